"""Exact deduplication by two passes over a Bloom filter; native expressions only.

Pass 1 tallies hash slots and keeps those hit more than once as a bounded filter.  Pass 2
tests every row against it: a row with an unset slot is certainly unique and passes straight
through; only the others are exchanged, by their full SHA-256, to settle exact groups.  A filter has at most
``max_slots`` slots.  Where that is too few for the rows, the hashes are cut into ranges, and both passes are made
range by range with a filter of that size each, so the share of unique rows that a filter lets through by chance is
the same for any number of rows.

Defined cases: null text counts as empty; in a group the row with the largest id stays; a
null id loses to any other; rows that repeat an id with the same text count in
``group_size`` and are all marked as kept by ``decide`` (they are the same document), while
``keep_one`` returns a single one of them.  Empty tables give empty results; texts of any length are
hashed whole; other columns are carried by ``keep_one`` and not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm import bloom
from kinlink.plans.scratch import keep

#: Groups above rows / HOT_SHARE are at most HOT_SHARE many, so their table may be broadcast.
HOT_SHARE = 2048
HOT_LEAST = 1000


def _sha(text: str):
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def _resolve(rows: DataFrame, flagged: DataFrame, n: int) -> DataFrame:
    """Join (keep_id, group_size) of its SHA group to each of ``rows``.

    ``flagged``: (__kl_id, __kl_sha) of the same rows.  The tally per group is combined
    before the exchange.  Hot groups are joined by a broadcast of at most HOT_SHARE rows, so
    no task gets all copies of one text; the rest meets by an exchange on the hash.
    """
    limit = max(HOT_LEAST, n // HOT_SHARE)
    stats = flagged.groupBy("__kl_sha").agg(F.max("__kl_id").alias("__kl_keep"), F.count(F.lit(1)).alias("__kl_size"))
    stats = keep(stats, "dedup-groups")
    hot = stats.filter(F.col("__kl_size") > limit)
    cold = stats.filter(F.col("__kl_size") <= limit)
    hot_sha = F.broadcast(hot.select("__kl_sha"))
    return (
        rows.join(F.broadcast(hot), "__kl_sha")
        .unionByName(rows.join(hot_sha, "__kl_sha", "left_anti").join(cold, "__kl_sha"))
    )


def _tested(digests: DataFrame, slots_per_row: int, max_slots: int) -> tuple[int, DataFrame]:
    """(rows, digests with ``__kl_maybe``: false if no other row has the hash)."""
    n = digests.count()
    ranges = max(1, -(-n * slots_per_row // max_slots))
    m = bloom.slots_for(-(-n // ranges), slots_per_row, max_slots)
    out = None
    for k in range(ranges):
        part = digests.filter(F.pmod(F.xxhash64("__kl_sha", F.lit("range")), F.lit(ranges)) == k) if ranges > 1 else digests
        words = keep(bloom.repeat_words(part, "__kl_sha", m), "dedup-filter")
        tested = bloom.flag(part, "__kl_sha", words, m, "__kl_maybe")
        if ranges > 1:
            tested = keep(tested, "dedup-tested")  # one filter at a time is held
        out = tested if out is None else out.unionByName(tested)
    return n, out


def _groups(docs: DataFrame, id_col: str, text_col: str, slots_per_row: int, max_slots: int) -> tuple[DataFrame, DataFrame]:
    """(__kl_sha, __kl_id, __kl_keep, __kl_size) of rows that are surely alone, and of the others."""
    digests = keep(docs.select(F.col(id_col).alias("__kl_id"), F.unhex(_sha(text_col)).alias("__kl_sha")), "dedup-digests")
    n, tested = _tested(digests, slots_per_row, max_slots)
    alone = tested.filter(~F.col("__kl_maybe")).select("__kl_sha", "__kl_id", F.col("__kl_id").alias("__kl_keep"), F.lit(1).cast("long").alias("__kl_size"))
    maybe = tested.filter("__kl_maybe").select("__kl_id", "__kl_sha")
    return alone, _resolve(maybe, maybe, n)


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots_per_row: int = 16, max_slots: int = bloom.MAX_SLOTS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    alone, others = _groups(docs, id_col, text_col, slots_per_row, max_slots)
    return alone.unionByName(others).select(
        F.col("__kl_id").alias(id_col),
        F.col("__kl_keep").alias("keep_id"),
        F.col("__kl_size").alias("group_size"),
        F.col("__kl_id").eqNullSafe(F.col("__kl_keep")).alias("kept"),
        F.lower(F.hex("__kl_sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots_per_row: int = 16, max_slots: int = bloom.MAX_SLOTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Which rows go is settled on ids and hashes alone; texts stay where they are, but for the few that
    ``bloom.drop_ids`` has to look at twice and for one row of each that is repeated with its id.
    """
    def key(sha, number):
        return F.concat(sha, F.coalesce(number.cast("string"), F.lit("null")).cast("binary"))

    _, others = _groups(docs, id_col, text_col, slots_per_row, max_slots)
    rows = others.select(key(F.col("__kl_sha"), F.col("__kl_id")).alias("__kl_key"), F.col("__kl_id").eqNullSafe(F.col("__kl_keep")).alias("__kl_kept"))
    counts = rows.groupBy("__kl_key").agg(F.first("__kl_kept").alias("__kl_kept"), F.count(F.lit(1)).alias("__kl_n"))
    go = keep(counts.filter("not __kl_kept or __kl_n > 1"), "dedup-losers")
    keyed = docs.withColumn("__kl_key", key(F.unhex(_sha(text_col)), F.col(id_col)))
    left = bloom.drop_ids(keyed, go.select("__kl_key"), "__kl_key").select(docs.columns)
    repeated = go.filter("__kl_kept").select("__kl_key")
    n = repeated.count()
    if not n:
        return left
    once = keyed.join(F.broadcast(repeated) if n <= bloom.BROADCAST_ROWS else repeated, "__kl_key", "left_semi").dropDuplicates(["__kl_key"])
    return left.unionByName(once.select(docs.columns))
