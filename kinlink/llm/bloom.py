"""Bloom filters of bounded size as DataFrames of 64-bit words, all in native expressions.

A filter has ``m`` slots (a power of two).  Only words with a set bit are stored, so a
filter never exceeds ``m / 64`` rows of two longs; that bound is what allows broadcasting
it.  A filter that is too full lets more rows through, it never loses one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.plans.scratch import keep

HASHES = 2
MIN_SLOTS = 1 << 16
#: 2**27 slots: at most 2**21 words, 32 MB of (word, bits) rows.
MAX_SLOTS = 1 << 27


def slots_for(rows: int, per_row: int = 16, most: int = MAX_SLOTS) -> int:
    """Slots for so many rows: a power of two between MIN_SLOTS and ``most``."""
    m = MIN_SLOTS
    while m < rows * per_row and m < most:
        m *= 2
    return m


def _slots(key: Column, m: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(m)) for seed in range(HASHES)]


def _as_words(slots: DataFrame) -> DataFrame:
    return slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"))


def member_words(keys: DataFrame, key: str, m: int) -> DataFrame:
    """The filter of all keys: (word, bits)."""
    return _as_words(keys.select(F.explode(F.array(*_slots(F.col(key), m))).alias("slot")))


def repeat_words(keys: DataFrame, key: str, m: int) -> DataFrame:
    """The filter of slots that two or more rows hit.

    A tally per slot is combined on the map side, so what is exchanged is slot counters,
    never rows of the input, and a hot key costs one counter per task.
    """
    slots = keys.select(F.explode(F.array(*_slots(F.col(key), m))).alias("slot"))
    return _as_words(slots.groupBy("slot").count().filter("count > 1").select("slot"))


def flag(df: DataFrame, key: str, words: DataFrame, m: int, name: str) -> DataFrame:
    """Add boolean ``name``: false if the key is surely not in the filter."""
    hit = []
    for i, slot in enumerate(_slots(F.col(key), m)):
        w, b = f"__kl_w{i}", f"__kl_b{i}"
        side = words.select(F.col("word").alias(w), F.col("bits").alias(b))
        df = df.withColumn(f"__kl_s{i}", slot)
        df = df.join(F.broadcast(side), F.shiftright(f"__kl_s{i}", 6) == F.col(w), "left")
        hit.append(F.expr(f"coalesce(shiftrightunsigned({b}, cast(__kl_s{i} & 63 as int)) & 1L, 0L) = 1L"))
    df = df.withColumn(name, reduce(lambda a, b: a & b, hit))
    return df.drop(*[f"__kl_{c}{i}" for i in range(HASHES) for c in "swb"])


#: Ids that are dropped by a broadcast of them (a few MB), and not by filters.
BROADCAST_ROWS = 100_000


def drop_ids(docs: DataFrame, losers: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the rows whose id is in ``losers`` (its column ``id_col``); rows with a null id stay.

    Few losers are broadcast.  Of more, a filter rules out most other rows, which pass straight through.
    Ids that pass it by chance are told from losers on a table of ids alone; a second filter of these finds their
    rows, and only what passes both is exchanged.  The losers' own texts never move.
    """
    n = losers.count()
    only = losers.select(id_col)
    if n <= BROADCAST_ROWS:
        return docs.join(F.broadcast(only), id_col, "left_anti").select(docs.columns)
    m = slots_for(n)
    words = keep(member_words(only, id_col, m), "drop-filter")
    unsure = F.col("__kl_maybe") & F.col(id_col).isNotNull()
    tested = flag(docs, id_col, words, m, "__kl_maybe")
    chance = keep(flag(docs.select(id_col), id_col, words, m, "__kl_maybe").filter(unsure).select(id_col).join(only, id_col, "left_anti").distinct(), "drop-chance")
    m2 = slots_for(chance.count())
    second = flag(tested.filter(unsure), id_col, keep(member_words(chance, id_col, m2), "drop-filter"), m2, "__kl_again").filter("__kl_again")
    stay = second.join(chance, id_col, "left_semi")
    return tested.filter(~unsure).select(docs.columns).unionByName(stay.select(docs.columns))
