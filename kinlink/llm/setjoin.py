"""Jaccard self-join of word shingle sets by PartEnum signatures, down to its components.

Sets are put into size bands whose bounds grow by 1/similarity, so that partners are in one band or the
next.  For each such pair of bands the Hamming distance of partners is at most some k.  The
feature domain (shingle hashes) is cut into n1 partitions of n2 parts; by the pigeonhole
principle partners differ in at most k2 parts of some partition, so one of the ways to leave out k2 of
its n2 parts leaves equal features: the hash of what is left, with band, partition and
way, is a signature that both share.  ``scheme`` picks n1, n2 and k2 by the band.

All signatures are made and no link is lost.  A way whose parts are empty is a signature too, shared by every
set without features there.  So ``spare`` more partitions are made than the principle needs: at least spare + 1
partitions of partners then agree in some way, and a set with empty ways in at most ``spare`` partitions
has one among these that isn't empty, which its partner makes as well.  Such a set leaves its empty
signatures out; the few others send them.

Documents of equal sets are folded to one (the least id) before signatures are made.  Ids that share a
signature form a bucket.  To the ids of the distinct buckets come their sets' sizes and the counts of their features in
BINS equal parts of the hash domain: the sum of the lesser counts bounds the intersection, so most pairs that share a
signature by chance are ruled out for certain, and only what may link is closed to candidate families.  A family of bounded size is settled in one task, exactly, by the intersection sizes of all its sets;
of a larger one the stars are tested first, and then, block by block, what these leave outside its largest
component against all its members.  Hot signatures are folded to one row per task before the exchange; their
ids are closed without a bound, which can only enlarge a family.

Defined cases: null or empty text has an empty set and no links; with fewer words than a shingle the
whole sequence is the one shingle; equal texts link; rows that repeat an id are one node; a row with
a null id has no links and a null component; an empty table gives no rows.  Texts of any length are
taken whole.  Ids are integers; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm import bloom
from kinlink.llm.components import components
from kinlink.llm.words import chain, hash_words, mix, portions
from kinlink.plans.scratch import keep, ship, shuffle_partitions

#: Rows of (signature, id) gathered before they are sorted and sent, and rows that meet in a task.
FLUSH, MEET = 1 << 18, 1 << 20
#: One task's rows of one signature beyond this are folded to one.
FOLD = 64
#: Ids in one row of a folded signature; larger buckets are closed without looking at their pairs.
CHUNK = 1024
#: Parts of the hash domain whose features are counted for each set.
BINS = 64
#: Families beyond these are settled by several tasks.
FAMILY_DOCS = 2048
FAMILY_SHINGLES = 4_000_000
#: Features a signature should have.
FEATURES = 3.4
#: Members tested against a centre in one task.
TESTED = 2048
BROADCAST_ROWS = 200_000
#: Groups of equal sets above rows / HOT_SHARE are at most HOT_SHARE many.
HOT_SHARE, HOT_LEAST = 2048, 1000


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    h, at = hash_words(column, lower=True)
    s = chain(h, words)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= words:
            out.append(np.unique(s[a : b - words + 1]))
        else:
            out.append(chain(h[a:b], int(b - a)) if b > a else np.empty(0, np.uint64))
    return out


@functools.cache
def band(size: int, num: int, den: int) -> int:
    """The band of a set's size."""
    i, low = 0, 1
    while (high := low * den // num) < size:
        i, low = i + 1, high + 1
    return i


@functools.cache
def bounds(i: int, num: int, den: int) -> tuple[int, int]:
    low = 1
    for _ in range(i):
        low = low * den // num + 1
    return low, low * den // num


@functools.cache
def scheme(i: int, num: int, den: int) -> tuple[int, int, int, int]:
    """(n1, n2, k2, spare) for sets of band i and their partners of band i or i + 1; n1 counts the spare partitions."""
    low, high = bounds(i, num, den)
    most = high + high * den // num
    k = max(s - 2 * -(-num * s // (num + den)) for s in range(max(2 * low, most - 2 * den), most + 1))
    if k <= 0:
        return 1, 1, 0, 0
    best = None
    for k2 in range(min(k, 4) + 1):
        least = -(-(k + 1) // (k2 + 1))
        for n2 in range(k2 + 1, k2 + 5):
            spare = 0
            while spare <= least:  # enough for the empty ways of all but odd sets
                none = math.exp(-low / ((least + spare) * n2))
                weak = (least + spare) * sum(math.comb(n2, j) * none**j * (1 - none) ** (n2 - j) for j in range(n2 - k2, n2 + 1))
                if spare >= weak + 2.5 * math.sqrt(weak):
                    break
                spare += 1
            if spare > least:
                spare = 0
            n1 = least + spare
            features = low / n1 * (n2 - k2) / n2
            cost = n1 * math.comb(n2, k2)
            rank = (features < FEATURES, cost if features >= FEATURES else -features)
            if best is None or rank < best[0]:
                best = rank, (n1, n2, k2, spare)
    return best[1]


@functools.cache
def _layout(i: int, num: int, den: int):
    """Shape, spare partitions, edges of the parts in the hash domain, ways to keep parts, salts of the signatures."""
    n1, n2, k2, spare = scheme(i, num, den)
    edges = np.array([(p << 64) // (n1 * n2) for p in range(n1 * n2)], np.uint64)
    ways = np.array([[j not in out for j in range(n2)] for out in itertools.combinations(range(n2), k2)], np.uint64)
    salt = mix(np.arange(n1 * len(ways), dtype=np.uint64) + np.uint64((i + 1) << 40))
    return (n1, n2), spare, edges, ways, salt


def signatures(s: np.ndarray, i: int, num: int, den: int) -> np.ndarray:
    """The signatures of the sorted set s for the pair of bands i and i + 1."""
    shape, spare, edges, ways, salt = _layout(i, num, den)
    sums = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(mix(s + np.uint64(0x632BE59BD9B4E019)), out=sums[1:])
    at = np.append(np.searchsorted(s, edges), len(s))
    out = mix(((sums[at[1:]] - sums[at[:-1]]).reshape(shape) @ ways.T).ravel() ^ salt)
    filled = np.diff(at).reshape(shape) @ ways.T.astype(np.int64) > 0
    return out[filled.ravel()] if (~filled).any(1).sum() <= spare else out


def profile(s: np.ndarray) -> np.ndarray:
    """Size and counts by part of the hash domain, all zero where they don't fit, which rules nothing out."""
    counts = np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=BINS)
    return np.append(len(s), counts).astype(np.uint16) if len(s) < 1 << 16 else np.zeros(BINS + 1, np.uint16)


def _alike(profiles: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """Groups of members connected by pairs that may link; with too many members, one group of all."""
    m = len(profiles)
    if m > CHUNK:
        return [np.arange(m)]
    size, counts = profiles[:, 0].astype(np.int64), profiles[:, 1:]
    near = np.zeros((m, m), bool)
    for i in range(m):
        both = np.minimum(counts[i], counts[i:]).sum(1, dtype=np.int64)
        near[i, i:] = (den * both >= num * (size[i] + size[i:] - both)) | (size[i] == 0) | (size[i:] == 0)
    if m == 2:
        return [np.arange(2)] if near[0, 1] else []
    labels = _least_reached(near | near.T, np.arange(m))
    return [g for k in np.unique(labels) if len(g := np.flatnonzero(labels == k)) > 1]


class _Payload:
    """Rows (signature's low half, id) of one part as bytes; the last ``folded`` of them stand for folded signatures."""

    @staticmethod
    def pack(low: np.ndarray, ids: np.ndarray, folded: np.ndarray) -> bytes:
        order = np.argsort(folded, kind="stable")
        low, ids = low[order].astype(np.uint32), ids[order]
        base = int(ids.min())
        narrow = int(ids.max()) - base < 1 << 32
        ids = (ids - base).astype(np.uint32) if narrow else ids
        return np.array([len(low), folded.sum(), narrow, base], np.int64).tobytes() + low.tobytes() + ids.tobytes()

    @staticmethod
    def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, folded, narrow, base = np.frombuffer(data, np.int64, 4).tolist()
        low = np.frombuffer(data, np.uint32, n, 32)
        ids = np.frombuffer(data, np.uint32 if narrow else np.int64, n, 32 + 4 * n).astype(np.int64)
        return low, ids + base if narrow else ids, np.arange(n) >= n - folded


def _buckets(docs: DataFrame, words: int, num: int, den: int, parts: int) -> DataFrame:
    """(ids, closed): distinct sorted lists of two or more ids that share a signature.

    Where a task has many ids of one signature it makes lists of them itself, each with the same first id, which
    alone goes on to the list made after the exchange.  Such lists, and those of more than CHUNK ids, are ``closed``:
    their ids have to stay together.  A signature is cut to its part and 32 more bits: a bucket may
    hold two of them, which only adds pairs to test.
    """
    schema = "part int, lists boolean, payload binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, int]] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            ids = np.repeat(np.array([w[1] for w in waiting], np.int64), [len(w[0]) for w in waiting])
            sigs = np.concatenate([w[0] for w in waiting])
            waiting.clear()
            order = np.argsort(sigs, kind="stable")
            sigs, ids = sigs[order], ids[order]
            starts = np.flatnonzero(np.concatenate(([True], sigs[1:] != sigs[:-1])))
            length = np.diff(np.append(starts, len(sigs)))
            stay, folded = np.ones(len(sigs), bool), np.zeros(len(sigs), bool)
            out: dict[tuple[int, bool, bytes], None] = {}
            for a, n in zip(starts[length > FOLD].tolist(), length[length > FOLD].tolist()):
                own = np.unique(ids[a : a + n])
                stay[a + 1 : a + n] = False
                ids[a], folded[a] = own[0], True
                for b in range(1, len(own), CHUNK - 1):
                    out[int(own[0]) % parts, True, np.concatenate((own[:1], own[b : b + CHUNK - 1])).tobytes()] = None
            sigs, ids, folded = sigs[stay], ids[stay], folded[stay]
            at = np.searchsorted(((sigs >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
            for p in np.flatnonzero(np.diff(at)).tolist():
                own = slice(at[p], at[p + 1])
                out[p, False, _Payload.pack(sigs[own], ids[own], folded[own])] = None
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.bool_(), pa.binary()))], ["part", "lists", "payload"])

        for b in portions(batches):
            for i, s in zip(b.column("id").to_pylist(), shingle_sets(b.column("text"), words)):
                if i is not None and len(s):
                    k = band(len(s), num, den)
                    for j in (k, k - 1) if k else (k,):
                        waiting.append((signatures(s, j, num, den), i))
                        rows += len(waiting[-1][0])
                if rows >= FLUSH:
                    yield flush()
                    rows = 0
        if rows:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        rows, out = [], {}
        for lists, payload in zip(table["lists"].to_pylist(), table["payload"].to_pylist()):
            if lists:
                out[payload] = True
            else:
                rows.append(_Payload.unpack(payload))
        if rows:
            low, ids, folded = (np.concatenate(x) for x in zip(*rows))
            order = np.lexsort((ids, low))
            low, ids, folded = low[order], ids[order], folded[order]
            starts = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
            length = np.diff(np.append(starts, len(low)))
            closed = np.logical_or.reduceat(folded, starts) | (length > CHUNK)
            for a, n, c in zip(*(x[length > 1].tolist() for x in (starts, length, closed))):
                own = ids[a : a + n]
                if (own[1:] == own[:-1]).any():
                    own = np.unique(own)
                if len(own) > 1:
                    key = own.tobytes()
                    out[key] = c or out.get(key, False)
        return pa.table({"ids": pa.array([np.frombuffer(o, np.int64) for o in out], pa.list_(pa.int64())), "closed": pa.array(list(out.values()), pa.bool_())})

    sent = docs.mapInArrow(send, schema)
    return sent.groupBy("part").applyInArrow(meet, "ids array<long>, closed boolean").groupBy("ids").agg(F.max("closed").alias("closed"))


def _possible(buckets: DataFrame, profiles: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): stars of the ids in each bucket that pairs which may link connect; profiles: (id, profile or null)."""
    named = buckets.filter("not closed").select(F.xxhash64("ids").alias("bucket"), F.explode("ids").alias("id"))
    members = named.join(profiles.hint("merge"), "id")  # exploded lists look small to Spark: without it they may be broadcast
    bins = shuffle_partitions(buckets.sparkSession, named.count(), 1 << 16)
    none = np.zeros(BINS + 1, np.uint16).tobytes()

    def run(table: pa.Table) -> pa.Table:
        bucket, ids = table["bucket"].to_numpy(), table["id"].to_numpy()
        profile_of = np.frombuffer(b"".join(x or none for x in table["profile"].to_pylist()), np.uint16).reshape(-1, BINS + 1)
        order = np.lexsort((ids, bucket))
        bucket, ids, profile_of = bucket[order], ids[order], profile_of[order]
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        pairs = set()
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)]):
            for group in _alike(profile_of[a:b], num, den):
                own = ids[a:b][group].tolist()
                pairs.update((own[0], x) for x in own[1:])
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    found = members.withColumn("bin", F.pmod("bucket", F.lit(bins))).groupBy("bin").applyInArrow(run, "a long, b long")
    closed = buckets.filter("closed").select(F.element_at("ids", 1).alias("a"), F.explode(F.slice("ids", 2, F.greatest(F.size("ids"), F.lit(2)))).alias("b"))
    return found.unionByName(closed).filter("a <> b").distinct()


def _linked(sets: list[np.ndarray], num: int, den: int, first: int | None = None) -> np.ndarray:
    """Boolean matrix of the links between the sets, from all their intersection sizes; with ``first``,
    of the links between the first so many and the rest."""
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    kinds, place = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), n)
    cut = slice(0, m) if first is None else slice(first, m)
    first = m if first is None else first
    both = np.zeros((first, m - cut.start), np.float32)
    step = max(1, 8_000_000 // m)
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    for a in range(0, len(kinds), step):
        lo, hi = np.searchsorted(place, [a, a + step])
        x = np.zeros((m, min(step, len(kinds) - a)), np.float32)
        x[row[lo:hi], place[lo:hi] - a] = 1
        both += x[:first] @ x[cut].T
    total = n[:first, None] + n[None, cut] - both
    return (both > 0) & (den * both.astype(np.float64) >= num * total)


def _least_reached(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id reachable from each row of the matrix."""
    out = np.full(len(ids), -1, np.int64)
    done = np.zeros(len(ids), bool)
    for i in np.argsort(ids, kind="stable"):
        if not done[i]:
            front = np.zeros(len(ids), bool)
            front[i] = True
            seen = front.copy()
            while front.any():
                front = linked[front].any(0) & ~seen
                seen |= front
            done |= seen
            out[seen] = ids[i]
    return out


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text, columns of wanted) of the documents in ``wanted`` (id, ...)."""
    n = wanted.count()
    if n <= BROADCAST_ROWS:
        return docs.join(F.broadcast(wanted), "id")
    m = bloom.slots_for(n)
    words = keep(bloom.member_words(wanted, "id", m), "join-members")
    return bloom.flag(docs, "id", words, m, "__kl_maybe").filter("__kl_maybe").drop("__kl_maybe").join(wanted.hint("merge"), "id")


def _settle(docs: DataFrame, members: DataFrame, words: int, num: int, den: int, bins: int) -> DataFrame:
    """(id, component) of the families in ``members`` (id, family), each within one task."""
    rows = _texts_of(docs, members.withColumn("bin", F.pmod(F.xxhash64("family"), F.lit(bins))))

    def run(table: pa.Table) -> pa.Table:
        families, ids = table["family"].to_numpy(), table["id"].to_numpy()
        texts = table["text"].combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        order = np.argsort(families, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], families[order][1:] != families[order][:-1])))
        out_ids, out = [], []
        for a, b in zip(starts, np.append(starts[1:], len(order))):
            at = order[a:b]
            sets = shingle_sets(texts.take(pa.array(at)), words)
            out_ids.append(ids[at])
            out.append(_least_reached(_linked(sets, num, den) | (ids[at][:, None] == ids[at][None, :]), ids[at]))
        return pa.table({"id": np.concatenate(out_ids), "component": np.concatenate(out)})

    return rows.groupBy("bin").applyInArrow(run, "id long, component long")


def _verify(docs: DataFrame, pairs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link.  Members meet their centre in groups of bounded size."""
    sizes = keep(pairs.groupBy("a").count().withColumn("cells", F.ceil(F.col("count") / TESTED).cast("int")).select("a", "cells"), "join-cells")
    several = sizes.filter("cells > 1")  # the others need no join, so no task gets all pairs of a centre
    if several.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        several = F.broadcast(several)
    cells = F.coalesce("cells", F.lit(1))
    dealt = pairs.join(several, "a", "left").select("a", F.col("b").alias("id"), F.pmod(F.xxhash64("b"), cells.cast("long")).alias("cell"), F.lit(False).alias("centre"))
    centres = sizes.select("a", F.col("a").alias("id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells").cast("long") - 1)).alias("cell"), F.lit(True).alias("centre"))
    wanted = keep(dealt.unionByName(centres), "join-tests")
    rows = _texts_of(docs, wanted)

    def run(table: pa.Table) -> pa.Table:
        ids, centre = table["id"].to_numpy(), table["centre"].to_numpy()
        texts = table["text"].combine_chunks()
        sets = shingle_sets(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts, words)
        c = [sets[i] for i in np.flatnonzero(centre)]
        a = int(table["a"][0].as_py())
        found = set()
        for i in np.flatnonzero(~centre):
            for s in c:
                both = len(np.intersect1d(s, sets[i], assume_unique=True))
                if den * both >= num * (len(s) + len(sets[i]) - both):
                    found.add(int(ids[i]))
        return pa.table({"a": pa.array([a] * len(found), pa.int64()), "b": pa.array(sorted(found), pa.int64())})

    return rows.groupBy("a", "cell").applyInArrow(run, "a long, b long")


def _settle_large(docs: DataFrame, members: DataFrame, stars: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(id, component) of families too large for one task; members: (id, family), stars: (a, b).

    The stars are tested first, which needs one test a member and joins most of a group of copies.  A
    link that is still missing has an end outside the family's largest component, so what is outside
    is then compared with all members, block by block: a task holds TESTED of each.
    """
    links = keep(_verify(docs, stars, words, num, den), "join-links")
    labels = components(links)
    now = keep(members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")), "join-large")
    sizes = now.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    extent = sizes.groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("rest"))
    extent = extent.filter("rest > 0").withColumns({c: F.ceil(F.col(k) / TESTED) for c, k in (("cells", "all"), ("blocks", "rest"))})
    now = now.join(extent, "family")
    deal = lambda seed, c: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    inside = now.select("id", "family", F.lit(False).alias("outside"), deal(1, "cells").alias("cell"), every("blocks").alias("block"))
    outside = now.filter("component <> main").select("id", "family", F.lit(True).alias("outside"), every("cells").alias("cell"), deal(2, "blocks").alias("block"))
    rows = _texts_of(docs, keep(inside.unionByName(outside), "join-blocks"))

    def run(table: pa.Table) -> pa.Table:
        ids, outer = table["id"].to_numpy(), table["outside"].to_numpy()
        order = np.argsort(~outer, kind="stable")
        ids, n = ids[order], int(outer.sum())
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        if 0 < n < len(ids):
            texts = table["text"].combine_chunks()
            sets = shingle_sets((texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts).take(pa.array(order)), words)
            linked = np.zeros((len(ids), len(ids)), bool)
            linked[:n, n:] = _linked(sets, num, den, n)
            a, b = _least_reached(linked | linked.T, ids), ids  # a star for each connected part: as many links as ids
        return pa.table({"a": a, "b": b})

    found = rows.groupBy("family", "cell", "block").applyInArrow(run, "a long, b long").filter("a <> b")
    return components(links.unionByName(found))


def _equal_sets(each: DataFrame) -> DataFrame:
    """(id, rep): ids whose set equals that of a lesser id, ``rep``; each: (id, rows, n, h1, h2) with a 128-bit hash of
    the set.

    Ids with several rows are left as they are.  Groups are counted by a map-side combine, and hot ones join
    by a broadcast of at most HOT_SHARE rows.
    """
    key = ["n", "h1", "h2"]
    single = each.filter("rows = 1").select("id", *key)
    groups = keep(single.groupBy(*key).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "join-equal")
    limit = max(HOT_LEAST, (groups.agg(F.sum("size")).first()[0] or 0) // HOT_SHARE)
    hot, cold = groups.filter(F.col("size") > limit).drop("size"), groups.filter(F.col("size") <= limit).drop("size")
    found = single.join(F.broadcast(hot), key).unionByName(single.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key))
    return keep(found.filter("id <> rep").select("id", "rep"), "join-copies")


def link(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (least id reachable by links)."""
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            sets = shingle_sets(b.column("text"), words)
            hashes = [[int(mix(s + np.uint64(seed)).sum().view(np.int64)) for s in sets] for seed in (0x51ED270B, 0x2545F491)]
            columns = [pa.array([len(s) for s in sets], pa.int64()), *[pa.array(h, pa.int64()) for h in hashes], pa.array([profile(s).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("id"), *columns], ["id", "n", "h1", "h2", "profile"])

    sizes = keep(base.mapInArrow(count, "id long, n long, h1 long, h2 long, profile binary"), "join-sizes")
    kinds = [F.first(c).alias(c) for c in ("h1", "h2")]
    one_row = F.when(F.count(F.lit(1)) == 1, F.first("profile")).alias("profile")  # of several rows, no bound holds for all
    each = keep(sizes.filter("id is not null and n > 0").groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), *kinds, one_row), "join-each")
    copies = _equal_sets(each)
    own = bloom.drop_ids(base, copies, "id")
    shingles = sizes.agg(F.sum("n")).first()[0] or 0
    buckets = keep(_buckets(own, words, num, den, shuffle_partitions(spark, shingles, MEET)), "join-buckets")
    stars = keep(_possible(buckets, each.select("id", "profile"), num, den), "join-stars")
    families = keep(components(stars).select("id", F.col("component").alias("family")), "join-families")
    extent = families.join(each.select("id", "n"), "id").groupBy("family").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"))
    extent = keep(extent.withColumn("large", (F.col("docs") > FAMILY_DOCS) | (F.col("shingles") > FAMILY_SHINGLES)), "join-extent")
    total = extent.groupBy("large").agg(F.sum("shingles").alias("n")).collect()
    small = sum(r["n"] for r in total if not r["large"])
    marked = keep(families.join(extent.select("family", "large"), "family"), "join-marked")
    out = []
    if small:
        out.append(_settle(own, marked.filter("not large").select("id", "family"), words, num, den, max(shuffle_partitions(spark), small // FAMILY_SHINGLES + 1)))
    if any(r["large"] for r in total):
        large = keep(marked.filter("large").select("id", "family"), "join-large-members")
        out.append(_settle_large(own, large, stars.join(large.select(F.col("id").alias("a")), "a", "left_semi"), words, num, den))
    labels = sizes.select("id", F.col("id").alias("component")).limit(0)
    for x in out:
        labels = labels.unionByName(x.select("id", "component").distinct())
    labels = keep(labels, "join-labels")
    # a copy takes the label of its representative, which is the least id of its group but maybe not of its component
    copied = copies.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    done = sizes.join(labels.unionByName(copied), "id", "left")
    return done.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").cast(docs.schema[id_col].dataType).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document (the least id) of each group of near duplicates."""
    losers = link(docs, words, num, den, id_col, text_col).filter(f"{id_col} <> component_id").select(id_col)
    return bloom.drop_ids(docs, keep(losers, "join-losers"), id_col)
