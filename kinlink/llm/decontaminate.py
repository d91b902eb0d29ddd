"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Words are runs of letters and digits, lower-cased, without regard to punctuation; in scripts without spaces each
character is a word.  An item of n words may differ from its closest stretch in k = floor(n * (1 - similarity))
word edits.

The CGK embedding walks over a window of words: at step j it writes the word it stands on, and moves on if a random
function of j and that word says so.  Two windows at a small edit distance have embeddings at a small Hamming
distance, since the walks go together until an edit and may fall into step again after it.  Bit sampling hashes a few
steps of the embedding.  Every window of a document is embedded, one from each word, and every window of an item, so
a pair is found if the sampled steps of one walk stay between two edits.

``plan`` picks the number of steps and of walks by the item's length: n - k words that no edit touches lie in at
most k + 1 stretches, and if the longest has m words, at least (n - k) - (m - 1)(k + 1) of them have m.  A walk of s
steps stays within m words if it moves at most m - 1 times in s - 1 steps.  The miss that remains after all walks
is at most 1 - recall however the edits lie.  Items too short for an edit (under 5 words at 0.8) have windows
of just their size, whose embeddings are equal, so one walk finds every copy.

After each of the first sampled steps the windows whose key so far is not an item's are left out, so the work is a
few passes over the words and doesn't grow with the items but for matches.  A match names item and diagonal.  The
words of the item-sized window on it are counted: all but k of the item's words must occur there.  What is left is
compared by the exact edit distance in words between the whole item and the best stretch of the window.

The items are broadcast in groups of at most GROUP_CHARS characters, documents are read once for each group (one, for
all but huge benchmarks), and a worker holds the index of a few blocks of BLOCK_WORDS words at a time.

Defined cases: null or empty documents and items, and items without a word, match nothing; items too short for an
edit match where they occur word for word; null ids are kept as they are; repeated documents or items give a row
each; ties between stretches go to the first; an empty table on either side gives no rows.  Columns other than id
and text are not looked at, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kinlink.llm.words import hash_words, mix, portions
from kinlink.plans.scratch import ship

SIMILARITY = 0.8
RECALL = 0.999
SEED = 404
#: Most walks of an item; more steps, which make a key rarer, are taken only while that is enough.
WALKS = 6
STEPS = (12, 10, 8, 6, 5, 4, 3, 2, 1)
#: Characters of items in one broadcast, words of items in one index, indexes held by a worker.
GROUP_CHARS = 1 << 26
BLOCK_WORDS = 200_000
HELD = 3
#: Matches and words of their windows looked at together.
MATCHES = 1 << 20
#: Sampled steps after which windows are left out, and bits of the tables used for it.
SIEVES = 4
_SIEVE = 20
#: What a walk reads behind the end of an item-sized window.
_END = np.uint64(0x7E57AB1E)
#: Characters of scripts without spaces; characters outside ASCII that are neither letters, marks nor digits.
UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
MARKS = r"[^\x{00}-\x{7F}\p{L}\p{M}\p{N}]"


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets by text)."""
    if not pc.all(pc.string_is_ascii(column)).as_py():
        column = pc.replace_substring_regex(column, MARKS, " ")
        if pc.any(pc.match_substring_regex(column, UNSPACED)).as_py():
            column = pc.replace_substring_regex(column, f"({UNSPACED})", r" \1 ")
    return hash_words(column, lower=True, bare=True)


def most_edits(n: int, similarity: float) -> int:
    """Word edits that a stretch may be away from an item of n words."""
    return int(n * (1 - similarity) + 1e-9)


@functools.cache
def plan(n: int, similarity: float, recall: float) -> tuple[int, int]:
    """(steps, walks) for items of n words: the most steps with which WALKS walks reach the recall."""
    k = most_edits(n, similarity)
    if k == 0:
        return 2 * n, 1
    m = -(-(n - k) // (k + 1))
    many = (n - k) - (m - 1) * (k + 1)
    stays = lambda s, words: sum(math.comb(s - 1, i) for i in range(min(words, s))) / 2 ** (s - 1)
    for s in STEPS:
        miss = (1 - stays(s, m)) ** many * (1 - stays(s, m - 1)) ** (k + 1 - many)
        walks = 1 if miss <= 0 else math.ceil(math.log(1 - recall) / math.log(miss)) if miss < 1 else WALKS + 1
        if walks <= WALKS:
            return s, walks
    raise ValueError("recall can't be reached")  # not met: one step always stays within a word


def _moves(word: np.ndarray, walk: int, j: int) -> np.ndarray:
    """The random function of the walk, the step and the word: 0 or 1."""
    odd = int(mix(np.array([SEED * 1_000_003 + walk * 1009 + j], np.uint64))[0]) | 1
    return ((word * np.uint64(odd)) >> np.uint64(63)).astype(np.int64)


def _write(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    key = (key ^ word) * np.uint64(0x9FB21C651E98DF25)
    return key ^ key >> np.uint64(29)


def _place(key: np.ndarray) -> np.ndarray:
    return (mix(key) >> np.uint64(64 - _SIEVE)).astype(np.int64)


class _Walk:
    """One walk over all windows of some items, of their own numbers of steps; ``width``: size of the windows, or 0
    where they are only bounded by the item."""

    def __init__(self, number: int, width: int, h: np.ndarray, starts: np.ndarray, ends: np.ndarray, item: np.ndarray, offset: np.ndarray, steps: np.ndarray):
        self.number, self.width, self.steps = number, width, int(steps.max())
        rng = np.random.default_rng([SEED, number, width])
        last = {int(s) - 1 for s in np.unique(steps)}
        self.sampled = sorted({0, *last, *np.flatnonzero(rng.random(self.steps) < 0.6).tolist()})
        self.sieves: dict[int, np.ndarray] = {}
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for j, keys, rows in self._run(h, starts, ends, steps):
            if len(self.sieves) < SIEVES:
                sieve = np.zeros(1 << _SIEVE, bool)
                sieve[_place(keys)] = True
                self.sieves[j] = sieve
            if j in last:
                of = steps[rows] == j + 1
                order = np.argsort(keys[of], kind="stable")
                if len(order):
                    self.tables[j] = keys[of][order], item[rows][of][order], offset[rows][of][order]

    def _run(self, h: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(step, keys, rows) at the sampled steps, for the items' windows that aren't left by then."""
        h = np.append(h, _END)
        rows, at, key = np.arange(len(starts)), starts.copy(), np.full(len(starts), self.width, np.uint64)
        for j in range(self.steps):
            inside = at < ends[rows]
            now = np.where(inside, h[np.minimum(at, len(h) - 1)], _END)
            use = steps[rows] > j
            if j in self.sampled:
                if not self.width:
                    use &= inside
                rows, at, now, key = rows[use], at[use], now[use], _write(key[use], now[use])
                yield j, key, rows
            at = at + _moves(now, self.number, j)

    def matches(self, h: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(step, starts, lo, hi): windows of the words h whose key is in the step's table, and where."""
        padded = np.append(h, np.full(self.steps + 1, _END))
        start = np.arange(len(h))
        at, key = start, np.full(len(h), self.width, np.uint64)
        for j in range(self.steps):
            now = padded[at]
            if self.width:
                now = np.where(at < start + self.width, now, _END)
            if j in self.sampled:
                key = _write(key, now)
                if j in self.sieves:
                    alive = np.flatnonzero(self.sieves[j][_place(key)])
                    start, at, key, now = start[alive], at[alive], key[alive], now[alive]
                if j in self.tables:
                    table = self.tables[j][0]
                    lo, hi = np.searchsorted(table, key, "left"), np.searchsorted(table, key, "right")
                    some = np.flatnonzero(hi > lo)
                    yield j, start[some], lo[some], hi[some]
            if not len(start):
                return
            at = at + _moves(now, self.number, j)
            if not self.width:
                at = np.minimum(at, len(padded) - 1)


class _Index:
    """Items in one block: their words, and the walks over their windows."""

    def __init__(self, ids: list, texts: list[str], similarity: float, recall: float):
        h, at = words_of(pa.array(texts, pa.string()))
        self.ids = ids
        self.items = [h[a:b] for a, b in zip(at[:-1], at[1:])]
        self.masks = []
        for w in self.items:
            masks: dict[int, int] = {}
            for i, x in enumerate(w.tolist()):
                masks[x] = masks.get(x, 0) | 1 << i
            self.masks.append(masks)
        self.lengths = np.diff(at)
        self.most = np.array([most_edits(n, similarity) for n in self.lengths.tolist()], np.int64)
        #: Word and item in one number, to ask whether an item has a word; how often it has it isn't asked.
        self.has = np.unique(_both(h, np.repeat(np.arange(len(ids)), self.lengths)))
        plans = np.array([plan(n, similarity, recall) if n else (0, 0) for n in self.lengths.tolist()], np.int64).reshape(-1, 2)
        exact = self.most == 0
        self.walks = []
        for n in np.unique(self.lengths[exact & (self.lengths > 0)]).tolist():
            own = np.flatnonzero(exact & (self.lengths == n))
            self.walks.append(_Walk(0, n, h, at[own], at[own + 1], own, np.zeros(len(own), np.int64), plans[own, 0]))
        for number in range(int(plans[~exact, 1].max(initial=0))):
            own = np.flatnonzero(~exact & (plans[:, 1] > number))
            n = self.lengths[own]
            item = np.repeat(own, n)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            self.walks.append(_Walk(number, 0, h, at[item] + offset, at[item + 1], item, offset, plans[item, 0]))

    def candidates(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distinct (document, item, diagonal) with a key in common, and enough words in the window."""
        found = [np.empty((0, 3), np.int64)]
        for walk in self.walks:
            for j, start, lo, hi in walk.matches(h):
                _, item, offset = walk.tables[j]
                doc = np.searchsorted(at, start, "right") - 1
                n = hi - lo
                total = np.cumsum(n)
                a = 0
                while a < len(start):  # windows of at most MATCHES matches, or one window
                    b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + MATCHES, "right")))
                    m = n[a:b]
                    each = np.repeat(lo[a:b], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    rows = np.unique(np.stack((np.repeat(doc[a:b], m), item[each], np.repeat(start[a:b], m) - offset[each]), 1), axis=0)
                    found.append(rows[self._enough(h, at, rows)])
                    a = b
        return np.unique(np.concatenate(found), axis=0)

    def _enough(self, h: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whether the window has n - k words of the item, for rows of (document, item, diagonal)."""
        doc, item, x = rows.T
        n, most = self.lengths[item], self.most[item]
        a, b = np.maximum(at[doc], x - most), np.minimum(at[doc + 1], x + n + most)
        enough = np.zeros(len(rows), bool)
        total = np.cumsum(b - a)
        i = 0
        while i < len(rows):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + MATCHES, "right")))
            m = (b - a)[i:j]
            first = np.cumsum(m) - m
            word = h[np.repeat(a[i:j] - first, m) + np.arange(m.sum())]
            key = _both(word, np.repeat(item[i:j], m))
            place = np.minimum(np.searchsorted(self.has, key), len(self.has) - 1)
            enough[i:j] = np.add.reduceat(self.has[place] == key, first, dtype=np.int64) >= (n - most)[i:j]
            i = j
        return enough


def _both(word: np.ndarray, item: np.ndarray) -> np.ndarray:
    return mix(word ^ mix(item.astype(np.uint64)))


def best_stretch(masks: dict[int, int], n: int, words: list[int]) -> tuple[int, int]:
    """(edit distance in words, end) of the stretch of ``words`` closest to an item of n words.

    Bit-parallel dynamic programming: one column of the table is two integers of n bits.
    """
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best, end = n, 0
    for k, w in enumerate(words, 1):
        eq = masks.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & full, up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        up, down = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, k
    return best, end


def _leaks(index: _Index, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, edit distance, word at which the stretch ends) of every pair that is close enough."""
    pairs: dict[tuple[int, int], list[int]] = {}
    for d, item, x in index.candidates(h, at).tolist():
        pairs.setdefault((d, item), []).append(x)
    for (d, item), diagonals in sorted(pairs.items()):
        n = len(index.items[item])
        most = int(index.most[item])
        lo, hi = int(at[d]), int(at[d + 1])
        windows: list[list[int]] = []
        for x in sorted(set(diagonals)):
            a, b = max(lo, x - most), min(hi, x + n + most)
            if windows and a <= windows[-1][1]:
                windows[-1][1] = b
            else:
                windows.append([a, b])
        best = None
        for a, b in windows:
            distance, end = best_stretch(index.masks[item], n, h[a:b].tolist())
            if distance <= most and (best is None or distance < best[0]):
                best = distance, a + end - lo
                if not distance:
                    break
        if best:
            yield d, item, *best


def find(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """One row per document and item that it holds: id, item, item_words, edit_distance, end_word.

    ``end_word``: the number of the document's words up to the end of the closest stretch.
    """
    if not 0.5 <= similarity <= 1:
        raise ValueError("similarity has to be from 0.5 to 1")
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).filter("text is not null")
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).filter("text is not null")
    doc_kind, item_kind = rows.schema["doc"].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    schema = f"doc {doc_kind}, item {item_kind}, item_words int, edit_distance int, end_word long"

    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = chars // GROUP_CHARS + 1
    out = None
    for k in range(groups):
        group = items.filter(F.pmod(F.xxhash64("text"), F.lit(groups)) == k).orderBy("text", "item").collect()  # GROUP_CHARS or so
        blocks: list[tuple[list, list[str]]] = []
        size = 4 * BLOCK_WORDS
        for r in group:
            if size >= 4 * BLOCK_WORDS:
                blocks.append(([], []))
                size = 0
            blocks[-1][0].append(r["item"])
            blocks[-1][1].append(r["text"])
            size += len(r["text"])
        found = _search(rows, spark.sparkContext.broadcast(blocks), similarity, recall, schema, to_arrow_type(items.schema["item"].dataType))
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "item_words", "edit_distance", "end_word")


@functools.lru_cache(maxsize=HELD)
def _index(shared: Broadcast, block: int, similarity: float, recall: float) -> _Index:
    """Made once a worker while it is among the last few used."""
    return _Index(*shared.value[block], similarity, recall)


def _search(rows: DataFrame, shared: Broadcast, similarity: float, recall: float, schema: str, item_type: pa.DataType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = len(shared.value)
        for b in portions(batches, most=1 << 21 if blocks <= HELD else 1 << 23):
            h, at = words_of(b.column("text"))
            for block in range(blocks):
                index = _index(shared, block, similarity, recall)
                found = list(_leaks(index, h, at))
                cols = [
                    b.column("doc").take(pa.array([f[0] for f in found], pa.int64())),
                    pa.array([index.ids[f[1]] for f in found], item_type),
                    pa.array([len(index.items[f[1]]) for f in found], pa.int32()),
                    pa.array([f[2] for f in found], pa.int32()),
                    pa.array([f[3] for f in found], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc", "item", "item_words", "edit_distance", "end_word"])

    return rows.mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold an item."""
    from kinlink.llm import bloom
    from kinlink.plans.scratch import keep

    return bloom.drop_ids(docs, keep(find(docs, benchmark, similarity, id_col, text_col).select(id_col).distinct(), "leaks"), id_col)
