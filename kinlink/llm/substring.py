"""Removal of long repeated word passages by prefix-partitioned suffix trees.

Every word is the start of a suffix; two suffixes with the first ``window`` words in common mark a
repeat.  A suffix is keyed by a prefix of variable length: up to the end of the least
hashed ``GRAM``-word run (its anchor) among those in its first ``window`` words.  Equal windows
have equal anchors at equal distance, so suffixes of different keys can't be repeats, and the keys
split all suffixes into independent groups, dealt to memory-sized partitions by the anchor.
Suffixes of one anchor lie side by side in the text, so they travel together as one strip of words.

First the anchors are tallied; a bounded bitmap of those seen twice or more leaves the rest out of
the exchange.  Anchors seen more than HEAVY times have too many suffixes for a group: their prefix is extended
to the whole window, so the suffixes are dealt by the hash of their first ``window`` words, one by one, and only
equal ones meet.  In a partition the suffix trees of all groups grow together from the top:
a node's leaves are parted by their next words, and branches with one leaf are cut.  Leaves
below an internal node as deep as the window are repeated windows; the words they cover go.

Identical strips within a task are sent once: their windows are known to repeat, so that a passage
in a third of all documents is one strip per task.

Defined cases: null or empty text has no words; with fewer words than the window nothing is removed;
a row that repeats another (same id and text) counts as another place, so both lose all their windows;
the input alone decides, not what is left.  The sha256 of no words is that of empty text.  Texts of any length are
taken whole; rows with a null id are told apart by their text; an empty table gives no rows; other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm import bloom
from kinlink.llm.words import chain, hash_words, mix, portions
from kinlink.plans.scratch import keep, ship, shuffle_partitions

WINDOW = 35
GRAM = 8
#: Words by which a tree grows in one step.
STEP = 5
#: Bits of the bitmap of repeated anchors: 2**28 bits are 32 MB on each worker.
MAX_BITS = 28
#: Strips of one anchor that may meet in a group, and bits of the bitmap of anchors with more.
HEAVY = 4096
HEAVY_BITS = 24
#: Words of strips, or anchors, gathered by a task before it sends them.
FLUSH_WORDS = 2_000_000
FLUSH_STRIPS = 20_000
FLUSH_ANCHORS = 1 << 20
#: Words looked at together; a place among them fits beside its hash in 64 bits.
SEGMENT = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)
#: A null id inside this module.
_NULL = -(1 << 63)


def _runs(h: np.ndarray, at: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, first window, last window, anchor) of every run of windows with one anchor.

    h: word hashes of all documents, at: where each begins.  Yields arrays, segment by segment.
    """
    width = window - GRAM + 1
    doc_of_end = at[1:]
    for a in range(0, max(0, len(h) - window + 1), SEGMENT):
        part = h[a : a + SEGMENT + window - 1]
        grams = chain(part, GRAM)
        key = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        n = 1
        while 2 * n <= width:
            key = np.minimum(key[:-n], key[n:])
            n *= 2
        if n < width:
            key = np.minimum(key[: len(key) - (width - n)], key[width - n :])
        first = np.arange(a, a + len(key))
        doc = np.searchsorted(doc_of_end, first, "right")
        whole = first + window <= doc_of_end[doc]
        first, doc, key = first[whole], doc[whole], key[whole]
        if not len(first):
            continue
        new = np.ones(len(first), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        starts = np.flatnonzero(new)
        last = first[np.append(starts[1:], len(first)) - 1]
        place = (key[starts] & _PLACE).astype(np.int64)
        yield doc[starts], first[starts], last, place + a


def _anchor_hash(h: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Hash of the GRAM words from each place; not the order by which anchors are chosen, since the
    least of many hashes are all small and would meet in a few partitions."""
    x = mix(h[places])
    for i in range(1, GRAM):
        x = mix(x * np.uint64(0x8CB92BA72F3D8DD7) + h[places + i])
    return x


def _part_of(anchors: np.ndarray, parts: int) -> np.ndarray:
    return (((anchors >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _repeated_anchors(docs: DataFrame, window: int, bits: int, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the anchors that occur more than once (2**bits bits) and more than HEAVY times, by their top bits.

    Each of ``slices`` (a power of two) partitions owns its slice of the bitmaps; the driver gets
    2**bits / 4 bytes in all at most, whatever the input.
    """
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            x, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            out = []
            for many, y in ((False, x[n == 1]), (True, x[n > 1])):
                at = np.searchsorted(_part_of(y, slices), np.arange(slices + 1))
                times = n[n > 1] if many else np.empty(0, np.int64)
                out += [(p, many, y[at[p] : at[p + 1]].tobytes() + times[at[p] : at[p + 1]].tobytes()) for p in np.flatnonzero(np.diff(at)).tolist()]
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.bool_(), pa.binary()))], ["part", "many", "payload"])

        for b in portions(batches):
            h, at = hash_words(b.column("text"))
            for _, _, _, place in _runs(h, at, window):
                waiting.append(_anchor_hash(h, place))
                rows += len(place)
                if rows >= FLUSH_ANCHORS:
                    yield flush()
                    rows = 0
        if waiting:
            yield flush()

    heavy_bits = min(bits, HEAVY_BITS)

    def meet(table: pa.Table) -> pa.Table:
        anchors, times = [], []
        for m, payload in zip(table["many"].to_pylist(), table["payload"].to_pylist()):
            x = np.frombuffer(payload, np.uint64)
            k = len(x) // 2 if m else len(x)
            anchors.append(x[:k])
            times.append(x[k:].astype(np.int64) if m else np.ones(k, np.int64))
        x, inverse = np.unique(np.concatenate(anchors), return_inverse=True)
        n = np.bincount(inverse, np.concatenate(times), len(x))
        part = int(table["part"][0].as_py())
        out = []
        for least, top in ((1, bits), (HEAVY, heavy_bits)):
            size = (1 << top) // slices
            marks = np.zeros(size, bool)
            marks[(x[n > least] >> np.uint64(64 - top)).astype(np.int64) - part * size] = True
            out.append(pa.array([np.packbits(marks).tobytes()], pa.binary()))
        return pa.table([pa.array([part], pa.int32()), *out], ["part", "repeated", "heavy"])

    found = docs.select("text").mapInArrow(send, "part int, many boolean, payload binary").groupBy("part").applyInArrow(meet, "part int, repeated binary, heavy binary")
    out = [np.zeros((1 << top) // 8, np.uint8) for top in (bits, heavy_bits)]
    for r in found.toLocalIterator():
        for bitmap, marks in zip(out, (r["repeated"], r["heavy"])):
            bitmap[r["part"] * len(marks) : (r["part"] + 1) * len(marks)] = np.frombuffer(marks, np.uint8)
    return out[0], out[1]


def _marked(bitmap: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    slot = anchors >> np.uint64(64 - (len(bitmap) * 8).bit_length() + 1)
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (7 - (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _pack(head: np.ndarray, words: np.ndarray) -> bytes:
    """Strips (rows of head: id, text hash, first, last, anchor place) and their words, 48 bits each."""
    return b"".join((np.int64(len(head)).tobytes(), head.tobytes(), (words >> np.uint64(32)).astype(np.uint32).tobytes(), (words >> np.uint64(16)).astype(np.uint16).tobytes()))


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of all stretches, one after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def _contents(words: np.ndarray, lengths: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A hash of each strip's words and of its anchor's place in it."""
    begin = np.cumsum(lengths) - lengths
    within = np.arange(len(words)) - np.repeat(begin, lengths)
    x = mix(words + mix(within.astype(np.uint64) + np.uint64(1)))
    return mix(np.add.reduceat(x, begin) + (places.astype(np.uint64) << np.uint64(32)) + lengths.astype(np.uint64))


def _unpack(payload: bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(payload, np.int64, 1)[0])
    head = np.frombuffer(payload, np.int64, 5 * n, 8).reshape(n, 5)
    words = int((head[:, 3] - head[:, 2] + window).sum())
    at = 8 + 40 * n
    high = np.frombuffer(payload, np.uint32, words, at).astype(np.uint64)
    return head, (high << np.uint64(16)) | np.frombuffer(payload, np.uint16, words, at + 4 * words)


def _deep_leaves(head: np.ndarray, words: np.ndarray, anchor: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(strip, first window) of all suffixes below a node as deep as the window with two or more leaves.

    The trees of all prefixes grow together, STEP words at a time; a branch with one leaf is cut.
    """
    n = head[:, 3] - head[:, 2] + 1
    begin = np.concatenate(([0], np.cumsum(n + window - 1)))[:-1]
    strip = np.repeat(np.arange(len(head)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = begin[strip] + within
    node = mix(anchor[strip] ^ (head[strip, 4] - head[strip, 2] - within).astype(np.uint64))
    depth = 0
    while True:
        _, inverse, leaves = np.unique(node, return_inverse=True, return_counts=True)
        inner = leaves[inverse] > 1
        strip, within, at, node = strip[inner], within[inner], at[inner], node[inner]
        if depth >= window or not len(node):
            return strip, within
        step = min(STEP, window - depth)
        node = mix(node ^ chain(words, step)[at + depth])
        depth += step


def _joined(rows: np.ndarray) -> np.ndarray:
    """Rows (id, text hash, first window, last window) of single windows, neighbours put together."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1) | (rows[1:, 2] > rows[:-1, 3] + 1)
    starts = np.flatnonzero(new)
    out = rows[starts]
    out[:, 3] = rows[np.append(starts[1:], len(rows)) - 1, 3]
    return out


STRIPS, READY, WINDOWS = range(3)


def _ranges(docs: DataFrame, bitmap: np.ndarray, heavy: np.ndarray, window: int, parts: int) -> DataFrame:
    """(id, th, first, last): runs of repeated windows."""
    shared = docs.sparkSession.sparkContext.broadcast((bitmap.tobytes(), heavy.tobytes()))
    schema = "part int, kind int, payload binary"

    def batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["part", "kind", "payload"])

    def known(rows: np.ndarray) -> list[tuple[int, int, bytes]]:
        """Repeated runs, dealt in blocks to any partition."""
        return [(int(rows[a, 1] % parts), READY, np.ascontiguousarray(rows[a : a + 4096]).tobytes()) for a in range(0, len(rows), 4096)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, many = (np.frombuffer(x, np.uint8) for x in shared.value)
        heads: list[np.ndarray] = []
        strips: list[np.ndarray] = []
        anchors: list[np.ndarray] = []
        singles: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            head, words, part = np.concatenate(heads), np.concatenate(strips), _part_of(np.concatenate(anchors), parts)
            heads.clear(), strips.clear(), anchors.clear()
            lengths = head[:, 3] - head[:, 2] + window
            begin = np.cumsum(lengths) - lengths
            _, once, which, n = np.unique(_contents(words, lengths, head[:, 4] - head[:, 2]), return_index=True, return_inverse=True, return_counts=True)
            out = known(head[n[which] > 1, :4])
            once = once[np.argsort(part[once], kind="stable")]
            at = np.searchsorted(part[once], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(at)).tolist():
                own = once[at[p] : at[p + 1]]
                out.append((p, STRIPS, _pack(head[own], words[_spread(begin[own], lengths[own])])))
            return batch(out)

        def flush_singles() -> pa.RecordBatch:
            """Windows of heavy anchors (id, text hash, place, hash): of equal ones, one goes on."""
            rows = np.concatenate(singles)
            singles.clear()
            _, once, which, n = np.unique(rows[:, 3], return_index=True, return_inverse=True, return_counts=True)
            again = rows[n[which] > 1]
            out = known(_joined(np.column_stack((again[:, :3], again[:, 2])))) if len(again) else []
            part = _part_of(rows[once, 3].view(np.uint64), parts)
            once = once[np.argsort(part, kind="stable")]
            at = np.searchsorted(np.sort(part), np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(at)).tolist():
                out.append((p, WINDOWS, np.ascontiguousarray(rows[once[at[p] : at[p + 1]]]).tobytes()))
            return batch(out)

        size = alone = 0
        for b in portions(batches):
            h, at = hash_words(b.column("text"))
            ids = b.column("id").to_numpy(zero_copy_only=False)
            ths = b.column("th").to_numpy(zero_copy_only=False)
            for doc, first, last, place in _runs(h, at, window):
                anchor = _anchor_hash(h, place)
                hit = np.flatnonzero(_marked(marks, anchor))
                single = _marked(many, anchor[hit])
                for k in range(0, len(hit), FLUSH_STRIPS):
                    own = hit[k : k + FLUSH_STRIPS][~single[k : k + FLUSH_STRIPS]]
                    d, f, e = doc[own], first[own], last[own]
                    heads.append(np.stack((ids[d], ths[d], f - at[d], e - at[d], place[own] - at[d]), 1).astype(np.int64))
                    strips.append(h[_spread(f, e - f + window)] & ~np.uint64(0xFFFF))
                    anchors.append(anchor[own])
                    size += len(strips[-1])
                    if size >= FLUSH_WORDS:
                        yield flush()
                        size = 0
                    own = hit[k : k + FLUSH_STRIPS][single[k : k + FLUSH_STRIPS]]
                    if len(own):
                        d, f, n = doc[own], first[own], last[own] - first[own] + 1
                        words = h[_spread(f, n + window - 1)]
                        begin = np.cumsum(n + window - 1) - (n + window - 1)
                        hashes = chain(words, window)[_spread(begin, n)]
                        d, where = np.repeat(d, n), _spread(f, n)
                        singles.append(np.stack((ids[d], ths[d], where - at[d], hashes.view(np.int64)), 1).astype(np.int64))
                        alone += len(where)
                        if alone >= FLUSH_WORDS // 4:
                            yield flush_singles()
                            alone = 0
        if size:
            yield flush()
        if alone:
            yield flush_singles()

    def meet(table: pa.Table) -> pa.Table:
        heads, words, singles, out = [], [], [], []
        for kind, payload in zip(table["kind"].to_pylist(), table["payload"].to_pylist()):
            if kind == READY:
                out.append(np.frombuffer(payload, np.int64).reshape(-1, 4))
            elif kind == WINDOWS:
                singles.append(np.frombuffer(payload, np.int64).reshape(-1, 4))
            else:
                head, w = _unpack(payload, window)
                heads.append(head)
                words.append(w)
        if singles:
            rows = np.concatenate(singles)
            _, which, n = np.unique(rows[:, 3], return_inverse=True, return_counts=True)
            rows = rows[n[which] > 1]
            if len(rows):
                out.append(_joined(np.column_stack((rows[:, :3], rows[:, 2]))))
        if heads:
            head, words = np.concatenate(heads), np.concatenate(words)
            begin = np.concatenate(([0], np.cumsum(head[:, 3] - head[:, 2] + window)))[:-1]
            anchor = _anchor_hash(words, begin + head[:, 4] - head[:, 2])
            strip, within = _deep_leaves(head, words, anchor, window)
            if len(strip):
                new = np.ones(len(strip), bool)
                new[1:] = (strip[1:] != strip[:-1]) | (within[1:] != within[:-1] + 1)
                starts = np.flatnonzero(new)
                ends = np.append(starts[1:], len(strip)) - 1
                h = head[strip[starts]]
                out.append(np.stack((h[:, 0], h[:, 1], h[:, 2] + within[starts], h[:, 2] + within[ends]), 1))
        rows = np.concatenate(out) if out else np.empty((0, 4), np.int64)
        return pa.table({k: rows[:, i] for i, k in enumerate(("id", "th", "first", "last"))})

    return docs.mapInArrow(send, schema).groupBy("part").applyInArrow(meet, "id long, th long, first long, last long")


def _cut(text: str | None, ranges: list, window: int) -> tuple[int, list[bytes]]:
    """Number of words, and the words that stay."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not ranges:
        return len(words), words
    gone = np.zeros(len(words) + 1, np.int64)
    r = np.array(ranges, np.int64).reshape(-1, 2)
    np.add.at(gone, r[:, 0], 1)
    np.add.at(gone, r[:, 1] + window, -1)
    return len(words), [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256, and with ``with_text`` also kept_text."""
    if window < GRAM + 1:
        raise ValueError(f"window must be above {GRAM}")
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("orig"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(16, min(MAX_BITS, int(chars).bit_length()))  # about a bit a character, 80 an anchor
    slices = 1
    while slices < shuffle_partitions(spark, chars // 80, FLUSH_ANCHORS) and slices < 1 << (min(bits, HEAVY_BITS) - 3):
        slices *= 2
    bitmap, heavy = _repeated_anchors(rows, window, bits, slices)
    parts = shuffle_partitions(spark, chars // 6, FLUSH_WORDS)
    ranges = keep(_ranges(rows.select("id", "th", "text"), bitmap, heavy, window, parts), "repeat-ranges")
    spans = keep(ranges.groupBy("id", "th").agg(F.collect_set(F.array("first", "last")).alias("ranges")), "repeat-spans")
    m = bloom.slots_for(spans.count())
    members = keep(bloom.member_words(spans, "th", m), "repeat-members")
    tested = bloom.flag(rows, "th", members, m, "__kl_maybe")
    none = F.lit(None).cast("array<array<bigint>>").alias("ranges")
    plain = tested.filter("not __kl_maybe").select("orig", "text", none)
    hit = tested.filter("__kl_maybe").join(spans, ["id", "th"], "left").select("orig", "text", "ranges")
    kind = rows.schema["orig"].dataType.simpleString()
    names = ["orig", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            out = []
            for text, r in zip(b.column("text"), b.column("ranges")):
                n, left = _cut(text.as_py(), r.as_py() or [], window)
                joined = b" ".join(left)
                out.append((n, n - len(left), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "replace") if with_text else ""))
            cols = list(zip(*out)) or [()] * 4
            arrays = [b.column("orig"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(cols[3], pa.string())] if with_text else []), names)

    schema = f"orig {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return plain.unionByName(hit).mapInArrow(run, schema).withColumnRenamed("orig", id_col)
