"""Best-two-fit packing of tokenised documents into fixed-length sequences.

A document is its token ids and the end id; only one longer than a sequence is cut.  Pieces of one
length are interchangeable, so the packing is planned on the histogram of lengths, which
has at most ``size`` rows however many documents there are: a bin is filled greedily with the
longest pieces that fit, then its smallest piece is taken out again and replaced by the two
unpacked pieces that fill the larger gap best, if they fill it better.  The pattern found is used
as often as its pieces last, so the plan grows with the number of lengths only.  Pieces then find
their place by their rank among those of their length.

Defined cases: null or empty text is the end id alone (one piece of length 1); a text of exactly
the sequence's length is one piece; repeated rows are packed each for itself; empty tables give an
empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import functools
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinlink.llm.words import portions
from kinlink.plans.scratch import keep, ship

SIZE = 4096
END_ID = 1
#: Bytes of runs and ids that a worker remembers in a turn (two such tables at most), what an entry takes beside
#: them, and the longest run that is remembered.
CACHE = 32 << 20
ENTRY = 180
LONG = 256
#: Pieces ranked together, on average.
BLOCK_PIECES = 50_000

# The tokenizer's normaliser only lower-cases and joins white space in texts of these
# characters; other texts take the library's whole path.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xff‐-―‘-‟…€]*")
_PLAIN_CHARS = [c for c in map(chr, range(0x10000)) if _PLAIN.fullmatch(c)]


class _Known(dict):
    """Ids of a string as little-endian bytes, made by ``make``.  The strings used since the last
    turn and those of the turn before are remembered, CACHE bytes each; very long ones aren't."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older, self.bytes = make, {}, 0

    def __missing__(self, key: str) -> bytes:
        if len(key) > LONG:
            return self.make(key)
        if self.bytes >= CACHE:
            self.older.clear()  # before the copy, so that there are never three
            self.older, self.bytes = dict(self), 0
            self.clear()
        ids = self[key] = self.older.get(key) or self.make(key)
        self.bytes += len(key) * (1 if key.isascii() else 2) + len(ids) + ENTRY
        return ids


@functools.cache
def _loaded(path: str):
    """Ids of a text; those of a run without white space, if runs can be encoded one by one; special strings."""
    import json
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    plain = kinds == ["NFC", "Replace", "Lowercase"] and len(steps) == 2 and steps[0]["type"] == "Split" and steps[0]["invert"] and steps[1]["type"] == "ByteLevel" and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]
    special = [x["content"] for x in spec.get("added_tokens", [])]

    def encode(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    if not plain:
        return encode, None, special
    # The split pattern over the plain characters only, and the byte-level alphabet: bytes that aren't
    # printable in Latin-1 are moved behind U+0100, in turn.
    low = sorted({c for x in _PLAIN_CHARS for c in x.lower()})
    split = steps[0]["pattern"]["Regex"]
    for kind in "LN":
        split = split.replace(rf"\p{{{kind}}}", re.escape("".join(c for c in low if unicodedata.category(c)[0] == kind)))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in printable)}
    letters = [chr(moved.get(b, b)) for b in range(256)]

    words, tokens = re.compile(split).findall, tokenizer.model.tokenize

    def run_bytes(run: str) -> bytes:
        ids: list[int] = []
        for word in words(run):
            mapped = word if word.isascii() else "".join([letters[b] for b in word.encode()])
            ids += [t.id for t in tokens(mapped)]
        return struct.pack(f"<{len(ids)}I", *ids)

    return encode, _Known(run_bytes), special


def token_bytes(text: str, path: str) -> bytes:
    """The ids that the tokenizer gives, as little-endian bytes; by runs without white space where
    that is the same, since no token of this tokenizer's pattern spans white space."""
    encode, runs, special = _loaded(path)
    if runs is None or not _PLAIN.fullmatch(text) or any(s in text for s in special):
        return encode(text)
    return b"".join(map(runs.__getitem__, text.lower().split()))


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            out: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = memoryview(token_bytes(text.as_py() or "", tokenizer) + end)
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out)) or [()] * 5
            types = (b.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """(times, lengths in a bin) of every pattern, best two fit."""
    left = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out: list[tuple[int, list[int]]] = []
    marks = np.where(left > 0, np.arange(size + 1), 0)
    while marks.any():
        best = np.maximum.accumulate(marks)  # the longest unpacked piece of at most that length
        bin_, free, taken = [], size, {}

        def longest(most: int) -> int:
            x = int(best[most]) if most > 0 else 0
            while x and left[x] <= taken.get(x, 0):
                x = int(best[x - 1])
            return x

        while x := longest(free):
            bin_.append(x)
            taken[x] = taken.get(x, 0) + 1
            free -= x
        if free and len(bin_) > 1:
            small = bin_[-1]
            gap = free + small
            taken[small] -= 1
            pair, most, a = None, small, longest(gap - 1)
            while a and 2 * a > most:  # a is the longer of the two
                taken[a] = taken.get(a, 0) + 1
                b = longest(min(a, gap - a))
                taken[a] -= 1
                if b and a + b > most:
                    pair, most = (a, b), a + b
                    if most == gap:
                        break
                a = longest(a - 1)
            if pair:
                bin_ = [*bin_[:-1], *pair]
                for x in pair:
                    taken[x] = taken.get(x, 0) + 1
            else:
                taken[small] += 1
        taken = {x: n for x, n in taken.items() if n}
        times = int(min(left[x] // n for x, n in taken.items()))
        for x, n in taken.items():
            left[x] -= n * times
            if not left[x]:
                marks[x] = 0
        out.append((times, bin_))
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = keep(pieces(docs, tokenizer, id_col, text_col, size, end_id), "pack-pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `size` rows
    # (length, first rank) of every place in the plan; bin and offset follow from the rank.
    used: dict[int, int] = {}
    keys, firsts, bins, offsets, first_bin = [], [], [], [], 0
    for times, lengths in plan(histogram, size):
        at, groups = 0, {}
        for x in lengths:
            groups.setdefault(x, []).append(at)
            at += x
        for x, places in groups.items():
            for p in places:
                keys.append(x)
                firsts.append(used.get(x, 0))
                bins.append(first_bin)
                offsets.append(p)
                used[x] = used.get(x, 0) + times
        first_bin += times
    order = np.lexsort((np.array(firsts, np.int64), np.array(keys, np.int64)))
    table = spark.sparkContext.broadcast(tuple(np.array(c, np.int64)[order] for c in (keys, firsts, bins, offsets)))

    # A rank among the pieces of one length: pieces are dealt to blocks by hash, ranked inside, and
    # offset by the counts of the blocks before, so that no length, however common, is in one task.
    total = sum(histogram.values())
    blocks = max(1, -(-total // BLOCK_PIECES))
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "block").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(inside) - 1).join(counts, ["length", "block"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    kind = cut.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, bin_, offset = table.value
        joint = key * (1 << 48) + first
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            i = np.searchsorted(joint, length * (1 << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(bin_[i] + rank - first[i]), pa.array(offset[i])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    out = ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("doc_id", id_col)
