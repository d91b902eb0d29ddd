"""Words of text columns as 64-bit hashes, on the UTF-8 bytes with NumPy.

A word is a run of bytes other than space and 0x09-0x0D, as in ``bytes.split()``; or, where
``bare`` is asked for, a run of ASCII letters, digits and bytes from 0x80 on.  Every byte
has a random 64-bit value; a word's hash is the polynomial of its bytes' values modulo 2**64, from
prefix sums, then mixed.  Work is done on at most WINDOW bytes at a time (more only if one word
is longer), so the memory beside the hashes does not grow with a text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, byte values after lower-casing A-Z, and which bytes separate (bare) words."""
    values = np.random.default_rng(41).integers(0, 1 << 64, 256, dtype=np.uint64)
    lower = values.copy()
    lower[65:91] = values[97:123]
    separates = np.zeros(256, bool)
    separates[[32, *range(9, 14)]] = True
    bare = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
    return values, lower, separates, bare


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if not _powers or len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        _powers.clear()
        for b in (_BASE, inverse):
            steps = np.full(n + 1, b, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
    return _powers[0], _powers[1]


def _window(data: np.ndarray, cuts: np.ndarray, values: np.ndarray, separates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of data; at each position of cuts a new text begins."""
    apart = separates[data]
    begins = ~apart
    ends = begins.copy()
    begins[1:] &= apart[:-1]
    ends[:-1] &= apart[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    begins[inner] = ~apart[inner]
    ends[inner - 1] = ~apart[inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * power[: len(data)], out=sums[1:])
    h = (sums[last + 1] - sums[first]) * inverse[first]
    return mix(h + (last + 1 - first).astype(np.uint64) * _U(0xD6E8FEB86659FD93)), first


def hash_words(column: pa.Array, lower: bool = False, bare: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets: words of text i are hashes[offsets[i]:offsets[i + 1]]).

    Nulls count as empty texts.
    """
    n = len(column)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    plain, lowered, spaces, marks = _tables()
    values, separates = lowered if lower else plain, marks if bare else spaces
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + WINDOW)
        if end < len(data):  # cut where a text begins, or else at a separator
            k = int(np.searchsorted(offsets, end, "right")) - 1
            if offsets[k] > at:
                end = int(offsets[k])
            else:
                back = np.flatnonzero(separates[data[at:end]])
                while not len(back) and end < offsets[k + 1]:
                    step = min(int(offsets[k + 1]), end + WINDOW)
                    back = np.flatnonzero(separates[data[end:step]])[:1] + (end - at)
                    end = step
                end = at + int(back[-1]) + 1 if len(back) else end
        lo, hi = np.searchsorted(offsets, [at, end])
        h, first = _window(data[at:end], offsets[lo:hi] - at, values, separates)
        hashes.append(h)
        starts.append(first + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def chain(hashes: np.ndarray, words: int) -> np.ndarray:
    """Hash of the run of so many words from each word on; runs over the end are left out."""
    n = len(hashes) - words + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = mix(hashes[:n] + _U(words))
    for i in range(1, words):
        h = mix(h * _U(0xA24BAED4963EE407) + hashes[i : i + n])
    return h


def portions(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``most`` bytes of text, or one row; memory then follows the
    slice and not the batch."""
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < len(b):
            before = ends[at - 1] if at else 0
            n = max(1, int(np.searchsorted(ends, before + most, "right")) - at)
            yield b.slice(at, n)
            at += n
