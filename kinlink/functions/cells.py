"""Exact cosines of a block of query records with a block of index records, cut to the best of every query."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHANNELS = ("cos_n", "cos_a")
#: Pairs gathered before they become columns.
FLUSH = 1 << 16


def _flat(tok: pa.ChunkedArray, w: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row of each token, tokens, weights)."""
    tok, w = (pa.concat_arrays(x.chunks) if x.num_chunks else pa.array([], x.type) for x in (tok, w))
    rows = np.repeat(np.arange(len(tok)), np.diff(tok.offsets.to_numpy()))
    return rows, tok.flatten(), w.flatten().to_numpy(zero_copy_only=False)


def _top(score: np.ndarray, k: int, least: float) -> np.ndarray:
    """Positions of the k highest scores above ``least``; of equal ones the first."""
    at = np.flatnonzero(score > least)
    if len(at) > k:
        x = score[at]
        edge = np.partition(x, len(x) - k)[len(x) - k]
        over = at[x > edge]
        at = np.concatenate((over, at[x == edge][: k - len(over)]))
    return at


def best_of_cell(ks: dict[str, int], kinds: list[str], least: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of (queries, index), tables of id, tok and w lists; tokens start with their channel, or ``key:kind:``.

    It returns the pairs among the k best of a query by ``rk_n``, ``rk_a`` or ``rk_c``, and those with a key in common.
    """

    def run(q: pa.Table, s: pa.Table) -> pa.Table:
        names = ["q", "s", *CHANNELS, *[f"kf_{k}" for k in kinds]]
        types = [q["id"].type, s["id"].type, pa.float64(), pa.float64(), *[pa.int32()] * len(kinds)]
        empty = pa.table([pa.array([], t) for t in types], names)
        if not len(q) or not len(s):
            return empty
        s = s.sort_by("id")  # so that the first of equal scores is the least id
        m = len(s)
        s_row, s_tok, s_w = _flat(s["tok"], s["w"])
        coded = s_tok.dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        s_row, s_w = s_row[order], s_w[order]
        start = np.searchsorted(code[order], np.arange(len(words) + 1))
        label = {c: i for i, c in enumerate([*CHANNELS, *[f"key:{k}" for k in kinds]])}
        of = np.array([label[_channel(w)] for w in words.to_pylist()], np.int64)
        q_row, q_tok, q_w = _flat(q["tok"], q["w"])
        found = pc.index_in(q_tok, words).fill_null(-1).to_numpy()
        met = found >= 0
        q_row, q_w, found = q_row[met], q_w[met], found[met]
        at = np.searchsorted(q_row, np.arange(len(q) + 1))
        done, waiting = [], []

        def flush() -> None:
            if waiting:
                done.append([np.concatenate(x) for x in zip(*waiting)])
                waiting.clear()

        rows = 0
        for i in range(len(q)):
            own, weight = found[at[i] : at[i + 1]], q_w[at[i] : at[i + 1]]
            if not len(own):
                continue
            cos = []
            channel = of[own]
            for c in range(2):
                mine = np.flatnonzero(channel == c)
                if len(mine):
                    cuts = [slice(start[t], start[t + 1]) for t in own[mine]]
                    products = np.concatenate([s_w[x] * w for x, w in zip(cuts, weight[mine])])
                    cos.append(np.round(np.bincount(np.concatenate([s_row[x] for x in cuts]), products, m), 9))
                else:
                    cos.append(np.zeros(m))
            near = np.flatnonzero((cos[0] > least) | (cos[1] > least))
            n, a = cos[0][near], cos[1][near]
            score = {"rk_n": n, "rk_a": a, "rk_c": (n + a) / 2}
            take = [near[_top(score[r], k, least)] for r, k in ks.items()]
            keyed = np.flatnonzero(channel >= 2)
            held = [(channel[j] - 2, s_row[start[own[j]] : start[own[j] + 1]]) for j in keyed]
            chosen = np.unique(np.concatenate([*take, *[x for _, x in held]]))
            if not len(chosen):
                continue
            flags = np.zeros((len(kinds), len(chosen)), np.int32)
            for k, x in held:
                flags[k, np.searchsorted(chosen, x)] = 1
            waiting.append([np.full(len(chosen), i), chosen, cos[0][chosen], cos[1][chosen], *flags])
            rows += len(chosen)
            if rows >= FLUSH:
                flush()
                rows = 0
        flush()
        if not done:
            return empty
        i, j, *rest = (np.concatenate(x) for x in zip(*done))
        return pa.table([q["id"].take(pa.array(i)), s["id"].take(pa.array(j)), *[pa.array(x, t) for x, t in zip(rest, types[2:])]], names)

    return run


def _channel(token: str) -> str:
    """``cos_n`` of ``cos_n:w:ring``, ``key:core`` of ``key:core:large ring``."""
    parts = token.split(":", 2)
    return ":".join(parts[:2]) if parts[0] == "key" else parts[0]
