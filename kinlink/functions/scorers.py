"""String similarity scores of pairs of columns, 0 to 100, as Arrow-batched functions.

``ratio`` is 200 * LCS / (sum of lengths); the token variants sort or partition the words first, the
partial ones take the best window of the longer string.  A task remembers the pairs it has scored, up to
a bound.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Scored pairs that a task remembers from batch to batch.
KNOWN = 100_000


@functools.lru_cache(maxsize=4096)
def _masks(a: str) -> dict[str, int]:
    """The places of each letter as bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if not a or not b:
        return 0
    masks = _masks(a)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & masks.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * lcs(a, b) / n


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a stretch of the longer one of at most its length; of
    equally long ones, either may be the shorter."""
    if len(a) == len(b):
        return max(_best_stretch(a, b), _best_stretch(b, a))
    return _best_stretch(*sorted((a, b), key=len))


def _best_stretch(a: str, b: str) -> float:
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    best, n = 0.0, len(a)
    letters = [c in _masks(a) for c in b]
    for i in range(1 - n, len(b)):
        window = b[max(0, i) : i + n]
        most = sum(letters[max(0, i) : i + n])  # no common subsequence is longer
        if 200.0 * most > best * (n + len(window)):
            best = max(best, ratio(a, window))
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _parts(a: str, b: str) -> tuple[list[str], list[str], list[str]]:
    x, y = set(a.split()), set(b.split())
    return sorted(x & y), sorted(x - y), sorted(y - x)


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among shared words, shared and own words of a, and of b; 0 if a side is empty."""
    if not a.split() or not b.split():
        return 0.0
    both, x, y = _parts(a, b)
    if both and (not x or not y):
        return 100.0
    s, p, q = " ".join(both), " ".join([*both, *x]), " ".join([*both, *y])
    best = ratio(p, q)
    return max(best, ratio(s, p), ratio(s, q)) if both else best


def partial_token_set_ratio(a: str, b: str) -> float:
    if not a.split() or not b.split():
        return 0.0
    both, x, y = _parts(a, b)
    return 100.0 if both else partial_ratio(" ".join(x), " ".join(y))


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """0 to 1; the prefix bonus counts from a Jaro similarity above 0.7."""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [c for c, u in zip(b, used) if u]
    half = sum(x != y for x, y in zip(mine, theirs)) // 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * weight * (1 - jaro) if jaro > 0.7 else jaro


SCORERS: dict[str, Callable[[str, str], float]] = {f.__name__: f for f in (ratio, partial_ratio, token_sort_ratio, token_set_ratio, partial_token_set_ratio, jaro_winkler)}


class _Known:
    """Scores of distinct pairs, remembered up to KNOWN of them."""

    def __init__(self, scorer: Callable[[str, str], float]):
        self.scorer, self.known = scorer, {}

    def __call__(self, x: pd.Series, y: pd.Series) -> pd.Series:
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        pairs = list(zip(x, y))
        for p in set(pairs) - known.keys():
            known[p] = self.scorer(*p)
        return pd.Series([known[p] for p in pairs], dtype="float64")


def score(name: str, a: Column, b: Column) -> Column:
    """The scorer over two string columns; nulls count as empty."""
    known = _Known(SCORERS[name])  # each worker gets its own

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return known(x, y)

    return F.pandas_udf(run, "double")(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def scores(wanted: dict[str, tuple[str, str, str]], columns: dict[str, Column]) -> Column:
    """A struct of several scores in one function: {score: (scorer, column, column)} over named string columns."""
    names = list(columns)
    known = {k: _Known(SCORERS[f]) for k, (f, _, _) in wanted.items()}

    def run(*series: pd.Series) -> pd.DataFrame:
        by_name = dict(zip(names, series))
        return pd.DataFrame({k: known[k](by_name[a], by_name[b]) for k, (_, a, b) in wanted.items()})

    run.__annotations__ = {"series": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, ", ".join(f"{k} double" for k in wanted))(*[F.coalesce(c, F.lit("")) for c in columns.values()])
