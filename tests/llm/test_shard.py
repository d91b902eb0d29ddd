from collections import Counter

import pytest

from kinlink.llm import registry, shard


def brute(shards, size):
    """Each shard's whole preference list, claimed turn by turn."""
    prefer = []
    for s in shards:
        start, step = shard._hash(s, "offset") % size, shard._hash(s, "skip") % (size - 1) + 1
        prefer.append([(start + step * j) % size for j in range(size)])
    owner = {}
    while len(owner) < size:
        for i, p in enumerate(prefer):
            free = next((x for x in p if x not in owner), None)
            if free is not None:
                owner[free] = i
    return [owner[x] for x in range(size)]


@pytest.mark.parametrize("n,size", [(1, 7), (3, 13), (7, 7), (5, 211)])
def test_table_matches_brute_force(n, size):
    shards = [f"s{i}" for i in range(n)]
    assert shard.lookup_table(shards, size) == brute(shards, size)


def test_even_and_stable():
    full = shard.lookup_table(registry.SHARDS, 65537)
    counts = Counter(full)
    assert max(counts.values()) - min(counts.values()) <= 1
    less = shard.lookup_table(registry.SHARDS[:-1], 65537)
    moved = sum(a != b for a, b in zip(full, less) if a != 63)
    assert moved / 65537 < 0.1


@pytest.mark.parametrize("shards,size", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_bad_parameters(shards, size):
    with pytest.raises(ValueError):
        shard.lookup_table(shards, size)


def test_placement(spark):
    df = spark.createDataFrame([(1, "x", "a"), (1, "y", "b"), (None, None, None), (2, "", "c")], "doc_id long, slot string, shard string")
    got = shard.place(df, "doc_id", ["a", "b", "c"], 13).collect()
    assert len(got) == 4 and all(r["shard"] in "abc" and 0 <= r["slot"] < 13 for r in got)
    assert len({r["slot"] for r in got if r["doc_id"] == 1}) == 1
    assert shard.place(df.limit(0), "doc_id", ["a"], 13).count() == 0
    assert "Python" not in shard.place(df, "doc_id", ["a", "b"], 13)._jdf.queryExecution().toString()
