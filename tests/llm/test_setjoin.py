import random

import numpy as np
import pytest

from kinlink.llm import setjoin as J
from kinlink.llm.components import components


def shingles(text, k):
    w = "".join(c.lower() if c.isascii() else c for c in (text or "")).encode().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=160, words=(1, 90)):
    """Texts with copies, near copies at all distances, chains, and a shared passage."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.55:
            w = rng.choice(texts[-30:]).split() if kind < 0.4 else texts[0].split()
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 5))):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randrange(*words))]
            if kind > 0.85:
                w += passage
        texts.append(" ".join(w))
    ids = rng.sample(range(10 * n), n)
    return list(zip(ids, texts)) + [(10 * n + 1, None), (10 * n + 2, ""), (10 * n + 3, "one two"), (10 * n + 4, "ONE  two"), (10 * n + 5, "\t\n ")]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, component_id string, n long").repartition(5)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.link(df, **kw).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_join_matches_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows, words=3, num=90, den=100) == brute(rows, 3, 90, 100)


def test_five_words_match_brute_force(spark):
    rows = corpus(3)
    assert run(spark, rows, words=5, num=80, den=100) == brute(rows, 5, 80, 100)


def test_rounds_and_folding_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(J, "FAMILY_DOCS", 2)
    rows = corpus(4, n=120)
    assert run(spark, rows, words=3, num=90, den=100) == brute(rows, 3, 90, 100)


def _sets(rng, n, size=60):
    """Sets of which many are partners at 0.8."""
    out = []
    for _ in range(n):
        s = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
        if out and rng.random() < 0.6:
            old = out[int(rng.integers(0, len(out)))]
            s = np.concatenate((old[int(rng.integers(0, 9)) :], s[: int(rng.integers(0, 6))]))
        out.append(np.unique(s))
    return out


def test_bound_on_the_intersection_rules_out_no_partners():
    rng = np.random.default_rng(6)
    sets = _sets(rng, 60)
    for a in sets:
        for b in sets:
            both = len(np.intersect1d(a, b))
            if a is not b and 100 * both >= 80 * (len(a) + len(b) - both):
                assert len(J._alike(np.array([J.profile(a), J.profile(b)]), 80, 100)) == 1
    far = [np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2)) for _ in range(8)]
    assert J._alike(np.array([J.profile(x) for x in far]), 80, 100) == []
    wild = np.array([J.profile(x) for x in far])
    wild[3] = 0  # a document that stands for a folded signature meets all
    assert [len(g) for g in J._alike(wild, 80, 100)] == [8]
    assert J.profile(np.arange(1 << 16, dtype=np.uint64)).sum() == 0


def test_payload_round_trip():
    rng = np.random.default_rng(7)
    for span in (1 << 60, 1 << 20):
        ids, low, folded = rng.integers(-span, span, 40), rng.integers(0, 1 << 32, 40).astype(np.uint64), rng.random(40) < 0.3
        data = J._Payload.pack(low, ids, folded)
        assert sorted(zip(*(x.tolist() for x in J._Payload.unpack(data)))) == sorted(zip(low.tolist(), ids.tolist(), folded.tolist()))
        assert len(data) == 32 + 40 * (8 if span < 1 << 31 else 12)


def test_hot_signatures_are_folded_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(J, "FOLD", 2)
    monkeypatch.setattr(J, "CHUNK", 3)
    rows = corpus(9, n=120)
    assert run(spark, rows, words=3, num=90, den=100) == brute(rows, 3, 90, 100)


def test_a_set_with_few_features_in_its_partitions_meets_its_partners():
    """Sets whose hashes lie close together leave most partitions empty: they send their empty ways too."""
    rng = np.random.default_rng(8)
    for size in (60, 200, 500):
        for _ in range(5):
            a = np.unique(rng.integers(0, 1 << 58, size, dtype=np.uint64))
            b = np.unique(np.concatenate((a[size // 12 :], rng.integers(0, 1 << 58, size // 20, dtype=np.uint64))))
            made = []
            for s in (a, b):
                k = J.band(len(s), 80, 100)
                made.append({x for j in ((k, k - 1) if k else (k,)) for x in J.signatures(s, j, 80, 100).tolist()})
            assert made[0] & made[1]


def test_equal_sets_are_folded_and_unfolded(spark, monkeypatch):
    monkeypatch.setattr(J, "HOT_LEAST", 3)
    rows = [(i, "one two three four five") for i in range(50, 70)] + [(i, "six seven eight nine") for i in (3, 1)] + [(9, "one two three four five"), (9, "other words are here"), (4, "other words are here")]
    assert run(spark, rows, words=2)[60] == (4, 4) and run(spark, rows, words=2)[3] == (3, 1)


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100), (1, 2)])
def test_partners_share_a_signature(num, den):
    rng = np.random.default_rng(num)
    for size in [*range(1, 40), 77, 150, 400]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            drop = int(rng.integers(0, size // 4 + 1))
            b = np.unique(np.concatenate((a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, size // 4 + 1)), dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if both and den * both >= num * (len(a) + len(b) - both):
                made = []
                for s in (a, b):
                    k = J.band(len(s), num, den)
                    made.append({x for j in ((k, k - 1) if k else (k,)) for x in J.signatures(s, j, num, den).tolist()})
                assert made[0] & made[1], (size, len(a), len(b))


def test_bands_hold_all_partners():
    for num, den in ((90, 100), (80, 100)):
        for x in range(1, 3000):
            i = J.band(x, num, den)
            low, high = J.bounds(i, num, den)
            assert low <= x <= high and J.band(x * den // num, num, den) <= i + 1


def test_repeated_null_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (5, "a b c d")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in J.link(df, words=3).collect()), key=str)
    assert got == [(1, 1), (1, 1), (5, 1), (None, None)]
    assert J.link(df.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in J.keep_one(df.filter("doc_id is not null"), words=3).collect()) == [1, 1]


def test_components_of_a_chain_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200), (301, 300), (301, 302)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[100 + i] == 100 for i in range(50))
    assert got[302] == 300 and 200 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_members_of_buckets_are_not_gathered_on_the_driver(spark, monkeypatch):
    """Far below the broadcast bound, as compressed lists of ids are; still they meet their profiles and texts by an exchange."""
    profile = J.profile(np.arange(9, dtype=np.uint64)).tobytes()
    buckets = spark.createDataFrame([([1, 2, 3], False), ([4, 5], True)], "ids array<long>, closed boolean")
    profiles = spark.createDataFrame([(i, profile) for i in (1, 2, 3)], "id long, profile binary")
    stars = J._possible(J.keep(buckets, "b"), J.keep(profiles, "p"), 80, 100)
    assert "Broadcast" not in stars._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in stars.collect()} == {(1, 2), (1, 3), (4, 5)}
    monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
    texts = J._texts_of(J.keep(spark.createDataFrame([(1, "a"), (9, "b")], "id long, text string"), "d"), J.keep(spark.createDataFrame([(1, 7)], "id long, family long"), "w"))
    assert "SortMergeJoin" in texts._jdf.queryExecution().executedPlan().toString() and [tuple(r) for r in texts.collect()] == [(1, "a", 7)]
