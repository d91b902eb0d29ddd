import hashlib
from collections import defaultdict

from kinlink.llm import bloom, exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, word long, kept int"


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 0) for i, t in rows], SCHEMA)


ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (6, "x" * 200_000), (7, "x" * 200_000), (8, "a "), (9, "A"), (9, "A"), (None, "a"), (None, "lone"), (10, "é"), (11, "é")]


def test_decisions_match_brute_force(spark):
    got = exact_dedup.decide(frame(spark, ROWS)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(ROWS)


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MIN_SLOTS", 64)
    rows = [(i, f"t{i % 150}") for i in range(300)]
    got = exact_dedup.decide(frame(spark, rows), slots_per_row=0, max_slots=64).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_hot_group_goes_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_LEAST", 10)
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 20)
    rows = [(i, "same") for i in range(200)] + [(1000 + i, f"t{i % 30}") for i in range(60)]
    got = exact_dedup.decide(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_keep_one_keeps_columns_and_one_row_each(spark):
    got = exact_dedup.keep_one(frame(spark, ROWS))
    assert got.columns == ["doc_id", "text", "keep_id", "word", "kept"]
    texts = [r["text"] or "" for r in got.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in ROWS})
    assert {r["doc_id"] for r in got.collect() if r["text"] == "a"} == {2}


def test_empty_table(spark):
    assert exact_dedup.decide(frame(spark, [])).count() == 0
    assert exact_dedup.keep_one(frame(spark, [])).count() == 0


def test_drop_ids(spark):
    docs = frame(spark, [(i, str(i)) for i in range(100)])
    losers = spark.createDataFrame([(3,), (50,), (50,)], "doc_id long")
    assert sorted(r["doc_id"] for r in bloom.drop_ids(docs, losers, "doc_id").collect()) == [i for i in range(100) if i not in (3, 50)]


def test_main_path_is_native(spark):
    plan = exact_dedup.decide(frame(spark, ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_ranges_of_hashes_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MIN_SLOTS", 64)
    monkeypatch.setattr(bloom, "BROADCAST_ROWS", 3)
    rows = [(i, f"text {i % 37 if i % 3 else i}") for i in range(150)] + [(7, None), (8, ""), (9, "again"), (9, "again"), (None, "again"), (None, "none"), (None, "none")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, keep_id string")
    whole = sorted(map(str, exact_dedup.decide(df).collect()))
    assert whole == sorted(map(str, exact_dedup.decide(df, slots_per_row=4, max_slots=256).collect()))
    one = sorted(map(str, exact_dedup.keep_one(df).collect()))
    assert one == sorted(map(str, exact_dedup.keep_one(df, slots_per_row=4, max_slots=256).collect()))
    best = {}
    for i, t in rows:
        t = t or ""
        best[t] = max(best.get(t, -1), -1 if i is None else i)
    assert len(one) == len(best)
