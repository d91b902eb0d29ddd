import math

import pytest
from pyspark.sql import functions as F

from kinlink.operators import context, decide, features, retrieval, tokens, validate
from kinlink.sources import tables


def claims(spark, rows):
    return spark.createDataFrame([(q, s, 2, float(p)) for q, s, p in rows], "qi long, si long, src int, p2 double")


def test_expected_f(spark):
    keep = lambda ps: {r["qi"] for r in decide.assign_expected_f(claims(spark, [(i, 1, p) for i, p in enumerate(ps)]), "p2").collect()}
    assert keep([0.9, 0.6]) == {0} and keep([0.4]) == set() and keep([0.48]) == {0} and keep([0.47]) == set()
    assert keep([1.0, 0.04]) == {0} and keep([1.0, 1.0]) == {0, 1}
    b = decide.expected_f(claims(spark, [(0, 1, 0.9), (1, 1, 0.6)]), "p2").orderBy("k").collect()
    assert [round(r["ef"], 5) for r in b] == [0.81818, 0.78947] and round(b[0]["p0"], 6) == 0.04


def test_threshold_is_strict_and_ties_go_to_the_smaller_entity(spark):
    got = decide.assign(claims(spark, [(1, 5, 0.7), (2, 9, 0.8), (2, 4, 0.8)]), "p2", 0.7).collect()
    assert [(r["si"], r["qi"]) for r in got] == [(4, 2)]


def test_metric(spark):
    pairs = lambda x: spark.createDataFrame(x, "si long, qi long")
    f = lambda p, t: decide.entity_f05(pairs(p), pairs(t), spark.createDataFrame([(1,)], "si long")).first()["f"]
    assert f([], []) == 1 and f([(1, 1)], []) == 0 and f([], [(1, 1)]) == 0
    assert f([(1, 1), (1, 2)], [(1, 1), (1, 3), (1, 4)]) == pytest.approx(0.45455, abs=1e-5)


def test_bands(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.05, 0.0500001, 0.5, 1.0)], "x double")
    left = [r[0] for r in df.select(decide.band(F.col("x"), decide.BANDS)).collect()]
    right = [r[0] for r in df.select(decide.band(F.col("x"), decide.GATE_BANDS, right=True)).collect()]
    assert left == [0, 0, 1, 4, 18] and right == [0, 0, 0, 1, 12]


def test_empty_top_band_is_no_error(spark):
    best = claims(spark, [(1, 1, 0.5)]).withColumn("y", F.lit(1))
    t = decide.band_table(best, best, "p2", 1).collect()
    assert [(r["b"], r["pos_te"], r["prec_te"]) for r in t] == [(4, 0.0, 0.0)]


def test_digits(spark):
    df = spark.createDataFrame([("7344", "7342"), ("509", "409"), ("99", "100"), ("", "12")], "q_pnum string, s_pnum string")
    got = features.digit_geometry(df).collect()
    names = ["pn_absdiff", "pn_hamming", "pn_lowdiff", "pn_highdiff", "pn_highdiff_rel", "pn_lastdig_eq", "pn_firstdig_eq"]
    assert [[r[n] for n in names] for r in got] == [[2, 1, 0, 0, 3, 0, 1], [100, 1, 2, 2, 0, 1, 0], [1, 3, 0, 2, 0, 0, 0], [-1, -1, -2, -2, -1, -1, -1]]
    df = spark.createDataFrame([("10", "4", "10", "4 13")], "q_pnum string, s_pnum string, q_nums string, s_nums string")
    assert features.number_membership(df).first()["nums_minabs"] == 3


def test_entity_context(spark):
    got = {r["qi"]: r for r in context.context(claims(spark, [(1, 1, 0.9), (2, 1, 0.4), (3, 7, 0.3)])).collect()}
    assert (got[1]["s_p2sum_o"], got[1]["s_p2max_o"]) == (pytest.approx(0.4), 0.4)
    assert (got[2]["s_p2sum_o"], got[2]["s_p2max_o"]) == (pytest.approx(0.9), 0.9)
    assert got[3]["s_p2max_o"] == 0 and got[3]["q_marg"] == 0


def records(spark, rows):
    return tokens.add_tokens(spark.createDataFrame(rows, "id long, country string, core string, skel string, alt string, ad string, nums string, pnum string"))


def test_tokens(spark):
    r = records(spark, [(1, "US", "", "", "", "", "", ""), (2, "US", "red ox", "rt ks", "abc", "main cross road", "12", "12"), (3, "US", None, None, None, "one", None, None)]).orderBy("id").collect()
    assert r[0]["ntok"] == [] and r[0]["atok"] == [] and r[0]["key_core"] is None
    assert {"b:main_cross", "b:cross_road", "x:12_main", "d:12", "a:road"} <= set(r[1]["atok"]) and {"w:red", "w:ox", "k:rt", "w:abc"} <= set(r[1]["ntok"])
    assert r[1]["key_core_pn"] == "red ox|12" and r[2]["atok"] == ["a:one"]


@pytest.mark.parametrize("held,numbered,want", [(50, True, 50), (51, True, 0), (10, False, 10), (11, False, 0)])
def test_key_caps(spark, held, numbered, want):
    pnum = "7" if numbered else ""
    index = records(spark, [(i, "US", "same", "same", "", "", pnum, pnum) for i in range(held)])
    q = records(spark, [(1000, "US", "same", "same", "", "", pnum, pnum), (1001, "FR", "same", "same", "", "", pnum, pnum), (1002, None, "same", "same", "", "", pnum, pnum)])
    got = retrieval.key_candidates(index, q, {"core_pn": 50} if numbered else {"core": 10}).collect()
    assert len(got) == want and {r["qi"] for r in got} <= {1000}


def test_cosine_does_not_depend_on_partitions(spark):
    rows = [(i, "US", f"w{i % 7} v{i % 11}", f"w{i % 7}", "", f"road{i % 5} hill{i % 3}", "", "") for i in range(60)]
    r = records(spark, rows)
    index, q = r.filter("id % 2 = 0"), r.filter("id % 2 = 1")
    runs = [sorted(tuple(x) for x in retrieval.candidates(index.repartition(n), q.repartition(n), df_floor=50).collect()) for n in (1, 7)]
    assert runs[0] == runs[1] and all(x[2] <= 1 + 1e-6 for x in runs[0])


def test_blend_and_truth(spark):
    a = spark.createDataFrame([(1, 1, 0.8), (2, 1, 0.8)], "qi long, si long, p5 double")
    b = spark.createDataFrame([(1, 1, 0.6)], "qi long, si long, p4 double")
    assert {r["qi"]: round(r["pb"], 9) for r in decide.blend(a, b, "p5", "p4").collect()} == {1: 0.7, 2: 0.8}
    t = spark.createDataFrame([("S1-1", "S2-9,S3-1"), ("S1-2", ""), ("S1-3", None)], "source1_entity_id string, matched_entity_ids string")
    assert sorted(tuple(r) for r in decide.truth_pairs(t).collect()) == [("S1-1", "S2-9"), ("S1-1", "S3-1")]


def test_twin_gate(spark):
    best = spark.createDataFrame([(1, 1, 0.9, "10", "12"), (2, 2, 0.95, "10", "12"), (3, 3, 0.9, "10", "20")], "qi long, si long, p2 double, q_pnum string, s_pnum string")
    assert sorted(r["qi"] for r in decide.gated_matches(best, "p2", 0.9).collect()) == [2, 3]


def test_files(spark, tmp_path):
    rows = [("S1-2", 'a "b" \\'), ("S1-1", None), ("S1-3", "")]
    tables.write_tsv(spark.createDataFrame(rows, "source1_entity_id string, matched_entity_ids string"), f"{tmp_path}/t", one_file=True)
    text = "".join(p.read_text() for p in (tmp_path / "t").glob("part-*"))
    assert text == 'source1_entity_id\tmatched_entity_ids\nS1-2\ta "b" \\\nS1-1\t\nS1-3\t\n'
    assert [tuple(r) for r in tables.read_tsv(spark, f"{tmp_path}/t").collect()] == [("S1-2", 'a "b" \\'), ("S1-1", None), ("S1-3", None)]
    assert {r[0] for r in tables.read_ids(spark, f"{tmp_path}/t").collect()} == {"S1-1", "S1-2", "S1-3"}
    tables.write_json({"a": 1}, spark, f"{tmp_path}/j")
    assert tables.read_json(spark, f"{tmp_path}/j") == {"a": 1}
    made = []
    for _ in range(2):
        assert tables.resume(spark, f"{tmp_path}/r", lambda: made.append(1) or spark.range(3)).count() == 3
    assert made == [1]
    pos = tables.with_position(spark.range(100).repartition(3)).collect()
    assert sorted(r["pos"] for r in pos) == list(range(100))


def test_validator(spark, tmp_path):
    rows = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-1", ""), ("S1-2", "S1-9,X9-1,S3-7"), ("S1-9", "S2-5")], "source1_entity_id string, matched_entity_ids string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "entity_id string")
    found = validate.findings(rows, "matched_entity_ids", ids("S1-1", "S1-2", "S1-3"), ids("S2-1", "S2-5"))
    want = {("duplicate_row", "S1-1"), ("repeated_id", "S1-1"), ("self_match", "S1-9"), ("wrong_prefix", "X9-1"), ("unknown_id", "S3-7"), ("missing", "S1-3"), ("extra", "S1-9")}
    assert {tuple(r) for r in found.collect()} == want
    assert "unknown_id" not in {r["rule"] for r in validate.findings(rows, "matched_entity_ids", ids("S1-1")).collect()}
    cand = spark.createDataFrame([("S1-1", "S2-1"), ("S1-9", "")], "source1_entity_id string, candidate_entity_ids string")
    assert {r[0] for r in validate.outside_candidates(rows, cand).collect()} == {"S1-2", "S1-9"}
    (tmp_path / "c.tsv").write_text("source1_entity_id,matched_entity_ids\n")
    (tmp_path / "h.tsv").write_text("id\tx\nno tab\n\n")
    (tmp_path / "e.tsv").write_text("")
    head = ["source1_entity_id", "matched_entity_ids"]
    assert [validate.header_problem(spark, f"{tmp_path}/{n}.tsv", head) for n in "chex"] == ["comma_separated", "header", "empty", "missing"]
    assert validate.rows_without_tab(spark.read.text(f"{tmp_path}/h.tsv")).count() == 1


def test_simulation_bounds(spark):
    best = claims(spark, [(i, i % 5, 0.5) for i in range(50)]).withColumn("pc", F.lit(1.0))
    u = spark.createDataFrame([(i,) for i in range(5)], "si long")
    assert decide.simulate_f05(best, u, F.lit(True), 0.0) == 1.0
    assert 0 < decide.simulate_f05(best, u, F.lit(True), 3.0) < 1
    assert math.isclose(decide.simulate_f05(best.withColumn("pc", F.lit(0.0)), u, F.lit(False), 0.0), 1.0)
