import random

from pyspark.sql import functions as F

from kinlink.operators import decide, models
from kinlink.plans import linkage
from kinlink.streaming.linkage import candidates_of_stream

ONE = {"maxIter": 3, "maxDepth": 3, "stepSize": 0.3}
SMALL = {1: ONE, 2: [ONE, ONE | {"featureSubsetStrategy": "0.6"}], 3: ONE, 4: ONE}
SCHEMA = "id long, entity_id string, country string, business_name string, business_address string"


def planted(seed=1, n=150):
    """Index records, query records and the true pairs: misspelt names, changed forms and addresses."""
    rng = random.Random(seed)
    first = [a + b for a in ("nor", "har", "pin", "sil", "gold", "ever", "blu", "cas", "mon", "ver") for b in ("wick", "ton", "dale", "stone", "field", "mere", "ford", "land")]
    second = "analytics bakery logistics foundry textiles software dairy press marine optics farms studio".split()
    index, queries, truth = [], [], []
    for i in range(n):
        name, street, number = f"{rng.choice(first)} {rng.choice(second)}", f"{rng.choice(first)} road", rng.randrange(1, 900)
        index.append((i, f"S1-{i}", "US", f"{name} LLC", f"{number} {street}, Salem, KS"))
        for k in range(rng.randrange(3)):
            q = 10_000 + 10 * i + k
            w = list(name)
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice("aeiou")
            queries.append((q, f"S{2 + k}-{q}", "US", "".join(w) + rng.choice((" Inc", ", L.L.C.", "")), rng.choice((f"{number} {street.replace('road', 'rd')}, Salem, Kansas", f"{number} {street}", ""))))
            truth.append((i, q))
    for j in range(40):
        queries.append((90_000 + j, f"S2-{90_000 + j}", "US", f"{rng.choice(first)}x {rng.choice(second)}", f"{rng.randrange(900, 999)} elsewhere lane"))
    return index, queries, truth


def test_fit_and_apply_find_planted_matches(spark):
    index, queries, truth = planted(n=60)
    i, q = (linkage.normalise(spark.createDataFrame(x, SCHEMA)).cache() for x in (index, queries))
    t = spark.createDataFrame(truth, "si long, qi long")
    fitted = linkage.fit(i, q, t, SMALL, df_floor=100)
    universe = i.select(F.col("id").alias("si"))
    assert fitted["config"]["oof_f05"] > 0.85
    assert {c["score"] for c in fitted["configs"]} == {"p3", "p4"} and len(fitted["models"]) == 4 and len(fitted["models"][1][0]) == 2
    new = linkage.apply(fitted, i, q, df_floor=100)
    assert decide.macro_f05(new, t, universe).first()["macro_f05"] > 0.85
    top = models.importances(fitted["models"][0][0][0], linkage.STAGE1)
    assert abs(sum(top.values()) - 1) < 1e-6


def test_stream_gives_the_candidates_of_the_batch(spark, tmp_path):
    index, queries, _ = planted(2, 40)
    i = linkage.normalise(spark.createDataFrame(index, SCHEMA))
    q = linkage.normalise(spark.createDataFrame(queries, SCHEMA)).select("id", "country", "ntok", "atok", *[f"key_{k}" for k in ("core_pn", "skel_pn", "cat_pn", "core", "skel", "cat")])
    q.repartition(2).write.parquet(f"{tmp_path}/q")
    got = []
    stream = spark.readStream.schema(q.schema).parquet(f"{tmp_path}/q")
    run = candidates_of_stream(i, stream, lambda df, n: got.extend(tuple(r)[:2] for r in df.collect()), f"{tmp_path}/at", df_floor=100)
    run.awaitTermination()
    from kinlink.operators import retrieval

    assert sorted(got) == sorted(tuple(r)[:2] for r in retrieval.candidates(i, spark.read.parquet(f"{tmp_path}/q"), df_floor=100).collect()) and got


def test_results_follow_the_order_of_the_index(spark, tmp_path):
    from kinlink.sources import tables

    ids = [f"S1-{k}" for k in (7, 3, 11, 5)]
    order = spark.createDataFrame(list(enumerate(ids)), "pos long, entity_id string")
    index = spark.createDataFrame([(k, e) for k, e in enumerate(ids)], "id long, entity_id string")
    queries = spark.createDataFrame([(1, "S2-1"), (2, "S3-9"), (3, "S2-4")], "id long, entity_id string")
    pairs = spark.createDataFrame([(2, 2), (2, 1), (0, 3)], "si long, qi long")
    tables.write_ordered(linkage.results(pairs, index, queries, order, "matched_entity_ids"), f"{tmp_path}/out")
    got = [l.split("\t") for f in sorted((tmp_path / "out").glob("part-*")) for l in f.read_text().splitlines()]
    rows = [r for r in got if r[0] != "source1_entity_id"]
    assert rows == [["S1-7", "S2-4"], ["S1-3", ""], ["S1-11", "S2-1,S3-9"], ["S1-5", ""]]


def test_validator_entry(spark, tmp_path, capsys):
    from kinlink.operators import validate

    (tmp_path / "s1.tsv").write_text("entity_id\tname\nS1-1\ta\nS1-2\tb\n")
    good, bad, commas = (tmp_path / n for n in ("good.tsv", "bad.tsv", "commas.tsv"))
    good.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\t\n")
    bad.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1\nS1-1\tS1-2\nno tab\n")
    commas.write_text("source1_entity_id,matched_entity_ids\n")
    assert validate.main([str(good), str(tmp_path / "s1.tsv")]) == 0
    assert validate.main([str(bad), str(tmp_path / "s1.tsv")]) == 1
    out = capsys.readouterr().out
    assert all(x in out for x in ("duplicate_row", "repeated_id", "self_match", "missing", "extra", "without a tab"))
    assert validate.main([str(commas), str(tmp_path / "s1.tsv")]) == 1 and validate.main([str(tmp_path / "none"), str(tmp_path / "s1.tsv")]) == 1


def test_ids_of_a_folder_of_parts(spark, tmp_path):
    from kinlink.sources import tables

    spark.range(20).selectExpr("concat('S1-', id) AS entity_id", "'x' AS name").repartition(4).write.option("sep", "\t").option("header", True).csv(f"{tmp_path}/ids")
    assert {r[0] for r in tables.read_ids(spark, f"{tmp_path}/ids").collect()} == {f"S1-{k}" for k in range(20)}


def test_rule_chosen_by_simulation(spark):
    """With scores that are their own precision, a threshold that takes nearly nothing loses."""
    rows = [(q, q // 20, (q * 37 % 100) / 99, int((q * 7919 // 100) % 100 <= q * 37 % 100)) for q in range(1000)]
    d = spark.createDataFrame(rows, "qi long, si long, p2 double, y int")
    rule = decide.choose_rule(d, d, "p2", sum(r[3] for r in rows), spark.range(50).withColumnRenamed("id", "si"), reps=1)
    assert len(rule["simulated"]) == 6 and rule["accepted"] > 0
    assert max(rule["simulated"], key=rule["simulated"].get).startswith(rule["rule"])
    assert rule["simulated"]["thr_0.97"] < max(rule["simulated"].values())
