from kinlink.plans import linkage


def test_pairs_of_equal_records_are_computed_once(spark, monkeypatch):
    """Pair features depend on the strings of both sides only: 40 x 30 pairs of copies are one pair of kinds."""
    made, keep = {}, linkage.keep

    def noted(df, name):
        made[name] = keep(df, name)
        return made[name]

    monkeypatch.setattr(linkage, "keep", noted)
    schema = "id long, country string, " + ", ".join(f"{c} string" for c in linkage.SIDE)
    row = {"core": "blue ring", "ad": "oak road", "nums": "7", "pnum": "7"}
    side = lambda first, n: spark.createDataFrame([(first + i, "US", *[row.get(c) for c in linkage.SIDE]) for i in range(n)], schema)
    index, queries = side(100, 30), side(0, 40)
    pairs = queries.selectExpr("id as qi").crossJoin(index.selectExpr("id as si"))
    got = linkage.pair_features(pairs, index, queries).select("qi", "si", "n_ratio", "s_core_cnt", "pnum_eq").collect()
    assert len({(r["qi"], r["si"]) for r in got}) == len(got) == 1200
    assert {tuple(r)[2:] for r in got} == {(100.0, 30, 1)}
    assert made["link-kinds"].count() == 1
