"""Context of scored claims (qi, si, src, score): within the query, within the entity, among claimants.

Scores are summed as given; ties are broken by the other id, so results don't depend on the
partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinlink.functions.scorers import score as similarity

TOP_SCORE = 0.5
CLAIMS = [
    "p2rk", "q_p2max", "q_marg", "q_p2sum", "q_n", "s_n", "s_p2sum_o", "s_p2max_o", "s_srk", "s_ntop_o",
    "s_ntop_same_src_o", "s_top_p2mean_o", "is_qtop",
]
CONSENSUS = [
    "c_pn_same", "c_pn_same_p2", "c_core_same", "c_core_same_p2", "c_pn_is_mode", "c_mode_eq_s1", "c_core_is_mode",
    "c_cmode_eq_s1", "c_pn_s_agree_p2",
]
ATTRIBUTES = ["legal", "st", "city", "pnum"]
AGREEMENT = ["eq_s1", "same", "same_p", "is_mode", "mode_eq_s1"]


def _nth(by: str, key: str, tie: str, n: int) -> Column:
    w = Window.partitionBy(key).orderBy(F.desc(by), tie).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.nth_value(by, n).over(w)


def query_context(d: DataFrame, score: str = "p2", suffix: str = "") -> DataFrame:
    """Rank, maximum, sum, count, margin of a claim in its query; whether it is a clear top claim."""
    q = Window.partitionBy("qi")
    p = F.col(score)
    d = d.withColumns(
        {
            f"p2rk{suffix}": F.row_number().over(q.orderBy(F.desc(score), "si")),
            f"q_p2max{suffix}": F.max(score).over(q),
            f"q_p2sum{suffix}": F.sum(score).over(q),
            f"q_n{suffix}": F.count(F.lit(1)).over(q),
            "__second": F.coalesce(_nth(score, "qi", "si", 2), p),
        }
    )
    first = F.col(f"p2rk{suffix}") == 1
    margin = F.when(first, p - F.col("__second")).otherwise(p - F.col(f"q_p2max{suffix}"))
    return d.withColumns({f"q_marg{suffix}": margin, f"is_qtop{suffix}": (first & (p > TOP_SCORE)).cast("int")}).drop("__second")


def entity_context(d: DataFrame, score: str = "p2", suffix: str = "") -> DataFrame:
    """What the other claims on the same entity look like; needs query_context."""
    s, same = Window.partitionBy("si"), Window.partitionBy("si", "src")
    p, top = F.col(score), F.col(f"is_qtop{suffix}")
    tops = F.sum(top).over(s) - top
    top_sum = F.sum(F.when(top == 1, p).otherwise(0.0)).over(s) - F.when(top == 1, p).otherwise(0.0)
    d = d.withColumns({"__n": F.count(F.lit(1)).over(s), "__m1": F.max(score).over(s), "__m2": _nth(score, "si", "qi", 2)})
    best_other = F.when(F.col("__n") == 1, 0.0).when(p >= F.col("__m1"), F.col("__m2")).otherwise(F.col("__m1"))
    return d.withColumns(
        {
            f"s_n{suffix}": F.col("__n"),
            f"s_p2sum_o{suffix}": F.sum(score).over(s) - p,
            f"s_srk{suffix}": F.row_number().over(s.orderBy(F.desc(score), "qi")),
            f"s_ntop_o{suffix}": tops,
            f"s_ntop_same_src_o{suffix}": F.sum(top).over(same) - top,
            f"s_top_p2mean_o{suffix}": top_sum / F.greatest(tops, F.lit(1)),
            f"s_p2max_o{suffix}": best_other,
        }
    ).drop("__n", "__m1", "__m2")


def context(d: DataFrame, score: str = "p2", suffix: str = "") -> DataFrame:
    return entity_context(query_context(d, score, suffix), score, suffix)


def weighted_mode(d: DataFrame, value: str, score: str, out: str, keys: tuple[str, ...] = ("si",)) -> DataFrame:
    """(keys, out): the value with the largest summed score; ties go to the smaller value."""
    sums = d.groupBy(*keys, F.col(value).alias(out)).agg(F.round(F.sum(score), 9).alias("__w"))
    w = Window.partitionBy(*keys).orderBy(F.desc("__w"), out)
    return sums.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k", "__w")


def _mode(value: Column, weight: Column) -> Column:
    """``weighted_mode`` of the entity beside each of its claims, without a join; null weights don't count."""
    return F.first(F.when(weight.isNotNull(), value)).over(Window.partitionBy("si").orderBy(F.desc_nulls_last(weight), value))


def consensus(d: DataFrame, score: str = "p2", suffix: str = "") -> DataFrame:
    """Agreement of the claimants on house number and core name; one exchange by entity serves all windows.

    ``d`` has q_pnum, s_pnum, q_core, s_core; nulls count as empty.
    """
    d = d.withColumns({c: F.coalesce(c, F.lit("")) for c in ("q_pnum", "s_pnum", "q_core", "s_core")})
    p, has = F.col(score), F.col("q_pnum") != ""
    s, by_number, by_core = (Window.partitionBy(*k) for k in (("si",), ("si", "q_pnum"), ("si", "q_core")))
    agrees = F.when(F.col("q_pnum") == F.col("s_pnum"), p).otherwise(0.0)
    sums = {"__ns": F.sum(score).over(by_number), "__cs": F.sum(score).over(by_core), "__as": F.sum(agrees).over(s)}
    counts = {"__nn": F.count(F.lit(1)).over(by_number) - 1, "__cn": F.count(F.lit(1)).over(by_core) - 1}
    d = d.withColumns(sums | counts).withColumns({"__nw": F.when(has, F.round("__ns", 9)), "__cw": F.round("__cs", 9)})
    d = d.withColumns({"__pm": _mode(F.col("q_pnum"), F.col("__nw")), "__cm": _mode(F.col("q_core"), F.col("__cw"))})
    return d.withColumns(
        {
            f"c_pn_same{suffix}": F.when(has, F.col("__nn")).otherwise(-1),
            f"c_pn_same_p2{suffix}": F.when(has, F.col("__ns") - p).otherwise(-1.0),
            f"c_core_same{suffix}": F.col("__cn"),
            f"c_core_same_p2{suffix}": F.col("__cs") - p,
            f"c_pn_s_agree_p2{suffix}": F.col("__as") - agrees,
            f"c_pn_is_mode{suffix}": F.when(has, (F.col("q_pnum") == F.col("__pm")).cast("int")).otherwise(-1),
            f"c_mode_eq_s1{suffix}": F.when(F.col("__pm").isNull(), -1).otherwise((F.col("__pm") == F.col("s_pnum")).cast("int")),
            f"c_core_is_mode{suffix}": (F.col("q_core") == F.col("__cm")).cast("int"),
            f"c_cmode_eq_s1{suffix}": (F.col("__cm") == F.col("s_core")).cast("int"),
        }
    ).drop(*sums, *counts, "__nw", "__cw", "__pm", "__cm")


def attribute_consensus(d: DataFrame, attributes: list[str], score: str = "p3", suffix: str = "") -> DataFrame:
    """The five agreement columns of each attribute a (q_a against s_a); empty values take part."""
    p = F.col(score)
    every: list[str] = []
    for a in attributes:
        names = [f"__{x}_{a}" for x in "qsnwm"]
        q, s, n, w, m = (F.col(c) for c in names)
        every += names
        d = d.withColumns({names[0]: F.coalesce(f"q_{a}", F.lit("")), names[1]: F.coalesce(f"s_{a}", F.lit(""))})
        alike = Window.partitionBy("si", names[0])
        d = d.withColumns({names[2]: F.count(F.lit(1)).over(alike) - 1, names[3]: F.sum(score).over(alike)})
        d = d.withColumn(names[4], _mode(q, F.round(w, 9)))
        d = d.withColumns(
            {
                f"k_{a}_eq_s1{suffix}": (q == s).cast("int"),
                f"k_{a}_same{suffix}": n,
                f"k_{a}_same_p{suffix}": w - p,
                f"k_{a}_is_mode{suffix}": (q == m).cast("int"),
                f"k_{a}_mode_eq_s1{suffix}": (m == s).cast("int"),
            }
        )
    return d.drop(*every)


PEER_COLUMNS = ["pr_n", "pr_nmax", "pr_nmin", "pr_nw", "pr_amax", "pr_aw", "pr_pn_any", "pr_maxp"]


def peer_pairs(d: DataFrame, score: str = "p3", k: int = 3, least_peer: float = 0.2, least: float = 0.01) -> DataFrame:
    """(qi, si, pq, pp): up to k best other claimants of each claim's entity.  k + 1 rows an entity are joined."""
    best = Window.partitionBy("si").orderBy(F.desc(score), "qi")
    top = d.filter(F.col(score) >= least_peer).withColumn("__k", F.row_number().over(best)).filter(F.col("__k") <= k + 1)
    top = top.select("si", F.col("qi").alias("pq"), F.col(score).alias("pp"))
    mine = d.filter(F.col(score) >= least).select("qi", "si").join(top, "si").filter("pq <> qi")
    w = Window.partitionBy("qi", "si").orderBy(F.desc("pp"), "pq")
    return mine.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= k).drop("__k")


def peers(d: DataFrame, queries: DataFrame, score: str = "p3", k: int = 3, least_peer: float = 0.2, least: float = 0.01) -> DataFrame:
    """Add the peer columns; -1 without peers.  ``queries``: (qi, core, ad, pnum)."""
    x = peer_pairs(d, score, k, least_peer, least)
    x = x.join(queries.select("qi", F.col("core").alias("c1"), F.col("ad").alias("a1"), F.col("pnum").alias("n1")), "qi")
    x = x.join(queries.select(F.col("qi").alias("pq"), F.col("core").alias("c2"), F.col("ad").alias("a2"), F.col("pnum").alias("n2")), "pq")
    x = x.withColumn("ns", similarity("token_set_ratio", F.col("c1"), F.col("c2"))).withColumn("asim", similarity("token_set_ratio", F.col("a1"), F.col("a2")))
    g = x.groupBy("qi", "si").agg(
        F.count(F.lit(1)).alias("pr_n"),
        F.max("ns").alias("pr_nmax"),
        F.min("ns").alias("pr_nmin"),
        (F.sum(F.col("ns") * F.col("pp")) / F.sum("pp")).alias("pr_nw"),
        F.max("asim").alias("pr_amax"),
        (F.sum(F.col("asim") * F.col("pp")) / F.sum("pp")).alias("pr_aw"),
        F.coalesce(F.max(((F.col("n1") == F.col("n2")) & (F.col("n1") != "")).cast("int")), F.lit(0)).alias("pr_pn_any"),
        F.max("pp").alias("pr_maxp"),
    )
    return d.join(g, ["qi", "si"], "left").fillna(-1, PEER_COLUMNS)
