"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.plans.scratch import Kept


def _closest(edges: DataFrame, name: str) -> DataFrame:
    """Edges both ways joined with the least neighbour (or itself) of their first node.

    The least is combined on the map side, so a node with most of the links is one row per task.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if name == "small":
        both = both.filter("b < a")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a")


def components(links: DataFrame) -> DataFrame:
    """(id, component): every node of ``links`` (a, b) with the least id it can reach.

    Each round is written to the scratch folder and the round before is freed, so a lost executor
    costs a task, not the loop.  Rounds grow with the logarithm of the longest chain.
    """
    now = Kept(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        large = _closest(now.df, "large").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = _closest(large, "small")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).distinct()
        then = Kept(small, "links")
        r = then.df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        now.drop()
        now = then
        if (r["n"], r["x"]) == mark:
            break
        mark = (r["n"], r["x"])
    roots = now.df.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.df.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
