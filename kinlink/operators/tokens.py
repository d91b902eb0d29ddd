"""Token bags of the name and address channels, and exact blocking keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.functions.text import skeleton, words_of

KEYS = ("core_pn", "skel_pn", "cat_pn", "core", "skel", "cat")


def _tagged(tag: str, words: Column, least: int) -> Column:
    return F.transform(F.filter(words, lambda w: F.length(w) >= least), lambda w: F.concat(F.lit(tag), w))


def _skeletons(words: Column, least: int) -> Column:
    return F.transform(F.filter(words, lambda w: F.length(w) >= least), lambda w: F.concat(F.lit("k:"), skeleton(w)))


def bigrams(words: Column) -> Column:
    """``b:first_second`` of neighbouring words; none for fewer than two words."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.concat(F.lit("b:"), F.get(words, i - 1), F.lit("_"), F.get(words, i)))
    return F.filter(pairs, lambda x: x.isNotNull())


def add_tokens(df: DataFrame) -> DataFrame:
    """Add ntok, atok and the six keys to normalised records (core, skel, alt, ad, nums, pnum)."""
    core, alt, ad, nums = (words_of(F.col(c)) for c in ("core", "alt", "ad", "nums"))
    pnum = F.coalesce("pnum", F.lit(""))
    cat = skeleton(F.replace(F.coalesce("core", F.lit("")), F.lit(" "), F.lit("")))
    df = df.withColumn("__cat", cat).withColumn("__ad", ad)
    names = F.concat(_tagged("w:", core, 2), _skeletons(core, 2), _tagged("w:", alt, 3), _skeletons(alt, 3), F.array(F.concat(F.lit("c:"), F.col("__cat"))))
    with_number = F.when(pnum != "", F.transform(F.filter("__ad", lambda w: F.length(w) >= 3), lambda w: F.concat(F.lit("x:"), pnum, F.lit("_"), w))).otherwise(F.array().cast("array<string>"))
    places = F.concat(_tagged("a:", F.col("__ad"), 3), _tagged("d:", nums, 1), bigrams(F.col("__ad")), with_number)

    def key(c: Column, numbered: bool) -> Column:
        c = F.when(F.coalesce(c, F.lit("")) != "", c)
        return F.when(pnum != "", F.concat(c, F.lit("|"), pnum)) if numbered else c

    return df.withColumns(
        {
            "ntok": F.filter(F.array_distinct(names), lambda t: F.length(t) > 2),
            "atok": F.array_distinct(places),
            "key_core_pn": key(F.col("core"), True),
            "key_skel_pn": key(F.col("skel"), True),
            "key_cat_pn": key(F.col("__cat"), True),
            "key_core": key(F.col("core"), False),
            "key_skel": key(F.col("skel"), False),
            "key_cat": F.when(F.length("__cat") >= 4, F.col("__cat")),
        }
    ).drop("__cat", "__ad")
