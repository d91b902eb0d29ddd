"""The whole linkage: normalise, retrieve, score in four stages, decide, write.

``candidate_features`` and ``pair_features`` need no labels; ``fit`` trains the cascade of models and chooses the
decision rule on out-of-fold scores, ``apply`` scores and decides new queries, ``results`` makes the
two output tables.  Stage results are written to the scratch folder, which cuts the lineage between the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.operators import context, decide, features, models, retrieval
from kinlink.operators.addresses import normalise_addresses
from kinlink.operators.names import normalise_names
from kinlink.operators.tokens import add_tokens
from kinlink.plans.scratch import keep, ship

SIDE = ["core", "skel", "nm", "alt", "legal", "ad", "nums", "pnum", "st", "city"]
FLAGS = [f"kf_{k}" for k in retrieval.KEY_CAPS]
STAGE1 = [
    "cos_n", "cos_a", "cos_c", "rk_n", "rk_a", "rk_c", "qmax_n", "qmax_a", "qmax_c", "gap_n", "gap_a",
    "gap_c", "urk_n", "urk_a", "urk_c", "marg_c", "n_cand", "n_keyed", "kf_core_pn", "kf_skel_pn",
    "kf_cat_pn", "kf_core", "kf_skel", "kf_cat", "ad_empty", "nonlat", "dom", "src", "q_ntok", "q_natok",
]
CONTEXT = context.CLAIMS
OVERLAPS = [
    "q_nnum", "s_nnum", "q_nad", "s_nad", "q_nnm", "s_nnm", "num_common", "ad_common", "nm_common", "num_cq",
    "num_cs", "ad_cq", "ad_cs", "nm_cq", "nm_cs",
]
EQUALITIES = [
    "first_eq", "pnum_eq", "st_eq", "legal_eq", "s_pnum_len", "pnum_lev",
]
DIGITS = [
    "pn_absdiff", "pn_logdiff", "pn_reldiff", "pn_samelen", "pn_lendiff", "pn_hamming", "pn_lowdiff",
    "pn_highdiff", "pn_highdiff_rel", "pn_lastdig_eq", "pn_firstdig_eq", "pn_q_in_snums", "pn_s_in_qnums",
    "nums_minabs",
]
DIFFERENCES = [
    "dn_q", "dn_s", "dn_q_idf", "dn_s_idf", "dn_q_max", "dn_s_max", "dn_share_idf", "da_q", "da_s",
    "da_q_idf", "da_s_idf", "da_q_max", "da_s_max", "da_share_idf", "lg_q", "lg_s",
]
AMBIGUITY = [
    "s_core_cnt", "s_skel_cnt", "q_core_cnt", "q_skel_cnt",
]
#: What the third and fourth model see of a pair, beside p2.
BASE = [
    "p1", "cos_n", "cos_a", "n_tset", "a_tset", "pnum_eq", "num_cq", "sk_cat", "ad_empty", "src", "n_ratio", "nm_tset",
    "sk_ratio", "a_ratio", "num_tset", "pn_absdiff", "pn_highdiff_rel", "pn_lowdiff", "st_eq", "city_ratio", "q_nnum",
    "s_nnum", "nonlat", "dom", "s_core_cnt", "s_skel_cnt", "q_core_cnt", "q_skel_cnt", "dn_q_idf", "dn_s_idf", "da_q_idf",
    "da_s_idf", "lg_q", "lg_s", "n_keyed",
]
THIRD = ["p2", *BASE, *CONTEXT]
FOURTH = [
    *THIRD, "p3", *[f"{c}_3" for c in [*context.CLAIMS, *context.CONSENSUS]],
    *[f"k_{a}_{x}_3" for a in context.ATTRIBUTES for x in context.AGREEMENT], *context.PEER_COLUMNS,
]
PAIR = [*features.STRING_SCORES, *OVERLAPS, *EQUALITIES, *DIGITS, *DIFFERENCES, *AMBIGUITY]


def normalise(records: DataFrame) -> DataFrame:
    """``records`` (id, entity_id, country, business_name, business_address) with all name, address and token columns."""
    ship(records.sparkSession)
    named = normalise_names(records, "business_name")
    return add_tokens(normalise_addresses(named, "business_address", "country"))


def stage1_of_kinds(c: DataFrame) -> DataFrame:
    """The stage-1 features of the candidates of each kind of query (q): once a kind, not once a record."""
    return features.stage1(c, FLAGS, "q")


def candidate_features(index: DataFrame, queries: DataFrame, **cap) -> DataFrame:
    """Candidates of the queries with the stage-1 features; both sides normalised."""
    c = retrieval.candidates(index, queries, describe=stage1_of_kinds, **cap)
    return c.join(features.query_meta(queries).withColumnRenamed("id", "qi"), "qi", "left")


def pair_features(c: DataFrame, index: DataFrame, queries: DataFrame) -> DataFrame:
    """String, set, digit, word and ambiguity features of the pairs in ``c`` (qi, si, ...).

    What depends on one record only (idf of its words, how ambiguous it is) is added before pairing.  Pairs whose
    records are equal in all that the features read are computed once.
    """
    n = index.count()
    idf = {col: keep(features.word_idf(index, col), "word-idf") for col in ("skel", "ad")}

    def side(records: DataFrame, p: str) -> DataFrame:
        r = features.with_ambiguity(records, index)
        for col in idf:
            r = features.with_word_idf(r, idf[col], n, col)
        own = [F.coalesce(x, F.lit("")).alias(f"{p}_{x}") for x in SIDE]
        return r.select(F.col("id").alias(f"__{p}"), *own, *[F.col(x).alias(f"{p}_{x}") for x in ("core_cnt", "skel_cnt", "skel_idf", "ad_idf")])

    (q, q_kinds), (s, s_kinds) = _kinds(queries), _kinds(index)
    named = keep(c.join(q.select(F.col("id").alias("qi"), F.col("kind").alias("__q")), "qi").join(s.select(F.col("id").alias("si"), F.col("kind").alias("__s")), "si"), "link-named")
    d = named.select("__q", "__s").distinct().join(side(q_kinds, "q"), "__q").join(side(s_kinds, "s"), "__s")
    d = features.number_membership(features.digit_geometry(features.set_overlaps(features.string_scores(d))))
    d = features.word_differences(features.word_differences(d, "skel", "dn"), "ad", "da").drop("q_skel_idf", "s_skel_idf", "q_ad_idf", "s_ad_idf")
    d = d.withColumns({"lg_q": features.legal_code(F.col("q_legal")), "lg_s": features.legal_code(F.col("s_legal"))})
    return named.join(keep(d, "link-kinds"), ["__q", "__s"]).drop("__q", "__s")


def _kinds(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, kind), one record (id, country, strings) per kind): records that are equal in all that a pair's features read are
    one kind, called after its least id."""
    content = ["country", *SIDE]
    r = records.select("id", *content).withColumn("__content", F.sha2(F.to_json(F.struct(*content)), 256))
    kinds = keep(r.groupBy("__content").agg(F.min("id").alias("id"), *[F.first(x).alias(x) for x in content]), "link-contents")
    return r.select("id", "__content").join(kinds.select("__content", F.col("id").alias("kind")), "__content").select("id", "kind"), kinds.drop("__content")


LEGAL_CATEGORIES = dict.fromkeys(("lg_q", "lg_s"), len(features.LEGAL_CODES) + 1)


def fourth_features(d: DataFrame, queries: DataFrame) -> DataFrame:
    """Context, consensus and attribute agreement on the third model's scores, and the peers; d has p2, p3 and the
    strings of both sides."""
    d = context.consensus(context.context(d, "p3", "_3"), "p3", "_3")
    d = keep(context.attribute_consensus(d, context.ATTRIBUTES, "p3", "_3"), "link-consensus")
    return context.peers(d, queries.select(F.col("id").alias("qi"), "core", "ad", "pnum"))


def fit(index: DataFrame, queries: DataFrame, truth: DataFrame, settings: dict = models.STAGES, keep_best: int = features.CASCADE, least_p2: float = 0.05, least_p4: float = 0.01, share: float = 1.0, **cap) -> dict:
    """Train the four stages on labelled queries; truth: (si, qi).

    ``share``: of the queries that the second and fourth stage train on.  Returns the models, the decision rule
    (on the third or the fourth score, whichever is better out of fold), and the out-of-fold scores.
    """
    label = truth.select("qi", "si", F.lit(1).alias("y"))
    c = candidate_features(index, queries, **cap).join(label, ["qi", "si"], "left").fillna(0, ["y"])
    c = keep(c, "link-candidates")
    first = models.cross_fit(c, STAGE1, "y", settings[1])
    kept = features.cascade(models.out_of_fold(first, c, "p1"), "p1", keep_best)
    d = keep(pair_features(kept, index, queries), "link-pairs")
    second = models.cross_fit(d, [*STAGE1, "p1", "p1rk", "p1max", "p1sum", *PAIR], "y", settings[2], share=share, categories=LEGAL_CATEGORIES)
    scored = keep(models.out_of_fold(second, d, "p2").filter(F.col("p2") >= min(least_p2, least_p4)), "link-second")
    ctx = keep(context.context(scored.filter(F.col("p2") >= least_p2)), "link-context")
    third = models.cross_fit(ctx, THIRD, "y", settings[3], categories=LEGAL_CATEGORIES)
    oof = keep(models.out_of_fold(third, ctx, "p3"), "link-scores")
    all4 = keep(fourth_features(_with_p3(scored, oof, least_p4), queries), "link-fourth")
    fourth = models.cross_fit(all4, FOURTH, "y", settings[4], share=share, categories=LEGAL_CATEGORIES)
    oof4 = keep(models.out_of_fold(fourth, all4, "p4"), "link-scores4")
    universe = index.select(F.col("id").alias("si"))
    rules = [decide.tune(oof, "p3", truth, universe), decide.tune(oof4, "p4", truth, universe)]
    return {"models": (first, second, third, fourth), "config": max(rules, key=lambda r: r["oof_f05"]), "configs": rules, "scores": oof4}


def _with_p3(scored: DataFrame, third: DataFrame, least_p4: float) -> DataFrame:
    """The pairs of the fourth stage with their context; p3 is 0 where the third stage left them out."""
    d = context.context(scored.filter(F.col("p2") >= least_p4))
    return d.join(third.select("qi", "si", "p3"), ["qi", "si"], "left").fillna(0.0, ["p3"])


def score(fitted: dict, index: DataFrame, queries: DataFrame, keep_best: int = features.CASCADE, least_p2: float = 0.05, least_p4: float = 0.01, **cap) -> DataFrame:
    """(qi, si, p2, p3, p4, strings of both sides) of new queries."""
    first, second, third, fourth = fitted["models"]
    c = keep(candidate_features(index, queries, **cap), "link-candidates")
    kept = features.cascade(models.mean_of_all(first, c, "p1"), "p1", keep_best)
    scored = keep(models.mean_of_all(second, keep(pair_features(kept, index, queries), "link-pairs"), "p2").filter(F.col("p2") >= min(least_p2, least_p4)), "link-second")
    p3 = keep(models.mean_of_all(third, context.context(scored.filter(F.col("p2") >= least_p2)), "p3"), "link-third")
    all4 = keep(fourth_features(_with_p3(scored, p3, least_p4), queries), "link-fourth")
    return models.mean_of_all(fourth, all4, "p4")


def apply(fitted: dict, index: DataFrame, queries: DataFrame, keep_best: int = features.CASCADE, least_p2: float = 0.05, **cap) -> DataFrame:
    """(si, qi) matches of new queries by the fitted models and rule."""
    scored = score(fitted, index, queries, keep_best, least_p2, **cap)
    if fitted["config"]["score"] == "p3":
        scored = scored.filter(F.col("p2") >= least_p2)
    return decide.decide(scored, fitted["config"])


def results(pairs: DataFrame, index: DataFrame, queries: DataFrame, order: DataFrame, out: str) -> DataFrame:
    """One row per entity of ``order`` (pos, entity_id): its query entity ids joined by commas, in that order.

    ``pairs``: (si, qi), matches or candidates; index, queries: (id, entity_id).
    """
    named = pairs.join(index.select(F.col("id").alias("si"), F.col("entity_id").alias("s")), "si").join(queries.select(F.col("id").alias("qi"), F.col("entity_id").alias("q")), "qi")
    lists = decide.id_lists(named.select("s", "q"), order.select("entity_id"), out)
    return lists.join(order.select(F.col("entity_id").alias("source1_entity_id"), "pos"), "source1_entity_id")
