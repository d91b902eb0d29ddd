"""The catalogue: one query for each linkage operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.catalogue import adapters as A
from kinlink.catalogue import sql as S
from kinlink.functions.scorers import score
from kinlink.functions.text import fold_latin, skeleton
from kinlink.operators import context, decide, features, models, retrieval, validate
from kinlink.operators.addresses import normalise_addresses
from kinlink.operators.names import normalise_names
from kinlink.operators.tokens import add_tokens
from kinlink.plans import linkage
from kinlink.plans.scratch import keep, scratch_dir, ship, spread
from kinlink.sources import tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
GATE = 0.9


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for the comparison. Cosines are rounded to 9 digits already: 12 for what follows from them,
    as a second, coarser rounding would meet exact halves."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_cosines(df: DataFrame) -> DataFrame:
    """What follows from cosines of 9 digits, rounded to 12 as ``rounded`` does, without a decimal for every value: such
    values lie far from any half of the 12th digit, so both ways give the same double. A zero has no sign."""
    return df.select(*[(F.rint(F.col(c) * 1e12) / 1e12 + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def short_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(index, queries): short normalised records with tokens."""
    r = _short_with_tokens(spark, sf_dir)
    return r.filter("side = 1"), r.filter("side <> 1")


def _short_with_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(add_tokens(spread(A.view(spark, sf_dir, A.SHORT), "id")), "short-tokens")


# ---------------------------------------------------------------- sources and sinks


@query(S.TSV)
def tsv_roundtrip(spark, sf_dir):
    """Written without quoting and read back as strings; null and empty fields are null."""
    df = A.load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"), F.concat(F.lit('"'), "c_name", F.lit("\\")).alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"))
    path = f"{scratch_dir(spark)}/tsv-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    tables.write_tsv(df, path)
    return tables.read_tsv(spark, path, ["k", "name", "segment"])


@query(S.TRUTH_PAIRS)
def truth_pairs(spark, sf_dir):
    g = A.view(spark, sf_dir, A.TRUTH).groupBy("si").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("S2-"), F.col("qi").cast("string")))), ",").alias("matched_entity_ids"))
    return decide.truth_pairs(g.select(F.concat(F.lit("S1-"), F.col("si").cast("string")).alias("source1_entity_id"), "matched_entity_ids"))


@query(S.ID_LISTS)
def id_list_output(spark, sf_dir):
    c = A.view(spark, sf_dir, A.CLAIMS).filter("p2 > 0.9")
    pairs = c.select(F.concat(F.lit("S1-"), F.col("si").cast("string")).alias("s"), F.concat(F.lit("S"), F.col("src").cast("string"), F.lit("-"), F.col("qi").cast("string")).alias("q"))
    order = A.view(spark, sf_dir, A.UNIVERSE).select(F.concat(F.lit("S1-"), F.col("si").cast("string")).alias("entity_id"))
    return decide.id_lists(pairs, order, "matched_entity_ids")


# ---------------------------------------------------------------- names and addresses


@query(S.LATIN_FOLD)
def latin_fold(spark, sf_dir):
    words = A.load(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-zÀ-ÖØ-öø-ÿ]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", fold_latin(F.col("word")).alias("folded"))


@query(S.SKELETON)
def phonetic_skeleton(spark, sf_dir):
    words = A.load(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", skeleton(F.col("word")).alias("skel"))


def _names(spark, sf_dir):
    ship(spark)
    return normalise_names(A.view(spark, sf_dir, A.RECORDS), "business_name")


@query(S.NAMES)
def name_normalise(spark, sf_dir):
    return _names(spark, sf_dir).select("id", "nm", "core", "skel", "alt", "legal", "dom", "nonlat")


@query(S.NAME_TOKENS)
def name_tokens(spark, sf_dir):
    return _names(spark, sf_dir).select("id", F.explode(F.split("nm", " ")).alias("tok")).filter("tok <> ''").groupBy("id", "tok").agg(F.count(F.lit(1)).alias("times"))


@query(S.NAMES_LEGAL)
def legal_split(spark, sf_dir):
    return _names(spark, sf_dir).groupBy("legal").agg(F.count(F.lit(1)).alias("records"), F.sum(F.size(F.split("core", " "))).alias("words"))


@query(S.NAMES_DOMAIN)
def domain_stem(spark, sf_dir):
    return _names(spark, sf_dir).filter("dom = 1").select("id", "core")


@query(S.NAMES_ALIAS)
def dba_split(spark, sf_dir):
    return _names(spark, sf_dir).filter("alt <> ''").select("id", "alt", "nm")


def _addresses(spark, sf_dir):
    ship(spark)
    return normalise_addresses(A.view(spark, sf_dir, A.RECORDS), "business_address", "country")


@query(S.ADDRESSES)
def address_normalise(spark, sf_dir):
    return _addresses(spark, sf_dir).select("id", "ad", "nums", "pnum", "st", "city", "ad_empty")


@query(S.ADDRESS_STATES)
def state_lookup(spark, sf_dir):
    return _addresses(spark, sf_dir).groupBy("country", "st").agg(F.count(F.lit(1)).alias("records"))


@query(S.ADDRESS_WORDS)
def addr_words(spark, sf_dir):
    return _addresses(spark, sf_dir).select("id", F.explode(F.split("ad", " ")).alias("word")).filter("word <> ''").groupBy("word").agg(F.countDistinct("id").alias("records"))


@query(S.ADDRESS_PRIMARY)
def addr_primary_number(spark, sf_dir):
    return _addresses(spark, sf_dir).filter("pnum <> ''").select("id", "pnum")


@query(S.ADDRESS_NUMBERS)
def addr_numbers(spark, sf_dir):
    return _addresses(spark, sf_dir).select("id", "pnum", F.explode(F.split("nums", " ")).alias("number")).filter("number <> ''")


# ---------------------------------------------------------------- tokens and retrieval


@query(S.TOKENS)
def token_bag(spark, sf_dir):
    r = _short_with_tokens(spark, sf_dir)
    return r.select("id", F.explode("ntok").alias("tok")).unionByName(r.select("id", F.explode("atok").alias("tok")))


@query(S.BIGRAMS)
def addr_bigrams(spark, sf_dir):
    r = _short_with_tokens(spark, sf_dir)
    return r.select("id", F.explode("atok").alias("tok")).filter("tok like 'b:%'")


@query(S.KEYS)
def blocking_keys(spark, sf_dir):
    return _short_with_tokens(spark, sf_dir).select("id", "key_core_pn", "key_skel_pn", "key_cat_pn", "key_core", "key_skel", "key_cat")


@query(S.VOCABULARY)
def idf_vocab(spark, sf_dir):
    index, _ = short_records(spark, sf_dir)
    return rounded(retrieval.vocabulary(index, "ntok"))


@query(S.WEIGHTS)
def tfidf_weights(spark, sf_dir):
    index, q = short_records(spark, sf_dir)
    return rounded(retrieval.postings(q, "atok", retrieval.vocabulary(index, "atok")))


@query(S.TOP_NAME)
def cosine_topk_name(spark, sf_dir):
    index, q = short_records(spark, sf_dir)
    return rounded(retrieval.best(index, q, "rk_n", 10).select("qi", "si", F.col("cos_n").alias("cos"), "rk"), 12)


@query(S.TOP_BOTH)
def cosine_topk_combined(spark, sf_dir):
    index, q = short_records(spark, sf_dir)
    return rounded(retrieval.best(index, q, "rk_c", 15), 12)


@query(S.KEY_CANDIDATES)
def key_candidates_capped(spark, sf_dir):
    return retrieval.key_candidates(*short_records(spark, sf_dir))


def _candidates(spark, sf_dir):
    return retrieval.candidates(*short_records(spark, sf_dir))


@query(S.CANDIDATES)
def candidate_union(spark, sf_dir):
    return rounded(_candidates(spark, sf_dir), 12)


@query(S.STAGE1)
def stage1_features(spark, sf_dir):
    c = retrieval.candidates(*short_records(spark, sf_dir), describe=linkage.stage1_of_kinds)
    return rounded_cosines(c.drop(*linkage.FLAGS, *retrieval.RANKS))


@query(S.CASCADE)
def cascade_topm(spark, sf_dir):
    return rounded(features.cascade(A.view(spark, sf_dir, A.CLAIMS).select("qi", "si", "p2"), "p2", 3))


@query(S.RECALL)
def recall_at_k(spark, sf_dir):
    ranked = A.view(spark, sf_dir, A.CLAIMS).select("qi", "si", "p2")
    ranked = retrieval.top_k(ranked, "p2", 10, "rk")
    return retrieval.recall_at(ranked, A.view(spark, sf_dir, A.TRUTH), "rk", [1, 3, 6, 10])


# ---------------------------------------------------------------- pair features


def _string_pairs(spark, sf_dir):
    return A.view(spark, sf_dir, S.STRING_PAIRS)


@query(S.LEVENSHTEIN)
def levenshtein_feat(spark, sf_dir):
    return _string_pairs(spark, sf_dir).select("qi", "si", F.levenshtein("q_pnum", "s_pnum").alias("pnum_lev"))


@query(S.JARO_WINKLER)
def jaro_winkler_feat(spark, sf_dir):
    ship(spark)
    return rounded(_string_pairs(spark, sf_dir).select("qi", "si", score("jaro_winkler", F.col("q_core"), F.col("s_core")).alias("n_jw")))


@query(S.INDEL)
def indel_ratio(spark, sf_dir):
    ship(spark)
    return rounded(_string_pairs(spark, sf_dir).select("qi", "si", score("ratio", F.col("q_city"), F.col("s_city")).alias("city_ratio")))


@query()
def token_set_ratio(spark, sf_dir):
    """Token-set similarity of the core names."""
    ship(spark)
    return rounded(_string_pairs(spark, sf_dir).select("qi", "si", score("token_set_ratio", F.col("q_core"), F.col("s_core")).alias("n_tset")))


@query()
def string_scores(spark, sf_dir):
    """All similarity scores of the strings of parts and suppliers, each on its own field."""
    ship(spark)
    return rounded(features.string_scores(_string_pairs(spark, sf_dir)).select("qi", "si", "pnum_lev", *features.STRING_SCORES))


@query(S.OVERLAPS)
def set_overlap_feats(spark, sf_dir):
    d = A.view(spark, sf_dir, S.OVERLAP_PAIRS)
    names = [c for c in features.set_overlaps(d).columns if c not in d.columns]
    return rounded(features.set_overlaps(d).select("qi", "si", *names))


@query(S.DIGITS)
def digit_geometry(spark, sf_dir):
    d = A.view(spark, sf_dir, S.DIGIT_PAIRS)
    names = [c for c in features.digit_geometry(d).columns if c not in d.columns]
    return rounded(features.digit_geometry(d).select("qi", "si", *names))


@query(S.MEMBERSHIP)
def nums_minabs(spark, sf_dir):
    return features.number_membership(A.view(spark, sf_dir, S.DIGIT_PAIRS)).select("qi", "si", "pn_q_in_snums", "pn_s_in_qnums", "nums_minabs")


@query(S.DIFFERENCES)
def idf_diff_feats(spark, sf_dir):
    index, q = short_records(spark, sf_dir)
    pairs = retrieval.key_candidates(index, q).select("qi", "si")
    idf, n = features.word_idf(index, "ad"), index.count()
    side = lambda r, p: features.with_word_idf(r.select("id", "ad"), idf, n, "ad").select(F.col("id").alias(f"{p}i"), F.col("ad_idf").alias(f"{p}_ad_idf"))
    d = pairs.join(side(q, "q"), "qi").join(side(index, "s"), "si")
    return rounded(features.word_differences(d, "ad", "da").drop("q_ad_idf", "s_ad_idf"))


@query(S.AMBIGUITY)
def ambiguity_counts(spark, sf_dir):
    index, q = short_records(spark, sf_dir)
    pairs = retrieval.key_candidates(index, q).select("qi", "si")
    side = lambda r, p: features.with_ambiguity(r, index).select(F.col("id").alias(f"{p}i"), *[F.col(f"{c}_cnt").alias(f"{p}_{c}_cnt") for c in ("core", "skel")])
    return pairs.join(side(q, "q"), "qi").join(side(index, "s"), "si").select("qi", "si", *linkage.AMBIGUITY)


# ---------------------------------------------------------------- context


@query(S.QUERY_CONTEXT)
def query_context(spark, sf_dir):
    return rounded(context.query_context(A.view(spark, sf_dir, A.CLAIMS)).drop("p3", "y", "src"))


@query(S.ENTITY_CONTEXT)
def entity_context(spark, sf_dir):
    d = context.context(A.view(spark, sf_dir, A.CLAIMS))
    return rounded(d.select("qi", "si", *[c for c in d.columns if c.startswith("s_")]))


@query(S.BEST_OTHER)
def best_other(spark, sf_dir):
    return rounded(context.context(A.view(spark, sf_dir, A.CLAIMS)).groupBy("si").agg(F.max("s_p2max_o").alias("most"), F.min("s_p2max_o").alias("least")))


@query(S.WEIGHTED_MODE)
def weighted_mode(spark, sf_dir):
    return context.weighted_mode(A.view(spark, sf_dir, A.CLAIM_PAIRS), "q_pnum", "p2", "pmode")


@query(S.CONSENSUS)
def claim_consensus(spark, sf_dir):
    d = context.consensus(A.view(spark, sf_dir, A.CLAIM_PAIRS))
    return rounded(d.select("qi", "si", *[c for c in d.columns if c.startswith("c_")]))


@query(S.ATTRIBUTES)
def attr_consensus(spark, sf_dir):
    d = context.attribute_consensus(A.view(spark, sf_dir, A.CLAIM_PAIRS), ["legal", "city"])
    return rounded(d.select("qi", "si", *[c for c in d.columns if c.startswith("k_")]))


@query(S.PEERS)
def peer_pairs(spark, sf_dir):
    return rounded(context.peer_pairs(A.view(spark, sf_dir, A.CLAIMS)))


@query()
def peer_feats(spark, sf_dir):
    """Similarity of each claim to the best other claimants of its entity."""
    ship(spark)
    d = A.view(spark, sf_dir, A.CLAIM_PAIRS)
    q = d.select("qi", F.col("q_core").alias("core"), F.col("q_city").alias("ad"), F.col("q_pnum").alias("pnum")).distinct()
    return rounded(context.peers(d.select("qi", "si", "p3"), q))


# ---------------------------------------------------------------- decisions


@query(S.ASSIGN)
def assign_threshold(spark, sf_dir):
    return decide.assign(A.view(spark, sf_dir, A.CLAIMS), "p2", 0.7)


@query(S.EXPECTED_F)
def assign_expected_f(spark, sf_dir):
    return decide.assign_expected_f(A.view(spark, sf_dir, A.CLAIMS), "p2")


@query(S.MACRO_F05)
def macro_f05(spark, sf_dir):
    d = A.view(spark, sf_dir, A.CLAIMS)
    return decide.macro_f05(decide.assign(d, "p2", 0.7), A.view(spark, sf_dir, A.TRUTH), A.view(spark, sf_dir, A.UNIVERSE))


@query(S.SWEEP)
def threshold_sweep(spark, sf_dir):
    return decide.threshold_sweep(A.view(spark, sf_dir, A.CLAIMS), "p2", A.view(spark, sf_dir, A.TRUTH), A.view(spark, sf_dir, A.UNIVERSE))


def _best(spark, sf_dir):
    """The best claim of every query, with its strings."""
    return decide.best_per_query(A.view(spark, sf_dir, A.CLAIM_PAIRS), "p2")


def _sides(spark, sf_dir):
    """(train, test) of a calibration: the best claims of even and of odd queries."""
    best = _best(spark, sf_dir)
    return best.filter("qi % 2 = 0"), best.filter("qi % 2 = 1")


@query(S.BANDS)
def band_calibration(spark, sf_dir):
    train, test = _sides(spark, sf_dir)
    return rounded(decide.band_table(train, test, "p2", 5000))


@query(S.CALIBRATED)
def calibrate_scores(spark, sf_dir):
    train, test = _sides(spark, sf_dir)
    return rounded(decide.calibrate(test, decide.band_table(train, test, "p2", 5000), "p2").select("qi", "si", "pc"))


@query(S.STRATA)
def strata_calibration(spark, sf_dir):
    train, test = (decide.strata(x) for x in _sides(spark, sf_dir))
    return rounded(decide.strata_table(train, test, "p2", 5000, 4000.0))


@query()
def simulate_f05(spark, sf_dir):
    """Simulated macro F0.5 of a threshold on calibrated scores."""
    train, test = _sides(spark, sf_dir)
    pc = keep(decide.calibrate(test, decide.band_table(train, test, "p2", 5000), "p2"), "calibrated")
    f = decide.simulate_f05(pc, A.view(spark, sf_dir, A.UNIVERSE), F.col("pc") > 0.3, 0.1)
    return spark.createDataFrame([(0.3, f)], "threshold double, simulated_f05 double")


@query(S.OFFSETS)
def twin_offset(spark, sf_dir):
    return decide.house_offset(_best(spark, sf_dir)).select("qi", "si", "d", "grp")


@query(S.GATE)
def twin_gate(spark, sf_dir):
    train, test = (decide.house_offset(x) for x in _sides(spark, sf_dir))
    return rounded(decide.gate_table(train, test, "p2", 100, 100))


@query(S.GATED)
def gated_matches(spark, sf_dir):
    return decide.gated_matches(_best(spark, sf_dir), "p2", GATE)


@query(S.BLEND)
def score_blend(spark, sf_dir):
    c = A.view(spark, sf_dir, A.CLAIMS)
    return rounded(decide.blend(c, c.filter("si % 3 <> 0"), "p2", "p3"))


@query(S.FOLDS)
def fold_split(spark, sf_dir):
    c = A.view(spark, sf_dir, A.CLAIMS)
    return c.select("qi", models.fold_of(F.col("qi")).alias("fold")).groupBy("fold").agg(F.count(F.lit(1)).alias("claims"), F.countDistinct("qi").alias("queries"))


@query(S.VALIDATE)
def validate_rules(spark, sf_dir):
    rows = A.view(spark, sf_dir, S.RESULT_ROWS)
    required = A.view(spark, sf_dir, "SELECT 'S1-' || CAST(s_suppkey AS STRING) AS entity_id FROM supplier")
    known = A.view(spark, sf_dir, "SELECT DISTINCT 'S2-' || CAST(l_orderkey AS STRING) AS entity_id FROM lineitem")
    return validate.findings(rows, "matched_entity_ids", required, known)


@query()
def gbt_oof_scores(spark, sf_dir):
    """Out-of-fold scores of a boosted model on the claims' context."""
    d = keep(context.context(A.view(spark, sf_dir, A.CLAIMS)), "gbt")
    fitted = models.cross_fit(d, ["p2", "p3", "q_marg", "s_n", "s_p2max_o"], "y", models.STAGES[3] | {"maxIter": 5, "maxDepth": 3})
    return rounded(models.out_of_fold(fitted, d, "p4").select("qi", "si", "y", "p4"))


@query()
def linkage_end_to_end(spark, sf_dir):
    """Raw records to candidates with all pair features: the parts as both sources."""
    r = keep(linkage.normalise(A.view(spark, sf_dir, A.RECORDS)), "records")
    index, q = r.filter("id % 3 = 0"), r.filter("id % 3 <> 0")
    c = keep(linkage.candidate_features(index, q), "link-candidates")
    return rounded(linkage.pair_features(c, index, q).select("qi", "si", *linkage.STAGE1, *linkage.PAIR))


@query(S.STREAM)
def streaming_key_matches(spark, sf_dir):
    """Query records as a stream against the static index, by exact core name."""
    import uuid

    from kinlink.streaming.linkage import key_matches_of_stream

    index, q = short_records(spark, sf_dir)
    held = keep(index.select("id", "country", "key_core"), "stream-index")
    path = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    q.select("id", "country", "key_core").write.parquet(f"{path}/in")
    stream = spark.readStream.schema("id long, country string, key_core string").parquet(f"{path}/in")
    out = key_matches_of_stream(held, stream, "core").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/at").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.schema("qi long, si long").parquet(f"{path}/out")
