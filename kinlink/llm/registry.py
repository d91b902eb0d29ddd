"""The corpus operators as queries over the provided tables, and their SQL."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm import decontaminate, exact_dedup, html_text, langid, packing, pii, setjoin, shard, substring, url_filter

#: Production parameters of the queries.
SHARDS = [f"shard-{i:03d}" for i in range(64)]
#: Setting of the session that holds the secret of op9.
PII_KEY = "spark.kinlink.pii.key"
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(_table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.link(_table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"), window=35)


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.place(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def pii_key(spark: SparkSession) -> str:
    """The secret of the session; where none is set, one drawn for this application, which nobody can undo later."""
    key = spark.conf.get(PII_KEY, None)
    if not key:
        sc = spark.sparkContext
        if not hasattr(sc, "_kinlink_pii_key"):
            sc._kinlink_pii_key = secrets.token_hex(32)
        key = sc._kinlink_pii_key
    return key


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: a page is bad if a label of the document it comes from says low quality or toxic; that document is the
    number at the end of its path."""
    labels, pages = _table(spark, sf_dir, "labels"), _table(spark, sf_dir, "pages")
    _, path = url_filter.host_and_path(F.col("url"))
    source = F.regexp_extract(path, r"([0-9]{1,18})[^0-9]*\z", 1).try_cast("long")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNull() & F.col("toxic").isNull(), None).otherwise(0)
    outcomes = pages.select(F.col("page_id").alias("id"), source.alias("doc_id")).join(labels.select("doc_id", bad.alias("bad")), "doc_id")
    return url_filter.judge(pages, outcomes.select("id", "bad"), URL_RULES)


def queries() -> dict:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op6_ngram_jaccard": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op8_shard": _shard_sql(), "op10_url_filter": OP10_SQL}


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END)) AS s FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * i >= 90 * (p.n + q.n - i)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r FROM reach JOIN edges e ON e.x = reach.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(r) AS m FROM reach GROUP BY 1) USING (doc_id)
"""


OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, unnest(list_transform(range(1, len(words) - 33), lambda i: md5(array_to_string(words[i:i + 34], ' ')))) AS h FROM w),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
word AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w),
mark AS (
  SELECT word.doc_id, word.i, word, max(a.i) OVER (PARTITION BY word.doc_id ORDER BY word.i) AS last FROM word LEFT JOIN again a ON a.doc_id = word.doc_id AND a.i = word.i),
agg AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (last IS NOT NULL AND i - last < 35) AS n_removed,
    string_agg(word, ' ' ORDER BY i) FILTER (last IS NULL OR i - last >= 35) AS kept FROM mark GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN agg USING (doc_id)
"""


def _shard_sql() -> str:
    owners = ",".join(map(str, shard.lookup_table(SHARDS)))
    return f"""
WITH placed AS (
  SELECT doc_id, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12))::UBIGINT % {shard.TABLE_SIZE} AS INT) AS slot FROM documents),
owners AS (SELECT string_split('{owners}', ',') AS o)
SELECT doc_id, slot, 'shard-' || lpad(o[slot + 1], 3, '0') AS shard FROM placed, owners
"""


_URL_SQL = """
WITH urls AS (
  SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
sites AS (SELECT *, nullif(rtrim(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.'), '') AS site FROM urls),
parts AS (
  SELECT *, string_split(site, '.') AS l, regexp_matches(site, '^[0-9.]+$|[\\[\\]]') AS number,
    len(string_split(site, '.')) > 2 AND (regexp_full_match(string_split(site, '.')[-1], '[a-z]{2}') AND list_contains(GENERIC_LABELS, string_split(site, '.')[-2])
      OR list_contains(SERVICE_SUFFIXES, array_to_string(string_split(site, '.')[-2:], '.'))) AS two FROM sites),
leveled AS (
  SELECT *, CASE WHEN number THEN site WHEN two THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix,
    CASE WHEN number OR len(l) < 2 THEN site WHEN two THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain FROM parts),
outcome AS (
  SELECT page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM leveled JOIN labels ON doc_id = try_cast(regexp_extract(path, '([0-9]{1,18})[^0-9]*$', 1) AS BIGINT)
  WHERE site IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY page_id),
labelled AS (SELECT l.*, o.bad FROM leveled l JOIN outcome o USING (page_id)),
total AS (SELECT count(*) AS n, coalesce(sum(bad), 0) / greatest(count(*), 1)::DOUBLE AS p FROM labelled),
c1 AS (SELECT suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM labelled GROUP BY 1),
c2 AS (SELECT suffix, domain, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM labelled GROUP BY 1, 2),
c3 AS (SELECT suffix, domain, site, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM labelled GROUP BY 1, 2, 3),
v AS (
  SELECT lvl, count(*) AS k, any_value(p) AS p, (sum((bad / n - p) ** 2 * n) - (count(*) - 1) * any_value(p * (1 - p))) / sum(n) AS v
  FROM (SELECT 1 AS lvl, n, bad FROM c1 UNION ALL SELECT 2, n, bad FROM c2 UNION ALL SELECT 3, n, bad FROM c3) x, (SELECT p FROM total) t GROUP BY lvl),
s AS (SELECT lvl, CASE WHEN p <= 0 OR p >= 1 THEN 1 WHEN k < 2 OR v <= 0 THEN 1000 ELSE least(1000, greatest(1, p * (1 - p) / v - 1)) END AS s FROM v),
k AS (SELECT max(s) FILTER (lvl = 1) AS s1, max(s) FILTER (lvl = 2) AS s2, max(s) FILTER (lvl = 3) AS s3 FROM s),
p1 AS (SELECT suffix, c1.n, c1.bad, p AS q FROM c1, total t(tn, p)),
p2 AS (SELECT c2.suffix, domain, c2.n, c2.bad, (p1.bad - c2.bad + p1.q * s1) / (p1.n - c2.n + s1) AS q FROM c2 JOIN p1 USING (suffix), k),
p3 AS (SELECT c3.suffix, domain, site, c3.n, c3.bad, (p2.bad - c3.bad + p2.q * s2) / (p2.n - c3.n + s2) AS q FROM c3 JOIN p2 USING (suffix, domain), k),
m1 AS (SELECT suffix, bad + q * s1 AS a, n - bad + (1 - q) * s1 AS b FROM p1, k),
m2 AS (SELECT domain, bad + q * s2 AS a2, n - bad + (1 - q) * s2 AS b2 FROM p2, k),
m3 AS (SELECT site, bad + q * s3 AS a3, n - bad + (1 - q) * s3 AS b3 FROM p3, k),
b1 AS (SELECT suffix, round(a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)), 9) AS x1 FROM m1),
b2 AS (SELECT domain, round(a2 / (a2 + b2) - 1.645 * sqrt(a2 / (a2 + b2) * (1 - a2 / (a2 + b2)) / (a2 + b2 + 1)), 9) AS x2 FROM m2),
b3 AS (SELECT site, round(a3 / (a3 + b3) - 1.645 * sqrt(a3 / (a3 + b3) * (1 - a3 / (a3 + b3)) / (a3 + b3 + 1)), 9) AS x3 FROM m3),
scored AS (
  SELECT page_id, host, path, coalesce(x3, x2, x1, (SELECT CASE WHEN n > 0 THEN p - 1.645 * sqrt(p * (1 - p) / (n + 1)) ELSE 0 END FROM total)) AS bad_bound
  FROM leveled LEFT JOIN b3 USING (site) LEFT JOIN b2 USING (domain) LEFT JOIN b1 USING (suffix)),
rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) r(what, h, p)),
fits AS (
  SELECT page_id, h || p AS rule, what, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS k
  FROM scored JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT s.page_id, host, path, rule, coalesce(what, CASE WHEN bad_bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, bad_bound
FROM scored s LEFT JOIN fits f ON f.page_id = s.page_id AND f.k = 1
"""
OP10_SQL = _URL_SQL.replace("GENERIC_LABELS", str(url_filter.GENERIC)).replace("SERVICE_SUFFIXES", str(url_filter.SERVICES))
