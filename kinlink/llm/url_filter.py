"""URL filtering by empirical-Bayes host reputation, with explicit rules before it.

Labelled page outcomes (bad or not) are counted per host.  The bad rate of a host is shrunk
towards that of its registered domain, that towards its suffix, and that towards all pages,
each by a beta prior whose strength comes from the spread of the children's rates (method
of moments); the prior of a member leaves its own pages out.  A page is blocked where the lower posterior bound of its host's bad rate is above
a threshold; hosts without labels take the posterior of the nearest level that has some.

The registered domain is one label more than the public suffix, and that is the last label, or the last two where
these are a country's code with a generic label before it (co.uk, com.au) or a service that gives names to its
users (github.io).  An address of digits is its own domain.  Ports and user names don't count for the levels.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule, belongs to no host and
takes the overall posterior; an empty table gives no rows; urls of any length are taken whole; other columns are not
looked at, whatever their names; labels with a null id or without a page are ignored; repeated
pages are judged alike; with no labels at all everything that no rule blocks is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.plans.scratch import keep

LEVELS = ("suffix", "domain", "site")
#: A reputation table of more rows than this is joined by an exchange instead of a broadcast.
BROADCAST_ROWS = 200_000
#: A salted join deals a host's pages to so many tasks.
SALTS = 16
# Labels that make a suffix of two labels with a country's code, and suffixes of services.
GENERIC = ["ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "govt", "gv", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch"]
SERVICES = ["blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "vercel.app", "web.app", "wordpress.com"]
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://`` up to ``/ ? #``, A-Z lower-cased; then up to ``? #``."""
    u = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(u, r"(?s)\A.*?://([^/?#]*)", 1)
    path = F.regexp_extract(u, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _UPPER.lower()), path


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. rules: (verdict, host, path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the last one set wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _levels(df: DataFrame) -> DataFrame:
    """Add site (the host without port and user), domain and suffix; null where the host is empty."""
    site = F.rtrim(F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", ""), F.lit("."))
    df = df.withColumn("site", F.when(site != "", site)).withColumn("__parts", F.split("site", r"\."))
    last = lambda n: F.array_join(F.slice(F.concat(F.array(*[F.lit("")] * n), "__parts"), -n, n), ".")
    two = (F.element_at("__parts", -1).rlike("^[a-z]{2}$") & F.get("__parts", F.size("__parts") - 2).isin(GENERIC)) | last(2).isin(SERVICES)
    number = F.col("site").rlike(r"^[0-9.]+$|[\[\]]")
    df = df.withColumn("__two", F.coalesce(two & (F.size("__parts") > 2), F.lit(False)))
    return df.withColumns(
        {
            "suffix": F.when(number, F.col("site")).when(F.col("__two"), last(2)).otherwise(F.element_at("__parts", -1)),
            "domain": F.when(number | (F.size("__parts") < 2), F.col("site")).when(F.col("__two"), last(3)).otherwise(last(2)),
        }
    ).drop("__parts", "__two")


def _strength(counts: DataFrame, p: float, least: float = 1.0, most: float = 1000.0) -> float:
    """Prior strength from the spread of the rates: p(1-p)/v - 1, v the variance beyond chance."""
    if not 0 < p < 1:
        return least
    r = counts.agg(F.sum(F.col("n")).alias("n"), F.count(F.lit(1)).alias("k"), F.sum((F.col("bad") / F.col("n") - p) ** 2 * F.col("n")).alias("ss")).first()
    if not r["n"] or r["k"] < 2:
        return most
    v = (r["ss"] - (r["k"] - 1) * p * (1 - p)) / r["n"]
    return most if v <= 0 else min(most, max(least, p * (1 - p) / v - 1))


def reputation(labelled: DataFrame, z: float, most: float = 1000.0) -> tuple[list[DataFrame], float]:
    """Per level a table (key, posterior bound), and the bound of a page with no level known.

    ``labelled``: (site, domain, suffix, bad 0/1).  Counting is combined on the map side, so a
    host with a third of all labels is one counter per task.
    """
    hosts = keep(labelled.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")), "host-counts")
    counts = {k: hosts.groupBy(*LEVELS[: i + 1]).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")) for i, k in enumerate(LEVELS)}
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    n = total["n"] or 0
    p = (total["bad"] or 0) / n if n else 0.0
    tables, above = [], None
    for i, k in enumerate(LEVELS):
        s = _strength(counts[k], p, most=most)
        t = counts[k]
        if above is None:
            t = t.withColumn("prior", F.lit(p))
        else:  # what the level above says without this member's own pages, so that none counts twice
            other = (F.col("bad_above") - F.col("bad") + F.col("prior_above") * strength) / (F.col("n_above") - F.col("n") + strength)
            t = t.join(above, list(LEVELS[:i])).withColumn("prior", other)
        a = F.col("bad") + F.col("prior") * s
        b = F.col("n") - F.col("bad") + (1 - F.col("prior")) * s
        mean = a / (a + b)
        t = t.withColumn("bound", mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1)))
        tables.append(t.select(F.col(k).alias(f"__kl_{k}"), F.round("bound", 9).alias(f"__kl_bound_{k}")))
        above = t.select(*LEVELS[: i + 1], F.col("n").alias("n_above"), F.col("bad").alias("bad_above"), F.col("prior").alias("prior_above"))
        strength = s
    return tables, p - z * ((p * (1 - p) / (n + 1)) ** 0.5 if n else 0.0)


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", z: float = 1.645, threshold: float = 0.5) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, bad_bound.

    ``outcomes``: (id, bad 0/1) of labelled pages.
    """
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    urls = _levels(urls).withColumn("rule", rule).withColumn("by_rule", verdict)
    marked = outcomes.filter("id is not null and bad is not null").groupBy("id").agg(F.max("bad").alias("bad"))
    labelled = urls.filter("site is not null").join(marked, "id").select(*LEVELS, "bad")
    tables, default = reputation(labelled, z)
    for k, t in zip(LEVELS, tables):
        t = keep(t, "reputation")
        if t.count() <= BROADCAST_ROWS:
            urls = urls.join(F.broadcast(t), F.col(k) == F.col(f"__kl_{k}"), "left")
        else:  # the pages of one host are dealt to SALTS tasks
            t = t.withColumn("__kl_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
            urls = urls.withColumn("__kl_cell", salt).join(t, (F.col(k) == F.col(f"__kl_{k}")) & (F.col("__kl_cell") == F.col("__kl_salt")), "left").drop("__kl_salt", "__kl_cell")
    bound = F.coalesce("__kl_bound_site", "__kl_bound_domain", "__kl_bound_suffix", F.lit(default))
    return urls.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", F.when(bound > threshold, "block").otherwise("allow")).alias("verdict"),
        bound.alias("bad_bound"),
    )
