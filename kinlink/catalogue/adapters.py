"""Views of the provided tables in the shapes the operators take.

They are inputs, not operators, so the same SQL text serves Spark and the SQL checks where the
dialects agree.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")

#: Scored claims: an order line claims its supplier. One row per (qi, si).
CLAIMS = """
SELECT l_orderkey AS qi, l_suppkey AS si, CAST(2 + l_suppkey % 2 AS INT) AS src,
       max(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 2003 AS DOUBLE) / CAST(2003 AS DOUBLE)) AS p2,
       max(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 613 AS DOUBLE) / CAST(613 AS DOUBLE)) AS p3,
       max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y
FROM lineitem GROUP BY l_orderkey, l_suppkey
"""
#: Claims with the strings of both sides.
CLAIM_PAIRS = f"""
SELECT c.*, CAST(c.qi % 40 + 1 AS STRING) AS q_pnum, CASE WHEN c.si % 7 = 0 THEN '' ELSE CAST(c.si % 45 + 1 AS STRING) END AS s_pnum,
       CASE c.qi % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma delta' END AS q_core,
       CASE c.si % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma delta' ELSE '' END AS s_core,
       CASE c.qi % 5 WHEN 0 THEN 'llc' WHEN 1 THEN 'inc' ELSE '' END AS q_legal, CASE c.si % 3 WHEN 0 THEN 'llc' ELSE '' END AS s_legal,
       CASE c.qi % 6 WHEN 0 THEN 'salem' ELSE 'boston' END AS q_city, CASE c.si % 2 WHEN 0 THEN 'salem' ELSE '' END AS s_city
FROM ({CLAIMS}) c
"""
TRUTH = f"SELECT DISTINCT si, qi FROM ({CLAIMS}) t WHERE y = 1"
UNIVERSE = "SELECT s_suppkey AS si FROM supplier"
#: Raw business records from the parts.
RECORDS = """
SELECT p_partkey AS id, 'S' || CAST(1 + p_partkey % 3 AS STRING) || '-' || CAST(p_partkey AS STRING) AS entity_id,
  CASE p_partkey % 2 WHEN 0 THEN 'US' ELSE 'India' END AS country,
  CASE p_partkey % 9
    WHEN 0 THEN p_name || ' LLC' WHEN 1 THEN 'M/s ' || p_name || ' Privete Limited' WHEN 2 THEN upper(p_name) || ', L.L.C.'
    WHEN 3 THEN 'www.' || replace(p_name, ' ', '-') || '.com' WHEN 4 THEN p_name || ' doing business as ' || p_type || ' Corporation'
    WHEN 5 THEN '-- ' || p_name || ' & Sons Incorporated 9876543210 | ' || p_brand WHEN 6 THEN 'The ' || p_name || ' [Co.]'
    WHEN 7 THEN NULL ELSE p_name || '''s ' || p_type || ' + ' || p_brand END AS business_name,
  CASE p_partkey % 8
    WHEN 0 THEN CAST(p_size AS STRING) || ' ' || p_type || ' St, Salem, KS' WHEN 1 THEN 'Plot No. 0' || CAST(p_size AS STRING) || ', Near ' || p_type || ' Rd, New Delhi, Delhi'
    WHEN 2 THEN 'PO Box 12, ' || CAST(p_size * 37 AS STRING) || ' Oak Ave, null, Boston, MA' WHEN 3 THEN '(' || CAST(p_size AS STRING) || ') 1st Street, Chokio, Minnesota'
    WHEN 4 THEN 'No. 12-' || CAST(p_size AS STRING) || ', ' || p_type || ' Ngr., Pune, MH' WHEN 5 THEN '' WHEN 6 THEN NULL
    ELSE 'H.No ' || CAST(p_size AS STRING) || 'b/' || CAST(p_partkey % 100 AS STRING) || ' Mg Road, tn' END AS business_address
FROM part
"""
#: Normalised records with the short fields of every part: side 1 is the index.
SHORT = """
SELECT p_partkey AS id, p_type AS country, CAST(1 + p_partkey % 3 AS INT) AS side, lower(p_name) AS core, translate(lower(p_name), 'aeiouyh', '') AS skel,
       CASE WHEN p_partkey % 5 = 0 THEN lower(p_type) ELSE '' END AS alt, replace(lower(p_brand), '#', '') || ' ' || lower(p_name) AS ad,
       CAST(p_size AS STRING) || ' ' || CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING) AS nums, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE CAST(p_size AS STRING) END AS pnum
FROM part
"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A SELECT over the provided tables; their names stand for the files."""
    for t in TABLES:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 parquet.`{sf_dir}/{t}.parquet`", sql)
    return spark.sql(sql)
