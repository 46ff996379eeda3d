"""The fixture tables seen as entity-resolution inputs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str, modulus: int = 0, rest: int = 0) -> DataFrame:
    """Order lines as scored pairs: s1_id the order, cand_id the part; with ``modulus`` only orders of one residue."""
    d = table(spark, sf_dir, "lineitem")
    if modulus:
        d = d.filter(F.col("l_orderkey") % modulus == rest)
    d = d.groupBy(F.col("l_orderkey").alias("s1_id"), F.col("l_partkey").alias("cand_id")).agg(F.min("l_linenumber").alias("ln"), F.min("l_linestatus").alias("nc"), F.min("l_returnflag").alias("nk"))
    prob = ((F.col("s1_id") * 7 + F.col("cand_id") * 13 + F.col("ln") * 31) % 1000).cast("double") / 1000
    return d.select("s1_id", "cand_id", F.concat(F.lit("c"), (F.col("s1_id") % 3).cast("string")).alias("country"), prob.alias("prob"), ((F.col("s1_id") + F.col("cand_id")) % 4 == 0).cast("int").alias("label"), "nc", "nk")


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, those without lines included."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1_id"), F.concat(F.lit("c"), (F.col("o_orderkey") % 3).cast("string")).alias("country"))


#: The same views in DuckDB SQL.
SQL = """
raw AS (SELECT l_orderkey AS s1_id, l_partkey AS cand_id, min(l_linenumber) AS ln, min(l_linestatus) AS nc, min(l_returnflag) AS nk FROM lineitem GROUP BY 1, 2),
pairs AS (SELECT s1_id, cand_id, 'c' || CAST(s1_id % 3 AS VARCHAR) AS country, CAST((s1_id * 7 + cand_id * 13 + ln * 31) % 1000 AS DOUBLE) / 1000 AS prob, CAST((s1_id + cand_id) % 4 = 0 AS INTEGER) AS label, nc, nk FROM raw),
universe AS (SELECT o_orderkey AS s1_id, 'c' || CAST(o_orderkey % 3 AS VARCHAR) AS country FROM orders),
truth AS (SELECT s1_id, cand_id FROM pairs WHERE label = 1),
owned AS (SELECT * FROM pairs QUALIFY prob = max(prob) OVER (PARTITION BY cand_id)),
chosen AS (SELECT s1_id, cand_id, prob FROM owned WHERE prob >= 0.5),
val AS (SELECT * FROM pairs WHERE s1_id % 2 = 0), test AS (SELECT * FROM pairs WHERE s1_id % 2 = 1),
counted AS (SELECT u.s1_id, u.country, coalesce(tp, 0) AS tp, coalesce(np, 0) AS np, coalesce(nt, 0) AS nt FROM universe u LEFT JOIN (
  SELECT coalesce(c.s1_id, t.s1_id) AS s1_id, count(*) FILTER (c.s1_id IS NOT NULL AND t.s1_id IS NOT NULL) AS tp, count(c.s1_id) AS np, count(t.s1_id) AS nt
  FROM chosen c FULL JOIN truth t ON c.s1_id = t.s1_id AND c.cand_id = t.cand_id GROUP BY 1) x ON u.s1_id = x.s1_id),
scored AS (SELECT *, CASE WHEN np = 0 AND nt = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * tp / (0.25 * nt + np) END::DOUBLE AS f FROM counted)
"""

#: Business records made of the parts, and of the same parts with variations, as SQL of either engine.
BUSINESSES = """SELECT p_partkey AS entity_id, CASE p_partkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'India' ELSE 'France' END AS country,
CASE p_partkey % 7 WHEN 0 THEN 'Mr ' WHEN 1 THEN 'Shree ' ELSE '' END || p_name || ' ' || p_type || CASE p_partkey % 5 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' LLC' WHEN 2 THEN ' Services Ltd' WHEN 3 THEN ' SARL' ELSE '' END AS name,
'No.' || CAST(p_size * 7 AS VARCHAR(20)) || ', ' || CAST(p_partkey % 30 AS VARCHAR(20)) || CASE p_partkey % 4 WHEN 0 THEN ' North Street, West Virginia' WHEN 1 THEN ' Second Avenue, New Delhi' WHEN 2 THEN ' Rue de ' || p_brand || ', Nord' ELSE ' ' || p_brand || ' Road' END AS address FROM part"""
VARIANTS = """SELECT p_partkey AS entity_id, CASE p_partkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'India' ELSE 'France' END AS country,
CASE p_partkey % 6 WHEN 0 THEN upper(p_name) || ' ' || p_type WHEN 1 THEN p_type || ' ' || p_name WHEN 2 THEN p_name || ' Center' WHEN 3 THEN replace(p_name, 's', '5') || ' ' || p_type || ' LLP' WHEN 4 THEN p_name ELSE p_name || ' ' || p_type || ' Corp' END AS name,
CASE WHEN p_partkey % 9 = 0 THEN '' ELSE CAST(p_size * 7 + p_partkey % 5 AS VARCHAR(20)) || ' ' || CAST(p_partkey % 30 AS VARCHAR(20)) || CASE p_partkey % 4 WHEN 0 THEN ' N St, WV' WHEN 1 THEN ' 2nd Ave, Delhi' WHEN 2 THEN ' rue de ' || p_brand ELSE ' ' || p_brand || ' rd' END END AS address FROM part"""
#: Candidate pairs: each part with its variation, and the parts of the first two lines of an order.
LISTED = """SELECT s1_id, cand_id, CAST((s1_id * 37 + cand_id * 11) % 1000 AS DOUBLE) / 1000 AS cos FROM (SELECT p_partkey AS s1_id, p_partkey AS cand_id FROM part
UNION SELECT a.l_partkey, b.l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2) x"""
RANKED = f"SELECT *, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY cos DESC, cand_id) AS INTEGER) AS rank FROM ({LISTED}) y"


def entity_numbers(u: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities per country of the labelled and the other half."""
    n = [u.filter(F.col("s1_id") % 2 == r).groupBy("country").agg(F.count(F.lit(1)).alias(name)) for r, name in ((0, "n_val"), (1, "n_test"))]
    return n[0], n[1]


def sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    """SQL over tables of a data folder."""
    named = re.sub(rf"\b(FROM|JOIN) ({'|'.join(tables)})\b", r"\1 {\2}", text)
    return spark.sql(named, **{t: table(spark, sf_dir, t) for t in tables})
