"""A corpus pipeline of five stages: quality rules, near-copies, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns documents (the last one: their pieces), so that the
stages can be run one by one with their results written between them, or at once by ``run``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamweave.llm import mixing, pieces, quality_rules, set_join, surrogates
from loamweave.llm.common import cut, surrogate_key, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled thresholds let pass."""
    cutoffs = cut(quality_rules.learn(docs, table(spark, sf_dir, "labels")))
    return quality_rules.apply(docs, cutoffs).filter("_q_kept").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: 0.8 of five-word shingles (op4_set_join asks for more)."""
    return set_join.distinct(docs, percent=80, n=5)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; the length column follows the text."""
    out = surrogates.replace(docs, surrogate_key(spark))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_pii_types") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents left out, taken or repeated, dealt to shards."""
    return mixing.mixed(docs, length="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, pieces."""
    out = pieces.encode(docs, pieces.load())
    return out.select("doc_id", F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"), "pieces")


STAGES = [("quality_rules", keep_good), ("set_join", one_of_each), ("surrogates", without_personal_data), ("mixing", mix), ("pieces", encode)]

#: Keyed hashes and the hypergeometric tree have no SQL counterpart; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
