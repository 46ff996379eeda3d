"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from . import ann, brown_lm, compression_quality, language_id, mixing, pieces, quality_rules, set_join, surrogates, toxicity
from .common import surrogate_key, table
from .oracles import ORACLES

QUERIES = {
    "op1_toxicity": lambda spark, d: toxicity.query(table(spark, d, "documents"), table(spark, d, "labels")),
    "op2_pieces": lambda spark, d: pieces.query(table(spark, d, "documents")),
    "op3_surrogates": lambda spark, d: surrogates.query(table(spark, d, "documents"), surrogate_key(spark)),
    "op4_set_join": lambda spark, d: set_join.query(table(spark, d, "documents")),
    "op5_ann": lambda spark, d: ann.query(table(spark, d, "embeddings")),
    "op6_compression": lambda spark, d: compression_quality.query(table(spark, d, "documents"), table(spark, d, "labels")),
    "op7_brown_lm": lambda spark, d: brown_lm.query(table(spark, d, "documents")),
    "op8_mixing": lambda spark, d: mixing.query(table(spark, d, "documents")),
    "op9_language": lambda spark, d: language_id.query(table(spark, d, "documents")),
    "op10_quality_rules": lambda spark, d: quality_rules.assess(table(spark, d, "documents"), table(spark, d, "labels")),
}

__all__ = ["ORACLES", "QUERIES"]
