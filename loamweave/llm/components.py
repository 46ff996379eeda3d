"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, comp): for every id in an edge the smallest id it is connected with.

    Each step points the larger ids of a neighbourhood at its smallest; a neighbourhood is only ever
    aggregated to that minimum and joined with it, so no group is gathered.  Steps end when the edges
    no longer change, which a count and a sum of hashes tell.
    """
    pick = lambda d: d.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    e = cut(pick(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))))
    before = None
    while True:
        # large star: every larger neighbour of u goes to u's minimum
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = pick(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # small star: every smaller neighbour of u, and u, go to the smallest of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        near = e.join(low, "u")
        e = cut(pick(near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    tops = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("comp"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(tops)
