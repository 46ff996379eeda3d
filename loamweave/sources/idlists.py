"""Tab-separated sources and sinks: records, ground truth and id lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "entity_id string, name string, address string, country string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Four-column TSV: quotes are ordinary characters, other field counts fail, empty fields are ''."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="", schema=RECORD, mode="FAILFAST")
    return raw.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in raw.columns])


def read_lists(spark: SparkSession, path: str, ids: str = "s1_id", item: str = "match_id") -> tuple[DataFrame, DataFrame]:
    """A (key, comma list) TSV as long pairs, and all keys, those with empty lists included."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="", schema=f"{ids} string, list string")
    pairs = raw.select(ids, F.explode(F.split(F.coalesce("list", F.lit("")), ",")).alias(item)).filter(F.col(item) != "")
    return pairs, raw.select(ids)


def id_lists(universe: DataFrame, pairs: DataFrame, key: str = "s1_id", item: str = "cand_id", order: str | None = None) -> DataFrame:
    """(key, ids): each key of ``universe`` once, its distinct items comma-joined in order; '' without any."""
    if order is None:
        lists = pairs.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.col(item).cast("string"))), ",").alias("ids"))
    else:
        first = pairs.groupBy(key, item).agg(F.min(order).alias("_o"))
        lists = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", F.col(item).cast("string").alias("i")))), lambda x: x["i"]), ",").alias("ids"))
    return universe.select(key).distinct().join(lists, key, "left").select(key, F.coalesce("ids", F.lit("")).alias("ids"))


def problems(lists: DataFrame, universe: DataFrame, candidates: DataFrame | None = None, key: str = "s1_id") -> DataFrame:
    """Counts of what a validator refuses: missing, extra and repeated keys, repeated ids, ids outside the candidates."""
    items = lists.select(key, F.posexplode(F.filter(F.split("ids", ","), lambda x: x != "")).alias("i", "item"))
    n = lambda d: d.agg(F.count(F.lit(1)).alias("n"))
    parts = {
        "missing": universe.select(key).distinct().join(lists, key, "left_anti"),
        "extra": lists.join(universe.select(key).distinct(), key, "left_anti"),
        "repeated_key": lists.groupBy(key).count().filter("count > 1"),
        "repeated_id": items.groupBy(key, "item").count().filter("count > 1"),
    }
    if candidates is not None:
        parts["outside"] = items.join(candidates.select(key, F.col("cand_id").cast("string").alias("item")).distinct(), [key, "item"], "left_anti")
    out = None
    for name, d in parts.items():
        row = n(d).select(F.lit(name).alias("rule"), "n")
        out = row if out is None else out.unionByName(row)
    return out
