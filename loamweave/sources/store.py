"""Folders of a run: source tables and their normalised cache, id-list files, JSON and models, through Spark's file systems only."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as nm
from .idlists import read_records


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


@dataclass(frozen=True)
class Store:
    """``spark.loamweave.data`` and ``spark.loamweave.cache``, unless given."""

    spark: SparkSession
    data: str
    cache: str

    @classmethod
    def of(cls, spark: SparkSession, data: str | None = None, cache: str | None = None) -> Store:
        return cls(spark, data or spark.conf.get("spark.loamweave.data"), cache or spark.conf.get("spark.loamweave.cache"))

    def source(self, split: str, number: int) -> str:
        return f"{self.data}/{split}_source{number}.tsv"

    def cached(self, split: str, number: int) -> str:
        return f"{self.cache}/{split}_source{number}.parquet"

    def build(self, split: str, number: int) -> DataFrame:
        """Read, normalise and write one source."""
        nm.records(read_records(self.spark, self.source(split, number))).write.mode("overwrite").parquet(self.cached(split, number))
        return self.spark.read.parquet(self.cached(split, number))

    def load(self, split: str, number: int) -> DataFrame:
        """The cached source, built where it is missing or was not finished."""
        if exists(self.spark, f"{self.cached(split, number)}/_SUCCESS"):
            return self.spark.read.parquet(self.cached(split, number))
        return self.build(split, number)


def write_lists(ids: DataFrame, pairs: DataFrame, path: str, header: str, order: str | None = None) -> None:
    """``header`` below source1_entity_id; a line per id in their order (or that of ``order``), a TAB always, ids S2- and S3- once each in their pairs' order.

    ``ids``: s1_id (and the order); ``pairs``: s1_id, cand_id (and a column place, else by id).  Lines are
    ranged by the order over many files whose names sort; the first one begins with the header.
    """
    place = F.col("place") if "place" in pairs.columns else F.col("cand_id")
    good = pairs.filter(F.col("cand_id").rlike("^S[23]-")).groupBy("s1_id", "cand_id").agg(F.min(place).alias("_o"))
    lists = good.groupBy("s1_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "cand_id"))), lambda x: x["cand_id"]), ",").alias("ids"))
    rows = ids.select("s1_id", (F.col(order) if order else F.col("s1_id")).alias("_at")).join(lists, "s1_id", "left")
    lines = rows.select(F.lit(1).alias("_k"), F.col("_at"), F.concat("s1_id", F.lit("\t"), F.coalesce("ids", F.lit(""))).alias("value"))
    first = ids.sparkSession.range(1).select(F.lit(0).alias("_k"), F.lit(None).cast(lines.schema["_at"].dataType).alias("_at"), F.lit(f"source1_entity_id\t{header}").alias("value"))
    first.unionByName(lines).orderBy("_k", "_at").select("value").write.mode("overwrite").text(path)


def read_lists(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(s1_id, cand_id, place) of an id-list folder or file, and all its s1_id; the header line is left out."""
    rows = spark.read.text(path).filter(~F.col("value").startswith("source1_entity_id\t")).select(F.split("value", "\t").alias("x"))
    rows = rows.select(F.col("x")[0].alias("s1_id"), F.coalesce(F.get("x", 1), F.lit("")).alias("list"))
    return rows.select("s1_id", F.posexplode(F.split("list", ",")).alias("place", "cand_id")).filter("cand_id <> ''").select("s1_id", "cand_id", "place"), rows.select("s1_id")


def file_problems(spark: SparkSession, path: str, header: str, ids: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(rule, n): what a validator refuses in an id-list file: header, TAB, quotes or blanks, keys missing, foreign or repeated, ids of another kind, repeated or outside the candidates."""
    lines = spark.read.text(path)
    body = lines.filter(F.col("value") != f"source1_entity_id\t{header}")
    rows = body.select("value", F.split("value", "\t").alias("x")).select("value", F.size("x").alias("n"), F.col("x")[0].alias("s1_id"), F.coalesce(F.get("x", 1), F.lit("")).alias("list"))
    items = rows.select("s1_id", F.explode(F.split("list", ",")).alias("cand_id")).filter("cand_id <> ''")
    one = lambda d: d.agg(F.count(F.lit(1)).alias("n"))
    parts = {
        "header": lines.agg(F.abs(F.count_if(F.col("value") == f"source1_entity_id\t{header}") - 1).alias("n")), "tab": one(rows.filter("n <> 2")), "quote_or_blank": one(rows.filter(F.col("value").rlike('["\' ]'))),
        "missing": one(ids.select("s1_id").distinct().join(rows, "s1_id", "left_anti")), "foreign": one(rows.join(ids, "s1_id", "left_anti")), "repeated_key": one(rows.groupBy("s1_id").count().filter("count > 1")),
        "kind": one(items.filter(~F.col("cand_id").rlike("^S[23]-"))), "repeated_id": one(items.groupBy("s1_id", "cand_id").count().filter("count > 1")),
    }
    if candidates is not None:
        parts["outside"] = one(items.join(candidates.select("s1_id", "cand_id").distinct(), ["s1_id", "cand_id"], "left_anti"))
    out = None
    for rule, d in parts.items():
        row = d.select(F.lit(rule).alias("rule"), F.col("n").cast("long").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def save_model(model: PipelineModel, path: str, meta: dict) -> None:
    """A fitted model, and beside it what its use depends on (features, cut-offs, decision)."""
    model.write().overwrite().save(f"{path}/model")
    write_json(SparkSession.getActiveSession(), f"{path}/meta", meta)


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), read_json(spark, f"{path}/meta")


