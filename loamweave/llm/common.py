"""Shared helpers: table access, lineage cuts, label folds."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder, freed, ship

#: ASCII white space of the word definition used by the contracts.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data folder through Spark (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def surrogate_key(spark: SparkSession) -> str:
    """The caller's secret for surrogates: ``spark.loamweave.surrogateKey``, or a public one for tests."""
    return spark.conf.get("spark.loamweave.surrogateKey", "not a secret")


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage.

    The folder is ``checkpoint_folder``; the files survive lost executors.  Shuffle files
    of the run go with it.
    """
    checkpoint_folder(df.sparkSession)
    with freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """A broadcast hint for a computed table, only where its counted rows stay below the bound."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shared(df: DataFrame, value) -> Broadcast:
    """Broadcast a driver-side value of bounded size to Python workers that know this package."""
    ship(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(value)


def id_type(df: DataFrame, name: str = "doc_id") -> str:
    return df.schema[name].dataType.simpleString()


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (null for a null id)."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def below(share: Column, *keys) -> Column:
    """True for about ``share`` of the keys: those with the smallest hashes."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < share * float(1 << 30)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, per_class: int, max_chars: int) -> DataFrame:
    """A bounded sample of labelled training texts: ``per_class`` rows of each label value.

    Rows are taken in the order of a hash of the id, so the sample does not depend on the layout.
    Only texts of 1 to ``max_chars`` characters count, which bounds the sample to
    ``2 * per_class * max_chars`` characters.  Of several labels for an id the largest counts, of several
    texts the first in order.  Columns: _y int, _text string.
    """
    from pyspark.sql import Window

    y = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).filter(F.col("_y").isin(0, 1) & (fold(F.col("_id"), modulus) != held)).groupBy("_id").agg(F.max("_y").alias("_y"))
    d = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).filter((fold(F.col("_id"), modulus) != held) & F.length("_text").between(1, max_chars))
    # the few ids are chosen first, from ids and lengths alone; only then are their texts read.  A share of
    # the ids in hash order, several times what is needed, keeps the ranked rows few at any input size.
    n = {r["_y"]: r["count"] for r in y.groupBy("_y").count().collect()}
    share = F.when(F.col("_y") == 1, min(1.0, 8 * per_class / max(1, n.get(1, 0)))).otherwise(min(1.0, 8 * per_class / max(1, n.get(0, 0))))
    order = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    chosen = (
        d.select("_id").join(y.filter(below(share, "_id")), "_id")
        .withColumn("_r", F.row_number().over(Window.partitionBy("_y").orderBy(order, "_id")))
        .filter(F.col("_r") <= per_class)
        .select("_id", "_y")
    )
    return d.join(F.broadcast(chosen.distinct()), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))
