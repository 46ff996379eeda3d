"""Sessions, and making this package known to Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster's session comes from spark-submit."""
    b = (
        SparkSession.builder.master(f"local[{cores}]").appName("loamweave")
        .config("spark.sql.shuffle.partitions", partitions).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.adaptive.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the workers this package's source, once a session (as ``--py-files`` would)."""
    sc = spark.sparkContext
    if getattr(sc, "_loamweave_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="loamweave-"), "loamweave.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("loamweave", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._loamweave_shipped = True


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only in local mode (tests), where it may be unset, a temporary folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Data frames made within remove their shuffle files when they have run, not only when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once into the checkpoint folder, as Parquet.

    For wide tables that are read several times: a checkpoint keeps whole rows, this keeps columns, of which each
    reader takes its own.  What is built on it has a short plan.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/stored-{uuid.uuid4().hex}"
    with freed(spark):
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
