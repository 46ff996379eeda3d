"""The pipeline's stages, each taking effect, and its run as a whole."""

import corpus_pipeline as cp
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for name, stage in cp.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(docs.count())
        assert name == "pieces" or docs.columns == columns
    assert sizes[0] > sizes[1] >= sizes[2] == sizes[3] and sizes[4] == sizes[5] > 0
    assert docs.filter(F.size("pieces") != F.col("n_pieces")).count() == 0
    assert cp.run(spark, FOLDER).count() == sizes[-1]
