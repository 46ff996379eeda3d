"""Tables that several steps read are computed once: short plans, the same columns, no shuffle files left."""

import glob
import os
import tempfile

from loamweave.operators import features
from loamweave.plans import linkage, scoring
from loamweave.session import stored

FOLDER = "/root/testdata/sf0.001"


def _plan(d) -> str:
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_labelled_pairs_are_read_not_planned_again(spark):
    new = scoring.labelled(spark, FOLDER)
    assert not any(x in _plan(new) for x in ("Join", "Window", "ArrowEvalPython"))
    old = features.rarity(features.group(features.native(linkage.joined(spark, FOLDER))), linkage.queries_side(spark, FOLDER)).select("s1_id", "cand_id", "country", *scoring.MODEL)
    got = new.select(*old.columns)
    assert got.dtypes == old.dtypes and sorted(map(str, got.collect())) == sorted(map(str, old.collect()))


def test_pairs_without_records_or_country_count_nothing(spark):
    fields = ", ".join(f"{f} string" for f in features.FIELDS if f != "non_latin") + ", non_latin boolean, entity_id long, country string"
    row = lambda i, key, country: (*["x" if f != "name_key" else key for f in features.FIELDS if f != "non_latin"], False, i, country)
    q = spark.createDataFrame([row(1, "a", "US"), row(2, "a", "US"), row(3, "a", None), row(4, "", "US"), row(5, "a", "India")], fields)
    pairs = spark.createDataFrame([(1, 2, 0.5, 1), (3, 1, 0.5, 1), (4, 4, 0.5, 1), (9, 1, 0.5, 1), (5, 9, 0.5, 1)], "s1_id long, cand_id long, cos double, rank int")
    names = ["s1_id", "cand_id", *linkage.RARITY]
    old = features.rarity(features.with_records(pairs, q, q), q).select(*names)
    new = features.pair_rarity(pairs, q, q).select(*names)
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, old.collect()))


def test_stored_leaves_no_shuffle_files(spark):
    files = lambda: set(glob.glob(os.path.join(os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()), "blockmgr-*", "*", "shuffle_*")))
    before = files()
    d = stored(spark.range(1000, numPartitions=3).selectExpr("id % 7 AS k").groupBy("k").count())
    left = {f for f in files() - before if f.endswith(".data")}  # a count below writes its own
    assert not left and d.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
