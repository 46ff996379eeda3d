"""A cut table leaves its checkpoint, not the shuffle files of its run."""

import glob
import os
import tempfile

from loamweave.llm.common import cut


def test_cut_leaves_no_shuffle_files(spark):
    files = lambda: set(glob.glob(os.path.join(os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()), "blockmgr-*", "*", "shuffle_*.data")))
    before, held = files(), []
    for _ in range(3):
        held.append(cut(spark.range(1000, numPartitions=3).selectExpr("id % 7 AS k").groupBy("k").count()))
    left = files() - before  # a count below writes its own
    assert not left and [d.count() for d in held] == [7, 7, 7]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
