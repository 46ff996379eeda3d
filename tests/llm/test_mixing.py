"""The mix against its own definition: targets, quotas, disjoint draws, shortened copies, equal rows."""

import collections

from loamweave.llm import mixing
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def test_taken_words_are_the_target_rounded_down(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    per = mixing.plan(docs).groupBy("src").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max(F.col("taken") - 3 * F.col("size")).alias("over"), F.sum((F.col("part") > 0).cast("int")).alias("parts"))
    for r in per.collect():
        assert r.taken == int(r.target) and r.over <= 0 and r.parts <= 1


def test_mixed_texts_have_the_planned_words(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = {r.src: r.n for r in mixing.plan(docs).groupBy("src").agg(F.sum("taken").alias("n")).collect()}
    out = mixing.mixed(docs, length="n_chars")
    got = out.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).collect()
    assert out.columns == docs.columns and {r.source: r.n for r in got} == {k: n for k, n in want.items() if n}
    whole = {r.doc_id: r.text for r in docs.collect()}
    cut = [r for r in out.collect() if r.text != whole[r.doc_id]]
    assert len(cut) <= 20 and all(whole[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in cut)


def test_tree_keeps_quotas_and_halves_evenly(spark):
    quotas = {"a": 700, "b": 41, "c": 0, None: 259}
    row = spark.createDataFrame([([(s, q) for s, q in quotas.items()],)], "quotas array<struct<src:string,q:int>>")
    shards = {r.shard: {x.src: x.q for x in r.quotas} for r in mixing.splitting_tree(row, 5, 3).collect()}
    assert len(shards) == 32 and all(q >= 0 for s in shards.values() for q in s.values())
    assert {s: sum(x[s] for x in shards.values()) for s in quotas} == quotas
    assert {sum(x.values()) for x in shards.values()} <= {31, 32}
    assert len({x["a"] for x in shards.values()}) > 3  # drawn, not dealt in turn


def test_draws_of_blocks_are_disjoint_and_complete(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    p = mixing.Plan(mixing._numbers(docs), mixing.WEIGHTS, 3.0, None, 8)
    n = 1 << p.bits
    sources = {r._s: r for r in p.sources.collect()}
    draws = collections.Counter()
    for r in p.blocks.collect():
        draws[r._b] += len(r.shards)
        s = sources[r._b]
        assert len(r.shards) == s.whole + (s.edge is not None and r._r <= s.edge)
    for k, s in sources.items():
        assert draws[k] == s.whole * n + (s.edge + 1 if s.edge is not None else 0)


def test_equal_rows_are_counted_one_by_one(spark):
    rows = [(1, "one two three four", "a")] * 5 + [(None, "x y", None)] * 3 + [(2, "w " * 40, "b"), (3, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for d in (docs, docs.repartition(3)):
        plan = mixing.plan(d).collect()
        per = collections.Counter()
        for r in plan:
            per[r.src] += r.taken
            assert len(r.shards) == r.copies and r.taken <= 3 * r.size
        assert all(per[r.src] == int(r.target) for r in plan)
        got = collections.Counter()
        for r in mixing.mixed(d).collect():
            got[r.source] += len(r.text.split())
        assert got == +per
