"""Candidate generation: TF-IDF top-K per partition, capped exact keys, merging, recall."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship, stored

QUERIES, POOL = 1024, 8192  # texts of a cell of the grid, at most about
COMMON = 256  # lists of a cell that are held as whole rows, at most; the others are held as lists


def blocking_text(records: DataFrame) -> DataFrame:
    """(part, id, text) of normalised records: core name and address, by country."""
    return records.select(F.col("country").alias("part"), F.col("entity_id").alias("id"), F.concat_ws(" ", "name_core", "addr_norm").alias("text"))


def terms(docs: DataFrame, key: str, text: str, part: str | None = None) -> DataFrame:
    """(part, id, term, tf): word counts per document; words are runs of letters and digits in lower case."""
    words = F.explode(F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}0-9]+", " "), " "), lambda t: t != ""))
    p = F.col(part) if part else F.lit("")
    return docs.select(p.alias("part"), F.col(key).alias("id"), words.alias("term")).groupBy("part", "id", "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf_topk(queries: DataFrame, pool: DataFrame, k: int = 20, min_df: int = 2, max_df: float = 1.0, part_max_df: dict[str, float] | None = None) -> DataFrame:
    """(part, s1_id, cand_id, cos, rank) from term tables: vocabulary and IDF come from the pool alone.

    Weights are (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), L2-normalised over the kept vocabulary.
    All words found in ``min_df`` of the pool's documents count, however common.  A caller may drop those in more than
    ``max_df`` of a partition's documents; ``part_max_df`` has other shares for some partitions.  The vectors are stored,
    and counted for the grid.
    """
    n = pool.select("part", "id").distinct().groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    most = F.coalesce(*[F.when(F.col("part") == p, F.lit(x)) for p, x in (part_max_df or {}).items()], F.lit(max_df))
    vocab = pool.groupBy("part", "term").agg(F.count(F.lit(1)).alias("df")).join(n, "part").filter((F.col("df") >= min_df) & (F.col("df") <= most * F.col("n")))
    vocab = vocab.select("part", "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))

    def vectors(t: DataFrame, other: DataFrame) -> DataFrame:
        """(part, id, bag, terms, w): the terms that the other side has too; equal bags have equal terms and counts, all of them."""
        both = other.select("part", "term").distinct().withColumn("both", F.lit(True))
        w = t.filter(F.col("id").isNotNull()).join(vocab, ["part", "term"]).join(both, ["part", "term"], "left").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
        v = w.groupBy("part", "id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sort_array(F.collect_list(F.struct("term", "tf", "w", "both"))).alias("x"))
        x = F.filter("x", lambda e: e["both"])
        bag = F.md5(F.to_json(F.transform("x", lambda e: F.struct(e["term"], e["tf"]))).cast("binary"))
        return stored(v.select("part", "id", bag.alias("bag"), F.transform(x, lambda e: e["term"]).alias("terms"), F.transform(x, lambda e: e["w"] / F.col("norm")).alias("w")).filter(F.size("terms") > 0))

    # each text that occurs is compared once: with the pool's in cells of a grid, each with all of its pairs
    q, p = vectors(queries, pool), vectors(pool, queries)
    one = lambda d: d.groupBy("part", "bag").agg(F.min("id").alias("id"), F.min_by(F.struct("terms", "w"), "id").alias("x")).select("part", "bag", "id", "x.*")
    each_q, each_p = one(q), one(p)
    most = [d.groupBy("part").agg(F.count_distinct("bag").alias("n")).agg(F.max("n")).first()[0] or 0 for d in (q, p)]
    rows, columns = -(-most[0] // QUERIES) or 1, -(-most[1] // POOL) or 1
    tasks = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = lambda d, own, n, other, m: d.withColumns({own: F.pmod(F.xxhash64("bag"), F.lit(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))}).repartition(tasks, "part", "_a", "_b")
    left, right = at(each_q, "_a", rows, "_b", columns), at(each_p, "_b", columns, "_a", rows)
    kind = p.schema["id"].dataType.simpleString()
    near = left.groupBy("part", "_a", "_b").cogroup(right.groupBy("part", "_a", "_b")).applyInArrow(_nearest(q.sparkSession, k), f"part string, q_bag string, p_bag string, least {kind}, cos double")
    # a bag among the first k by its smallest id, and its k smallest ids, are all that can be among the first k rows
    best = lambda d, id_: d.withColumn("rank", F.row_number().over(Window.partitionBy("part", "q_bag").orderBy(F.desc("cos"), id_))).filter(F.col("rank") <= k)
    first = p.select("part", F.col("bag").alias("p_bag"), F.col("id").alias("cand_id"), F.row_number().over(Window.partitionBy("part", "bag").orderBy("id")).alias("_n")).filter(F.col("_n") <= k).drop("_n")
    found = best(best(near, "least").drop("rank").join(first, ["part", "p_bag"]), "cand_id")
    return q.select("part", F.col("bag").alias("q_bag"), F.col("id").alias("s1_id")).join(found, ["part", "q_bag"]).select("part", "s1_id", "cand_id", "cos", "rank")


def _nearest(spark: SparkSession, k: int):
    """For a cell's queries and pool: (part, q_bag, p_bag, least, cos) of each query's ``k`` nearest, ties to smaller ids.

    Products are added up term by term over the pool's lists, so every pair with a common term is scored; the longest
    lists are held as rows of a matrix.  A query's ``k``-th best score among some of the pool is a bound for all of it.
    """
    ship(spark)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"q": [], "p": [], "cos": []}
        if left.num_rows and right.num_rows:
            ids = right.column("id").to_pandas()
            right = right.take(pa.array(ids.argsort(kind="stable").to_numpy()))
            flat = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            ends = [np.cumsum([0, *pc.list_value_length(t.column("terms")).to_pylist()]) for t in (left, right)]
            code, names = pd.factorize(np.concatenate([flat(left, "terms"), flat(right, "terms")]))
            q_term, p_term = code[: ends[0][-1]], code[ends[0][-1] :]
            by = np.argsort(p_term, kind="stable")
            at, v = np.repeat(np.arange(right.num_rows), np.diff(ends[1]))[by], flat(right, "w")[by]
            lists = np.searchsorted(p_term[by], np.arange(len(names) + 1))
            q_w = flat(left, "w")
            size = np.diff(lists)
            common = np.argsort(-size, kind="stable")[:COMMON]
            common = common[size[common] * 8 > right.num_rows]
            dense, row = np.zeros((len(common), right.num_rows)), np.full(len(names), -1)
            row[common] = np.arange(len(common))
            for r, t in enumerate(common):
                dense[r, at[lists[t] : lists[t + 1]]] = v[lists[t] : lists[t + 1]]
            step = max(1, right.num_rows // max(1024, 16 * k))
            for i in range(left.num_rows):
                total = np.zeros(right.num_rows)
                for j in range(ends[0][i], ends[0][i + 1]):
                    t = q_term[j]
                    if row[t] >= 0:
                        total += q_w[j] * dense[row[t]]
                    else:
                        c, d = lists[t], lists[t + 1]
                        total[at[c:d]] += q_w[j] * v[c:d]
                few = total[::step]
                least = np.partition(few, len(few) - k)[len(few) - k] if len(few) > k else 0.0
                some = np.flatnonzero(total > max(0.0, least - 2e-6))  # cos is rounded to six digits
                cos = np.round(total[some], 6)
                some, cos = some[cos > 0], cos[cos > 0]
                if len(cos) > k:
                    enough = cos >= np.partition(cos, len(cos) - k)[len(cos) - k]
                    some, cos = some[enough], cos[enough]
                order = np.lexsort((some, -cos))[:k]
                out["q"].append(np.full(len(order), i))
                out["p"].append(some[order])
                out["cos"].append(cos[order])
        x, y, cos = (np.concatenate(out[c]) if out[c] else np.zeros(0) for c in out)
        x, y = pa.array(x.astype(np.int64)), pa.array(y.astype(np.int64))
        return pa.table({"part": left.column("part").take(x), "q_bag": left.column("bag").take(x), "p_bag": right.column("bag").take(y), "least": right.column("id").take(y), "cos": pa.array(cos.astype(float))})

    return run


def key_pass(queries: DataFrame, pool: DataFrame, cap: int = 20) -> DataFrame:
    """(s1_id, cand_id) of equal (part, key); keys with more than ``cap`` pool rows are skipped."""
    few = pool.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= cap).select("part", "key")
    p = pool.join(few, ["part", "key"], "left_semi").withColumnRenamed("id", "cand_id")
    return queries.withColumnRenamed("id", "s1_id").join(p, ["part", "key"]).select("s1_id", "cand_id").distinct()


def record_passes(queries: DataFrame, pool: DataFrame, cap: int = 20) -> DataFrame:
    """(s1_id, cand_id, via_addr_key, via_compact, via_empty_addr) of normalised records, by three key passes per country.

    An address key must hold a digit and two blanks on both sides, a query's compact name six characters;
    the name key is tried on pool rows without an address.  Empty keys meet nothing.
    """
    place = F.col("addr_key").rlike("[0-9]") & F.col("addr_key").rlike(" .* ")
    passes = {
        "via_addr_key": ("addr_key", queries.filter(place), pool.filter(place)),
        "via_compact": ("name_compact", queries.filter(F.length("name_compact") >= 6), pool),
        "via_empty_addr": ("name_key", queries, pool.filter("addr_norm = ''")),
    }
    side = lambda d, key: d.filter(F.col(key) != "").select(F.col("country").alias("part"), F.col("entity_id").alias("id"), F.col(key).alias("key"))
    found = [key_pass(side(q, key), side(p, key), cap).select("s1_id", "cand_id", *[F.lit(int(f == flag)).alias(f) for f in passes]) for flag, (key, q, p) in passes.items()]
    return reduce(DataFrame.unionByName, found).groupBy("s1_id", "cand_id").agg(*[F.max(f).alias(f) for f in passes])


def merge_candidates(top: DataFrame, flagged: DataFrame, flags: list[str], k: int = 20) -> DataFrame:
    """Full outer union of ranked pairs and flagged pairs; new pairs get cos 0 and rank k + 1, missing flags 0."""
    f = flagged.groupBy("s1_id", "cand_id").agg(*[F.max(c).alias(c) for c in flags])
    out = top.select("s1_id", "cand_id", "cos", "rank").join(f, ["s1_id", "cand_id"], "full")
    return out.select("s1_id", "cand_id", F.coalesce("cos", F.lit(0.0)).alias("cos"), F.coalesce("rank", F.lit(k + 1)).alias("rank"), *[F.coalesce(c, F.lit(0)).alias(c) for c in flags])


def recall(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """(found, total, recall) of the true pairs."""
    hit = truth.join(pairs.select("s1_id", "cand_id").distinct().withColumn("hit", F.lit(1)), ["s1_id", "cand_id"], "left")
    return hit.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("found"), F.count(F.lit(1)).alias("total")).withColumn("recall", F.round(F.col("found") / F.col("total"), 6))
