"""Operator 5: nearest neighbours by additive quantisation.

1. ``BOOKS`` codebooks of full-dimensional codewords are fitted to a bounded sample, each to the
   residuals of those before it (k-means, then the next).
2. Every vector is encoded by beam search over the books: the ``beam`` best partial sums are kept
   from book to book.  Codeword inner products are tabulated, so a step only adds table entries.
   The factor that brings the reconstruction nearest to the vector is stored, and the length of what
   is then left, which bounds the error of every inner product with the code (Cauchy and Schwarz).
3. A coarse cell is the nearest centre of a separate k-means book of about ``CELLS * sqrt(n)`` centres,
   so cells stay small as the data grow.  Cells are packed into blocks of about ``block`` rows, a
   hot cell is split over several; a query goes once to each block that holds a cell it visits.
4. First pass: a query visits the share ``probe`` of all cells (``LEAST`` at least) with the largest inner
   products.  In a block, lookup tables give approximate inner products (times the factor) of a query with
   the rows of its cells; the ``rerank`` best of them (ties by smaller id) are scored exactly in double
   precision.  The ``k``-th best score of all blocks is one that the ``k`` nearest reach.
5. Second pass: a query visits the cells whose bound reaches that score (inner product with the centre
   plus the cell's radius, or the cell's longest vector), and of their rows scores exactly those whose
   codes' bound reaches it.  These scores are ranked.

No row that belongs to the ``k`` nearest is passed over, however the vectors lie: ``probe`` and ``rerank``
set only how good the first score is, cells and codes how few rows are scored exactly.  Where vectors fill
all directions alike and neighbours are hardly nearer than the rest, that is a good part of them.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do those of another length than the most frequent one (no inner product with them exists).
A query's own row is left out, and so are rows that repeat its id.  Queries that repeat an id with
another vector have a ranking each; rows equal in id and vector are one query.  Null ids take no part.  Ties go to smaller
vec_id.  Empty input gives no rows.  Further columns are ignored.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, shared

BOOKS, WORDS, BEAM, SAMPLE, CELLS, LEAST = 16, 256, 4, 16384, 4.5, 48
SLACK = 1e-9  # of the lengths, for the rounding of bounds in double precision


def kmeans(x: np.ndarray, k: int, rng, steps: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        near = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        order = np.argsort(near, kind="stable")
        full, begin = np.unique(near[order], return_index=True)
        c[full] = np.add.reduceat(x[order], begin, axis=0) / np.diff(np.append(begin, len(x)))[:, None]
    return c


class Index:
    """Codebooks (books, words, dim), the table of their inner products, and the coarse centres."""

    def __init__(self, sample: np.ndarray, cells: int, books: int = BOOKS, words: int = WORDS, beam: int = BEAM, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.beam, self.dim = beam, sample.shape[1]
        self.cells = kmeans(sample, cells, rng)
        rest, out = sample.copy(), []
        for _ in range(books):
            c = kmeans(rest, words, rng)
            rest = rest - c[(rest @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)]
            out.append(np.concatenate([c, np.zeros((words - len(c), self.dim), np.float32)]))
        self.codes = np.stack(out).astype(np.float32)

    @cached_property
    def gram(self) -> np.ndarray:
        flat = self.codes.reshape(-1, self.dim)
        return (flat @ flat.T).astype(np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "gram"}  # its 67 MB are computed where they are needed

    def assign(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.cells.T - 0.5 * (self.cells * self.cells).sum(axis=1)).argmax(axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes (n, books) by beam search for the least squared error, factors, and lengths of what is left, rounding included."""
        books, words, _ = self.codes.shape
        longest = np.sqrt((self.codes.astype(np.float64) ** 2).sum(axis=2)).max(axis=1).sum()
        all_codes, all_ratio, all_rest = np.empty((len(x), books), np.uint8), np.empty(len(x)), np.empty(len(x))
        for at in range(0, len(x), 256):
            true = x[at : at + 256].astype(np.float64)
            part = true.astype(np.float32)
            n = len(part)
            dots = (part @ self.codes.reshape(-1, self.dim).T).reshape(n, books, words)
            codes, cost = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32)
            for m in range(books):
                own = self.gram.reshape(books, words, books, words)[m, np.arange(words), m, np.arange(words)]
                step = (own - 2 * dots[:, m])[:, None, :] + np.zeros((1, codes.shape[1], 1), np.float32)
                for b in range(m):
                    step += 2 * self.gram[b * words + codes[:, :, b], m * words : (m + 1) * words]
                total = (cost[:, :, None] + step).reshape(n, -1)
                keep = min(self.beam, total.shape[1])
                best = np.argpartition(total, keep - 1, axis=1)[:, :keep] if keep < total.shape[1] else np.tile(np.arange(keep), (n, 1))
                cost = np.take_along_axis(total, best, 1)
                codes = np.concatenate([np.take_along_axis(codes, (best // words)[:, :, None], 1), (best % words)[:, :, None]], axis=2)
            win = codes[np.arange(n), cost.argmin(axis=1)]
            made = self.codes[np.arange(books), win].astype(np.float64).sum(axis=1)
            ratio = (true * made).sum(axis=1) / np.maximum((made**2).sum(axis=1), 1e-30)
            all_codes[at : at + n] = win
            all_ratio[at : at + n] = ratio
            all_rest[at : at + n] = _length(true - ratio[:, None] * made) + SLACK * (_length(true) + np.abs(ratio) * longest)
        return all_codes, all_ratio, all_rest


def _valid(embeddings: DataFrame) -> DataFrame:
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return e.filter((F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0))


def _length(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=-1))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def search(embeddings: DataFrame, every: int = 20, k: int = 20, rerank: int = 128, probe: float = 0.5, block: int = 8192, query_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest by inner product (``rerank`` >= ``k``)."""
    spark = embeddings.sparkSession
    empty = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    e = _valid(embeddings)
    dims = e.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("v", F.abs))).cast("double").alias("most")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return spark.createDataFrame([], empty)
    e = e.filter(F.size("v") == dims["d"])
    unit = 2.0 ** int(np.frexp(dims["most"])[1] - 1)  # index and bounds are in this unit, so that single precision holds them
    rows = e.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(SAMPLE).select("v").toArrow()  # SAMPLE vectors at most
    sample = (_matrix(rows.column("v").combine_chunks()) / unit).astype(np.float32)
    index = Index(sample, max(1, min(int(CELLS * dims["n"] ** 0.5), len(sample) // 8)))
    visited = max(min(LEAST, len(index.cells)), int(np.ceil(probe * len(index.cells))))
    held = shared(e, index)

    def encode(batches):
        ix = held.value
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v")) / unit
                x = x.astype(np.float64)
                codes, ratio, rest = ix.encode(x)
                cell = ix.assign(x.astype(np.float32))
                centre, norm = ix.cells[cell].astype(np.float64), _length(x)
                away = _length(x - centre) + SLACK * (norm + _length(centre))
                yield pa.record_batch(
                    [b.column("vec_id"), pa.array(cell.astype(np.int32)), pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(x), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary()), pa.array(ratio), pa.array(rest), pa.array(away), pa.array(norm * (1 + SLACK)), b.column("v")],
                    names=["vec_id", "cell", "codes", "ratio", "rest", "away", "norm", "v"],
                )

    typ = e.schema["v"].dataType.elementType.simpleString()
    coded = cut(e.mapInArrow(encode, f"vec_id long, cell int, codes binary, ratio double, rest double, away double, norm double, v array<{typ}>"))
    # blocks of cells: a row per cell comes to the driver
    sizes = {r["cell"]: r for r in coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away"), F.max("norm").alias("norm")).collect()}
    first, parts, at, filled = np.zeros(len(index.cells), np.int32), np.ones(len(index.cells), np.int32), 0, 0
    away, norm = np.full((2, len(index.cells)), -np.inf)
    for c in range(len(index.cells)):
        n = sizes[c]["n"] if c in sizes else 0
        if n:
            away[c], norm[c] = sizes[c]["away"], sizes[c]["norm"]
        if filled and filled + n > block:
            at, filled = at + 1, 0
        first[c], parts[c], filled = at, max(1, -(-n // block)), filled + n
        if parts[c] > 1:
            at, filled = at + int(parts[c]), 0
    packing = shared(e, (first, parts, away, norm))
    table = spark.createDataFrame([(c, int(first[c]), int(parts[c])) for c in sizes], "cell int, first int, parts int")
    coded = coded.drop("away", "norm").join(F.broadcast(table), "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))

    def visits(ix, x, least):
        """Which cells each query visits: some of the best, or (``least``: the score to reach) all whose bound reaches it."""
        near = x @ ix.cells.astype(np.float64).T
        if least is not None:
            away, norm = packing.value[2:]
            size = _length(x)[:, None]
            return np.minimum(near + size * away, size * norm) >= least[:, None]
        best = np.argsort(-near, axis=1, kind="stable")[:, :visited]
        out = np.zeros(near.shape, bool)
        out[np.arange(len(x))[:, None], best] = True
        return out

    queries = e.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).dropDuplicates().withColumn("qk", F.xxhash64("q"))
    n_queries = queries.count()
    chunks = max(1, -(-n_queries // query_block))
    # a block meets every chunk of the queries
    left = coded.select("block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "vec_id", "cell", "codes", "ratio", "rest", "v")

    def scored(queries: DataFrame, last: bool) -> DataFrame:
        """(query_id, qk, vec_id, score) of rows scored exactly: the best codes of some cells, or (``last``) all whose bound reaches ``least``."""

        def visit(batches):
            (first, parts, _, _), ix = packing.value, held.value
            for b in batches:
                if b.num_rows:
                    x = (_matrix(b.column("q")) / unit).astype(np.float64)
                    seen = visits(ix, x, b.column("least").to_numpy(zero_copy_only=False) if last else None)
                    none = [np.zeros(0, np.int64)]
                    lists = [np.unique(np.concatenate(none + [first[c] + np.arange(parts[c]) for c in np.flatnonzero(row)])) for row in seen]
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                    yield pa.record_batch([*(b.column(c) for c in ("query_id", "qk", "q", "least")), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists).astype(np.int32)))], names=["query_id", "qk", "q", "least", "blocks"])

        def score(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            out = {"query_id": [], "qk": [], "vec_id": [], "score": []}
            if len(c) and len(q):
                ix = held.value
                c = c.sort_values(["cell", "vec_id"], kind="stable")
                ids, v, cell = c["vec_id"].to_numpy(), np.stack(c["v"].to_numpy()).astype(np.float64), c["cell"].to_numpy()
                codes = np.frombuffer(b"".join(c["codes"]), np.uint8).reshape(len(c), -1).astype(np.int64) + np.arange(ix.codes.shape[0]) * ix.codes.shape[1]
                ratio, rest = c["ratio"].to_numpy(), c["rest"].to_numpy()
                edges = np.flatnonzero(np.diff(cell, prepend=-1, append=-1))
                words = ix.codes.reshape(-1, ix.dim).T.astype(np.float64)
                for at in range(0, len(q), 256):
                    some_q = q.iloc[at : at + 256]
                    z = np.stack(some_q["q"].to_numpy()).astype(np.float64)
                    x = (np.stack(some_q["q"].to_numpy()) / unit).astype(np.float64)
                    size, least = _length(x), some_q["least"].to_numpy()
                    tables = x @ words
                    seen = visits(ix, x, least if last else None)
                    near = np.full((len(x), len(ids)), -np.inf)
                    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                        who = np.flatnonzero(seen[:, cell[i]])
                        if len(who):
                            t = tables[who]
                            near[who, i:j] = sum(t[:, codes[i:j, m]] for m in range(codes.shape[1])) * ratio[i:j]
                    for row, (qid, qk) in enumerate(zip(some_q["query_id"].to_numpy(), some_q["qk"].to_numpy(), strict=True)):
                        near[row, ids == qid] = -np.inf  # the query's own row
                        own = near[row]
                        if last:
                            pick = np.flatnonzero((own > -np.inf) & (own + size[row] * rest >= least[row]))
                        else:
                            pick = np.flatnonzero(own > -np.inf)
                            if len(pick) > rerank:
                                own = own[pick]
                                edge = np.partition(own, len(own) - rerank)[len(own) - rerank]
                                sure, ties = pick[own > edge], pick[own == edge]
                                ties = ties[np.argsort(ids[ties], kind="stable")]
                                pick = np.concatenate([sure, ties[: rerank - len(sure)]])
                        if not len(pick):
                            continue
                        # row by row, so that equal vectors score equally; few at a time, which stay in the processor's cache
                        exact = np.concatenate([(v[pick[i : i + 256]] * z[row]).sum(axis=1) for i in range(0, len(pick), 256)])
                        top = np.lexsort((ids[pick], -exact))[:k]
                        out["query_id"].append(np.full(len(top), qid))
                        out["qk"].append(np.full(len(top), qk))
                        out["vec_id"].append(ids[pick][top])
                        out["score"].append(exact[top])
            return pd.DataFrame({n: np.concatenate(x) if x else np.zeros(0, float if n == "score" else np.int64) for n, x in out.items()})

        to = queries.mapInArrow(visit, f"query_id long, qk long, q array<{typ}>, least double, blocks array<int>").withColumn("chunk", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(chunks)).cast("int"))
        to = to.select("query_id", "qk", "q", "least", F.col("chunk").alias("_chunk"), F.explode("blocks").alias("_block"))
        return left.groupBy("block", "chunk").cogroup(to.groupBy("_block", "_chunk")).applyInPandas(score, "query_id long, qk long, vec_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id", "qk").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    lowest = F.lit(float("-inf"))
    reached = ranked(scored(queries.withColumn("least", lowest), False)).filter((F.col("rank") == k) & (F.abs("score") < float("inf")))
    reached = cut(reached.select("query_id", "qk", (F.col("score") / unit / unit).alias("least")))
    queries = queries.join(reached, ["query_id", "qk"], "left").withColumn("least", F.coalesce("least", lowest))
    return ranked(scored(queries, True)).select("query_id", "rank", "vec_id", "score")


def query(embeddings: DataFrame) -> DataFrame:
    return search(embeddings)
