"""Operator 8: mixing sources to target weights (DataFrame functions only).

1. Targets.  A source's target is its weight's share of all words, at most ``max_repeat`` times its
   own size; the excess goes to the others by weight until none is above (solved in closed form from
   the sources in the order of ``cap / weight``).
2. Blocks.  A source's documents fall by a keyed hash into ``n`` blocks, and an affine permutation,
   keyed by source, orders the blocks.  Each whole repetition takes all blocks; the last, partial one
   takes the first blocks of the permutation up to the target.  In the one block where the target
   falls, documents are taken in hash order, and of the document where it falls the first words, so
   that a source's taken words are its target rounded down.
3. Splitting tree.  Block draws are exact quotas per source.  A node's quotas are halved by a
   multivariate hypergeometric draw (per source a hypergeometric count given what the sources before
   it took), and so on down to the output shards.  Offsets in the permuted order make the shards'
   draws disjoint.
4. ``mixed`` deals the texts to their shards, once, and puts a shard into a keyed local order.

Sizes: ``n`` grows with the root of the largest source, so that both the blocks of a source and the
documents of one block stay few; the tree's depth grows with the words, ``SHARD_WORDS`` a shard.
What is broadcast is a row per source and block (``UNITS`` at most, as ``n`` falls with the number of
sources) and a row per source.  Reruns agree, since every choice is a keyed hash.

Defined results: null or empty text has size 0 and is never taken.  A null source is a source of its
own, ordered last.  Null ids and repeated rows are separate documents that share a block; of rows equal
in id and text as many are taken as the target asks for.  Empty input gives no rows.  Further columns
are passed through by ``mixed`` and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, cut, small

WEIGHTS = (5.0, 2.0, 1.0)
SHARD_WORDS, UNITS = 1 << 22, 1 << 20


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = 3.0) -> DataFrame:
    """(src, source_size long, target double) from rows (src, size); one row per source."""
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("_k", F.row_number().over(Window.orderBy(F.col("src").isNull(), "src")) - 1)
    per = per.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_k") % len(weights) + 1).cast("int"))).withColumn("_cap", F.col("source_size") * max_repeat)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_k")
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # if just the sources before this one are at their caps, the others share the rest at this rate
    rate = (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    per = per.withColumn("_rate", rate)
    per = per.withColumn("_final", F.min(F.when(F.col("_rate") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), F.col("_k"), F.col("_rate").alias("r")))).over(whole)["r"])
    return per.select("src", "source_size", F.coalesce(F.least(F.col("_cap"), F.col("_final") * F.col("_w")), F.col("_cap")).alias("target"))


def _uniform(*keys) -> Column:
    """A number in (0, 1) that depends on the keys alone."""
    return (F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") + 0.5) / float(1 << 53)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _ln_factorial(n: Column) -> Column:
    """Stirling's series at n + 8, stepped back to n; its error is below 1e-13."""
    z = n.cast("double") + 8.0
    series = z * F.log(z) - z + F.log(z * 6.283185307179586) / 2 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0)))
    return series - F.log((n + 1.0) * (n + 2.0) * (n + 3.0) * (n + 4.0)) - F.log((n + 5.0) * (n + 6.0) * (n + 7.0) * (n + 8.0))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` from ``total`` fall among the ``marked``: the inverse distribution function at ``u``.

    Summed within 12 standard deviations of the mean, outside of which less than 1e-16 lies.
    """
    given = F.struct(total.cast("int").alias("t"), marked.cast("int").alias("m"), drawn.cast("int").alias("d"), u.alias("u"))

    def bounds(g: Column) -> Column:
        share = F.when(g["t"] > 0, g["m"] / g["t"]).otherwise(0.0)
        return F.struct(*[g[c].alias(c) for c in "tmdu"], (g["d"] * share).alias("mean"), (12 * F.sqrt(g["d"] * share * (1 - share)) + 12).alias("far"))

    def ends(g: Column) -> Column:
        lo = F.greatest(F.lit(0), g["d"] + g["m"] - g["t"], F.floor(g["mean"] - g["far"]).cast("int"))
        return F.struct(*[g[c].alias(c) for c in "tmdu"], lo.alias("lo"), F.least(g["d"], g["m"], F.ceil(g["mean"] + g["far"]).cast("int")).alias("hi"))

    def drawn_of(g: Column) -> Column:
        t, m, d, lo, hi = (g[c] for c in ("t", "m", "d", "lo", "hi"))
        # ln of C(m, lo) * C(t - m, d - lo) / C(t, d)
        terms = F.array(m, -lo, -(m - lo), t - m, -(d - lo), -(t - m - d + lo), -t, d, t - d)
        signs = F.array(*[F.lit(x) for x in (1, -1, -1, 1, -1, -1, -1, 1, 1)])
        first = F.aggregate(F.zip_with(F.transform(terms, lambda x: F.abs(x)), signs, lambda x, s: s * _ln_factorial(x)), F.lit(0.0), lambda a, x: a + x)

        def step(s: Column, x: Column) -> Column:
            # P(x) / P(x - 1); a step is a count only while the sum has not reached u
            ln = s["ln"] + F.log((m - x + 1.0) * (d - x + 1.0)) - F.log(x * (t - m - d + x + 0.0))
            return F.struct(ln.alias("ln"), (s["below"] + F.exp(s["ln"])).alias("below"), F.when(s["below"] + F.exp(s["ln"]) < g["u"], x).otherwise(s["x"]).alias("x"))

        start = _let(first, lambda ln: F.struct(ln.alias("ln"), F.lit(0.0).alias("below"), lo.alias("x")))
        return F.aggregate(F.sequence(F.least(lo + 1, hi), hi), start, step, lambda s: s["x"])

    return _let(_let(_let(given, bounds), ends), lambda g: F.when(g["lo"] >= g["hi"], g["lo"]).otherwise(drawn_of(g)))


def splitting_tree(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """(shard long, quotas array) from one row (quotas array<struct<src, q int>>): exact quotas of every shard.

    Each shard follows its own path from the root; nodes on two paths draw the same, keyed numbers.
    """
    shards = quotas.sparkSession.range(0, 1 << depth, 1, min(1 << depth, 256)).select(F.col("id").alias("shard"))

    def down(state: Column, level: Column) -> Column:
        node = F.floor(F.col("shard") / F.pow(F.lit(2.0), depth - level)).cast("long")
        right = F.floor(F.col("shard") / F.pow(F.lit(2.0), depth - level - 1)).cast("long") % 2 == 1
        total = F.aggregate(state, F.lit(0), lambda a, x: a + x["q"])

        def halve(s: Column, x: Column) -> Column:
            got = hypergeometric(s["total"], x["q"], s["drawn"], _uniform(F.lit(seed), level, node, x["src"]))
            return _let(got, lambda g: F.struct((s["total"] - x["q"]).alias("total"), (s["drawn"] - g).alias("drawn"), F.concat(s["kept"], F.array(F.struct(x["src"].alias("src"), F.when(right, x["q"] - g).otherwise(g).alias("q")))).alias("kept")))

        start = _let(total, lambda n: F.struct(n.alias("total"), F.floor(n / 2).cast("int").alias("drawn"), F.filter(state, lambda x: F.lit(False)).alias("kept")))
        return F.aggregate(state, start, halve, lambda s: s["kept"])

    path = F.aggregate(F.sequence(F.lit(0), F.lit(depth - 1)), F.col("quotas"), down) if depth else F.col("quotas")
    return shards.withColumn("quotas", quotas.scalar()).select("shard", path.alias("quotas"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


class Plan:
    """The decisions of a mix: ``sources`` (a row per source) and ``blocks`` (a row per source and block)."""

    def __init__(self, numbers: DataFrame, weights: tuple[float, ...], max_repeat: float, depth: int | None, seed: int):
        """``numbers``: rows (doc_id, src, size, tk), where tk tells texts apart."""
        self.seed = seed
        per = numbers.groupBy("src").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words"))
        most, sources, words = per.agg(F.coalesce(F.max("rows"), F.lit(1)), F.count(F.lit(1)), F.coalesce(F.sum("words"), F.lit(0))).first()
        self.bits = max(0, min(max(6, most.bit_length() // 2 + 2), (UNITS // max(1, sources)).bit_length() - 1))
        self.depth = depth if depth is not None else min(20, max(4, (words // SHARD_WORDS).bit_length()))
        n = 1 << self.bits
        d = numbers.withColumns(self.places("doc_id", "src"))
        sums = cut(d.groupBy("src", "_rank").agg(F.sum("size").alias("words")))
        t = targets(sums.withColumnRenamed("words", "size"), weights, max_repeat)
        whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
        t = t.withColumn("whole", F.least(whole, F.lit(int(max_repeat))).cast("int"))
        t = t.withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")).withColumnRenamed("src", "_s")
        # the block where the rest ends, and the words of it that are still to be taken
        upto = F.sum("words").over(Window.partitionBy("src").orderBy("_rank"))
        per_block = sums.join(small(t), _same("src", "_s")).withColumn("upto", upto)
        edge = F.min(F.when(F.col("upto") > F.col("rest"), F.struct(F.col("_rank").alias("edge"), (F.col("rest") - F.col("upto") + F.col("words")).alias("room")))).alias("e")
        t = per_block.groupBy("_s").agg(*[F.first(c).alias(c) for c in ("source_size", "target", "whole")], edge).select("_s", "source_size", "target", "whole", "e.edge", "e.room")
        t = cut(t)
        # the document where it ends: how many rows like it go whole, and the words taken of the next
        inside = d.join(small(t), _same("src", "_s")).filter((F.col("_rank") == F.col("edge")) & (F.col("size") > 0))
        order = Window.partitionBy("src").orderBy("_at", "tk")
        inside = inside.withColumn("_n", F.row_number().over(order)).withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        first = F.min(F.when(F.col("upto") > F.col("room"), F.struct("_n", "_at", "tk", (F.col("room") - F.col("upto") + F.col("size")).alias("part")))).alias("x")
        # rows equal in id and text stand next to each other
        ends = inside.withColumn("_of", F.min("_n").over(Window.partitionBy("src", "_at", "tk")))
        ends = ends.withColumn("_twins", F.count(F.lit(1)).over(Window.partitionBy("src", "_at", "tk")))
        last = ends.groupBy("_s").agg(first).select(F.col("_s").alias("_e"), "x.*")
        kin = ends.select(F.col("_s").alias("_k"), F.col("_n").alias("_m"), "_of", "_twins")
        last = last.join(kin, _same("_e", "_k") & (F.col("_n") == F.col("_m"))).select("_e", F.col("_at").alias("end_at"), F.col("tk").alias("end_tk"), "part", (F.col("_n") - F.col("_of")).alias("before"), "_twins")
        self.sources = cut(t.join(small(cut(last)), _same("_s", "_e"), "left").drop("_e"))
        self.twins = self.sources.filter("_twins > 1").limit(1).count() > 0
        # block draws: all blocks of the whole repetitions, then those up to the edge
        draws = (F.col("whole") * n + F.when(F.col("room").isNotNull(), F.col("edge") + 1).otherwise(0)).cast("int")
        quotas = self.sources.agg(F.array_sort(F.collect_list(F.struct(F.col("_s").alias("src"), draws.alias("q")))).alias("quotas"))
        tree = splitting_tree(quotas, self.depth, seed).select("shard", F.explode("quotas").alias("x")).select("shard", F.col("x.src").alias("src"), F.col("x.q").alias("q")).filter("q > 0")
        upto = F.sum("q").over(Window.partitionBy("src").orderBy("shard"))
        drawn = tree.withColumn("_to", upto).select("src", "shard", F.explode(F.sequence(F.col("_to") - F.col("q"), F.col("_to") - 1)).alias("place"))
        blocks = drawn.groupBy(F.col("src").alias("_b"), (F.col("place") % n).cast("int").alias("_r")).agg(F.array_sort(F.collect_list(F.struct("place", "shard"))).alias("_draws"))
        self.blocks = cut(blocks.select("_b", "_r", F.transform("_draws", lambda x: x["shard"].cast("int")).alias("shards")))

    def places(self, doc_id: str, src: str) -> dict[str, Column]:
        """A row's block in the permuted order, and its place inside the block."""
        n = 1 << self.bits
        h = F.xxhash64(F.lit(self.seed), doc_id)
        odd = F.xxhash64(F.lit(self.seed + 1), src).bitwiseOR(F.lit(1))
        rank = F.pmod(F.pmod(odd, F.lit(n)) * F.pmod(h, F.lit(n)) + F.pmod(F.xxhash64(F.lit(self.seed + 2), src), F.lit(n)), F.lit(n)).cast("int")
        return {"_rank": rank, "_at": F.xxhash64(F.lit(self.seed + 3), doc_id)}

    def decide(self, d: DataFrame, doc_id: str, src: str, some: Column, tk: Column) -> DataFrame:
        """``d`` with source_size, target, whole (whole copies), part (words of one more) and shards (one per copy).

        ``some``: whether the text has a word; ``tk``: what tells texts apart.
        """
        d = d.withColumns(self.places(doc_id, src)).join(small(self.sources), _same(src, "_s"), "left")
        at_end = (F.col("_rank") == F.col("edge")) & (F.col("_at") == F.col("end_at"))
        d = d.withColumn("_end", F.coalesce(some & at_end & (tk == F.col("end_tk")), F.lit(False)))
        if self.twins:  # of equal rows some are before the end: they are numbered, within one group a source
            w = Window.partitionBy(F.when(F.col("_end"), F.xxhash64(src)).otherwise(F.xxhash64("_at", tk, F.monotonically_increasing_id()))).orderBy("_at")
            d = d.withColumn("_nth", F.row_number().over(w) - 1)
        else:
            d = d.withColumn("_nth", F.lit(0))
        ahead = (F.col("_rank") < F.col("edge")) | ((F.col("_rank") == F.col("edge")) & ((F.col("_at") < F.col("end_at")) | ((F.col("_at") == F.col("end_at")) & (tk < F.col("end_tk")))))
        ahead = F.coalesce(F.when(F.col("_end"), F.col("_nth") < F.col("before")).otherwise(ahead), F.lit(False))
        whole = F.when(some, F.col("whole") + ahead.cast("int")).otherwise(0)
        part = F.when(F.col("_end") & (F.col("_nth") == F.col("before")), F.col("part")).otherwise(0).cast("long")
        d = d.withColumn("_whole", whole.cast("int")).withColumn("_part", part)
        d = d.join(small(self.blocks, UNITS * 2), _same(src, "_b") & (F.col("_rank") == F.col("_r")), "left")
        n = F.col("_whole") + (F.col("_part") > 0).cast("int")
        shards = F.when(n > 0, F.slice("shards", 1, F.greatest(n, F.lit(1)))).otherwise(F.expr("cast(array() as array<int>)"))
        return d.withColumn("_shards", shards)


def _numbers(docs: DataFrame) -> DataFrame:
    """(doc_id, src, size, tk) of every document, kept in the checkpoint folder (numbers only)."""
    return cut(docs.select("doc_id", F.col("source").alias("src"), _size(F.col("text")).alias("size"), F.xxhash64("text").alias("tk")))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = 3.0, depth: int | None = None, seed: int = 8) -> DataFrame:
    """A row for each document: doc_id, src, size, source_size, target, taken, copies, part, shards (one per copy).

    ``copies`` counts the whole copies and, where ``part`` is above 0, one more of the first ``part`` words.
    """
    d = _numbers(docs)
    p = Plan(d, weights, max_repeat, depth, seed)
    out = p.decide(d, "doc_id", "src", F.col("size") > 0, F.col("tk"))
    taken = F.col("_whole") * F.col("size") + F.col("_part")
    return out.select("doc_id", "src", "size", "source_size", "target", taken.cast("long").alias("taken"), F.size("_shards").alias("copies"), F.col("_part").alias("part"), F.col("_shards").alias("shards"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = 3.0, depth: int | None = None, seed: int = 8, length: str | None = None) -> DataFrame:
    """The mixed corpus: every column of ``docs``, a row per copy, dealt to shards and shuffled within each.

    One document a source at most has a copy of its first words; ``length`` names a column that then
    gets that copy's number of characters.
    """
    p = Plan(_numbers(docs), weights, max_repeat, depth, seed)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, names, strict=True))
    d = docs.toDF(*names)
    text = F.col(own["text"])
    d = p.decide(d, own["doc_id"], own["source"], F.coalesce(text.rlike(WORD), F.lit(False)), F.xxhash64(text))
    copy = F.transform("_shards", lambda s, i: F.struct(s.alias("shard"), (i >= F.col("_whole")).alias("cut")))
    d = d.select(*names, "_part", "_at", F.explode(copy).alias("_c")).select(*names, "_part", "_at", "_c.shard", "_c.cut")
    begin = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"{SPACE}*{WORD}"), F.lit(0)), 1, F.greatest(F.col("_part"), F.lit(1)).cast("int")), "")
    d = d.withColumn(own["text"], F.when(F.col("cut"), begin).otherwise(text))
    if length and length in own:
        kind = docs.schema[length].dataType
        d = d.withColumn(own[length], F.when(F.col("cut"), F.char_length(own["text"]).cast(kind)).otherwise(F.col(own[length])))
    d = d.repartitionById(1 << p.depth, F.col("shard")).sortWithinPartitions("shard", F.xxhash64(F.lit(seed + 5), "_at", "shard"))
    return d.select(*[F.col(n).alias(c) for c, n in own.items()])


def query(docs: DataFrame) -> DataFrame:
    """The contract's columns, then copies, part and shards."""
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "part", "shards")
