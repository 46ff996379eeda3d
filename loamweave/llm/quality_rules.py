"""Operator 10: quality rules with risk-controlled thresholds (DataFrame functions only).

Each rule is one per-document measure with a cut-off per stratum (language).  A rule rejects a
document whose measure exceeds the cut-off.  What is controlled is the rules' joint false rejection
in each stratum: the share of the good documents passing the base rules that any cut-off rejects.

1. Labelled documents are split by a hash of their id.  The design third orders the pairs (rule,
   cut-off) of a stratum: those that reject more bad than good documents, the purest first.  The
   first k pairs together are step k; steps are nested, so their rejections grow with k.
2. On the holdout, the other two thirds, a step that rejects r of the stratum's n good documents has
   the p-value P(Bin(n, alpha) <= r) of "it falsely rejects at least alpha of them".  Steps are
   tested in their order and the tests stop at the first that fails (fixed-sequence testing, which
   costs no level); the level is shared between the strata (Bonferroni).  So with probability
   ``1 - delta`` all strata's chosen steps keep their joint false rejection below ``alpha``.
3. Among the certified steps the one is taken that rejects most bad minus good documents of the
   holdout, the first on ties.  A stratum without enough labels has no cut-offs.

Defined results: null or empty text: no words, all measures 0, base_failed.  Null language: a stratum
of its own.  Null or repeated doc_id: each row is judged by itself; labels join on equal ids only, and
a label given repeatedly for an id counts once.  Further input columns are passed through by
``apply`` and never read; its own columns carry a prefix that can be chosen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, cut, small

#: Rule name -> cut-offs, loosest first.  A document is rejected where its measure is above.
GRID = {
    "symbols": [4.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2],
    "marks": [4.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2],
    "capitals": [0.99, 0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4],
    "repeats": [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15],
    "dup_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
    "long_words": [60.0, 40.0, 30.0, 20.0, 15.0, 12.0],
}
ALPHA, DELTA, DESIGN = 0.05, 0.05, 3


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words in 3-word windows that the text has twice or more, from hashes of the windows."""

    def covered(at: Column) -> Column:
        """Words under windows that begin at the sorted places ``at``."""
        n = F.size(at)
        step = F.transform(at, lambda p, i: F.when(i + 1 < n, F.least(F.lit(3), F.get(at, i + 1) - p)).otherwise(3))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def places(windows: Column) -> Column:
        ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(r: Column) -> Column:
            same = lambda i, h: F.coalesce(F.get(r, i)["h"] == h, F.lit(False))
            return F.array_sort(F.transform(F.filter(r, lambda x, i: same(i - 1, x["h"]) | same(i + 1, x["h"])), lambda x: x["i"]))

        return _let(_let(ranked, twins), covered)

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    found = _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(places(w)))
    return F.when(F.size(words) < 6, _small_repeats(words)).otherwise(found).cast("long")


def _small_repeats(words: Column) -> Column:
    """The same for 4 or 5 words, where the two or three windows can be compared by hand."""
    w = [F.concat_ws(" ", F.slice(words, i, 3)) for i in (1, 2, 3)]
    n = F.size(words)
    return (
        F.when(n < 4, 0)
        .when((n == 5) & (w[0] == w[1]) & (w[1] == w[2]), 5)
        .when(w[0] == w[1], 4)
        .when((n == 5) & (w[1] == w[2]), 4)
        .when((n == 5) & (w[0] == w[2]), 5)
        .otherwise(0)
    )


def measures(docs: DataFrame, text: str = "text", prefix: str = "_q_") -> DataFrame:
    """Add ``<prefix>base`` (struct of the base counts) and ``<prefix>m`` (struct of the rules' measures)."""
    b, m, w, t = f"{prefix}base", f"{prefix}m", f"{prefix}words", f"{prefix}text"
    docs = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    docs = docs.withColumn(w, F.filter(F.split(t, f"{SPACE}+"), lambda x: x != ""))
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(WORD))
    # explode keeps the optimiser from writing the counts' expressions into each place that reads them
    counts = F.explode(F.array(
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("lines"),
            _repeated(F.col(w)).alias("n_repeat_words"),
            F.regexp_count(t, F.lit(r"\p{Lu}")).alias("capitals"),
            F.regexp_count(t, F.lit("[!?]")).alias("marks"),
        )
    ))
    docs = docs.withColumn(b, counts).drop(w)
    c = lambda x: F.col(f"{b}.{x}")
    per = lambda x, n: F.when(n > 0, x / n).otherwise(0.0)
    return docs.withColumn(
        m,
        F.struct(
            per(c("n_symbols"), c("n_words")).alias("symbols"),
            per(c("marks"), c("n_words")).alias("marks"),
            per(c("capitals"), c("word_chars")).alias("capitals"),
            per(c("n_repeat_words"), c("n_words")).alias("repeats"),
            per(c("lines.n") - c("lines.d"), c("lines.n")).alias("dup_lines"),
            per(c("word_chars"), c("n_words")).alias("long_words"),
        ),
    ).drop(t)


def base_failed(base: Column) -> Column:
    return (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])


def log_binomial_tail(n: Column, k: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k), exact up to rounding; summed in logarithms so that large n cannot underflow."""
    odds = math.log(p / (1 - p))
    first = n * math.log(1 - p)

    def add(state: Column, i: Column) -> Column:
        term = state["t"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(state["s"], term)
        return F.struct(term.alias("t"), (top + F.log1p(F.exp(-F.abs(state["s"] - term)))).alias("s"))

    zero = F.struct(first.alias("t"), first.alias("s"))
    return F.when(k <= 0, first).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), zero, add, lambda s: s["s"]))


def _design(doc_id: Column) -> Column:
    """True for the rows that design the steps (one in ``DESIGN``)."""
    return F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % DESIGN == 0


def thresholds(measured: DataFrame, labels: DataFrame, grid: dict[str, list[float]] = GRID, alpha: float = ALPHA, delta: float = DELTA, label: str = "quality") -> DataFrame:
    """Certified cut-offs: (stratum string, one nullable double column per rule).

    ``measured``: rows with doc_id, stratum, failed (by the base rules) and a struct ``m`` holding the
    rules' measures.  Rows are counted in two pre-aggregated passes over the labelled ones; all else
    has a row per stratum, rule and cut-off.
    """
    y = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).filter(F.col("_y").isin(0, 1)).groupBy("_id").agg(F.max("_y").alias("_y"))
    held = cut(measured.filter("not failed").join(y, measured["doc_id"] == y["_id"]).select("stratum", "_y", "m", _design(F.col("doc_id")).alias("design")))
    strata = held.select("stratum").distinct().count()
    if not strata:
        return held.sparkSession.createDataFrame([], "stratum string, " + ", ".join(f"{r} double" for r in grid))
    pairs = [(i, r, j, c) for i, (r, cs) in enumerate(grid.items()) for j, c in enumerate(cs)]
    counts = [F.count_if((F.col(f"m.{r}") > c) & (F.col("_y") == v)).alias(f"{r}_{j}_{v}") for _, r, j, c in pairs for v in (0, 1)]
    each = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(j).alias("j"), F.lit(c).alias("cutoff"), F.col(f"{r}_{j}_1").alias("good"), F.col(f"{r}_{j}_0").alias("bad")) for i, r, j, c in pairs])
    step = Window.partitionBy("stratum").orderBy(F.col("good") / (F.col("good") + F.col("bad")), F.desc("bad"), "rule", "j")
    ordered = held.filter("design").groupBy("stratum").agg(*counts).select("stratum", F.explode(each).alias("t")).select("stratum", "t.*").filter("bad > good").withColumn("k", F.row_number().over(step))
    path = cut(ordered.groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("k", "rule", "cutoff"))).alias("path")))
    # the step at which each holdout row is rejected, if any
    values = F.array(*[F.col(f"m.{r}") for r in grid])
    first = F.array_min(F.transform(F.filter("path", lambda x: F.get(values, x["rule"]) > x["cutoff"]), lambda x: x["k"]))
    tested = held.filter("not design").join(small(path), "stratum").groupBy("stratum", first.alias("k")).agg(F.count_if(F.col("_y") == 1).alias("good"), F.count_if(F.col("_y") == 0).alias("bad"))
    upto = Window.partitionBy("stratum").orderBy(F.col("k").asc_nulls_last())
    tested = tested.select("stratum", "k", F.sum("good").over(upto).alias("good"), F.sum("bad").over(upto).alias("bad"), F.sum("good").over(Window.partitionBy("stratum")).alias("n")).filter("k is not null")
    # a count of alpha * n or more cannot be certified, so no tail of more terms is summed
    passes = F.when(F.col("good") >= alpha * F.col("n"), False).otherwise(log_binomial_tail(F.col("n"), F.col("good"), alpha) <= math.log(delta / strata))
    sure = tested.withColumn("ok", F.min(passes.cast("int")).over(upto)).filter((F.col("ok") == 1) & (F.col("bad") > F.col("good")))
    best = sure.groupBy("stratum").agg(F.max_by("k", F.struct(F.col("bad") - F.col("good"), -F.col("k"))).alias("last"))
    taken = path.join(best, "stratum").withColumn("path", F.filter("path", lambda x: x["k"] <= F.col("last")))
    strictest = lambda i: F.array_min(F.transform(F.filter("path", lambda x: x["rule"] == i), lambda x: x["cutoff"]))
    return taken.select("stratum", *[strictest(i).alias(r) for i, r in enumerate(grid)])


def stratum(lang: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), lang), F.lit("null"))


def verdict(measure: Column, cutoffs: Column, grid: dict[str, list[float]] = GRID) -> Column:
    """True where no rule rejects; a missing cut-off rejects nothing."""
    out = F.lit(True)
    for r in grid:
        out = out & ~F.coalesce(measure[r] > cutoffs[r], F.lit(False))
    return out


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """The cut-offs.  All documents are measured where they stand, which shuffles numbers only."""
    m = measures(docs.select("doc_id", F.col(text).alias("text"), stratum(F.col(lang)).alias("stratum")))
    return thresholds(m.select("doc_id", "stratum", base_failed(F.col("_q_base")).alias("failed"), F.col("_q_m").alias("m")), labels, **options)


def apply(docs: DataFrame, cutoffs: DataFrame, lang: str = "lang", text: str = "text", prefix: str = "_q_") -> DataFrame:
    """``docs`` with <prefix>base, <prefix>m and <prefix>kept; the texts are not shuffled."""
    cuts = cutoffs.select(F.col("stratum").alias(f"{prefix}s"), F.struct(*[F.col(r) for r in GRID]).alias(f"{prefix}c"))
    d = measures(docs, text, prefix).withColumn(f"{prefix}k", stratum(F.col(lang)))
    d = d.join(small(cuts), F.col(f"{prefix}k") == F.col(f"{prefix}s"), "left")
    kept = ~base_failed(F.col(f"{prefix}base")) & verdict(F.col(f"{prefix}m"), F.col(f"{prefix}c"))
    return d.withColumn(f"{prefix}kept", kept).drop(f"{prefix}s", f"{prefix}c", f"{prefix}k")


def assess(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for every document.

    Measures are made once for all documents and kept in the checkpoint folder (numbers only), then
    used both for the cut-offs and for the verdicts.
    """
    m = measures(docs.select("doc_id", "text", stratum(F.col("lang")).alias("stratum")))
    m = cut(m.select("doc_id", "stratum", F.col("_q_base").alias("base"), F.col("_q_m").alias("m")))
    cuts = cut(thresholds(m.select("doc_id", "stratum", base_failed(F.col("base")).alias("failed"), "m"), labels, **options))
    c = cuts.select(F.col("stratum").alias("_s"), F.struct(*[F.col(r) for r in GRID]).alias("_c"))
    out = m.join(small(c), F.col("stratum") == F.col("_s"), "left")
    b = F.col("base")
    return out.select(
        "doc_id", b["n_words"].alias("n_words"), b["word_chars"].alias("word_chars"), b["n_symbols"].alias("n_symbols"),
        (b["lines"]["n"] - b["lines"]["d"]).cast("long").alias("n_dup_lines"), b["n_repeat_words"].alias("n_repeat_words"),
        base_failed(b).alias("base_failed"), (~base_failed(b) & verdict(F.col("m"), F.col("_c"))).alias("kept"),
    )
