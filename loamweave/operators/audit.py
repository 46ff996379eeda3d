"""Audits: size against score, predicted scores, differences of normal forms, weighted loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as nm
from . import decide


def size_vs_cutoff(universe: DataFrame, pairs: DataFrame, truth: DataFrame, keeps: list[float], threshold: float) -> DataFrame:
    """(keep, cutoff, candidates_per_entity, macro_f05): what stricter candidate filters cost, at one decision threshold.

    ``pairs``: s1_id, cand_id, p1, prob, label.  A cut-off is the order statistic of the true pairs' p1 at each keep.
    """
    out, entities = None, universe.count()
    for keep in keeps:
        cut = decide.order_cut(pairs, keep, "p1").first()["cutoff"]
        kept = pairs.filter(F.col("p1") >= F.lit(cut))
        counted = decide.counts(universe, kept.filter(F.col("prob") >= threshold), truth)
        row = counted.agg(F.round(F.avg(decide.f05()), 6).alias("macro_f05")).withColumns({"keep": F.lit(keep), "cutoff": F.lit(cut).cast("double")})
        row = row.withColumn("candidates_per_entity", F.round(F.lit(kept.count()) / F.lit(entities), 6)).select("keep", "cutoff", "candidates_per_entity", "macro_f05")
        out = row if out is None else out.unionByName(row)
    return out


def predicted_scores(universe: DataFrame, pairs: DataFrame, truth: DataFrame, policies: dict[str, Column], known: dict[str, float] | None = None) -> DataFrame:
    """(policy, emulated, predicted): expected scores of selections on a corpus where negatives are denser by their weight w.

    ``known``: real scores of two policies, in order; the others are predicted on the line through them.
    """
    nt = truth.groupBy("s1_id").agg(F.count(F.lit(1)).alias("nt"))
    sums = [x for n, p in policies.items() for x in (F.count_if(p & (F.col("label") == 1)).alias(f"tp_{n}"), F.sum(F.when(p, (1 - F.col("label")) * F.col("w")).otherwise(0.0)).alias(f"fp_{n}"))]
    d = universe.select("s1_id").join(nt, "s1_id", "left").join(pairs.groupBy("s1_id").agg(*sums), "s1_id", "left").na.fill(0)
    f = lambda n: F.when(F.col("nt") > 0, 1.25 * F.col(f"tp_{n}") / (0.25 * F.col("nt") + F.col(f"tp_{n}") + F.col(f"fp_{n}"))).otherwise(F.exp(-F.col(f"fp_{n}")))
    e = d.agg(*[F.avg(f(n)).alias(n) for n in policies])
    predicted = lambda n: F.lit(None).cast("double")
    if known:
        (a, x), (b, y) = known.items()
        predicted = lambda n: F.lit(y) + (F.col(n) - F.col(b)) * F.lit(y - x) / (F.col(b) - F.col(a))
    each = F.array(*[F.struct(F.lit(n).alias("policy"), F.round(n, 6).alias("emulated"), F.round(predicted(n), 6).alias("predicted")) for n in policies])
    return e.select(F.explode(each).alias("x")).select("x.*")


def word_differences(joined: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(field, side, word, n): words that one record of true pairs has and the other lacks ('extra' in the candidate, 'missing' from it)."""
    parts = None
    for name, f in fields.items():
        a, b = nm.words(F.col(f"q_{f}")), nm.words(F.col(f"c_{f}"))
        for side, diff in (("extra", F.array_except(b, a)), ("missing", F.array_except(a, b))):
            d = joined.select(F.lit(name).alias("field"), F.lit(side).alias("side"), F.explode(F.array_distinct(diff)).alias("word"))
            parts = d if parts is None else parts.unionByName(d)
    return parts.groupBy("field", "side", "word").agg(F.count(F.lit(1)).alias("n"))


def agreement(joined: DataFrame) -> DataFrame:
    """Shares of true pairs per country whose core and compact names agree, whose numbers conflict or are missing."""
    q, c = nm.words(F.col("q_addr_nums")), nm.words(F.col("c_addr_nums"))
    share = lambda x: F.round(F.avg(x.cast("int")), 6)
    return joined.groupBy("country").agg(
        F.count(F.lit(1)).alias("pairs"), share(F.col("q_name_key") == F.col("c_name_key")).alias("key_equal"), share(F.col("q_name_compact") == F.col("c_name_compact")).alias("compact_equal"),
        share((F.size(q) > 0) & (F.size(c) > 0) & ~F.arrays_overlap(q, c)).alias("nums_conflict"), share(F.size(c) == 0).alias("no_nums"),
    )


def before_after(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """(field, records, changed, shorter, median_words, p90_words) of two versions of normalised records (entity_id, fields)."""
    j = before.select("entity_id", *[F.col(f).alias(f"b_{f}") for f in fields]).join(after.select("entity_id", *fields), "entity_id")
    words = lambda x: F.size(nm.words(F.col(x)))
    each = F.array(*[F.struct(F.lit(f).alias("field"), (~F.col(f"b_{f}").eqNullSafe(F.col(f))).alias("changed"), (words(f) < words(f"b_{f}")).alias("shorter"), words(f).alias("n")) for f in fields])
    d = j.select(F.explode(each).alias("x")).select("x.*")
    return d.groupBy("field").agg(F.count(F.lit(1)).alias("records"), F.count_if("changed").alias("changed"), F.count_if("shorter").alias("shorter"), F.percentile("n", 0.5).alias("median_words"), F.percentile("n", 0.9).alias("p90_words"))


def weighted_log_loss(d: DataFrame, scores: list[str], weight: str = "w") -> DataFrame:
    """(score, log_loss): weighted averages over the rows with label and weight, scores clipped to 1e-6 from 0 and 1."""
    def loss(c: str) -> Column:
        p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(c)))
        return -(F.col("label") * F.log(p) + (1 - F.col("label")) * F.log(1 - p))

    each = F.array(*[F.struct(F.lit(c).alias("score"), F.round(F.sum(F.col(weight) * loss(c)) / F.sum(weight), 6).alias("log_loss")) for c in scores])
    return d.agg(each.alias("x")).select(F.explode("x").alias("x")).select("x.*")
