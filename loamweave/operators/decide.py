"""Decisions on scored pairs (s1_id, cand_id, country, prob ...), and their evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def competition(pairs: DataFrame) -> DataFrame:
    """Features of a pair among its entity's and its candidate's pairs, over the whole table."""
    s, c = Window.partitionBy("s1_id"), Window.partitionBy("cand_id")
    best, top = F.max("prob").over(s), F.max("prob").over(c)
    return pairs.select(
        "s1_id", "cand_id", (best - F.col("prob")).alias("gap"), F.when(best > 0, F.col("prob") / best).otherwise(0.0).alias("part_of_best"),
        F.count(F.lit(1)).over(s).alias("n_cands"), F.count(F.lit(1)).over(c).alias("cand_n_lists"), (F.col("prob") - top).alias("minus_cand_best"), (F.col("prob") == top).alias("is_cand_best"),
    )


def one_owner(pairs: DataFrame) -> DataFrame:
    """Pairs whose score is their candidate's best; ties all stay."""
    return pairs.withColumn("_b", F.max("prob").over(Window.partitionBy("cand_id"))).filter(F.col("prob") == F.col("_b")).drop("_b")


def rivals(pairs: DataFrame) -> DataFrame:
    """Rank among the rivals for a candidate (ties alike), and the margin to the best other one (-100: no other)."""
    w = Window.partitionBy("cand_id")
    order = w.orderBy(F.desc("prob"), "s1_id")
    r = pairs.withColumn("_n", F.row_number().over(order)).withColumn("_1", F.max("prob").over(w)).withColumn("_2", F.max(F.when(F.col("_n") == 2, F.col("prob"))).over(w))
    other = F.when(F.col("_n") == 1, F.coalesce("_2", F.lit(-100.0))).otherwise(F.col("_1"))
    return r.select("s1_id", "cand_id", F.count(F.lit(1)).over(w).alias("n_rivals"), F.rank().over(w.orderBy(F.desc("prob"))).alias("rival_rank"), F.round(F.col("prob") - other, 6).alias("margin"))


def context(pairs: DataFrame, high: float = 0.9, low: float = 0.3) -> DataFrame:
    """What an entity's other pairs say: rank, number of high pairs, high and low pairs of the same kind (itself left out)."""
    s, k = Window.partitionBy("s1_id"), Window.partitionBy("s1_id", "nk")
    hi, lo = (F.col("prob") >= high).cast("int"), (F.col("prob") < low).cast("int")
    return pairs.select(
        "s1_id", "cand_id", F.row_number().over(s.orderBy(F.desc("prob"), "cand_id")).alias("prob_rank"), F.sum(hi).over(s).alias("n_hi"),
        (F.sum(hi).over(k) - hi).alias("same_hi"), (F.sum(lo).over(k) - lo).alias("same_lo"), F.round(F.max("prob").over(s) - F.col("prob"), 6).alias("gap_top"),
    )


def consensus(pairs: DataFrame, value: str = "nc") -> DataFrame:
    """The most frequent value of each entity's pairs; ties go to the smaller value."""
    n = pairs.groupBy("s1_id", value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("s1_id").orderBy(F.desc("n"), value)
    return n.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("s1_id", F.col(value).alias("consensus"), "n")


def expected_select(pairs: DataFrame, floor: float = 0.5, weight: float = 1.0) -> DataFrame:
    """Per entity the smallest k whose expected F0.5 is best; kept above ``floor`` and where it beats an empty answer."""
    s = Window.partitionBy("s1_id")
    order = s.orderBy(F.desc("prob"), "cand_id")
    d = pairs.withColumn("k", F.row_number().over(order)).withColumn("cum", F.sum("prob").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("ef", F.round(1.25 * F.col("cum") / (0.25 * F.sum("prob").over(s) + F.col("k")), 9)).withColumn("none", F.exp(F.sum(F.log(1 - F.least("prob", F.lit(0.999999)))).over(s)))
    d = d.withColumn("best", F.max("ef").over(s)).withColumn("at", F.min(F.when(F.col("ef") == F.col("best"), F.col("k"))).over(s))
    return d.filter((F.col("k") <= F.col("at")) & (F.col("prob") >= floor) & (F.col("best") > weight * F.col("none"))).select("s1_id", "cand_id", "prob")


def counts(universe: DataFrame, selected: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1_id, country, tp, np, nt) for every entity of the universe."""
    both = selected.select("s1_id", "cand_id").distinct().withColumn("p", F.lit(1)).join(truth.select("s1_id", "cand_id").distinct().withColumn("t", F.lit(1)), ["s1_id", "cand_id"], "full")
    per = both.groupBy("s1_id").agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count("p").alias("np"), F.count("t").alias("nt"))
    return universe.join(per, "s1_id", "left").na.fill(0, ["tp", "np", "nt"])


def f05() -> Column:
    """Of tp, np, nt: both empty is 1, one empty 0."""
    return F.when((F.col("np") == 0) & (F.col("nt") == 0), 1.0).when(F.col("tp") == 0, 0.0).otherwise(1.25 * F.col("tp") / (0.25 * F.col("nt") + F.col("np")))


def report(counted: DataFrame) -> DataFrame:
    """Macro F0.5, pair precision and recall and the score of entities without matches, per country and overall (null)."""
    d = counted.withColumn("f", f05())
    ratio = lambda a, b: F.round(F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)).otherwise(0.0), 6)
    return d.rollup("country").agg(F.round(F.avg("f"), 6).alias("macro_f05"), ratio("tp", "np").alias("pair_p"), ratio("tp", "nt").alias("pair_r"), F.round(F.avg(F.when(F.col("nt") == 0, F.col("f"))), 6).alias("singletons"), F.count(F.lit(1)).alias("entities"))


def size_vs_score(counted: DataFrame) -> DataFrame:
    """Mean F0.5 by the number of true matches."""
    return counted.groupBy("nt").agg(F.round(F.avg(f05()), 6).alias("f05"), F.count(F.lit(1)).alias("entities"))


def tune(universe: DataFrame, pairs: DataFrame, truth: DataFrame, grid: list[float]) -> DataFrame:
    """(threshold, macro_f05) over a grid, in one aggregation; the first of the best is the choice.

    Per entity and threshold the counts are cumulative from the highest threshold down, so pairs are
    read once and expanded only to (entity, threshold).
    """
    lab = pairs.join(truth.select("s1_id", "cand_id").distinct().withColumn("t", F.lit(1)), ["s1_id", "cand_id"], "left")
    step = lambda t: [F.count_if(F.col("prob") >= t), F.count_if((F.col("prob") >= t) & F.col("t").isNotNull())]
    per = lab.groupBy("s1_id").agg(F.array(*[F.struct(F.lit(t).alias("threshold"), step(t)[0].alias("np"), step(t)[1].alias("tp")) for t in grid]).alias("g"))
    nt = truth.select("s1_id", "cand_id").distinct().groupBy("s1_id").agg(F.count(F.lit(1)).alias("nt"))
    none = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(0).cast("long").alias("np"), F.lit(0).cast("long").alias("tp")) for t in grid])
    d = universe.join(per, "s1_id", "left").join(nt, "s1_id", "left").select(F.coalesce("nt", F.lit(0)).alias("nt"), F.explode(F.coalesce("g", none)).alias("g")).select("nt", "g.*")
    return d.groupBy("threshold").agg(F.round(F.avg(f05()), 6).alias("macro_f05"))


def bands(prob: Column, edges: list[float], right_closed: bool = False) -> Column:
    """The number of edges below the score: [a, b) bands, or (a, b] ones."""
    return reduce(lambda x, e: x + ((prob > e) if right_closed else (prob >= e)).cast("int"), edges, F.lit(0))


def density(val: DataFrame, test: DataFrame, n_val: DataFrame, n_test: DataFrame, edges: list[float]) -> DataFrame:
    """(country, band, val_prec, true_per_s1, test_per_s1, rate) for owned pairs in (a, b] bands.

    rate = (true pairs per entity on labelled data) / (pairs per entity on test), at most 1.  ``n_val``, ``n_test``:
    all entities of a country, those without pairs included.  A country and band without labelled pairs takes
    the unweighted mean of the countries in the band, else 0.
    """
    b = bands(F.col("prob"), edges, True).alias("band")
    v = val.groupBy("country", b).agg(F.count(F.lit(1)).alias("pairs"), F.sum("label").alias("true")).join(F.broadcast(n_val), "country")
    v = v.select("country", "band", (F.col("true") / F.col("n_val")).alias("tps"), (F.col("true") / F.col("pairs")).alias("prec"))
    pooled = v.groupBy("band").agg(F.avg("tps").alias("pooled_tps"), F.avg("prec").alias("pooled_prec"))
    t = test.groupBy("country", b).agg(F.count(F.lit(1)).alias("pairs")).join(F.broadcast(n_test), "country")
    j = t.join(v, ["country", "band"], "left").join(pooled, "band", "left")
    tps, per = F.coalesce("tps", "pooled_tps"), F.col("pairs") / F.col("n_test")
    r6 = lambda x, n: F.round(x, 6).alias(n)
    return j.select("country", "band", r6(F.coalesce("prec", "pooled_prec"), "val_prec"), r6(tps, "true_per_s1"), r6(per, "test_per_s1"), r6(F.coalesce(F.least(tps / per, F.lit(1.0)), F.lit(0.0)), "rate"))


def group_rules(val: DataFrame, test: DataFrame, n_val: DataFrame, n_test: DataFrame, edges: list[float], rescue: float = 0.82, veto: float = 0.74, least_val: int = 100, least_test: int = 500) -> DataFrame:
    """Actions per (band, country, nc, nk) by the estimated precision on test; unseen groups count as 0."""
    keys = ["band", "country", "nc", "nk"]
    b = bands(F.col("prob"), edges).alias("band")
    v = val.select(b, "country", "nc", "nk", "label").groupBy(*keys).agg(F.count(F.lit(1)).alias("v_n"), F.sum("label").alias("v_true"))
    t = test.select(b, "country", "nc", "nk").groupBy(*keys).agg(F.count(F.lit(1)).alias("t_n"))
    g = t.join(v, keys, "left").na.fill(0, ["v_n", "v_true"]).join(n_val, "country").join(n_test, "country")
    g = g.withColumn("test_rate", F.round((F.col("v_true") / F.col("n_val")) / (F.col("t_n") / F.col("n_test")), 3))
    action = F.when((F.col("test_rate") >= rescue) & (F.col("v_n") >= least_val) & (F.col("band") < len(edges)), "rescue").when(F.col("test_rate") <= veto, "veto")
    return g.withColumn("action", action).filter((F.col("t_n") >= least_test) & F.col("action").isNotNull()).select(*keys, "action", "v_n", "t_n", "test_rate")


def apply_rules(pairs: DataFrame, selected: DataFrame, rules: DataFrame, edges: list[float]) -> DataFrame:
    """Vetoed groups leave the selection, rescued ones join it; a null key meets no rule."""
    keys = ["band", "country", "nc", "nk"]
    tagged = pairs.withColumn("band", bands(F.col("prob"), edges)).join(rules.select(*keys, "action"), keys, "left")
    gone = tagged.filter("action = 'veto'").select("s1_id", "cand_id")
    more = tagged.filter("action = 'rescue'").select("s1_id", "cand_id")
    return selected.select("s1_id", "cand_id").join(gone, ["s1_id", "cand_id"], "left_anti").union(more).distinct()


def prior_weights(val: DataFrame, test: DataFrame, n_val: DataFrame, n_test: DataFrame, low: float = 0.2, high: float = 60.0, least: int = 5) -> DataFrame:
    """Weights of labelled negatives per (country, nc, nk) that give them the density they have on test."""
    keys = ["country", "nc", "nk"]
    v = val.groupBy(*keys).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    t = test.groupBy(*keys).agg(F.count(F.lit(1)).alias("t_n"))
    d = v.join(t, keys, "left").join(n_val, "country").join(n_test, "country")
    want = F.greatest(F.coalesce(F.col("t_n"), F.lit(0)) / F.col("n_test") - F.col("pos") / F.col("n_val"), F.lit(0.0))
    w = F.greatest(F.lit(low), F.least(F.lit(high), want / (F.col("neg") / F.col("n_val"))))
    return d.select(*keys, F.round(F.when(F.col("neg") >= least, w).otherwise(1.0), 6).alias("w"))


def calibrated_veto(pairs: DataFrame, gamma: float = 2.55, sure: float = 0.97, least: float = 0.78, floor: float = 0.9) -> DataFrame:
    """Pairs to drop: unsure ones with a weak calibrated score, and all below the floor."""
    weak = (F.col("prob") < sure) & (F.pow(F.coalesce("pc", F.lit(0.5)), F.lit(gamma)) < least)
    return pairs.filter(weak | (F.col("pc") < floor)).select("s1_id", "cand_id")


def toggle(selected: DataFrame, block: DataFrame, add: bool) -> DataFrame:
    """The selection with a block of pairs added, or without it."""
    s, b = selected.select("s1_id", "cand_id"), block.select("s1_id", "cand_id")
    return s.union(b).distinct() if add else s.join(b, ["s1_id", "cand_id"], "left_anti")


def siblings(matches: DataFrame, pool: DataFrame, keys: list[str]) -> DataFrame:
    """Unclaimed pool rows that equal a match in all keys (none empty), where the key has one owner."""
    m = matches.join(pool, "cand_id")
    owner = m.groupBy(*keys).agg(F.min("s1_id").alias("s1_id"), F.max("s1_id").alias("_hi")).filter("s1_id = _hi").drop("_hi")
    free = pool.join(matches.select("cand_id").distinct(), "cand_id", "left_anti").filter(F.col(keys[-1]) != "")
    return free.join(owner, keys).select("s1_id", "cand_id")


def attribution(truth: DataFrame, blocked: DataFrame, kept: DataFrame, selected: DataFrame) -> DataFrame:
    """(stage, n): where each true pair was lost, and how many chosen pairs are false."""
    mark = lambda d, n: d.select("s1_id", "cand_id").distinct().withColumn(n, F.lit(1))
    t = truth.select("s1_id", "cand_id").distinct()
    for d, n in ((blocked, "b"), (kept, "k"), (selected, "s")):
        t = t.join(mark(d, n), ["s1_id", "cand_id"], "left")
    lost = t.select(F.when(F.col("s").isNotNull(), "found").when(F.col("b").isNull(), "blocking").when(F.col("k").isNull(), "filter").otherwise("decision").alias("stage"))
    false = selected.select("s1_id", "cand_id").distinct().join(truth, ["s1_id", "cand_id"], "left_anti").select(F.lit("false").alias("stage"))
    return lost.unionByName(false).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


def by_kind(selected: DataFrame, owned: DataFrame, countries: list[str], neighbour: list[str], typo: list[str], low: float, threshold: float) -> DataFrame:
    """The selection without neighbours' numbers in ``countries``, and with typing errors of scores in [low, threshold).

    ``owned`` has country, prob and kind (of the change of number; '' where numbers do not conflict).
    """
    kind = owned.select("s1_id", "cand_id", "country", "kind", "prob")
    bad = kind.filter(F.col("country").isin(countries) & F.col("kind").isin(neighbour)).select("s1_id", "cand_id")
    more = kind.filter((F.col("prob") >= low) & (F.col("prob") < threshold) & F.col("kind").isin(typo)).select("s1_id", "cand_id")
    return selected.select("s1_id", "cand_id").join(bad, ["s1_id", "cand_id"], "left_anti").union(more).distinct()


def conflict_select(owned: DataFrame, base: float, strict: float) -> DataFrame:
    """Pairs above ``base``, or above ``strict`` where their numbers conflict."""
    return owned.filter(F.when(F.col("conflict"), F.col("prob") >= strict).otherwise(F.col("prob") >= base)).select("s1_id", "cand_id")


def expected_macro(universe: DataFrame, pairs: DataFrame, selected: DataFrame, miss: float) -> DataFrame:
    """The expected macro F0.5 of a selection from calibrated scores pc; ``miss`` is the number of true pairs an entity has outside the pairs."""
    total = pairs.groupBy("s1_id").agg(F.sum("pc").alias("t"), F.sum(F.log(1 - F.col("pc"))).alias("none"))
    chosen = selected.groupBy("s1_id").agg(F.sum("pc").alias("tp"), F.count(F.lit(1)).alias("k"))
    d = universe.select("s1_id").join(total, "s1_id", "left").join(chosen, "s1_id", "left").na.fill(0, ["t", "none", "tp", "k"])
    f = F.when(F.col("k") > 0, 1.25 * F.col("tp") / (0.25 * (F.col("t") + miss) + F.col("k"))).otherwise(F.exp(F.col("none") - miss))
    return d.agg(F.round(F.avg(f), 6).alias("expected_f05"))


def order_cut(pairs: DataFrame, keep: float, score: str = "prob") -> DataFrame:
    """The score above which the share ``keep`` of the labelled true pairs lies: an order statistic, not interpolated."""
    t = pairs.filter("label = 1").select(F.col(score).alias("v"), F.floor(F.col(score) * 1000).alias("b"))
    # at most 1,001 bands are ordered to find the band of the place; only its own values are ranked
    bands_ = t.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    run = bands_.withColumn("upto", F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))).withColumn("at", F.floor(F.sum("n").over(Window.partitionBy()) * F.lit(1 - keep)))
    band = run.filter((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("n") <= F.col("at"))).select("b", (F.col("at") - F.col("upto") + F.col("n") + 1).alias("place"))
    values = t.join(F.broadcast(band), "b").groupBy("b", "place", "v").agg(F.count(F.lit(1)).alias("n"))
    values = values.withColumn("upto", F.sum("n").over(Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    return values.filter(F.col("upto") >= F.col("place")).agg(F.min("v").alias("cutoff"))


def target_threshold(pairs: DataFrame, wanted: int) -> DataFrame:
    """The score of the pair at the place ``wanted`` (from 0) in descending order."""
    return pairs.select("prob").orderBy(F.desc("prob")).limit(wanted + 1).agg(F.min("prob").alias("threshold"))
