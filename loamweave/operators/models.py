"""Models of pairs: splits, candidate filter, main model, cascade, cross-fitting, reweighted second stage, domain ratio, transfer.

Boosted trees are ``pyspark.ml``'s, so they run distributed and stay in the JVM; they grow by depth.  Splits
are keyed hashes of the entity (``bucket``), which need no sorting and give the same answer in any engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import decide


def bucket(key: Column, seed: int, n: int = 1000) -> Column:
    """0 to n - 1, evenly, by a hash of seed and key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % n


def split(entities: DataFrame, train: int, valid: int, seed: int = 7, offset: int = 0) -> DataFrame:
    """Entities with part 'train' or 'valid': thousandths of all, disjoint, shifted by ``offset``."""
    b = (bucket(F.col("s1_id"), seed) + offset) % 1000
    part = F.when(b < train, "train").when(b < train + valid, "valid")
    return entities.withColumn("part", part).filter("part IS NOT NULL")


def hide(pairs: DataFrame, share: int, seed: int = 11) -> DataFrame:
    """Pairs without a share (thousandths) of the entities, whose records stay in other entities' lists."""
    return pairs.filter(bucket(F.col("s1_id"), seed) >= share)


def fit(train: DataFrame, features: list[str], categories: list[str] = (), weight: str | None = None, valid: str | None = None, rounds: int = 20, depth: int = 5, seed: int = 7) -> PipelineModel:
    """Boosted trees for the column label; ``valid`` marks the rows that stop the rounds early."""
    index = [StringIndexer(inputCol=c, outputCol=f"_{c}", handleInvalid="keep") for c in categories]
    vector = VectorAssembler(inputCols=[*features, *[f"_{c}" for c in categories]], outputCol="_x", handleInvalid="keep")
    trees = GBTClassifier(featuresCol="_x", labelCol="label", maxIter=rounds, maxDepth=depth, subsamplingRate=0.8, stepSize=0.1, seed=seed, maxBins=64)
    if weight:
        trees = trees.setWeightCol(weight)
    if valid:
        trees = trees.setValidationIndicatorCol(valid)
    return Pipeline(stages=[*index, vector, trees]).fit(train)


def score(model: PipelineModel, d: DataFrame, name: str = "prob") -> DataFrame:
    """``d`` with the probability of label 1."""
    return model.transform(d).withColumn(name, vector_to_array("probability")[1]).select(*[c for c in d.columns if c != name], name)


def candidate_filter(train: DataFrame, valid: DataFrame, features: list[str], keep: float = 0.995) -> tuple[PipelineModel, float]:
    """The cheap first stage, and the score that keeps a share of the true pairs that blocking found."""
    model = fit(train, features, rounds=15, depth=4)
    cut = decide.order_cut(score(model, valid, "p1"), keep, "p1").first()["cutoff"]
    return model, float("-inf") if cut is None else float(cut)


def main_model(train: DataFrame, valid: DataFrame, features: list[str], conflict: float = 3.0) -> PipelineModel:
    """The second stage, with negatives of conflicting numbers weighted and early stopping on ``valid``."""
    w = F.when((F.col("label") == 0) & (F.col("nums_conflict") > 0), conflict).otherwise(1.0)
    both = train.withColumn("_v", F.lit(False)).unionByName(valid.withColumn("_v", F.lit(True)))
    return fit(both.withColumn("_w", w), features, weight="_w", valid="_v")


def cascade(pairs: DataFrame, first: PipelineModel, cut: float, more: Callable[[DataFrame], DataFrame], main: PipelineModel) -> DataFrame:
    """(s1_id, cand_id, p1, prob): ``more`` adds the expensive features, and only to what the filter keeps."""
    kept = score(first, pairs, "p1").filter(F.col("p1") >= cut)
    return score(main, more(kept)).select("s1_id", "cand_id", "p1", "prob")


def half_average(frames: list[DataFrame], columns: list[str] = ("prob",)) -> DataFrame:
    """The mean score of each pair over several models' results."""
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    return every.groupBy("s1_id", "cand_id").agg(*[F.avg(c).alias(c) for c in columns])


def crossfit(train: DataFrame, new: DataFrame, features: list[str], seed: int = 13, **options) -> tuple[DataFrame, DataFrame]:
    """Each half of the entities scored by the other half's model; ``new`` pairs by the mean of both."""
    half = bucket(F.col("s1_id"), seed, 2)
    models = [fit(train.filter(half == k), features, **options) for k in (0, 1)]
    own = score(models[1], train.filter(half == 0)).unionByName(score(models[0], train.filter(half == 1)))
    return own, half_average([score(m, new).select("s1_id", "cand_id", "prob") for m in models])


def rival_stack(train: DataFrame, new: DataFrame, features: list[str], conflict: float = 3.0) -> DataFrame:
    """``new`` rescored by trees over the first score and rival and context features."""
    w = F.when((F.col("label") == 0) & (F.col("nums_conflict") > 0), conflict).otherwise(1.0)
    return score(fit(train.withColumn("_w", w), ["prob", *features], weight="_w"), new, "stacked")


def band_weights(val: DataFrame, test: DataFrame, n_val: DataFrame, n_test: DataFrame, edges: list[float], low: float = 0.2, least: int = 5) -> DataFrame:
    """Weights of labelled negatives per (country, band, nc, nk): of the group, else of the band, else 1; no upper bound."""
    def weights(keys: list[str], name: str) -> DataFrame:
        b = decide.bands(F.col("prob"), edges, True)
        v = val.withColumn("band", b).groupBy(*keys).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
        t = test.withColumn("band", b).groupBy(*keys).agg(F.count(F.lit(1)).alias("t_n"))
        d = v.join(t, keys, "left").join(F.broadcast(n_val), "country").join(F.broadcast(n_test), "country")
        w = F.greatest(F.coalesce(F.col("t_n"), F.lit(0)) / F.col("n_test") - F.col("pos") / F.col("n_val"), F.lit(0.0)) / (F.col("neg") / F.col("n_val"))
        return d.select(*keys, F.when(F.col("neg") >= least, w).alias(name))

    fine, coarse = weights(["country", "band", "nc", "nk"], "fine"), weights(["country", "band"], "coarse")
    out = fine.join(coarse, ["country", "band"], "left")
    return out.select("country", "band", "nc", "nk", F.round(F.greatest(F.coalesce("fine", "coarse", F.lit(1.0)), F.lit(low)), 6).alias("w"))


def second_stage(val: DataFrame, test: DataFrame, weights: DataFrame, features: list[str], folds: int = 5, apply_to: tuple[str, str] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Calibrated scores pc: of ``val`` out of fold, of ``test`` by all of ``val``, negatives weighted per (country, nc, nk).

    ``apply_to=(country, as_country)`` encodes an unlabelled country as a labelled one.
    """
    kinds = ["nc", "nk", "country"]
    v = val.join(F.broadcast(weights.select(*kinds, "w")), kinds, "left")
    v = v.withColumn("w", F.when(F.col("label") == 1, 1.0).otherwise(F.coalesce("w", F.lit(1.0)))).withColumn("fold", bucket(F.col("s1_id"), 3, folds))
    parts = [score(fit(v.filter(F.col("fold") != k), features, kinds, "w", **options), v.filter(F.col("fold") == k), "pc") for k in range(folds)]
    own = parts[0]
    for p in parts[1:]:
        own = own.unionByName(p)
    t = test
    if apply_to:
        t = test.withColumn("_own", F.col("country")).withColumn("country", F.when(F.col("country") == apply_to[0], apply_to[1]).otherwise(F.col("country")))
    out = score(fit(v, features, kinds, "w", **options), t, "pc")
    return own, out.withColumn("country", F.col("_own")).drop("_own") if apply_to else out


def domain_ratio(val: DataFrame, test: DataFrame, n_val: DataFrame, n_test: DataFrame, features: list[str]) -> DataFrame:
    """Test pairs with r, how much denser they are on test than on labelled data, pc = prob / max(r, 1) and pc_free = prob / r (at most 0.999)."""
    w = val.join(F.broadcast(n_val), "country").join(F.broadcast(n_test), "country").withColumn("w", F.col("n_test") / F.col("n_val"))
    both = w.select(*features, "w", F.lit(0.0).alias("label")).unionByName(test.select(*features, F.lit(1.0).alias("w"), F.lit(1.0).alias("label")))
    vector = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")
    model = Pipeline(stages=[vector, LogisticRegression(featuresCol="_x", labelCol="label", weightCol="w", regParam=1e-4)]).fit(both)
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col("_d")))
    d = score(model, test, "_d").withColumn("r", p / (1 - p)).drop("_d")
    return d.withColumns({"pc": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prob") / F.greatest("r", F.lit(1.0)))), "pc_free": F.greatest(F.lit(0.0), F.least(F.lit(0.999), F.col("prob") / F.col("r")))})


def transfer(pairs: DataFrame, universe: DataFrame, truth: DataFrame, features: list[str], source: str, target: str, grid: list[float], **options) -> DataFrame:
    """(threshold, source_f05, target_f05) of a model fitted to one country, on its own entities held out and on another country."""
    held = bucket(F.col("s1_id"), 17, 3) == 0
    model = fit(pairs.filter((F.col("country") == source) & ~held), features, **options)
    out = {}
    for name, some in (("source_f05", (F.col("country") == source) & held), ("target_f05", F.col("country") == target)):
        u = universe.filter(some)
        out[name] = decide.tune(u, decide.one_owner(score(model, pairs.filter(some))), truth.join(u.select("s1_id"), "s1_id", "left_semi"), grid).withColumnRenamed("macro_f05", name)
    return out["source_f05"].join(out["target_f05"], "threshold")
