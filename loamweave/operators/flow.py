"""The composed decision over scored and tagged pairs, in its fixed order of steps."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from . import decide


@dataclass(frozen=True)
class Policy:
    """What each step does; an empty field leaves its step out."""

    cut: float = 0.0
    threshold: float | None = None
    per_entity: float | None = None
    country_threshold: dict[str, float] = field(default_factory=dict)
    neighbour_veto: tuple[str, ...] = ()
    typo_rescue: float | None = None
    edges: tuple[float, ...] = ()
    legal_veto: tuple[str, ...] = ()
    calibrated: tuple[str, ...] = ()
    calibrated_min: float = 0.78
    word_veto: bool = False


def _threshold(owned: DataFrame, policy: Policy, entities: int) -> float:
    if policy.threshold is not None:
        return policy.threshold
    n = owned.count()
    return decide.target_threshold(owned, max(0, min(int(policy.per_entity * entities), n - 1))).first()["threshold"]


def decided(pairs: DataFrame, policy: Policy, entities: int, rules: DataFrame | None = None) -> DataFrame:
    """The owned candidates with the verdict ``chosen``, one projection for all steps.

    ``pairs``: s1_id, cand_id, country, p1, prob and, as the steps ask for them, kind (of the change of
    number), nc, nk, legal (conflict), pc, swapped (words).  A tag that is null meets no rule.
    """
    owned = decide.one_owner(pairs.filter(F.col("p1") >= policy.cut))
    thr = _threshold(owned, policy, entities)
    yes: Column = F.col("prob") >= thr
    if policy.country_threshold:
        own = F.coalesce(*[F.when(F.col("country") == c, F.lit(t)) for c, t in policy.country_threshold.items()], F.lit(0.0))
        yes = yes & (F.col("prob") >= own)
    if policy.neighbour_veto:
        yes = yes & ~(F.col("country").isin(*policy.neighbour_veto) & F.col("kind").isin(lx.NEIGHBOUR_KINDS))
    if policy.typo_rescue is not None:
        yes = yes | ((F.col("prob") >= policy.typo_rescue) & (F.col("prob") < thr) & F.col("kind").isin(lx.TYPO_KINDS))
    if rules is not None:
        keys = ["band", "country", "nc", "nk"]
        owned = owned.withColumn("band", decide.bands(F.col("prob"), list(policy.edges))).join(F.broadcast(rules.select(*keys, "action")), keys, "left")
        act = F.coalesce("action", F.lit(""))
        yes = (yes & (act != "veto")) | ((F.col("prob") < thr) & (act == "rescue"))
    if policy.legal_veto:
        yes = yes & ~(F.col("country").isin(*policy.legal_veto) & F.col("legal"))
    if policy.calibrated:
        yes = F.when(F.col("country").isin(*policy.calibrated), F.coalesce(F.col("pc") >= policy.calibrated_min, F.lit(False))).otherwise(yes)
    if policy.word_veto:
        yes = yes & ~F.col("swapped")
    return owned.withColumn("chosen", F.coalesce(yes, F.lit(False)))


def siblings(chosen: DataFrame, pool: DataFrame, keys: list[str]) -> DataFrame:
    """Unclaimed pool rows that agree with a match in all keys (the last one not empty), where just one entity asks for them."""
    p = pool.filter(F.col(keys[-1]) != "").select("cand_id", *keys)
    owner = chosen.select("s1_id", "cand_id").join(p, "cand_id").groupBy(*keys).agg(F.min("s1_id").alias("s1_id"), F.max("s1_id").alias("_hi")).filter("s1_id = _hi").drop("_hi")
    return p.join(chosen.select("cand_id").distinct(), "cand_id", "left_anti").join(owner, keys).select("s1_id", "cand_id")


def finalise(pairs: DataFrame, policy: Policy, entities: int, rules: DataFrame | None = None, pool: DataFrame | None = None, keys: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The matches and the candidate list; siblings join both."""
    chosen = decided(pairs, policy, entities, rules).filter("chosen").select("s1_id", "cand_id")
    listed = pairs.filter(F.col("p1") >= policy.cut).select("s1_id", "cand_id")
    if pool is not None:
        more = siblings(chosen, pool, list(keys))
        chosen, listed = chosen.unionByName(more), listed.unionByName(more).distinct()
    return chosen, listed


def lend_rules(rules: DataFrame, lender: str, borrower: str, names: list[str] = lx.SAFE_NAMES, numbers: list[str] = lx.SAFE_NUMBERS) -> DataFrame:
    """Rules with a labelled country's safe rescues also for a country without labels, whose own rows go."""
    lent = rules.filter((F.col("country") == lender) & (F.col("action") == "rescue") & F.col("nk").isin(names) & F.col("nc").isin(numbers))
    return rules.filter(F.col("country") != borrower).unionByName(lent.withColumn("country", F.lit(borrower)))


def splice(rows: DataFrame, replacement: DataFrame, country: str) -> DataFrame:
    """One country's rows taken from elsewhere; columns that one side lacks become null."""
    return rows.filter(F.col("country") != country).unionByName(replacement.filter(F.col("country") == country), allowMissingColumns=True)
