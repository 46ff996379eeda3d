"""Pair features: what the two records of a pair have in common, and how rare it is."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import names as nm
from ..functions import similarity as sim
from ..functions import text as tx
from ..session import ship

FIELDS = ["name_norm", "name_core", "name_compact", "name_key", "name_alt", "addr_norm", "addr_nums", "addr_key", "non_latin"]
#: Feature: kernel, field of the query, field of the candidate.
KERNELS = {
    "name_tset": (sim.token_set_ratio, "q_name_core", "c_name_core"), "name_tsort": (sim.token_sort_ratio, "q_name_core", "c_name_core"),
    "name_ratio": (sim.ratio, "q_name_norm", "c_name_norm"), "name_partial": (sim.partial_ratio, "q_name_compact", "c_name_compact"),
    "compact_jw": (sim.jaro_winkler, "q_name_compact", "c_name_compact"), "addr_tset": (sim.token_set_ratio, "q_addr_norm", "c_addr_norm"),
    "addr_ratio": (sim.ratio, "q_addr_norm", "c_addr_norm"), "key_tset": (sim.token_set_ratio, "q_name_key", "c_name_key"),
    "alt_tset": (sim.token_set_ratio, "q_name_core", "c_name_alt"), "addr_key_tset": (sim.token_set_ratio, "q_addr_key", "c_addr_key"),
    "skel_tset": (sim.token_set_ratio, "q_skel", "c_skel"),
}


def unmatched(a: str, b: str, least: float = 80) -> int:
    """Words of ``a`` without an equal or near-equal word in ``b``."""
    other = b.split()
    return sum(t not in other and not any(sim.ratio(t, u) >= least for u in other) for t in a.split())


def with_records(pairs: DataFrame, queries: DataFrame, pool: DataFrame, more: tuple[list[str], list[str]] = ([], [])) -> DataFrame:
    """Pairs with q_* and c_* fields of both records (ids s1_id and cand_id); a pair without a record keeps empty fields.  ``more``: other columns of either side."""
    q = queries.select(F.col("entity_id").alias("s1_id"), "country", *[F.col(f).alias(f"q_{f}") for f in [*FIELDS, *more[0]]])
    c = pool.select(F.col("entity_id").alias("cand_id"), *[F.col(f).alias(f"c_{f}") for f in [*FIELDS, *more[1]]])
    text = [s + f for s in ("q_", "c_") for f in FIELDS if f != "non_latin"]
    return pairs.drop("country").join(q, "s1_id", "left").join(c, "cand_id", "left").na.fill("", text).na.fill(False, ["q_non_latin", "c_non_latin"])


def native(d: DataFrame) -> DataFrame:
    """Features that built-in functions give: sets of words and numbers, flags, legal forms."""
    w = {s + f: nm.words(F.col(s + f)) for s in ("q_", "c_") for f in ("name_core", "addr_nums")}
    q, c = w["q_addr_nums"], w["c_addr_nums"]
    lq, lc = nm.families(F.col("q_name_norm"), lx.FAMILIES), nm.families(F.col("c_name_norm"), lx.FAMILIES)
    apart = ~F.arrays_overlap(q, c)
    num = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    return d.withColumns({
        "compact_eq": num((F.col("q_name_compact") == F.col("c_name_compact")) & (F.col("q_name_compact") != "")),
        "name_jacc": F.round(tx.jaccard(w["q_name_core"], w["c_name_core"]), 6),
        "core_len_diff": F.abs(F.length("q_name_core") - F.length("c_name_core")),
        "nums_jacc": F.round(tx.jaccard(q, c), 6), "nums_conflict": num((F.size(q) > 0) & (F.size(c) > 0) & apart), "nums_q": F.size(q), "nums_c": F.size(c),
        "cand_addr_empty": num(F.col("c_addr_norm") == ""), "cand_non_latin": num(F.col("c_non_latin")),
        "key_eq": num((F.col("q_name_key") == F.col("c_name_key")) & (F.col("q_name_key") != "")),
        "acronym": num(nm.acronym(F.col("q_name_core"), F.col("c_name_compact")) | nm.acronym(F.col("c_name_core"), F.col("q_name_compact"))),
        "nums_fuzzy": num(apart & nm.near_numbers(q, c)),
        "legal_conflict": num((F.size(lq) > 0) & (F.size(lc) > 0) & ~F.arrays_overlap(lq, lc)), "legal_both": num((F.size(lq) > 0) & (F.size(lc) > 0)),
    })


def strings(d: DataFrame) -> DataFrame:
    """String similarities, in one Arrow pass over the fields they need."""
    ship(d.sparkSession)
    d = d.withColumns({"q_skel": nm.skeletons(F.col("q_name_core")), "c_skel": nm.skeletons(F.col("c_name_core"))})
    fields = sorted({f for _, a, b in KERNELS.values() for f in (a, b)})
    names = [*KERNELS, "key_extra", "key_missing"]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = {n: [float(k(a, b)) for a, b in zip(x[p], x[q], strict=True)] for n, (k, p, q) in KERNELS.items()}
            keys = list(zip(x["q_name_key"], x["c_name_key"], strict=True))
            yield pd.DataFrame(out | {"key_extra": [float(unmatched(c, q)) for q, c in keys], "key_missing": [float(unmatched(q, c)) for q, c in keys]})

    return d.withColumn("_s", run(F.struct(*[F.coalesce(F.col(f), F.lit("")).alias(f) for f in fields]))).select("*", "_s.*").drop("_s", "q_skel", "c_skel")


def rarity(d: DataFrame, queries: DataFrame) -> DataFrame:
    """How many query records of the country have the name key or address key of either side; "other" leaves the pair's own record out."""
    for field, short in (("name_key", "key"), ("addr_key", "addr")):
        n = queries.filter(F.col(field) != "").groupBy("country", F.col(field).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        for side, name in (("q", f"q_{short}_freq"), ("c", f"c_{short}_s1_freq")):
            d = d.withColumn("_v", F.col(f"{side}_{field}")).join(n, ["country", "_v"], "left").withColumn(name, F.coalesce("_n", F.lit(0))).drop("_v", "_n")
        same = (F.col(f"q_{field}") == F.col(f"c_{field}")).cast("int")
        d = d.withColumn(f"c_{short}_other_s1", F.greatest(F.col(f"c_{short}_s1_freq") - same, F.lit(0)))
    return d


def counted(queries: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with what ``rarity`` counts, per record instead of per pair: key_freq and addr_freq of queries, key_s1 and
    addr_s1 of the pool, maps from a country to the number of its query records with the key."""
    for field, short in (("name_key", "key"), ("addr_key", "addr")):
        n = queries.filter((F.col(field) != "") & F.col("country").isNotNull()).groupBy("country", field).agg(F.count(F.lit(1)).alias("_n"))
        queries = queries.join(n, ["country", field], "left").withColumn(f"{short}_freq", F.coalesce("_n", F.lit(0))).drop("_n")
        pool = pool.join(n.groupBy(field).agg(F.map_from_entries(F.collect_list(F.struct("country", "_n"))).alias(f"{short}_s1")), field, "left")
    return queries, pool


def pair_rarity(pairs: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """``rarity`` of pairs and their records' fields, from sides that are counted once: no pair is dealt out by its keys."""
    d = with_records(pairs, *counted(queries, pool), (["key_freq", "addr_freq"], ["key_s1", "addr_s1"]))
    for short, field in (("key", "name_key"), ("addr", "addr_key")):
        n = F.coalesce(F.try_element_at(f"c_{short}_s1", F.col("country")), F.lit(0))
        same = (F.col(f"q_{field}") == F.col(f"c_{field}")).cast("int")
        d = d.withColumns({f"q_{short}_freq": F.coalesce(f"q_{short}_freq", F.lit(0)), f"c_{short}_s1_freq": n, f"c_{short}_other_s1": F.greatest(n - same, F.lit(0))})
    return d.drop("c_key_s1", "c_addr_s1")


def group(d: DataFrame) -> DataFrame:
    """Features among an entity's and a candidate's pairs, over the whole table: cos, rank, competition, repeats, and the first candidate."""
    s, c = Window.partitionBy("s1_id"), Window.partitionBy("cand_id")
    best, top = F.max("cos").over(s), F.max("cos").over(c)
    first = lambda f: F.first(f).over(s.orderBy("rank", "cand_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    same = lambda f: F.when(F.col(f) != "", F.count(F.lit(1)).over(Window.partitionBy("s1_id", f)) - 1).otherwise(0)
    return d.withColumns({
        "cos_gap": F.round(best - F.col("cos"), 6), "cos_ratio": F.round(F.when(best > 0, F.col("cos") / best).otherwise(0.0), 6), "n_cands": F.count(F.lit(1)).over(s),
        "cand_n_lists": F.count(F.lit(1)).over(c), "cand_best_cos": top, "cos_minus_cand_best": F.round(F.col("cos") - top, 6), "is_cand_best": (F.col("cos") == top).cast("int"),
        "n_same_compact": same("c_name_compact"), "n_same_nums": same("c_addr_nums"),
        "top_name_core": first("c_name_core"), "top_addr_norm": first("c_addr_norm"), "top_nums_eq": ((first("c_addr_nums") == F.col("c_addr_nums")) & (F.col("c_addr_nums") != "")).cast("int"),
    })


def all_features(pairs: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """Every feature of ranked pairs (s1_id, cand_id, cos, rank, flags ...), string fields dropped."""
    d = rarity(group(native(with_records(pairs, queries, pool))), queries)
    spark = d.sparkSession
    d = strings(d).withColumns({"top_name_tset": sim.similarity(spark, "token_set", F.col("top_name_core"), F.col("c_name_core")), "top_addr_tset": sim.similarity(spark, "token_set", F.col("top_addr_norm"), F.col("c_addr_norm"))})
    return d.drop(*[s + f for s in ("q_", "c_") for f in FIELDS], "top_name_core", "top_addr_norm")


def vocabulary(queries: DataFrame, least: int = 100) -> DataFrame:
    """(country, word) of core-name words that at least ``least`` records of the country have."""
    w = queries.select("country", F.explode(F.array_distinct(nm.words(F.col("name_core")))).alias("word"))
    return w.groupBy("country", "word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _seen(word: str, others: list[str]) -> bool:
    return any(word.startswith(o) or o.startswith(word) or sim.ratio(word, o) >= 75 for o in others)


def words_changed(a: str, b: str) -> tuple[list[str], list[str], bool]:
    """Real words that ``b`` gains and loses against ``a``, and whether any word of ``b`` is seen in ``a``."""
    x, y = a.split(), b.split()
    real = lambda w, other: len(w) >= 3 and not w.isdigit() and not _seen(w, other)
    return [w for w in y if real(w, x)], [w for w in x if real(w, y)], any(_seen(w, x) for w in y)


def name_changes(d: DataFrame, vocab: DataFrame) -> DataFrame:
    """``d`` with nk, the kind of change between the names, and swapped, true where the candidate has another word of the
    country's vocabulary in the place of one of the entity's words.

    The Python part gives the gained and lost words; vocabulary membership is a join on gained words, so the
    vocabulary is never collected.
    """
    ship(d.sparkSession)

    @F.pandas_udf("gained array<string>, lost array<string>, near boolean")
    def changed(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([words_changed(x or "", y or "") for x, y in zip(a, b, strict=True)], columns=["gained", "lost", "near"])

    fill = nm.folded(lx.FILLERS)
    d = d.withColumn("_w", changed("q_name_core", "c_name_core"))
    new = d.select("s1_id", "cand_id", "country", F.explode("_w.gained").alias("word")).filter(~F.col("word").isin(fill)).join(vocab.select("country", "word"), ["country", "word"], "left_semi")
    d = d.join(new.select("s1_id", "cand_id").distinct().withColumn("_v", F.lit(True)), ["s1_id", "cand_id"], "left").withColumn("_v", F.coalesce("_v", F.lit(False)))
    a, b = nm.words(F.col("q_name_core")), nm.words(F.col("c_name_core"))
    gained, lost = F.col("_w.gained"), F.col("_w.lost")
    ga, la = F.size(gained) > 0, F.size(lost) > 0
    only_fill = ga & F.forall(gained, lambda w: w.isin(fill))
    kind = (
        F.when((F.size(a) == 0) | (F.size(b) == 0), "empty").when(F.array_join(a, "") == F.array_join(b, ""), "identical").when(F.array_sort(a) == F.array_sort(b), "reorder")
        .when(~F.arrays_overlap(a, b) & ~F.col("_w.near"), F.when((F.size(b) == 1) & (F.length(F.get(b, F.lit(0))) <= 4), "initialism").otherwise("brand"))
        .when(~ga & ~la, F.when(F.col("q_name_key") != F.col("c_name_key"), "typo").otherwise("keyeq_typo"))
        .when(F.col("_v") & la, "swap_vocab").when(F.col("_v"), "add_vocab").when(only_fill & ~la, "add_filler").when(only_fill, "filler_for_word").when(la & ~ga, "drop_word").otherwise("swap_other")
    )
    return d.withColumns({"nk": kind, "swapped": F.col("_v") & F.exists(lost, lambda w: ~w.isin(fill))}).drop("_w", "_v")


def number_kinds(d: DataFrame) -> DataFrame:
    """``d`` with nc, the relation of the addresses' numbers."""
    return d.withColumn("nc", nm.number_relation(F.col("q_addr_nums"), F.col("c_addr_nums"), F.col("q_addr_norm"), F.col("c_addr_norm")))


def conflict(d: DataFrame) -> Column:
    """Both sides have numbers, none in common."""
    q, c = nm.words(F.col("q_addr_nums")), nm.words(F.col("c_addr_nums"))
    return (F.size(q) > 0) & (F.size(c) > 0) & ~F.arrays_overlap(q, c)


def describe(d: DataFrame) -> DataFrame:
    """Columns that describe a domain: relation of numbers (0 blank, 1 missing, 2 equal, 3 overlap, 4 conflict), of names (0 compact, 1 key, 2 other), blanks, lengths, ranks."""
    q, c = nm.words(F.col("q_addr_nums")), nm.words(F.col("c_addr_nums"))
    s = Window.partitionBy("s1_id")
    nums = F.when(F.col("c_addr_norm") == "", 0).when((F.size(q) == 0) | (F.size(c) == 0), 1).when(F.col("q_addr_nums") == F.col("c_addr_nums"), 2).when(F.arrays_overlap(q, c), 3).otherwise(4)
    name = F.when(F.col("q_name_compact") == F.col("c_name_compact"), 0).when(F.col("q_name_key") == F.col("c_name_key"), 1).otherwise(2)
    return d.select(
        "s1_id", "cand_id", nums.alias("nums_cat"), name.alias("name_cat"), (F.col("q_addr_norm") == "").cast("int").alias("q_blank"), (F.col("c_addr_norm") == "").cast("int").alias("c_blank"),
        (F.length("q_name_norm") - F.length("c_name_norm")).alias("len_diff"), F.row_number().over(s.orderBy(F.desc("prob"), "cand_id")).alias("prob_rank"),
        F.count_if(F.col("prob") >= 0.97).over(s).alias("n_hi"), F.count_if((F.col("prob") >= 0.3) & (F.col("prob") < 0.97)).over(s).alias("n_mid"),
    )
