"""Queries over business records: normal forms, pair features, name and number changes, decisions that rest on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import names as nm
from ..operators import blocking, decide, features
from ..session import stored
from . import views

NATIVE = ["compact_eq", "name_jacc", "core_len_diff", "nums_jacc", "nums_conflict", "nums_q", "nums_c", "cand_addr_empty", "key_eq"]
GROUP = ["cos_gap", "cos_ratio", "n_cands", "cand_n_lists", "cand_best_cos", "cos_minus_cand_best", "is_cand_best", "n_same_compact", "n_same_nums", "top_nums_eq"]
RARITY = ["q_key_freq", "c_key_s1_freq", "c_key_other_s1", "q_addr_freq", "c_addr_s1_freq", "c_addr_other_s1"]


def queries_side(s: SparkSession, d: str) -> DataFrame:
    return nm.records(views.sql(s, d, views.BUSINESSES, "part"))


def pool_side(s: SparkSession, d: str) -> DataFrame:
    return nm.records(views.sql(s, d, views.VARIANTS, "part"))


def ranked(s: SparkSession, d: str) -> DataFrame:
    return views.sql(s, d, views.RANKED, "part", "lineitem")


def records(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Both sides' records, stored, for plans that read them several times.

    The parts are one small file, so their rows are dealt out before the names are normalised.
    """
    spread = lambda text: views.sql(s, d, text, "part").repartition(int(s.conf.get("spark.sql.shuffle.partitions")))
    return stored(nm.records(spread(views.BUSINESSES))), stored(nm.records(spread(views.VARIANTS)))


def sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides' records and the ranked pairs, stored."""
    return *records(s, d), stored(ranked(s, d))


def joined(s: SparkSession, d: str) -> DataFrame:
    return features.with_records(ranked(s, d), queries_side(s, d), pool_side(s, d))


def _records(s: SparkSession, d: str) -> DataFrame:
    both = queries_side(s, d).withColumn("side", F.lit("q")).unionByName(pool_side(s, d).withColumn("side", F.lit("c")))
    return both.select("side", "entity_id", *features.FIELDS)


def _ids(d: DataFrame, columns: list[str]) -> DataFrame:
    return d.select("s1_id", "cand_id", *columns)


def _kinds(s: SparkSession, d: str) -> DataFrame:
    out = features.name_changes(features.number_kinds(joined(s, d)), features.vocabulary(queries_side(s, d)))
    return _ids(out, ["nk", "nc", "swapped"])


def _legal(s: SparkSession, d: str) -> DataFrame:
    return joined(s, d).filter(nm.legal_conflict(F.col("q_name_norm"), F.col("c_name_norm"), F.col("c_name_core"))).select("s1_id", "cand_id")


def _describe(s: SparkSession, d: str) -> DataFrame:
    return features.describe(joined(s, d).withColumnRenamed("cos", "prob"))


def _owned(s: SparkSession, d: str) -> DataFrame:
    """The scored pairs that own their candidate, with a kind of number change and a calibrated score."""
    o = decide.one_owner(views.pairs(s, d))
    kind = F.when(F.col("nk") == "A", "near_value").when(F.col("nk") == "R", "one_digit_sub_big").otherwise("")
    return o.withColumns({"kind": kind, "conflict": F.col("nk") == "R", "pc": F.col("prob") * 0.98})


def _by_kind(s: SparkSession, d: str) -> DataFrame:
    o = _owned(s, d)
    return decide.by_kind(o.filter("prob >= 0.5"), o, ["c0", "c2"], lx.NEIGHBOUR_KINDS, lx.TYPO_KINDS, 0.3, 0.5)


def _expected(s: SparkSession, d: str) -> DataFrame:
    o = _owned(s, d)
    return decide.expected_macro(views.universe(s, d), o, o.filter("prob >= 0.5"), 0.1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "normalised_records": _records,
        "record_key_passes": lambda s, d: blocking.record_passes(queries_side(s, d), pool_side(s, d)),
        "pair_features_native": lambda s, d: _ids(features.native(joined(s, d)), NATIVE),
        "pair_features_group": lambda s, d: _ids(features.group(joined(s, d)), GROUP),
        "pair_features_rarity": lambda s, d: _ids(features.rarity(joined(s, d), queries_side(s, d)), RARITY),
        "pair_features": lambda s, d: features.all_features(ranked(s, d), queries_side(s, d), pool_side(s, d)),
        "change_kinds": _kinds,
        "domain_description": _describe,
        "legal_veto": _legal,
        "name_vocabulary": lambda s, d: features.vocabulary(queries_side(s, d)),
        "neighbour_veto_typo_rescue": _by_kind,
        "conflict_threshold": lambda s, d: decide.conflict_select(_owned(s, d), 0.5, 0.8),
        "expected_macro_f05": _expected,
        "order_cut": lambda s, d: decide.order_cut(views.pairs(s, d), 0.995),
        "target_threshold": lambda s, d: decide.target_threshold(decide.one_owner(views.pairs(s, d)), 500),
    }


def _quoted(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


def _normal() -> str:
    """Names and addresses of both sides normalised in DuckDB SQL, step by step."""
    letters, digits = "length(regexp_replace(x, '[^a-z]', '', 'g'))", "length(regexp_replace(x, '[^0-9]', '', 'g'))"
    ocr = f"CASE WHEN {letters} >= 2 AND {digits} BETWEEN 1 AND 2 AND {letters} > {digits} THEN translate(x, '0134568', 'oieasgb') ELSE x END"
    first = lambda c: f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"
    fold = lambda c: f"translate(replace({c}, 'rn', 'm'), 'l', 'i')"
    gone = sorted({*lx.HONORIFICS, *nm.folded(lx.HONORIFICS), *lx.MARKERS})
    states = {}
    for country, table in lx.STATES.items():
        c = "a"
        for full in sorted(table, key=len, reverse=True):
            c = rf"regexp_replace({c}, '\b{full}\b', '{table[full]}', 'g')"
        states[country] = c
    return f"""both_ AS (SELECT 'q' AS side, * FROM ({views.BUSINESSES}) UNION ALL SELECT 'c', * FROM ({views.VARIANTS})),
n1 AS (SELECT *, list_transform(list_filter(regexp_split_to_array(replace(lower(name), '.', ' '), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: {ocr}) AS t FROM both_),
n2 AS (SELECT * REPLACE (list_transform(list_filter(list_transform(t, lambda x: CASE WHEN x LIKE 'ln_%' THEN 'in' || x[3:] ELSE x END), lambda x: x NOT IN {_quoted(gone)}), lambda x: coalesce({_map(lx.SRI | lx.VARIANTS)}[x], x)) AS t) FROM n1),
n3 AS (SELECT * REPLACE ({first("t")} AS t) FROM (SELECT * REPLACE (list_transform(t, lambda x: {fold("x")}) AS t) FROM n2)),
n4 AS (SELECT *, list_filter(t, lambda x: x NOT IN {_quoted(nm.folded(lx.LEGAL))}) AS c FROM n3),
n5 AS (SELECT *, list_filter(c, lambda x: x NOT IN {_quoted(nm.folded(lx.DESCRIPTORS))}) AS k, array_to_string(t, ' ') AS name_norm FROM n4),
n6 AS (SELECT *, CASE WHEN len(c) > 0 THEN array_to_string(c, ' ') ELSE name_norm END AS name_core FROM n5),
n7 AS (SELECT *, replace(name_core, ' ', '') AS name_compact, CASE WHEN len(k) = 0 OR (len(k) = 1 AND length(k[1]) < 6) THEN name_core ELSE array_to_string(k, ' ') END AS name_key FROM n6),
a1 AS (SELECT *, array_to_string(list_filter(regexp_split_to_array(lower(address), '[^a-z0-9]+'), lambda x: x <> ''), ' ') AS a FROM n7),
a2 AS (SELECT * REPLACE (CASE country WHEN 'US' THEN {states["US"]} WHEN 'India' THEN {states["India"]} ELSE {states["France"]} END AS a) FROM a1),
a3 AS (SELECT *, list_transform(list_filter(string_split(regexp_replace(a, '\\b([a-z]{{1,4}})([0-9]+)\\b', '\\1 \\2', 'g'), ' '), lambda x: x <> ''), lambda x: regexp_replace(x, '^([0-9]+)(st|nd|rd|th)$', '\\1')) AS w FROM a2),
a4 AS (SELECT * REPLACE (list_transform(list_transform(w, lambda x: coalesce({_map(lx.ORDINALS)}[x], x)), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END ELSE coalesce({_map(lx.STREETS | lx.CITIES)}[x], x) END) AS w) FROM a3),
a5 AS (SELECT * REPLACE (list_filter(w, lambda x: x NOT IN {_quoted(lx.ADDRESS_NOISE)}) AS w) FROM a4),
a6 AS (SELECT * REPLACE ({first("w")} AS w) FROM a5),
rec AS (SELECT side, entity_id, country, name_norm, name_core, name_compact, name_key, '' AS name_alt, array_to_string(w, ' ') AS addr_norm,
array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(array_to_string(w, ' '), '[0-9]+'), lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END))), ' ') AS addr_nums,
array_to_string(list_filter(w, lambda x: x NOT IN {_quoted(lx.GENERIC)}), ' ') AS addr_key, false AS non_latin FROM a6),
ranked AS ({views.RANKED}),
j AS (SELECT r.*, q.country, {", ".join(f"q.{f} AS q_{f}, c.{f} AS c_{f}" for f in features.FIELDS)} FROM ranked r JOIN rec q ON q.side = 'q' AND q.entity_id = r.s1_id JOIN rec c ON c.side = 'c' AND c.entity_id = r.cand_id)"""


def oracle_sql() -> dict[str, str]:
    n, w = "WITH " + _normal(), "WITH " + views.SQL
    split = lambda c: f"list_filter(string_split({c}, ' '), lambda x: x <> '')"
    jacc = lambda a, b: f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN round(len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))), 6) ELSE 0.0 END"
    qn, cn = split("q_addr_nums"), split("c_addr_nums")
    freq = lambda f, s: f"coalesce((SELECT count(*) FROM rec WHERE side = 'q' AND rec.country = j.country AND rec.{f} = j.{s}_{f} AND rec.{f} <> ''), 0)"
    fam = lambda c: f"list_distinct(list_filter(list_transform({split(c)}, lambda x: {_map({nm.folded([k])[0]: v for k, v in lx.VETO_FAMILIES.items()})}[x]), lambda x: x IS NOT NULL))"
    place = lambda x: f"regexp_matches({x}.addr_key, '[0-9]') AND length({x}.addr_key) - length(replace({x}.addr_key, ' ', '')) >= 2"
    passes = {"via_addr_key": ("addr_key", place("q"), place), "via_compact": ("name_compact", "length(q.name_compact) >= 6", lambda x: "true"), "via_empty_addr": ("name_key", "true", lambda x: f"{x}.addr_norm = ''")}
    met = " UNION ALL ".join(
        f"""SELECT q.entity_id AS s1_id, c.entity_id AS cand_id, '{flag}' AS flag FROM rec q JOIN rec c ON q.country = c.country AND q.{key} = c.{key} WHERE q.side = 'q' AND c.side = 'c' AND q.{key} <> '' AND {of} AND {pool("c")}
AND (c.country, c.{key}) IN (SELECT (country, {key}) FROM rec x WHERE side = 'c' AND {pool("x")} GROUP BY country, {key} HAVING count(*) <= 20)"""
        for flag, (key, of, pool) in passes.items()
    )
    return {
        "record_key_passes": f"{n} SELECT s1_id, cand_id, {', '.join(f'CAST(bool_or(flag = {chr(39)}{f}{chr(39)}) AS INTEGER) AS {f}' for f in passes)} FROM ({met}) z GROUP BY 1, 2",
        "normalised_records": f"{n} SELECT side, entity_id, {', '.join(features.FIELDS)} FROM rec",
        "pair_features_native": f"""{n} SELECT s1_id, cand_id, CAST(q_name_compact = c_name_compact AND q_name_compact <> '' AS INTEGER) AS compact_eq, {jacc(split("q_name_core"), split("c_name_core"))} AS name_jacc,
abs(length(q_name_core) - length(c_name_core)) AS core_len_diff, {jacc(qn, cn)} AS nums_jacc, CAST(len({qn}) > 0 AND len({cn}) > 0 AND len(list_intersect({qn}, {cn})) = 0 AS INTEGER) AS nums_conflict,
len({qn}) AS nums_q, len({cn}) AS nums_c, CAST(c_addr_norm = '' AS INTEGER) AS cand_addr_empty, CAST(q_name_key = c_name_key AND q_name_key <> '' AS INTEGER) AS key_eq FROM j""",
        "pair_features_group": f"""{n} SELECT s1_id, cand_id, round(max(cos) OVER s - cos, 6) AS cos_gap, round(CASE WHEN max(cos) OVER s > 0 THEN cos / max(cos) OVER s ELSE 0.0 END, 6) AS cos_ratio, count(*) OVER s AS n_cands, count(*) OVER c AS cand_n_lists,
max(cos) OVER c AS cand_best_cos, round(cos - max(cos) OVER c, 6) AS cos_minus_cand_best, CAST(cos = max(cos) OVER c AS INTEGER) AS is_cand_best,
CASE WHEN c_name_compact <> '' THEN count(*) OVER (PARTITION BY s1_id, c_name_compact) - 1 ELSE 0 END AS n_same_compact, CASE WHEN c_addr_nums <> '' THEN count(*) OVER (PARTITION BY s1_id, c_addr_nums) - 1 ELSE 0 END AS n_same_nums,
CAST(arg_min(c_addr_nums, rank) OVER s = c_addr_nums AND c_addr_nums <> '' AS INTEGER) AS top_nums_eq FROM j WINDOW s AS (PARTITION BY s1_id), c AS (PARTITION BY cand_id)""",
        "pair_features_rarity": f"""{n}, x AS (SELECT s1_id, cand_id, {freq("name_key", "q")} AS q_key_freq, {freq("name_key", "c")} AS c_key_s1_freq, {freq("addr_key", "q")} AS q_addr_freq, {freq("addr_key", "c")} AS c_addr_s1_freq, q_name_key = c_name_key AS k, q_addr_key = c_addr_key AS a FROM j)
SELECT s1_id, cand_id, q_key_freq, c_key_s1_freq, greatest(c_key_s1_freq - CAST(k AS INTEGER), 0) AS c_key_other_s1, q_addr_freq, c_addr_s1_freq, greatest(c_addr_s1_freq - CAST(a AS INTEGER), 0) AS c_addr_other_s1 FROM x""",
        "domain_description": f"""{n} SELECT s1_id, cand_id, CASE WHEN c_addr_norm = '' THEN 0 WHEN q_addr_nums = '' OR c_addr_nums = '' THEN 1 WHEN q_addr_nums = c_addr_nums THEN 2 WHEN len(list_intersect({qn}, {cn})) > 0 THEN 3 ELSE 4 END AS nums_cat,
CASE WHEN q_name_compact = c_name_compact THEN 0 WHEN q_name_key = c_name_key THEN 1 ELSE 2 END AS name_cat, CAST(q_addr_norm = '' AS INTEGER) AS q_blank, CAST(c_addr_norm = '' AS INTEGER) AS c_blank, length(q_name_norm) - length(c_name_norm) AS len_diff,
CAST(row_number() OVER (PARTITION BY s1_id ORDER BY cos DESC, cand_id) AS INTEGER) AS prob_rank, count(*) FILTER (cos >= 0.97) OVER (PARTITION BY s1_id) AS n_hi, count(*) FILTER (cos >= 0.3 AND cos < 0.97) OVER (PARTITION BY s1_id) AS n_mid FROM j""",
        "legal_veto": f"""{n} SELECT s1_id, cand_id FROM j WHERE len({split("c_name_core")}) >= 2 AND len({fam("q_name_norm")}) > 0 AND len({fam("c_name_norm")}) > 0 AND len(list_intersect({fam("q_name_norm")}, {fam("c_name_norm")})) = 0""",
        "name_vocabulary": f"{n} SELECT country, word, count(DISTINCT entity_id) AS n FROM (SELECT country, entity_id, unnest(string_split(name_core, ' ')) AS word FROM rec WHERE side = 'q') WHERE word <> '' GROUP BY 1, 2 HAVING count(DISTINCT entity_id) >= 100",
        "neighbour_veto_typo_rescue": f"{w} SELECT s1_id, cand_id FROM owned WHERE (prob >= 0.5 AND NOT (country IN ('c0', 'c2') AND nk = 'A')) OR (prob >= 0.3 AND prob < 0.5 AND nk = 'R')",
        "conflict_threshold": f"{w} SELECT s1_id, cand_id FROM owned WHERE prob >= CASE WHEN nk = 'R' THEN 0.8 ELSE 0.5 END",
        "expected_macro_f05": f"""{w}, o AS (SELECT s1_id, prob, prob * 0.98 AS pc FROM owned), e AS (SELECT s1_id, sum(pc) AS t, sum(ln(1 - pc)) AS none_, sum(pc) FILTER (prob >= 0.5) AS tp, count(*) FILTER (prob >= 0.5) AS k FROM o GROUP BY 1)
SELECT round(avg(CASE WHEN coalesce(k, 0) > 0 THEN 1.25 * tp / (0.25 * (t + 0.1) + k) ELSE exp(coalesce(none_, 0) - 0.1) END), 6) AS expected_f05 FROM universe LEFT JOIN e USING (s1_id)""",
        "order_cut": f"{w}, v AS (SELECT list_sort(list(prob)) AS l FROM pairs WHERE label = 1) SELECT l[CAST(floor(len(l) * CAST(1 - CAST(0.995 AS DOUBLE) AS DOUBLE)) AS BIGINT) + 1] AS cutoff FROM v",
        "target_threshold": f"{w} SELECT min(prob) AS threshold FROM (SELECT prob FROM owned ORDER BY prob DESC LIMIT 501)",
    }
