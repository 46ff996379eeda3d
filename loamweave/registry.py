"""All queries of the library proper, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import blocking, decide
from .plans import linkage, scoring, views
from .sources import idlists

EDGES = [0.3, 0.5, 0.7, 0.9, 0.97]
GRID = [round(0.2 + 0.025 * i, 3) for i in range(31)]
Query = Callable[[SparkSession, str], DataFrame]


def _truth(p: DataFrame) -> DataFrame:
    return p.filter("label = 1").select("s1_id", "cand_id")


def _chosen(p: DataFrame) -> DataFrame:
    return decide.one_owner(p).filter("prob >= 0.5").select("s1_id", "cand_id", "prob")


def _counted(s: SparkSession, d: str) -> DataFrame:
    p = views.pairs(s, d)
    return decide.counts(views.universe(s, d), _chosen(p), _truth(p))


def _halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Labelled and unlabelled pairs, and the numbers of all entities of either per country."""
    u = views.universe(s, d)
    n = [u.filter(F.col("s1_id") % 2 == r).groupBy("country").agg(F.count(F.lit(1)).alias(name)) for r, name in ((0, "n_val"), (1, "n_test"))]
    return views.pairs(s, d, 2, 0), views.pairs(s, d, 2, 1), n[0], n[1]


def _tfidf(s: SparkSession, d: str, part: str | None = None) -> DataFrame:
    docs, items = views.table(s, d, "documents"), views.table(s, d, "benchmark")
    pool = blocking.terms(docs, "doc_id", "text")
    return blocking.tfidf_topk(blocking.terms(items, "item_id", "text"), pool, max_df=0.02).select("s1_id", "cand_id", "cos", F.col("rank").cast("int").alias("rank"))


def _copies(s: SparkSession, d: str) -> DataFrame:
    """View B: the first document of each text and language among the others of its language, by their whole normalised texts (capped)."""
    text = F.col("text")
    whole = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}0-9]+", " "))
    docs = views.table(s, d, "documents").select(F.coalesce("lang", F.lit("")).alias("part"), F.col("doc_id").alias("id"), F.md5(text).alias("same"), F.md5(F.when(whole != "", whole).otherwise(text)).alias("key"))
    first = docs.groupBy("part", "same").agg(F.min("id").alias("id")).select("id")
    return blocking.key_pass(docs.join(first, "id", "left_semi"), docs.join(first, "id", "left_anti"))


def _merged(s: SparkSession, d: str) -> DataFrame:
    p = views.pairs(s, d)
    top = p.filter("prob >= 0.4").select("s1_id", "cand_id", F.col("prob").alias("cos"), F.col("label").alias("rank"))
    flagged = p.filter("prob < 0.6").select("s1_id", "cand_id", (F.col("nk") == "A").cast("int").alias("via_key"), (F.col("nc") == "O").cast("int").alias("via_compact"))
    return blocking.merge_candidates(top, flagged, ["via_key", "via_compact"])


def _group_rules(s: SparkSession, d: str) -> DataFrame:
    v, t, nv, nt = _halves(s, d)
    return decide.group_rules(v, t, nv, nt, EDGES, least_val=5, least_test=5)


def _rules_applied(s: SparkSession, d: str) -> DataFrame:
    v, t, nv, nt = _halves(s, d)
    return decide.apply_rules(t, _chosen(t), decide.group_rules(v, t, nv, nt, EDGES, least_val=5, least_test=5), EDGES)


def _veto(s: SparkSession, d: str) -> DataFrame:
    pc = F.when(F.col("cand_id") % 5 == 0, F.lit(None)).otherwise(1 - (F.col("cand_id") % 20) / 100)
    return decide.calibrated_veto(views.pairs(s, d).withColumn("pc", pc))


def _siblings(s: SparkSession, d: str) -> DataFrame:
    pool = views.table(s, d, "part").select(F.col("p_partkey").alias("cand_id"), F.col("p_brand").alias("k1"), F.concat(F.col("p_size").cast("string"), F.lit(""), (F.col("p_partkey") % 97).cast("string")).alias("k2"))
    m = _chosen(views.pairs(s, d)).filter("prob >= 0.9").select("s1_id", "cand_id")
    return decide.siblings(m, pool, ["k1", "k2"])


def _text(s: SparkSession, d: str) -> DataFrame:
    docs = views.table(s, d, "documents")
    low = F.lower(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.md5(F.array_join(tx.tokens(low), " ")).alias("tokens"), F.md5(tx.fold(low)).alias("folded"), F.array_join(tx.numbers(low), ",").alias("nums"), tx.non_latin(low).alias("non_latin"))


def _numbers(s: SparkSession, d: str) -> DataFrame:
    o = views.table(s, d, "orders")
    a, b = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    return o.select("o_orderkey", tx.number_kind(a, b).alias("kind"))


def _lists(s: SparkSession, d: str) -> DataFrame:
    return idlists.id_lists(views.universe(s, d), _chosen(views.pairs(s, d)))


def _problems(s: SparkSession, d: str) -> DataFrame:
    return idlists.problems(_lists(s, d), views.universe(s, d), views.pairs(s, d))


def queries() -> dict[str, Query]:
    p = views.pairs
    return {
        "tfidf_topk": _tfidf,
        "key_pass_copies": _copies,
        "merge_candidates": _merged,
        "blocking_recall": lambda s, d: blocking.recall(_truth(p(s, d)), p(s, d).filter("prob >= 0.4")),
        "competition_features": lambda s, d: decide.competition(p(s, d)),
        "rival_margin": lambda s, d: decide.rivals(p(s, d)),
        "context_features": lambda s, d: decide.context(p(s, d)),
        "consensus_number": lambda s, d: decide.consensus(p(s, d)),
        "one_owner": lambda s, d: decide.one_owner(p(s, d)),
        "expected_f05_select": lambda s, d: decide.expected_select(p(s, d)),
        "threshold_tuning_grid": lambda s, d: decide.tune(views.universe(s, d), decide.one_owner(p(s, d)), _truth(p(s, d)), GRID),
        "density_table": lambda s, d: decide.density(decide.one_owner(p(s, d, 2, 0)).filter("country <> 'c1' OR prob < 0.5"), decide.one_owner(p(s, d, 2, 1)), *views.entity_numbers(views.universe(s, d)), EDGES),
        "group_rules": _group_rules,
        "group_rules_applied": _rules_applied,
        "prior_weights": lambda s, d: decide.prior_weights(*_halves(s, d)),
        "calibrated_veto": _veto,
        "toggle_remove": lambda s, d: decide.toggle(_chosen(p(s, d)), p(s, d).filter("nk = 'R'"), False),
        "toggle_add": lambda s, d: decide.toggle(_chosen(p(s, d)), p(s, d).filter("nk = 'R' AND prob >= 0.45"), True),
        "sibling_expansion": _siblings,
        "macro_f05_report": lambda s, d: decide.report(_counted(s, d)),
        "size_vs_score": lambda s, d: decide.size_vs_score(_counted(s, d)),
        "error_attribution": lambda s, d: decide.attribution(_truth(p(s, d)), p(s, d).filter("prob >= 0.2"), decide.one_owner(p(s, d).filter("prob >= 0.2")), _chosen(p(s, d))),
        "text_normalisation": _text,
        "number_kinds": _numbers,
        "id_lists": _lists,
        "validator": _problems,
    } | linkage.queries() | scoring.queries()


def oracle_sql() -> dict[str, str]:
    w = "WITH " + views.SQL
    band = lambda op: "(" + " + ".join(f"CAST(prob {op} {e} AS INTEGER)" for e in EDGES) + ")"
    rules = f"""{w},
nv AS (SELECT country, count(*) AS n_val FROM universe WHERE s1_id % 2 = 0 GROUP BY 1), nt AS (SELECT country, count(*) AS n_test FROM universe WHERE s1_id % 2 = 1 GROUP BY 1),
v AS (SELECT {band(">=")} AS band, country, nc, nk, count(*) AS v_n, sum(label) AS v_true FROM val GROUP BY ALL), t AS (SELECT {band(">=")} AS band, country, nc, nk, count(*) AS t_n FROM test GROUP BY ALL),
g AS (SELECT t.band, t.country, t.nc, t.nk, coalesce(v_n, 0) AS v_n, t_n, round((coalesce(v_true, 0) / n_val) / (t_n / n_test), 3) AS test_rate FROM t LEFT JOIN v USING (band, country, nc, nk) JOIN nv USING (country) JOIN nt USING (country)),
rules AS (SELECT band, country, nc, nk, CASE WHEN test_rate >= 0.82 AND v_n >= 5 AND band < {len(EDGES)} THEN 'rescue' WHEN test_rate <= 0.74 THEN 'veto' END AS action, v_n, t_n, test_rate FROM g WHERE t_n >= 5)
"""
    grid = ", ".join(f"({t})" for t in GRID)
    f = "CASE WHEN np = 0 AND nt = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * tp / (0.25 * nt + np) END::DOUBLE"
    words = r"regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}0-9]+', ' ', 'g'), ' ')"
    tf = lambda t, k: f"(SELECT id, term, count(*) AS tf FROM (SELECT {k} AS id, unnest({words}) AS term FROM {t}) WHERE term <> '' GROUP BY 1, 2)"
    return {
        "tfidf_topk": f"""WITH p AS {tf("documents", "doc_id")}, q AS {tf("benchmark", "item_id")}, n AS (SELECT count(DISTINCT id) AS n FROM p),
v AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), n WHERE df >= 2 AND df <= 0.02 * n),
pw AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM (SELECT id, term, (1 + ln(tf)) * idf AS w FROM p JOIN v USING (term))),
qw AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM (SELECT id, term, (1 + ln(tf)) * idf AS w FROM q JOIN v USING (term))),
c AS (SELECT qw.id AS s1_id, pw.id AS cand_id, round(sum(qw.w * pw.w), 6) AS cos FROM qw JOIN pw USING (term) GROUP BY 1, 2)
SELECT s1_id, cand_id, cos, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY cos DESC, cand_id) AS INTEGER) AS rank FROM c WHERE cos > 0 QUALIFY rank <= 20""",
        "key_pass_copies": r"""WITH d AS (SELECT coalesce(lang, '') AS part, doc_id AS id, md5(text) AS same, md5(coalesce(nullif(trim(regexp_replace(lower(text), '[^\p{L}0-9]+', ' ', 'g')), ''), text)) AS key FROM documents),
f AS (SELECT min(id) AS id FROM d GROUP BY part, same), p AS (SELECT * FROM d WHERE id NOT IN (SELECT id FROM f)), few AS (SELECT part, key FROM p GROUP BY 1, 2 HAVING count(*) <= 20)
SELECT DISTINCT q.id AS s1_id, p.id AS cand_id FROM d q JOIN p ON q.part = p.part AND q.key = p.key JOIN few ON p.part = few.part AND p.key = few.key WHERE q.id IN (SELECT id FROM f)""",
        "merge_candidates": f"""{w} SELECT s1_id, cand_id, coalesce(t.prob, 0.0) AS cos, coalesce(t.label, 21) AS rank, coalesce(f.via_key, 0) AS via_key, coalesce(f.via_compact, 0) AS via_compact
FROM (SELECT * FROM pairs WHERE prob >= 0.4) t FULL JOIN (SELECT s1_id, cand_id, CAST(nk = 'A' AS INTEGER) AS via_key, CAST(nc = 'O' AS INTEGER) AS via_compact FROM pairs WHERE prob < 0.6) f USING (s1_id, cand_id)""",
        "blocking_recall": f"{w} SELECT count(*) FILTER (prob >= 0.4) AS found, count(*) AS total, round(count(*) FILTER (prob >= 0.4) / count(*), 6) AS recall FROM pairs WHERE label = 1",
        "competition_features": f"""{w} SELECT s1_id, cand_id, max(prob) OVER s - prob AS gap, CASE WHEN max(prob) OVER s > 0 THEN prob / max(prob) OVER s ELSE 0.0 END AS part_of_best, count(*) OVER s AS n_cands, count(*) OVER c AS cand_n_lists,
prob - max(prob) OVER c AS minus_cand_best, prob = max(prob) OVER c AS is_cand_best FROM pairs WINDOW s AS (PARTITION BY s1_id), c AS (PARTITION BY cand_id)""",
        "rival_margin": f"""{w}, r AS (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) AS n FROM pairs)
SELECT s1_id, cand_id, count(*) OVER c AS n_rivals, CAST(rank() OVER (PARTITION BY cand_id ORDER BY prob DESC) AS INTEGER) AS rival_rank,
round(prob - CASE WHEN n = 1 THEN coalesce(max(CASE WHEN n = 2 THEN prob END) OVER c, -100.0) ELSE max(prob) OVER c END, 6) AS margin FROM r WINDOW c AS (PARTITION BY cand_id)""",
        "context_features": f"""{w}, h AS (SELECT *, CAST(prob >= 0.9 AS INTEGER) AS hi, CAST(prob < 0.3 AS INTEGER) AS lo FROM pairs)
SELECT s1_id, cand_id, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id) AS INTEGER) AS prob_rank, CAST(sum(hi) OVER s AS BIGINT) AS n_hi, CAST(sum(hi) OVER k - hi AS BIGINT) AS same_hi, CAST(sum(lo) OVER k - lo AS BIGINT) AS same_lo, round(max(prob) OVER s - prob, 6) AS gap_top
FROM h WINDOW s AS (PARTITION BY s1_id), k AS (PARTITION BY s1_id, nk)""",
        "consensus_number": f"{w} SELECT s1_id, nc AS consensus, n FROM (SELECT s1_id, nc, count(*) AS n FROM pairs GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY n DESC, nc) = 1",
        "one_owner": f"{w} SELECT * FROM owned",
        "expected_f05_select": f"""{w}, k AS (SELECT *, row_number() OVER o AS k, sum(prob) OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id ROWS UNBOUNDED PRECEDING) AS cum, sum(prob) OVER (PARTITION BY s1_id) AS total, exp(sum(ln(1 - least(prob, 0.999999))) OVER (PARTITION BY s1_id)) AS none_ FROM pairs WINDOW o AS (PARTITION BY s1_id ORDER BY prob DESC, cand_id)),
e AS (SELECT *, round(1.25 * cum / (0.25 * total + k), 9) AS ef FROM k), b AS (SELECT *, max(ef) OVER (PARTITION BY s1_id) AS best FROM e), a AS (SELECT *, min(CASE WHEN ef = best THEN k END) OVER (PARTITION BY s1_id) AS at_ FROM b)
SELECT s1_id, cand_id, prob FROM a WHERE k <= at_ AND prob >= 0.5 AND best > none_""",
        "threshold_tuning_grid": f"""{w}, g(threshold) AS (VALUES {grid}), nt AS (SELECT s1_id, count(*) AS nt FROM truth GROUP BY 1),
x AS (SELECT threshold, s1_id, count(*) FILTER (prob >= threshold) AS np, count(*) FILTER (prob >= threshold AND label = 1) AS tp FROM owned, g GROUP BY 1, 2),
y AS (SELECT g.threshold, coalesce(tp, 0) AS tp, coalesce(np, 0) AS np, coalesce(nt, 0) AS nt FROM universe u CROSS JOIN g LEFT JOIN x ON x.s1_id = u.s1_id AND x.threshold = g.threshold LEFT JOIN nt ON nt.s1_id = u.s1_id)
SELECT CAST(threshold AS DOUBLE) AS threshold, round(avg({f}), 6) AS macro_f05 FROM y GROUP BY 1""",
        "density_table": f"""{w}, nv AS (SELECT country, count(*) AS n FROM universe WHERE s1_id % 2 = 0 GROUP BY 1), nt AS (SELECT country, count(*) AS n FROM universe WHERE s1_id % 2 = 1 GROUP BY 1),
ov AS (SELECT * FROM (SELECT * FROM val QUALIFY prob = max(prob) OVER (PARTITION BY cand_id)) WHERE country <> 'c1' OR prob < 0.5), ot AS (SELECT * FROM test QUALIFY prob = max(prob) OVER (PARTITION BY cand_id)),
a AS (SELECT country, band, x / n AS tps, x / p AS prec FROM (SELECT country, {band(">")} AS band, sum(label) AS x, count(*) AS p FROM ov GROUP BY 1, 2) JOIN nv USING (country)),
m AS (SELECT band, avg(tps) AS ptps, avg(prec) AS pprec FROM a GROUP BY 1), b AS (SELECT country, band, x / n AS per FROM (SELECT country, {band(">")} AS band, count(*) AS x FROM ot GROUP BY 1, 2) JOIN nt USING (country))
SELECT country, band, round(coalesce(prec, pprec), 6) AS val_prec, round(coalesce(tps, ptps), 6) AS true_per_s1, round(per, 6) AS test_per_s1, round(coalesce(least(coalesce(tps, ptps) / per, 1.0), 0.0), 6) AS rate FROM b LEFT JOIN a USING (country, band) LEFT JOIN m USING (band)""",
        "group_rules": f"{rules} SELECT * FROM rules WHERE action IS NOT NULL",
        "group_rules_applied": f"""{rules}, tagged AS (SELECT s1_id, cand_id, action FROM (SELECT *, {band(">=")} AS band FROM test) JOIN rules USING (band, country, nc, nk)),
c AS (SELECT s1_id, cand_id FROM test WHERE prob >= 0.5 AND (cand_id, prob) IN (SELECT cand_id, max(prob) FROM test GROUP BY 1))
SELECT * FROM (SELECT s1_id, cand_id FROM c EXCEPT SELECT s1_id, cand_id FROM tagged WHERE action = 'veto') UNION SELECT s1_id, cand_id FROM tagged WHERE action = 'rescue'""",
        "prior_weights": f"""{w}, nv AS (SELECT country, count(*) AS n_val FROM universe WHERE s1_id % 2 = 0 GROUP BY 1), nt AS (SELECT country, count(*) AS n_test FROM universe WHERE s1_id % 2 = 1 GROUP BY 1),
v AS (SELECT country, nc, nk, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM val GROUP BY ALL), t AS (SELECT country, nc, nk, count(*) AS t_n FROM test GROUP BY ALL)
SELECT country, nc, nk, round(CASE WHEN neg >= 5 THEN greatest(0.2, least(60.0, greatest(coalesce(t_n, 0) / n_test - pos / n_val, 0.0) / (neg / n_val))) ELSE 1.0 END, 6) AS w FROM v LEFT JOIN t USING (country, nc, nk) JOIN nv USING (country) JOIN nt USING (country)""",
        "calibrated_veto": f"""{w}, x AS (SELECT *, CASE WHEN cand_id % 5 = 0 THEN NULL ELSE 1 - (cand_id % 20) / 100 END AS pc FROM pairs)
SELECT s1_id, cand_id FROM x WHERE (prob < 0.97 AND pow(coalesce(pc, 0.5), 2.55) < 0.78) OR pc < 0.9""",
        "toggle_remove": f"{w} SELECT s1_id, cand_id FROM chosen EXCEPT SELECT s1_id, cand_id FROM pairs WHERE nk = 'R'",
        "toggle_add": f"{w} SELECT s1_id, cand_id FROM chosen UNION SELECT s1_id, cand_id FROM pairs WHERE nk = 'R' AND prob >= 0.45",
        "sibling_expansion": f"""{w}, pool AS (SELECT p_partkey AS cand_id, p_brand AS k1, CAST(p_size AS VARCHAR) || CAST(p_partkey % 97 AS VARCHAR) AS k2 FROM part), m AS (SELECT s1_id, cand_id FROM chosen WHERE prob >= 0.9),
o AS (SELECT k1, k2, min(s1_id) AS s1_id FROM m JOIN pool USING (cand_id) GROUP BY 1, 2 HAVING min(s1_id) = max(s1_id))
SELECT o.s1_id, p.cand_id FROM pool p JOIN o USING (k1, k2) WHERE p.cand_id NOT IN (SELECT cand_id FROM m)""",
        "macro_f05_report": f"""{w} SELECT country, round(avg(f), 6) AS macro_f05, round(CASE WHEN sum(np) > 0 THEN sum(tp) / sum(np) ELSE 0.0 END, 6) AS pair_p, round(CASE WHEN sum(nt) > 0 THEN sum(tp) / sum(nt) ELSE 0.0 END, 6) AS pair_r,
round(avg(CASE WHEN nt = 0 THEN f END), 6) AS singletons, count(*) AS entities FROM scored GROUP BY ROLLUP (country)""",
        "size_vs_score": f"{w} SELECT nt, round(avg(f), 6) AS f05, count(*) AS entities FROM scored GROUP BY 1",
        "error_attribution": f"""{w}, b AS (SELECT * FROM pairs WHERE prob >= 0.2), k AS (SELECT * FROM b QUALIFY prob = max(prob) OVER (PARTITION BY cand_id)),
l AS (SELECT CASE WHEN c.s1_id IS NOT NULL THEN 'found' WHEN b.s1_id IS NULL THEN 'blocking' WHEN k.s1_id IS NULL THEN 'filter' ELSE 'decision' END AS stage FROM truth t LEFT JOIN b USING (s1_id, cand_id) LEFT JOIN k USING (s1_id, cand_id) LEFT JOIN chosen c USING (s1_id, cand_id))
SELECT stage, count(*) AS n FROM (SELECT stage FROM l UNION ALL SELECT 'false' FROM chosen c WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.s1_id = c.s1_id AND t.cand_id = c.cand_id)) GROUP BY 1""",
        "text_normalisation": r"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(t, '[^a-z0-9]+'), lambda x: x <> ''), ' ')) AS tokens, md5(translate(replace(t, 'rn', 'm'), 'l', 'i')) AS folded,
array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '[0-9]+'), lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END))), ',') AS nums, regexp_matches(t, '[^\x{0000}-\x{024F}]') AS non_latin FROM d""",
        "id_lists": f"{w} SELECT u.s1_id, coalesce(ids, '') AS ids FROM universe u LEFT JOIN (SELECT s1_id, string_agg(CAST(cand_id AS VARCHAR), ',' ORDER BY CAST(cand_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT s1_id, cand_id FROM chosen) GROUP BY 1) x USING (s1_id)",
        "validator": f"{w} SELECT rule, CAST(0 AS BIGINT) AS n FROM (VALUES ('missing'), ('extra'), ('repeated_key'), ('repeated_id'), ('outside')) r(rule)",
    } | linkage.oracle_sql() | scoring.oracle_sql()
