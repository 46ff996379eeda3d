"""DuckDB SQL of the queries whose whole result SQL can express.  Not: fitted models, searches by codes, keyed hashes, pieces."""

from __future__ import annotations

from .quality_rules import ALPHA, DELTA, DESIGN, GRID

_WORDS = r"'[^\x20\x09-\x0D]+'"

SET_JOIN = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS x FROM d
), e AS (
  SELECT doc_id, len(x) AS n, unnest(x) AS t FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * b.n >= 90 * a.n AND 100 * a.n >= 90 * b.n
  GROUP BY 1, 2 HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
), g AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r(id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.id
)
SELECT s.doc_id, CAST(len(x) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT id, min(c) AS component_id FROM r GROUP BY 1) m ON m.id = s.doc_id
"""

_PAIRS = ", ".join(f"({i + 1}, {j}, CAST({c} AS DOUBLE))" for i, cs in enumerate(GRID.values()) for j, c in enumerate(cs))

QUALITY_RULES = rf"""
WITH t AS (
  SELECT doc_id, lang, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
    SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM t WHERE len(w) > 2)
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM win, (VALUES (0), (1), (2)) v(k) WHERE c > 1 GROUP BY 1
), c AS (
  SELECT t.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(x, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(regexp_extract_all(x, '[!?]')) AS marks, len(regexp_extract_all(x, '\p{{Lu}}')) AS capitals,
    list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, {_WORDS})) AS lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN rep ON rep.doc_id = t.doc_id
), m AS (
  SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce('=' || lang, 'null') AS stratum,
    [CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END, CASE WHEN n_words > 0 THEN marks / n_words ELSE 0 END, CASE WHEN word_chars > 0 THEN capitals / word_chars ELSE 0 END,
     CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END, CASE WHEN len(lines) > 0 THEN (len(lines) - len(list_distinct(lines))) / len(lines) ELSE 0 END,
     CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END] AS v
  FROM c
), pairs(rule, j, cutoff) AS (VALUES {_PAIRS}
), held AS (
  SELECT m.doc_id, stratum, v, y.y, CAST('0x' || substr(md5(CAST(m.doc_id AS VARCHAR)), 1, 8) AS BIGINT) % {DESIGN} = 0 AS design
  FROM m JOIN (SELECT doc_id, max(quality) AS y FROM labels WHERE quality IN (0, 1) GROUP BY 1) y ON y.doc_id = m.doc_id WHERE NOT base_failed
), designed AS (
  SELECT stratum, rule, j, cutoff, count(*) FILTER (y = 1) AS good, count(*) FILTER (y = 0) AS bad FROM held, pairs WHERE design AND v[rule] > cutoff GROUP BY ALL
), step AS (
  SELECT stratum, rule, cutoff, row_number() OVER (PARTITION BY stratum ORDER BY good / (good + bad), bad DESC, rule, j) AS k FROM designed WHERE bad > good
), hit AS (
  SELECT h.doc_id, h.stratum, h.y, min(k) AS k FROM held h JOIN step s ON s.stratum = h.stratum AND v[rule] > cutoff WHERE NOT design GROUP BY ALL
), n AS (
  SELECT stratum, count(*) FILTER (y = 1) AS n FROM held WHERE NOT design GROUP BY 1
), cum AS (
  SELECT stratum, k, sum(count(*) FILTER (y = 1)) OVER w AS good, sum(count(*) FILTER (y = 0)) OVER w AS bad FROM hit GROUP BY 1, 2 WINDOW w AS (PARTITION BY stratum ORDER BY k)
), sure AS (
  SELECT cum.stratum, k, bad - good AS gain FROM cum JOIN n ON n.stratum = cum.stratum WHERE bad > good AND
    list_sum(list_transform(range(0, CAST(good AS BIGINT) + 1), lambda i: exp(lgamma(n.n + 1) - lgamma(i + 1) - lgamma(n.n - i + 1) + i * ln({ALPHA}) + (n.n - i) * ln(1 - {ALPHA})))) <= {DELTA} / (SELECT count(DISTINCT stratum) FROM held)
), best AS (
  SELECT stratum, arg_min(k, (-gain, k)) AS k FROM sure GROUP BY 1
), cuts AS (
  SELECT s.stratum, rule, min(cutoff) AS cutoff FROM step s JOIN best b ON b.stratum = s.stratum AND s.k <= b.k GROUP BY 1, 2
), gone AS (
  SELECT DISTINCT m.doc_id FROM m JOIN cuts ON cuts.stratum = m.stratum WHERE v[rule] > cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM gone) AS kept FROM m
"""

ORACLES: dict[str, str] = {"op4_set_join": SET_JOIN, "op10_quality_rules": QUALITY_RULES}
