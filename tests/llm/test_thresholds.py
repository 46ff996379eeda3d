"""Cut-offs and verdicts against a plain-Python version with exact binomials."""

import collections
import hashlib
from fractions import Fraction
from math import comb

from loamweave.llm import quality_rules as q
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.01"


def tail(n, k, p):
    return float(sum(comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1)))


def by_hand(rows, grid, alpha, delta):
    """rows: (doc_id, stratum, failed, measures, label)."""
    held = [(i, s, m, y) for i, s, failed, m, y in rows if not failed and y in (0, 1)]
    design = [r for r in held if int(hashlib.md5(str(r[0]).encode()).hexdigest()[:8], 16) % q.DESIGN == 0]
    rest = [r for r in held if r not in design]
    strata, out = {r[1] for r in held}, {}
    for s in strata:
        steps = []
        for i, (rule, cuts) in enumerate(grid.items()):
            for j, c in enumerate(cuts):
                n = collections.Counter(y for _, t, m, y in design if t == s and m[rule] > c)
                if n[0] > n[1]:
                    steps.append((n[1] / (n[0] + n[1]), -n[0], i, j, rule, c))
        steps.sort()
        good = [m for _, t, m, y in rest if t == s and y == 1]
        bad = [m for _, t, m, y in rest if t == s and y == 0]
        hit = lambda m, k: any(m[r] > c for *_, r, c in steps[:k])
        best = None
        for k in range(1, len(steps) + 1):
            r = sum(hit(m, k) for m in good)
            if not good or tail(len(good), r, alpha) > delta / len(strata):
                break
            gain = sum(hit(m, k) for m in bad) - r
            if gain > 0 and (best is None or gain > best[0]):
                best = gain, k
        if best:
            cuts = collections.defaultdict(list)
            for *_, r, c in steps[: best[1]]:
                cuts[r].append(c)
            out[s] = {r: min(c) for r, c in cuts.items()}
    return out


def test_cutoffs_equal_those_by_hand(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    m = q.measures(docs.select("doc_id", "text", q.stratum(F.col("lang")).alias("stratum")))
    m = m.select("doc_id", "stratum", q.base_failed(F.col("_q_base")).alias("failed"), F.col("_q_m").alias("m")).cache()
    y = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(r.doc_id, r.stratum, r.failed, r.m.asDict(), y.get(r.doc_id)) for r in m.collect()]
    for alpha, delta in ((0.05, 0.05), (0.1, 0.2)):
        got = {r.stratum: {k: v for k, v in r.asDict().items() if k != "stratum" and v is not None} for r in q.thresholds(m, labels, alpha=alpha, delta=delta).collect()}
        assert got == by_hand(rows, q.GRID, alpha, delta) and got
    kept = {r.doc_id: r for r in q.assess(docs, labels).collect()}
    cuts = by_hand(rows, q.GRID, q.ALPHA, q.DELTA)
    decided = 0
    for i, s, failed, x, _ in rows:
        no = any(x[r] > c for r, c in cuts.get(s, {}).items())
        assert kept[i].kept == (not failed and not no)
        decided += no and not failed
    assert decided > 0


def test_a_mixture_keeps_its_joint_false_rejection(spark):
    rows = [(i, f"=s{i % 2}", False, (0.5 if i % 10 == 0 else 0.1, 0.0, 0.9 if i % 7 == 0 else 0.0, 0.0, 0.0, 5.0)) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, stratum string, failed boolean, m struct<symbols:double,marks:double,capitals:double,repeats:double,dup_lines:double,long_words:double>")
    labels = spark.createDataFrame([(i, int(not (i % 10 == 0 and i % 20 < 15)) if i % 7 else 1) for i in range(3000)], "doc_id long, quality int")
    for r in q.thresholds(d, labels).collect():
        # capitals reject every seventh document, all of them good: never certified
        assert r.capitals is None and r.symbols is not None
