"""Common words bring candidates too: no list is dropped for its length, held as a row or not."""

import collections
import math
import random

import pytest
from loamweave.operators import blocking
from loamweave.plans import scoring


@pytest.mark.parametrize("common", [0, 3, 256])
def test_records_that_share_only_common_words(spark, monkeypatch, common):
    monkeypatch.setattr(blocking, "COMMON", common)
    monkeypatch.setattr(blocking, "POOL", 50)
    rng = random.Random(3)
    pool = [(f"p{i:03}", " ".join(["street"] + rng.choices("abcdef", k=rng.randint(0, 4)))) for i in range(130)]
    queries = [(f"q{i:03}", t) for i, t in enumerate(["street", "street a", "b c f", "street z", "", "a a b"])]
    side = lambda rows: blocking.terms(spark.createDataFrame([("", *r) for r in rows], "part string, id string, text string"), "id", "text", "part")
    got = sorted((r.s1_id, r["rank"], r.cand_id, r.cos) for r in blocking.tfidf_topk(side(queries), side(pool), k=10).collect())
    docs = {i: collections.Counter(t.split()) for i, t in pool}
    df = collections.Counter(w for c in docs.values() for w in c)
    idf = {w: math.log((1 + len(docs)) / (1 + n)) + 1 for w, n in df.items() if n >= 2}

    def unit(c):
        x = {w: (1 + math.log(n)) * idf[w] for w, n in c.items() if w in idf}
        return {w: v / math.sqrt(sum(v * v for v in x.values())) for w, v in x.items()}

    want = []
    for i, t in queries:
        x = unit(collections.Counter(t.split()))
        cos = {j: round(sum(v * unit(y).get(w, 0) for w, v in x.items()), 6) for j, y in docs.items()}
        want += [(i, n + 1, j, -v) for n, (v, j) in enumerate(sorted((-v, j) for j, v in cos.items() if v > 0)[:10])]
    assert len(want) == 50
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want, strict=True))


def test_every_business_has_candidates(spark):
    """At 2 % of a country most words of the names went; now each record has its ten."""
    d = scoring.queries()["tfidf_records"](spark, "/root/testdata/sf0.001")
    n = {r.s1_id: r["count"] for r in d.groupBy("s1_id").count().collect()}
    ids = {r.p_partkey for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()}
    assert set(n) == ids and set(n.values()) == {10}
