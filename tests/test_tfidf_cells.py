"""TF-IDF candidates over a grid of cells, with copies of texts, against all pairs."""

import collections
import math
import random

from loamweave.operators import blocking


def test_cells_and_copies_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocking, "QUERIES", 7)
    monkeypatch.setattr(blocking, "POOL", 11)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 5))) for _ in range(25)]
    pool = [(part, f"p{i:03}", rng.choice(texts)) for part in "ab" for i in range(90)]
    queries = [(part, f"q{i:03}", rng.choice(texts)) for part in "abc" for i in range(40)]
    side = lambda rows: blocking.terms(spark.createDataFrame(rows, "part string, id string, text string"), "id", "text", "part")
    d = blocking.tfidf_topk(side(queries), side(pool), k=6, max_df=0.5, part_max_df={"b": 0.3})
    got = sorted((r.part, r.s1_id, r["rank"], r.cand_id, r.cos) for r in d.collect())
    want = []
    for part in "ab":
        docs = {i: collections.Counter(t.split()) for p, i, t in pool if p == part and t}
        df = collections.Counter(w for c in docs.values() for w in c)
        idf = {w: math.log((1 + len(docs)) / (1 + n)) + 1 for w, n in df.items() if 2 <= n <= (0.3 if part == "b" else 0.5) * len(docs)}

        def unit(c, idf=idf):
            x = {w: (1 + math.log(n)) * idf[w] for w, n in c.items() if w in idf}
            norm = math.sqrt(sum(v * v for v in x.values()))
            return {w: v / norm for w, v in x.items()}

        vectors = {i: unit(c) for i, c in docs.items()}
        for p, i, t in queries:
            x = unit(collections.Counter(t.split())) if p == part else {}
            cos = {j: round(sum(v * y.get(w, 0) for w, v in x.items()), 6) for j, y in vectors.items()}
            best = sorted((-v, j) for j, v in cos.items() if v > 0)[:6]
            want += [(part, i, n + 1, j, -v) for n, (v, j) in enumerate(best)]
    assert got == sorted(want) and len(got) > 200


def test_no_pool_or_no_common_term(spark):
    side = lambda rows: blocking.terms(spark.createDataFrame(rows, "part string, id long, text string"), "id", "text", "part")
    assert blocking.tfidf_topk(side([("a", 1, "x")]), side([]), max_df=1.0).count() == 0
    assert blocking.tfidf_topk(side([("a", 1, "x")]), side([("a", 2, "y"), ("a", 3, "y")]), max_df=1.0).count() == 0
