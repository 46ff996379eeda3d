"""Nearest neighbours are the true ones on rows of many kinds: no direction preferred, many components, wide lengths, copies."""

import numpy as np
import pytest
from loamweave.llm import ann


def rows(kind):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2500, 192))
    if kind == "lengths":
        return x[:, :24] * rng.lognormal(0, 1.5, (len(x), 1)) * 1e60
    if kind == "copies":
        return x[rng.integers(0, 40, len(x)), :16]
    return x


@pytest.mark.parametrize("kind", ["wide", "lengths", "copies"])
def test_the_nearest_are_found_on_any_rows(spark, kind):
    x = rows(kind)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.query(d).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, len(x), 20))
    for q, found in got.items():
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -s))[:20]
        assert [v for v, _ in found] == want.tolist() and np.allclose([e for _, e in found], s[want], rtol=1e-12)


def test_few_rows_are_scored_where_groups_lie_apart():
    rng = np.random.default_rng(2)
    centres = np.repeat(rng.normal(size=(50, 32)), 60, axis=0)
    x = centres + 0.02 * rng.normal(size=centres.shape)
    ix = ann.Index(x.astype(np.float32), 200)
    codes, ratio, rest = ix.encode(x)
    made = ratio[:, None] * ix.codes[np.arange(16), codes].astype(float).sum(axis=1)
    exact, bound = x @ x.T, x @ made.T + np.linalg.norm(x, axis=1)[:, None] * rest
    assert (bound >= exact).all()
    assert (bound >= np.sort(exact, axis=1)[:, -20:-19]).mean() < 0.05  # of all pairs
