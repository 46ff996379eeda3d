"""Head words outside the exchange's seed get classes."""

import numpy as np

from loamweave.llm import brown_lm


def test_words_outside_the_seed_have_class_contexts(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        a, b = rng.integers(0, 30, 40), rng.integers(0, 30, 40)
        rows.append((i, " ".join(x for p, q in zip(a, b, strict=True) for x in (f"a{p}", f"b{q}"))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, counts = brown_lm.learn(docs, cluster=12, classes=2)
    out = brown_lm.score(docs, model, counts).collect()
    # words of one kind follow those of the other: one of 30 words, not of 60
    per = -sum(r.score for r in out) / sum(r.n_tokens for r in out)
    assert per < np.log10(30) + 0.05
    assert counts.count() == 60 == len(model.counts) and model.ids[1:].max() < 2


def test_gains_are_those_of_the_information():
    rng = np.random.default_rng(5)
    # ids 0-7 seed words of classes 0-2, 8-10 words to be placed (class 3), 11 the tail (4), 12 the end (5)
    cls = np.array([0, 1, 2, 0, 1, 2, 0, 1, 3, 3, 3, 4, 5])
    m = rng.integers(0, 30, (13, 13)).astype(float)
    m[[8, 9, 10], [8, 9, 10]] = 0
    phi = lambda x: np.sum(x[x > 0] * np.log(x[x > 0]))

    def information(c):
        one = np.eye(6)[c]
        n = one.T @ m @ one
        return phi(n) - phi(n.sum(1)) - phi(n.sum(0))

    one = np.eye(6)[cls]
    after, before = m @ one, m.T @ one
    row, g, c = (np.array(x) for x in zip(*[(w, s * 6 + k, v) for w in range(3) for s, t in enumerate((after, before)) for k, v in enumerate(t[8 + w]) if v], strict=True))
    got = brown_lm.gains(one.T @ m @ one, 3, row, g, c.astype(float))
    for w in range(3):
        want = np.array([information(np.where(np.arange(13) == 8 + w, k, cls)) for k in range(3)])
        assert np.allclose(got[w] - got[w][0], want - want[0])
