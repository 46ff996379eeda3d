"""Groups whose members are about as far from each other as a link allows, against all pairs."""

import random

from loamweave.llm import set_join


def test_pairs_met_in_many_lists_are_all_found(spark):
    rng, docs = random.Random(5), {}
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(120)]
        for i in range(40):
            words = list(base)
            for at in rng.sample(range(120), rng.choice((1, 2, 3, 4))):
                words[at] = f"x{rng.randrange(10**6)}"
            docs[100 * g + i] = words
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in docs.items()}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    name = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            name[a] = name[b] = min(name[a], name[b])
    steps = {}
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    out = set_join.link(frame, 80, 5, trace=lambda step, f: steps.update({step: f.count()})).collect()
    assert {r.doc_id: r.component_id for r in out} == name
    assert {r.doc_id: r.n_shingles for r in out} == {i: len(s) for i, s in sets.items()}
    assert steps["more"] > 0 and len(set(name.values())) > 3


def test_a_pair_leaves_one_list(spark):
    """The list of the first shared shingle gives all pairs, the later ones none."""
    n, far = 20, 2**63 - 1
    toks = list(range(1, 11))
    first = toks + [far] * (set_join.AHEAD - len(toks))
    rows = [(t, 100, c, t - 1, c, bytearray(set_join.BITS // 8), first) for c in range(n) for t in toks]
    live = spark.createDataFrame(rows, "tok long, size int, cid long, pos int, comp long, bits binary, first array<long>")
    got = set_join.block_pairs(live, 80)
    assert sorted((r.a, r.b) for r in got.collect()) == [(a, b) for a in range(n) for b in range(a + 1, n)]
    # the entries still carry shingle 1, so its list, left out here, is the only one to give them
    later = set_join.block_pairs(live.filter("tok > 1"), 80)
    assert later.count() == 0
