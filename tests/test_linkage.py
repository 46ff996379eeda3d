"""Pair features and name changes against plain Python on the small tables."""

import __spark_entry__ as entry
from loamweave.functions import names as nm
from loamweave.functions import similarity as sim
from loamweave.operators import features
from loamweave.plans import linkage

FOLDER = "/root/testdata/sf0.001"


def test_string_features(spark):
    got = {(r.s1_id, r.cand_id): r for r in entry.queries()["pair_features"](spark, FOLDER).collect()}
    rows = linkage.joined(spark, FOLDER).collect()
    assert len(got) == len(rows) > 200
    for r in rows[:300]:
        g = got[r.s1_id, r.cand_id]
        assert g.name_tset == sim.token_set_ratio(r.q_name_core, r.c_name_core) and g.addr_ratio == sim.ratio(r.q_addr_norm, r.c_addr_norm)
        assert g.compact_jw == sim.jaro_winkler(r.q_name_compact, r.c_name_compact) and g.key_extra == features.unmatched(r.c_name_key, r.q_name_key)


def test_name_changes(spark):
    cases = [
        ("emmanuel fetes", "emmanuel amis", "swap_vocab", True), ("red bakery", "red bakery industries", "add_vocab", False), ("palma mining", "palma center", "filler_for_word", False),
        ("palma", "palma center", "add_filler", False), ("", "x", "empty", False), ("a bc", "ab c", "identical", False), ("b a", "a b", "reorder", False), ("best agro", "ba", "initialism", False),
        ("palma mining", "zorro", "brand", False), ("palma mining", "palma", "drop_word", False), ("palma minning", "palma mining", "keyeq_typo", False), ("palma mining", "palma zzyx", "swap_other", False),
    ]
    d = spark.createDataFrame([(i, i, "FR", a, b, "k", "k") for i, (a, b, _, _) in enumerate(cases)], "s1_id int, cand_id int, country string, q_name_core string, c_name_core string, q_name_key string, c_name_key string")
    vocab = spark.createDataFrame([("FR", w) for w in ["amis", "industries", "emmanuel"] + nm.folded(["center"])], "country string, word string")
    got = {r.s1_id: (r.nk, r.swapped) for r in features.name_changes(d, vocab).collect()}
    assert [got[i] for i in range(len(cases))] == [(k, s) for _, _, k, s in cases]


def test_kinds_cover_all_pairs(spark):
    d = entry.queries()["change_kinds"](spark, FOLDER)
    assert d.count() == linkage.ranked(spark, FOLDER).count() and d.filter("nk IS NULL OR nc IS NULL OR swapped IS NULL").count() == 0
