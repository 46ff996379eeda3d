"""The pipeline's near-duplicate stage on copies with scattered word edits."""

import corpus_pipeline as cp


def test_two_edits_in_a_hundred_words_are_a_near_copy(spark):
    base = [f"w{i}" for i in range(100)]
    copy = [f"x{i}" if i in (30, 70) else w for i, w in enumerate(base)]  # 86 of 106 five-word shingles, 92 of 104 three-word ones
    more = [f"x{i}" if i in (20, 50, 80) else w for i, w in enumerate(base)]  # 81 of 111: below 0.8, and further from the copy
    rows = [(3, " ".join(base)), (1, " ".join(copy)), (2, " ".join(more)), (4, "another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.one_of_each(spark, docs, "").collect()) == [1, 2, 4]
