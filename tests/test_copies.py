"""The key pass over whole documents (view B of FIXTURES.md)."""

from loamweave import registry


def test_copies_of_any_id_and_whole_texts(spark, tmp_path):
    head = "A header of more than sixty characters that many of the documents share: "
    rows = [
        (2, head + "one", "en"), (4, head + "one", "en"),  # same parity
        (6, head + "two", "en"), (7, head + "two", "en"), (9, head + "TWO!", "en"), (11, head + "TWO!", "en"),  # equal but for case and marks
        (13, head + "three", "en"), (14, head + "one", "de"),  # another text, another language
        (20, "!!!", "en"), (21, "???", "en"), (22, "!!!", "en"), (24, None, "en"), (26, None, "en"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in registry.queries()["key_pass_copies"](spark, str(tmp_path)).collect()}
    assert got == {(2, 4), (6, 7), (6, 11), (9, 7), (9, 11), (20, 22)}
