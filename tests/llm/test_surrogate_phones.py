"""Telephone numbers without three digits in a row, in texts with nothing else."""

from loamweave.llm import surrogates


def test_numbers_in_pairs_of_digits_are_replaced(spark):
    rows = ["+33 1 23 45 67 89", "+33-1-23-45-67-89", "Ruf an: +49 30 12 34 56 78".replace(":", ""), "+44 20 79 46 09 58 call", "no number + 4 here"]
    out = surrogates.query(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert [r.types for r in out] == [["phone"]] * 4 + [[]]
    assert all(r.text != t for r, t in zip(out[:4], rows, strict=False)) and out[4].text == rows[4]
    assert out[0].text.startswith("+33 ") and out[0].text.replace(" ", "-") == out[1].text
