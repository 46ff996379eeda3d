"""Text functions and kernels on cases worked out by hand."""

from pyspark.sql import functions as F

from loamweave.functions import similarity as sim
from loamweave.functions import text as tx


def test_kernels():
    assert sim.ratio("abcd", "abcd") == 100 and sim.ratio("", "") == 100 and sim.lcs("abcbdab", "bdcaba") == 4
    assert sim.token_set_ratio("a b", "a b c") == 100 and sim.token_set_ratio("", "a") == 0
    assert sim.token_sort_ratio("b a", "a b") == 100 and sim.damerau("ca", "abc") == 2 and sim.partial_ratio("abc", "xxabcxx") == 100
    assert abs(sim.jaro_winkler("martha", "marhta") - 96.11) < 0.01


def test_text(spark):
    rows = [("731", "731", "same"), ("0102", "102", "zeros"), ("221", "225", "one_digit_sub_small"), ("1416", "1446", "one_digit_sub_big"), ("19", "22", "near_value"), ("12", "21", "transposed"), ("731", "31", "digit_added_or_lost"), ("", "1", "na"), ("1", "99999", "far")]
    d = spark.createDataFrame(rows, "a string, b string, kind string")
    assert d.filter(tx.number_kind(F.col("a"), F.col("b")) != F.col("kind")).count() == 0
    w = spark.createDataFrame([("5ervices", "services"), ("lnc", "inc"), ("b2b", "b2b"), ("1416", "1416")], "t string, w string")
    assert [r.x for r in w.select(tx.fix_ocr(F.col("t")).alias("x")).collect()][:2] == ["services", "inc"]
