"""Text functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(c: Column) -> Column:
    """Runs of a-z and 0-9."""
    return F.filter(F.split(c, "[^a-z0-9]+"), lambda t: t != "")


def fold(c: Column) -> Column:
    """Look-alikes made equal: rn as m, l as i."""
    return F.translate(F.replace(c, F.lit("rn"), F.lit("m")), "l", "i")


def fix_ocr(t: Column) -> Column:
    """Digits read for letters, in tokens with 1 or 2 digits, at least 2 letters and more letters than digits; then a leading ln as in."""
    digits, letters = F.length(F.regexp_replace(t, "[^0-9]", "")), F.length(F.regexp_replace(t, "[^a-z]", ""))
    # fixed values: digit to letter
    fixed = F.when((letters >= 2) & digits.between(1, 2) & (letters > digits), F.translate(t, "0134568", "oieasgb")).otherwise(t)
    return F.when(fixed.startswith("ln") & (F.length(fixed) >= 3), F.concat(F.lit("in"), F.substring(fixed, 3, 1000))).otherwise(fixed)


def numbers(c: Column) -> Column:
    """The distinct digit runs, leading zeros stripped, sorted as strings."""
    stripped = F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))
    return F.array_sort(F.array_distinct(stripped))


def non_latin(c: Column) -> Column:
    """Any character above U+024F."""
    return c.rlike("[^\\x{0000}-\\x{024F}]")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(0.0)


def number_kind(a: Column, b: Column) -> Column:
    """How two digit strings differ; checked in this order."""
    n = lambda x: F.regexp_replace(x, "^0+", "")
    la, lb = F.length(a), F.length(b)
    diff = F.abs(a.try_cast("decimal(38,0)") - b.try_cast("decimal(38,0)"))
    place = lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))
    changed = F.filter(F.sequence(F.lit(1), F.greatest(la, F.lit(1))), place)
    letters = lambda x: F.array_sort(F.split(x, ""))
    long, short = F.when(la > lb, a).otherwise(b), F.when(la > lb, b).otherwise(a)
    lost = F.exists(F.sequence(F.lit(1), F.greatest(la, lb)), lambda k: F.concat(F.substr(long, F.lit(1), k - 1), F.substr(long, k + 1, F.length(long))) == short)
    return (
        F.when(a.isNull() | b.isNull() | (la == 0) | (lb == 0), "na").when(a == b, "same").when(n(a) == n(b), "zeros")
        .when((la == lb) & (letters(a) == letters(b)), "transposed").when((F.abs(la - lb) == 1) & lost, "digit_added_or_lost")
        .when((la == lb) & (F.size(changed) == 1) & (diff <= 9), "one_digit_sub_small").when((la == lb) & (F.size(changed) == 1), "one_digit_sub_big")
        .when(diff <= 20, "near_value").otherwise("far")
    )
