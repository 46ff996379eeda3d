"""String similarity kernels, and Arrow UDFs of them.

Run them on distinct pairs.  Values are 0 to 100; two empty strings are 100 for ``ratio`` and 0 for the
token set ratio, which is 0 if either side is empty.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the characters of ``a``."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for ch in b:
        hit = rows & places.get(ch, 0)
        rows = ((rows + hit) | (rows - hit)) & full
    return len(a) - rows.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 * 2 * lcs(a, b) / total if total else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = sorted(x & y)
    if both and (x <= y or y <= x):
        return 100.0
    base, left, right = " ".join(both), sorted(x - y), sorted(y - x)
    p, q = " ".join([*both, *left]), " ".join([*both, *right])
    best = ratio(p, q)
    return max(best, ratio(base, p), ratio(base, q)) if both else best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer one, windows at the edges included."""
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    if not s:
        return 100.0 if not t else 0.0
    n = len(s)
    return max(ratio(s, t[max(0, i) : i + n]) for i in range(1 - n, len(t)))


def jaro_winkler(a: str, b: str) -> float:
    if not a or not b:
        return 0.0 if a or b else 100.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, mine = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                mine.append(ch)
                break
    m = len(mine)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(mine, (b[j] for j in range(len(b)) if used[j]), strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i in range(min(4, len(a), len(b))) if a[i] != b[i]), min(4, len(a), len(b)))
    return 100.0 * (jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro)


def damerau(a: str, b: str) -> int:
    """Edits with transpositions, further edits between transposed letters allowed."""
    far = len(a) + len(b)
    last: dict[str, int] = {}
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    for i in range(1, len(a) + 1):
        seen = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), seen
            same = a[i - 1] == b[j - 1]
            if same:
                seen = j
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


KERNELS = {"ratio": ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio, "partial": partial_ratio, "jaro_winkler": jaro_winkler, "damerau": damerau}


def similarity(spark: SparkSession, name: str, a: Column, b: Column) -> Column:
    """One kernel as an Arrow UDF over two string columns (null: empty)."""
    ship(spark)
    kernel = KERNELS[name]

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([float(kernel(p or "", q or "")) for p, q in zip(x, y, strict=True)])

    return run(a, b)
