"""Operator 9: language identification with language-bitmask n-gram filters.

All languages' Bloom filters share their hash functions and are stored bit-sliced: slot ``i`` holds a
bit mask with a bit for each language (a word for each 64 of them), so one lookup per hash function and
an AND return all the languages that contain an n-gram.  A text's per-language popcounts are corrected for each filter's
false positives, ``(hits - f * n) / (1 - f)`` with f = (share of the filter's set bits) ** hashes, and
the largest corrected count decides.

N-grams are runs of 4 bytes of the lower-cased text with everything in ASCII that is no letter as a
space.  A language's filter holds those seen twice or more in its training sample and not more than
``ratio`` times as often, relative to the sample's size, in another language's.

Learning takes at most ``per_lang`` texts a language, by hash order of the ids: of up to ``max_chars``
characters and, where these do not suffice, the first ``max_chars`` characters of longer ones.  Any
number of languages is learned; of rows that repeat an id the first language and text in order count.

Defined results: null text or no letter: ``und`` with score 0.  Nothing learned: ``und``, 0.  No
n-gram known: the first language by name, score 0.  Ties: the first language by name.  Repeated rows
are judged alike; null ids are not held out and teach nothing.  Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import below, fold, id_type, shared

BITS, HASHES = 18, 2
_MULT = np.random.default_rng(9).integers(1, 2**32, 8, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[b for b in range(128) if not chr(b).isalpha()]] = 32


def _grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4-byte grams with at most one space, and each one's text."""
    x = _CLASS[data]
    n = len(x) - 3
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    y = x.astype(np.uint32)
    g = (y[:n] << np.uint32(24)) | (y[1 : n + 1] << np.uint32(16)) | (y[2 : n + 2] << np.uint32(8)) | y[3:]
    blank = (x == 32).astype(np.int8)
    ok = blank[:n] + blank[1 : n + 1] + blank[2 : n + 2] + blank[3:] < 2
    for k in (1, 2, 3):  # grams across a boundary of texts
        b = bounds[1:-1] - k
        ok[b[(b >= 0) & (b < n)]] = False
    at = np.flatnonzero(ok)
    return g[at], np.searchsorted(at, bounds)


def _slots(g: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((g ^ (g >> np.uint32(15))) * m) >> np.uint32(32 - bits) for m in _MULT[:HASHES]]


class Filters:
    """The learned languages, their bit-sliced filters and false positive rates."""

    def __init__(self, texts: dict[str, list[str]], bits: int = BITS, ratio: float = 3.0):
        self.langs, self.bits = sorted(texts), bits
        width = np.uint8 if len(self.langs) <= 8 else np.uint16 if len(self.langs) <= 16 else np.uint32 if len(self.langs) <= 32 else np.uint64
        words = max(1, -(-len(self.langs) // 64))
        self.slots = np.zeros((words, 1 << bits), width)
        counts = []
        for name in self.langs:
            a = pa.array([t.lower() for t in texts[name]], pa.string())
            got = [_grams(d, b)[0] for _, _, d, b in ta.slices(a)]
            counts.append(np.unique(np.concatenate(got) if got else np.zeros(0, np.uint32), return_counts=True))
        keys = np.unique(np.concatenate([k for k, _ in counts])) if counts else np.zeros(0, np.uint32)
        rate = np.zeros((len(counts), len(keys)))
        for i, (k, c) in enumerate(counts):
            rate[i, np.searchsorted(keys, k)] = np.where(c >= 2, c / max(1, c.sum()), 0)
        top = rate.max(axis=0) if len(counts) else np.zeros(0)
        for i in range(len(counts)):
            for s in _slots(keys[(rate[i] > 0) & (rate[i] * ratio >= top)], bits):
                self.slots[i // 64, s] |= width(1 << i % 64)
        filled = [np.mean((self.slots[i // 64] >> width(i % 64)) & width(1)) for i in range(len(counts))]
        self.false = np.array(filled) ** HASHES

    def counts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected popcounts (texts x languages) and the numbers of n-grams."""
        g, at = _grams(data, bounds)
        n = np.diff(at) if len(at) else np.zeros(len(bounds) - 1, np.int64)
        hits = np.zeros((len(n), len(self.langs)))
        if len(g):
            at_ = _slots(g, self.bits)
            total = np.zeros(len(g) + 1, np.int64)
            for i in range(len(self.langs)):
                if i % 64 == 0:
                    mask = np.bitwise_and.reduce([self.slots[i // 64, s] for s in at_])
                np.cumsum((mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1), out=total[1:], dtype=np.int64)
                hits[:, i] = total[at[1:]] - total[at[:-1]]
        return np.maximum(0, (hits - self.false * n[:, None]) / (1 - np.minimum(self.false, 0.999))), n


def learn(docs: DataFrame, modulus: int = 4, held: int = 2, per_lang: int = 400, max_chars: int = 8000) -> Filters:
    d = docs.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_l"), F.col("text").alias("_t")).filter(F.col("_l").isNotNull() & F.col("_t").isNotNull() & (fold(F.col("_id"), modulus) != held))
    d = d.filter(F.length("_t") > 0).withColumn("_far", F.length("_t") > max_chars)
    sizes = d.groupBy("_l", "_far").count()  # two rows a language
    # several times the rows needed, by hash, so that the ranked rows stay few at any input size
    share = F.least(F.lit(1.0), F.lit(8.0 * per_lang) / F.col("count"))
    w = Window.partitionBy("_l").orderBy("_far", F.pmod(F.xxhash64("_id"), F.lit(1 << 30)), "_id")
    some = d.select("_id", "_l", "_far").join(F.broadcast(sizes), ["_l", "_far"]).filter(below(share, "_id"))
    chosen = some.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_lang).select("_id").distinct()
    texts_ = d.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min(F.struct("_l", F.substring("_t", 1, max_chars).alias("_t"))).alias("x"))
    rows = texts_.select("x._l", "x._t").collect()  # per_lang texts of max_chars characters a language at most
    texts: dict[str, list[str]] = {}
    for r in rows:
        texts.setdefault(r[0], []).append(r[1])
    return Filters({k: sorted(v) for k, v in texts.items()})


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score for every row of (doc_id, text)."""
    held = shared(docs, filters)  # 2**BITS masks of at most 8 bytes

    def run(batches):
        f = held.value
        names = np.array([*f.langs, "und"], dtype=object)
        for batch in batches:
            best, score = np.full(batch.num_rows, len(f.langs)), np.zeros(batch.num_rows)
            if f.langs:
                for i, j, data, bounds in ta.slices(batch.column("_text")):
                    c, n = f.counts(data, bounds)
                    k = c.argmax(axis=1)
                    rest = np.sort(c, axis=1)
                    first, second = rest[:, -1], rest[:, -2] if len(f.langs) > 1 else np.zeros(len(rest))
                    best[i:j], score[i:j] = k, np.where(first > 0, (first - second) / np.maximum(first, 1e-9) * np.minimum(1, first / np.maximum(n, 1)), 0)
            ok = np.asarray(batch.column("_letter"))
            best, score = np.where(ok, best, len(f.langs)), np.where(ok, score, 0.0)
            yield pa.record_batch([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))], names=["doc_id", "lang_pred", "score"])

    d = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("_text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    return d.mapInArrow(run, f"doc_id {id_type(docs)}, lang_pred string, score double")


def query(docs: DataFrame) -> DataFrame:
    return identify(docs, learn(docs)).select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
