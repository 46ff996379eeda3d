"""Vectorised tokenising of Arrow string batches with numpy.

A batch of texts is one byte array with boundaries.  Word edges, word hashes and n-grams are found
by whole-array operations, so no Python code runs per word.  Batches are worked on in slices of at
most ``SLICE`` bytes (one text at least), which bounds the memory of a Python worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 3)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _bytes_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)


_RANDOM = _bytes_table(20)
#: A-Z as a-z; all other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: The white space of the contracts' words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII that is neither letter nor digit also separates.
IS_PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pw(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        out = []
        for p in (_P, _PINV):
            a = np.full(size, p, np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        _powers = (out[0], out[1])
        if n > 8 * SLICE:  # a giant text's tables are not kept
            big, _powers = _powers, (np.ones(1, np.uint64), np.ones(1, np.uint64))
            return big
    return _powers


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, text boundaries) for runs of texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of words before each text boundary."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    gap = space[data]
    new = np.zeros(len(data) + 1, bool)
    new[bounds] = True
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = gap[:-1]
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = gap[1:]
    solid = ~gap
    s = np.flatnonzero(solid & (before | new[:-1]))
    e = np.flatnonzero(solid & (after | new[1:])) + 1
    return s, e, np.searchsorted(s, bounds)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, fold: np.ndarray = FOLD) -> np.ndarray:
    """A 64-bit hash of each word (bytes after ``fold``), equal wherever the word is equal."""
    if not len(s):
        return np.zeros(0, np.uint64)
    pw, inv = _pw(len(data) + 1)
    c = np.empty(len(data) + 1, np.uint64)
    c[0] = 0
    np.cumsum(_RANDOM[fold][data] * pw[: len(data)], out=c[1:])
    return mix((c[e] - c[s]) * inv[s] + (e - s).astype(np.uint64))


def prefix_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of each word and of its first bytes, one array per length; a shorter word counts whole."""
    if not len(s):
        return [np.zeros(0, np.uint64)] * (len(lengths) + 1)
    pw, inv = _pw(len(data) + 1)
    c = np.empty(len(data) + 1, np.uint64)
    c[0] = 0
    np.cumsum(_RANDOM[data] * pw[: len(data)], out=c[1:])
    begin, scale = c[s], inv[s]
    out = []
    for n, length in enumerate((0, *lengths)):
        z = e if not length else np.minimum(e, s + length)
        out.append(mix((c[z] - begin) * scale + np.uint64(1000 * n)))
    return out


def shingle_hashes(h: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``n``-word shingles; a shorter text is one shingle."""
    k = [np.uint64(x) for x in _bytes_table(7)[:n]]
    m = len(h) - n + 1
    if m > 0:
        g = h[:m] * k[0]
        for j in range(1, n):
            g += h[j : m + j] * k[j]
        g = mix(g)
    out = []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if j - i >= n:
            out.append(np.unique(g[i : j - n + 1]))
        elif j > i:
            x = np.full(1, j - i, np.uint64)
            for y in range(i, j):
                x = mix(x * k[0] + h[y : y + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Lookup:
    """Open addressing over 64-bit hashes: the place of a hash in the list given, or -1."""

    def __init__(self, hashes: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(2 * len(hashes) + 1))))
        self.shift = np.uint64(64 - bits)
        size = (1 << bits) + 64
        self.keys, self.rank = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        slot, todo = (hashes >> self.shift).astype(np.int64), np.arange(len(hashes))
        self.probes = 0
        while len(todo):
            self.probes += 1
            if slot[todo].max() + 1 >= len(self.keys):
                self.keys, self.rank = np.append(self.keys, np.zeros(64, np.uint64)), np.append(self.rank, np.full(64, -1, np.int32))
            free = todo[self.rank[slot[todo]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.rank[slot[put]] = hashes[put], put
            todo = np.setdiff1d(todo, put)
            slot[todo] += 1

    def find(self, h: np.ndarray) -> np.ndarray:
        out, todo, slot = np.full(len(h), -1, np.int32), np.arange(len(h)), (h >> self.shift).astype(np.int64)
        for _ in range(self.probes):
            rank, key = self.rank[slot], self.keys[slot]
            hit = (key == h[todo]) & (rank >= 0)
            out[todo[hit]] = rank[hit]
            go = ~hit & (rank >= 0)
            todo, slot = todo[go], slot[go] + 1
            if not len(todo):
                break
        return out
