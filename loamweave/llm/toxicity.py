"""Operator 1: toxic spans by a linear-chain conditional random field.

Two labels, a position per word (in lower case, split at white space and ASCII punctuation).  The
label scores are sums of weights of the word, of its first 5 to 8 bytes, and of its two neighbours,
and a 2 x 2 table of transitions.  Training labels are given per document; labelled tokens come from
them: a word is toxic where it stands in a toxic text and it, or one of its beginnings, has a smoothed
document-frequency ratio between toxic and other training texts of at least ``ratio``.  The field is
fitted to these tokens by gradient steps on the exact conditional likelihood.  Features that hardly
differ between the labels and are not frequent either have no weight.

Forward-backward gives each word's marginal.  A document's score is a calibrated logistic function
of the largest marginal and of the sum of all marginals' squares; words with a marginal of 0.5 or
more, joined where they are adjacent, are the offending spans.

Forward and backward passes are products of 2 x 2 matrices, reset at each text's edges.  They run
over a whole batch at once: the words are cut into lanes, the lanes' products are scanned (by the
same function), and all lanes then step together.

Learning takes at most ``per_class`` texts of each label of up to ``max_chars`` characters.

Defined results: null text counts as empty; a text without words gets the score of "no toxic word".
With no toxic or no other training text, the score is 0 for all (1 if only toxic ones are known).
Repeated rows are scored alike; null ids are not held out and teach nothing.  Further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import fold, id_type, labelled_sample, shared

LANE, PREFIXES = 64, (5, 6, 7, 8)
_SPLIT = ta.IS_PUNCT


def _prefix_states(m: np.ndarray) -> np.ndarray:
    """States after each step: v_t = v_(t-1) M_t from v = (1, 1), each scaled to sum 1.  m: (n, 2, 2)."""
    n = len(m)
    out = np.empty((n, 2))
    if n <= 4 * LANE:
        a, b = 0.5, 0.5
        for t, ((p, q), (r, s)) in enumerate(m.tolist()):
            a, b = a * p + b * r, a * q + b * s
            z = a + b
            a, b = a / z, b / z
            out[t] = a, b
        return out
    lanes = -(-n // LANE)
    full = np.empty((lanes * LANE, 2, 2))
    full[:n] = m
    full[n:] = np.eye(2)
    full = full.reshape(lanes, LANE, 2, 2)
    p = [full[:, 0, i, j].copy() for i in (0, 1) for j in (0, 1)]
    for t in range(1, LANE):
        x = full[:, t]
        p = [p[0] * x[:, 0, 0] + p[1] * x[:, 1, 0], p[0] * x[:, 0, 1] + p[1] * x[:, 1, 1], p[2] * x[:, 0, 0] + p[3] * x[:, 1, 0], p[2] * x[:, 0, 1] + p[3] * x[:, 1, 1]]
        z = 1 / (p[0] + p[1] + p[2] + p[3])
        p = [q * z for q in p]
    states = _prefix_states(np.stack(p, 1).reshape(lanes, 2, 2))
    a, b = np.full(lanes, 0.5), np.full(lanes, 0.5)
    a[1:], b[1:] = states[:-1, 0], states[:-1, 1]
    result = out if lanes * LANE == n else np.empty((lanes * LANE, 2))
    view = result.reshape(lanes, LANE, 2)
    for t in range(LANE):
        x = full[:, t]
        a, b = a * x[:, 0, 0] + b * x[:, 1, 0], a * x[:, 0, 1] + b * x[:, 1, 1]
        z = 1 / (a + b)
        a, b = a * z, b * z
        view[:, t, 0], view[:, t, 1] = a, b
    return result[:n]


def forward_backward(e: np.ndarray, trans: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of label 1, and the scaled forward and backward states.

    e: score of label 1 over label 0 for each word; trans: scores of label pairs; first, last: flags
    of the texts' edges.
    """
    w = np.exp(np.clip(e, -30, 30))
    t = np.exp(trans)
    m = np.empty((len(e), 2, 2))
    m[:, :, 0], m[:, :, 1] = t[:, 0], t[:, 1] * w[:, None]
    m[first, :, 0] = 1.0
    m[first, :, 1] = w[first, None]
    f = _prefix_states(m)
    back = np.empty((len(e), 2, 2))
    # v_t(y) = sum over y' of v_(t+1)(y') * w(y') * t[y, y'], read from the end
    back[:-1, 0, :], back[:-1, 1, :] = t[:, 0], t[:, 1] * w[1:, None]
    if len(e):
        back[-1] = 1.0
    back[last] = 1.0
    b = _prefix_states(back[::-1])[::-1]
    both = f * b
    return both[:, 1] / both.sum(axis=1), f, b


class Model:
    def __init__(self):
        self.lookup, self.weights = ta.Lookup(np.zeros(0, np.uint64)), np.zeros((3, 1), np.float32)
        self.trans, self.bias = np.zeros((2, 2)), -40.0
        self.curve = np.array([0.0, 0.0, -40.0])

    def places(self, feats: list[np.ndarray]) -> list[np.ndarray]:
        """Each feature's column of ``weights``; the last column is zero and stands for all others."""
        return [self.lookup.find(f) for f in feats]

    def emission(self, k: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """weights: as the word's own feature, as the word before, as the word after."""
        e = self.weights[0][k[0]].astype(float) + self.bias
        for x in k[1:]:
            e += self.weights[0][x]
        e[1:] += np.where(first[1:], 0, self.weights[1][k[0][:-1]])
        e[:-1] += np.where(last[:-1], 0, self.weights[2][k[0][1:]])
        return e

    def score(self, top: np.ndarray, total: np.ndarray) -> np.ndarray:
        x = self.curve[0] * top + self.curve[1] * np.log1p(total) + self.curve[2]
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _lower(data: np.ndarray) -> np.ndarray:
    """A-Z and the Latin-1 capitals in lower case."""
    out = ta.FOLD[data]
    if len(out) > 1:
        b = data[1:]
        out[1:][(data[:-1] == 0xC3) & (b >= 0x80) & (b <= 0x9E) & (b != 0x97)] += 32
    return out


def tokens(texts: pa.Array):
    """For slices of texts: rows, bytes, boundaries, word starts and ends, words before each text, features, edge flags."""
    for i, j, data, bounds in ta.slices(texts):
        s, e, at = ta.words(data, bounds, _SPLIT)
        first, last = np.zeros(len(s), bool), np.zeros(len(s), bool)
        full = np.flatnonzero(np.diff(at) > 0)
        first[at[full]], last[at[full + 1] - 1] = True, True
        yield i, j, data, bounds, s, e, at, ta.prefix_hashes(_lower(data), s, e, PREFIXES), first, last


def _summaries(p: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest marginal of each text and the sum of all marginals' squares, so that small ones hardly add up over long texts."""
    top, total = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        top[full] = np.maximum.reduceat(p, at[full])
        total[full] = np.add.reduceat(p * p, at[full])
    return top, total


def train(texts: list[str], toxic: np.ndarray, ratio: float = 8.0, steps: int = 40, ridge: float = 1e-4) -> Model:
    """Fit the field and the curve to labelled texts."""
    model = Model()
    if not toxic.any() or toxic.all():
        model.curve[2] = 40.0 if len(toxic) and toxic.all() else -40.0
        return model
    parts = list(tokens(pa.array(texts, pa.string())))
    feats = [np.concatenate([x[7][f] for x in parts]) for f in range(len(PREFIXES) + 1)]
    first, last = np.concatenate([x[8] for x in parts]), np.concatenate([x[9] for x in parts])
    sizes = np.concatenate([np.diff(x[6]) for x in parts])
    doc = np.repeat(np.arange(len(texts)), sizes)
    # document frequencies of the features in toxic and other texts
    every, where = np.unique(np.concatenate(feats), return_inverse=True)
    pairs = np.unique(np.tile(doc, len(feats)) * len(every) + where)
    n = [np.bincount((pairs % len(every))[toxic[pairs // len(every)] == v], minlength=len(every)) for v in (False, True)]
    lift = ((n[1] + 0.5) / (toxic.sum() + 1)) / ((n[0] + 0.5) / ((~toxic).sum() + 1))
    # labelled tokens, and the features that get weights
    bad = (lift >= ratio) & (n[1] >= 4)
    where = where.reshape(len(feats), -1)
    y = bad[where].any(axis=0) & toxic[doc]
    frequent = n[0] + n[1] >= np.sort(n[0] + n[1])[-min(len(every), 2000)]
    keep = np.flatnonzero(frequent | ((lift >= ratio / 2) & (n[1] >= 3)))
    model.lookup = ta.Lookup(every[keep])
    k = model.places(feats)
    # Adagrad on the conditional likelihood
    w, sq = np.zeros((3, len(keep) + 1)), np.full((3, len(keep) + 1), 1e-8)
    trans, tsq, bias, bsq = np.zeros((2, 2)), np.full((2, 2), 1e-8), -2.0, 1e-8
    link = ~first[1:]
    size = max(1.0, float(y.sum()))
    for _ in range(steps):
        e = w[0][np.array(k)].sum(axis=0) + bias
        e[1:] += np.where(link, w[1][k[0][:-1]], 0)
        e[:-1] += np.where(link, w[2][k[0][1:]], 0)
        p, f, b = forward_backward(e, trans, first, last)
        d = (y - p) / size
        count = lambda x, v: np.bincount(x + 1, v, len(keep) + 1)
        g = np.stack([
            sum(count(x, d) for x in k),
            count(k[0][:-1], np.where(link, d[1:], 0)),
            count(k[0][1:], np.where(link, d[:-1], 0)),
        ])
        g = np.roll(g, -1, axis=1) - ridge * w
        g[:, -1] = 0
        right = b[1:] * np.stack([np.ones(len(e) - 1), np.exp(np.clip(e[1:], -30, 30))], 1)
        pair = f[:-1, :, None] * np.exp(trans) * right[:, None, :]
        pair = (pair / pair.sum(axis=(1, 2), keepdims=True))[link].sum(axis=0)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:-1][link].astype(int), y[1:][link].astype(int)), 1)
        tg, bg = (seen - pair) / size - ridge * trans, d.sum()
        sq, tsq, bsq = sq + g * g, tsq + tg * tg, bsq + bg * bg
        w += 0.5 * g / np.sqrt(sq)
        trans += 0.2 * tg / np.sqrt(tsq)
        bias += 0.5 * bg / np.sqrt(bsq)
    model.weights, model.trans, model.bias = w.astype(np.float32), trans, float(bias)
    # the curve, by Newton steps with a small ridge
    p, _, _ = forward_backward(model.emission(k, first, last), trans, first, last)
    top, total = _summaries(p, np.concatenate([[0], np.cumsum(sizes)]))
    a = np.column_stack([top, np.log1p(total), np.ones(len(top))])
    c = np.zeros(3)
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(a @ c, -40, 40)))
        hess = (a * (q * (1 - q))[:, None]).T @ a + np.diag([0.5, 0.5, 1e-3])
        step = np.linalg.solve(hess, a.T @ (toxic - q) - np.array([0.5, 0.5, 1e-3]) * c)
        c += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    model.curve = c
    return model


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, per_class: int = 1000, max_chars: int = 6000, label: str = "toxic") -> Model:
    rows = sorted((r["_id"], r["_text"], r["_y"]) for r in labelled_sample(docs, labels, label, modulus, held, per_class, max_chars).collect())
    return train([r[1] for r in rows], np.array([r[2] == 1 for r in rows], bool))


def tag(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted, n_toxic and spans (array<struct<start, end, p>>, in characters) for every row of (doc_id, text)."""
    held = shared(docs, model)  # weights of features of the bounded training sample
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches):
        m = held.value
        for batch in batches:
            n = batch.num_rows
            score, found, spans = np.empty(n), np.zeros(n, np.int64), [[] for _ in range(n)]
            for i, j, data, bounds, s, e, at, feats, first, last in tokens(batch.column("_text")):
                p, _, _ = forward_backward(m.emission(m.places(feats), first, last), m.trans, first, last)
                top, total = _summaries(p, at)
                score[i:j] = m.score(top, total)
                hit = np.flatnonzero(p >= 0.5)
                if len(hit):
                    row = np.searchsorted(at, hit, "right") - 1
                    found[i:j] = np.bincount(row, minlength=j - i)
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    base = chars[bounds]
                    previous = -2
                    for x, r in zip(hit.tolist(), row.tolist(), strict=True):
                        a, z = int(chars[s[x]] - base[r]), int(chars[e[x]] - base[r])
                        out = spans[i + r]
                        if previous == x - 1 and not first[x]:
                            out[-1]["end"], out[-1]["p"] = z, max(out[-1]["p"], float(p[x]))
                        else:
                            out.append({"start": a, "end": z, "p": float(p[x])})
                        previous = x
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(found), pa.array(spans, span)],
                names=["doc_id", "score", "predicted", "n_toxic", "spans"],
            )

    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    return d.mapInArrow(run, f"doc_id {id_type(docs)}, score double, predicted int, n_toxic long, spans array<struct<start:int,end:int,p:double>>")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return tag(docs, learn(docs, labels)).select("doc_id", held, "score", "predicted", "n_toxic", "spans")
