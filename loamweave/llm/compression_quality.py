"""Operator 6: a compression classifier with zstandard dictionaries.

One dictionary is built from good and one from bad labelled texts.  A text is compressed with either;
the difference of the two sizes over the text's own size is the only feature.  A logistic curve, fitted
on labelled texts that built no dictionary, turns it into a score.

Learning takes at most ``per_class`` texts of each label of up to ``max_chars`` characters; every
second one builds the dictionaries, the others calibrate.

Defined results: null text counts as empty; an empty text has difference 0.  With one label only (or
none) the score is that label's share (0.5 without labels).  Rows are judged alone, so repeated rows
agree; null ids are not held out and teach nothing.  Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, id_type, labelled_sample, shared

LEVEL, DICT_BYTES = 3, 64 << 10


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained zstandard dictionary; with too little text to train on, the text itself."""
    joined = b"\n".join(texts)
    try:
        if len(joined) < 20 * size:
            size = max(1024, len(joined) // 20)
        # short samples, so that a few long texts cannot fill the dictionary
        parts = [t[i : i + 1000] for t in texts for i in range(0, len(t), 1000)]
        return zstandard.train_dictionary(size, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return joined[-size:]


class Model:
    def __init__(self, good: bytes, bad: bytes, slope: float = 0.0, offset: float = 0.0):
        self.good, self.bad, self.slope, self.offset = good, bad, slope, offset

    def compressors(self):
        out = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        return out

    @staticmethod
    def difference(text: bytes, pair) -> float:
        """(size with the bad dictionary - size with the good one) / size of the text."""
        return (len(pair[1].compress(text)) - len(pair[0].compress(text))) / len(text) if text else 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset by Newton steps, on the standardised feature."""
    mean, sd = x.mean(), x.std() or 1.0
    a = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * len(x) * np.eye(2) * [1, 0] + 1e-9 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * len(x) * w * [1, 0])
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w[0] / sd, w[1] - w[0] * mean / sd


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, per_class: int = 1000, max_chars: int = 8000, label: str = "quality") -> Model:
    rows = sorted((r["_id"], r["_y"], r["_text"].encode()) for r in labelled_sample(docs, labels, label, modulus, held, per_class, max_chars).collect())
    of = [[t for _, y, t in rows if y == v] for v in (0, 1)]
    if not of[0] or not of[1]:
        share = 0.5 if not rows else float(bool(of[1]))
        return Model(b"", b"", 0.0, 40 * (2 * share - 1))
    m = Model(*[_dictionary(of[v][::2], DICT_BYTES) for v in (1, 0)])
    pair = m.compressors()
    x, y = zip(*[(m.difference(t, pair), v) for v in (0, 1) for t in (of[v][1::2] or of[v])], strict=True)
    m.slope, m.offset = logistic(np.array(x), np.array(y, float))
    return m


def classify(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted and the difference for every row of (doc_id, text)."""
    held = shared(docs, model)  # two dictionaries of DICT_BYTES

    def run(batches):
        m = held.value
        pair = m.compressors() if m.good else None
        for batch in batches:
            x = np.array([m.difference(t.as_buffer().to_pybytes(), pair) if pair and t.is_valid else 0.0 for t in batch.column("_text")])
            s = m.score(x)
            yield pa.record_batch([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(x)], names=["doc_id", "score", "predicted", "difference"])

    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    return d.mapInArrow(run, f"doc_id {id_type(docs)}, score double, predicted int, difference double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return classify(docs, learn(docs, labels)).select("doc_id", held, "score", "predicted", "difference")
