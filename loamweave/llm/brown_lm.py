"""Operator 7: a Brown class-based bigram language model.

Words are the contracts' words with A-Z lower-cased; one end token follows each text and also stands
before its first word.  Counts cover every training text:

1. word counts, summed per batch before the shuffle;
2. bigram counts among the ``cluster`` most frequent words, with one pseudo word for the other head
   words, one for the tail and one for the end;
3. exchange clustering on the driver moves each frequent word to the class that raises the average
   mutual information of adjacent classes most, until a sweep changes nothing or ``sweeps`` are done;
   the pseudo words are classes of their own;
   Words seen once always belong to the tail, so that its class has the contexts of rare words;
4. every other head word is placed: its bigrams with the classes are counted over all training texts,
   and it joins the class for which they raise that information most (``place``);
5. bigrams of classes are counted again, with the classes of all head words;
6. P(word | before) = P(class | class before) * P(word | class), both with added counts.

Scoring looks up the ``head`` most frequent words in a table of bounded size.  All other words, known
or not, form the tail class: their numbers per text are added up at once, and their counts come from
an exact join of (text, word, occurrences) with the word counts.

Bounds: ``head`` words of 16 bytes are broadcast; ``(cluster + 3) ** 2`` bigram counts at most and a
class for each head word come to the driver.  The words of a text are never cut or sampled.

Defined results: null text: the end token alone.  Empty training: all counts 0, V is 0, score equals
the smoothed model without data.  Null id: not held out and not learned from.  Repeated rows are
scored alike, each as a row of its own.  Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import cut, fold, id_type, shared

HEAD, CLUSTER, CLASSES = 1 << 18, 1000, 48
ADD = 0.1


def _training(docs: DataFrame, modulus: int, held: int) -> DataFrame:
    return docs.filter(fold(F.col("doc_id"), modulus) != held).select(F.coalesce(F.col("text"), F.lit("")).alias("_text"))


def word_counts(train: DataFrame) -> DataFrame:
    """(w long: hash of the word, n long)."""

    shared(train, None)

    def run(batches):
        for batch in batches:
            got = []
            for _, _, data, bounds in ta.slices(batch.column("_text")):
                s, e, _ = ta.words(data, bounds)
                got.append(np.unique(ta.word_hashes(data, s, e), return_counts=True))
                if sum(len(k) for k, _ in got) > 1 << 20:
                    got = [_merge(got)]
            k, c = _merge(got)
            if len(k):
                yield pa.record_batch([pa.array(k.view(np.int64)), pa.array(c)], names=["w", "n"])

    return train.mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _merge(got: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, where = np.unique(np.concatenate([x for x, _ in got]), return_inverse=True)
    return k, np.bincount(where, np.concatenate([x for _, x in got]), len(k)).astype(np.int64)


def _ids(data, bounds, lookup: ta.Lookup, ids: np.ndarray, end: int):
    """Word boundaries of texts, hashes, ranks in the head or -1, places in the sequence, and the sequence: ids of
    a slice's words with ``end`` before each text and after the last.  ``ids`` has the tail's id, then the head's in order."""
    s, e, at = ta.words(data, bounds)
    h = ta.word_hashes(data, s, e)
    r = lookup.find(h)
    docs = len(bounds) - 1
    seq = np.full(len(r) + docs + 1, end, np.int64)
    where = np.arange(len(r)) + np.repeat(np.arange(docs), np.diff(at)) + 1
    seq[where] = ids[r + 1]
    return at, h, r, where, seq


def bigrams(train: DataFrame, lookup: ta.Lookup, ids: np.ndarray, end: int) -> np.ndarray:
    """Counts of adjacent ids (0 to ``end``) over all training texts."""
    held = shared(train, (lookup, ids))
    width = end + 1

    def run(batches):
        look, table = held.value
        for batch in batches:
            got = []
            for _, _, data, bounds in ta.slices(batch.column("_text")):
                seq = _ids(data, bounds, look, table, end)[4]
                got.append(np.unique(seq[:-1] * width + seq[1:], return_counts=True))
                if sum(len(k) for k, _ in got) > 1 << 20:
                    got = [_merge(got)]
            k, c = _merge(got)
            if len(k):
                yield pa.record_batch([pa.array((k // width).astype(np.int32)), pa.array((k % width).astype(np.int32)), pa.array(c)], names=["a", "b", "n"])

    b = train.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    m = np.zeros((width, width))
    m[b.column("a").to_numpy(), b.column("b").to_numpy()] = b.column("n").to_numpy()
    return m


def _phi(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def contexts(train: DataFrame, lookup: ta.Lookup, ids: np.ndarray, top: int, end: int) -> DataFrame:
    """(w int: rank of a head word from ``top`` on, x: its neighbours as (g, n)): g is the id after it, or end + 1 + the id before it."""
    held = shared(train, (lookup, ids))
    width = 2 * (end + 1)

    def batch_of(got):
        k, c = _merge(got)
        return pa.record_batch([pa.array((k // width).astype(np.int32)), pa.array((k % width).astype(np.int32)), pa.array(c)], names=["w", "g", "n"])

    def run(batches):
        look, table = held.value
        got = []
        for batch in batches:
            for _, _, data, bounds in ta.slices(batch.column("_text")):
                _, _, r, where, seq = _ids(data, bounds, look, table, end)
                far = r >= top
                w, p = r[far].astype(np.int64) * width, where[far]
                got.append(np.unique(np.concatenate([w + seq[p + 1], w + end + 1 + seq[p - 1]]), return_counts=True))
                if sum(len(k) for k, _ in got) > 1 << 21:
                    got = [_merge(got)]
                    if len(got[0][0]) > 1 << 20:
                        yield batch_of(got)
                        got = []
        if got:
            yield batch_of(got)

    n = train.mapInArrow(run, "w int, g int, n long").groupBy("w", "g").agg(F.sum("n").alias("n"))
    return n.groupBy("w").agg(F.sort_array(F.collect_list(F.struct("g", "n"))).alias("x"))


def gains(n: np.ndarray, classes: int, row: np.ndarray, g: np.ndarray, c: np.ndarray) -> np.ndarray:
    """What each word (0 to row[-1]) would add to the information in each of the first ``classes`` classes.

    ``n``: bigram counts of ``classes`` classes and three pseudo classes, of which the first holds all the
    words to be placed.  Word ``row`` has ``c`` neighbours ``g``, as in ``contexts``; rows are in order.
    """
    width, words = len(n), row[-1] + 1
    side, g = g // width, g % width
    after, before = np.zeros((words, width)), np.zeros((words, width))
    after[row[side == 0], g[side == 0]] = c[side == 0]
    before[row[side == 1], g[side == 1]] = c[side == 1]
    x = np.where((side == 0)[:, None], n[:classes, g].T, n[g, :classes])
    # without the word in its pseudo class
    x -= np.where((g == classes)[:, None], np.where((side == 0)[:, None], before[row, :classes], after[row, :classes]), 0)
    out = np.add.reduceat(_phi(x + c[:, None]) - _phi(x), np.flatnonzero(np.diff(row, prepend=-1)), axis=0)
    a, b, d = after[:, :classes], before[:, :classes], np.diag(n)[:classes]
    out += _phi(d + a + b) - _phi(d + a) - _phi(d + b) + _phi(d)
    for margin, more in ((n.sum(axis=1)[:classes], after), (n.sum(axis=0)[:classes], before)):
        out -= _phi(margin + more.sum(axis=1, keepdims=True)) - _phi(margin)
    return out


def place(train: DataFrame, lookup: ta.Lookup, size: int, top: int, cls: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The class of each of the ``size`` head words: that of ``cls`` for the first ``top``, the best by ``gains`` for the others."""
    if size == top:
        return cls[:top]
    one = np.eye(int(cls.max()) + 1)[cls]
    classes, end = int(cls[top]), int(cls[top + 2])
    ids = np.concatenate([[cls[top + 1]], cls[np.minimum(np.arange(size), top)]])
    held = shared(train, one.T @ m @ one)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("x")
            flat = lists.flatten()
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            g, c = flat.field("g").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(float)
            best = np.empty(b.num_rows, np.int32)
            for i in range(0, b.num_rows, 1000):
                at = slice(*np.searchsorted(row, [i, i + 1000]))
                best[i : i + 1000] = gains(held.value, classes, row[at] - i, g[at], c[at]).argmax(axis=1)
            yield pa.record_batch([b.column("w"), pa.array(best)], names=["w", "k"])

    found = contexts(train, lookup, ids, top, end).mapInArrow(run, "w int, k int").toArrow()  # head rows of 8 bytes at most
    out = np.full(size, -1, np.int64)
    out[:top] = cls[:top]
    out[found.column("w").to_numpy()] = found.column("k").to_numpy()
    return out


def exchange(counts: np.ndarray, words: int, classes: int, sweeps: int = 6) -> np.ndarray:
    """A class for each of the first ``words`` ids of a bigram count matrix; later ids keep classes of their own.

    Maximises sum N(g, h) ln N(g, h) - sum N(g) ln N(g) - sum N(h) ln N(h) by moving single words.
    """
    size = len(counts)
    extra = size - words
    total = classes + extra
    cls = np.concatenate([np.arange(words) % classes, classes + np.arange(extra)])
    c = counts.astype(float)
    one = np.zeros((size, total))
    one[np.arange(size), cls] = 1
    left, right = c @ one, (one.T @ c).T  # of each id: counts of the classes after and before it
    n = one.T @ left
    phi = _phi
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            g = cls[w]
            after, before, self_ = left[w].copy(), right[w].copy(), c[w, w]
            # without w: its own class loses the rows and columns of w
            after[g] -= self_
            before[g] -= self_
            n[g] -= after
            n[:, g] -= before
            n[g, g] -= self_
            # margins with w's own neighbours counted, wherever w goes
            rows, cols = n.sum(axis=1) + before, n.sum(axis=0) + after
            # the gain of putting w into class k: row k, column k, their crossing, and the two margins
            gain = (phi(n + after) - phi(n)).sum(axis=1) + (phi(n.T + before) - phi(n.T)).sum(axis=1)
            d = np.diag(n)
            gain += phi(d + after + before + self_) - phi(d) - (phi(d + after) - phi(d)) - (phi(d + before) - phi(d))
            gain -= phi(rows + after.sum() + self_) - phi(rows) + phi(cols + before.sum() + self_) - phi(cols)
            k = int(np.argmax(gain[:classes] - 1e-9 * (np.arange(classes) != g)))
            n[k] += after
            n[:, k] += before
            n[k, k] += self_
            if k != g:
                moved += 1
                cls[w] = k
                right[:, g] -= c[w]  # w stands before them
                right[:, k] += c[w]
                left[:, g] -= c[:, w]
                left[:, k] += c[:, w]
        if not moved:
            break
    return cls


class Model:
    """What scoring needs: the head's lookup and counts, classes, log10 transitions and class sizes."""

    def __init__(self, lookup: ta.Lookup, counts: np.ndarray, cls: np.ndarray, pair: np.ndarray, n: int, v: int, ends: int):
        """``cls``: a class for each head word; ``pair``: counts of adjacent classes, the last two the tail and the end."""
        self.lookup, self.counts, self.n, self.v, self.ends = lookup, counts, n, v, ends
        k, tail, self.end = len(pair), len(pair) - 2, len(pair) - 1
        self.ids = np.concatenate([[tail], cls]).astype(np.int64)
        back = (pair.sum(axis=0) + 1) / (pair.sum() + k)
        self.step = np.log10((pair + 5 * back) / (pair.sum(axis=1, keepdims=True) + 5))
        in_class, kinds = np.bincount(cls, counts, k), np.bincount(cls, minlength=k)
        # the tail's words are the rest, plus one place for all unknown words; the end is alone in its class
        in_class[tail], kinds[tail] = max(0, n - ends - counts.sum()), max(0, v - len(counts) - (ends > 0)) + 1
        in_class[self.end], kinds[self.end] = ends, 1
        self.size = in_class + ADD * kinds
        self.emit = np.log10(counts + ADD) - np.log10(self.size[cls]) if len(counts) else np.zeros(0)
        self.tail_size = float(np.log10(self.size[tail]))
        self.base_size = float(np.log10(n + ADD * (v + 1)))
        self.base = np.log10(counts + ADD) - self.base_size if len(counts) else np.zeros(0)


def learn(docs: DataFrame, modulus: int = 10, held: int = 0, head: int = HEAD, cluster: int = CLUSTER, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """The model, and the word counts that its tail is joined with."""
    train = _training(docs, modulus, held)
    counts = cut(word_counts(train))
    ends = train.count()
    words, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # the head: words above a count that at most ``head`` words reach, found from a histogram of some
    # hundred rows, so that no task ranks the words of all others
    step = F.floor(F.log2(F.col("n")) * 64).cast("int")
    sizes, least, total = counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect(), None, 0
    for r in sorted(sizes, key=lambda r: -r["s"]):
        total += r["k"]
        if total > head:
            break
        least = r["s"]
    rows = counts.filter(F.lit(False) if least is None else (step >= least) & (F.col("n") > 1)).toArrow()  # head rows of 16 bytes at most
    rows = rows.sort_by([("n", "descending"), ("w", "ascending")])
    hashes, n = rows.column("w").to_numpy().view(np.uint64), rows.column("n").to_numpy().astype(float)
    lookup, top = ta.Lookup(hashes), min(cluster, len(hashes))
    ids = np.concatenate([[top + 1], np.minimum(np.arange(len(hashes)), top)])
    m = bigrams(train, lookup, ids, top + 2)
    cls = exchange(m, top, min(classes, max(1, top)))
    k = int(cls[top])
    cls = place(train, lookup, len(hashes), top, cls, m)
    pair = bigrams(train, lookup, np.concatenate([[k], cls]), k + 1)
    return Model(lookup, n, cls, pair, words + ends, kinds + (ends > 0), ends), counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score for every row of (doc_id, text)."""
    held = shared(docs, model)
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"))

    def run(batches):
        m = held.value
        end_base = np.log10(m.ends + ADD) - m.base_size
        end_emit = np.log10(m.ends + ADD) - np.log10(m.size[m.end])
        for batch in batches:
            cols = [[] for _ in range(6)]
            for i, j, data, bounds in ta.slices(batch.column("_text")):
                at, h, r, _, k = _ids(data, bounds, m.lookup, m.ids, m.end)
                step = np.concatenate([[0.0], np.cumsum(m.step[k[:-1], k[1:]])])
                places = at + np.arange(len(at))  # of the end tokens in k
                known = r >= 0
                emit, base = np.zeros(len(r) + 1), np.zeros(len(r) + 1)
                if len(r):
                    emit[1:] = np.cumsum(np.where(known, m.emit[r] if len(m.emit) else 0, -m.tail_size))
                    base[1:] = np.cumsum(np.where(known, m.base[r] if len(m.base) else 0, -m.base_size))
                got = np.concatenate([[0], np.cumsum(known)])
                row = np.searchsorted(at, np.flatnonzero(~known), "right") - 1
                rest = h[~known].view(np.int64)
                tails = np.split(np.sort(rest) if len(at) == 2 else rest, np.cumsum(np.bincount(row, minlength=j - i))[:-1])
                cols[0].append(np.diff(at) + 1)
                cols[1].append(got[at[1:]] - got[at[:-1]] + (m.ends > 0))
                cols[2].append(base[at[1:]] - base[at[:-1]] + end_base)
                cols[3].append(step[places[1:]] - step[places[:-1]] + emit[at[1:]] - emit[at[:-1]] + end_emit)
                for t in tails:
                    w, c = np.unique(t, return_counts=True)
                    cols[4].append(w)
                    cols[5].append(c)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in cols[4]])]).astype(np.int32)
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in cols]
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[4].astype(np.int64))), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[5].astype(np.int32)))]
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(x) for x in flat[:2]], pa.array(flat[2].astype(float)), pa.array(flat[3].astype(float)), *lists], names=["doc_id", "n", "k", "b", "s", "w", "c"])

    out = d.mapInArrow(run, f"doc_id {id_type(docs)}, n long, k long, b double, s double, w array<long>, c array<int>")
    # numbers only; the row number is fixed by the checkpoint, so equal ids stay apart
    out = cut(out.withColumn("_row", F.monotonically_increasing_id()))
    tail = out.select("_row", F.explode(F.arrays_zip("w", "c")).alias("x")).select("_row", "x.w", "x.c")
    # occurrences of a frequent tail word are many rows of one key: summed per word first, they need no salting,
    # since a tail word is by definition rarer than every head word
    tail = tail.join(counts, "w", "left").groupBy("_row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("c")).otherwise(0)).alias("tk"), F.sum(F.log10(F.coalesce(F.col("n"), F.lit(0)) + F.lit(ADD)) * F.col("c")).alias("ts")
    )
    out = out.drop("w", "c").join(tail, "_row", "left")
    ts = F.coalesce(F.col("ts"), F.lit(0.0))
    return out.select("doc_id", F.col("n").alias("n_tokens"), (F.col("k") + F.coalesce(F.col("tk"), F.lit(0))).alias("n_known"), (F.col("b") + ts).alias("base_score"), (F.col("s") + ts).alias("score"))


def query(docs: DataFrame) -> DataFrame:
    model, counts = learn(docs)
    held = F.coalesce(fold(F.col("doc_id"), 10) == 0, F.lit(False)).alias("held_out")
    out = score(docs, model, counts)
    return out.select("doc_id", held, "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") / F.col("n_tokens")).alias("log10_perplexity"))
