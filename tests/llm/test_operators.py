"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and odd inputs."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamweave.llm import ann, brown_lm, compression_quality, language_id, mixing, pieces, quality_rules, set_join, surrogates, toxicity
from loamweave.llm import textarrays as ta
from loamweave.llm.components import components

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _text string"
ODD = [
    (1, None, "en", "a", 0, 1.0, "x"), (2, "", None, None, None, 1.0, "x"), (3, "word", "en", "a", 4, 1.0, "x"), (3, "word", "en", "a", 4, 1.0, "x"),
    (None, "no id here", "en", None, 10, 1.0, "x"), (4, "\t\n  ", "de", "b", 5, 1.0, "x"), (5, "lorem ipsum " * 30000, "en", "a", 1, 1.0, "x"), (6, "123 !!! 456", "fr", "b", 11, 1.0, "x"),
    (7, "ÀÉ ▁ a  b c \U0001f600", "fr", "b", 11, 1.0, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


OPERATORS = {
    "toxicity": lambda d, l: toxicity.query(d, l),
    "pieces": lambda d, l: pieces.query(d),
    "surrogates": lambda d, l: surrogates.query(d, "k"),
    "set_join": lambda d, l: set_join.query(d),
    "compression": lambda d, l: compression_quality.query(d, l),
    "brown_lm": lambda d, l: brown_lm.query(d),
    "mixing": lambda d, l: mixing.query(d),
    "language": lambda d, l: language_id.query(d),
    "rules": lambda d, l: quality_rules.assess(d, l),
    "mixed": lambda d, l: mixing.mixed(d),
    "distinct": lambda d, l: set_join.distinct(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_inputs(odd, empty, labels, name):
    n = OPERATORS[name](odd, labels).count()
    assert n == len(ODD) or name in ("mixed", "distinct")
    assert OPERATORS[name](empty, labels).count() == 0


def test_components_match_union_find(spark):
    rng = np.random.default_rng(1)
    edges = rng.integers(0, 400, (300, 2))
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        f, g = find(a), find(b)
        parent[max(f, g)] = min(f, g)
    got = components(spark.createDataFrame([(int(a), int(b)) for a, b in edges], "a long, b long"), "a", "b").collect()
    assert all(r.comp == find(r.id) for r in got) and len(got) == len({int(x) for a, b in edges if a != b for x in (a, b)})


def test_set_join_is_exact(docs):
    sets = {r.doc_id: frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if (w := words(r.text)) else frozenset() for r in docs.collect()}
    lists, parent = collections.defaultdict(set), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            lists[x].add(i)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {(a, b) for l in lists.values() if len(l) < 200 for a in l for b in l if a < b}:
        o = len(sets[a] & sets[b])
        if 100 * o >= 90 * len(sets[a] | sets[b]):
            f, g = find(a), find(b)
            parent[max(f, g)] = min(f, g)
    for r in set_join.query(docs).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id))


def test_language_model_base_and_gain(docs):
    rows = {r.doc_id: words(r.text) for r in docs.collect()}
    train = {i: w for i, w in rows.items() if crc(i, 10)}
    c = collections.Counter(x for w in train.values() for x in w)
    n, v = sum(c.values()) + len(train), len(c) + 1
    out = brown_lm.query(docs).collect()
    for r in out:
        w = rows[r.doc_id]
        base = sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) + np.log10((len(train) + 0.1) / (n + 0.1 * (v + 1)))
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, not crc(r.doc_id, 10))
        assert abs(r.base_score - base) < 1e-6 * abs(base)
    assert sum(r.score for r in out if r.held_out) > sum(r.base_score for r in out if r.held_out)


def test_exchange_raises_mutual_information():
    rng = np.random.default_rng(0)
    seq = np.where(np.arange(4000) % 2 == 0, rng.integers(0, 5, 4000), rng.integers(5, 10, 4000))
    m = np.zeros((10, 10))
    np.add.at(m, (seq[:-1], seq[1:]), 1)

    def information(cls):
        one = np.eye(2)[cls]
        n = one.T @ m @ one
        return np.nansum(n * np.log(n * n.sum() / np.outer(n.sum(1), n.sum(0))) if n.all() else np.where(n > 0, n * np.log(np.maximum(n, 1e-9) * n.sum() / np.outer(n.sum(1), n.sum(0))), 0))

    best = [information(brown_lm.exchange(m, 10, 2, sweeps)) for sweeps in (0, 1, 4, 12)]
    assert best == sorted(best) and best[-1] > best[0] + 1


def test_classifiers_on_held_out_rows(docs, labels):
    langs = language_id.query(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in langs]) > 0.97
    q = compression_quality.query(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good, bad = [r.score for r in q if r.quality == 1], [r.score for r in q if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.85
    t = toxicity.query(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    tox, ok = [r.score for r in t if r.toxic == 1], [r.score for r in t if r.toxic == 0]
    assert np.mean([g > b for g in tox for b in ok]) > 0.7


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(3)
    for n in (1, 2, 6, 700):
        e, trans = rng.normal(size=n), rng.normal(size=(2, 2))
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        first[0] = last[-1] = True
        if n > 2:
            first[n // 2], last[n // 2 - 1] = True, True
        got = toxicity.forward_backward(e, trans, first, last)[0]
        f, b = np.zeros((n, 2)), np.ones((n, 2))
        for t in range(n):
            prev = np.ones(2) if first[t] else f[t - 1] @ np.exp(trans)
            f[t] = prev * [1, np.exp(e[t])]
            f[t] /= f[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = np.ones(2) if last[t] else np.exp(trans) @ (b[t + 1] * [1, np.exp(e[t + 1])])
            b[t] /= b[t].sum()
        want = f * b
        assert np.allclose(got, want[:, 1] / want.sum(1))


def test_pieces_equal_the_library_in_unigram_mode():
    sp = pytest.importorskip("sentencepiece")
    v = pieces.load().build()
    raw = v.model
    m = sp.SentencePieceProcessor(model_proto=raw)
    rng = np.random.default_rng(0)
    for _ in range(50):
        text = "".join(rng.choice(list("abcde fgh  ij\né日k"), 12))
        ids, score, _ = v.encode(text)
        assert v.decode(ids) == text and m.decode(ids) == text
        seg = pieces.MARK + text.replace(" ", pieces.MARK)
        best = [0.0] + [-np.inf] * len(seg)  # brute force over all pieces
        table = {p: s for p, s, i in zip(v.text, v.score, range(len(v.text)), strict=True) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
        for j in range(1, len(seg) + 1):
            best[j] = max(best[j - 1] + v.unknown_score, *[best[i] + table[seg[i:j]] for i in range(max(0, j - 20), j) if seg[i:j] in table], -np.inf)
        assert np.isclose(score, best[-1])


def test_mixing_meets_targets_and_reruns_agree(docs):
    a, b = (sorted(map(str, mixing.query(docs).collect())) for _ in range(2))
    assert a == b
    per = mixing.query(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("w"), F.max(F.col("taken") - 3 * F.col("size")).alias("over"), F.sum("size").alias("z"), F.max("source_size").alias("s")).collect()
    assert all(abs(r.t - r.w) <= 0.02 * r.w and r.over <= 0 and r.z == r.s for r in per)
    sizes = sorted((r.source, r.s) for r in per)
    weight, want, left = {s: (5, 2, 1)[i % 3] for i, (s, _) in enumerate(sizes)}, {}, dict(sizes)
    total = float(sum(left.values()))
    while left:  # share by weight, cap, share the rest again
        share = {s: total * weight[s] / sum(weight[x] for x in left) for s in left}
        capped = [s for s in left if share[s] > 3 * left[s]]
        for s in capped or list(left):
            want[s] = min(share[s], 3 * left[s])
            total -= want[s]
        left = {} if not capped else {s: z for s, z in left.items() if s not in capped}
    assert all(abs(r.w - want[r.source]) < 1e-6 * want[r.source] for r in per)


def test_hypergeometric_has_the_right_mean(spark):
    d = spark.range(4000).select(mixing.hypergeometric(F.lit(50), F.lit(20), F.lit(10), mixing._uniform(F.lit(1), "id")).alias("x"))
    r = d.agg(F.avg("x"), F.variance("x"), F.min("x"), F.max("x")).first()
    assert abs(r[0] - 4) < 0.1 and abs(r[1] - 10 * 0.4 * 0.6 * 40 / 49) < 0.2 and r[2] >= 0 and r[3] <= 10


def test_quality_measures_by_hand(docs, labels):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in quality_rules.assess(docs, labels).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = collections.Counter(g)
        twice = {i + j for i, x in enumerate(g) if c[x] > 1 for j in range(3)}
        lines = [x for x in texts[r.doc_id].split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", texts[r.doc_id])), len(lines) - len(set(lines)), len(twice))
        assert r.base_failed == (len(w) < 50 or 100 * len(twice) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_binomial_tail(spark):
    from math import comb, log

    rows = [(n, k) for n in (10, 200) for k in (0, 1, 5)]
    d = spark.createDataFrame(rows, "n long, k long").select("n", "k", quality_rules.log_binomial_tail(F.col("n"), F.col("k"), 0.05).alias("p"))
    for r in d.collect():
        assert abs(r.p - log(sum(comb(r.n, i) * 0.05**i * 0.95 ** (r.n - i) for i in range(r.k + 1)))) < 1e-9


def test_surrogates(spark):
    text = "Mr. John Smith, a.b@mail1.example.com, 4207051279108084, +1 (375) 555-4393, 54.158.173.199, password=e3b3ed3cc8548923d6; Mr. John Smith v 4.0."
    out = surrogates.query(spark.createDataFrame([(1, text), (2, "card 4207-0512-7910-8084 of A.B@mail1.example.com")], "doc_id long, text string"), "k").orderBy("doc_id").collect()
    a, b = out[0].text, out[1].text
    assert out[0].types == ["name", "email", "card", "phone", "ip", "secret", "name"] and "v 4.0." in a
    assert not re.search("Smith|a.b@|42070512|555-4393|54.158|e3b3ed", a)
    names = re.findall(r"Mr\. [\w-]+ \w+", a)
    assert len(names) == 2 and len(set(names)) == 1
    card = re.search(r"\d{16}", a)[0]
    assert re.search(r"\d{4}-\d{4}-\d{4}-\d{4}", b)[0].replace("-", "") == card and re.search(r"\S+@\S+", b)[0] == re.search(r"[^ ]+@[^ ,]+", a)[0]
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", a) and re.search(r"password=[0-9a-f]{18};", a)


def test_ann_recall_and_ties(spark):
    e = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    x = e.orderBy("vec_id").toPandas()
    ids, m = x.vec_id.to_numpy(), np.stack(x.embedding).astype(float)
    got = collections.defaultdict(list)
    for r in ann.query(e).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = (m * m[i]).sum(axis=1)
        s[i] = -np.inf
        top = set(ids[np.lexsort((ids, -s))[:20]])
        hits.append(len(top & {v for v, _ in got[ids[i]]}) / 20)
        assert all(abs(sc - float(m[i] @ m[np.flatnonzero(ids == v)[0]])) < 1e-12 for v, sc in got[ids[i]])
    assert np.mean(hits) >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r["rank"]) for r in ann.query(few).orderBy("query_id", "rank").collect()] == [(2, 1), (3, 2), (8, 3)]


def test_word_hashes_follow_words():
    a = pa.array(["Aa b  c", None, "", "x aa\tB"])
    out = [(ta.word_hashes(d, s, e).tolist(), at.tolist()) for _, _, d, b in ta.slices(a) for s, e, at in [ta.words(d, b)]]
    h, at = out[0]
    assert at == [0, 3, 3, 3, 6] and h[0] == h[4] and h[1] == h[5] and len(set(h)) == 4
