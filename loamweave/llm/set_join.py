"""Operator 4: exact similarity join of word-shingle sets with set relations.

Two documents link when 100 * |x & y| >= percent * |x | y| for their sets of ``n``-word shingles.

1. Sets.  A shingle is a 64-bit hash.  Equal sets form one class (hash of the sorted shingles).
2. Global order.  Documents are counted per hash bucket, over all documents; a set is ordered by the
   counts (as 256 levels around their mean) and the hash, so shingles that many documents share come
   last.  Any one order is right; this one keeps index lists short.  The buckets grow with the text
   (one for about ``PER_BUCKET`` words, 2**26 at most, a byte each).
3. Index.  The first ``size - ceil(size * percent) + 1`` shingles of a class are indexed with their
   position: one of them is common to any two sets that link.  An entry stays only if a set of a
   compatible size is next to it in its list, in the order of size.
4. Answers from relations.  In each list the most central set (whose indexed shingles meet most other
   sets) is a hub for all that have a compatible size; the list's other sets are dealt with in the same
   way.  A set drawn by a hash of list and set is a second hub, another one in each list, so that groups
   whose members do not all link to their centre are joined too.  Pairs of hub and member are verified.  Members of a hub are so similar that their answers
   overlap: a member's own answers are derived from its hub's component, and no pair inside a
   component is looked at again.
5. What is left.  Lists that still hold sets of several components are read again, in blocks by
   position; a block is skipped as a whole when position and sizes bound the overlap below the need, and
   pairs of one component are skipped.  Lists of frequent shingles are first dealt out by bands of
   size, each with the band below it, as sets of further bands cannot link.  An entry carries the first
   ``AHEAD`` of its class's shingles in such lists: a pair that shares an earlier one of them leaves that
   one's list and not this one, so that close groups do not give each pair once for every common shingle.

Before a pair leaves a list, the parities of ``BITS`` shingle buckets are compared: each shingle that
only one set has flips at most one parity, so more differing parities than differing shingles are
allowed rule the pair out.  Pairs that leave a list are screened once more in the same way, with as many
parities as the sets have shingles, and all that remain are verified exactly, on the whole sets.

Verification joins pairs with the sets of the classes in them.  Sets are made again from the texts of
just these classes (a bit table of their text hashes, sized by their number, selects them in one
pass).  Components are found by star steps on the edge table.  Lists of frequent shingles are split by
``SALT`` where entries are counted, and their one hub is found by aggregation and joined to the members.

Defined results: null, empty and word-free texts have 0 shingles and are components of their own.
With fewer than ``n`` words the whole sequence is one shingle.  A component is named by its smallest
doc_id; rows with a null id take part and get the name of their component (null if it has none).
Repeated rows each get a row.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import cut, id_type, shared
from .components import components

PERCENT, WORDS, PER_BUCKET, CHUNKS, SALT, BITS = 90, 3, 32, 16, 32, 256
AHEAD = 32  # 8 bytes each in every entry of a list that is read again
FREQUENT = 255  # sixteen roots above the mean: not by chance


def _sets(column: pa.Array, n: int):
    for i, j, data, bounds in ta.slices(column):
        s, e, at = ta.words(data, bounds)
        yield i, j, ta.shingle_hashes(ta.word_hashes(data, s, e), at, n)


def bucket_bits(docs: DataFrame) -> int:
    """Binary digits of the number of buckets, from the length of all texts."""
    size = docs.agg(F.coalesce(F.sum(F.length("_text")), F.lit(0))).first()[0]
    return int(min(26, max(16, np.ceil(np.log2(size / 6 / PER_BUCKET + 1)))))


def _packed(x: np.ndarray) -> bytes:
    """Counts, most of them small: which are above 0, what is above 1 of these as bytes, and the rest."""
    some = x[x > 0] - 1
    large = np.flatnonzero(some > 254)
    low = np.minimum(some, 255).astype(np.uint8)
    body = zlib.compress(low.tobytes(), 1) if len(low) else b""
    return len(body).to_bytes(4, "little") + body + np.packbits(x > 0).tobytes() + some[large].astype("<u4").tobytes()


def _unpacked(raw: bytes, size: int) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    out = np.unpackbits(np.frombuffer(raw, np.uint8, -(-size // 8), 4 + n))[:size].astype(np.uint32)
    if n:
        low = np.frombuffer(zlib.decompress(raw[4 : 4 + n]), np.uint8).astype(np.uint32)
        low[low == 255] = np.frombuffer(raw, "<u4", offset=4 + n + -(-size // 8))
        out[out > 0] += low
    return out


def bucket_levels(docs: DataFrame, n: int, bits: int) -> np.ndarray:
    """The level of each hash bucket: 128 at the mean number of documents, 8 levels to a root of the mean.  2**bits bytes."""
    shared(docs, None)
    step = (1 << bits) // CHUNKS

    def count(batches):
        total, keys, held = np.zeros(1 << bits, np.uint32), [], 0

        def add():
            if keys:
                total[:] += np.bincount(np.concatenate(keys), minlength=1 << bits).astype(np.uint32)
                keys.clear()

        for b in batches:
            for _, _, sets in _sets(b.column("_text"), n):
                keys.append((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64))
                held += len(keys[-1])
                if held > 1 << 21:
                    add()
                    held = 0
        add()
        if total.any():
            for c in range(CHUNKS):
                yield pa.record_batch([pa.array([c], pa.int32()), pa.array([_packed(total[c * step : (c + 1) * step])])], names=["c", "counts"])

    def merge(batches):
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for c, x in zip(b.column("c").to_pylist(), b.column("counts"), strict=True):
                totals.setdefault(c, np.zeros(step, np.uint64))
                totals[c] += _unpacked(x.as_buffer().to_pybytes(), step)
        for c, t in totals.items():
            packed = _packed(np.minimum(t, 0xFFFFFFFF).astype(np.uint32))
            yield pa.record_batch([pa.array([c], pa.int32()), pa.array([int(t.sum())]), pa.array([packed])], names=["c", "total", "counts"])

    parts = docs.select("_text").mapInArrow(count, "c int, counts binary").repartition(CHUNKS, "c")
    rows = parts.mapInArrow(merge, "c int, total long, counts binary").collect()  # CHUNKS rows, 4 * 2**bits bytes at most
    out, mean = np.zeros(1 << bits, np.uint8), sum(r["total"] for r in rows) / (1 << bits)
    for r in rows:
        x = _unpacked(bytes(r["counts"]), step).astype(np.float32)
        out[r["c"] * step : (r["c"] + 1) * step] = np.clip(128 + 8 * (x - mean) / max(1.0, mean) ** 0.5, 0, 255).astype(np.uint8)
    return out


def need(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of linked sets of sizes a and b: 100 * o >= percent * (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def _folded(words: np.ndarray, size: int) -> np.ndarray:
    """Parities of fewer buckets: halves are added until ``size`` entries are left."""
    while len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def signatures(docs: DataFrame, levels: np.ndarray, n: int, percent: int, bits: int) -> DataFrame:
    """(doc_id, tk: hash of the text, size, cid: hash of the set, toks: indexed shingles in order, bits: parities).

    Only the first row of a class in a task has ``toks``, so copies do not lengthen lists.
    """
    held = shared(docs, levels)
    often = np.uint64(FREQUENT << 55)

    def run(batches):
        level, known = held.value, set()
        for b in batches:
            size, cid, toks, bits_, wide = [], [], [], [], []
            for _, _, sets in _sets(b.column("_text"), n):
                for x in sets:
                    size.append(len(x))
                    full = BITS << max(0, int(np.ceil(np.log2(max(1, len(x)) / BITS))))
                    odd = (np.bincount((x % np.uint64(full)).astype(np.int64), minlength=full) & 1).astype(np.uint8)
                    wide.append(np.packbits(odd).tobytes())
                    bits_.append(np.packbits(_folded(odd, BITS)).tobytes())
                    cid.append(int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True))
                    p = len(x) - (-(-len(x) * percent // 100)) + 1 if len(x) else 0
                    # a token is the level and the hash; the sign says that it is frequent
                    if cid[-1] in known:
                        toks.append(np.zeros(0, np.int64))
                        continue
                    known.add(cid[-1])
                    t = level[(x >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(55) | (x >> np.uint64(9))
                    t = np.sort(np.partition(t, p - 1)[:p]) if p else t
                    toks.append((t | ((t >= often).astype(np.uint64) << np.uint64(63))).view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(t) for t in toks])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(toks) if toks else np.zeros(0, np.int64)))
            yield pa.record_batch([b.column("doc_id"), b.column("tk"), pa.array(size, pa.int32()), pa.array(cid, pa.int64()), lists, pa.array(bits_, pa.binary()), pa.array(wide, pa.binary())], names=["doc_id", "tk", "size", "cid", "toks", "bits", "wide"])

    return docs.mapInArrow(run, f"doc_id {id_type(docs)}, tk long, size int, cid long, toks array<long>, bits binary, wide binary")


def _dealt(frame: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys in one partition, for code that reads whole lists.

    Dealt by an expression: a plain ``repartition`` by key is dropped after a join by that key, and that
    join may be replanned at run time to leave its rows where they are.
    """
    return frame.repartition(F.xxhash64(*keys))


def _runs(batches, names):
    """Whole lists: record batches in the order of ``tok`` as arrays whose last list is complete."""
    rest = None
    for b in batches:
        now = {n: _parities(b.column(n)) if n == "bits" else b.column(n).flatten().to_numpy().reshape(-1, AHEAD) if n == "first" else b.column(n).to_numpy(zero_copy_only=False) for n in names}
        if rest is not None:
            now = {n: np.concatenate([rest[n], now[n]]) for n in names}
        if not len(now["tok"]):
            continue
        other = np.flatnonzero(now["tok"] != now["tok"][-1])
        last = int(other[-1]) + 1 if len(other) else 0
        rest = {n: x[last:] for n, x in now.items()}
        if last:
            yield {n: x[:last] for n, x in now.items()}
    if rest is not None and len(rest["tok"]):
        yield rest


def _parities(column: pa.Array) -> np.ndarray:
    """Rows of BITS / 64 words."""
    buffers, width = column.buffers(), BITS // 8
    return np.frombuffer(buffers[2], np.uint8)[column.offset * width : (column.offset + len(column)) * width].view(np.uint64).reshape(len(column), -1) if len(column) else np.zeros((0, BITS // 64), np.uint64)


def _may_link(size_a, size_b, bits_a, bits_b, percent: int) -> np.ndarray:
    """False where the parities differ more than linked sets of these sizes can."""
    least = need(size_a, size_b, percent)
    return np.bitwise_count(bits_a ^ bits_b).sum(axis=1) <= size_a + size_b - 2 * least


def shared_lists(entries: DataFrame, percent: int) -> DataFrame:
    """The entries with a possible partner in their list, with the length of the list (of its part, for a salted one)."""

    def run(batches):
        for x in _runs(batches, ["tok", "salt", "size", "cid", "pos"]):
            same = np.zeros(len(x["tok"]) + 1, bool)
            same[1:-1] = (x["tok"][1:] == x["tok"][:-1]) & (x["salt"][1:] == x["salt"][:-1])
            one = np.ones(len(x["tok"]), bool)  # copies from several tasks
            one[1:] = ~same[1:-1] | (x["cid"][1:] != x["cid"][:-1])
            x = {k: v[one] for k, v in x.items()}
            same = np.zeros(len(x["tok"]) + 1, bool)
            same[1:-1] = (x["tok"][1:] == x["tok"][:-1]) & (x["salt"][1:] == x["salt"][:-1])
            of = np.cumsum(~same[:-1]) - 1
            n = np.bincount(of)[of]
            near = same.copy()
            size = x["size"].astype(np.int64)
            near[1:-1] &= size[1:] * percent <= size[:-1] * 100
            keep = near[:-1] | near[1:] | (x["tok"] < 0)
            if keep.any():
                yield pa.record_batch([pa.array(v[keep]) for v in (x["tok"], x["salt"], x["size"], x["cid"], x["pos"], n)], names=["tok", "salt", "size", "cid", "pos", "n"])

    e = entries.withColumn("salt", F.when(F.col("tok") < 0, F.pmod("cid", F.lit(SALT))).otherwise(0).cast("int"))
    e = _dealt(e, "tok", "salt").sortWithinPartitions("tok", "salt", "size", "cid")
    return e.select("tok", "salt", "size", "cid", "pos").mapInArrow(run, "tok long, salt int, size int, cid long, pos int, n long")


def hub_pairs(live: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a list's hubs with the members that may link to them."""

    def tested(p, q, size, bits, cid):
        """Members p and hubs q of compatible sizes."""
        ok = (p != q) & (size[p] * percent <= size[q] * 100) & (size[q] * percent <= size[p] * 100)
        p, q = p[ok], q[ok]
        good = _may_link(size[p], size[q], bits[p], bits[q], percent)
        p, q = cid[p[good]], cid[q[good]]
        pairs = np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)]), axis=1)
        return pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    def run(batches):
        for x in _runs(batches, ["tok", "salt", "size", "cid", "bits"]):
            tok, salt, size, cid, bits = x["tok"], x["salt"], x["size"].astype(np.int64), x["cid"], x["bits"]
            # the second hub of each list
            head = np.ones(len(tok), bool)
            head[1:] = tok[1:] != tok[:-1]
            of, draw = np.cumsum(head) - 1, ta.mix(cid.view(np.uint64) ^ ta.mix(tok.view(np.uint64)))
            drawn = np.flatnonzero(draw == np.minimum.reduceat(draw, np.flatnonzero(head))[of])
            hubs = np.zeros(of[-1] + 1, np.int64)
            hubs[of[drawn]] = drawn
            yield tested(np.arange(len(tok)), hubs[of], size, bits, cid)
            todo = np.arange(len(tok))
            while len(todo):
                t, s = tok[todo], salt[todo]
                new = np.ones(len(todo), bool)
                new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
                hub = todo[np.flatnonzero(new)][np.cumsum(new) - 1]
                ok = (size[todo] * percent <= size[hub] * 100) & (size[hub] * percent <= size[todo] * 100)
                yield tested(todo[ok & ~new], hub[ok & ~new], size, bits, cid)
                todo = todo[~ok]

    def compare(batches):
        for b in batches:
            p, q, sp, sq = (b.column(c).to_numpy() for c in ("cid", "h", "size", "hs"))
            good = (p != q) & _may_link(sp.astype(np.int64), sq.astype(np.int64), _parities(b.column("bits")), _parities(b.column("hb")), percent)
            pairs = np.unique(np.stack([np.minimum(p, q)[good], np.maximum(p, q)[good]]), axis=1)
            yield pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    rare = _dealt(live.filter("tok >= 0"), "tok").sortWithinPartitions("tok", F.desc("central"), "cid")
    rare = rare.select("tok", "salt", "size", "cid", "bits").mapInArrow(run, "a long, b long")
    # a list of a frequent shingle can be of any length: its two hubs are aggregates, and are joined to the members
    often = live.filter("tok < 0")
    hubs = often.groupBy("tok").agg(F.max(F.struct("central", "cid")).alias("x"), F.min(F.struct(F.xxhash64("tok", "cid"), "cid")).alias("y"))
    hubs = hubs.select("tok", F.explode(F.array("x.cid", "y.cid")).alias("h")).distinct()
    traits = often.select(F.col("cid").alias("h"), F.col("size").alias("hs"), F.col("bits").alias("hb")).join(hubs.select("h").distinct(), "h", "left_semi").dropDuplicates(["h"])
    met = often.select("tok", "cid", "size", "bits").join(hubs, "tok").drop("tok").dropDuplicates(["cid", "h"]).join(traits, "h")
    ratio = (F.col("size") * percent <= F.col("hs") * 100) & (F.col("hs") * percent <= F.col("size") * 100)
    common = met.filter(ratio).select("cid", "size", "bits", "h", "hs", "hb").mapInArrow(compare, "a long, b long")
    return rare.unionByName(common).distinct()


def block_pairs(live: DataFrame, percent: int, block: int = 64, short: int = 8) -> DataFrame:
    """Pairs (a, b) of different components from lists read in blocks of one position each."""

    def met_before(x, p, q):
        """Whether the classes at (p, q) share a shingle before this list's, among those that they carry."""
        out = np.zeros(len(p), bool)
        for c in range(0, len(p), block * block):
            u, v, t = x["first"][p[c : c + block * block]], x["first"][q[c : c + block * block]], x["own"][p[c : c + block * block]]
            out[c : c + len(t)] = ((u[:, :, None] == v[:, None, :]) & (u < t[:, None])[:, :, None]).any(axis=(1, 2))
        return out

    def tested(x, p, q):
        """The pairs of places (p, q) that may link; pairs of the lower band are met in that band's own list."""
        size, pos, cid = x["size"], x["pos"], x["cid"]
        bound = np.minimum(pos[p], pos[q]) + np.minimum(size[p] - pos[p], size[q] - pos[q])
        good = (x["comp"][p] != x["comp"][q]) & ~(x["low"][p] & x["low"][q]) & (bound >= need(size[p], size[q], percent))
        p, q = p[good], q[good]
        good = _may_link(size[p], size[q], x["bits"][p], x["bits"][q], percent)
        p, q = p[good], q[good]
        good = ~met_before(x, p, q)
        p, q = p[good], q[good]
        return np.stack([np.minimum(cid[p], cid[q]), np.maximum(cid[p], cid[q])])

    def batch_of(found):
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pairs, pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    def run(batches):
        """Pairs that several lists hold are merged before they leave, as far as a bounded store reaches."""
        found, held, store = [], 0, 1 << 20
        for pairs in each(batches):
            if pairs.shape[1]:
                found.append(pairs)
                held += pairs.shape[1]
            if held > store:
                pairs, out = batch_of(found)
                found, held = [pairs], pairs.shape[1]
                if held > store // 2:
                    yield out
                    found, held = [], 0
        if found:
            yield batch_of(found)[1]

    def each(batches):
        for x in _runs(batches, ["tok", "size", "cid", "pos", "comp", "low", "bits", "own", "first"]):
            edges = np.flatnonzero(np.concatenate([[True], x["tok"][1:] != x["tok"][:-1], [True]]))
            # lists with one component have their answers already
            mixed = np.minimum.reduceat(x["comp"], edges[:-1]) < np.maximum.reduceat(x["comp"], edges[:-1])
            if not mixed.any():
                continue
            stay = np.repeat(mixed, np.diff(edges))
            x = {k: v[stay].astype(np.int64) if k in ("size", "pos") else v[stay] for k, v in x.items()}
            edges = np.concatenate([[0], np.cumsum(np.diff(edges)[mixed])])
            # lists of a few sets: all at once, by the distance of the two places
            n = np.diff(edges)
            left = np.repeat(np.where(n <= short, n, 0), n) - (np.arange(len(x["tok"])) - np.repeat(edges[:-1], n)) - 1
            for k in range(1, short):
                p = np.flatnonzero(left >= k)
                if len(p):
                    yield tested(x, p, p + k)
            for i, j in zip(edges[:-1][n > short].tolist(), edges[1:][n > short].tolist(), strict=True):
                size, pos = x["size"][i:j], x["pos"][i:j]
                # blocks: entries of one position, at most ``block`` of them, in the order of size
                cuts = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
                cuts = np.unique(np.concatenate([cuts, *[np.arange(c, d, block) for c, d in zip(cuts, np.append(cuts[1:], j - i), strict=True)]]))
                ends = np.append(cuts[1:], j - i)
                smallest, largest, at = size[cuts], size[ends - 1], pos[cuts]
                for b, (c, d) in enumerate(zip(cuts.tolist(), ends.tolist(), strict=True)):
                    # blocks that can hold a partner: sizes within the ratio, and the overlap bound
                    # min(i, j) + 1 + min(size - i, size' - j) - 1 reaches what the smaller sizes need
                    most = np.minimum(at[b], at[b:]) + np.minimum(largest[b] - at[b], largest[b:] - at[b:])
                    least = need(smallest[b], smallest[b:], percent)
                    ok = (smallest[b:] * percent <= largest[b] * 100) & (smallest[b] * percent <= largest[b:] * 100) & (most >= least)
                    for o in (np.flatnonzero(ok) + b).tolist():
                        p, q = np.meshgrid(np.arange(c, d), np.arange(cuts[o], ends[o]), indexing="ij")
                        p, q = p.ravel(), q.ravel()
                        if o == b:
                            p, q = p[p < q], q[p < q]
                        if len(p):
                            yield tested(x, p + i, q + i)

    # sets that link are in one band of size or in neighbours
    band = F.floor(F.log("size") / np.log(100 / percent)) if percent < 100 else F.col("size")
    entry = lambda tok, low: F.struct(tok.alias("tok"), F.lit(low).alias("low"))
    both = F.when(F.col("tok") < 0, F.array(entry(F.xxhash64("tok", band), False), entry(F.xxhash64("tok", band + 1), True))).otherwise(F.array(entry(F.col("tok"), False)))
    e = live.withColumn("_e", F.explode(both)).select("_e.tok", "_e.low", "size", "cid", "pos", "comp", "bits", F.col("tok").alias("own"), "first")
    e = _dealt(e, "tok").sortWithinPartitions("tok", "pos", "size", "cid")
    return e.select("tok", "size", "cid", "pos", "comp", "low", "bits", "own", "first").mapInArrow(run, "a long, b long").distinct()


def fetch_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(cid, items binary: the sorted shingles) of the wanted classes, from one text of each."""
    keys = cut(classes.join(wanted, "cid", "left_semi").select("cid", F.col("one.tk").alias("tk"), F.col("one.doc_id").alias("rid")))
    count = keys.count()
    bits = int(min(27, max(16, np.ceil(np.log2(16 * count + 1)))))
    shared(docs, None)

    def mark(batches):
        bit = np.zeros(1 << bits, bool)
        for b in batches:
            bit[b.column("tk").to_numpy().view(np.uint64) >> np.uint64(64 - bits)] = True
        yield pa.record_batch([pa.array([zlib.compress(np.packbits(bit).tobytes(), 1)])], names=["bits"])

    table = np.zeros((1 << bits) // 8, np.uint8)
    for r in keys.select("tk").coalesce(8).mapInArrow(mark, "bits binary").toLocalIterator():
        table |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    held = shared(docs, table)

    def run(batches):
        t = np.unpackbits(held.value).astype(bool)
        for b in batches:
            k = b.column("tk").to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            b = b.filter(pa.array(t[k]))
            if b.num_rows:
                items = [x.tobytes() for _, _, sets in _sets(b.column("_text"), n) for x in sets]
                yield pa.record_batch([b.column("tk"), b.column("doc_id"), pa.array(items, pa.binary())], names=["tk", "doc_id", "items"])

    some = docs.mapInArrow(run, f"tk long, doc_id {id_type(docs)}, items binary")
    got = some.join(keys, (some["tk"] == keys["tk"]) & some["doc_id"].eqNullSafe(keys["rid"])).select("cid", "items")
    return got.groupBy("cid").agg(F.first("items").alias("items"))  # fully equal rows give it twice


def screen(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their wide parities do not rule out."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y, m, n in zip(b.column("x"), b.column("y"), b.column("m").to_pylist(), b.column("n").to_pylist(), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                size = min(len(u), len(v))
                differ = int(np.bitwise_count(_folded(u, size) ^ _folded(v, size)).sum())
                keep.append(differ <= m + n - 2 * (-(-percent * (m + n) // (100 + percent))))
            k = pa.array(keep, pa.bool_())
            yield pa.record_batch([b.column("a").filter(k), b.column("b").filter(k)], names=["a", "b"])

    side = lambda c, bits, size: classes.select(F.col("cid").alias(c), F.col("wide").alias(bits), F.col("size").cast("long").alias(size))
    p = pairs.join(side("a", "x", "m"), "a").join(side("b", "y", "n"), "b")
    return p.select("a", "b", "x", "y", "m", "n").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""

    def run(batches):
        for b in batches:
            keep = []
            if b.column("x").null_count or b.column("y").null_count:
                raise ValueError("the set of a class is missing")
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                o = len(u) + len(v) - len(np.union1d(u, v))
                keep.append(100 * o >= percent * (len(u) + len(v) - o))
            k = pa.array(keep, pa.bool_())
            yield pa.record_batch([b.column("a").filter(k), b.column("b").filter(k)], names=["a", "b"])

    p = pairs.join(sets.select(F.col("cid").alias("a"), F.col("items").alias("x")), "a", "left").join(sets.select(F.col("cid").alias("b"), F.col("items").alias("y")), "b", "left")
    return p.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def link(docs: DataFrame, percent: int = PERCENT, n: int = WORDS, text: str = "text", trace=None) -> DataFrame:
    """doc_id, tk (hash of the text), n_shingles, component_id for every row of ``docs``.  ``trace(name, frame)`` sees the steps, for tests."""
    trace = trace or (lambda name, frame: None)
    d = docs.select("doc_id", F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tk"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    digits = bucket_bits(d)
    sig = cut(signatures(d, bucket_levels(d, n, digits), n, percent, digits))
    full = sig.filter("size > 0").groupBy("cid")
    classes = cut(full.agg(F.min("doc_id").alias("least"), F.min(F.struct("tk", "doc_id")).alias("one"), F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("wide").alias("wide")))
    entries = sig.filter("size > 0").select("cid", "size", F.posexplode("toks").alias("pos", "tok"))
    live = cut(shared_lists(entries, percent))
    trace("live", live)
    central = live.groupBy("cid").agg(F.sum("n").alias("central")).join(classes.select("cid", "bits"), "cid")
    stars = cut(screen(hub_pairs(live.join(central, "cid"), percent), classes, percent))
    trace("stars", stars)
    ids = lambda p: p.select(F.col("a").alias("cid")).union(p.select(F.col("b").alias("cid"))).distinct()
    links = cut(verify(stars, fetch_sets(d, classes, ids(stars), n), percent))
    trace("links", links)
    comp = cut(components(links, "a", "b"))
    name = lambda c: F.coalesce(F.col("comp"), F.col(c))
    labelled = live.select("tok", "size", "cid", "pos").join(comp, F.col("cid") == F.col("id"), "left").withColumn("comp", name("cid")).drop("id")
    mixed = labelled.groupBy("tok").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y")).filter("_x < _y").select("tok")
    labelled = cut(labelled.join(mixed, "tok", "left_semi"))
    # a class has no more tokens than its text has words
    first = labelled.groupBy("cid").agg(F.sort_array(F.collect_list("tok")).alias("first"))
    first = first.select("cid", F.slice(F.concat("first", F.array_repeat(F.lit(2**63 - 1), AHEAD)), 1, AHEAD).alias("first"))
    rest = block_pairs(labelled.join(classes.select("cid", "bits"), "cid").join(first, "cid"), percent)
    more = cut(screen(rest.join(stars, ["a", "b"], "left_anti"), classes, percent))
    trace("more", more)
    if more.limit(1).count():
        found = cut(verify(more, fetch_sets(d, classes, ids(more), n), percent))
        trace("found", found)
        if found.limit(1).count():
            links = links.unionByName(found)
            comp = cut(components(links, "a", "b"))
    least = classes.select("cid", "least").join(comp, F.col("cid") == F.col("id"), "left").withColumn("comp", name("cid"))
    # the smallest doc_id of each component, then of each class in it
    named = least.join(least.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("cid", "component_id")
    out = sig.select("doc_id", "tk", "size", "cid").join(named, "cid", "left")
    return out.select("doc_id", "tk", F.col("size").cast("long").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def distinct(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group: that with the component's name, once.

    Rows without words are in no group and all stay; of rows without an id, those of a named group go
    only with their own text's equals (they cannot be its name).
    """
    found = link(docs, **options)
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_d"), F.col("tk").alias("_k")).distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("_tk", F.xxhash64(text)).withColumn("_own", F.when(text.rlike(r"[^\x20\x09-\x0D]"), 0).otherwise(F.monotonically_increasing_id()))
    kept = d.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_tk") == F.col("_k")), "left_anti")
    return kept.dropDuplicates(["doc_id", "_tk", "_own"]).select(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    return link(docs).drop("tk")
