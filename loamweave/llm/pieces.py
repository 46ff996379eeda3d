"""Operator 2: SentencePiece encoding and decoding.

The vocabulary file is read on the driver and broadcast (its size is fixed).  Encoding finds the
segmentation of highest total piece score: an Aho-Corasick automaton over the pieces reads the text
once; at each position the pieces that end there (the output links) relax the best score.  A
character that no piece covers costs ``lowest score - 10`` and becomes its UTF-8 byte pieces (or the
unknown piece, if the vocabulary has none).  Ties keep the longer last piece.

Since no piece contains a space mark after another character, a text falls apart at these places into
independent segments; equal segments of a task are encoded once (``CACHE`` of them are remembered).
The file's own normaliser must be the identity; white space then survives, and decoding gives back
the text.  A space mark is put before the first character and taken away by decoding.

Defined results: null text gives null pieces and decodes to null; an empty text gives no pieces.  Text
that already holds the mark U+2581 decodes to spaces there (as in the format itself).  Rows are
independent, so repeats and null ids are no special case.  Further columns are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, shared

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK, CACHE, LONG = "▁", 200_000, 64


class Vocabulary:
    """Pieces and scores of a SentencePiece model file."""

    def __init__(self, model: bytes):
        self.model = model
        self._ready = False

    def __getstate__(self):
        return {"model": self.model, "_ready": False}

    def build(self) -> Vocabulary:
        if self._ready:
            return self
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        n = sp.get_piece_size()
        self.text, self.score, self.kind = [sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], []
        self.unknown, self.bytes = sp.unk_id(), {}
        automaton = ahocorasick.Automaton()
        inner = set()
        for i, p in enumerate(self.text):
            if sp.is_byte(i):
                self.bytes[int(p[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                automaton.add_word(p, (len(p), self.score[i], i))
                inner |= {p} if MARK in p.lstrip(MARK) else set()
        if inner:
            raise ValueError(f"pieces with a space mark inside: {sorted(inner)[:3]}")
        automaton.make_automaton()
        self.automaton = automaton
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.unknown_score = min(self.score[i] for i in normal) - 10.0
        self.byte_value = {i: b for b, i in self.bytes.items()}
        newline = any("\n" in self.text[i] for i in normal)
        self.segments = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if newline else f"\n|{MARK}*[^{MARK}\n]+|{MARK}+").findall
        self.cache: dict[str, tuple[tuple[int, ...], float, int]] = {}
        self._ready = True
        return self

    def viterbi(self, text: str) -> tuple[tuple[int, ...], float, int]:
        """Ids of the best segmentation, its score, and the number of characters that no piece covers."""
        n = len(text)
        best, back = [0.0] + [None] * n, [None] * (n + 1)
        done = 0  # positions up to here are final

        def fill(to: int) -> None:
            """Characters without any piece: the unknown edge."""
            nonlocal done
            while done < to:
                done += 1
                edge = best[done - 1] + self.unknown_score
                if best[done] is None or edge > best[done]:
                    best[done], back[done] = edge, (1, -1)

        for end, (length, score, i) in self.automaton.iter(text):
            end += 1
            if done < end - 1:
                fill(end - 1)
            s = best[end - length] + score
            if best[end] is None or s > best[end]:
                best[end], back[end] = s, (length, i)
        fill(n)
        out, missing = [], 0
        at = n
        while at:
            length, i = back[at]
            if i < 0:
                missing += 1
                code = text[at - 1].encode("utf-8", "surrogatepass")
                out += [self.bytes[b] for b in reversed(code)] if len(self.bytes) == 256 else [self.unknown]
            else:
                out.append(i)
            at -= length
        return tuple(reversed(out)), best[n], missing

    def encode(self, text: str) -> tuple[list[int], float, int]:
        ids: list[int] = []
        total, missing = 0.0, 0
        cache = self.cache
        if text:
            for seg in self.segments(MARK + text.replace(" ", MARK)):
                got = cache.get(seg)
                if got is None:
                    got = self.viterbi(seg)
                    if len(seg) <= LONG:
                        if len(cache) >= CACHE:
                            cache.clear()
                        cache[seg] = got
                ids += got[0]
                total += got[1]
                missing += got[2]
        return ids, total, missing

    def decode(self, ids) -> str:
        out, raw = [], bytearray()
        for i in ids:
            b = self.byte_value.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.text[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out)
        return (text[1:] if text.startswith(MARK) else text).replace(MARK, " ")


def load(path: str = MODEL) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary(f.read())


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, pieces array<int>, piece_score double, n_uncovered long for every row of (doc_id, text)."""
    held = shared(docs, vocabulary)

    def run(batches):
        v = held.value.build()
        for batch in batches:
            text, n = batch.column("_text"), batch.num_rows
            for at in range(0, n, 1000):  # bounded lists of Python integers
                part, ids = text.slice(at, 1000), []
                m = len(part)
                ends, score, missing = np.zeros(m + 1, np.int32), np.zeros(m), np.zeros(m, np.int64)
                flat = []
                for k, t in enumerate(part.to_pylist()):
                    if t:
                        ids, score[k], missing[k] = v.encode(t)
                        flat.append(np.array(ids, np.int32))
                        ends[k + 1] = len(ids)
                values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))
                mask = pa.array(np.asarray(part.is_null()))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), values, mask=mask)
                yield pa.record_batch([batch.column("doc_id").slice(at, 1000), lists, pa.array(score), pa.array(missing)], names=["doc_id", "pieces", "piece_score", "n_uncovered"])

    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(run, f"doc_id {id_type(docs)}, pieces array<int>, piece_score double, n_uncovered long")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, text for every row of (doc_id, pieces)."""
    held = shared(encoded, vocabulary)

    def run(batches):
        v = held.value.build()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                text = [None if x is None else v.decode(x) for x in batch.column("pieces").slice(at, 1000).to_pylist()]
                yield pa.record_batch([batch.column("doc_id").slice(at, 1000), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(run, f"doc_id {id_type(encoded)}, text string")


def encode_checked(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """As ``encode``, and whether the pieces decode to the very text, without a second pass over the rows."""
    held = shared(docs, vocabulary)
    schema = f"doc_id {id_type(docs)}, n_pieces long, n_uncovered long, piece_score double, pieces_crc long, round_trip boolean"

    def run(batches):
        import zlib

        v = held.value.build()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = []
                for t in batch.column("_text").slice(at, 1000).to_pylist():
                    ids, score, missing = v.encode(t or "")
                    rows.append((len(ids), missing, score, zlib.crc32(np.array(ids, "<i4").tobytes()), v.decode(ids) == (t or "").replace(MARK, " ")))
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_()), strict=True)]
                yield pa.record_batch([batch.column("doc_id").slice(at, 1000), *cols], names=["doc_id", "n_pieces", "n_uncovered", "piece_score", "pieces_crc", "round_trip"])

    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(run, schema)


def query(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """Counts, score and checksum of every text's pieces, and whether decoding gives the text back."""
    return encode_checked(docs, load(path))
