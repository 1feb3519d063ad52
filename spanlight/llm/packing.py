"""Packing of documents into fixed-length sequences along a space-filling curve.

Every document's token counts are hashed into a vector, projected to few dimensions and placed on
a Hilbert curve. Documents are range-sorted by curve position, so that neighbours in a sequence
are alike, and laid end to end within each range; sequences are cut from that stream.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanlight.llm.common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SEQUENCE_TOKENS = 4096
END_ID = 2
#: Hashed dimensions of a document vector; dimensions of the curve and bits of each.
HASHED, CURVE_DIMS, CURVE_BITS = 512, 4, 8
CACHE_WORDS = 1_000_000
#: Bytes of packed ids in a range of the curve, one task's share, until there are MOST_RANGES of them (a task sorts its
#: range on disk, so larger ones take longer and no more memory); sampled documents for their bounds, at least and a range.
RANGE_BYTES, MOST_RANGES, SAMPLE_DOCS, SAMPLE_A_RANGE = 10_000_000, 200_000, 4000, 50
#: Bytes of packed ids for a code point, as a first guess of how many ranges there will be.
BYTES_A_CHAR = 0.6

#: Latin letters that lower-casing maps one to one, then marks: NFC leaves both alone and the tokenizer splits between them.
_WORD = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([,.!;:?%*$&#]*)")


def _byte_characters() -> dict[int, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: b if b in shown else next(rest) for b in range(256)}


_BYTES = _byte_characters()


class Words:
    """Ids of white-space separated words by the given tokenizer, cached by word.

    Exact for byte-level tokenizers that drop white space, let no token cross it, and lower-case.
    Words of lower-case Latin letters go straight to the tokenizer's model, all others through the
    whole tokenizer.
    """

    def __init__(self, path: str = WORD_BPE) -> None:
        assert sys.byteorder == "little"  # packed ids are little-endian
        self._tok = Tokenizer.from_file(path)
        self._tok.no_padding()
        self._tok.no_truncation()
        self._model = self._tok.model
        self._new: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def _make(self, w: bytes) -> bytes:
        if len(w) <= 48 and (m := _WORD.fullmatch(w)):
            word, marks = m.groups()
            if marks:
                return self._cached(word) + self._cached(marks)
            text = word.decode()
            low = text.lower()
            if low != text:
                return self._cached(low.encode())
            return array("H", [t.id for t in self._model.tokenize(word.decode("latin-1").translate(_BYTES))]).tobytes()
        return np.array(self._tok.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint16).tobytes()

    def _cached(self, w: bytes) -> bytes:
        ids = self._new.get(w)
        if ids is None:
            ids = self._old.get(w)
            if ids is None:
                ids = self._make(w)
            if len(w) <= 48:
                if len(self._new) >= CACHE_WORDS // 2:
                    self._old, self._new = self._new, {}
                self._new[w] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Packed 16-bit ids of text."""
        new = self._new.get
        return b"".join([new(w) or self._cached(w) for w in text.encode("utf-8", "replace").split()])


@lru_cache(maxsize=2)
def words(path: str = WORD_BPE) -> Words:
    return Words(path)


@lru_cache(maxsize=1)
def _hashing() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each id its hashed dimension and sign; the projection of hashed dimensions to the curve's."""
    x = (np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = (x >> np.uint64(40)).astype(np.int64) % HASHED
    sign = np.where(x >> np.uint64(63), 1.0, -1.0)
    return bucket, sign, np.random.default_rng(11).standard_normal((HASHED, CURVE_DIMS))


def curve_point(ids: np.ndarray) -> np.ndarray:
    """Grid cell of a document: its hashed vector, of length one, projected and cut into 2^bits steps."""
    bucket, sign, project = _hashing()
    v = np.bincount(bucket[ids], sign[ids], HASHED)
    v = np.sign(v) * np.sqrt(np.abs(v))  # frequent words count less
    norm = np.sqrt(v @ v)
    z = (v / norm) @ project if norm else np.zeros(CURVE_DIMS)
    cells = 1 << CURVE_BITS
    return np.clip((z / 6 + 0.5) * cells, 0, cells - 1).astype(np.int64)


def hilbert_key(cells: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """Positions of integer points (rows of cells, 0 <= cell < 2^bits) on the Hilbert curve (Skilling's transform)."""
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_key(cells: np.ndarray, doc_ids: list[int | None]) -> np.ndarray:
    """Curve positions in the upper bits, hashed ids below: copies share a position and still are dealt out evenly."""
    low = np.array([zlib.crc32(str(i).encode()) >> 9 for i in doc_ids], np.int64)
    return (hilbert_key(cells) << 23) | low


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = WORD_BPE, end_id: int = END_ID, cuts: list[int] | None = None) -> DataFrame:
    """(id_col, hkey long, part int, ids binary): packed little-endian 16-bit ids with end_id last, the key along the curve, and between which cuts it lies."""
    bounds = np.array(cuts or [], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, end = words(path), np.array([end_id], np.uint16).tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = [w.encode(t.as_py() or "") + end for t in part.column(1)]
                cells = np.array([curve_point(np.frombuffer(x, np.uint16)) for x in ids]).reshape(-1, CURVE_DIMS)
                key = curve_key(cells, part.column(0).to_pylist())
                where = np.searchsorted(bounds, key, side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(key), pa.array(where), pa.array(ids, pa.binary())], names=[id_col, "hkey", "part", "ids"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, f"`{id_col}` bigint, hkey bigint, part int, ids binary")


def range_cuts(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int) -> list[int]:
    """Keys that cut the curve into ranges of about RANGE_BYTES of ids, by the quantiles of a sample, weighted by length.

    The sample decides how many and how even the ranges are, nothing else: every document is dealt
    to the range of its own key. It grows with the number of ranges, takes rows whatever their ids,
    and the driver gets two numbers of each.
    """
    n, chars = docs.agg(F.count("*"), F.sum(F.length(text_col))).first()
    guess = min(int((chars or 0) * BYTES_A_CHAR // RANGE_BYTES) + 1, MOST_RANGES)
    share = min(1.0, max(SAMPLE_DOCS, SAMPLE_A_RANGE * guess) / n) if n else 1.0
    some = docs.sample(False, share, 7) if share < 1 else docs
    rows = tokenize(some, id_col, text_col, path, end_id).select("hkey", F.length("ids").alias("n")).toArrow()
    if not rows.num_rows:
        return []
    keys, sizes = (rows.column(c).to_numpy().astype(np.int64) for c in ("hkey", "n"))
    order = np.argsort(keys, kind="stable")
    keys, below = keys[order], np.cumsum(sizes[order])
    ranges = min(int(below[-1] / len(keys) * n // RANGE_BYTES) + 1, MOST_RANGES)
    at = np.searchsorted(below, below[-1] / ranges * np.arange(1, ranges))
    return sorted({int(k) for k in keys[np.minimum(at, len(keys) - 1)]})


def _tail(n: int, tokens: int) -> list[int]:
    """Sequence lengths for the last n < tokens ids: powers of two, which need no padding."""
    return [1 << b for b in range(tokens.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = WORD_BPE, tokens: int = SEQUENCE_TOKENS, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    Every row of docs, repeated ids and texts included, is laid out whole: its ids, then end_id
    (null and empty texts: end_id alone). Sequences hold exactly `tokens` ids except the last of
    each range, whose rest is cut into sequences of power-of-two length, so no id of padding is
    needed. Sequence ids are unique, not dense: the range's number in the upper bits. Ties on the
    curve are sorted by hashed id. Extra columns of docs are ignored.
    """
    schema = f"`{id_col}` bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, full = TaskContext.get().partitionId() << 33, 0
        rows: list[tuple] = []  # pieces of the open sequence: (doc, start, ids, doc_tokens)
        held = 0
        out: list[tuple] = []

        def close(lengths: list[int]) -> None:
            """Put the pieces at hand into sequences of the given lengths."""
            nonlocal rows, held, full
            todo, rows, held = rows[::-1], [], 0
            for n in lengths:
                at = 0
                while at < n:
                    doc, start, ids, total = todo.pop()
                    if len(ids) > n - at:
                        todo.append((doc, start + n - at, ids[n - at :], total))
                        ids = ids[: n - at]
                    out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base + full, at, *([ids.astype(np.int32)] if keep_ids else [])))
                    at += len(ids)
                full += 1

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[]] * (8 if keep_ids else 7)
            out.clear()
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * keep_ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids)

        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.frombuffer(raw.as_buffer(), np.uint16)
                at, total = 0, len(ids)
                while at < total:
                    part = ids[at : at + tokens - held]
                    rows.append((doc, at, part, total))
                    held, at = held + len(part), at + len(part)
                    if held == tokens:
                        close([tokens])
                if len(out) >= (512 if keep_ids else 4096):
                    yield batch()
            rows = [(d, s, i.copy(), n) for d, s, i, n in rows]  # the batch's memory goes
        close(_tail(held, tokens))
        if out:
            yield batch()

    cuts = range_cuts(docs, id_col, text_col, path, end_id)
    each = tokenize(docs, id_col, text_col, path, end_id, cuts)
    along = each.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("hkey", id_col)
    return along.select(id_col, "ids").mapInArrow(run, schema)


def op1_pack(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
