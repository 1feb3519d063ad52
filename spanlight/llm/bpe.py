"""Exact byte-level BPE by backtracking over longest matches; decoding by an offset table.

An Aho-Corasick automaton finds the longest token at every position. The encoder takes longest
matches from the left; a token may follow another only if merging the two texts would have kept
that boundary, which the pair-compatibility table tells from the merges alone. Where no token fits,
it backs up, and a bitmap of dead ends keeps the whole walk linear in the text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from spanlight.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: Entries of a worker's cache of encoded chunks; the older half goes when it is full.
CACHE_CHUNKS = 900_000
CACHE_BYTES = 48


class Codec:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library.

    encode() equals that library's encode(text, add_special_tokens=False), decode() its
    decode(ids, skip_special_tokens=False). Contents of added tokens found in a text are single ids.
    """

    def __init__(self, path: str = BYTE_BPE) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = all(not t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        odd = [k for k in ("normalizer", "post_processor") if spec[k]] + [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if odd or not plain or model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True):
            raise ValueError(f"not a plain byte-level BPE: {', '.join(odd) or path}")
        vocab: dict[str, int] = model["vocab"]
        self._pre = pre_tokenizers.ByteLevel(add_prefix_space=pre["add_prefix_space"])
        if pre["add_prefix_space"]:
            raise ValueError("a prefix space is not supported")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # Ranks: single bytes first, then tokens in the order in which merges make them.
        order = [t for t in vocab if len(t) == 1] + [a + b for a, b in merges]
        rank: dict[str, int] = {}
        for t in order:
            rank.setdefault(t, len(rank))
        self._ids = np.array([vocab[t] for t in rank], np.int64)
        self._len = [len(t) for t in rank]
        self._split = [(i, i) for i in range(len(rank))]
        self._pair: dict[tuple[int, int], int] = {}
        for a, b in merges:
            pair, t = (rank[a], rank[b]), rank[a + b]
            if pair not in self._pair:
                self._pair[pair] = t
                if self._split[t] == (t, t):
                    self._split[t] = pair
        self._rank, self._fits = rank, {}
        self._prefix = [-1] * len(rank)  # the next shorter token that starts a token
        for t, i in rank.items():
            for n in range(len(t) - 1, 0, -1):
                if (j := rank.get(t[:n])) is not None:
                    self._prefix[i] = j
                    break
        self._auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, i in rank.items():
            self._auto.add_word(t, i)
        self._auto.make_automaton()
        # The offset table: id -> its bytes, and id -> its decimal digits with a comma.
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._added = added
        self._special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        of_char = {c: b for b, c in enumerate(self._alphabet())}
        size = max([*vocab.values(), *added.values()]) + 1
        text = [b""] * size
        for t, i in vocab.items():
            text[i] = bytes(of_char[c] for c in t)
        for t, i in added.items():
            text[i] = t.encode()
        self._bytes, self._decimal = _table(text), _table([b"%d," % i for i in range(size)])
        self._wide = np.uint16 if size <= 1 << 16 else np.uint32
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    @staticmethod
    def _alphabet() -> list[str]:
        """The printable character that stands for each byte in vocabulary files."""
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        out, n = [], 256
        for b in range(256):
            out.append(chr(b) if b in shown else chr(n))
            n += b not in shown
        return out

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging the text of token a followed by that of b leaves just these two tokens."""
        if (known := self._fits.get((a, b))) is not None:
            return known
        left, right, limit, pair, split = a, b, 1 << 60, self._pair, self._split
        while True:
            if pair.get((left, right), limit) < limit:
                fits = False
                break
            if left > right:
                limit, left = left, split[left][1]
                if left != limit:
                    continue
                limit, right = right + 1, split[right][0]
                if right + 1 == limit:
                    fits = True
                    break
            else:
                limit, right = right + 1, split[right][0]
                if right + 1 != limit:
                    continue
                limit, left = left, split[left][1]
                if left == limit:
                    fits = True
                    break
        if len(self._fits) > 2_000_000:
            self._fits.clear()
        self._fits[a, b] = fits
        return fits

    def _piece(self, piece: str) -> list[int]:
        """Ranks of the tokens of one pre-token, given in the byte alphabet."""
        if (whole := self._rank.get(piece)) is not None and (self._len[whole] == 1 or self._reachable(whole)):
            return [whole]
        return self._walk(piece)

    @lru_cache(maxsize=1 << 17)  # noqa: B019  one codec lives as long as its worker
    def _reachable(self, token: int) -> bool:
        a, b = self._split[token]
        return a != token and self._compatible_below(a, b, token)

    def _compatible_below(self, a: int, b: int, limit: int) -> bool:
        return (self._len[a] == 1 or self._reachable(a)) and (self._len[b] == 1 or self._reachable(b)) and self._joins(a, b, limit)

    def _joins(self, a: int, b: int, token: int) -> bool:
        """Whether merging turns the text of a, b into token, not into something else on the way."""
        left, right, limit, pair, split = a, b, token, self._pair, self._split
        while True:
            if pair.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, left = left, split[left][1]
                if left != limit:
                    continue
                limit, right = right + 1, split[right][0]
                if right + 1 == limit:
                    return True
            else:
                limit, right = right + 1, split[right][0]
                if right + 1 != limit:
                    continue
                limit, left = left, split[left][1]
                if left == limit:
                    return True

    def _walk(self, piece: str) -> list[int]:
        n, size, prefix, fits = len(piece), self._len, self._prefix, self._compatible
        longest = [-1] * n
        for end, t in self._auto.iter(piece):
            at = end + 1 - size[t]
            if longest[at] < 0 or size[t] > size[longest[at]]:
                longest[at] = t
        dead, out, at = bytearray(n + 1), [], 0
        token = longest[0]
        while at < n:
            while True:
                end = at + size[token]
                if not dead[end] and (not out or fits(out[-1], token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    break
                if prefix[token] >= 0:
                    token = prefix[token]
                    continue
                dead[at] = 1  # nothing that starts here can end the text
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                token = out.pop()
                at -= size[token]
        return out

    def _cached(self, chunk: str) -> bytes:
        ids = self._new.get(chunk)
        if ids is None:
            ids = self._old.get(chunk)
            if ids is None:
                ids = self._chunk(chunk)
            if len(chunk) <= CACHE_BYTES:
                if len(self._new) >= CACHE_CHUNKS // 2:
                    self._old, self._new = self._new, {}
                self._new[chunk] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and len(chunk) <= CACHE_BYTES:
            if chunk[-1] in _MARKS and chunk[-2:-1].isalpha():  # a pre-token ends between letter and mark
                return self._cached(chunk[:-1]) + self._cached(chunk[-1])
            if chunk[0] == " " and chunk[1:].isalpha():
                return self._ids[self._piece("\u0120" + chunk[1:])].astype(self._wide).tobytes()
        ranks: list[int] = []
        for piece, _ in self._pre.pre_tokenize_str(chunk):
            ranks += self._piece(piece)
        return self._ids[ranks].astype(self._wide).tobytes()

    def _plain(self, text: str) -> bytes:
        """Ids of text without added tokens, as packed integers."""
        if _ODD_SPACE.search(text):
            return self._chunk(text)
        new = self._new.get
        return b"".join([new(c) or self._cached(c) for c in _CHUNKS.findall(text)])

    def encode(self, text: str) -> np.ndarray:
        if self._special is None or not self._special.search(text):
            return np.frombuffer(self._plain(text), self._wide)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self._added[m[0]]], self._wide).tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*out, self._plain(text[at:])]), self._wide)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return _gather(self._bytes, ids)

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return _gather(self._decimal, ids)[:-1]


#: A chunk is white space (blanks and line feeds alone) and what follows it up to the next; no
#: pre-token crosses from other characters into white space, so chunks are encoded one by one.
_CHUNKS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_MARKS = frozenset(",.!;:?%*$&#")
_ODD_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")


def _table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in parts], np.int32)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size, dtype=np.int32) - size, size


def _gather(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> bytes:
    data, start, size = table
    out = []
    for at in range(0, len(ids), 1 << 18):
        part = ids[at : at + (1 << 18)]
        n = size[part]
        ends = np.cumsum(n, dtype=np.int32)
        out.append(data[np.arange(ends[-1], dtype=np.int32) + np.repeat(start[part] - ends + n, n)].tobytes())
    return b"".join(out)


@lru_cache(maxsize=2)
def codec(path: str = BYTE_BPE) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """(id_col, ids array<int>): each whole text encoded; null and empty texts give no ids.

    Rows stay rows (repeated ids and texts included); extra columns are ignored.
    """
    schema = f"`{id_col}` bigint, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [c.encode(t.as_py() or "").astype(np.int32) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = BYTE_BPE) -> DataFrame:
    """(id_col, text): the text of each row's ids; null ids give an empty text."""
    schema = f"`{id_col}` bigint, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [c.decode(np.array(x.as_py() or [], np.int64)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(F.col(id_col).cast("bigint"), F.col(ids_col)).mapInArrow(run, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of each whole text, encoded and decoded again in one pass; one row for each row.

    Null texts count as empty; null and repeated ids stay as they are, extra columns are ignored.
    """
    schema = f"`{id_col}` bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1):
                ids = c.encode(t.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(c.decimals(ids) if len(ids) else b"").hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, schema)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
