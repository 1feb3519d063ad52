"""Language identification with hyperdimensional n-gram profiles.

Every letter of any script has a fixed random vector of +1 and -1, made of a hash of its code point. A trigram's vector binds (multiplies) its
letters' vectors, each permuted (rotated) by its position; a text's vector bundles (adds) those of
its trigrams. A language's prototype bundles the trigrams of all its labelled texts, and a text
gets the language whose prototype has the largest cosine with its vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlight.llm.common import held_out, table

UNKNOWN = "und"
#: Dimensions of the vectors; base of trigram codes, above every code point; seed of the letter vectors.
DIMS, SYMBOLS, SEED = 512, 1 << 21, 5
#: Languages that a task counts at a time; trigrams that it holds before they are bundled.
HELD_LANGS, HELD_TRIGRAMS = 64, 1 << 20
#: Inverse temperature that turns cosines into a share.
SHARPNESS = 12.0


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Symbol of each code point: 0 for other than letters, else the code point of the small letter."""
    out = np.zeros(0x110000, np.int32)
    for c in range(len(out)):
        ch = chr(c)
        if ch.isalpha():
            out[c] = ord(ch.lower()[:1])
    return out


class _Letters:
    """Vectors by code point, or array of code points: bits of splitmix64 as +1 and -1."""

    def __getitem__(self, points: np.ndarray | int) -> np.ndarray:
        points = np.asarray(points)
        at = points.astype(np.uint64)[..., None] * np.uint64(DIMS // 64) + np.arange(1 + (SEED << 40), 1 + (SEED << 40) + DIMS // 64, dtype=np.uint64)
        x = at * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).astype("<u8").view(np.uint8), axis=-1)
        return bits.astype(np.int8) * np.int8(2) - np.int8(1)


def _letters() -> _Letters:
    return _Letters()


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    """Vectors of trigram codes: the letters' vectors, rotated by position, multiplied."""
    points, at = np.unique(np.concatenate([codes // SYMBOLS**2, codes // SYMBOLS % SYMBOLS, codes % SYMBOLS]), return_inverse=True)
    v = _letters()[points]
    a, b, c = at.reshape(3, -1)
    return np.roll(v, 2, 1)[a] * np.roll(v, 1, 1)[b] * v[c]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram codes of a text and their counts. Runs of other characters count as one blank; trigrams without a letter don't count."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    s = np.concatenate(([0], _symbols()[points], [0])).astype(np.int64)
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
    if len(s) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:]
    codes, n = np.unique(codes[codes > 0], return_counts=True)
    return codes, n


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def text_vector(codes: np.ndarray, n: np.ndarray, kind: type = np.float32) -> np.ndarray:
    out = np.zeros(DIMS, kind)
    for at in range(0, len(codes), 4096):
        out += n[at : at + 4096].astype(kind) @ trigram_vectors(codes[at : at + 4096]).astype(kind)
    return out


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    prototypes: tuple[bytes, ...]  # float32 vectors of length one


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Prototypes from every row with text and language that may be learnt from.

    Each task bundles what it reads and sends one vector for each language. A text's weight grows
    with the root of its trigram counts only, so a few long texts don't make a language.
    """
    schema = "lang string, vec array<double>"

    def bundle(sums: dict[str, np.ndarray], held: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> None:
        for lang, parts in held.items():
            codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            sums[lang] += text_vector(codes, np.bincount(at, np.concatenate([w for _, w in parts]), len(codes)), np.float64)
        held.clear()

    def bundled(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, vec in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([vec])], names=["lang", "vec"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        n_held = 0
        for b in batches:
            for t, lang in zip(b.column(0), b.column(1).to_pylist()):
                codes, n = trigrams(t.as_py())
                if lang not in sums:
                    if len(sums) == HELD_LANGS:  # bundles add up, so they may be sent in parts
                        bundle(sums, held)
                        yield from bundled(sums)
                        sums, n_held = {}, 0
                    sums[lang] = np.zeros(DIMS)
                held.setdefault(lang, []).append((codes, np.sqrt(n)))
                n_held += len(codes) + 1
                if n_held > HELD_TRIGRAMS:
                    bundle(sums, held)
                    n_held = 0
        bundle(sums, held)
        yield from bundled(sums)

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col))).select(text_col, lang_col)
    sums = rows.mapInArrow(run, schema).select("lang", F.posexplode("vec")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    by_lang: dict[str, np.ndarray] = {}
    for r in sums.collect():  # languages x DIMS numbers
        by_lang.setdefault(r.lang, np.zeros(DIMS))[r.pos] = r.x
    langs = sorted(k for k, v in by_lang.items() if np.linalg.norm(v) > 0)
    return Model(tuple(langs), tuple((by_lang[k] / np.linalg.norm(by_lang[k])).astype(np.float32).tobytes() for k in langs))


def predict(text: str | None, langs: tuple[str, ...], prototypes: np.ndarray) -> tuple[str, float, float]:
    """(language, score, cosine) of a text."""
    if not text or not langs or not _has_letter(text):
        return UNKNOWN, 0.0, 0.0
    codes, n = trigrams(text)
    if not len(codes):
        return UNKNOWN, 0.0, 0.0
    v = text_vector(codes, np.sqrt(n))
    norm = float(np.linalg.norm(v))
    cos = prototypes @ v / norm if norm else np.zeros(len(langs))
    best = int(np.argmax(cos))
    share = 1 / sum(math.exp(SHARPNESS * float(c - cos[best])) for c in cos)
    return langs[best], share, max(0.0, float(cos[best]))


def identified(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """All columns of docs and out_col struct<lang, score, cosine>, which replaces a column of that name.

    lang is `und`, score and cosine 0, for null texts and those without any letter; ties go to the
    first language in alphabetical order.
    """
    @F.pandas_udf("lang string, score double, cosine double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        prototypes = np.array([np.frombuffer(p, np.float32) for p in model.prototypes]).reshape(-1, DIMS)
        for texts in batches:
            yield pd.DataFrame([predict(t, model.langs, prototypes) for t in texts], columns=["lang", "score", "cosine"])

    return docs.withColumn(out_col, guess(F.col(text_col)))


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identified(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
