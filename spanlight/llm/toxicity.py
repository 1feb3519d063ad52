"""Toxicity by compression distance: window lengths under a toxic and an ordinary zstandard dictionary.

Labelled texts are cut into windows of some words. zstandard's trainer makes a base dictionary of
ordinary windows, which both dictionaries have, and of either label a part of its own from the
windows that tell it best. Which those are is found by cross-fitting: at first the windows that
the base compresses worst, then those that the dictionaries of the other half of the documents
compress better for their own label than for the other. A window's distance is the bytes that the
toxic dictionary saves over the ordinary one. Where it saves any, the windows half a step aside are
compressed too and the better of both counts as well, so that a chance match in one framing isn't
enough. A document has its largest window's distance; the threshold is calibrated on labelled rows
kept out of the dictionaries.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlight.llm.common import held_out, table

#: Bounds of the labelled sample: documents of either label, windows of a document (those of least hash).
TOXIC_DOCS, ORDINARY_DOCS, DOC_WINDOWS = 1600, 3200, 2000
#: Words of a window, an even number; bytes from which a word is cut, and of its pieces.
WINDOW_WORDS, LONG_WORD, PIECE = 8, 48, 24
#: Bytes of the base and of either label's own part; windows that the base is trained on; share of a label's windows that its part is.
BASE_BYTES, OWN_BYTES, BASE_WINDOWS, OWN_SHARE, ROUNDS = 300_000, 16_000, 40_000, 0.05, 2
#: Threshold in bytes where the calibration rows have one label only; what a wrong ordinary row costs against a wrong toxic one; steepness of the score about the threshold.
THRESHOLD, FALSE_ALARM, STEEPNESS = 6.5, 2.0, 0.7

#: Ends every window and both dictionaries: zstandard looks for no matches in the last bytes of its input.
_END = b" \x01\x02\x03\x04\x05\x06\x07\x08\x0b\x0c\x0e\x0f"


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    threshold: float = THRESHOLD


def units(text: str | None) -> list[bytes]:
    """Words in small letters; very long ones (or texts without blanks) in pieces, so that nothing is left out."""
    out: list[bytes] = []
    for w in (text or "").lower().encode("utf-8", "replace").split():
        if len(w) <= LONG_WORD:
            out.append(w)
        else:
            out.extend(w[i : i + PIECE] for i in range(0, len(w), PIECE))
    return out


def windows(text: str | None) -> list[bytes]:
    """Windows side by side, the last one shorter."""
    u = units(text)
    return [b" ".join(u[i : i + WINDOW_WORDS]) for i in range(0, len(u), WINDOW_WORDS)]


def _compressor(dictionary: bytes) -> zs.ZstdCompressor:
    d = dictionary + _END
    how = zs.ZstdCompressionParameters.from_level(
        3, source_size=64, dict_size=len(d), write_content_size=False, write_checksum=False, write_dict_id=False, strategy=zs.STRATEGY_LAZY, min_match=4, search_log=4
    )
    return zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=how)


class Scorer:
    """Distances and scores under a model's two dictionaries."""

    def __init__(self, model: Model) -> None:
        self._threshold = model.threshold
        self._good, self._bad = _compressor(model.ordinary).compress, _compressor(model.toxic).compress

    def window(self, w: bytes) -> int:
        """Bytes that the toxic dictionary saves on a window."""
        x = w + _END
        return len(self._good(x)) - len(self._bad(x))

    def distance(self, text: str | None) -> int:
        """Largest distance of a window together with the better one half a step aside; 0 without words."""
        u, n, best = units(text), WINDOW_WORDS, 0
        of = lambda a, b: self.window(b" ".join(u[max(0, a) : b])) if a < len(u) and b > 0 else 0
        for i in range(0, len(u), n):
            d = of(i, i + n)
            if d > 0:
                best = max(best, d + max(of(i - n // 2, i + n // 2), of(i + n // 2, i + n + n // 2)))
        return best

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, STEEPNESS * (self.distance(text) - self._threshold)))))


# --- training ---


def _trained(samples: list[bytes], size: int) -> bytes:
    """zstandard's dictionary of the samples; too few to train on are the dictionary themselves."""
    if sum(map(len, samples)) > 4 * size and len(samples) > 100:
        try:
            return zs.train_dictionary(size, samples, k=24, d=8).as_bytes()
        except zs.ZstdError:
            pass
    return b" ".join(samples)[:size]


def _without_copies(docs: list[list[bytes]]) -> list[list[bytes]]:
    """Documents of which at least half is new: copies would pass for material that recurs."""
    seen: set[int] = set()
    out = []
    for d in docs:
        words = b" ".join(d).split()
        runs = {hash(tuple(words[i : i + 4])) for i in range(max(1, len(words) - 3))}
        if 2 * len(runs & seen) <= len(runs):
            out.append(d)
        seen |= runs
    return out


def _dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionaries from the windows of documents."""
    toxic, ordinary = _without_copies(toxic), _without_copies(ordinary)
    every = [w for d in ordinary for w in d]
    random.Random(1).shuffle(every)
    base = _trained(every[:BASE_WINDOWS], BASE_BYTES)
    plain = _compressor(base).compress
    rest = {w: len(plain(w + _END)) / (len(w) + 8) for d in toxic + ordinary for w in d}

    def part(docs: list[list[bytes]], key: Callable[[bytes], tuple]) -> bytes:
        best = sorted({w for d in docs for w in d}, key=lambda w: (*key(w), w), reverse=True)
        return _trained(best[: max(50, int(len(best) * OWN_SHARE))], OWN_BYTES) + base

    def both(t: list[list[bytes]], o: list[list[bytes]], gain: dict[bytes, int]) -> tuple[bytes, bytes]:
        return part(o, lambda w: (-gain.get(w, 0), rest[w])), part(t, lambda w: (gain.get(w, 0), rest[w]))

    halves = [(toxic[i::2], ordinary[i::2]) for i in (0, 1)]
    gains: list[dict[bytes, int]] = [{}, {}]
    for _ in range(ROUNDS):
        scorers = [Scorer(Model(*both(*h, g))) for h, g in zip(halves, gains)]
        gains = [{w: scorers[1 - i].window(w) for docs in halves[i] for d in docs for w in d} for i in (0, 1)]
    return both(toxic, ordinary, gains[0] | gains[1])


def calibrated(distances: list[tuple[int, int]]) -> float:
    """Threshold between (distance, label) rows with the best sum of both labels' shares right, the ordinary one's times FALSE_ALARM; of equal ones the (upper) middle one."""
    n = [sum(y == k for _, y in distances) for k in (0, 1)]
    if not all(n):
        return THRESHOLD
    at: list[tuple[float, float]] = []
    for t in range(min(x for x, _ in distances), max(x for x, _ in distances) + 2):
        right = sum(y == 1 and x >= t for x, y in distances) / n[1] + FALSE_ALARM * sum(y == 0 and x < t for x, y in distances) / n[0]
        at.append((round(right, 9), t - 0.5))
    best = [t for r, t in at if r == max(at)[0]]
    return best[len(best) // 2]


def train(toxic: list[list[bytes]], ordinary: list[list[bytes]], texts: Callable[[list[bytes]], str] = lambda d: b" ".join(d).decode("utf-8", "replace")) -> Model:
    """Dictionaries from the windows of four fifths of the documents, the threshold from the others.

    Copies count once in the dictionaries. Without documents of a label its own part is empty and
    the threshold the default one, so that nothing is told apart.
    """
    learnt, rest = ([[d for i, d in enumerate(x) if (i % 5 == 4) == last] for x in (toxic, ordinary)] for last in (False, True))
    model = Model(*_dictionaries(*learnt))
    scorer = Scorer(model)
    return Model(model.ordinary, model.toxic, calibrated([(scorer.distance(texts(d)), y) for y, docs in ((1, rest[0]), (0, rest[1])) for d in docs]))


# --- DataFrames ---

_scorers: dict[Model, Scorer] = {}


def sample(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, ordinary_docs: int = ORDINARY_DOCS) -> tuple[list[list[bytes]], list[list[bytes]]]:
    """Windows of a bounded, repeatable sample of the labelled documents that may be learnt from.

    At most toxic_docs + ordinary_docs rows of at most DOC_WINDOWS windows come to the driver,
    however long the texts and however often an id is repeated (the greatest text of an id counts).
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("id")
    ids = known.where("toxic = 1").orderBy(order, "id").limit(toxic_docs).union(known.where("toxic = 0").orderBy(order, "id").limit(ordinary_docs))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for t in b.column(2):
                w = windows(t.as_py())
                if len(w) > DOC_WINDOWS:
                    w = [w[i] for i in sorted(sorted(range(len(w)), key=lambda i: (zlib.crc32(w[i]), i))[:DOC_WINDOWS])]
                kept.append(w)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kept, pa.list_(pa.binary()))], names=["id", "toxic", "windows"])

    some = docs.where(F.length("text") > 0).join(F.broadcast(ids), F.col("doc_id") == F.col("id"))  # at most the sum of both limits
    one = some.select("id", F.col("toxic").cast("int"), "text").groupBy("id", "toxic").agg(F.max("text").alias("text"))
    rows = one.mapInArrow(cut, "id bigint, toxic int, windows array<binary>").collect()
    rows.sort(key=lambda r: r.id)
    return tuple([[bytes(w) for w in r.windows] for r in rows if r.toxic == y and r.windows] for y in (1, 0))  # type: ignore[return-value]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train(*sample(docs, labels))


def scored(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity_score") -> DataFrame:
    """All columns of docs and out_col (0 to 1; null and empty texts score as texts without any window), which replaces a column of that name."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if model not in _scorers:
            _scorers.clear()  # a worker outlives queries
            _scorers[model] = Scorer(model)
        of = _scorers[model].score
        for texts in batches:
            yield texts.map(lambda t: of(t or ""))

    return docs.withColumn(out_col, score(F.col(text_col)))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"))
