"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A sketch is a row of cells, each the count, the xor of digests and the xor of their check values
of the paragraphs that hash to it. Sketches of two versions subtract cell by cell; what the
versions share cancels, and peeling cells with one digest left recovers the digests by which they
differ. A sketch's size follows from its own text: the least power of two (three times) at which
all of it peels. Cells are addressed by the low bits of a hash, so the larger of two sketches folds
to the size of the other. Where the difference of both is too much for that size, peeling fails,
and is tried again at the full size of each, at which either recovers all its digests. So two
fingerprints always tell their difference, without the texts.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlight.llm.common import table

#: Words from which a sentence is cut further, at words picked by their own hash.
LONG_WORDS = 40
#: Bytes of text (in code points) of a range of ids, one task's share.
RANGE_CHARS = 64_000_000

_SENTENCE = re.compile(r"[^\n.!?]*[.!?]+|[^\n.!?]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_CHECK = np.uint64(0xFF51AFD7ED558CCD)


def paragraphs(text: str) -> list[str]:
    """Paragraph units of a text: sentences within lines; very long ones are cut where the words, not the position, say so.

    Whole paragraphs would be too coarse: a text of one paragraph has no unit left after any edit.
    """
    out = []
    for m in _SENTENCE.finditer(text):
        unit = m[0].strip()
        if not unit:
            continue
        if len(unit) > 4 * LONG_WORDS and len(words := unit.split()) > LONG_WORDS:
            at = 0
            for i, w in enumerate(words):
                if xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass"), 3) % 12 == 0:
                    out.append(" ".join(words[at : i + 1]))
                    at = i + 1
            unit = " ".join(words[at:])
        if unit:
            out.append(unit)
    return out


def digests(text: str) -> np.ndarray:
    """Distinct 64-bit digests; the n-th copy of a paragraph has a digest of its own."""
    seen: dict[str, int] = {}
    out = []
    for p in paragraphs(text):
        n = seen[p] = seen.get(p, -1) + 1
        out.append(xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass"), n))
    return np.unique(np.array(out, np.uint64))


def _check(keys: np.ndarray) -> np.ndarray:
    x = keys * _CHECK
    return (x ^ (x >> np.uint64(31))) >> np.uint64(32)


class Sketches:
    """Sketches one after another in flat arrays: 3 << bits[i] cells each, so that many are built and peeled at a time."""

    __slots__ = ("bits", "checks", "counts", "keys", "start")

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = np.asarray(bits, np.int64)
        self.start = np.concatenate([[0], np.cumsum(3 << self.bits)])
        self.counts = np.zeros(self.start[-1], np.int64)
        self.keys, self.checks = np.zeros(self.start[-1], np.uint64), np.zeros(self.start[-1], np.uint64)

    def add(self, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray | int = 1) -> None:
        """Digests keys, each into three cells of the sketch owner."""
        check, bits = _check(keys), self.bits[owner]
        low = ((np.uint64(1) << bits.astype(np.uint64)) - np.uint64(1))[None, :]
        x = keys[None, :] * _MIX[:, None]
        at = (self.start[owner] + (np.arange(3)[:, None] << bits) + ((x >> np.uint64(32)) & low).astype(np.int64)).ravel()
        np.add.at(self.counts, at, np.broadcast_to(sign, (3, len(keys))).ravel())
        np.bitwise_xor.at(self.keys, at, np.tile(keys, 3))
        np.bitwise_xor.at(self.checks, at, np.tile(check, 3))

    def sizes(self) -> np.ndarray:
        """Digests in each sketch, by its counts."""
        return (np.add.reduceat(self.counts, self.start[:-1]) // 3) if len(self.bits) else np.zeros(0, np.int64)

    def take(self, which: np.ndarray) -> Sketches:
        out = Sketches(self.bits[which])
        at = np.concatenate([np.arange(self.start[i], self.start[i + 1]) for i in which] or [np.zeros(0, np.int64)]).astype(np.int64)
        out.counts, out.keys, out.checks = self.counts[at], self.keys[at], self.checks[at]
        return out

    def folded(self, bits: np.ndarray) -> Sketches:
        """The sketches that the same digests give at smaller sizes."""
        out = Sketches(np.minimum(bits, self.bits))
        owner = np.repeat(np.arange(len(self.bits)), 3 << self.bits)
        at = np.arange(self.start[-1]) - self.start[owner]
        row, cell = at >> self.bits[owner], at & ((1 << self.bits[owner]) - 1)
        to = out.start[owner] + (row << out.bits[owner]) + (cell & ((1 << out.bits[owner]) - 1))
        np.add.at(out.counts, to, self.counts)
        np.bitwise_xor.at(out.keys, to, self.keys)
        np.bitwise_xor.at(out.checks, to, self.checks)
        return out

    def minus(self, other: Sketches) -> Sketches:
        """Differences of sketches pair by pair, at the smaller size of each pair."""
        a, b = self.folded(other.bits), other.folded(self.bits)
        a.counts, a.keys, a.checks = a.counts - b.counts, a.keys ^ b.keys, a.checks ^ b.checks
        return a

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, digest, sign) of all that can be recovered, and which sketches were emptied by it. Changes the cells."""
        home = np.repeat(np.arange(len(self.bits)), 3 << self.bits)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            one = np.nonzero(np.abs(self.counts) == 1)[0]
            one = one[_check(self.keys[one]) == self.checks[one]]
            if not len(one):
                break
            order = np.lexsort((self.keys[one], home[one]))
            one = one[order]
            fresh = np.concatenate([[True], (home[one][1:] != home[one][:-1]) | (self.keys[one][1:] != self.keys[one][:-1])])
            one = one[fresh]
            owner, keys, sign = home[one], self.keys[one], self.counts[one]
            found.append((owner, keys, sign))
            self.add(owner, keys, -sign)
            if len(found) > 64 and sum(len(f[0]) for f in found) > 8 * len(self.counts):
                break  # only colliding check values could go on like this
        full = (self.counts != 0) | (self.keys != 0)
        left = np.logical_or.reduceat(full, self.start[:-1]) if len(self.bits) else np.zeros(0, bool)
        none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        owner, keys, sign = (np.concatenate(x) for x in zip(none, *found))
        return owner, keys, sign, ~left

    def text(self, i: int) -> str:
        """Base64 of a sketch's cells; equal sketches have equal texts."""
        at = slice(self.start[i], self.start[i + 1])
        return base64.b64encode(self.counts[at].astype("<i4").tobytes() + self.keys[at].astype("<u8").tobytes() + self.checks[at].astype("<u4").tobytes()).decode()


def _read(fingerprint: str) -> Sketches:
    raw = base64.b64decode(fingerprint)
    cells = len(raw) // 16
    out = Sketches(np.array([(cells // 3).bit_length() - 1]))
    out.counts = np.frombuffer(raw, "<i4", cells).astype(np.int64)
    out.keys, out.checks = np.frombuffer(raw, "<u8", cells, 4 * cells).copy(), np.frombuffer(raw, "<u4", cells, 12 * cells).astype(np.uint64)
    return out


def sketched(digest_sets: list[np.ndarray]) -> Sketches:
    """A sketch of each set, at the least size of at least 1.5 cells a digest at which all of it peels."""
    n = np.array([len(d) for d in digest_sets], np.int64)
    bits = np.array([max(2, int(k // 2).bit_length()) for k in n.tolist()], np.int64)
    keys = np.concatenate([*digest_sets, np.zeros(0, np.uint64)]).astype(np.uint64)
    owner = np.repeat(np.arange(len(n)), n)
    todo = np.arange(len(n))
    while len(todo):
        here = np.isin(owner, todo)
        trial = Sketches(bits[todo])
        trial.add(np.searchsorted(todo, owner[here]), keys[here])
        *_, whole = trial.peel()
        todo = todo[~whole]
        bits[todo] += 1
    out = Sketches(bits)
    out.add(owner, keys)
    return out


def fingerprint(text: str | None) -> str:
    return sketched([digests(text or "")]).text(0)


def apart(a: Sketches, b: Sketches) -> np.ndarray:
    """How many digests each pair of sketches differs by, from the sketches alone."""
    owner, _, _, whole = a.minus(b).peel()
    out = np.bincount(owner, minlength=len(a.bits))
    again = np.nonzero(~whole)[0]
    if len(again):  # too far apart for the smaller size: either one by itself
        (oa, ka, _, _), (ob, kb, _, _) = (x.take(again).peel() for x in (a, b))
        for j, i in enumerate(again):
            out[i] = len(np.setxor1d(ka[oa == j], kb[ob == j]))
    return out


def likenesses(a: Sketches, b: Sketches) -> np.ndarray:
    """Share of the digests of either text that both have, of each pair; 1 if neither has any."""
    both, d = a.sizes() + b.sizes(), apart(a, b)
    return np.where(both + d == 0, 1.0, (both - d) / np.maximum(1, both + d))


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints."""
    return float(likenesses(_read(a), _read(b))[0])


def difference(a: str, b: str) -> tuple[set[int], set[int]]:
    """Digests of paragraphs in the text of fingerprint a alone, and in b's alone."""
    x, y = _read(a), _read(b)
    _, keys, sign, whole = x.minus(y).peel()
    if whole[0]:
        return {int(k) for k, s in zip(keys, sign) if s > 0}, {int(k) for k, s in zip(keys, sign) if s < 0}
    one, other = ({int(k) for k in z.peel()[1]} for z in (x, y))
    return one - other, other - one


def edited(text: str, following: str) -> str:
    """text whose last half (rounded down) is replaced by as much of the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _range_of(k: Column, h: Column, cuts: list[tuple[int, int]]) -> Column:
    """How many of the sorted cuts are at most (k, h): a binary search, in the JVM."""
    if not cuts:
        return F.lit(0)
    ks, hs = (F.array(*[F.lit(c[i]) for c in cuts]) for i in (0, 1))

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        at = F.least(mid, F.lit(len(cuts) - 1))
        ck, ch = F.get(ks, at), F.get(hs, at)
        right = (ck < k) | ((ck == k) & (ch <= h))
        open_ = acc["lo"] < acc["hi"]
        return F.struct(F.when(open_ & right, mid + 1).otherwise(acc["lo"]).cast("int").alias("lo"), F.when(open_ & ~right, mid).otherwise(acc["hi"]).cast("int").alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    return F.aggregate(F.array(*[F.lit(0)] * (len(cuts).bit_length() + 1)), start, step, lambda acc: acc["lo"])


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_chars: int = RANGE_CHARS) -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): one row for each row of docs.

    The next document is the next in descending id, then descending hash and text (so repeated rows
    follow one another; null ids come last), after the last the first; a single document follows
    itself. near_* come from the two fingerprints alone. Null texts count as empty. Documents are
    dealt out once by ranges of id and text hash of about range_chars code points, so rows of one id
    (or of none) are split too unless their texts are equal, and each range gets the head of the next as a
    guest. Extra columns are ignored.
    """
    least = -(1 << 63)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.coalesce("id", F.lit(least))).withColumn("h", F.xxhash64("text"))
    total = rows.agg(F.count("*"), F.sum(F.length("text"))).first()
    schema = f"`{id_col}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not total[0]:
        return spark.createDataFrame([], schema)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total[1] or 0) // range_chars))
    cuts: list[tuple[int, int]] = []
    if n > 1:
        ks = sorted(rows.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 20 * n)).first()[0])
        # an id with more rows than a range is cut by the texts' hashes too, as often as it was met
        cuts = sorted((k, least + (i << 64) // (met + 1)) for k, met in Counter(ks).items() for i in range(met + 1 if met > 1 else 1))
    part = _range_of(F.col("k"), F.col("h"), cuts)
    rows = rows.withColumn("part", part)
    heads = rows.groupBy("part").agg(F.max(F.struct("k", "h")).alias("top")).collect()  # a row for each range
    tops = sorted((r.part, r.top.k, r.top.h) for r in heads)
    goes = [(k, h, tops[(i + 1) % len(tops)][0]) for i, (_, k, h) in enumerate(tops)]  # the head of a range is the guest of the range above
    to = F.broadcast(spark.createDataFrame(goes, "k bigint, h bigint, goes int"))  # as many rows as ranges
    guests = rows.where(F.col("k").isin(sorted({k for k, _, _ in goes}))).join(to, ["k", "h"]).groupBy("k", "h", "goes").agg(F.max("text").alias("text"))
    both = rows.select("id", "k", "h", "text", "part", F.lit(0).alias("guest")).union(guests.select(F.lit(None).cast("bigint"), "k", "h", "text", F.col("goes"), F.lit(1)))
    dealt = both.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("guest", F.desc("k"), F.desc("h"), F.desc("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            """Rows of all that is held but the last, whose next document isn't known yet."""
            new = [edited(a[1], b[1]) for a, b in zip(held, held[1:])]
            own, changed = sketched([keys for _, _, keys in held]), sketched([digests(t) for t in new])
            m = np.arange(len(new))
            first = own.take(m)
            near = likenesses(first, changed), likenesses(first, own.take(m + 1))
            sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]
            cols = [[i for i, _, _ in held[:-1]], [len(t) for _, t, _ in held[:-1]], sha, [own.text(i) for i in m], [changed.text(i) for i in m], *near]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            del held[:-1]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        size = 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py()
                held.append((i, text, digests(text)))
                size += len(text)
                if len(held) > 1 and (len(held) > 512 or size > 2_000_000):
                    yield out()
                    size = len(text)
        if len(held) > 1:
            yield out()

    return dealt.select("id", "text").mapInArrow(run, schema)


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
