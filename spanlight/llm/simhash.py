"""SimHash near-duplicates over word shingles, by an inverted index on byte positions.

A fingerprint has eight positional bytes. Two fingerprints that differ in at most four bits agree
in at least four of them, so the count filter keeps only pairs that share four positional bytes.
Postings are keyed by four positions and their bytes at once: every posting list already holds
pairs with the guaranteed minimum count, a pair is taken from the list of its first four equal
positions alone, and the whole distance verifies it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanlight.llm.common import materialize, table
from spanlight.llm.components import connected_components

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
#: Posting lists longer than this are not paired; their members go through shared midpoints.
HOT_POSTINGS = 2000


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint: a bit is set if over half of the shingle hashes set it.

    A-Z is lower-cased, words are runs without ASCII white space, repeats count; a text with fewer
    words is one shingle, a text without words (or null) has fingerprint 0.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    n, digest, sep = max(1, len(parts) - words + 1), xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounds the memory of a very long text
        h = np.array([digest(sep(parts[i : i + words]), SEED) for i in range(at, min(n, at + (1 << 16)))], np.dtype("<u8"))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp long): the fingerprint's 64 bits as a signed long, one row for each input row."""
    schema = f"`{id_col}` bigint, fp bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, schema)


def _postings(distinct: DataFrame) -> DataFrame:
    """(key, fp) for each of the 70 choices of four byte positions; the key's top half is their mask."""
    keys = []
    for at in itertools.combinations(range(8), 4):
        byte = [F.shiftleft(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)), 8 * i) for i, p in enumerate(at)]
        bits = byte[0].bitwiseOR(byte[1]).bitwiseOR(byte[2]).bitwiseOR(byte[3])
        keys.append(bits.bitwiseOR(F.lit(sum(1 << p for p in at) << 32)))
    return distinct.select("fp", F.explode(F.array(*keys)).alias("key"))


def _first_four(x: Column, mask: Column) -> Column:
    """Whether mask holds the first four byte positions in which x is zero."""
    equal = F.lit(0)
    for p in range(8):
        equal = equal.bitwiseOR(F.when(F.shiftrightunsigned(x, 8 * p).bitwiseAND(F.lit(255)) == 0, 1 << p).otherwise(0))
    below = mask.bitwiseOR(F.shiftright(mask, 1))
    below = below.bitwiseOR(F.shiftright(below, 2))
    below = below.bitwiseOR(F.shiftright(below, 4))
    return equal.bitwiseAND(below) == mask


def _midpoint_links(hot: DataFrame, max_bits: int) -> DataFrame:
    """Links among fingerprints of overfull lists, without pairing them.

    Two fingerprints are within max_bits bits of each other just when some midpoint is within half
    of that (rounded up) of one and within the other half (rounded down) of the other. At most 2081
    fingerprints share a midpoint; each is linked to the least of those in the smaller half.
    """
    far, near = (max_bits + 1) // 2, max_bits // 2
    bits = [np.uint64(1) << np.uint64(i) for i in range(64)]
    masks = [(np.uint64(sum(c)), len(c) <= near) for n in range(far + 1) for c in itertools.combinations(bits, n)]
    flips, close = np.array([m for m, _ in masks], np.uint64), np.array([c for _, c in masks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 256):
                part = fps[at : at + 256]
                mid = (part[:, None] ^ flips[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(mid), pa.array(np.repeat(part, len(flips)).view(np.int64)), pa.array(np.tile(close, len(part)))], names=["mid", "fp", "close"])

    around = hot.select("fp").mapInArrow(run, "mid bigint, fp bigint, close boolean")
    least = F.min(F.when(F.col("close"), F.col("fp"))).over(W.partitionBy("mid"))
    return around.select("fp", least.alias("m")).where("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b")).distinct()


def links(distinct: DataFrame, max_bits: int = MAX_BITS, hot_postings: int = HOT_POSTINGS) -> DataFrame:
    """(a, b) between distinct fingerprints fp: every pair within max_bits (4 at most) differing bits.

    Members of lists above hot_postings are linked in stars that connect the same fingerprints as
    all their pairs would, so nothing is left out at any size.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("four shared positional bytes are guaranteed for at most four differing bits")
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(distinct.select("fp").repartition(tasks, "fp"), "distinct")  # few bytes, but 70 rows come of each
    posts = _postings(dealt)
    sizes = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # merge: Spark takes posts for as small as distinct, from which 70 times the rows come, and would broadcast them
    lists = materialize(posts.join(sizes.hint("merge"), "key"), "postings")
    cold = lists.where(F.col("n") <= hot_postings)
    a, b = cold.select("key", F.col("fp").alias("a")), cold.select("key", F.col("fp").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    pairs = a.join(b.hint("merge"), "key").where((F.col("a") < F.col("b")) & (F.bit_count(x) <= max_bits) & _first_four(x, F.shiftrightunsigned("key", 32).cast("int")))
    out = pairs.select("a", "b")
    hot = lists.where(F.col("n") > hot_postings)
    if hot.isEmpty():
        return out
    return out.union(_midpoint_links(hot.select("fp").distinct().repartition(tasks, "fp"), max_bits))


#: Vertices without any id come after all ids.
_VERTEX, _NO_ID, _ID_END = "decimal(21,0)", str(1 << 64), str(1 << 63)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, hot_postings: int = HOT_POSTINGS) -> DataFrame:
    """(id_col, fingerprint, component_id): one row for each row of docs.

    fingerprint is 16 lowercase hex digits; component_id is the smallest id reachable over links of
    at most max_bits bits. Rows of equal fingerprint are one vertex, named by their least id, so that
    a component's least vertex is its id. Null and empty texts have fingerprint 0; a null id is never
    a component's smallest (null only if a group has no other). Extra columns of docs are ignored.
    """
    each = materialize(fingerprints(docs, id_col, text_col), "simhash")
    unnamed = F.lit(_NO_ID).cast(_VERTEX) + F.col("fp").cast(_VERTEX)
    nodes = each.groupBy("fp").agg(F.min(id_col).alias("least")).select("fp", F.coalesce(F.col("least").cast(_VERTEX), unnamed.cast(_VERTEX)).alias("v"))
    nodes = materialize(nodes, "vertices")
    found = links(nodes, max_bits, hot_postings)
    # merge: any side may hold a row for every text, and compressed files don't tell how large it gets in memory
    edges = found.join(nodes.select(F.col("fp").alias("a"), F.col("v").alias("va")).hint("merge"), "a").join(nodes.select(F.col("fp").alias("b"), F.col("v").alias("vb")).hint("merge"), "b")
    comp = connected_components(edges.select(F.col("va").alias("a"), F.col("vb").alias("b")))
    of = nodes.join(comp.hint("merge"), nodes.v == comp.id, "left").select("fp", F.coalesce("component", "v").alias("component"))
    of = of.select("fp", F.when(F.col("component") < F.lit(_ID_END).cast(_VERTEX), F.col("component")).cast("bigint").alias("component_id"))
    return each.join(of.hint("merge"), "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
