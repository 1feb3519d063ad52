"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanlight.llm.common import BROADCAST_ROWS, discard, materialize


#: Parts of a vertex's neighbours, reduced apart and then together.
SALTS = 64


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _with_least(edges: DataFrame, few: bool) -> DataFrame:
    """(a, b, m): the edges and the least neighbour m of a. few: the edges may be broadcast.

    A vertex's neighbours are dealt into SALTS parts by their hash. Each part has its own minimum,
    the minima of a vertex meet in a window of SALTS rows at most, and go back to the parts; so no
    task has all edges of a hub.
    """
    dealt = edges.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("part"))
    least = dealt.groupBy("a", "part").agg(F.min("b").alias("m"))
    least = least.select("a", "part", F.min("m").over(W.partitionBy("a")).alias("m"))
    return dealt.join(least if few else least.hint("merge"), ["a", "part"]).select("a", "b", "m")


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(id, component) for every vertex of edges(a, b); component is the smallest reachable id.

    a and b are of one orderable type. Each round's edges are written to the shared folder. The
    number of rounds grows with the logarithm of the longest path; max_rounds is a guard against
    an endless loop only. Self-loops and nulls are ignored, so vertices that have only those are absent.
    """
    now = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    seen = _state(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        few = 2 * seen[0] <= BROADCAST_ROWS
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, few).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = _with_least(large, few).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        then = materialize(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        discard(now)
        now, before = then, seen
        seen = _state(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
