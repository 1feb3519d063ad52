"""Cosine self-join of embeddings by an epsilon grid order.

Vectors of length one are within cosine c just when their Euclidean distance is at most
sqrt(2 - 2c) = eps, and projecting onto orthonormal directions can't lengthen a distance; nor can
it if the length of what the projection leaves out is added as one more coordinate. Vectors are
projected onto their leading principal directions, sorted lexicographically by grid cells of
width eps and cut into blocks of neighbours. Intervals of that sequence are joined recursively: a
pair of intervals whose boxes are farther apart than eps is dropped with all that it holds, others
split, down to blocks. Within a pair of blocks the same bound drops tiles, and the rest is compared
in double precision. Vectors of other lengths than one another never link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlight.llm.common import discard, materialize, table
from spanlight.llm.components import connected_components

COSINE = 0.9
#: Principal directions of the boxes, of which the first ones sort; directions beyond which vectors are first projected at random.
GRID_DIMS, SORT_DIMS, MOST_DIMS = 16, 8, 512
#: Vectors and bytes of a block at most; children of an interval; vectors of a tile.
BLOCK, BLOCK_BYTES, FAN_OUT, TILE = 8192, 4 << 20, 32, 128
#: Rounding allowance of projected distances.
SLACK = 1e-6


def _units(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple]:
    for b in batches:
        flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
        yield b.column(0), flat, flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _principal(vectors: DataFrame, dims: int, keep: int) -> np.ndarray:
    """Leading principal directions (columns) of all vectors; each task sends one sum of MOST_DIMS x MOST_DIMS at most.

    Vectors of more dimensions are first projected onto MOST_DIMS random orthonormal directions: any directions are right, these are only less telling.
    """
    some = min(dims, MOST_DIMS)
    first = np.eye(dims) if some == dims else np.linalg.qr(np.random.default_rng(3).standard_normal((dims, some)))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(some), np.zeros((some, some))
        for _, _, u in _units(batches, dims):
            u = u @ first
            n, one, two = n + len(u), one + u.sum(0), two + u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[n], one, two.ravel()])])], names=["sums"])

    sums = vectors.select("vec", "v").mapInArrow(run, "sums array<double>")
    rows = sums.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s")).collect()  # 1 + some + some x some numbers
    flat = np.zeros(1 + some + some * some)
    for r in rows:
        flat[r.pos] = r.s
    n, mean = flat[0] or 1.0, flat[1 : 1 + some] / (flat[0] or 1.0)
    _, q = np.linalg.eigh(flat[1 + some :].reshape(some, some) / n - np.outer(mean, mean))
    return np.ascontiguousarray(first @ q[:, ::-1][:, :keep])


def _projected(u: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates along the axes, and the length of the rest."""
    p = u @ axes
    return np.column_stack([p, np.sqrt(np.maximum(0.0, 1.0 - (p * p).sum(1)))])


def _unite(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Give linked vertices the least label reachable; label[v] is a vertex at most v, and its own label."""
    while True:
        a, b = label[x], label[y]
        open_ = a != b
        if not open_.any():
            return
        a, b = a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def _compare(a: tuple, b: tuple, same: bool, cosine: float, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted links of each vector of blocks a and b to the other block, and of each vector the least one it is linked to in steps (vectors of b count on from a's)."""
    (ua, wa, pa_), (ub, wb, pb) = a, b
    na, nb = np.zeros(len(ua)), np.zeros(len(ub))
    label = np.arange(len(ua) + (0 if same else len(ub)))
    at_a, at_b = np.arange(0, len(ua), TILE), np.arange(0, len(ub), TILE)
    lo_a, hi_a = np.minimum.reduceat(pa_, at_a), np.maximum.reduceat(pa_, at_a)
    lo_b, hi_b = np.minimum.reduceat(pb, at_b), np.maximum.reduceat(pb, at_b)
    tile_of_b = np.arange(len(ub)) // TILE
    for k, i in enumerate(at_a):
        gap = np.maximum(0, np.maximum(lo_a[k] - hi_b, lo_b - hi_a[k]))
        close = (gap * gap).sum(1) <= (eps + SLACK) ** 2
        if same:
            close[:k] = False
        cols = np.nonzero(close[tile_of_b])[0]
        near = ua[i : i + TILE] @ ub[cols].T >= cosine
        x, y = np.nonzero(near)
        x, y = x + i, cols[y]
        if same:  # within one block, every pair once: its tile of rows may hold both ways
            once = x < y
            x, y = x[once], y[once]
        if not len(x):
            continue
        na += np.bincount(x, wb[y], len(na))
        nb += np.bincount(y, wa[x], len(nb))
        _unite(label, x, y if same else y + len(ua))
    if same:
        na = na + nb
    return np.rint(na).astype(np.int64), np.rint(nb).astype(np.int64), label


def _leaf_pairs(boxes: DataFrame, n_blocks: int, eps: float, dims: int) -> DataFrame:
    """(a, b), a <= b: the pairs of blocks that are not provably farther apart than eps."""
    gap = F.aggregate(
        F.zip_with(
            F.zip_with("alo", "bhi", lambda x, y: x - y),
            F.zip_with("blo", "ahi", lambda x, y: x - y),
            lambda x, y: F.greatest(F.lit(0.0), x, y),
        ),
        F.lit(0.0),
        lambda s, x: s + x * x,
    )
    width = FAN_OUT
    while width < n_blocks:
        width *= FAN_OUT
    spark = boxes.sparkSession
    pairs = spark.createDataFrame([(0, 0)], "a bigint, b bigint")
    while width > 1:
        width //= FAN_OUT
        level = boxes.groupBy(F.floor(F.col("block") / width).alias("node")).agg(
            F.array(*[F.min(F.col("lo")[i]) for i in range(dims)]).alias("lo"), F.array(*[F.max(F.col("hi")[i]) for i in range(dims)]).alias("hi")
        )
        kids = level.withColumn("up", F.floor(F.col("node") / FAN_OUT))
        a = kids.select(F.col("up").alias("a"), F.col("node").alias("ka"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
        b = kids.select(F.col("up").alias("b"), F.col("node").alias("kb"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
        pairs = pairs.join(a, "a").join(b, "b").where((F.col("ka") <= F.col("kb")) & (gap <= (eps + SLACK) ** 2)).select(F.col("ka").alias("a"), F.col("kb").alias("b"))
    return pairs


def _links(distinct: DataFrame, dims: int, cosine: float) -> DataFrame:
    """(vec, n, other): weighted links of vectors of one length, in parts that add up, and a forest of the links (n = 0)."""
    eps, keep, block_size = float(np.sqrt(2 - 2 * cosine)), min(GRID_DIMS, dims), max(1, min(BLOCK, BLOCK_BYTES // (8 * dims)))
    axes = _principal(distinct, dims, keep)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            u = flat / np.linalg.norm(flat, axis=1, keepdims=True)
            cells = np.floor(u @ axes[:, :SORT_DIMS] / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(list(cells), pa.list_(pa.int32()))], names=["vec", "v", "w", "cells"])

    grid = materialize(distinct.select("vec", "v", "w").mapInArrow(project, "vec string, v array<double>, w bigint, cells array<int>"), "grid")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, []
        schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("names", pa.binary()), ("w", pa.binary()), ("u", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))])

        def block() -> pa.RecordBatch:
            names, ws, us = zip(*held)
            u = np.array(us)
            p = _projected(u, axes)
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), pa.array(["".join(names).encode()], pa.binary()), pa.array([np.array(ws, np.int64).tobytes()]), pa.array([u.tobytes()]), pa.array([p.min(0)]), pa.array([p.max(0)])], schema=schema)

        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            u = flat / np.linalg.norm(flat, axis=1, keepdims=True)
            for row in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), u):
                held.append(row)
                if len(held) == block_size:
                    yield block()
                    held, seq = [], seq + 1
        if held:
            yield block()

    spark = distinct.sparkSession
    tasks = max(1, -(-grid.count() // block_size))  # a task makes whole blocks, as few as can be
    ordered = grid.repartitionByRange(tasks, "cells", "vec").sortWithinPartitions("cells", "vec")
    cuts = materialize(ordered.select("vec", "v", "w").mapInArrow(cut, "part bigint, seq bigint, names binary, w binary, u binary, lo array<double>, hi array<double>"), "cuts")
    discard(grid)
    # A task's blocks may be small ones, so neighbours are put together to whole blocks.
    counts = cuts.select("part", "seq", (F.octet_length("w") / 8).cast("long").alias("n")).orderBy("part", "seq").collect()  # one row for each of them
    places, total = [], 0
    for r in counts:
        places.append((r.part, r.seq, total // block_size))
        total += r.n
    n_blocks = places[-1][2] + 1
    of = F.broadcast(spark.createDataFrame(places, "part bigint, seq bigint, block bigint"))
    placed = cuts.join(of, ["part", "seq"])
    pairs = materialize(_leaf_pairs(placed.select("block", "lo", "hi"), n_blocks, eps, keep + 1), "pairs")
    pieces = F.array_sort(F.collect_list(F.struct("part", "seq", "names", "w", "u")))
    blocks = materialize(placed.groupBy("block").agg(pieces.alias("p")).select("block", "p.names", "p.w", "p.u"), "blocks")
    discard(cuts)
    left = blocks.select(F.col("block").alias("a"), F.col("names").alias("an"), F.col("w").alias("aw"), F.col("u").alias("au"))
    right = blocks.select(F.col("block").alias("b"), F.col("names").alias("bn"), F.col("w").alias("bw"), F.col("u").alias("bu"))

    def compare(t: pa.Table) -> pa.Table:
        """One pair of blocks; a group is a pair, so no more than that is held."""
        row = t.combine_chunks()

        def block(side: str) -> tuple[np.ndarray, tuple]:
            names, w, u = (b"".join(row.column(side + c)[0].as_py()) for c in "nwu")
            m = np.frombuffer(u, np.float64).reshape(-1, dims)
            return np.frombuffer(names, "S64"), (m, np.frombuffer(w, np.int64), _projected(m, axes))

        same = row.column("a")[0].as_py() == row.column("b")[0].as_py()
        an, x = block("a")
        bn, y = (an, x) if same else block("b")
        na, nb, label = _compare(x, y, same, cosine, eps)
        both, n = (an, na) if same else (np.concatenate([an, bn]), np.concatenate([na, nb]))
        has, tied = np.nonzero(n)[0], np.nonzero(label != np.arange(len(label)))[0]
        names = np.concatenate([both[has], both[tied]]).astype(str)
        return pa.table({"vec": pa.array(names, pa.string()), "n": pa.array(np.concatenate([n[has], np.zeros(len(tied), np.int64)])), "other": pa.array([None] * len(has) + both[label[tied]].astype(str).tolist(), pa.string())})

    met = pairs.join(left, "a").join(right, "b").select("a", "b", "an", "aw", "au", "bn", "bw", "bu")
    return materialize(met.groupBy("a", "b").applyInArrow(compare, "vec string, n bigint, other string"), "links")


def similar_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(id_col, n_links, component_id, kept): one row for each row of vectors, over all pairs with cosine of at least `cosine`.

    n_links counts the other rows linked directly, component_id is the smallest id reachable, kept
    is whether that is the row's own. Null, empty and zero vectors and those with a null or
    non-finite component have no links and stand for themselves; vectors of different lengths don't
    link, and each length is joined by itself, so the lengths should be few. Equal vectors are
    compared once and weigh as often as they occur; rows that share an id count as separate rows in
    n_links. Extra columns are ignored.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    each = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    tagged = each.withColumn("vec", F.when(valid, F.sha2(F.concat_ws(",", F.transform("v", lambda x: F.hex((x + F.lit(0.0)).cast("string").cast("binary")))), 256)))
    ids = materialize(tagged.select("id", "vec"), "vectors")
    distinct = materialize(tagged.where("vec is not null").groupBy("vec").agg(F.first("v").alias("v"), F.count("*").alias("w"), F.min("id").alias("least")), "distinct")
    sizes = sorted(r.n for r in distinct.select(F.size("v").alias("n")).distinct().collect())
    if not sizes:
        return ids.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = None
    for n in sizes:
        some = _links(distinct if len(sizes) == 1 else distinct.where(F.size("v") == n), n, cosine)
        found = some if found is None else found.union(some)
    n_links = found.where("n > 0").groupBy("vec").agg(F.sum("n").alias("n"))
    least = distinct.select("vec", "least")
    edges = found.where("other is not null").join(least.withColumnRenamed("least", "a"), "vec").join(least.select(F.col("vec").alias("other"), F.col("least").alias("b")), "other")
    comp = connected_components(edges.select("a", "b")).select(F.col("id").alias("least"), "component")
    of_vec = distinct.select("vec", "w", "least").join(n_links, "vec", "left").join(comp, "least", "left")
    of_vec = of_vec.select("vec", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    out = ids.join(of_vec, "vec", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op3_embeddings(spark, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"))
