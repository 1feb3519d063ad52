import numpy as np
import pytest

from spanlight.llm import embedding_join as E


def brute(ids, vectors, cosine):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    n = [0] * len(ids)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                    n[i] += 1
                    n[j] += 1
                    x, y = find(ids[i]), find(ids[j])
                    up[max(x, y)] = min(x, y)
    return {i: (k, find(i)) for i, k in zip(ids, n)}


@pytest.mark.parametrize("block", [2048, 16])
def test_join_equals_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "TILE", 8)
    monkeypatch.setattr(E, "FAN_OUT", 4)
    rng = np.random.default_rng(block)
    centre = rng.standard_normal((20, 12))
    v = [(centre[rng.integers(20)] + 0.25 * rng.standard_normal(12)).tolist() for _ in range(160)]
    v += [v[0], v[0], [2 * x for x in v[1]], None, [], [0.0] * 12, [float("nan")] + v[2][1:], [None] + v[2][1:], [float("inf")] + v[2][1:], [-x for x in v[3]]]
    v += [v[0][:5], v[0][:5], [3 * x for x in v[0][:5]], v[4] + [0.5]]  # other lengths link among themselves
    ids = list(range(1000, 1000 + len(v)))
    df = spark.createDataFrame([(i, x, 0, "c") for i, x in zip(ids, v)], "vec_id bigint, embedding array<double>, label int, component_id string")
    got = E.similar_vectors(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(ids, v, 0.9) and len(got) == len(v)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_edges(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert E.similar_vectors(df).count() == 0
    mixed = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [2.0])], "vec_id bigint, embedding array<float>")
    assert {(r.vec_id, r.n_links, r.component_id) for r in E.similar_vectors(mixed).collect()} == {(1, 0, 1), (2, 1, 2), (3, 1, 2)}
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (4, None)]
    got = E.similar_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert sorted((r.vec_id is None, r.n_links) for r in got) == [(False, 0), (False, 2), (False, 2), (True, 2)]
    with pytest.raises(ValueError):
        E.similar_vectors(df, cosine=0)


def test_bounds_drop_only_what_is_far():
    rng = np.random.default_rng(9)
    u = rng.standard_normal((300, 24))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    axes = np.linalg.qr(rng.standard_normal((24, 6)))[0]
    p = E._projected(u, axes)
    far, bound = np.linalg.norm(u[:, None] - u[None], axis=2), np.linalg.norm(p[:, None] - p[None], axis=2)
    assert (bound <= far + 1e-9).all() and (bound > np.linalg.norm((u @ axes)[:, None] - (u @ axes)[None], axis=2) - 1e-9).all()


def test_blocks_far_apart_are_skipped(spark, monkeypatch):
    """Vectors in tight, distant clusters: most pairs of blocks must go."""
    monkeypatch.setattr(E, "BLOCK", 32)
    rng = np.random.default_rng(5)
    centre = np.eye(16)
    rows = [(i, (centre[i % 16] + 0.01 * rng.standard_normal(16)).tolist()) for i in range(640)]
    seen = []
    kept = E._leaf_pairs

    def counted(boxes, n, eps, dims):
        out = kept(boxes, n, eps, dims)
        seen.append((n, out.count()))
        return out

    monkeypatch.setattr(E, "_leaf_pairs", counted)
    got = E.similar_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert all(r.n_links == 39 and r.component_id == r.vec_id % 16 for r in got)
    n, pairs = seen[0]
    assert n >= 20 and pairs < 0.5 * n * (n + 1) / 2


def test_least_labels():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 500, (2, 350))
    label, up = np.arange(500), list(range(500))
    E._unite(label, x, y)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in zip(x.tolist(), y.tolist()):
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert label.tolist() == [find(i) for i in range(500)]
