import random

import pytest
from pyspark.sql import functions as F

from spanlight.llm import components
from spanlight.llm import simhash as S
from spanlight.llm.components import connected_components


def roots(links):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def test_components(spark):
    random.seed(2)
    links = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + i) for i in range(1, 200)] + [(7, 7)]
    rows = spark.createDataFrame(links + [(None, 3)], "a bigint, b bigint")
    want = roots([x for x in links if x[0] != x[1]])
    assert {r.id: r.component for r in connected_components(rows).collect()} == want
    assert connected_components(rows.limit(0)).count() == 0


def test_components_of_long_paths(spark):
    rows = spark.range(5000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connected_components(rows).where("component <> 0").count() == 0


def test_fingerprints_of_edge_cases():
    assert S.fingerprint(None) == S.fingerprint("") == S.fingerprint(" \t\n") == 0
    assert S.fingerprint("A b") == S.fingerprint("a\x0bB") != S.fingerprint("a b c")
    assert S.fingerprint("É") != S.fingerprint("é")  # only A-Z is lower-cased
    long = "word " * 200_000
    assert S.fingerprint(long) == S.fingerprint("word word word word")


@pytest.mark.parametrize("hot,bits", [(2000, 4), (3, 4), (3, 3), (3, 2), (3, 1), (3, 0)])
def test_links_equal_all_pairs(spark, hot, bits):
    random.seed(hot)
    base = [random.getrandbits(64) for _ in range(12)]
    fps = {0, *base}
    for b in base:
        for _ in range(25):
            x = b
            for bit in random.sample(range(64), random.randint(0, 7)):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = [(r.a % (1 << 64), r.b % (1 << 64)) for r in S.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), bits, hot_postings=hot).collect()]
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= bits}
    if hot == 2000:
        assert {tuple(sorted(p)) for p in got} == want and len(got) == len(want)
    assert roots(got) == roots(want) and all((a ^ b).bit_count() <= bits for a, b in got)
    with pytest.raises(ValueError):
        S.links(spark.createDataFrame([(1,)], "fp bigint"), 5)


def test_near_duplicates(spark):
    random.seed(1)
    words = [f"w{i}" for i in range(400)]
    text = " ".join(random.choices(words, k=300))
    near = text.replace(" ", "  ", 5).upper().lower()
    rows = [(5, text, "x"), (3, near, "x"), (9, text, None), (9, text, None), (4, "other text altogether here", "x"), (None, text, "x"), (7, "", "x"), (8, None, "x"), (None, "alone it stands quite", "x")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, source string, fp int, component int")
    got = S.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.component_id) for r in got}
    assert {(5, 3), (3, 3), (9, 3), (4, 4), (7, 7), (8, 7), (None, 3), (None, None)} == by
    assert {r.fingerprint for r in got if r.doc_id in (7, 8)} == {"0" * 16}
    assert S.near_duplicates(df.limit(0)).count() == 0
    assert {r.fingerprint for r in got if r.doc_id == 5} == {f"{S.fingerprint(text):016x}"}
    assert got[0].asDict().keys() == {"doc_id", "fingerprint", "component_id"} and F


def test_many_rows_are_not_broadcast(spark, monkeypatch):
    """No side of a join that grows with the texts goes to the driver, however small its files are."""
    plans = []

    def recorded(df, tag, write=S.materialize):
        plans.append((tag, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, tag)

    monkeypatch.setattr(S, "materialize", recorded)
    monkeypatch.setattr(components, "materialize", recorded)
    monkeypatch.setattr(components, "BROADCAST_ROWS", 0, raising=False)
    random.seed(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(random.choices(words, k=300)) for _ in range(8)]
    rows = [(10 * i + k, t + f" x{k}" * (k > 0)) for i, t in enumerate(base) for k in range(4)]
    out = S.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    plans.append(("result", out._jdf.queryExecution().executedPlan().toString()))
    fps = {i: S.fingerprint(t) for i, t in rows}
    linked = roots([(i, j) for i in fps for j in fps if (fps[i] ^ fps[j]).bit_count() <= S.MAX_BITS])
    assert {r.doc_id: r.component_id for r in out.collect()} == linked and len(set(linked.values())) < len(rows)
    assert {"postings", "edges", "result"} <= {tag for tag, _ in plans} and not {tag for tag, p in plans if "Broadcast" in p}
