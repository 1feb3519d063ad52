"""Registered queries against their SQL in DuckDB, on small tables with awkward texts."""

import random

import duckdb
import pytest

from spanlight.plans import catalogue

WORDS = "the tent stove weighs über straße naïve fuel rain 12 boils café x2 old-new a.b and or".split()


def sentence(n):
    w = random.choices(WORDS, k=n)
    return (" ".join(w) + random.choice([". ", "! ", "? ", ".\n", ", "])).capitalize()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    random.seed(21)
    d = tmp_path_factory.mktemp("mini")
    passages = [(i, " ".join(random.choices(WORDS, k=9)) + ".") for i in range(12)]
    docs = []
    for i in range(120):
        t = "".join(sentence(random.randint(1, 9)) for _ in range(random.randint(0, 8)))
        if i % 6 == 0:
            t += passages[i % 12][1] + "\n\nEnd " + passages[i % 12][1]
        docs.append((i, t, random.choice(["en", "de"]), f"src{i % 4}", len(t)))
    docs += [(120, "", "en", "src0", 0), (121, docs[3][1], "en", "src1", docs[3][4]), (122, "word", "de", "src2", 4), (123, "\n \n", "de", "src2", 3)]
    turns = [(c, t, ("system", "user", "assistant")[t % 3], sentence(5)) for c in range(15) for t in range(random.randint(1, 6))]
    turns += [(90, 0, "user", turns[0][3] + " and some more"), (91, 0, "user", turns[0][3] + " and some mere")]
    frames = {
        "documents": (docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        "benchmark": (passages, "item_id bigint, text string"),
        "labels": ([(i, i % 2, int(i % 5 == 0)) for i in range(0, 120, 2)], "doc_id bigint, quality int, toxic int"),
        "conversations": (turns, "conv_id bigint, turn bigint, role string, text string"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet/*.parquet'")
    return str(d), con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(r[i], 5) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_its_sql(spark, tables, name):
    d, con = tables
    got = catalogue.QUERIES[name](spark, d)
    want = con.sql(catalogue.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got.collect(), got.columns) == normal(want.fetchall(), want.columns)
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_other_queries_run(spark, tables, name):
    assert catalogue.QUERIES[name](spark, tables[0]).collect() is not None
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", ["coverage_confirm", "relative_floor", "context_packages"])
def test_questions_are_whole_passages(spark, tables, tmp_path, name):
    """A word far behind a passage's beginning, and more words than 64, change what is found."""
    (tmp_path / "d").mkdir()
    for t in ("documents", "labels", "conversations"):
        (tmp_path / "d" / f"{t}.parquet").symlink_to(f"{tables[0]}/{t}.parquet")
    far = " ".join(f"z{i}" for i in range(70)) + " old-new a.b and or stove weighs"
    spark.createDataFrame([(0, far), (1, "the tent"), (2, None)], "item_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/d/benchmark.parquet")
    got = catalogue.QUERIES[name](spark, f"{tmp_path}/d")
    rows = [r for r in got.collect() if r.query_id == "0"]
    assert rows and (name != "context_packages" or rows[0]["items"] + rows[0]["omissions"] > 0)
    if name in catalogue.ORACLE:
        con = duckdb.connect()
        for t in ("documents", "labels", "conversations", "benchmark"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/d/{t}.parquet/*.parquet'")
        want = con.sql(catalogue.ORACLE[name])
        assert normal(got.collect(), got.columns) == normal(want.fetchall(), want.columns)
    spark.catalog.clearCache()
