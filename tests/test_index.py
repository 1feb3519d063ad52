import math
import random

import pytest
from pyspark.sql import functions as F

from spanlight.errors import StorageError
from spanlight.functions import columns as C
from spanlight.functions import text as T
from spanlight.operators import index as I
from spanlight.operators import retrieve
from spanlight.sources import adapters

NOTES = {
    "gear.md": "テントの重量は三百グラムです。",
    "older.md": "前のテントの重量は五百グラムでした。",
    "tarp.md": "タープはテントより軽い。重量は不明。",
    "food.md": "米を五百グラム持つ。config.toml を見る",
    "en.md": "The tent weighs 2.4kg. The tent is old; a tent, a tent.",
    "ko.md": "텐트의 무게는 가볍습니다",
}


def corpus(spark, notes=NOTES):
    rows = spark.createDataFrame(list(notes.items()), "p string, t string")
    return adapters.corpus(rows, F.col("p"), F.col("t")).withColumn("ingest_seq", F.lit(0).cast("bigint"))


def naive(notes, query):
    """BM25 as defined, in plain Python."""
    tokens = {p: [x for term in T.index_terms(t) for x in T.split_term(term)] for p, t in notes.items()}
    mean = sum(map(len, tokens.values())) / len(tokens)
    total = {}
    for parts in map(T.split_term, dict.fromkeys(T.query_terms(query))):
        if not parts:
            continue
        f = {p: sum(ts[i : i + len(parts)] == parts for i in range(len(ts))) for p, ts in tokens.items()}
        n = sum(v > 0 for v in f.values())
        idf = math.log((len(tokens) - n + 0.5) / (n + 0.5))
        for p, k in f.items():
            if k:
                total[p] = total.get(p, 0.0) + (idf if idf > 0 else 1e-6) * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * len(tokens[p]) / mean))
    return total


@pytest.mark.parametrize("query", ["テントの重量は?", "tent 2.4kg", "config.toml", "무게는", "グラム the", "???", ""])
def test_bm25_equals_the_definition(spark, query):
    docs = corpus(spark)
    idx = I.Index.built(I.sections_of(docs))
    got = idx.candidates(spark.createDataFrame([("q", query)], "query_id string, query string")).join(docs.select("document_id", "source_path"), "document_id").collect()
    want = naive(NOTES, query)
    assert {r.source_path for r in got} == set(want)
    for r in got:
        assert r.score == pytest.approx(want[r.source_path], abs=1e-12)


def test_tokens_equal_the_python_model(spark):
    random.seed(5)
    texts = ["".join(random.choice("aZß ﬁテンｶ漢字ひら안녕.,-_1２\n　🙂é") for _ in range(40)) for _ in range(60)] + ["", " "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", C.fold(F.col("t")).alias("f")).select("i", C.index_tokens(F.col("f")).alias("x")).collect()
    for r in got:
        assert r.x == [p for term in T.index_terms(texts[r.i]) for p in T.split_term(term)]


def test_needles_in_the_jvm_equal_the_python_model(spark):
    asked = ["Hello, big world?", "one", "«One»", "?!", "", "a - b", "x  y\tz"]
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, q string")
    for r in rows.select("i", C.fold(F.col("q")).alias("f")).select("i", C.needle_runs(F.col("f")).alias("n")).collect():
        assert r.n == T.needles(asked[r.i])


def test_tiles(spark):
    rows = [("d", "v", 0, 100), ("d", "v", 10, 50), ("d", "v", 20, 30), ("d", "v", 50, 50), ("e", "v", 0, 5)]
    got = I.tiles(spark.createDataFrame(rows, "document_id string, version string, start int, end int")).collect()
    assert sorted((r.document_id, r.start, r.end) for r in got) == [("d", 0, 10), ("d", 10, 20), ("d", 20, 30), ("e", 0, 5)]


def test_saved_index_and_identity(spark, tmp_path):
    docs = corpus(spark)
    idx = I.Index.built(I.sections_of(docs))
    idx.saved(str(tmp_path / "i"))
    again = I.Index.opened(spark, str(tmp_path / "i"))
    q = spark.createDataFrame([("q", "tent")], "query_id string, query string")
    assert again.candidates(q).collect() == idx.candidates(q).collect()
    gone = docs.where("source_path = 'en.md'")
    assert again.without(gone).candidates(q).count() == 0 and again.without(gone).count() == 5
    spark.createDataFrame([('{"identity": "other"}',)], "value string").coalesce(1).write.mode("overwrite").text(str(tmp_path / "i/identity"))
    with pytest.raises(StorageError):
        I.Index.opened(spark, str(tmp_path / "i"))


def test_revised_index_equals_one_built_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "MOST_DELTAS", 3)
    path = str(tmp_path / "inc")
    notes = dict(NOTES)
    I.Index.built(I.sections_of(corpus(spark, notes))).saved(path)
    asked = spark.createDataFrame([("a", "テントの重量は?"), ("b", "tent weighs new")], "query_id string, query string")
    steps = [{"en.md": "A new text: the tent weighs less."}, {"more.md": "Another tent."}, {"en.md": None}, {"more.md": "weighs"}]
    for n, step in enumerate(steps):
        notes = {k: v for k, v in (notes | step).items() if v is not None}
        docs = corpus(spark, notes)
        ids = corpus(spark, {k: v or "x" for k, v in step.items()}).select("document_id")
        I.Index.revised(spark, path, ids, I.sections_of(docs.join(ids, "document_id", "left_semi")))
        opened, whole = I.Index.opened(spark, path), I.Index.built(I.sections_of(docs))
        assert len(I._deltas(spark, path)) == (n + 1 if n < 2 else n - 2)
        assert sorted(opened.candidates(asked).collect()) == sorted(whole.candidates(asked).collect()) and opened.count() == whole.count()


def test_search(spark):
    docs = corpus(spark)
    idx = I.Index.built(I.sections_of(docs))
    queries = spark.createDataFrame([("a", "テントの重量は?"), ("b", "tent weighs"), ("c", "nowhere")], "query_id string, query string")
    results, cut = retrieve.search(queries, docs, idx)
    rows = {(r.query_id, r.source_path): r for r in results.collect()}
    assert cut.count() == 0
    assert rows["a", "gear.md"].matched == 7 and not rows["a", "gear.md"].unconfirmed
    assert rows["a", "gear.md"].text == NOTES["gear.md"] and {rows["a", p].rank for p in ("gear.md", "older.md")} == {1, 2}
    assert rows["a", "tarp.md"].matched == 0 and not rows["a", "tarp.md"].unconfirmed  # by coverage
    assert rows["b", "en.md"].text == "The tent weighs 2.4kg." and not any(q == "c" for q, _ in rows)
    got = results.where("query_id = 'a'").collect()
    assert all(NOTES[r.source_path][r.start : r.end] == r.text for r in got)


def test_relative_floor_and_truncation(spark):
    rows = [("q", 10, False), ("q", 8, False), ("q", 7, False), ("q", 0, False), ("p", 1, False)]
    df = spark.createDataFrame(rows, "query_id string, matched int, unconfirmed boolean")
    assert sorted((r.matched, r.unconfirmed) for r in retrieve.relative_floor(df).collect()) == [(0, False), (1, False), (7, True), (8, False), (10, False)]
    docs = corpus(spark)
    _, cut = retrieve.search(spark.createDataFrame([("q", "テント")], "query_id string, query string"), docs, I.Index.built(I.sections_of(docs)), candidate_limit=2)
    assert [(r.query_id, r.limit) for r in cut.collect()] == [("q", 2)]


def test_gone_version_reads_the_current_one(spark):
    docs = corpus(spark)
    idx = I.Index.built(I.sections_of(docs))
    new = corpus(spark, {"en.md": "Now the tent weighs more."})
    results, _ = retrieve.search(spark.createDataFrame([("q", "tent weighs")], "query_id string, query string"), new, idx)
    assert [r.version for r in results.collect()] == [new.first().version]


def test_sections_are_scored_where_they_are(spark):
    """Against postings: all the best of each question, ties and phrases too, and nothing shuffled for each occurrence of a word."""
    random.seed(11)
    words = "tent stove rain fuel a.b old map".split()
    notes = {f"n{i:03d}.md": " ".join(random.choices(words, k=random.randint(1, 6))) for i in range(400)}
    docs = corpus(spark, notes).repartition(5)
    asked = spark.createDataFrame([(1, "tent"), (2, "a.b rain tent"), (3, "map.map old"), (4, "?"), (None, "tent")], "query_id int, query string")
    idx = I.Index.built(I.sections_of(docs))
    plain = I.Index(idx.postings, idx.lengths)
    order = ["document_id", "start"]
    for digits in (None, 9):
        got, want = (x if digits is None else x.withColumn("score", F.round("score", digits)) for x in (idx.scored(asked, 7), plain.scored(asked, 7)))
        got, want = (sorted(map(tuple, I.top_candidates(x, order, 7).collect())) for x in (got, want))
        assert got == want and len(got) >= 14
    assert idx.scored(asked, 7).count() < 5 * 3 * 4 * 7 < plain.scored(asked, 7).count()


def test_term_totals_are_added_up_in_each_part(spark):
    docs = corpus(spark)
    idx = I.Index.built(I.sections_of(docs))
    got = idx.term_totals()
    assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, I.Index(idx.postings, idx.lengths).term_totals().collect()))
