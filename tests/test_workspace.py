import io
import json

import pytest
from pyspark.sql import functions as F

from spanlight import config, errors, server
from spanlight.cli import parser
from spanlight.errors import SettingsError, UsageError
from spanlight.operators import evaluate
from spanlight.operators.index import Index, sections_of
from spanlight.model import Budget
from spanlight.plans import context, evaluation
from spanlight.sources import adapters
from spanlight.sources.ingest import Store
from spanlight.streaming import incremental
from spanlight.workspace import Workspace


def test_settings(tmp_path):
    f = tmp_path / "s.json"
    f.write_text('{"limit": 3, "ordering": "mmr"}')
    s = config.load(str(f), env={"SPANLIGHT_LIMIT": "4"}, flags={"context": 9, "store": None})
    assert (s.limit, s.ordering, s.context) == (4, "mmr", 9)
    for bad in ({"nope": 1}, {"limit": "x"}, {"ordering": "z"}, {"limit": 0}):
        with pytest.raises(SettingsError):
            config.load(env={}, flags=bad)
    with pytest.raises(SettingsError):
        config.load(env={}, flags={"indexes": "a/b=c"}).named_indexes()


def test_workspace_and_server(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "stoves.md").write_text("# Stoves\n\nThe alcohol stove boils half a litre in eight minutes.\n\n## Fuel\n\nCarry fuel.\n")
    (notes / "tarp.txt").write_text("The tarp weighs 310 grams.")
    s = config.load(env={}, flags={"store": f"{tmp_path}/store", "index": f"{tmp_path}/index"})
    ws = Workspace(spark, s)
    with pytest.raises(errors.StorageError):
        ws.index()
    ws.ingest(str(notes))
    rows, cut = ws.search("alcohol stove")
    assert rows[0]["source_path"] == "stoves.md" and rows[0]["section"] == "Stoves" and not cut
    made = ws.context("alcohol stove boils", "characters:200", at="2024-01-01")
    report = ws.verify(made, json.dumps({"claims": [{"text": "c", "citations": ["half a litre"]}]}), at="2024-01-02")
    assert report["clean"] and ws.usage()["cited_share"] == 1.0
    assert ws.trace("310 grams")[0]["source_path"] == "tarp.txt"
    (notes / "tarp.txt").write_text("The tarp weighs 311 grams.")
    assert ws.doctor(str(notes)) == {"documents": 2, "versions": 2, "revised": 0, "sections": 3, "drifted": 1}
    stale = ws.context("tarp weighs", root=str(notes))
    assert stale["items"] == [] and stale["omissions"][0]["rule"] == "stale_anchor" and ws.leads(stale)[0]["text"].startswith("The tarp")
    out = io.StringIO()
    asks = [{"id": 1, "method": "initialize"}, {"method": "note"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "tarp"}}}, {"id": 4, "method": "tools/call", "params": {"name": "search", "arguments": {}}}, {"id": 5, "method": "x"}]
    server.serve(ws, io.StringIO("\n".join(map(json.dumps, asks)) + "\nnot json\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g.get("id") for g in got] == [1, 2, 3, 4, 5, None] and len(got[1]["result"]["tools"]) == 6
    assert not got[2]["result"]["isError"] and got[3]["result"]["isError"] and got[4]["error"]["code"] == -32601
    assert ws.forget(["tarp.txt"]) == 1 and ws.search("tarp")[0] == [] and ws.forget(["tarp.txt"]) == 0
    with pytest.raises(UsageError):
        ws.search(" ")
    assert ws.forget_ledger() == 2 and ws.forget_ledger() == 0
    (notes / "_new.md").write_text("A hidden tarp.")
    ws.ingest(str(notes))  # a second ingest revises the index
    assert {r["source_path"] for r in ws.search("tarp")[0]} == {"_new.md", "tarp.txt"}
    both = config.load(env={}, flags={"store": f"{tmp_path}/store", "index": f"{tmp_path}/index", "indexes": f"default={tmp_path}/index,other={tmp_path}/nowhere"})
    rows = {r["index"]: r for r in Workspace.summaries(spark, both)}
    assert rows["default"]["documents"] == 3 and rows["default"]["unavailable"] is None
    assert rows["other"]["documents"] is None and rows["other"]["unavailable"] == "AnalysisException"
    with pytest.raises(UsageError):
        Workspace(spark, s, "other")


def test_ask(spark):
    docs = adapters.corpus(spark.createDataFrame([("a.txt", "The tent weighs 310 grams in all.")], "p string, t string"), F.col("p"), F.col("t")).withColumn("ingest_seq", F.lit(0).cast("bigint"))

    class Parrot:
        def generate(self, prompt):
            assert "tent weighs" in prompt
            return json.dumps([{"text": "c", "citations": ["weighs 310 grams"]}, {"text": "d", "citations": ["weighs 9 tons"]}])

    q = spark.createDataFrame([("q", "tent weighs")], "query_id string, query string")
    out = context.ask(q, docs, Index.built(sections_of(docs)), Budget("characters", 300), Parrot(), at="2024")
    assert [r.support for r in out["claims"].orderBy("claim_no").collect()] == ["supported", "unsupported"]
    assert out["reports"].first().clean is False and out["entries"].first().cited_items == 1


def test_cases(spark, tmp_path):
    def case(name, question, files, **spec):
        d = tmp_path / name / "corpus"
        d.mkdir(parents=True)
        for f, t in files.items():
            (d / f).write_text(t, encoding="utf-8")
        base = {"question": question, "language": "en", "genre": "gear", "tier": "ci", "split": "train", "origin": "handwritten", "budget": "characters:300", "must_include": [], "must_not_include": [], "traps": {}}
        (tmp_path / name / "case.json").write_text(json.dumps(base | spec))

    case("tent-00", "tent weighs", {"now.md": "{{F:w}}The tent weighs 310 grams.{{/F}}", "other.md": "{{F:x}}The stove is old.{{/F}}"}, must_include=["w"], must_not_include=["x"])
    case("tent-01", "tent weighs how much", {"a.md": "{{F:a}}The tent is green, it weighs.{{/F}}"}, must_not_include=["a"], traps={"a": {"kind": "near_miss", "expect_omission_rule": "below_threshold"}}, genre="trap")
    table, broken = evaluation.evaluated(spark, str(tmp_path))
    whole = next(r for r in table if r["genre"] is None and r["language"] is None and r["origin"] is None)
    assert whole["cases"] == 2 and whole["evidence_recall"] == 1.0 and whole["trap_rate"] == 0.0 and whole["omission_correctness"] == 1.0 and broken == []
    only, _ = evaluation.evaluated(spark, str(tmp_path), tier="ci", split="train")
    assert only[0]["cases"] and evaluate.FLOORS["evidence_recall"] == 0.95


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = spark.createDataFrame([("a", "one"), ("b", "two")], "p string, t string")
    adapters.corpus(rows, F.col("p"), F.col("t")).withColumn("corpus_root", F.lit("r")).write.parquet(str(src))
    st = Store(spark, str(tmp_path / "store"))
    seen = []
    stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src))
    incremental.ingest_stream(stream, st, str(tmp_path / "cp"), lambda r, n: seen.append(r.count())).awaitTermination(60)
    assert seen == [2] and st.current().count() == 2
    e = spark.createDataFrame([("2024-01-01 10:05:00", 2, 1), ("2024-01-01 10:55:00", 1, 0), ("2024-01-01 11:00:00", 3, 0)], "at string, items int, omissions int").withColumn("created_at", F.to_timestamp("at"))
    got = incremental.usage_by_window(e).orderBy("start").collect()
    assert [(r.packages, r.items) for r in got] == [(2, 3), (1, 3)]


def test_parser_and_errors(spark):
    assert parser().parse_args(["context", "q", "--budget", "bytes:9"]).budget == "bytes:9"
    assert errors.catalogue(spark).count() == 9 and len({e.exit_code for e in errors.CATALOGUE}) == 9


def test_weights(spark):
    df = spark.createDataFrame([(10, 0, 2.0), (0, 10, 5.0), (10, 10, 7.0)], "latin int, digit int, tokens double")
    w = evaluation.fitted_weights(df)
    assert w["latin"] == pytest.approx(0.2) and w["digit"] == pytest.approx(0.5)
