import random

import pytest
from pyspark.sql import functions as F

from spanlight.errors import ContractError, SettingsError, UsageError
from spanlight.model import Budget, Protection, Span, block_kinds, register_block_kind
from spanlight.operators import redundancy, select
from spanlight.functions import text as T
from spanlight.operators.index import Index, sections_of
from spanlight.plans import context, package
from spanlight.sources import adapters
from tests.test_index import NOTES, corpus


def cand(i, score=1.0, text=None, cost=10, date=None, bad=None, path=None):
    text = text if text is not None else f"text number {i} is quite its own {i * 7919}"
    return {"query": "q", "text": text, "document_id": f"d{i}", "version": "v", "start": 0, "end": len(text), "text_hash": "h", "source_path": path or f"p{i}", "section": "", "score": score, "signals": ["s"], "provenance": {"layer": "fact", "producer": "p", "observed_at": date, "confidence": None}, "observed_at": date, "disqualified": bad, "cost": cost}


def test_fill_goes_on_after_what_does_not_fit():
    c = [cand(1, cost=60), cand(2, cost=60), cand(3, cost=40)]
    items, omissions, spent = select.fit(c, Budget("characters", 100))
    assert [i["document_id"] for i in items] == ["d1", "d3"] and spent == 100
    assert [o["rule"] for o in omissions] == ["budget_exhausted"]


def test_copies_go_last_and_say_what_they_repeat():
    same = "the very same passage about tents and stoves"
    c = [cand(1, text=same), cand(2, text=same + "."), cand(3)]
    items, omissions, _ = select.fit(c, Budget("characters", 100))
    assert [i["document_id"] for i in items] == ["d1", "d3", "d2"] and items[2]["signals"][1] == "redundant_with:itm_001"
    items, omissions, _ = select.fit(c, Budget("characters", 20))
    assert [o["rule"] for o in omissions] == ["redundant_candidate"]


def test_disqualified_low_and_capped():
    c = [cand(1, bad={"rule": "stale_anchor", "reason": "r"}), cand(2, score=0.1), cand(3)]
    items, omissions, _ = select.fit(c, Budget("characters", 100), minimum=0.5, truncated_at=3)
    assert [o["rule"] for o in omissions] == ["stale_anchor", "below_threshold", "truncated_by_cap"] and len(items) == 1


@pytest.mark.parametrize("seed", range(5))
def test_column_orderings_equal_the_python_ones(spark, seed):
    random.seed(seed)
    c = [cand(i, score=random.choice([0.1, 0.5, 0.5, 2.0]), date=random.choice([None, "2024-01-01", "2024-01-02", "2023-12-31T10:00"]), path=random.choice("ab")) for i in range(12)]
    df = spark.createDataFrame([("q", x["document_id"], x["source_path"], 0, x["score"], x["observed_at"]) for x in c], "query_id string, document_id string, source_path string, start int, score double, observed_at string")
    for col, py in ((select.order_by_score, select.by_score), (select.order_by_recency, select.by_recency)):
        assert [r.document_id for r in col(df).orderBy("place").collect()] == [x["document_id"] for x in py(c)]


def test_mmr_prefers_what_is_different():
    a = "alpha beta gamma delta epsilon zeta"
    c = [cand(1, 1.0, a), cand(2, 0.99, a + "!"), cand(3, 0.8, "something else entirely, about rivers")]
    assert [x["document_id"] for x in select.by_diversity(c)] == ["d1", "d3", "d2"]
    assert select.by_diversity([]) == []


def test_orderings_by_name_and_rerank():
    with pytest.raises(SettingsError):
        select.selected_ordering("best")
    rer = select.reranked(select.by_score, lambda q, ts: [len(t) for t in ts])
    assert [x["document_id"] for x in rer([cand(1, 2.0, "aa"), cand(2, 1.0, "aaaa")])] == ["d2", "d1"]


def test_column_fill_equals_the_greedy_loop(spark):
    random.seed(3)
    rows = [(q, i, random.randint(1, 40)) for q in "xy" for i in range(20)]
    got = {(r.query_id, r.place): r.sent for r in select.filled(spark.createDataFrame(rows, "query_id string, place int, cost int"), 100).collect()}
    for q in "xy":
        spent = 0
        for _, i, c in (r for r in rows if r[0] == q):
            assert got[q, i] == (spent + c <= 100)
            spent += c if spent + c <= 100 else 0


def test_similar_pairs_equal_all_pairs(spark):
    random.seed(1)
    texts = ["".join(random.choice("abc ") for _ in range(random.randint(0, 25))) for _ in range(60)] + ["aaaaaa", "AAAAAA ", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for t in (0.5, 0.75, 1.0):
        got = {(r.a, r.b): (r.containment, r.jaccard) for r in redundancy.similar_pairs(rows, "i", "t", t).collect()}
        sets = [T.shingles(x) for x in texts]
        want = {(i, j): T.similarity(sets[i], sets[j]) for i in range(len(texts)) for j in range(i + 1, len(texts))}
        want = {k: v for k, v in want.items() if v[0] >= t and v[0] > 0}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_duplicate_heads(spark):
    rows = [("g", 0, "the very same passage"), ("g", 1, "the very same passage"), ("h", 0, "x"), ("g", 2, "other words here")]
    got = redundancy.duplicate_heads(spark.createDataFrame(rows, "group_id string, place int, text string")).collect()
    assert [(r.group_id, r.place, r.head, r.containment) for r in got] == [("g", 1, 0, 1.0)]


def build(spark, budget="characters:60", **kw):
    docs = corpus(spark)
    q = spark.createDataFrame([("a", "テントの重量は?"), ("b", "nothing of it")], "query_id string, query string")
    return context.build(q, docs, Index.built(sections_of(docs)), Budget.parse(budget), **kw)


def test_packages(spark):
    rows = {r.query_id: r for r in build(spark, created_at="t").collect()}
    made = package.read_back(rows["a"].json)
    assert [i["anchor"]["source_path"] for i in made["items"]] == ["older.md", "gear.md", "tarp.md"]
    assert made["items"][1]["text"] == NOTES["gear.md"] and made["items"][1]["selection"]["signals"] == ["lexical_match", "confirmed_in_text", "confirmed_share:0.88"]
    assert rows["b"].items == [] and package.read_back(rows["b"].json)["omissions"] == []
    again = {r.query_id: r.package_id for r in build(spark, created_at="later").collect()}
    assert again == {k: r.package_id for k, r in rows.items()}  # the time is not part of the id
    text = package.render(made)
    assert text.index("# SYSTEM") < text.index("# TASK") < text.index("# CONTEXT") and "[itm_002] gear.md[0:15]" in text


def test_tight_budget_and_account(spark):
    row = next(r for r in build(spark, "characters:16").collect() if r.query_id == "a")
    assert len(row["items"]) == 1 and {o.rule for o in row.omissions} >= {"budget_exhausted"}
    df = spark.createDataFrame([row], build(spark).schema)
    why = df.select(package.why_not(F.col("omissions")).alias("w")).first().w
    assert why.startswith(f"{len(row.omissions)} candidates were left out:\n  b")
    docs = adapters.as_documents(df).orderBy("n").collect()
    assert [d.metadata["kind"] for d in docs] == ["item"] + ["omission"] * len(row.omissions) and docs[-1].text == ""


def test_token_budget_states_its_error(spark):
    made = package.read_back(next(r.json for r in build(spark, "tokens:400").collect() if r.query_id == "a"))
    assert made["budget"]["measured_error"]["against"] == "cl100k_base"


def test_altered_packages_are_refused(spark):
    import json

    made = json.loads(next(r.json for r in build(spark).collect() if r.query_id == "a"))
    for change in ({"more": 1}, {"contract": "x/1"}, {"query": " "}, {"query": "another question"}, {"budget": made["budget"] | {"estimate": 1}}, {"items": made["items"] + made["items"][:1]}):
        with pytest.raises(ContractError):
            package.read_back(json.dumps(made | change))
    with pytest.raises(ContractError):
        package.read_back("[")


def test_small_values():
    assert Budget.parse("bytes:7").remaining(9) == 0
    for bad in ("100", "words:3", "tokens:0", "tokens:x"):
        with pytest.raises(UsageError):
            Budget.parse(bad)
    with pytest.raises(UsageError):
        Protection("r", "s", 1)
    assert Span(1, 3).overlaps(Span(2, 5)) and not Span(1, 2).overlaps(Span(2, 3)) and Span(0, 9).contains(Span(1, 2))
    with pytest.raises(UsageError):
        Span(0, 9).slice("abc")
    register_block_kind("aside")
    assert "aside" in block_kinds()
    with pytest.raises(UsageError):
        register_block_kind("Not ok")


def test_provenance_and_unknown_layers(spark):
    df = spark.createDataFrame([({"layer": "interpretation", "date": "2024"},), ({},), ({"layer": "measure", "producer": "p"},)], "m map<string,string>")
    got = [r.p.asDict() for r in df.select(select.provenance(F.col("m")).alias("p")).collect()]
    assert got[0] == {"layer": "interpretation", "producer": "spanlight.ingest/1", "observed_at": "2024", "confidence": 0.5}
    assert got[1]["layer"] == "fact" and got[2]["producer"] == "p"
    with pytest.raises(Exception, match="unknown layer"):
        spark.createDataFrame([({"layer": "guess"},)], "m map<string,string>").select(select.provenance(F.col("m"))).collect()


def test_two_digits_are_rounded_as_python_does(spark):
    rows = [(m, n) for n in [*range(1, 120), 125, 160, 200, 400, 1000, 8000] for m in ({*range(0, n + 1, max(1, n // 200)), n})]
    df = spark.createDataFrame(rows, "m int, n int")
    for r in df.select("m", "n", select.two_digits(F.col("m"), F.col("n")).alias("x")).collect():
        assert r.x == f"{r.m / r.n:.2f}", (r.m, r.n)


def test_similar_classes_in_tiles_and_without_broadcasts(spark, monkeypatch):
    """Every pair of blocks is compared, and no side that grows with the texts is sent to every task."""
    random.seed(8)
    base = ["".join(random.choice("abcdefg hij") for _ in range(80)) for _ in range(12)]
    texts = [b[:k] + random.choice("xyz") * (80 - k) for b in base for k in (40, 66, 72, 80)] + ["", "ab", base[0]]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    monkeypatch.setattr(redundancy, "BLOCK", 400)
    members, pairs = redundancy.similar_classes(rows, "i", "t")
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString() + members._jdf.queryExecution().executedPlan().toString()
    sets = [T.shingles(t) for t in texts[:-1]]
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if T.similarity(sets[a], sets[b])[0] >= 0.75}
    assert {(r.a, r.b) for r in pairs.collect()} == want and len(want) > 10
