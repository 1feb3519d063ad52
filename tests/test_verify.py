import json
import random

import pytest
from pyspark.sql import functions as F

from spanlight.errors import AnswerError, ProtectedError, SettingsError
from spanlight.functions import columns as C
from spanlight.functions import text as T
from spanlight.operators import evaluate, ledger, verify
from spanlight import providers


def test_parse_answer():
    assert verify.parse_answer('```json\n{"claims": [{"text": "a", "citations": ["q"]}, "b"]}\n```') == [("a", ["q"]), ("b", [])]
    assert verify.parse_answer('["x"]') == [("x", [])]
    for bad in ("", "{}", "3", '[{"text": ""}]', '[{"text": "a", "citations": [1]}]', "[3]", '{"claims": "x"}'):
        with pytest.raises(AnswerError):
            verify.parse_answer(bad)


def sent(spark):
    return spark.createDataFrame([("p", "itm_001", "d", "Boils half a litre\nin eight minutes.", 100), ("p", "itm_002", "e", "The TARP weighs 310 ｇrams", 0)], "package_id string, item_id string, document_id string, text string, start int")


def said(spark, rows):
    return spark.createDataFrame([("p", i, t, q) for i, (t, q) in enumerate(rows)], "package_id string, claim_no int, text string, citations array<string>")


def test_support_and_places(spark):
    claims = said(spark, [("a", ["half a LITRE in  eight"]), ("b", ["310 grams", "tarp"]), ("c", []), ("d", ["made up words here"]), ("e", ["tarp", "no"])])
    classes, where = verify.verify(claims, sent(spark))
    assert [r.support for r in classes.orderBy("claim_no").collect()] == ["supported", "supported", "uncited", "unsupported", "unsupported"]
    spots = {(r.claim_no, r.quote_no): (r.item_id, r.start, r.end) for r in where.collect()}
    assert spots[0, 0] == ("itm_001", 106, 127) and spots[1, 1] == ("itm_002", 4, 8)
    r = verify.report(classes, claims).first()
    assert (r.supported, r.unsupported, r.uncited, r.clean, r.asserts_nothing) == (2, 2, 1, False, False)


def test_protection(spark):
    claims = said(spark, [("a", ["[[1]] weighs"])])
    for reversible, want in ((False, "unverifiable"), (True, "supported")):
        shields = spark.createDataFrame([("p", reversible)], "package_id string, reversible boolean")
        restore = (lambda q: q.replace("[[1]]", "The tarp")) if reversible else None
        assert verify.verify(claims, sent(spark), shields, restore)[0].first().support == want
    with pytest.raises(ProtectedError):
        verify.verify(claims, sent(spark), spark.createDataFrame([("p", True)], "package_id string, reversible boolean"))


def test_unreadable_answers(spark):
    got = {r.package_id: (r.claims, r.error) for r in verify.parsed_answers(spark.createDataFrame([("a", '["x"]'), ("b", "no"), ("c", None)], "package_id string, answer string")).collect()}
    assert got["a"][0][0].text == "x" and got["b"][0] is None and "JSON" in got["b"][1] and got["c"][1]


def test_ledger(spark):
    item = "struct<item_id:string,document_id:string,start:int,end:int,score:double,cost:int>"
    omit = "struct<document_id:string,start:int,end:int,rule:string,score:double,cost:int>"
    shape = f"package_id string, created_at string, query string, unit string, budget_limit int, spent int, items array<{item}>, omissions array<{omit}>, protected boolean, seq int"
    i = ("itm_001", "d", 0, 5, 1.0, 5)
    j = ("itm_002", "d", 5, 9, 1.0, 4)
    o = ("d", 9, 12, "budget_exhausted", None, 3)
    rows = [("p", "2024-01-01", "q", "characters", 10, 9, [i, j], [o], False, 0), ("p", "2024-01-02", "q", "characters", 10, 5, [i], [o], False, 1), ("r", "2024-01-03", "secret", "characters", 10, 9, [i, j], [], False, 0)]
    entries, items, omissions = ledger.opened(spark.createDataFrame(rows, shape))
    assert entries.count() == 2 and items.count() == 3 and "query" not in entries.columns
    u = ledger.usage(entries, items, omissions).first()
    assert (u.packages, u.closed, u.cited_share, u.budget_exhausted) == (2, 0, None, 1)
    done = spark.createDataFrame([("r", "2024-02-01"), ("unknown", "x")], "package_id string, verified_at string")
    cited = spark.createDataFrame([("r", "itm_002"), ("r", "itm_002")], "package_id string, item_id string")
    entries, items = ledger.closed(entries, items, done, cited)
    u = ledger.usage(entries, items, omissions).first()
    assert (u.closed, u.items_sent, u.items_cited, u.cited_share) == (1, 2, 1, 0.5)
    assert [r.package_id for r in ledger.entries_since(entries, "2024-01-03").collect()] == ["r"]


def test_evaluation(spark):
    text, facts = evaluate.strip_markup("a {{F:one}}fact{{/F}} and {{F:two}}more{{/F}}.")
    assert text == "a fact and more." and facts == {"one": (2, 6), "two": (11, 15)}
    for bad in ("{{F:a}}x", "x{{/F}}", "{{F:a}}{{/F}}", "{{F:a}}x{{F:b}}y{{/F}}{{/F}}", "{{F:a}}x{{/F}}{{F:a}}y{{/F}}"):
        with pytest.raises(Exception):
            evaluate.strip_markup(bad)
    assert evaluate.breaches({"evidence_recall": 0.9, "trap_rate": 0.3, "omission_correctness": None}) and not evaluate.breaches({"evidence_recall": 1.0, "trap_rate": 0.0})
    a = evaluate.answers_scored(spark.createDataFrame([("c", True, True, True, False, False), ("d", True, False, False, False, True), ("e", False, False, False, False, False)], "case_id string, readable boolean, grounded boolean, on_target boolean, captured boolean, abstained boolean")).first()
    assert (a.cases, a.readable, a.grounded_rate, a.abstained_rate) == (3, 2, 1.0, 0.5)
    d = evaluate.disagreements(spark.createDataFrame([("c", "m", "x"), ("c", "n", "y"), ("d", "m", "x"), ("d", "n", "x")], "case_id string, model string, outcome string"))
    assert [r.case_id for r in d.collect()] == ["c"]


def test_providers_are_local():
    with pytest.raises(SettingsError):
        providers.ChatProvider("m", "http://example.com")
    r = providers.RegexRedactor(r"\d+")
    shown = r.protect("tent 310 and 310 and 42")
    assert shown == "tent [[1]] and [[1]] and [[2]]" and r.restore(shown) == "tent 310 and 310 and 42"
    assert json.dumps(shown)


def test_quotations_without_an_inner_word_are_found_without_comparing_all(spark):
    from spanlight.functions import columns as C
    from spanlight.operators import anchors

    docs = spark.createDataFrame([("a", "né ab cd. 日本語文 x", "p", None), ("b", "xabx, ab cd", "q", None), ("c", "", "r", None)], "document_id string, content string, source_path string, sections array<struct<heading:string,level:int,start:int,end:int>>")
    asked = spark.createDataFrame([("1", "ab cd"), ("2", "本語文"), ("3", "x"), ("4", "zzz"), ("5", "")], "quotation_id string, quotation string")
    got = {(r.quotation_id, r.document_id, r.start) for r in anchors.trace_quotations(asked, docs).collect()}
    assert got == {("1", "a", 3), ("1", "b", 6), ("2", "a", 11), ("3", "a", 15), ("3", "b", 0), ("3", "b", 3)}
    rows = spark.createDataFrame([("abcab",), ("é🙂x",), ("ab",), ("",)], "t string").select("t", C.grams(F.col("t")).alias("g")).collect()
    assert {r.t: r.g for r in rows} == {"abcab": ["abc", "bca", "cab"], "é🙂x": ["é🙂x"], "ab": [], "": []}


def test_search_form_without_offsets(spark):
    random.seed(4)
    pool = "aZß ﬁテｶ漢́¨\u0085\u001c　\n\t éİ½𝐀"
    texts = ["".join(random.choices(pool, k=random.randint(0, 9))) for _ in range(700)] + [None]
    want = [None if t is None else T.search_form(t)[0] for t in texts]
    assert [None if t is None else T.search_text(t) for t in texts] == want
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).select("i", C.search_form(F.col("t")).alias("f"))
    assert [r.f for r in rows.orderBy("i").collect()] == want


def test_covered_compares_a_text_once_for_each_item(spark):
    random.seed(6)
    paths = ["a.txt", "x/a.txt", "y/x/a.txt", "b.txt", "xa.txt", "x/"]
    facts = [(random.choice("pq"), i, random.choice(["a.txt", "x/a.txt", "b.txt", "", "/a.txt"]), random.randint(0, 5), random.randint(5, 9), random.choice(["one", "two", "three", "\0"])) for i in range(60)]
    items = [(random.choice("pq"), random.choice(paths), random.randint(0, 5), random.randint(4, 9), random.choice(["", "one", "has two in it"])) for _ in range(12)]
    f = spark.createDataFrame(facts, "case_id string, fact_id int, document string, start int, end int, text string")
    i = spark.createDataFrame(items, "case_id string, source_path string, start int, end int, text string")
    got = evaluate.covered(i, f)
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "endswith" not in plan
    same = lambda p, k: p == k or p.endswith("/" + k)
    want = {(c, n) for c, n, d, s, e, t in facts for ic, p, a, b, it in items if c == ic and (t in it or same(p, d) and a <= s and e <= b)}
    assert sorted(map(tuple, got.collect())) == sorted(want) and 0 < len(want) < 60
