import pytest
from pyspark.sql import functions as F

from spanlight.errors import ContractError, UsageError
from spanlight.operators import anchors, store
from spanlight.sources import adapters, folder, parsers
from spanlight.sources.ingest import Store, ingest_folder, ingest_report

MD = "---\ntitle: My notes\ntags: a\n---\nIntro text\nmore\n\n# One\n\npara\n\n## Two\n- item\n  - deep\n> quote\n```py\n# not a heading\n```\n# Three\nend"


def test_markdown():
    p = parsers.parser_for("x/notes.MD").parse(MD)
    kinds = [b[0] for b in p.blocks]
    assert kinds == ["front_matter", "paragraph", "heading", "paragraph", "heading", "list_item", "list_item", "quote", "code", "heading", "paragraph"]
    assert [(s[0], s[1]) for s in p.sections] == [("", 0), ("One", 1), ("Two", 2), ("Three", 1)]
    one, two = p.sections[1], p.sections[2]
    assert MD[one[2] :].startswith("# One") and one[3] == p.sections[3][2] == two[3]
    assert p.metadata == {"title": "My notes", "tags": "a"} and p.blocks[6][3] == 1


def test_lines_and_text():
    assert [x[0] for x in parsers.lines("a\r\nb\rc\n\nd")] == ["a", "b", "c", "", "d"]
    assert list(parsers.lines("")) == []
    p = parsers.PlainText().parse("a\nb\n\n\nc\n")
    assert [b[1:3] for b in p.blocks] == [(0, 3), (6, 7)] and p.sections == [("", 0, 0, 8)]


def test_json():
    text = '{"title": "T", "body": {"x": "héllo", "n": 3}}'
    p = parsers.Json().parse(text)
    assert [s[0] for s in p.sections] == ["title", "body"] and p.metadata == {"title": "T"}
    assert '"héllo"' in [text[a:b] for _, a, b, _ in p.blocks]
    with pytest.raises(ValueError):
        parsers.Json().parse('{"a":1}\n{"a":2}')


def test_registry():
    class Mine:
        name, suffixes, media_type = "mine", (".md",), "x/y"

        def parse(self, content):
            return parsers.Parsed()

    with pytest.raises(UsageError):
        parsers.register_parser(Mine())
    old = parsers.parser_for("a.md")
    parsers.register_parser(Mine(), replace=True)
    assert parsers.parser_for("a.md").name == "mine"
    parsers.register_parser(old, replace=True)
    assert parsers.parser_for("noext") is None and ".py" in parsers.registered_suffixes() and "json@1" in parsers.known_parsers()


def test_ignore_rules():
    r = folder.IgnoreRules.parse("# c\n*.log\n!keep.log\nbuild/\n/top.md\n")
    assert r.matched_by("a/x.log") == "*.log" and r.matched_by("a/keep.log") is None
    assert r.matched_by("build/x.md") == "build" and r.matched_by("build") is None and r.matched_by("build", True) == "build"
    assert r.matched_by("sub/top.md") == "top.md"  # a leading slash means nothing


def test_folder_ingest(spark, tmp_path):
    root = tmp_path / "notes"
    (root / "sub").mkdir(parents=True)
    (root / ".git").mkdir()
    files = {"a.md": MD.encode(), "sub/b.txt": "﻿plain text".encode("utf-8"), ".env": b"SECRET=1", "pic.bin": b"\0\1", "bad.txt": b"\xff\xfe\xfa", "nul.txt": b"a\0b", "x.log": b"log", ".git/c.md": b"no", "many.jsonl": b'{"a":1}\n{"b":2}'}
    for name, data in files.items():
        (root / name).write_bytes(data)
    st = Store(spark, str(tmp_path / "store"))
    rules = folder.IgnoreRules.parse("*.log")
    got = {r.source_path: (r.status, r.detail) for r in ingest_folder(spark, str(root), st, 0, rules).collect()}
    assert got["a.md"][0] == got["sub/b.txt"][0] == "added"
    assert got[".env"] == ("skipped", "looks like a store of credentials: .env") and got["x.log"][0] == got["pic.bin"][0] == "skipped"
    assert got["bad.txt"][0] == got["nul.txt"][0] == got["many.jsonl"][0] == "failed" and ".git/c.md" not in got
    assert st.current().where("source_path = 'sub/b.txt'").first().content == "plain text"

    (root / "a.md").write_text("changed", encoding="utf-8")
    again = ingest_report(ingest_folder(spark, str(root), st, 1, rules))
    assert {r.status: r.n for r in again.collect()} == {"revised": 1, "unchanged": 1, "skipped": 3, "failed": 3}
    assert st.versions().count() == 3 and st.current().count() == 2
    files_now, _ = folder.walk(spark, str(root), rules)
    (root / "a.md").write_text("drifted", encoding="utf-8")
    fresh = {r.source_path: r.is_current for r in anchors.freshness(st.current(), folder.walk(spark, str(root), rules)[0]).collect()}
    assert fresh == {"a.md": False, "sub/b.txt": True}
    st.forget(st.current().where("source_path = 'a.md'"))
    assert st.versions().count() == 1
    st.empty()
    assert st.versions().count() == 0


def test_hidden_files_are_read_and_credentials_are_not(spark, tmp_path):
    for name, text in {"_x.md": "one", ".h/y.md": "two", "_d/_z.txt": "three", ".env": "SECRET", ".h/id_rsa": "KEY", ".git/c.md": "no", "_skip.log": "log", "a.md": "four"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files, skipped = folder.walk(spark, str(tmp_path), folder.IgnoreRules.parse("*.log"))
    assert {r.source_path: bytes(r.bytes).decode() for r in files.collect()} == {"_x.md": "one", ".h/y.md": "two", "_d/_z.txt": "three", "a.md": "four"}
    assert {r.source_path for r in skipped.collect()} == {".env", ".h/id_rsa", "_skip.log"}


def test_hashes(spark):
    import hashlib

    from spanlight.functions import columns as C

    r = spark.createDataFrame([("é",), (None,)], "t string").select(*[C.content_hash(F.col("t"), a).alias(a) for a in ("sha256", "sha512", "blake2b")]).collect()
    assert r[0].asDict() == {a: f"{a}:{hashlib.new(a, 'é'.encode()).hexdigest()}" for a in ("sha256", "sha512", "blake2b")} and list(r[1]) == [None] * 3


def test_reverting_leaves_the_middle_version_current(spark, tmp_path):
    st = Store(spark, str(tmp_path / "s"))
    for seq, text in enumerate("ABA"):
        st.put(adapters.corpus(spark.createDataFrame([("p", text)], "p string, t string"), F.col("p"), F.col("t")).withColumn("corpus_root", F.lit("r")), seq)
    assert st.current().first().content == "B" and st.versions().count() == 2
    got = store.get(st.versions(), st.versions().where("content = 'A'").select("document_id", "version").union(st.current().select("document_id", F.lit(None).cast("string"))))
    assert sorted(r.content for r in got.collect()) == ["A", "B"]


def test_resolution(spark):
    docs = adapters.corpus(spark.createDataFrame([("p", "hello world")], "p string, t string"), F.col("p"), F.col("t"))
    a = anchors.anchored(docs, F.lit(0), F.lit(5)).select("document_id", "version", "start", "end", "text_hash")
    for text, want in (("hello world", "resolved"), ("hello there", "stale"), ("jello world", "stale"), ("hel", "unresolvable")):
        now = adapters.corpus(spark.createDataFrame([("p", text)], "p string, t string"), F.col("p"), F.col("t"))
        assert anchors.resolve(a, now).first().resolution.status == want
    forged = a.withColumn("text_hash", F.lit("sha256:0"))
    assert anchors.resolve(forged, docs).first().resolution.status == "unresolvable"


def test_trace(spark):
    text = "# T\nfirst line\nthe word here and the word there"
    docs = adapters.corpus(spark.createDataFrame([("p", text), ("q", "nothing")], "p string, t string"), F.col("p"), F.col("t")).withColumn("ingest_seq", F.lit(0).cast("bigint"))
    asked = spark.createDataFrame([("1", "the word"), ("2", "ord here and the wor"), ("3", ""), ("4", "zzz")], "quotation_id string, quotation string")
    got = sorted((r.quotation_id, r.start, r.line) for r in anchors.trace_quotations(asked, docs).collect())
    assert got == [("1", 15, 3), ("1", 33, 3), ("2", 20, 3)]
    a = anchors.anchored(docs.where("source_path = 'p'"), F.lit(15), F.lit(23)).select("document_id", "version", "start", "end", "text_hash")
    r = anchors.trace(a, docs).first()
    assert (r.status, r.line, r.current_version) == ("resolved", 3, None)


def test_frameworks_and_exports(spark, tmp_path):
    rows = spark.createDataFrame([("t", {"source": "s.md"}, "i", 1), ("u", {}, "i2", 2), ("v", {}, "", 3)], "t string, m map<string,string>, i string, n int")
    got = adapters.framework_texts(rows, F.col("t"), F.col("m"), F.col("i"), F.col("n")).collect()
    assert [r.source_path for r in got] == ["s.md", "i2", "document-0003"]
    f = tmp_path / "e.json"
    f.write_text('{"schema":"interest-export","version":1,"producer":"me","exported_at":"2024","interests":[{"topic":"tea","summary":"green","confidence":0.7}]}')
    r = adapters.interest_export(spark, str(f)).first()
    assert r.content == "- tea: green (confidence 0.70)" and r.metadata["layer"] == "interpretation"
    f.write_text('{"schema":"interest-export","version":1,"producer":"me","interests":[{"topic":"tea","summary":"green"}]}')
    with pytest.raises(ContractError):
        adapters.interest_export(spark, str(f))
