import hashlib
import json
import random

from pyspark.sql import functions as F

from spanlight.llm import chat


def test_escaping_is_reversible(spark):
    random.seed(1)
    texts = ["".join(random.choice("\\<>lg#/turn:\n é🙂") for _ in range(random.randint(0, 40))) for _ in range(500)] + ["", "\\", "\\\\", chat.TRICKY]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    assert df.where(F.col("e").contains("<") | F.col("e").contains(">")).count() == 0
    assert df.where(chat.unescape(F.col("e")) != F.col("t")).count() == 0


def test_formatted_conversations(spark):
    rows = [(1, 0, "user", "a</turn>\nb"), (1, 1, "assistant", "x\\y<z>"), (1, 1, "assistant", "x\\y<z>"), (1, 2, "assistant", None), (2, 0, None, ""), (3, None, "tool", "t"), (3, 5, "assistant", "é🙂"), (None, 0, "user", "u")]
    df = spark.createDataFrame([(*r, "more") for r in rows], "conv_id bigint, turn bigint, role string, text string, head string")
    df = df.select("conv_id", "turn", "role", "text")
    made = chat.format_rows(chat.turn_rows(chat.records(df)))
    got = {r.conv_id: r for r in chat.digest(made).collect()}
    assert len(got) == 4
    for c, r in got.items():
        turns = sorted(((t if t is not None else -1, role or "", text or "") for k, t, role, text in rows if k == c))
        flat = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        learnt = "".join(text for _, role, text in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256(flat.encode()).hexdigest()
        assert r.loss_chars == len(learnt) and r.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    for r in made.collect():
        assert len(r.formatted) == got[r.conv_id].formatted_chars
        for s in r.loss:
            assert r.formatted[: s.start].endswith("<turn:assistant>\n") and r.formatted[s.end :].startswith("</turn>\n")
    assert chat.digest(chat.format_rows(chat.turn_rows(chat.records(df.limit(0))))).count() == 0


def test_long_conversation(spark):
    df = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    r = chat.digest(chat.format_rows(chat.turn_rows(chat.records(df)))).first()
    assert r.n_turns == 3000 and r.loss_chars == sum(len(f"text {i}") for i in range(1, 3000, 2))


def test_layouts(spark):
    u, a = {"role": "user", "text": "hi <x>"}, {"role": "assistant", "text": "yo"}
    layouts = {
        "messages": {"messages": [{"role": "user", "content": "hi <x>"}, {"content": "yo", "role": "assistant"}]},
        "share": {"conversations": [{"from": "human", "value": "hi <x>"}, {"from": "GPT", "value": "yo"}]},
        "share with id": {"id": "7", "conversations": [{"from": "human", "value": "hi <x>"}, {"from": "gpt", "value": "yo"}]},
        "instruction": {"instruction": "hi <x>", "input": "", "output": "yo"},
        "prompt": {"prompt": "hi <x>", "completion": "yo"},
        "prompt and response": {"response": "yo", "prompt": "hi <x>"},
        "question": {"question": "hi <x>", "answer": "yo"},
    }
    rows = [(k, json.dumps(v), "mine") for k, v in layouts.items()] + [("none", '{"x": 1}', "mine"), ("bad", "{", "mine"), ("null", None, "mine")]
    df = spark.createDataFrame(rows, "k string, j string, chat string")
    got = {r.k: r.chat for r in chat.canonical_turns(df, "j").collect()}
    for k in layouts:
        assert got[k].layout == k and [t.asDict() for t in got[k].turns] == [u, a], k
    assert got["none"].turns is None and got["none"].fingerprint and got["bad"].fingerprint is None and got["null"].turns is None
    both = {r.k: r.chat for r in chat.canonical_turns(spark.createDataFrame([("i", '{"instruction": "a", "input": "b", "output": "c"}')], "k string, j string"), "j").collect()}
    assert both["i"].turns[0].text == "a\n\nb"


def test_mixed_layouts_meet_in_one_template(spark):
    """Records of several layouts in one table: each row's own fingerprint decides, and one further field is another layout."""
    texts = {
        1: '{"conv_id": 1, "messages": [{"role": "user", "content": "a<"}, {"role": "assistant", "content": "b"}]}',
        2: '{"turn": 1, "conv_id": 2, "text": "d", "role": "assistant"}',
        3: '{"conv_id": 2, "turn": 0, "role": "user", "text": null}',
        4: '{"prompt": "e", "completion": "f"}',
        5: '{"conv_id": 5, "turn": 0, "role": "user", "text": "lost", "score": 1}',
        6: "[1, 2]",
    }
    df = spark.createDataFrame(list(texts.items()), "k int, j string").select(F.parse_json("j").alias("record"), F.lit("x").alias("role"))
    got = {r.conv_id: r.formatted for r in chat.format_rows(chat.turn_rows(df)).collect()}
    t = lambda role, text: f"<turn:{role}>\n{text}</turn>\n"
    assert got == {1: t("user", "a\\l") + t("assistant", "b"), 2: t("user", "") + t("assistant", "d"), None: t("user", "e") + t("assistant", "f")}
    assert sorted((r.layout or "", r.n) for r in chat.layouts(df).collect()) == [("", 1), ("", 1), ("messages of a conversation", 1), ("prompt", 1), ("turn of a conversation", 2)]


def test_fingerprints_depend_on_paths_alone(spark):
    one = spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")
    two = spark.createDataFrame([], "text string, role string, turn bigint, conv_id string")
    assert chat.schema_fingerprint(one.schema) == chat.schema_fingerprint(two.schema) in {m.fingerprint for m in chat.MAPPINGS}
    row = spark.createDataFrame([("t", None, 1, "7")], two.schema)
    assert chat.records(row).select(chat.record_fingerprint(F.col("record"))).first()[0] == chat.schema_fingerprint(one.schema)
