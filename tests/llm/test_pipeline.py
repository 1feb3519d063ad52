import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from spanlight.llm import chat, packing, pii, registry, simhash


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    random.seed(12)
    d = tmp_path_factory.mktemp("sf")
    kinds = {"xx": "ba be bi bo zu za ra".split(), "yy": "tre cha ñol éau ique".split()}

    def text(i, bad=False):
        w = ["".join(random.choices(kinds["xy"[i % 2] * 2], k=4)) for _ in range(60)]
        for _ in range(4 * bad):
            w[random.randrange(60)] = random.choice(["grimble", "snorkfut"])
        return " ".join(w)

    rows = [(i, text(i, i % 3 == 0), "xy"[i % 2] * 2, "src0") for i in range(200)]
    rows += [(300 + i, rows[1][1], "yy", "src0") for i in range(20)] + [(400, "12345 !!", None, None), (401, None, None, "s"), (402, "", "xx", "s"), (403, rows[5][1] + " mail me@x.org", "yy", "s"), (7, rows[7][1], "yy", "src0")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.withColumn("language", F.lit("l")).withColumn("fp", F.lit(1)).coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)], "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b<")], "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0)], "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{d}/embeddings.parquet")
    return str(d), rows


def test_stages(spark, folder):
    d, rows = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = [docs]
    for name, stage in P.STAGES:
        seen.append(P.materialize(stage(spark, seen[-1], d), name))
    for x in seen[1:-1]:
        assert x.columns == docs.columns
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in seen[:-1]]
    assert ids[0] - ids[1] == {400, 401, 402}
    assert {i for i in ids[1] - ids[2] if i < 200} >= {i for i in range(200) if i % 3 == 0} and not {i for i in ids[1] - ids[2] if i % 3}
    # near copies against brute force
    kept = [(r.doc_id, simhash.fingerprint(r.text)) for r in seen[2].collect()]
    up = {i: i for i, _ in kept}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in kept:
        for j, b in kept:
            if (a ^ b).bit_count() <= 4:
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    assert ids[3] == {i for i in up if find(i) == i} and seen[3].count() == len(ids[3])
    assert 1 in ids[3] and not {300 + i for i in range(20)} & ids[3]
    for r in seen[4].collect():
        assert r.n_chars == len(r.text) and "@" not in r.text
    ref = Tokenizer.from_file(packing.WORD_BPE)
    got = {}
    for r in seen[5].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {r.doc_id: len(ref.encode(r.text, add_special_tokens=False).ids) + 1 for r in seen[4].collect()}
    assert P.run(spark, d).count() == seen[5].count() and P.ORACLE_SQL is None


def test_short_texts_have_a_language(spark, folder):
    d, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang")
    short = spark.createDataFrame([(1000 + i, f"{chr(65 + i)}.", None) for i in range(26)] + [(2000, "1.", None)], docs.schema)
    kept = {r.doc_id for r in P.language(spark, docs.union(short), d).collect()}
    assert {1000 + i for i in range(26)} <= kept and not {400, 401, 402, 2000} & kept


def test_stages_take_empty_tables(spark, folder):
    d, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, d).count() == 0


def test_near_copies_broadcast_no_postings(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.greatest(F.col("id"), F.lit(10))).alias("text"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "16m")  # more than any side of a join here but the postings, 70 to a text
    try:
        assert {r.doc_id for r in P.near_copies(spark, docs, "").collect()} == {0, *range(11, 20_000)}
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_near_copies_by_shuffled_ids(spark, monkeypatch):
    rows = [(i, f"w{i // 3}") for i in range(60)] + [(0, "w0"), (0, "w0"), (3, "w1"), (None, "w2"), (None, "w2"), (500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")

    def kept():
        out = P.near_copies(spark, docs, "")
        return sorted(map(str, out.collect())), "Broadcast" in out._jdf.queryExecution().executedPlan().toString()

    few, sent = kept()
    monkeypatch.setattr(P, "BROADCAST_ROWS", 0, raising=False)
    assert sent and kept() == (few, False) and len(few) == 20 + 2 + 1


def test_registered_queries(spark, folder):
    d, rows = folder
    n = {re_: fn(spark, d).count() for re_, fn in registry.QUERIES.items()}
    assert {k[: k.index("_")] for k in n} == {f"op{i}" for i in range(1, 11)}
    assert all(n[k] == len(rows) for k in n if k[:4] in ("op2_", "op4_", "op5_", "op6_", "op8_", "op9_") or k.startswith("op10_"))
    assert n["op7_chat"] == 2 and n["op3_embeddings"] == 2


def test_chat_sql(spark, folder):
    d, _ = folder
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet/*.parquet'")
    want = con.sql(chat.ORACLE_OP7)
    got = registry.QUERIES["op7_chat"](spark, d)
    assert sorted(got.columns) == sorted(want.columns)
    assert {tuple(sorted(r.asDict().items())) for r in got.collect()} == {tuple(sorted(zip(want.columns, r))) for r in want.fetchall()}


def test_digest_of_spans(spark):
    r = spark.createDataFrame([("mail a@b.cc now",)], "t string").select(pii.listed(pii.base_spans(F.col("t"))).alias("s")).first()
    assert r.s == "email:5:11" and hashlib.sha256(r.s.encode()).hexdigest()
