"""Further registered queries: parsers, store, ledger, answers and greedy orders, each with SQL that says the same."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlight.functions import columns as C
from spanlight.functions import text as X
from spanlight.operators import evaluate, index, ledger, redundancy, select, store, verify
from spanlight.plans import evaluation
from spanlight.plans.catalogue import _BM25, _FACTS, _FLAT, _INCOMING, ORACLE, _corpus, _facts, _held_items, _incoming, _index, _ledger, _path, _query, _questions, _table, _top
from spanlight.sources import folder

# --- sources ---


@_query("""x AS (SELECT *, doc_id % 4 IN (0, 1) AS ok FROM corpus)
SELECT source_path, ok, CASE WHEN ok THEN 'sha256:' || sha256(content) END AS version, CASE WHEN ok THEN length(content) END::INT AS characters FROM x""")
def file_texts(spark, sf_dir):
    """Files read as text: as they are, with a byte-order mark, with a NUL in front (binary), with a byte that is no UTF-8."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    m = F.col("doc_id") % 4
    b = F.when(m == 0, raw).when(m == 1, F.concat(F.unhex(F.lit("EFBBBF")), raw)).when(m == 2, F.concat(F.unhex(F.lit("00")), raw)).otherwise(F.concat(raw, F.unhex(F.lit("FF"))))
    out = folder.parsed(_table(spark, sf_dir, "documents").select(_path().alias("source_path"), b.alias("bytes")))
    return out.select("source_path", F.col("failure").isNull().alias("ok"), "version", F.length("content").alias("characters"))


_MARKDOWN = """md AS (SELECT document_id, '---' || chr(10) || 'title: T' || doc_id || chr(10) || '---' || chr(10) AS p0, '# ' || source || chr(10) || chr(10) || 'Text: ' || replace(replace(content, chr(10), ' '), chr(13), ' ') || chr(10) || chr(10) AS p1,
  '## Part of ' || doc_id || chr(10) || '- item' || chr(10) AS p2, '# Last' || chr(10) || '> quoted' AS p3, source, doc_id FROM corpus),
"""


def _markdown(spark, sf_dir):
    n = F.lit("\n")
    id_ = F.col("doc_id").cast("string")
    flat = F.translate(F.coalesce("text", F.lit("")), "\n\r", "  ")
    text = F.concat(F.lit("---\ntitle: T"), id_, F.lit("\n---\n# "), "source", n, n, F.lit("Text: "), flat, n, n, F.lit("## Part of "), id_, F.lit("\n- item\n# Last\n> quoted"))
    files = _table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), id_, F.lit(".txt")).alias("p"), text.cast("binary").alias("bytes"))
    return folder.parsed(files.select(F.concat(F.col("p"), F.lit(".md")).alias("source_path"), "bytes")).withColumn("document_id", C.document_id(F.expr("left(source_path, length(source_path) - 3)")))


@_query(_MARKDOWN + """o AS (SELECT *, length(p0) AS a, length(p0) + length(p1) AS b, length(p0) + length(p1) + length(p2) AS c, length(p0) + length(p1) + length(p2) + length(p3) AS d FROM md)
SELECT document_id, '' AS heading, 0 AS level, 0 AS start, a::INT AS "end" FROM o UNION ALL SELECT document_id, source, 1, a::INT, c::INT FROM o
UNION ALL SELECT document_id, 'Part of ' || doc_id, 2, b::INT, c::INT FROM o UNION ALL SELECT document_id, 'Last', 1, c::INT, d::INT FROM o""")
def markdown_sections(spark, sf_dir):
    """Nested sections of Markdown: what stands before the first heading, and every heading up to the next of its level or above."""
    return _markdown(spark, sf_dir).select("document_id", F.explode("sections").alias("s")).select("document_id", "s.heading", "s.level", "s.start", "s.end")


@_query(_MARKDOWN + """x AS (SELECT 1) SELECT document_id, 'T' || doc_id AS title, 'front_matter,heading,paragraph,heading,list_item,heading,quote' AS kinds FROM md""")
def markdown_blocks(spark, sf_dir):
    return _markdown(spark, sf_dir).select("document_id", F.element_at("metadata", "title").alias("title"), F.array_join("blocks.kind", ",").alias("kinds"))


@_query("""x AS (SELECT conv_id, turn, 3 + (coalesce(text, '') <> '')::INT AS fields FROM conversations)
SELECT conv_id::VARCHAR || '-' || turn || '.json' AS source_path, fields::INT AS fields, 2 AS sections FROM x""")
def json_fields(spark, sf_dir):
    """Keys and strings of a JSON file are fields where they occur; each top-level key starts a section."""
    rows = _table(spark, sf_dir, "conversations").where("role <> ''")
    body = F.to_json(F.struct("role", F.coalesce("text", F.lit("")).alias("text")))
    files = rows.select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(".json")).alias("source_path"), body.cast("binary").alias("bytes"))
    return folder.parsed(files).select("source_path", F.size("blocks").alias("fields"), F.size("sections").alias("sections"))


_RULES = "# what isn't text\n*.log\nbuild/\n!keep*.log\nold/*.md\n"


@_query("""n AS (SELECT source_path || s AS name, s FROM corpus, (SELECT unnest(['.log', '/build/a.txt', '/keep1.log', '/build/keep.log', '/x.md', '.txt']) AS s))
SELECT name, CASE WHEN s = '.log' THEN '*.log' WHEN s = '/build/a.txt' THEN 'build' END AS rule FROM n""")
def ignore_rules(spark, sf_dir):
    """Which rule excludes a path: later rules win, ! lets in again, a trailing slash is for folders."""
    rules = folder.IgnoreRules.parse(_RULES)

    @F.pandas_udf("string")
    def matched(paths: pd.Series) -> pd.Series:
        return paths.map(rules.matched_by)

    ends = F.explode(F.array(*[F.lit(s) for s in (".log", "/build/a.txt", "/keep1.log", "/build/keep.log", "/x.md", ".txt")]))
    return _table(spark, sf_dir, "documents").select(_path().alias("p"), ends.alias("s")).select(F.concat("p", "s").alias("name")).withColumn("rule", matched("name"))


@_query("""f AS (SELECT document_id, folded, content FROM corpus)
SELECT document_id, length(folded)::INT AS folded_chars, coalesce(list_sum(list_transform(generate_series(1, length(content)), lambda i: (i - 1) * (1 + (substr(content, i, 1) = 'ß')::INT))), 0)::BIGINT AS origins FROM f""")
def fold_origins(spark, sf_dir):
    """Folded texts and where their characters come from: the sum of all source offsets."""

    @F.pandas_udf("folded_chars int, origins bigint")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            f = X.fold_with_origins(t)
            n = len(f.text)
            rows.append((n, n * (n - 1) // 2 if f.origin is None else sum(f.origin)))
        return pd.DataFrame(rows, columns=["folded_chars", "origins"])

    return _corpus(spark, sf_dir).withColumn("f", run("content")).select("document_id", "f.*")


#: Latin letters and what stands for them, so that texts run through ideographs, Katakana, Hiragana and Hangul.
_LETTERS, _SCRIPTS = "enrithsa", "日本カタひら한글"
_TERMS_OF = r"""rn AS (SELECT id, unnest(regexp_extract_all(translate(fold, '{a}', '{b}'), '[日本]+|[カタ]+|[ひら]+|[한글]+|[^ \t\n\r\x{{3000}}日本カタひら한글]+')) AS run FROM src),
tm AS (SELECT id, run, CASE WHEN length(run) > 1 AND regexp_matches(run, '^[日本カタ]') THEN list_transform(generate_series(1, length(run) - 1), lambda i: substr(run, i, 2)) ELSE [run] END AS l FROM rn), """.format(a=_LETTERS, b=_SCRIPTS)


@_query("src AS (SELECT document_id AS id, folded AS fold FROM corpus), " + _TERMS_OF + "x AS (SELECT unnest(l) AS term FROM tm) SELECT term, count(*) AS n FROM x GROUP BY term")
def script_terms(spark, sf_dir):
    """Index terms over four scripts: bigrams of ideographs and Katakana, other runs whole."""
    folded = _corpus(spark, sf_dir).select(F.translate(C.fold(F.col("content")), _LETTERS, _SCRIPTS).alias("t"))
    return folded.select(F.explode(C.index_terms(F.col("t"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@_query("src AS (SELECT query_id AS id, fold FROM asked), " + _TERMS_OF + """al AS (SELECT id, unnest(l) AS term FROM tm UNION ALL SELECT id, left(run, k) FROM tm, generate_series(2, 64) g(k) WHERE regexp_matches(run, '^[한글]') AND k < length(run))
SELECT id AS query_id, term, count(*) AS n FROM al GROUP BY id, term""")
def script_query_terms(spark, sf_dir):
    """Terms of questions over four scripts, with the prefixes that Hangul terms get."""
    asked = _questions(spark, sf_dir).select("query_id", F.translate(C.fold(F.col("query")), _LETTERS, _SCRIPTS).alias("q"))
    return asked.select("query_id", F.explode(C.query_terms(F.col("q"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("n"))


# --- store, index, ledger ---


@_query(_INCOMING + """x AS (SELECT 1) SELECT document_id, CASE WHEN doc_id % 2 = 0 OR doc_id % 5 = 4 OR doc_id % 7 <> 0 THEN version ELSE 'sha256:' || sha256(content || 'x') END AS version FROM corpus""")
def store_get(spark, sf_dir):
    """Documents by version (even ids) and the current ones (odd ids), after a second delivery."""
    docs = _corpus(spark, sf_dir)
    ids = _table(spark, sf_dir, "documents").select(C.document_id(_path()).alias("document_id"), "doc_id")
    wanted = docs.join(ids, "document_id").select("document_id", F.when(F.col("doc_id") % 2 == 0, F.col("version")).alias("version"))
    return store.get(store.put(docs, _incoming(spark, sf_dir)), wanted).select("document_id", "version")


@_query("x AS (SELECT 1) SELECT count(*)::BIGINT AS sections FROM corpus WHERE doc_id % 3 <> 0")
def index_count(spark, sf_dir):
    """Sections of an index after a third of its documents went."""
    gone = _table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(C.document_id(_path()).alias("document_id"))
    return _index(spark, sf_dir).without(gone).lengths.agg(F.count("*").alias("sections"))


@_query("""x AS (SELECT conv_id, count(*) FILTER (role <> 'system') AS items, count(*) FILTER (role = 'system') AS omissions FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id)
SELECT conv_id::VARCHAR AS package_id, items::BIGINT AS items, omissions::BIGINT AS omissions FROM x""")
def ledger_forget(spark, sf_dir):
    tables = ledger.opened(_ledger(spark, sf_dir)[0])
    gone = _table(spark, sf_dir, "conversations").where("conv_id % 3 = 0").select(F.col("conv_id").cast("string").alias("package_id"))
    entries, items, omissions = ledger.forgotten(tables, gone)
    n = lambda t, c: t.groupBy("package_id").agg(F.count("*").alias(c))
    out = entries.select("package_id").join(n(items, "items"), "package_id", "left").join(n(omissions, "omissions"), "package_id", "left")
    return out.select("package_id", F.coalesce("items", F.lit(0)).cast("bigint").alias("items"), F.coalesce("omissions", F.lit(0)).cast("bigint").alias("omissions"))


# --- answers ---


def _payloads(spark, sf_dir):
    """Answers as models write them: bare lists, objects, within a code fence, and broken ones."""
    b = _table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    claim = lambda said, cited: F.struct(F.lit(said).alias("text"), cited.alias("citations"))
    none = F.array().cast("array<string>")
    two = F.array(claim("one", F.array("text")), claim("two", none))
    m = F.col("item_id") % 5
    text = F.when(m == 0, F.to_json(F.array(F.lit("a"), F.lit("b"), F.lit("c")))).when(m == 1, F.to_json(F.struct(two.alias("claims")))).when(m == 2, F.concat(F.lit("```json\n"), F.to_json(two), F.lit("\n```"))).when(m == 3, F.lit('{"claims": [{"text": " "}]}')).otherwise(F.lit("I think that"))
    return b.select(F.col("item_id").cast("string").alias("package_id"), text.alias("answer"))


@_query("""x AS (SELECT item_id, item_id % 5 AS m FROM benchmark)
SELECT item_id::VARCHAR AS package_id, m < 3 AS readable, CASE m WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 0 END AS claims, CASE WHEN m IN (1, 2) THEN 1 ELSE 0 END AS citations FROM x""")
def parsed_answers(spark, sf_dir):
    out = verify.parsed_answers(_payloads(spark, sf_dir))
    n = F.coalesce(F.size(F.flatten("claims.citations")), F.lit(0))
    return out.select("package_id", F.col("error").isNull().alias("readable"), F.when(F.col("claims").isNull(), 0).otherwise(F.size("claims")).alias("claims"), F.when(F.col("claims").isNull(), 0).otherwise(n).alias("citations"))


@_query("""x AS (SELECT conv_id, CASE WHEN coalesce(text, '') = '' THEN 'uncited' WHEN turn % 3 = 2 THEN 'unsupported' WHEN turn % 3 = 1 THEN 'unverifiable' ELSE 'supported' END AS s FROM conversations WHERE role <> 'system'), g AS (SELECT DISTINCT conv_id FROM conversations)
SELECT g.conv_id::VARCHAR AS package_id, count(*) FILTER (s = 'supported') AS supported, count(*) FILTER (s = 'unsupported') AS unsupported, count(*) FILTER (s = 'uncited') AS uncited, count(*) FILTER (s = 'unverifiable') AS unverifiable,
  count(s) > 0 AND count(s) = count(*) FILTER (s = 'supported') AS clean, count(s) = 0 AS asserts_nothing FROM g LEFT JOIN x USING (conv_id) GROUP BY g.conv_id""")
def verification_report(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").withColumn("package_id", F.col("conv_id").cast("string"))
    m = F.col("turn") % 3
    support = F.when(F.coalesce("text", F.lit("")) == "", "uncited").when(m == 2, "unsupported").when(m == 1, "unverifiable").otherwise("supported")
    return verify.report(rows.where("role <> 'system'").select("package_id", support.alias("support")), rows)


def _answered(spark, sf_dir):
    """Conversations as answered cases: turns are facts side by side, answers cite the middle of some of them."""
    t = _table(spark, sf_dir, "conversations").where("turn is not null").select(F.col("conv_id").cast("string").alias("case_id"), "turn", "role", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    facts = t.select("case_id", F.col("turn").cast("string").alias("fact_id"), F.lit("d").alias("document"), (F.col("turn") * 10).cast("int").alias("start"), (F.col("turn") * 10 + 10).cast("int").alias("end"), (F.col("role") == "user").alias("must_include"), F.when(F.col("role") == "assistant", F.when(F.col("turn") % 4 == 1, "near_duplicate").otherwise("stale")).alias("trap_kind"))
    cited = t.where("n % 3 = 0").select("case_id", F.lit("in/d").alias("source_path"), (F.col("turn") * 10 + 4).cast("int").alias("start"), (F.col("turn") * 10 + 6).cast("int").alias("end"))
    claims = t.select("case_id", F.col("turn").alias("claim_no"), F.when(F.col("n") % 3 == 0, F.array(F.lit("q"))).otherwise(F.array().cast("array<string>")).alias("citations"), F.when(F.col("n") % 3 == 0, "supported").otherwise("uncited").alias("support"))
    answers = t.groupBy("case_id").agg((F.max("turn") != 1).alias("readable"))
    return evaluate.answer_outcomes(answers, claims, cited, facts)


_OUTCOMES = """t AS (SELECT conv_id::VARCHAR AS case_id, turn, role, length(coalesce(text, '')) % 3 = 0 AS cited FROM conversations WHERE turn IS NOT NULL),
oc AS (SELECT case_id, max(turn) <> 1 AS readable, count(*) AS claims, bool_and(cited) AS grounded, NOT bool_or(cited) AS abstained, count(*) FILTER (cited AND role = 'user') > 0 AS on_target, count(*) FILTER (cited AND role = 'assistant' AND turn % 4 <> 1) > 0 AS adverse,
  coalesce(string_agg(DISTINCT turn::VARCHAR, ',' ORDER BY turn::VARCHAR) FILTER (cited AND role = 'assistant' AND turn % 4 = 1), '') AS copies FROM t GROUP BY case_id), """


@_query(_OUTCOMES + "x AS (SELECT 1) SELECT case_id, readable, claims, grounded, abstained, on_target, adverse AND NOT on_target AS captured, adverse AND on_target AS disagreeing, copies FROM oc")
def answer_outcomes(spark, sf_dir):
    """Where an answer's quotations landed: on the answer, on what contradicts it, on copies."""
    out = _answered(spark, sf_dir)
    return out.select("case_id", "readable", "claims", "grounded", "abstained", "on_target", "captured", "disagreeing", F.array_join("copies", ",").alias("copies"))


@_query(_OUTCOMES + """r AS (SELECT * FROM oc WHERE readable)
SELECT (SELECT count(*) FROM oc) AS cases, count(*) AS readable, count(*) FILTER (grounded) AS grounded, count(*) FILTER (on_target) AS on_target, count(*) FILTER (adverse AND NOT on_target) AS captured, count(*) FILTER (abstained) AS abstained,
  round(count(*) FILTER (abstained) / nullif(count(*), 0)::DOUBLE, 9) AS abstained_rate FROM r""")
def answer_summary(spark, sf_dir):
    out = evaluate.answers_scored(_answered(spark, sf_dir))
    return out.select("cases", "readable", "grounded", "on_target", "captured", "abstained", F.round("abstained_rate", 9).alias("abstained_rate"))


@_query("""x AS (SELECT item_id::INT AS claim_no, EXISTS (SELECT 1 FROM corpus c WHERE contains(trim(regexp_replace(c.folded, '\\s+', ' ', 'g')), trim(regexp_replace(replace(lower(b.text), 'ß', 'ss'), '\\s+', ' ', 'g')))) AS found FROM benchmark b WHERE text <> '')
SELECT claim_no, CASE WHEN found THEN 'supported' ELSE 'unsupported' END AS support FROM x""")
def verify_restored(spark, sf_dir):
    """Quotations of a reversibly redacted package, restored before they are looked for."""
    b = _table(spark, sf_dir, "benchmark").where("text <> ''")
    claims = b.select(F.lit("p").alias("package_id"), F.col("item_id").cast("int").alias("claim_no"), F.lit("claim").alias("text"), F.array(F.concat(F.lit("[["), "text", F.lit("]]"))).alias("citations"))
    shields = spark.createDataFrame([("p", True)], "package_id string, reversible boolean")
    classes, _ = verify.verify(claims, _held_items(spark, sf_dir), shields, lambda t: t.replace("[[", "").replace("]]", ""))
    return classes.select("claim_no", "support")


@_query(_FACTS + """f AS (SELECT ph.*, b.text FROM ph JOIN benchmark b USING (item_id)), h AS (SELECT source AS case_id, left(content, length(content) // 2) AS t FROM corpus)
SELECT case_id, count(*) AS facts, count(*) FILTER (EXISTS (SELECT 1 FROM h WHERE h.case_id = f.case_id AND contains(h.t, f.text))) AS covered FROM f GROUP BY case_id""")
def eval_covered_text(spark, sf_dir):
    """Facts found by their text in items of other documents: the first halves of a source's documents, under other names."""
    b = _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("said"))
    facts = _facts(spark, sf_dir).withColumn("item", F.substring_index("fact_id", ":", 1)).join(b, "item").withColumn("text", F.col("said"))
    items = _corpus(spark, sf_dir).select(F.substring_index("source_path", "/", 1).alias("case_id"), F.lit("elsewhere").alias("source_path"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.expr("left(content, CAST(floor(length(content) / 2) AS INT))").alias("text"))
    hit = evaluate.covered(items, facts).withColumn("hit", F.lit(1))
    return facts.join(hit, ["case_id", "fact_id"], "left").groupBy("case_id").agg(F.count("*").alias("facts"), F.count("hit").alias("covered"))


@_query("""x AS (SELECT query_id, i::INT AS i, length(query) AS n FROM asked, generate_series(1, 400) t(i))
SELECT query_id, i, printf('%.2f', least(i::DOUBLE / n, 1e0)) AS share FROM x WHERE n > 0""")
def signal_shares(spark, sf_dir):
    """Shares of questions with two digits."""
    q = _questions(spark, sf_dir).where("query <> ''").select("query_id", "query", F.explode(F.sequence(F.lit(1), F.lit(400))).alias("i"))
    made = F.element_at(select.signals(F.lit(""), F.lit(False), F.col("i"), F.col("query")), -1)
    return q.select("query_id", "i", F.substring_index(made, ":", -1).alias("share"))


# --- greedy orders ---


def _turns(spark, sf_dir):
    """Every turn and a variant of it, a longer one for even turns and the reverse for odd ones."""
    rows = _table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null").withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    text = F.coalesce("text", F.lit(""))
    made = F.when(F.col("v") == 0, text).when(F.col("turn") % 2 == 0, F.concat(text, F.lit(" again"))).otherwise(F.reverse(text))
    return rows.select("conv_id", (F.col("turn") * 2 + F.col("v")).cast("bigint").alias("turn"), made.alias("text"))


_CLASSES = _FLAT.replace("sh AS (", "cl AS (SELECT id, min(id) OVER (PARTITION BY t) AS class_id FROM fl), rp AS (SELECT id, t FROM fl WHERE id IN (SELECT class_id FROM cl)),\nsh AS (", 1).replace("FROM fl, LATERAL", "FROM rp, LATERAL")


@_query(_CLASSES + """z AS (SELECT a, b FROM pr JOIN sz p ON p.id = a JOIN sz q ON q.id = b WHERE k::DOUBLE / least(p.n, q.n) >= 0.75), n AS (SELECT id, count(*) AS n_links FROM (SELECT a AS id FROM z UNION ALL SELECT b FROM z) GROUP BY id)
SELECT cl.id, cl.class_id, coalesce(n.n_links, 0) AS n_links FROM cl LEFT JOIN n ON n.id = cl.class_id""")
def shingle_classes(spark, sf_dir):
    """Every turn with its class of equal texts and the number of classes that one is similar to."""
    rows = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return redundancy.class_links(rows, "id", "text")


_SAME = """dt AS (SELECT conv_id, 2 * turn + v AS turn, CASE WHEN v = 0 THEN coalesce(text, '') WHEN turn % 2 = 0 THEN coalesce(text, '') || ' again' ELSE reverse(coalesce(text, '')) END AS text FROM conversations, (SELECT unnest([0, 1]) AS v) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
""" + _FLAT.replace("FROM conversations", "FROM dt").replace("x.id < y.id GROUP", "x.id < y.id AND x.id // 1000 = y.id // 1000 GROUP") + """pc AS (SELECT a, b, k::DOUBLE / least(p.n, q.n) AS c FROM pr JOIN sz p ON p.id = a JOIN sz q ON q.id = b),
tu AS (SELECT conv_id, turn, conv_id * 1000 + turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, (length(coalesce(text, '')) % 97)::DOUBLE AS score FROM dt), """


@_query(_SAME + """walk(conv_id, place, heads) AS (SELECT DISTINCT conv_id, -1::BIGINT, []::BIGINT[] FROM tu UNION ALL
  SELECT w.conv_id, t.place, CASE WHEN EXISTS (SELECT 1 FROM pc WHERE pc.b = t.id AND pc.c >= 0.75e0 AND list_contains(w.heads, pc.a)) THEN w.heads ELSE list_append(w.heads, t.id) END FROM walk w JOIN tu t ON t.conv_id = w.conv_id AND t.place = w.place + 1),
hd AS (SELECT t.conv_id, t.place, arg_max(pc.a, [pc.c, -(pc.a % 1000)::DOUBLE]) AS head, max(pc.c) AS c FROM tu t JOIN walk w ON w.conv_id = t.conv_id AND w.place = t.place - 1 JOIN pc ON pc.b = t.id AND pc.c >= 0.75e0 AND list_contains(w.heads, pc.a) GROUP BY t.conv_id, t.place)
SELECT hd.conv_id::VARCHAR AS group_id, hd.place::INT AS place, h.place::INT AS head, round(hd.c, 9) AS containment FROM hd JOIN tu h ON h.id = hd.head""")
def duplicate_turns(spark, sf_dir):
    """Turns that repeat an earlier head of their conversation."""
    from pyspark.sql import Window as W

    rows = _turns(spark, sf_dir).withColumn("place", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1)
    return redundancy.duplicate_heads(rows.select(F.col("conv_id").cast("string").alias("group_id"), "place", "text")).withColumn("containment", F.round("containment", 9))


@_query(_SAME + """bs AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) - 1 AS rank, max(score) OVER (PARTITION BY conv_id) AS top FROM tu), pb AS (SELECT a AS x, b AS y, c FROM pc UNION ALL SELECT b, a, c FROM pc),
walk(conv_id, n, chosen) AS (SELECT conv_id, 0::BIGINT, [id]::BIGINT[] FROM bs WHERE rank = 0 UNION ALL
  SELECT w.conv_id, w.n + 1, list_append(w.chosen, (SELECT b.id FROM bs b WHERE b.conv_id = w.conv_id AND NOT list_contains(w.chosen, b.id)
    ORDER BY 0.7e0 * (b.score / CASE WHEN b.top > 0 THEN b.top ELSE 1e0 END) - (1 - 0.7e0) * coalesce((SELECT max(pb.c) FROM pb WHERE pb.x = b.id AND list_contains(w.chosen, pb.y)), 0e0) DESC, b.rank LIMIT 1)) FROM walk w WHERE w.n + 1 < (SELECT count(*) FROM tu WHERE tu.conv_id = w.conv_id))
SELECT w.conv_id, w.n::INT AS n, (w.chosen[w.n + 1] % 1000)::BIGINT AS turn FROM walk w""")
def mmr_turns(spark, sf_dir):
    """Turns of each conversation in the order of maximal marginal relevance, scored by length."""
    order = select.selected_ordering("mmr")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [{"score": float(len(t) % 97), "source_path": "", "document_id": "", "start": n, "text": t} for n, t in zip(pdf["turn"], pdf["text"])]
        best = order(rows)
        return pd.DataFrame({"conv_id": pdf["conv_id"].iloc[0], "n": range(len(best)), "turn": [c["start"] for c in best]})

    return _turns(spark, sf_dir).groupBy("conv_id").applyInPandas(run, T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("turn", T.LongType())]))


@_query(_BM25 + """cd AS (SELECT t.query_id, t.document_id, length(c.content) AS cost, row_number() OVER (PARTITION BY t.query_id ORDER BY t.rank, t.document_id) - 1 AS place FROM top t JOIN corpus c USING (document_id)),
walk(query_id, place, spent, sent) AS (SELECT DISTINCT query_id, -1::BIGINT, 0::BIGINT, false FROM cd UNION ALL
  SELECT w.query_id, b.place, CASE WHEN w.spent + b.cost <= 8000 THEN w.spent + b.cost ELSE w.spent END, w.spent + b.cost <= 8000 FROM walk w JOIN cd b ON b.query_id = w.query_id AND b.place = w.place + 1)
SELECT w.query_id, b.document_id FROM walk w JOIN cd b ON b.query_id = w.query_id AND b.place = w.place WHERE w.sent""")
def baseline_no_confirm(spark, sf_dir):
    """What the index proposes, whole and in rank order, while it fits."""
    top = _top(spark, sf_dir, _index(spark, sf_dir), _questions(spark, sf_dir))
    return evaluation.no_confirm(top, _corpus(spark, sf_dir), 8000).select("query_id", "document_id")


for _name in ("duplicate_turns", "mmr_turns", "baseline_no_confirm"):
    ORACLE[_name] = ORACLE[_name].replace("WITH corpus", "WITH RECURSIVE corpus", 1)
