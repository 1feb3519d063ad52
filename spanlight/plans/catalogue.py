"""The registered queries over the driver's tables and the DuckDB SQL that says the same.

Documents are the corpus (path source/doc_id.txt), the passages of benchmark the questions: what is
asked is a whole passage, or its first words where the query's SQL says so. Every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanlight.functions import columns as C
from spanlight.functions.text import Confirmation
from spanlight.model import Budget
from spanlight.operators import anchors, evaluate, index, ledger, redundancy, retrieve, select, store, verify
from spanlight.plans import context, package
from spanlight.sources import adapters, folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
QUESTION_WORDS = 8


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = f"{_SHARED}{sql}"
        return fn

    return add


_SHARED = f"""
WITH corpus AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS content, source || '/' || doc_id || '.txt' AS source_path,
    'doc_' || left(sha256(source || '/' || doc_id || '.txt'), 16) AS document_id,
    'sha256:' || sha256(coalesce(text, '')) AS version,
    replace(lower(coalesce(text, '')), 'ß', 'ss') AS folded
  FROM documents
), questions AS (
  SELECT item_id::VARCHAR AS query_id, array_to_string(list_slice(string_split_regex(trim(text), '\\s+'), 1, {QUESTION_WORDS}), ' ') AS query FROM benchmark
), asked AS (
  SELECT query_id, query, replace(lower(query), 'ß', 'ss') AS fold FROM questions
), """


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents in fewer parts than there are cores are dealt out, for their texts cost more than the move."""
    out = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name == "documents" and out.rdd.getNumPartitions() < cores:
        out = out.repartition(cores)
    return out


def _path() -> F.Column:
    return F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.corpus(_table(spark, sf_dir, "documents"), _path(), F.col("text")).withColumn("ingest_seq", F.lit(0).cast("bigint"))


def _questions(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """The first words of each passage, or all of them."""
    words = F.split(F.trim("text"), r"\s+")
    words = words if whole else F.slice(words, 1, QUESTION_WORDS)
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.array_join(words, " ").alias("query"))


# --- identity and store ---


@_query("x AS (SELECT 1) SELECT doc_id, source_path, document_id, version, length(content)::INT AS span_end, version AS text_hash FROM corpus")
def corpus_identity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    ids = store.identified(docs.select("doc_id", _path().alias("source_path"), F.coalesce("text", F.lit("")).alias("content")))
    out = anchors.anchored(ids, F.lit(0), F.length("content"))
    return out.select("doc_id", "source_path", "document_id", "version", F.col("end").alias("span_end"), "text_hash")


@_query("x AS (SELECT 1) SELECT 'sha256:' || sha256(string_agg(version, chr(10) ORDER BY version)) AS corpus_state FROM corpus")
def corpus_state(spark, sf_dir):
    return store.corpus_state(store.current(_corpus(spark, sf_dir)))


def _incoming(spark, sf_dir):
    """A second delivery: every seventh document revised, every fifth under a new path."""
    docs = _table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 7 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("x"))).otherwise(F.coalesce("text", F.lit("")))
    path = F.when(F.col("doc_id") % 5 == 4, F.concat(F.lit("new/"), _path())).otherwise(_path())
    return adapters.corpus(docs.select("*"), path, text).withColumn("ingest_seq", F.lit(1).cast("bigint"))


_INCOMING = """incoming AS (
  SELECT CASE WHEN doc_id % 5 = 4 THEN 'new/' ELSE '' END || source_path AS source_path,
    content || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END AS content FROM corpus
), delivered AS (
  SELECT source_path, 'doc_' || left(sha256(source_path), 16) AS document_id, 'sha256:' || sha256(content) AS version, content FROM incoming
), """


@_query(_INCOMING + """x AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM corpus c WHERE c.document_id = d.document_id AND c.version = d.version) THEN 'unchanged'
  WHEN EXISTS (SELECT 1 FROM corpus c WHERE c.document_id = d.document_id) THEN 'revised' ELSE 'added' END AS status FROM delivered d)
SELECT status, count(*) AS n FROM x GROUP BY status""")
def ingest_report(spark, sf_dir):
    return store.ingest_status(_corpus(spark, sf_dir), _incoming(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


@_query(_INCOMING + """v AS (SELECT document_id, version, 0::BIGINT AS ingest_seq FROM corpus UNION ALL
  SELECT document_id, version, 1::BIGINT FROM delivered d WHERE NOT EXISTS (SELECT 1 FROM corpus c WHERE c.document_id = d.document_id AND c.version = d.version))
SELECT document_id, version, ingest_seq, row_number() OVER (PARTITION BY document_id ORDER BY ingest_seq DESC, version DESC) = 1 AS is_current FROM v""")
def store_versions(spark, sf_dir):
    return store.history(store.put(_corpus(spark, sf_dir), _incoming(spark, sf_dir)))


@_query("x AS (SELECT 1) SELECT document_id, source_path FROM corpus c WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.doc_id AND l.toxic = 1)")
def forget_antijoin(spark, sf_dir):
    bad = _table(spark, sf_dir, "labels").where("toxic = 1").join(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return store.forget(_corpus(spark, sf_dir), bad.select(C.document_id(_path()).alias("document_id"))).select("document_id", "source_path")


@_query("x AS (SELECT 1) SELECT count(DISTINCT document_id) AS documents, count(DISTINCT source) AS roots FROM corpus")
def store_counts(spark, sf_dir):
    docs = _corpus(spark, sf_dir).withColumn("corpus_root", F.substring_index("source_path", "/", 1))
    return store.counts(docs)


@_query("""x AS (SELECT unnest(['.env', '.env.local', 'server.PEM', 'id_rsa', 'id_rsa.pub', 'notes.md', 'credentials', 'credentials.json', 'my.kdbx', 'environment']) AS suffix)
SELECT source_path || '.' || suffix AS name, regexp_full_match(lower(suffix), '\\.env|\\.env\\..*|.*\\.pem|.*\\.key|.*\\.p12|.*\\.pfx|.*\\.ppk|.*\\.kdbx|.*\\.keystore|id_rsa|id_dsa|id_ecdsa|id_ed25519|credentials|credentials\\..*|\\.netrc|\\.npmrc|\\.pypirc') AS refused FROM corpus, x""")
def credential_names(spark, sf_dir):
    names = [".env", ".env.local", "server.PEM", "id_rsa", "id_rsa.pub", "notes.md", "credentials", "credentials.json", "my.kdbx", "environment"]
    docs = _table(spark, sf_dir, "documents").select(_path().alias("p"), F.explode(F.array(*map(F.lit, names))).alias("s"))
    return docs.select(F.concat("p", F.lit("."), "s").alias("name"), folder.is_credential(F.col("s")).alias("refused"))


# --- parsing, tiles, terms ---


@_query("x AS (SELECT 1) SELECT document_id, len(regexp_extract_all(content, '[^\\n]*[^\\s][^\\n]*(?:\\n[^\\n]*[^\\s][^\\n]*)*'))::INT AS paragraphs FROM corpus")
def paragraph_blocks(spark, sf_dir):
    files = _table(spark, sf_dir, "documents").select(_path().alias("source_path"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    return folder.parsed(files).select("document_id", F.size("blocks").alias("paragraphs"))


def _turn_sections(spark, sf_dir):
    """Conversations as documents: each turn starts a section, the user's ones last to the end of the conversation."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    w = W.partitionBy("conv_id")
    end = F.sum(F.length("text")).over(w.orderBy("turn").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumns({"stop": end, "length": F.sum(F.length("text")).over(w)}).select(
        F.col("conv_id").cast("string").alias("document_id"), F.lit("v").alias("version"), (F.col("stop") - F.length("text")).cast("int").alias("start"), F.when(F.col("role") == "user", F.col("length")).otherwise(F.col("stop")).cast("int").alias("end"), "role", "turn", F.col("length").cast("int").alias("length")
    )


_TURNS = """t AS (SELECT conv_id::VARCHAR AS document_id, turn, role, coalesce(text, '') AS text, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn) AS stop, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id) AS total FROM conversations),
s AS (SELECT document_id, turn, role, (stop - length(text))::INT AS start, (CASE WHEN role = 'user' THEN total ELSE stop END)::INT AS "end", total::INT AS total FROM t), """


@_query(_TURNS + """x AS (SELECT s.document_id, s.start, least(coalesce((SELECT min(o.start) FROM s o WHERE o.document_id = s.document_id AND o.start > s.start), s."end"), s."end") AS "end" FROM s)
SELECT DISTINCT document_id, start, "end" FROM x WHERE "end" > start""")
def section_tiles(spark, sf_dir):
    return index.tiles(_turn_sections(spark, sf_dir)).select("document_id", "start", "end")


@_query(_TURNS + """o AS (SELECT document_id, total // 2 AS o FROM (SELECT DISTINCT document_id, total FROM s)), h AS (SELECT s.document_id, o.o, s.role, CASE s.role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level, s.turn FROM s JOIN o USING (document_id) WHERE s.start <= o.o AND o.o < s."end")
SELECT o.document_id, o.o::INT AS "offset", coalesce((SELECT h.role FROM h WHERE h.document_id = o.document_id ORDER BY h.level DESC, h.turn LIMIT 1), '') AS section FROM o""")
def section_at_offset(spark, sf_dir):
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    s = _turn_sections(spark, sf_dir).withColumn("s", F.struct("turn", F.struct(F.col("role").alias("heading"), level.alias("level"), "start", "end").alias("x")))
    per = s.groupBy("document_id").agg(F.array_sort(F.collect_list("s")).alias("s"), F.max("length").alias("length")).withColumn("offset", F.floor(F.col("length") / 2).cast("int"))
    return per.select("document_id", "offset", retrieve.section_name(F.col("s.x"), F.col("offset")).alias("section"))


_TOKENS = "tok AS (SELECT document_id, generate_subscripts(list, 1) - 1 AS pos, unnest(list) AS token FROM (SELECT document_id, regexp_extract_all(folded, '[\\p{L}\\p{N}]+') AS list FROM corpus)), "


_kept: list[index.Index] = []


def _index(spark, sf_dir) -> index.Index:
    """An index of all documents; what it holds of the last questions' terms is kept until the next one is made."""
    docs = _corpus(spark, sf_dir)
    while _kept:
        _kept.pop().free()
    _kept.append(index.Index.built(docs.select("document_id", "version", F.lit(0).alias("start"), F.length("content").alias("end"), "content"), keep=True))
    return _kept[0]


@_query(_TOKENS + "x AS (SELECT 1) SELECT token, count(DISTINCT document_id) AS df, count(*) AS tf FROM tok GROUP BY token")
def term_stats(spark, sf_dir):
    return _index(spark, sf_dir).term_totals()


@_query("x AS (SELECT 1) SELECT source AS index, lang, count(*) AS documents, sum(length(content))::BIGINT AS characters, max(doc_id::VARCHAR) AS last_ingest FROM corpus GROUP BY source, lang")
def index_summary(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("source").alias("index"), "lang", F.coalesce("text", F.lit("")).alias("content"), F.col("doc_id").cast("string").alias("ingested_at"))
    return index.summary(docs, ["index", "lang"])


_BM25 = _TOKENS + """len AS (SELECT document_id, len(regexp_extract_all(folded, '[\\p{L}\\p{N}]+')) AS n FROM corpus),
st AS (SELECT count(*)::DOUBLE AS n, avg(n)::DOUBLE AS mean FROM len),
qt AS (SELECT query_id, min(no) AS term_no, term FROM (SELECT query_id, generate_subscripts(l, 1) AS no, unnest(l) AS term FROM (SELECT query_id, string_split_regex(fold, '[ \\t\\n\\r]+') AS l FROM asked)) GROUP BY query_id, term),
qp AS (SELECT query_id, term_no, len(p) AS n_parts, unnest(p) AS token, generate_subscripts(p, 1) - 1 AS off FROM (SELECT query_id, term_no, regexp_extract_all(term, '[\\p{L}\\p{N}]+') AS p FROM qt) WHERE len(p) > 0),
ph AS (SELECT qp.query_id, qp.term_no, qp.n_parts, tok.document_id, tok.pos - qp.off AS p0 FROM qp JOIN tok USING (token)),
occ AS (SELECT query_id, term_no, document_id, p0 FROM ph GROUP BY query_id, term_no, n_parts, document_id, p0 HAVING count(*) = n_parts),
tf AS (SELECT query_id, term_no, document_id, count(*)::DOUBLE AS f FROM occ GROUP BY query_id, term_no, document_id),
df AS (SELECT query_id, term_no, count(*)::DOUBLE AS n FROM tf GROUP BY query_id, term_no),
sc AS (SELECT tf.query_id, tf.document_id, tf.term_no, CASE WHEN ln((st.n - df.n + 0.5e0) / (df.n + 0.5e0)) <= 0 THEN 1e-6 ELSE ln((st.n - df.n + 0.5e0) / (df.n + 0.5e0)) END * (tf.f * 2.2e0) / (tf.f + 1.2e0 * (0.25e0 + 0.75e0 * len.n / st.mean)) AS x
  FROM tf JOIN df USING (query_id, term_no) JOIN len USING (document_id), st),
raw AS (SELECT query_id, document_id, sum(x ORDER BY term_no) AS score FROM sc GROUP BY query_id, document_id),
top AS (SELECT query_id, document_id, rank, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, document_id) AS rank FROM raw) WHERE rank <= 50), """


def _rounded(scored: DataFrame) -> DataFrame:
    """Scores as two engines agree on them."""
    return scored.withColumn("score", F.round("score", 9))


def _top(spark, sf_dir, idx: index.Index, queries: DataFrame) -> DataFrame:
    return index.top_candidates(_rounded(idx.scored(queries)), ["document_id", "start"])


@_query(_BM25 + "x AS (SELECT 1) SELECT query_id, document_id, rank::INT AS rank, round(score, 6) AS score FROM top")
def bm25_topk(spark, sf_dir):
    return _top(spark, sf_dir, _index(spark, sf_dir), _questions(spark, sf_dir)).select("query_id", "document_id", "rank", F.round("score", 6).alias("score"))


_PHRASES = _BM25.replace("FROM asked)", "FROM (SELECT query_id, array_to_string(list_slice(string_split_regex(fold, ' '), 1, 2), '.') || ' ' || array_to_string(list_slice(string_split_regex(fold, ' '), 3, 4), '-') AS fold FROM asked))")


@_query(_PHRASES + "x AS (SELECT 1) SELECT query_id, document_id, rank::INT AS rank, round(score, 6) AS score FROM top")
def bm25_phrase(spark, sf_dir):
    words = F.split("query", " ")
    asked = _questions(spark, sf_dir).withColumn("query", F.concat(F.array_join(F.slice(words, 1, 2), "."), F.lit(" "), F.array_join(F.slice(words, 3, 2), "-")))
    return _top(spark, sf_dir, _index(spark, sf_dir), asked).select("query_id", "document_id", "rank", F.round("score", 6).alias("score"))


@_query(_BM25 + "x AS (SELECT 1) SELECT query_id, 50 AS \"limit\", 'candidate retrieval' AS stage FROM top GROUP BY query_id HAVING count(*) >= 50")
def truncation(spark, sf_dir):
    top = _top(spark, sf_dir, _index(spark, sf_dir), _questions(spark, sf_dir))
    return top.where("capped").select("query_id").distinct().select("query_id", F.lit(50).alias("limit"), F.lit("candidate retrieval").alias("stage"))


# --- questions and confirmation ---

_NEEDLES = """qw AS (SELECT query_id, query, fold, list_filter(list_transform(string_split_regex(trim(regexp_replace(regexp_replace(fold, '^[\\p{P}\\p{S}]+', ''), '[\\p{P}\\p{S}]+$', '')), '\\s+'), lambda w: regexp_replace(regexp_replace(w, '^[\\p{P}\\p{S}]+', ''), '[\\p{P}\\p{S}]+$', '')), lambda w: w <> '') AS w FROM asked),
nd AS (SELECT query_id, array_to_string(list_slice(w, i, i + k - 1), ' ') AS needle, min(1000 * (64 - k) + i) AS ord FROM qw, generate_series(1, 64) a(i), generate_series(1, 64) b(k)
  WHERE (len(w) > 1 AND k >= 2 AND i + k - 1 <= len(w)) OR (len(w) = 1 AND i = 1 AND k = 1) GROUP BY 1, 2), """


@_query(_NEEDLES + "x AS (SELECT 1) SELECT query_id, needle FROM nd")
def needles(spark, sf_dir):
    asked = _questions(spark, sf_dir).select("query_id", C.fold(F.col("query")).alias("fold"))
    return asked.select("query_id", F.explode(C.needle_runs(F.col("fold"))).alias("needle"))


_TERMS = "ct AS (SELECT query_id, unnest(regexp_extract_all(fold, '\\p{L}+|\\p{N}+')) AS term FROM asked), "


@_query(_TERMS + "x AS (SELECT 1) SELECT query_id, term, count(*) AS n FROM ct GROUP BY query_id, term")
def content_terms(spark, sf_dir):
    asked = _questions(spark, sf_dir).select("query_id", F.explode(C.content_terms(F.col("query"))).alias("term"))
    return asked.groupBy("query_id", "term").agg(F.count("*").alias("n"))


def _of_whole(sql: str) -> str:
    """SQL whose questions are whole passages, of any number of words."""
    shared = _SHARED.replace(f"list_slice(string_split_regex(trim(text), '\\s+'), 1, {QUESTION_WORDS})", "string_split_regex(trim(text), '\\s+')")
    some = "qw, generate_series(1, 64) a(i), generate_series(1, 64) b(k)"
    assert shared != _SHARED and some in sql
    return shared + sql.replace(some, "(SELECT *, unnest(generate_series(1, len(w))) AS i FROM qw) a, LATERAL (SELECT unnest(generate_series(1, len(a.w))) AS k) b")


_CONFIRMED = _BM25 + _NEEDLES + _TERMS + """hit AS (SELECT t.query_id, t.document_id, t.score, c.folded, c.source_path, length(q.query) AS qlen,
    (SELECT max(length(n.needle)) FROM nd n WHERE n.query_id = t.query_id AND contains(c.folded, n.needle)) AS matched FROM top t JOIN corpus c USING (document_id) JOIN asked q USING (query_id)),
cov AS (SELECT h.query_id, h.document_id, bool_and(contains(h.folded, k.term) OR (length(k.term) > 2 AND contains(h.folded, left(k.term, -1)))
    OR (length(k.term) > 3 AND NOT contains(h.folded, right(k.term, -1)) AND contains(h.folded, left(k.term, -2)))) AS covered FROM hit h JOIN ct k USING (query_id) GROUP BY h.query_id, h.document_id), """


def _confirmed(spark, sf_dir, whole: bool = False):
    docs, asked = _corpus(spark, sf_dir), _questions(spark, sf_dir, whole)
    top = _top(spark, sf_dir, _index(spark, sf_dir), asked)
    return retrieve.confirm(top.drop("rank", "capped"), docs, asked)


@_query(_CONFIRMED + "x AS (SELECT 1) SELECT query_id, document_id, matched::INT AS matched FROM hit WHERE matched IS NOT NULL")
def phrase_confirm(spark, sf_dir):
    return _confirmed(spark, sf_dir).where("matched > 0").select("query_id", "document_id", "matched")


@_query(_CONFIRMED + "x AS (SELECT 1) SELECT h.query_id, h.document_id, NOT coalesce(c.covered, false) AS unconfirmed FROM hit h LEFT JOIN cov c USING (query_id, document_id) WHERE h.matched IS NULL")
def coverage_confirm(spark, sf_dir):
    """Of whole passages as questions."""
    return _confirmed(spark, sf_dir, whole=True).where("matched = 0").select("query_id", "document_id", "unconfirmed")


ORACLE["coverage_confirm"] = _of_whole(ORACLE["coverage_confirm"].removeprefix(_SHARED))


_FLOORED = _CONFIRMED + """fl AS (SELECT h.query_id, h.document_id, h.source_path, h.score, coalesce(h.matched, 0) AS matched, h.qlen, h.matched IS NULL AND NOT coalesce(c.covered, false) AS missing,
  max(coalesce(h.matched, 0)) OVER (PARTITION BY h.query_id) AS best FROM hit h LEFT JOIN cov c USING (query_id, document_id)),
rf AS (SELECT *, missing OR (matched > 0 AND matched < best * 0.8e0) AS unconfirmed FROM fl), """


@_query(_FLOORED + "x AS (SELECT 1) SELECT query_id, document_id, matched::INT AS matched, unconfirmed FROM rf")
def relative_floor(spark, sf_dir):
    """Of whole passages as questions."""
    return retrieve.relative_floor(_confirmed(spark, sf_dir, whole=True)).select("query_id", "document_id", "matched", "unconfirmed")


ORACLE["relative_floor"] = _of_whole(ORACLE["relative_floor"].removeprefix(_SHARED))


@_query(_FLOORED + """oc AS (SELECT r.*, CASE WHEN r.matched > 0 THEN least(64, (SELECT count(*) FROM generate_series(1, length(h.folded)) g(i) WHERE substr(h.folded, g.i, r.matched) = n.needle)) END AS n_spans, n.needle
  FROM rf r JOIN hit h USING (query_id, document_id) LEFT JOIN LATERAL (SELECT needle FROM nd WHERE nd.query_id = r.query_id AND length(needle) = r.matched AND contains(h.folded, needle) ORDER BY ord LIMIT 1) n ON true),
s2 AS (SELECT query_id, document_id, source_path, unconfirmed, matched, score + n_spans * 0.01e0 + (matched::DOUBLE / qlen) * 0.1e0 AS s FROM oc WHERE matched > 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, source_path) AS rank FROM s2)
SELECT query_id, document_id, rank::INT AS rank, round(round(s, 9), 6) AS score, matched::INT AS matched, unconfirmed FROM rk WHERE rank <= 10""")
def search_confirmed(spark, sf_dir):
    """The flagship: BM25 candidates, phrase confirmation, score, relative floor, the best ten of each question."""
    hits = retrieve.relative_floor(_confirmed(spark, sf_dir)).where("matched > 0")
    best = retrieve.ranked(_rounded(hits), retrieve.LIMIT)
    return best.select("query_id", "document_id", "rank", F.round("score", 6).alias("score"), "matched", "unconfirmed")


@_query("""m AS (SELECT document_id, content, length(content) // 2 AS a, least(length(content) // 2 + 10, length(content)) AS b, length(content) AS n FROM corpus),
w AS (SELECT *, greatest(0, a - 120) AS lo, least(n, b + 120) AS hi FROM m),
p AS (SELECT *, substr(content, lo + 1, a - lo) AS pre, substr(content, lo + 1, a - lo + 1) AS pre1, substr(content, b + 1) AS post FROM w),
q AS (SELECT *, least(a, lo + greatest(length(regexp_extract(pre, '(?s)^(.*[\\n。．！？!?])', 1)), length(regexp_extract(pre1, '(?s)^(.*\\.\\s)', 1)))) AS s0,
  CASE WHEN strpos(substr(post, 1, hi - b), chr(10)) = 0 THEN hi ELSE b + strpos(substr(post, 1, hi - b), chr(10)) - 1 END AS e1,
  regexp_extract(post, '(?s)^(.*?(?:[。．！？!?]|\\.(?:\\s|$)))', 1) AS sent FROM p),
r AS (SELECT *, CASE WHEN sent = '' THEN hi WHEN b + length(rtrim(sent, chr(32) || chr(9) || chr(10) || chr(13))) > hi THEN hi ELSE b + length(rtrim(sent, chr(32) || chr(9) || chr(10) || chr(13))) END AS e2 FROM q)
SELECT document_id, (s0 + length(regexp_extract(substr(content, s0 + 1, a - s0), '^\\s*')))::INT AS start, greatest(b, least(e1, e2))::INT AS "end" FROM r""")
def widen_sentence(spark, sf_dir):
    docs = _corpus(spark, sf_dir).withColumn("a", F.floor(F.length("content") / 2).cast("int")).withColumn("b", F.least(F.col("a") + 10, F.length("content")))
    return docs.withColumn("w", C.widened(F.col("content"), F.col("a"), F.col("b"), 120)).select("document_id", "w.start", "w.end")


# --- costs, near duplicates, ordering, fill ---


@_query("""k AS (SELECT document_id, content, length(content) AS n,
  length(content) - length(regexp_replace(content, '[\\x{3040}-\\x{30FF}\\x{31F0}-\\x{31FF}\\x{FF66}-\\x{FF9D}]', '', 'g')) AS kana,
  length(content) - length(regexp_replace(content, '[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{2A6DF}]', '', 'g')) AS ideograph,
  length(content) - length(regexp_replace(content, '[\\x{AC00}-\\x{D7AF}\\x{1100}-\\x{11FF}\\x{3130}-\\x{318F}]', '', 'g')) AS hangul,
  length(content) - length(regexp_replace(content, '\\p{Nd}', '', 'g')) AS digit, length(content) - length(regexp_replace(content, '[\\s\\x{A0}\\x{3000}]', '', 'g')) AS space,
  length(content) - length(regexp_replace(content, '[A-Za-z\\x{AA}\\x{B5}\\x{BA}\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}]', '', 'g')) AS latin FROM corpus)
SELECT document_id, n::INT AS characters, strlen(content)::INT AS bytes, (CASE WHEN content = '' THEN 0 ELSE greatest(1, round_even(latin * 0.2151e0 + ideograph * 1.2923e0 + kana * 1.1919e0 + hangul * 1.2e0 + digit * 0.814e0 + space * 0.1601e0 + (n - kana - ideograph - hangul - digit - space - latin) * 0.484e0, 0)) END)::INT AS tokens FROM k""")
def cost_models(spark, sf_dir):
    return _corpus(spark, sf_dir).select("document_id", *[C.cost(F.col("content"), u).alias(u) for u in ("characters", "bytes", "tokens")])


_FLAT = """fl AS (SELECT conv_id * 1000 + turn AS id, trim(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '\\s+', ' ', 'g')) AS t FROM conversations),
sh AS (SELECT DISTINCT id, CASE WHEN length(t) < 5 THEN t ELSE substr(t, i, 5) END AS s FROM fl, LATERAL (SELECT unnest(generate_series(1, greatest(1, length(t) - 4))) AS i) WHERE t <> ''),
sz AS (SELECT id, count(*) AS n FROM sh GROUP BY id), pr AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.id < y.id GROUP BY x.id, y.id), """


@_query(_FLAT + "z AS (SELECT a, b, k::DOUBLE / least(p.n, q.n) AS c, k::DOUBLE / (p.n + q.n - k) AS j FROM pr JOIN sz p ON p.id = a JOIN sz q ON q.id = b) SELECT a, b, round(c, 9) AS containment, round(j, 9) AS jaccard FROM z WHERE c >= 0.75")
def shingle_similarity(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return redundancy.similar_pairs(rows, "id", "text").select("a", "b", F.round("containment", 9).alias("containment"), F.round("jaccard", 9).alias("jaccard"))


@_query()
def duplicate_heads(spark, sf_dir):
    """Heads among the results of every question; sequential, so tested against a model in Python."""
    got = retrieve.ranked(_confirmed(spark, sf_dir, whole=True), None).select(F.col("query_id").alias("group_id"), F.col("rank").alias("place"), "text")
    return redundancy.duplicate_heads(got).withColumn("containment", F.round("containment", 9))


def _candidates(spark, sf_dir):
    """Documents as candidates of their source, which stands for a question: scored by length, dated by id."""
    docs = _table(spark, sf_dir, "documents")
    date = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("2024-"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"), F.lit("-01")))
    return docs.select(F.col("source").alias("query_id"), F.col("doc_id").cast("string").alias("document_id"), _path().alias("source_path"), F.lit(0).alias("start"), (F.length("text") % 97).cast("double").alias("score"), date.alias("observed_at"), F.length("text").alias("cost"))


_CAND = "cand AS (SELECT source AS query_id, doc_id::VARCHAR AS document_id, source_path, 0 AS start, (length(content) % 97)::DOUBLE AS score, CASE WHEN doc_id % 3 <> 0 THEN '2024-' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || '-01' END AS observed_at, length(content)::INT AS cost FROM corpus), bs AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_path, document_id, start) - 1 AS place FROM cand), "


@_query(_CAND + "x AS (SELECT 1) SELECT query_id, document_id, place::INT AS place FROM bs")
def order_score(spark, sf_dir):
    return select.order_by_score(_candidates(spark, sf_dir)).select("query_id", "document_id", "place")


@_query(_CAND + """dr AS (SELECT *, CASE WHEN observed_at IS NULL THEN place ELSE row_number() OVER (PARTITION BY query_id, observed_at IS NULL ORDER BY observed_at DESC, place) - 1 END AS dplace FROM bs)
SELECT query_id, document_id, (row_number() OVER (PARTITION BY query_id ORDER BY 0.7e0 * place + 0.3e0 * dplace, source_path, document_id, start) - 1)::INT AS place FROM dr""")
def order_recent(spark, sf_dir):
    return select.order_by_recency(_candidates(spark, sf_dir)).select("query_id", "document_id", "place")


@_query(
    _CAND
    + """walk(query_id, place, spent, sent) AS (SELECT DISTINCT query_id, -1::BIGINT, 0::BIGINT, false FROM bs UNION ALL
  SELECT w.query_id, b.place, CASE WHEN w.spent + b.cost <= 20000 THEN w.spent + b.cost ELSE w.spent END, w.spent + b.cost <= 20000 FROM walk w JOIN bs b ON b.query_id = w.query_id AND b.place = w.place + 1)
SELECT w.query_id, b.document_id, w.place::INT AS place, w.sent FROM walk w JOIN bs b ON b.query_id = w.query_id AND b.place = w.place"""
)
def budget_fill(spark, sf_dir):
    return select.filled(select.order_by_score(_candidates(spark, sf_dir)), 20000).select("query_id", "document_id", "place", "sent")


ORACLE["budget_fill"] = ORACLE["budget_fill"].replace("WITH corpus", "WITH RECURSIVE corpus", 1)


def _packages(spark, sf_dir, ordering: str = "score", idx: index.Index | None = None, whole: bool = True):
    docs, asked = _corpus(spark, sf_dir), _questions(spark, sf_dir, whole)
    return context.build(asked, docs, idx or _index(spark, sf_dir), Budget("characters", 1200), ordering=ordering, created_at="2026-01-01T00:00:00Z")


@_query()
def context_packages(spark, sf_dir):
    """Whole packages with their ids: items and omissions of every question, rebuilt identically from the same input."""
    out = _packages(spark, sf_dir)
    return out.select("query_id", "package_id", F.size("items").alias("items"), F.size("omissions").alias("omissions"), "spent")


@_query()
def order_mmr(spark, sf_dir):
    """Items in the order of maximal marginal relevance; greedy, so tested against a model in Python."""
    return _packages(spark, sf_dir, "mmr").select("query_id", F.posexplode("items").alias("n", "i")).select("query_id", "n", "i.item_id", "i.document_id", "i.start", "i.end")


@_query(_BM25 + "x AS (SELECT 1) SELECT query_id, count(*) AS candidates, true AS accounted FROM top GROUP BY query_id")
def accounting_invariant(spark, sf_dir):
    idx = _index(spark, sf_dir)
    p = _packages(spark, sf_dir, idx=idx, whole=False).where(F.size("items") + F.size("omissions") > 0)
    told = F.size("items") + F.size(F.filter("omissions", lambda o: o["rule"] != "truncated_by_cap"))
    top = _top(spark, sf_dir, idx, _questions(spark, sf_dir)).groupBy("query_id").agg(F.count("*").alias("candidates"))
    return p.join(top, "query_id").select("query_id", "candidates", (told == F.col("candidates")).alias("accounted"))


@_query()
def omission_report(spark, sf_dir):
    p = _packages(spark, sf_dir)
    return p.select("query_id", F.explode("omissions").alias("o")).groupBy("query_id", "o.rule").agg(F.count("*").alias("n"))


@_query()
def why_not(spark, sf_dir):
    return _packages(spark, sf_dir).select("query_id", package.why_not(F.col("omissions")).alias("why_not"))


@_query()
def rendered_prompts(spark, sf_dir):
    return package.rendered(_packages(spark, sf_dir)).select("query_id", "package_id", F.sha2("prompt", 256).alias("prompt_sha256"))


@_query()
def interop_documents(spark, sf_dir):
    return adapters.as_documents(_packages(spark, sf_dir)).select("query_id", "n", "text", F.element_at("metadata", "kind").alias("kind"), F.element_at("metadata", "source").alias("source"))


@_query(
    _CAND
    + """om AS (SELECT b.*, c.content FROM bs b JOIN corpus c ON c.doc_id::VARCHAR = b.document_id),
rk AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, start) AS rank, document_id, score, content AS text FROM om WHERE regexp_matches(content, '\\S'))
SELECT query_id, rank::INT AS rank, document_id, score, sha256(text) AS text_sha256 FROM rk WHERE rank <= 3"""
)
def leads(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    omit = F.struct(F.lit("below_threshold").alias("rule"), F.lit("r").alias("reason"), "document_id", "start", F.col("cost").alias("end"), "source_path", "score", "cost")
    p = c.groupBy("query_id").agg(F.collect_list(omit).alias("omissions")).withColumn("items", F.array().cast("array<string>"))
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("content"), _path().alias("source_path"))
    return select.leads(p, docs, 3).select("query_id", "rank", "document_id", "score", F.sha2("text", 256).alias("text_sha256"))


# --- anchors, verification, ledger ---


@_query("""hits AS (SELECT item_id::VARCHAR AS quotation_id, document_id, source_path, content, text, i - 1 AS start FROM (SELECT b.item_id, b.text, c.*, list_filter(generate_series(1, length(c.content)), lambda i: substr(c.content, i, length(b.text)) = b.text) AS places FROM benchmark b JOIN corpus c ON contains(c.content, b.text) WHERE b.text <> ''), LATERAL (SELECT unnest(places) AS i)),
rk AS (SELECT *, row_number() OVER (PARTITION BY quotation_id ORDER BY document_id, start) AS n FROM hits)
SELECT quotation_id, document_id, source_path, start::INT AS start, (start + length(text))::INT AS "end", (start - length(replace(left(content, start), chr(10), '')) + 1)::INT AS line FROM rk WHERE n <= 20""")
def trace_quotation(spark, sf_dir):
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("quotation_id"), F.col("text").alias("quotation"))
    return anchors.trace_quotations(asked, _corpus(spark, sf_dir)).select("quotation_id", "document_id", "source_path", "start", "end", "line")


def _moved(spark, sf_dir):
    """Anchors over the first half of every document, and the documents as they came later: by id modulo 5 the same, longer, changed within, changed behind, or cut."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"), _path().alias("source_path"))
    half = F.floor(F.length("content") / 2).cast("int")
    a = anchors.anchored(store.identified(docs), F.lit(0), half).select("document_id", "version", "start", "end", "text_hash")
    m = F.col("doc_id") % 5
    later = F.when(m == 0, F.col("content")).when(m == 1, F.concat("content", F.lit("x"))).when(m == 2, F.concat(F.lit("x"), "content")).when(m == 3, F.concat(F.expr("substring(content, 1, CAST(floor(length(content) / 2) AS INT))"), F.lit("y"))).otherwise(F.lit(""))
    return a, store.identified(docs.select("source_path", later.alias("content")))


@_query("""m AS (SELECT document_id, version, content, left(content, length(content) // 2) AS half, CASE doc_id % 5 WHEN 0 THEN content WHEN 1 THEN content || 'x' WHEN 2 THEN 'x' || content WHEN 3 THEN left(content, length(content) // 2) || 'y' ELSE '' END AS later FROM corpus)
SELECT document_id, CASE WHEN length(half) > length(later) THEN 'unresolvable' WHEN left(later, length(half)) <> half AND later <> content THEN 'stale' WHEN left(later, length(half)) <> half THEN 'unresolvable' WHEN later <> content THEN 'stale' ELSE 'resolved' END AS status,
  CASE WHEN length(half) <= length(later) AND left(later, length(half)) = half THEN length(half) END::INT AS text_length FROM m""")
def anchor_resolution(spark, sf_dir):
    a, later = _moved(spark, sf_dir)
    return anchors.resolve(a, later).select("document_id", F.col("resolution.status").alias("status"), F.length("resolution.text").alias("text_length"))


@_query("x AS (SELECT 1) SELECT document_id, CASE WHEN doc_id % 4 = 3 THEN true WHEN doc_id % 4 = 2 THEN content = '' ELSE true END AS is_current FROM corpus")
def freshness_drift(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"), _path().alias("source_path"))
    held = store.identified(docs)
    m = F.col("doc_id") % 4
    raw = F.when(m == 1, F.concat(F.lit("﻿"), "content")).when(m == 2, F.concat(F.lit("~"), F.expr("substring(content, 2)"))).otherwise(F.col("content"))
    files = docs.where("doc_id % 4 <> 3").select("source_path", F.when((m == 2) & (F.col("content") == ""), F.lit("")).otherwise(raw).cast("binary").alias("bytes"))
    return anchors.freshness(held, files).select("document_id", "is_current")


def _answers(spark, sf_dir):
    """A claim for every passage of benchmark, with the passage and the passage in other case and spacing as quotations, checked against every document as an item of one package."""
    b = _table(spark, sf_dir, "benchmark").where("text <> ''")
    claims = b.select(F.lit("p").alias("package_id"), F.col("item_id").cast("int").alias("claim_no"), F.lit("claim").alias("text"), F.when(F.col("item_id") % 5 == 4, F.array().cast("array<string>")).otherwise(F.array("text", F.upper(F.replace("text", F.lit(" "), F.lit("  "))))).alias("citations"))
    return claims


def _held_items(spark, sf_dir):
    return _corpus(spark, sf_dir).select(F.lit("p").alias("package_id"), F.col("document_id").alias("item_id"), "document_id", F.col("content").alias("text"), F.lit(0).alias("start"))


_FORM = "fo AS (SELECT document_id, trim(regexp_replace(folded, '\\s+', ' ', 'g')) AS t FROM corpus), "


@_query(_FORM + """v AS (SELECT item_id::INT AS claim_no, item_id % 5 = 4 AS uncited, EXISTS (SELECT 1 FROM fo WHERE contains(fo.t, trim(regexp_replace(replace(lower(b.text), 'ß', 'ss'), '\\s+', ' ', 'g')))) AS found FROM benchmark b WHERE text <> '')
SELECT claim_no, CASE WHEN uncited THEN 'uncited' WHEN found THEN 'supported' ELSE 'unsupported' END AS support FROM v""")
def quote_verify(spark, sf_dir):
    classes, _ = verify.verify(_answers(spark, sf_dir), _held_items(spark, sf_dir))
    return classes.select("claim_no", "support")


@_query("x AS (SELECT 1) SELECT item_id::INT AS claim_no, 'unverifiable' AS support FROM benchmark WHERE text <> ''")
def verify_protected(spark, sf_dir):
    shields = spark.createDataFrame([("p", False)], "package_id string, reversible boolean")
    classes, _ = verify.verify(_answers(spark, sf_dir), _held_items(spark, sf_dir), shields)
    return classes.select("claim_no", "support")


def _ledger(spark, sf_dir):
    """Conversations as packages: user turns are items, system turns omissions, assistant turns cited items."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    part = F.struct(F.concat(F.lit("itm_"), F.col("turn").cast("string")).alias("item_id"), F.col("conv_id").cast("string").alias("document_id"), F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(1.0).alias("score"), F.length("text").alias("cost"))
    omit = F.struct(F.col("conv_id").cast("string").alias("document_id"), F.lit(0).alias("start"), F.length("text").alias("end"), F.when(F.length("text") % 2 == 0, "budget_exhausted").otherwise("below_threshold").alias("rule"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("cost"))
    p = rows.groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") != "system", part)).alias("items"), F.collect_list(F.when(F.col("role") == "system", omit)).alias("omissions"), F.sum(F.when(F.col("role") != "system", F.length("text")).otherwise(0)).cast("int").alias("spent"))
    p = p.select(F.col("conv_id").cast("string").alias("package_id"), F.concat(F.lit("2026-01-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0")).alias("created_at"), F.lit("q").alias("query"), F.lit("characters").alias("unit"), F.lit(100000).alias("budget_limit"), "spent", "items", "omissions", F.lit(False).alias("protected"), F.lit(0).alias("seq"))
    cited = rows.where("role = 'assistant'").select(F.col("conv_id").cast("string").alias("package_id"), F.concat(F.lit("itm_"), F.col("turn").cast("string")).alias("item_id"))
    done = rows.where("turn >= 2").select(F.col("conv_id").cast("string").alias("package_id"), F.lit("2026-02-01").alias("verified_at")).distinct()
    return p, done, cited


@_query("""cv AS (SELECT conv_id, max(turn) >= 2 AS closed, count(*) FILTER (role <> 'system') AS items, count(*) FILTER (role = 'assistant') AS cited, count(*) FILTER (role = 'system') AS omissions, count(*) FILTER (role = 'system' AND length(coalesce(text, '')) % 2 = 0) AS full_n FROM conversations GROUP BY conv_id HAVING '2026-01-' || lpad((conv_id % 28 + 1)::VARCHAR, 2, '0') >= '2026-01-05')
SELECT count(*) AS packages, count(*) FILTER (closed) AS closed, coalesce(sum(omissions), 0)::BIGINT AS omissions, coalesce(sum(items) FILTER (closed), 0)::BIGINT AS items_sent, coalesce(sum(cited) FILTER (closed), 0)::BIGINT AS items_cited, coalesce(sum(full_n), 0)::BIGINT AS budget_exhausted, round(sum(cited) FILTER (closed) / nullif(sum(items) FILTER (closed), 0)::DOUBLE, 9) AS cited_share FROM cv""")
def ledger_usage(spark, sf_dir):
    p, done, cited = _ledger(spark, sf_dir)
    entries, items, omissions = ledger.opened(p)
    entries, items = ledger.closed(entries, items, done, cited)
    return ledger.usage(entries, items, omissions, "2026-01-05").withColumn("cited_share", F.round("cited_share", 9))


# --- evaluation ---


def _facts(spark, sf_dir):
    """Benchmark passages planted in documents are facts; a case is a source, its items are documents within a greedy budget."""
    b = _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("quotation_id"), F.col("text").alias("quotation"))
    hits = anchors.trace_quotations(b, _corpus(spark, sf_dir), 1 << 30)
    return hits.select(F.substring_index("source_path", "/", 1).alias("case_id"), F.concat_ws(":", "quotation_id", "document_id", "start").alias("fact_id"), F.substring_index("source_path", "/", -1).alias("document"), "start", "end", F.lit("\0").alias("text"))


_FACTS = """ph AS (SELECT source AS case_id, document_id, source_path, b.item_id, i - 1 AS start, i - 1 + length(b.text) AS "end" FROM benchmark b JOIN corpus c ON contains(c.content, b.text), LATERAL (SELECT unnest(list_filter(generate_series(1, length(c.content)), lambda i: substr(c.content, i, length(b.text)) = b.text)) AS i) WHERE b.text <> ''),
it AS (SELECT source AS case_id, document_id, length(content) // 2 AS "end" FROM corpus), """


@_query(_FACTS + """j AS (SELECT ph.case_id, ph.item_id, ph.document_id, ph.start, ph."end" <= it."end" AS hit, ph.start < it."end" AS touch FROM ph JOIN it USING (document_id))
SELECT case_id, count(*) AS facts, count(*) FILTER (hit) AS covered FROM j GROUP BY case_id""")
def eval_covered(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    items = _corpus(spark, sf_dir).select(F.substring_index("source_path", "/", 1).alias("case_id"), "source_path", F.lit(0).alias("start"), F.floor(F.length("content") / 2).cast("int").alias("end"), F.lit("").alias("text"))
    hit = evaluate.covered(items, facts).withColumn("hit", F.lit(1))
    return facts.join(hit, ["case_id", "fact_id"], "left").groupBy("case_id").agg(F.count("*").alias("facts"), F.count("hit").alias("covered"))


@_query(_FACTS + """r AS (SELECT DISTINCT it.case_id, it.document_id FROM it JOIN ph USING (document_id) WHERE ph.start < it."end") SELECT it.case_id, count(*) AS items, count(r.document_id) AS relevant FROM it LEFT JOIN r USING (document_id) GROUP BY it.case_id""")
def eval_relevance(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    items = _corpus(spark, sf_dir).select(F.substring_index("source_path", "/", 1).alias("case_id"), "source_path", "document_id", F.lit(0).alias("start"), F.floor(F.length("content") / 2).cast("int").alias("end"))
    good = evaluate.relevant_items(items, facts).select("document_id").withColumn("good", F.lit(1))
    return items.join(good, "document_id", "left").groupBy("case_id").agg(F.count("*").alias("items"), F.count("good").alias("relevant"))


def _scores(spark, sf_dir):
    """Labelled documents as scored cases."""
    d = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    ids = lambda c: F.when(c, F.array(F.col("doc_id").cast("string"))).otherwise(F.array().cast("array<string>"))
    return d.select(F.col("source").alias("genre"), F.col("lang").alias("language"), F.when(F.col("doc_id") % 2 == 0, "handwritten").otherwise("generated").alias("origin"), ids(F.col("quality") == 1).alias("found"), ids(F.col("quality") == 0).alias("missed"), ids(F.col("toxic") == 1).alias("sprung"), F.lit(1).alias("forbidden"), ids(F.col("toxic") == 1).alias("explained"), ids(F.col("toxic") == 0).alias("misexplained"), F.lit(2).alias("items"), F.col("quality").alias("relevant_items"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("clean"))


@_query("""d AS (SELECT c.source AS genre, c.lang AS language, CASE WHEN c.doc_id % 2 = 0 THEN 'handwritten' ELSE 'generated' END AS origin, l.quality AS q, l.toxic AS t FROM corpus c JOIN labels l USING (doc_id))
SELECT genre, language, origin, count(*) AS cases, count(*) FILTER (q = 1 AND t = 0) AS clean_cases, sum(q)::BIGINT AS found, count(*) AS required, sum(t)::BIGINT AS sprung, count(*) AS forbidden, round(sum(q) / count(*)::DOUBLE, 9) AS evidence_recall, round(sum(q) / (2 * count(*))::DOUBLE, 9) AS evidence_precision, round(sum(t) / count(*)::DOUBLE, 9) AS trap_rate, round(sum(t) / count(*)::DOUBLE, 9) AS omission_correctness
FROM d GROUP BY GROUPING SETS ((), (genre), (language), (origin))""")
def eval_summary(spark, sf_dir):
    out = evaluate.summarised(_scores(spark, sf_dir))
    rates = ("evidence_recall", "evidence_precision", "trap_rate", "omission_correctness")
    return out.select("genre", "language", "origin", "cases", "clean_cases", "found", "required", "sprung", "forbidden", *[F.round(r, 9).alias(r) for r in rates])


@_query(
    _CAND.replace("ORDER BY score DESC, source_path, document_id, start", "ORDER BY source_path")
    + """walk(query_id, place, spent, sent) AS (SELECT DISTINCT query_id, -1::BIGINT, 0::BIGINT, false FROM bs UNION ALL
  SELECT w.query_id, b.place, CASE WHEN w.spent + b.cost <= 8000 THEN w.spent + b.cost ELSE w.spent END, w.spent + b.cost <= 8000 FROM walk w JOIN bs b ON b.query_id = w.query_id AND b.place = w.place + 1)
SELECT w.query_id, b.document_id FROM walk w JOIN bs b ON b.query_id = w.query_id AND b.place = w.place WHERE w.sent"""
)
def baseline_first_fit(spark, sf_dir):
    """What fits in path order, whatever is asked."""
    w = W.partitionBy("query_id").orderBy("source_path")
    return select.filled(_candidates(spark, sf_dir).withColumn("place", F.row_number().over(w) - 1), 8000).where("sent").select("query_id", "document_id")


ORACLE["baseline_first_fit"] = ORACLE["baseline_first_fit"].replace("WITH corpus", "WITH RECURSIVE corpus", 1)


@_query(_TURNS + """x AS (SELECT a.document_id, a.start AS l_start, a."end" AS l_end, b.start AS r_start, b."end" AS r_end FROM s a JOIN s b USING (document_id) WHERE a.role = 'user' AND b.role = 'assistant' AND a.start < b."end" AND b.start < a."end")
SELECT * FROM x""")
def span_overlap_join(spark, sf_dir):
    s = _turn_sections(spark, sf_dir)
    return anchors.overlapping(s.where("role = 'user'").select("document_id", "start", "end"), s.where("role = 'assistant'").select("document_id", "start", "end"))


@_query("x AS (SELECT 1) SELECT document_id, 'fact' AS layer, CASE WHEN doc_id % 3 = 1 THEN '2024-05-01' WHEN doc_id % 3 = 2 THEN '2023-01-02' END AS observed_at FROM corpus")
def provenance(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(C.document_id(_path()).alias("document_id"), "doc_id")
    meta = F.when(F.col("doc_id") % 3 == 1, F.create_map(F.lit("observed_at"), F.lit(" "), F.lit("date"), F.lit("2024-05-01"))).when(F.col("doc_id") % 3 == 2, F.create_map(F.lit("fetched_at"), F.lit("2021-01-01"), F.lit("published"), F.lit(" 2023-01-02 "))).otherwise(F.create_map(F.lit("title"), F.lit("x")))
    return docs.withColumn("p", select.provenance(meta)).select("document_id", "p.layer", "p.observed_at")


@_query()
def search_coverage(spark, sf_dir):
    """search() as a caller uses it, with coverage matches, widened text and unconfirmed results."""
    results, _ = retrieve.search(_questions(spark, sf_dir, whole=True), _corpus(spark, sf_dir), _index(spark, sf_dir), settings=Confirmation())
    return results.select("query_id", "document_id", "rank", "start", "end", "unconfirmed", "matched", F.sha2("text", 256).alias("text_sha256"))


@_query("""k AS (SELECT lang, length(content) AS n, length(content) - length(regexp_replace(content, '\\p{Nd}', '', 'g')) AS digit, length(content) - length(regexp_replace(content, '[\\s\\x{A0}\\x{3000}]', '', 'g')) AS space,
  length(content) - length(regexp_replace(content, '[A-Za-z\\x{AA}\\x{B5}\\x{BA}\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}]', '', 'g')) AS latin FROM corpus)
SELECT lang, sum(latin)::BIGINT AS latin, sum(digit)::BIGINT AS digit, sum(space)::BIGINT AS space, sum(n - latin - digit - space)::BIGINT AS other FROM k GROUP BY lang""")
def script_histogram(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("lang", C.script_counts(F.coalesce("text", F.lit(""))).alias("s"))
    return docs.groupBy("lang").agg(*[F.sum(F.col(f"s.{k}").cast("bigint")).alias(k) for k in ("latin", "digit", "space", "other")])


@_query("""x AS (SELECT 1) SELECT CASE WHEN doc_id % 3 = 0 THEN source || '/' || doc_id WHEN doc_id % 3 = 1 THEN 'id-' || doc_id ELSE 'document-' || lpad(doc_id::VARCHAR, greatest(4, length(doc_id::VARCHAR))::INT, '0') END AS source_path, sha256(content) AS content_sha256 FROM corpus""")
def framework_documents(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumn("m", F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("file_path"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")))).otherwise(F.create_map(F.lit("source"), F.lit(""))))
    id_ = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("id-"), F.col("doc_id").cast("string"))).otherwise(F.lit(""))
    out = adapters.framework_texts(docs, F.coalesce("text", F.lit("")), F.col("m"), id_, F.col("doc_id"))
    return out.select("source_path", F.sha2("content", 256).alias("content_sha256"))


@_query("""p AS (SELECT conv_id, '2026-01-' || lpad((conv_id % 28 + 1)::VARCHAR, 2, '0') AS created_at, count(*) FILTER (role <> 'system') AS items, count(*) FILTER (role = 'system') AS omissions, coalesce(sum(length(coalesce(text, ''))) FILTER (role <> 'system'), 0) AS estimate FROM conversations GROUP BY conv_id)
SELECT conv_id::VARCHAR AS package_id, created_at, 'sha256:' || sha256('q') AS query_hash, items::INT AS items, omissions::INT AS omissions, estimate::INT AS estimate FROM p WHERE created_at >= '2026-01-20' ORDER BY created_at DESC, conv_id::VARCHAR LIMIT 100""")
def ledger_entries(spark, sf_dir):
    """The newest hundred entries since a date; the limit is the feature."""
    entries, _, _ = ledger.opened(_ledger(spark, sf_dir)[0])
    return ledger.entries_since(entries, "2026-01-20", 100).select("package_id", "created_at", "query_hash", "items", "omissions", "estimate")


@_query("""x AS (SELECT document_id, doc_id % 2 = 0 AS unconfirmed, CASE doc_id % 3 WHEN 0 THEN 'unresolvable' WHEN 1 THEN 'stale' ELSE 'resolved' END AS status, doc_id % 5 <> 0 AS fresh FROM corpus)
SELECT document_id, CASE WHEN unconfirmed THEN 'below_threshold' WHEN status = 'unresolvable' OR NOT fresh OR status = 'stale' THEN 'stale_anchor' END AS rule FROM x""")
def disqualification(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(C.document_id(_path()).alias("document_id"), "doc_id")
    status = F.when(F.col("doc_id") % 3 == 0, "unresolvable").when(F.col("doc_id") % 3 == 1, "stale").otherwise("resolved")
    return docs.select("document_id", select.disqualification(F.col("doc_id") % 2 == 0, status, F.col("doc_id") % 5 != 0)["rule"].alias("rule"))


@_query(_INCOMING + """a AS (SELECT document_id, version, content, length(content) // 2 AS s FROM corpus),
now AS (SELECT d.document_id, d.version FROM delivered d JOIN corpus c USING (document_id) WHERE d.version <> c.version)
SELECT a.document_id, 'resolved' AS status, (length(left(content, s)) - length(replace(left(content, s), chr(10), '')) + 1)::INT AS line, n.version AS current_version FROM a LEFT JOIN now n USING (document_id)""")
def trace_anchor(spark, sf_dir):
    versions = store.put(_corpus(spark, sf_dir), _incoming(spark, sf_dir))
    s = F.floor(F.length("content") / 2).cast("int")
    a = anchors.anchored(_corpus(spark, sf_dir), s, F.length("content")).select("document_id", "version", "start", "end", "text_hash")
    return anchors.trace(a, versions).select("document_id", "status", "line", "current_version")


@_query("""x AS (SELECT q.query_id, CASE WHEN i % 2 = 0 THEN 'heading' ELSE '' END AS section, i % 3 = 0 AS unconfirmed, (i * length(q.query)) // 4 AS matched, length(q.query) AS n, i FROM asked q, generate_series(0, 5) t(i))
SELECT query_id, i::INT AS i, 'lexical_match' || CASE WHEN section <> '' THEN ',heading_match' ELSE '' END || CASE WHEN NOT unconfirmed THEN ',confirmed_in_text' ELSE '' END || CASE WHEN NOT unconfirmed AND matched > 0 THEN ',confirmed_share' ELSE '' END AS signals FROM x""")
def signals(spark, sf_dir):
    q = _questions(spark, sf_dir).select("query_id", "query", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    section = F.when(F.col("i") % 2 == 0, "heading").otherwise("")
    made = select.signals(section, F.col("i") % 3 == 0, F.floor(F.col("i") * F.length("query") / 4).cast("int"), F.col("query"))
    return q.select("query_id", "i", F.regexp_replace(F.array_join(made, ","), r":[0-9.]+", "").alias("signals"))


from spanlight.plans import inventory  # noqa: E402, F401  (registers further queries with the names above)
