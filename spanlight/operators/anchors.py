"""Anchors into document versions: resolving, tracing, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanlight.functions import columns as C
from spanlight.operators import store
from spanlight.operators.index import small
from spanlight.operators.retrieve import section_name


def anchored(documents: DataFrame, start: Column, end: Column) -> DataFrame:
    """documents with start, end and text_hash of a span of each."""
    return documents.withColumns({"start": start, "end": end}).withColumn("text_hash", C.content_hash(F.substr("content", F.col("start") + 1, F.col("end") - F.col("start"))))


def resolution(content: Column, version: Column, anchor_version: Column, start: Column, end: Column, text_hash: Column) -> Column:
    """struct<status, text>: whether an anchor's text is at its offsets in a version of its document."""
    found = F.substr(content, start + 1, end - start)
    same = C.content_hash(found) == text_hash
    other = anchor_version != version
    status = F.when(end > F.length(content), "unresolvable").when(~same & other, "stale").when(~same, "unresolvable").when(other, "stale").otherwise("resolved")
    return F.struct(status.alias("status"), F.when((end <= F.length(content)) & same, found).alias("text"))


def resolve(anchors: DataFrame, documents: DataFrame) -> DataFrame:
    """anchors(document_id, version, start, end, text_hash, …) with resolution against documents(document_id, version, content)."""
    now = documents.select("document_id", F.col("version").alias("now"), "content")
    met = anchors.join(now, "document_id")
    return met.withColumn("resolution", resolution(F.col("content"), F.col("now"), F.col("version"), F.col("start"), F.col("end"), F.col("text_hash"))).drop("content", "now")


def trace(anchors: DataFrame, versions: DataFrame) -> DataFrame:
    """anchors with status, source_path, section, line and current_version (null if it is the anchor's).

    Against the anchored version, the current one where that is gone; anchors of unknown documents vanish.
    """
    cols = ["content", "source_path", "sections"]
    exact = versions.select("document_id", "version", F.lit(True).alias("held"), *[F.col(c).alias(f"e_{c}") for c in cols])
    now = store.current(versions).select("document_id", F.col("version").alias("now"), *[F.col(c).alias(f"n_{c}") for c in cols])
    met = anchors.join(now, "document_id").join(exact, ["document_id", "version"], "left")
    took = met.withColumns({c: F.when(F.col("held"), F.col(f"e_{c}")).otherwise(F.col(f"n_{c}")) for c in cols}).withColumn("read", F.when(F.col("held"), F.col("version")).otherwise(F.col("now")))
    status = resolution(F.col("content"), F.col("read"), F.col("version"), F.col("start"), F.col("end"), F.col("text_hash"))
    out = took.select(*anchors.columns, status["status"].alias("status"), "source_path", section_name(F.col("sections"), F.col("start")).alias("section"), C.line_number(F.col("content"), F.col("start")).alias("line"), "now")
    return out.withColumn("current_version", F.when(F.col("now") != F.col("version"), F.col("now"))).drop("now")


def trace_quotations(quotations: DataFrame, documents: DataFrame, limit: int = 20) -> DataFrame:
    """(quotation_id, document_id, source_path, start, end, line, section): exact, overlapping occurrences in documents.

    In order of document and place, the first `limit` of each quotation. Quotations are a stated
    query set: each is looked for in every document, with the document's text read once. To read
    only documents that can hold them, a quotation's longest whole word prunes by a hash join where the
    quotation has one, and its first three characters where it hasn't; only quotations of one or two
    characters, which hardly any document lacks, are compared with all.
    """
    # A quotation may start and end within words, so only words inside it are whole words of a text.
    inside = F.regexp_extract_all("quotation", F.lit(r"(?<=[^\p{L}])(\p{L}{4,})(?=[^\p{L}])"), F.lit(1))
    longest = F.array_max(F.transform(inside, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = quotations.where("quotation <> ''").withColumn("word", F.coalesce(longest, F.lit("")))
    cols = ["document_id", "content", "source_path", "sections"]
    docs = documents.select(*cols)
    words = docs.select("document_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\p{L}{4,}"), F.lit(0)))).alias("word"))
    keyed = asked.where("word <> ''").join(words, "word").select("quotation_id", "quotation", "document_id")
    near = keyed.join(docs, "document_id")
    rest, met = asked.where("word = ''").select("quotation_id", "quotation"), near
    if not rest.isEmpty():
        keys = rest.where(F.length("quotation") >= 3).withColumn("gram", F.substring("quotation", 1, 3))
        held = docs.select("document_id", F.explode(C.grams(F.col("content"))).alias("gram")).join(small(keys.select("gram").distinct()), "gram", "left_semi")
        met = met.unionByName(keys.join(held, "gram").select("quotation_id", "quotation", "document_id").join(docs, "document_id").select(near.columns))
        tiny = rest.where(F.length("quotation") < 3)
        if not tiny.isEmpty():
            met = met.unionByName(tiny.join(docs, F.col("content").contains(F.col("quotation"))).select(near.columns))
    met = met.where(F.col("content").contains(F.col("quotation")))
    each = met.withColumn("start", F.explode(C.all_positions(F.col("content"), F.col("quotation"), limit)))
    w = W.partitionBy("quotation_id").orderBy("document_id", "start")
    best = each.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    return best.select("quotation_id", "document_id", "source_path", "start", (F.col("start") + F.length("quotation")).alias("end"), C.line_number(F.col("content"), F.col("start")).alias("line"), section_name(F.col("sections"), F.col("start")).alias("section"))


def freshness(documents: DataFrame, files: DataFrame) -> DataFrame:
    """documents(document_id, version, source_path, content) with is_current against files(source_path, bytes).

    A file of another length (a byte-order mark apart) is changed without hashing; a document whose
    file is missing counts as current, for nothing can be said.
    """
    met = documents.join(files.select("source_path", F.col("bytes").alias("__bytes")), "source_path", "left")
    length = F.octet_length("content")
    size = F.octet_length("__bytes")
    mark = F.substring("__bytes", 1, 3) == F.lit(b"\xef\xbb\xbf")
    body = F.when(mark & (size == length + 3), F.expr("substring(__bytes, 4)")).otherwise(F.col("__bytes"))
    same = F.concat(F.lit("sha256:"), F.sha2(body, 256)) == F.col("version")
    current = F.when(F.col("__bytes").isNull(), True).when((size != length) & (size != length + 3), False).otherwise(same)
    return met.withColumn("is_current", current).drop("__bytes")


def overlapping(left: DataFrame, right: DataFrame, key: str = "document_id") -> DataFrame:
    """Pairs of spans of the same document that overlap: (key, l_start, l_end, r_start, r_end)."""
    a = left.select(key, F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    b = right.select(key, F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return a.join(b, key).where((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")))


def blocks_in(blocks: Column, start: Column, end: Column) -> Column:
    """The blocks that overlap a span."""
    return F.filter(blocks, lambda b: (b["start"] < end) & (start < b["end"]))
