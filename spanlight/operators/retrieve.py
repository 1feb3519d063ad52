"""From candidates to results: exact confirmation, widening, scores, the relative floor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanlight.functions import columns as C
from spanlight.functions.text import Confirmation
from spanlight.operators import store
from spanlight.operators.index import CANDIDATES, Index, small

SPAN_BONUS, MATCH_WEIGHT = 0.01, 0.1
LIMIT, CONTEXT = 10, 120


def match_score(bm25: Column, n_spans: Column, matched: Column, query: Column) -> Column:
    """BM25, a little for every span, and the matched share of the question as it was asked."""
    share = F.when(F.length(query) > 0, matched.cast("double") / F.length(query)).otherwise(F.lit(0.0))
    return bm25 + n_spans.cast("double") * F.lit(SPAN_BONUS) + share * F.lit(MATCH_WEIGHT)


def relative_floor(results: DataFrame, floor: float = Confirmation().relative_match_floor) -> DataFrame:
    """results with unconfirmed set where a phrase match is much shorter than the question's longest."""
    best = F.max("matched").over(W.partitionBy("query_id"))
    weak = (F.col("matched") > 0) & (F.col("matched") < best * F.lit(floor))
    return results.withColumn("unconfirmed", F.col("unconfirmed") | F.coalesce(weak, F.lit(False)))


def ranked(results: DataFrame, limit: int | None) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "source_path", "start")
    out = results.withColumn("rank", F.row_number().over(w))
    return out if limit is None else out.where(F.col("rank") <= limit)


def section_name(sections: Column, offset: Column) -> Column:
    """Heading of the innermost section at an offset: the deepest, of those the first; empty outside all."""
    here = F.filter(F.coalesce(sections, F.array().cast("array<struct<heading:string,level:int,start:int,end:int>>")), lambda s: (s["start"] <= offset) & (offset < s["end"]))
    best = F.aggregate(
        here,
        F.struct(F.lit("").alias("heading"), F.lit(-1).alias("level")),
        lambda a, s: F.when(s["level"] > a["level"], F.struct(F.coalesce(s["heading"], F.lit("")).alias("heading"), s["level"].alias("level"))).otherwise(a),
    )
    return best["heading"]


def of_candidates(documents: DataFrame, candidates: DataFrame, most: int) -> DataFrame:
    """All versions of the candidates' documents, of which there are `most` at most."""
    return documents.join(small(candidates.select("document_id").distinct(), most), "document_id", "left_semi")


def confirm(candidates: DataFrame, documents: DataFrame, queries: DataFrame, settings: Confirmation = Confirmation(), context: int = CONTEXT, candidate_limit: int = CANDIDATES) -> DataFrame:
    """One row for each candidate whose document is there: span, text, score, section, unconfirmed, matched.

    candidates has query_id, document_id, version, start, end (of the section) and score; documents
    are all versions held. The version retrieved is read, the current one where it is gone.
    Contents are joined only here, to at most the candidate cap of rows for each question; other
    documents' go no further than the scan as long as that many ids can be sent to every task.
    """
    candidates = candidates.persist()  # read twice; the cap bounds it
    documents = of_candidates(documents, candidates, queries.count() * candidate_limit)
    cols = ["source_path", "content", "sections"]
    exact = documents.select("document_id", "version", *[F.col(c).alias(f"e_{c}") for c in cols])
    newest = store.current(documents).select("document_id", F.col("version").alias("now"), *[F.col(c).alias(f"n_{c}") for c in cols])
    met = candidates.join(exact, ["document_id", "version"], "left").join(newest, "document_id", "left").where("e_content is not null or n_content is not null")
    there = F.col("e_content").isNotNull()
    took = met.select("query_id", "document_id", F.when(there, F.col("version")).otherwise(F.col("now")).alias("version"), "start", "end", "score", *[F.when(there, F.col(f"e_{c}")).otherwise(F.col(f"n_{c}")).alias(c) for c in cols])
    asked = queries.select("query_id", "query", C.needles(F.col("query")).alias("needles"), C.content_terms(F.col("query")).alias("terms"))
    scoped = took.join(asked, "query_id").withColumn("scoped", F.substr("content", F.col("start") + 1, F.col("end") - F.col("start")))
    found = scoped.withColumn("found", C.confirmed(F.col("scoped"), F.col("needles"), F.col("terms"), settings))
    hit = F.size("found.spans") > 0
    first = F.get("found.spans", F.lit(0))
    a, b = F.coalesce(first["start"] + F.col("start"), F.col("start")), F.coalesce(first["end"] + F.col("start"), F.col("start"))
    wide = found.withColumn("at", a).withColumn("wide", C.widened(F.col("content"), a, b, context))
    lo = F.when(hit, F.col("wide.start")).otherwise(F.col("start"))
    hi = F.when(hit, F.col("wide.end")).otherwise(F.least(F.col("start") + context, F.col("end")))
    out = wide.withColumns({"lo": lo, "hi": hi})
    text = F.substr("content", F.col("lo") + 1, F.col("hi") - F.col("lo"))
    score = F.when(hit, match_score(F.col("score"), F.size("found.spans"), F.col("found.matched"), F.col("query"))).otherwise(F.col("score"))
    return out.select(
        "query_id",
        "document_id",
        "version",
        F.col("lo").alias("start"),
        F.col("hi").alias("end"),
        text.alias("text"),
        C.content_hash(text).alias("text_hash"),
        "source_path",
        score.alias("score"),
        section_name(F.col("sections"), F.col("at")).alias("section"),
        (~hit).alias("unconfirmed"),
        F.when(hit, F.col("found.matched")).otherwise(0).alias("matched"),
    )


def search(queries: DataFrame, documents: DataFrame, index: Index, limit: int | None = LIMIT, candidate_limit: int = 50, context: int = CONTEXT, settings: Confirmation = Confirmation()) -> tuple[DataFrame, DataFrame]:
    """(results, truncation): ranked results of queries(query_id, query), and the questions whose candidates reached the cap."""
    candidates = index.candidates(queries, candidate_limit).persist()  # read for the truncation too; the cap bounds it
    return searched(candidates, queries, documents, limit, candidate_limit, context, settings)


def searched(candidates: DataFrame, queries: DataFrame, documents: DataFrame, limit: int | None, candidate_limit: int, context: int, settings: Confirmation) -> tuple[DataFrame, DataFrame]:
    """search() from candidates that the index has proposed."""
    truncation = candidates.where("capped").select("query_id").distinct().select("query_id", F.lit(candidate_limit).alias("limit"), F.lit("candidate retrieval").alias("stage"))
    results = confirm(candidates.drop("rank", "capped"), documents, queries, settings, context, candidate_limit)
    return ranked(relative_floor(results, settings.relative_match_floor), limit), truncation
