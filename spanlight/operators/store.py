"""Versioned documents: identity, put, look-up, forget, corpus state."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanlight.functions import columns as C

#: Versions in a run of corpus_state.
RUN = 10_000


def identified(texts: DataFrame, path_col: str = "source_path", text_col: str = "content") -> DataFrame:
    """All columns, document_id (of the path alone) and version (of the content alone)."""
    return texts.withColumns({"document_id": C.document_id(F.col(path_col)), "version": C.content_hash(F.col(text_col))})


def ingest_status(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming with status added, revised or unchanged; held and incoming have document_id and version.

    Only the two keys of held are read.
    """
    keys = held.select("document_id", "version").distinct()
    same = keys.withColumn("__same", F.lit(True))
    known = keys.select("document_id").distinct().withColumn("__known", F.lit(True))
    joined = incoming.join(same, ["document_id", "version"], "left").join(known, "document_id", "left")
    status = F.when(F.col("__same"), "unchanged").when(F.col("__known"), "revised").otherwise("added")
    return joined.withColumn("status", status).drop("__same", "__known")


def put(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """held and what is new of incoming, numbered behind it by ingest_seq.

    A (document, version) already held is a no-op; so is its repetition within incoming, of which
    the first row by path order counts.
    """
    fresh = incoming.join(held.select("document_id", "version"), ["document_id", "version"], "left_anti")
    first = W.partitionBy("document_id", "version").orderBy("source_path", "ingest_seq")
    once = fresh.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return held.unionByName(once.select(held.columns))


def current(versions: DataFrame) -> DataFrame:
    """The last version put of every document. A version put before stays where it was first put: A, B, A leaves B."""
    last = W.partitionBy("document_id").orderBy(F.desc("ingest_seq"), F.desc("version"))
    return versions.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def get(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents of wanted(document_id, version): that version, the current one where version is null."""
    exact = versions.join(wanted.where("version is not null").distinct(), ["document_id", "version"], "left_semi")
    newest = current(versions).join(wanted.where("version is null").select("document_id").distinct(), "document_id", "left_semi")
    more = newest.join(exact.select("document_id", "version"), ["document_id", "version"], "left_anti")
    return exact.unionByName(more.select(exact.columns))


def history(versions: DataFrame) -> DataFrame:
    """(document_id, version, ingest_seq, is_current), oldest first within a document."""
    now = current(versions).select("document_id", F.col("version").alias("__now"))
    return versions.join(now, "document_id").select("document_id", "version", "ingest_seq", (F.col("version") == F.col("__now")).alias("is_current"))


def forget(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """rows of any table keyed by document_id without those documents, all versions of them."""
    return rows.join(documents.select("document_id").distinct(), "document_id", "left_anti")


def corpus_state(versions: DataFrame) -> DataFrame:
    """One row: the hash of the sorted version strings, one a line.

    The digest is of one string that grows with the corpus, so it is folded: versions are range-sorted,
    each task sends runs of RUN lines, and the driver hashes run after run in order, holding one at a time.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, RUN):
                lines = "\n".join(b.column(0).slice(at, RUN).to_pylist()) + "\n"
                yield pa.RecordBatch.from_arrays([pa.array([lines.encode()])], names=["lines"])

    digest, last = hashlib.sha256(), b""
    for r in versions.select("version").where("version is not null").orderBy("version").mapInArrow(runs, "lines binary").toLocalIterator():
        digest.update(last)
        digest.update(r.lines[:-1])
        last = b"\n"
    return versions.sparkSession.range(1).select(F.lit(f"sha256:{digest.hexdigest()}").alias("corpus_state"))


def counts(versions: DataFrame, root_col: str = "corpus_root") -> DataFrame:
    """(documents, roots): distinct current documents and distinct corpus roots."""
    return current(versions).agg(F.countDistinct("document_id").alias("documents"), F.countDistinct(root_col).alias("roots"))
