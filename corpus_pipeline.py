"""A corpus pipeline of five stages over `documents`, each one of the llm operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.llm import language_id, packing, pii, simhash, toxicity
from spanlight.llm.common import BROADCAST_ROWS, all_of, materialize, table, unused


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language, which are those without a letter; short ones stay, however unsure."""
    name = unused(docs, "language")
    out = language_id.identified(docs, language_id.fit(docs), out_col=name)
    return out.where(F.col(name)["lang"] != language_id.UNKNOWN).select(all_of(out, docs.columns))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is 0.5 or more; null and empty texts score below that and stay."""
    name = unused(docs, "toxicity_score")
    out = toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), out_col=name)
    return out.where(F.col(name) < 0.5).select(all_of(out, docs.columns))


def _ids(found: DataFrame, tag: str) -> DataFrame:
    """The ids written, for a join: they are broadcast at most if they are few, whatever their files' size."""
    ids = materialize(found, tag)
    return ids if ids.count() <= BROADCAST_ROWS else ids.hint("merge")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of every near-duplicate group.

    Rows repeated with id and text count once; documents without an id can't be named, and stay.
    """
    found = materialize(simhash.near_duplicates(docs), "copies")
    gone = _ids(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")  # a small table is known to be one
    kept = docs.join(gone, "doc_id", "left_anti")
    again = _ids(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept.select(all_of(kept, docs.columns))
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    single = kept.join(again, "doc_id", "left_anti")
    return single.select(all_of(single, docs.columns)).union(once.select(all_of(once, docs.columns)))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and terms that disclose it, by their kind; null texts stay null, and no row goes."""
    out = pii.sanitise(docs)
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 4096-token sequences along the curve, with their token ids."""
    return packing.pack(docs, keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("toxicity", toxic),
    ("near_copies", near_copies),
    ("pii", private),
    ("packing", packed),
]

#: SQL can express neither the learnt stages nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
