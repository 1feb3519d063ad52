"""Other sources and sinks: frameworks' documents, interest exports, labelled cases, this repository's corpus view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.errors import ContractError
from spanlight.functions import columns as C
from spanlight.model import BLOCK, SECTION

PATH_KEYS = ("source", "source_path", "file_path", "file_name", "path", "url")
EXPORT_SCHEMA, EXPORT_VERSION = "interest-export", 1


def corpus(rows: DataFrame, source: Column, text: Column) -> DataFrame:
    """Documents of a table: one section, no blocks; the path is given, id and version follow."""
    content = F.coalesce(text, F.lit(""))
    whole = F.array(F.struct(F.lit("").alias("heading"), F.lit(0).alias("level"), F.lit(0).alias("start"), F.length(content).alias("end"))).cast(f"array<{SECTION}>")
    return rows.select(
        C.document_id(source).alias("document_id"),
        C.content_hash(content).alias("version"),
        source.alias("source_path"),
        F.lit("text/plain").alias("media_type"),
        content.alias("content"),
        whole.alias("sections"),
        F.array().cast(f"array<{BLOCK}>").alias("blocks"),
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("metadata"),
    )


def framework_texts(rows: DataFrame, text: Column, metadata: Column, id_: Column, number: Column) -> DataFrame:
    """(source_path, content) of rows of other frameworks: the first path-like metadata key, the id, or a number."""
    paths = [F.when(F.element_at(metadata, k) != "", F.element_at(metadata, k)) for k in PATH_KEYS]
    path = F.coalesce(*paths, F.when(id_ != "", id_), F.format_string("document-%04d", number))
    content = F.when(text.isNull(), F.raise_error(F.lit("a document without text"))).otherwise(text)
    return rows.select(path.alias("source_path"), content.alias("content"))


def as_documents(packages: DataFrame, omissions: bool = True) -> DataFrame:
    """(query_id, n, text, metadata map): items in order and, if asked for, omissions with empty texts."""
    i = packages.select("query_id", F.posexplode("items").alias("n", "i"))
    pairs = lambda **kv: F.map_filter(F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())
    meta = pairs(kind=F.lit("item"), item_id=F.col("i.item_id"), source=F.col("i.source_path"), section=F.col("i.section"), start=F.col("i.start"), end=F.col("i.end"), score=F.col("i.score"))
    out = i.select("query_id", "n", F.col("i.text").alias("text"), meta.alias("metadata"))
    if not omissions:
        return out
    o = packages.select("query_id", F.size("items").alias("base"), F.posexplode("omissions").alias("n", "o"))
    why = pairs(kind=F.lit("omission"), rule=F.col("o.rule"), reason=F.col("o.reason"), source=F.col("o.source_path"), start=F.col("o.start"), end=F.col("o.end"), score=F.col("o.score"))
    return out.unionByName(o.select("query_id", (F.col("base") + F.col("n")).alias("n"), F.lit("").alias("text"), why.alias("metadata")))


def interest_export(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, content, metadata) of an interest export: a line for each interest, marked as interpretation.

    Another schema or version, and an interest without confidence from 0 to 1, are refused.
    """
    schema = "schema string, version int, producer string, exported_at string, interests array<struct<topic:string,summary:string,confidence:double,observed_at:string>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    bad = raw.where((F.col("schema") != EXPORT_SCHEMA) | (F.col("version") != EXPORT_VERSION) | F.col("schema").isNull() | F.col("version").isNull() | F.exists("interests", lambda i: i["confidence"].isNull() | ~i["confidence"].between(0, 1)))
    if not bad.isEmpty():
        raise ContractError(f"not an {EXPORT_SCHEMA} of version {EXPORT_VERSION} with a confidence for every interest: {path}")
    line = lambda i: F.concat_ws(" ", F.concat(F.lit("- "), i["topic"], F.lit(":")), i["summary"], F.format_string("(confidence %.2f)", i["confidence"]))
    text = F.array_join(F.transform("interests", line), "\n")
    least = F.array_min(F.transform("interests", lambda i: i["confidence"]))
    meta = F.create_map(F.lit("layer"), F.lit("interpretation"), F.lit("producer"), F.col("producer"), F.lit("observed_at"), F.col("exported_at"), F.lit("confidence"), least.cast("string"))
    return raw.select(F.concat(F.lit("interests/"), F.coalesce("producer", F.lit("export")), F.lit(".txt")).alias("source_path"), text.alias("content"), meta.alias("metadata"))
