"""A ledger of packages: counts and hashes, never text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanlight.functions import columns as C


def opened(packages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, items, omissions) of packages(package_id, created_at, query, unit, budget_limit, spent, items, omissions, protected, seq).

    A package opened again replaces what it was: the last seq counts.
    """
    w = W.partitionBy("package_id").orderBy(F.desc("seq"))
    last = packages.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    entries = last.select(
        "package_id", "created_at", C.content_hash(F.col("query")).alias("query_hash"), "unit", "budget_limit", F.col("spent").alias("estimate"),
        F.size("items").alias("items"), F.size("omissions").alias("omissions"), "protected", F.lit(None).cast("string").alias("verified_at"), F.lit(None).cast("int").alias("cited_items"),
    )
    items = last.select("package_id", F.explode("items").alias("i")).select("package_id", "i.item_id", "i.document_id", "i.start", "i.end", "i.score", "i.cost", F.lit(0).alias("cited"))
    omissions = last.select("package_id", F.explode("omissions").alias("o")).select("package_id", "o.document_id", "o.start", "o.end", "o.rule", "o.score", "o.cost")
    return entries, items, omissions


def closed(entries: DataFrame, items: DataFrame, reports: DataFrame, locations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, items) after reports(package_id, verified_at): which items were cited. Reports of unknown packages are ignored."""
    cited = locations.select("package_id", "item_id").distinct()
    n = cited.groupBy("package_id").agg(F.count("*").cast("int").alias("__cited"))
    done = reports.groupBy("package_id").agg(F.max("verified_at").alias("__at"))
    new = entries.join(done, "package_id", "left").join(n, "package_id", "left")
    over = F.col("__at").isNotNull()
    new = new.withColumns({"verified_at": F.coalesce("__at", "verified_at"), "cited_items": F.when(over, F.coalesce("__cited", F.lit(0))).otherwise(F.col("cited_items"))})
    flags = items.join(done.select("package_id", F.lit(1).alias("__over")), "package_id", "left").join(cited.withColumn("__hit", F.lit(1)), ["package_id", "item_id"], "left")
    flag = F.when(F.col("__over").isNotNull(), F.coalesce("__hit", F.lit(0))).otherwise(F.col("cited"))
    return new.select(entries.columns), flags.withColumn("cited", flag).select(items.columns)


def entries_since(entries: DataFrame, since: str | None = None, limit: int = 100) -> DataFrame:
    """Newest first; since is compared as a string."""
    some = entries if since is None else entries.where(F.col("created_at") >= since)
    return some.orderBy(F.desc("created_at"), "package_id").limit(limit)


def usage(entries: DataFrame, items: DataFrame, omissions: DataFrame, since: str | None = None) -> DataFrame:
    """One row of totals. The cited share is of packages whose answer was verified; null without any."""
    some = entries if since is None else entries.where(F.col("created_at") >= since)
    head = some.agg(F.count("*").alias("packages"), F.count("verified_at").alias("closed"), F.coalesce(F.sum("omissions"), F.lit(0)).alias("omissions"))
    done = items.join(some.where("verified_at is not null").select("package_id"), "package_id").agg(F.count("*").alias("items_sent"), F.coalesce(F.sum("cited"), F.lit(0)).alias("items_cited"))
    full = omissions.where("rule = 'budget_exhausted'").join(some.select("package_id"), "package_id").agg(F.count("*").alias("budget_exhausted"))
    one = head.crossJoin(done).crossJoin(full)  # a row each
    return one.withColumn("cited_share", F.col("items_cited").cast("double") / F.nullif(F.col("items_sent"), F.lit(0)))


def forgotten(tables: tuple[DataFrame, DataFrame, DataFrame], packages: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, items, omissions) without packages(package_id), or empty if none are named."""
    if packages is None:
        return tuple(t.limit(0) for t in tables)  # type: ignore[return-value]
    gone = packages.select("package_id").distinct()
    return tuple(t.join(gone, "package_id", "left_anti").select(t.columns) for t in tables)  # type: ignore[return-value]
