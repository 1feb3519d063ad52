"""Incremental ingest from a stream of new rows, and ledger statistics by event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanlight.sources.ingest import Store


def ingest_stream(rows: DataFrame, target: Store, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None, once: bool = True) -> StreamingQuery:
    """Put every micro-batch of documents into the store. A batch that is replayed changes nothing, for versions are content hashes."""

    def put(batch: DataFrame, epoch: int) -> None:
        report = target.put(batch, epoch)
        if on_batch is not None:
            on_batch(report, epoch)

    writer = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def usage_by_window(entries: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Packages, items and omissions of ledger entries (a stream or table with created_at timestamps) in tumbling windows; later events than `lateness` are dropped by the watermark."""
    return (
        entries.withWatermark("created_at", lateness)
        .groupBy(F.window("created_at", width))
        .agg(F.count("*").alias("packages"), F.sum("items").alias("items"), F.sum("omissions").alias("omissions"))
        .select("window.start", "window.end", "packages", "items", "omissions")
    )
