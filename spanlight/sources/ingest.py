"""Ingest: a folder or table into a versioned store on files, with a report."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.errors import StorageError
from spanlight.model import BLOCK, SECTION
from spanlight.operators import store
from spanlight.sources import folder

FORMAT = 1
COLUMNS = f"document_id string, version string, source_path string, media_type string, content string, sections array<{SECTION}>, blocks array<{BLOCK}>, metadata map<string,string>, corpus_root string, ingest_seq bigint"


class Store:
    """Versions of documents under a path: snapshots in folders of their own, the newest named by a pointer file.

    A snapshot is written whole before the pointer moves, so a reader sees the one or the other.
    Appends add a folder of new rows only; forgetting rewrites.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.format_checked()

    def _pointer(self) -> list[str]:
        p = self._path(f"{self.path}/CURRENT")
        if not self._fs.exists(p):
            return []
        return [r.value for r in self.spark.read.text(f"{self.path}/CURRENT").collect()]  # the parts' names

    def _point(self, parts: list[str]) -> None:
        new = f"{self.path}/.CURRENT-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(new))
        out.write(bytearray("\n".join([f"format {FORMAT}", *parts]).encode()))
        out.close()
        self._fs.delete(self._path(f"{self.path}/CURRENT"), False)
        if not self._fs.rename(self._path(new), self._path(f"{self.path}/CURRENT")):
            raise StorageError(f"could not move the pointer of {self.path}")

    def format_checked(self) -> None:
        head = self._pointer()[:1]
        if head and int(head[0].split()[1]) > FORMAT:
            raise StorageError(f"{self.path} has {head[0]}, this reads format {FORMAT}")

    def parts(self) -> list[str]:
        return self._pointer()[1:]

    def versions(self) -> DataFrame:
        parts = self.parts()
        if not parts:
            return self.spark.createDataFrame([], COLUMNS)
        return self.spark.read.schema(COLUMNS).parquet(*[f"{self.path}/{p}" for p in parts])

    def current(self) -> DataFrame:
        return store.current(self.versions())

    def put(self, incoming: DataFrame, seq: int) -> DataFrame:
        """Store what is new of incoming; returns (source_path, document_id, version, status) of every row."""
        held = self.versions()
        judged = store.ingest_status(held, incoming).select("source_path", "document_id", "version", "status")
        part = f"part-{seq:08d}-{uuid.uuid4().hex[:8]}"
        report = f"{self.path}/reports/{part}"
        judged.write.parquet(report)  # before the new rows count as held
        fresh = incoming.withColumn("ingest_seq", F.lit(seq).cast("bigint"))
        new = store.put(held.limit(0), fresh.join(held.select("document_id", "version"), ["document_id", "version"], "left_anti").select(*held.columns))
        new.write.parquet(f"{self.path}/{part}")
        self._point([*self.parts(), part])
        return self.spark.read.parquet(report)

    def forget(self, documents: DataFrame) -> None:
        """Every version of the documents goes, and the files that held them."""
        old = self.parts()
        if not old:
            return
        part = f"part-forget-{uuid.uuid4().hex[:8]}"
        store.forget(self.versions(), documents).write.parquet(f"{self.path}/{part}")
        self._point([part])
        for p in old:
            self._fs.delete(self._path(f"{self.path}/{p}"), True)

    def empty(self) -> None:
        old = self.parts()
        self._point([])
        for p in old:
            self._fs.delete(self._path(f"{self.path}/{p}"), True)


def ingest_folder(spark: SparkSession, root: str, target: Store, seq: int, rules: folder.IgnoreRules = folder.IgnoreRules()) -> DataFrame:
    """(source_path, status, detail): added, revised, unchanged, skipped and failed files of a folder."""
    files, skipped = folder.walk(spark, root, rules)
    read = folder.parsed(files)
    good = read.where("failure is null").drop("failure").withColumn("corpus_root", F.lit(root))
    status = target.put(good, seq).select("source_path", "status", F.lit(None).cast("string").alias("detail"))
    bad = read.where("failure is not null").select("source_path", F.when(F.col("failure") == "no parser", "skipped").otherwise("failed").alias("status"), F.col("failure").alias("detail"))
    out = skipped.select("source_path", F.lit("skipped").alias("status"), F.concat_ws(": ", "reason", "rule").alias("detail"))
    return status.unionByName(bad).unionByName(out)


def ingest_report(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("n"))
