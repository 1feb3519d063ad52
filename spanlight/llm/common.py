"""Table access, shared-folder materialisation and small column helpers of the llm operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []

#: Rows of a join's side that may go to the driver and every task. Spark itself decides by the bytes of
#: compressed files, and takes what explode() makes of a table for as small as the table.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach: spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spanlight-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    path = "file://" + own
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back, which cuts the lineage.

    The files outlive lost executors and go when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanlight/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._spanlight_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that no later plan reads."""
    path = getattr(df, "_spanlight_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _written[:] = [x for x in _written if x[1] != path]


@atexit.register
def _clean() -> None:
    for spark, path in list(_written):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session may be gone already; the folder then stays behind
            pass


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def all_of(df: DataFrame, names: list[str] | None = None) -> list[Column]:
    """Columns by name, whatever characters the names hold."""
    return [df[f"`{c}`"] for c in (df.columns if names is None else names)]


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents that no model may learn from (a null id counts as held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))
