"""Session settings the jobs rely on, and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Rows are sorted before the shuffle (last row per key); a task's share of a scan must fit into its memory.
    "spark.sql.files.maxPartitionBytes": "16MB",
    # A job of many queries would otherwise keep the shuffle files of all of them until the driver collects garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
#: For operators that send whole texts, or sets of them, to Python: a batch is a few megabytes in the JVM and in Python,
#: and shuffle files go at the end of each of an operator's many jobs.
TEXT_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
_CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Rows that one job of a load or a micro-batch shuffles. Larger tables are taken in parts, one after the other, so that the
#: shuffle files on disk at a time are those of one part. Each part reads the tables again, so parts are large.
PART_ROWS = 64_000_000
#: The same for spans of the calendar, which read no more than their own rows.
SPAN_ROWS = 16_000_000


def parts_for(rows: int) -> int:
    """Number of parts for a table of so many rows (the larger one of a join or union)."""
    return max(1, -(-rows // PART_ROWS))


def key_part(df: DataFrame, keys: Sequence[str], part: int, parts: int) -> DataFrame:
    """The rows whose keys belong to a part; equal keys, null ones included, are in one part of any table."""
    if parts == 1:
        return df
    return df.filter(F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(parts)) == part)


def configure(spark: SparkSession, settings: dict[str, str] = SETTINGS) -> SparkSession:
    """Apply the runtime settings; cluster sizing stays with the cluster."""
    for key, value in settings.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a temporary one only on a local master."""
    named = spark.conf.get(_CHECKPOINT_DIR, None)
    if named:
        return named
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _local_scratch()


@cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="priorline-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch root."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the scratch folder and read it back.

    Cuts the plan between two stages of a pipeline: the result is computed once, survives lost
    executors, and has exact size statistics for the plans that read it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._scratch = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` returned and nothing will read again."""
    for table in tables:
        _remove(table.sparkSession, table._scratch)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def held(df: DataFrame | Sequence[DataFrame], name: str, by: Sequence[str] = ()) -> Iterator[DataFrame]:
    """``stored`` for the length of a ``with`` block: the scratch table is removed after it.

    Several tables are written one after the other into one. A table that is held or stored already is not written again.
    """
    parts = [df] if isinstance(df, DataFrame) else df
    if len(parts) == 1 and not by and "_scratch" in vars(parts[0]):
        yield parts[0]
        return
    spark = parts[0].sparkSession
    path = scratch_path(spark, name)
    try:
        for part in parts:
            part.write.mode("append").partitionBy(*by).parquet(path)
        out = spark.read.schema(parts[0].schema).parquet(path) if by else spark.read.parquet(path)  # no folder, no schema
        out._scratch = path
        yield out
    finally:
        _remove(spark, path)
