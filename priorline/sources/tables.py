"""Parquet tables: load, save, partitioned results, snapshots and date ranges."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.operators.events import season_of_date
from priorline.operators.sets import union_relaxed
from priorline.sources import versions

_ABSENT = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def load_table(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame | None:
    """A Parquet table (its current version), or None when there is none at the path. Other failures are raised."""
    where = versions.current(spark, path)
    if where is None and versions.versions(spark, path):
        return None  # a first version that was never finished
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    try:
        return reader.parquet(where or path)
    except AnalysisException as error:
        if error.getCondition() in _ABSENT:
            return None
        raise


def load_many(spark: SparkSession, paths: Sequence[str], schema: str | None = None) -> DataFrame:
    """Season files as one table. With a declared wide schema they are one scan, and int and
    bigint files read together; without it each file keeps its types and the union widens them.
    """
    folders = [versions.folder_of(spark, path) for path in paths]
    if schema is not None:
        return spark.read.schema(schema).parquet(*folders)
    return union_relaxed(*[spark.read.parquet(folder) for folder in folders])


def save_table(
    df: DataFrame | Sequence[DataFrame], path: str, partition_by: Sequence[str] = (), options: dict[str, str] | None = None
) -> None:
    """Replace the table at a path, which ``df`` may read from; several tables are written one after the other into one.

    The new table is a version of its own and becomes the current one when it is complete (``sources.versions``), so a
    write that fails or stops anywhere leaves the old table as it is, and there is a whole table at any moment.
    """
    versions.save_version(df, path, partition_by, options)


def delete_table(spark: SparkSession, path: str) -> None:
    """Remove a table, if there is one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def empty_with_schema(spark: SparkSession, schema: str) -> DataFrame:
    """Typed empty table, the "nothing found" value."""
    return spark.createDataFrame([], schema)


def replace_partitions(
    df: DataFrame, path: str, partition_by: Sequence[str], finish: Callable[[DataFrame], DataFrame] | None = None
) -> None:
    """Replace only the partitions present in ``df``.

    Rows are rebalanced by the partition columns: small partitions share a task and become one
    file each, and a partition that holds a large part of the data is split over several tasks. ``finish`` adds columns
    after that shuffle.
    """
    rows = df.hint("rebalance", *partition_by)
    if finish is not None:
        rows = rows.transform(finish)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(
        versions.folder_of(df.sparkSession, path)
    )


def spans(rows: DataFrame, value: str, most: int, of: str | None = None) -> list[Column]:
    """Filters that split a table by ranges of a column's values, each of at most ``most`` rows or of one value.

    For columns with few values, such as calendar days or months. Nulls are with the least value. The filters are on
    ``of`` where that is given: the column the values are the lower ends of (days for months).
    """
    if rows.count() <= most:
        return [F.lit(True)]
    counts = [tuple(r) for r in rows.groupBy(value).count().collect()]
    starts, filled = [], sum(n for v, n in counts if v is None)
    for v, n in sorted(c for c in counts if c[0] is not None):
        if filled and filled + n > most:
            starts.append(v)
            filled = 0
        filled += n
    if not starts:
        return [F.lit(True)]
    at = F.col(of or value)
    between = [(at >= F.lit(low)) & (at < F.lit(high)) for low, high in zip(starts, starts[1:])]
    return [at.isNull() | (at < F.lit(starts[0])), *between, at >= F.lit(starts[-1])]


def save_results(results: DataFrame, path: str) -> None:
    """Results partitioned by date and game; only the partitions present in ``results`` change."""
    replace_partitions(results, path, ["game_date", "game_pk"])


def load_partition(spark: SparkSession, path: str, date: str) -> DataFrame | None:
    """Results of one date from a partitioned table; only that partition is listed and read."""
    return load_table(spark, f"{path}/game_date={date}")


def load_result_files(spark: SparkSession, folder: str) -> DataFrame | None:
    """Results of one date from a folder of ``<game>_sim_probs.parquet`` files.

    Other files and sub-folders are skipped. The files do not hold the game id; it comes from
    the file name.
    """
    files = load_table(spark, folder, pathGlobFilter="*.parquet")
    if files is None:
        return None
    game = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)_", 1).try_cast("bigint")
    return files.withColumn("game_pk", game)


def save_snapshot(stats: DataFrame, path: str, date: str) -> None:
    """Dated feature snapshot; writing a date again replaces it."""
    dated = stats.withColumn("snapshot_date", F.lit(date).cast("date"))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "snapshot_date"
    ).parquet(path)


def load_snapshot(spark: SparkSession, path: str, date: str) -> DataFrame | None:
    """Snapshot of a date, or None when none was ever saved for it."""
    return load_table(spark, f"{path}/snapshot_date={date}")


def scan_by_date(events: DataFrame, start=None, end=None, date: str = "game_date") -> DataFrame:
    """Events of a date range, or of the most recent date when no bound is given.

    One bound alone leaves the other side open. A literal range prunes partitions and row groups; the default bound is
    a scalar subquery over the date column only.
    """
    if start is not None:
        events = events.filter(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        events = events.filter(F.col(date) <= F.lit(end).cast("date"))
    if start is not None or end is not None:
        return events
    latest = events.agg(F.max(date).alias("latest")).scalar()
    return events.filter(F.col(date) == latest)


#: Settings under which Spark answers a maximum from Parquet footers.
_FOOTERS = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}


def newest_date(spark: SparkSession, path: str, date: str = "game_date", schema: str | None = None) -> datetime.date | None:
    """Latest date of a stored table, None for none, from file footers or, for a partition column, from the listing.

    No row group is read: the footers' statistics are the source of the aggregate.
    """
    plan = _newest(spark, path, date, schema)
    return None if plan is None else plan.first()[0]


def _newest(spark: SparkSession, path: str, date: str, schema: str | None) -> DataFrame | None:
    before = {key: spark.conf.get(key, None) for key in _FOOTERS}
    try:
        for key, value in _FOOTERS.items():
            spark.conf.set(key, value)
        table = load_table(spark, path, schema)
        if table is None:
            return None
        found = table.agg(F.max(date).alias("newest"))
        found._jdf.queryExecution().executedPlan()  # planned under these settings
        return found
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def scan_newest(spark: SparkSession, path: str, date: str = "game_date", schema: str | None = None) -> DataFrame | None:
    """Rows of the most recent date of a stored table; its literal date prunes partitions and row groups."""
    table, newest = load_table(spark, path, schema), newest_date(spark, path, date, schema)
    return table if table is None else table.filter(F.col(date) == F.lit(newest).cast("date"))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """The same rows; an empty table is an error when the plan runs."""
    present = df.limit(1).agg(F.count(F.lit(1)).alias("n")).select(
        F.when(F.col("n") > 0, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    )
    return df.filter(present.scalar())


def split_by_season(events: DataFrame, seasons: DataFrame, path: str) -> None:
    """Write the events of every season to its own partition."""
    replace_partitions(season_of_date(events, seasons), path, ["season"])
