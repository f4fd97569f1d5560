"""Daily event counts per entity as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.sources.upsert import upsert_partitions

LATENESS = "2 days"


def stream_daily_totals(
    events: DataFrame, entity: str, moment: str = "ts", kind: str = "event_type", lateness: str = LATENESS
) -> DataFrame:
    """Events per entity, day and kind, accepting rows up to ``lateness`` behind the newest one.

    Works on a stream and on a table. In append mode a stream emits a day once the watermark has
    passed its end, so state holds only the open days.
    """
    timed = events.withColumn(moment, F.col(moment).cast("timestamp")).withWatermark(moment, lateness)
    counts = timed.groupBy(F.window(moment, "1 day"), entity, kind).agg(F.count(F.lit(1)).alias("daily_events"))
    return counts.select(
        entity, kind, F.to_date(F.col("window.start")).alias("day"), "daily_events"
    )


def keep_in(counts: DataFrame, path: str, checkpoint: str, entity: str, kind: str = "event_type"):
    """Keep a table of all days, open ones included, and stop once all available input is processed.

    In update mode every changed day is written again, keyed by entity, kind and day into monthly partitions, so the
    table equals the totals of everything that has arrived.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        monthly = batch.withColumn("month", F.trunc("day", "month"))
        upsert_partitions(
            batch.sparkSession, path, monthly, f"batch-{batch_id}", keys=[entity, kind, "day"], partition="month", lead=None
        )

    return (
        counts.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def append_to(counts: DataFrame, path: str, checkpoint: str):
    """Append the closed days to a table and stop once all available input is processed."""
    return (
        counts.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
