import time
from pathlib import Path

import pytest
from helpers import rows

from priorline.operators import events
from priorline.streaming import daily, upsert
from test_events import pitches


def test_split_plate_appearances_equal_the_batch(spark, tmp_path):
    """Pitches of one plate appearance arrive in different files, the last one first."""
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    first = pitches(spark, [
        {"game_pk": 1, "at_bat_number": 1, "pitch_number": 3, "events": "single"},
        {"game_pk": 1, "at_bat_number": 2, "pitch_number": 1, "events": "walk"},
    ])
    second = pitches(spark, [
        {"game_pk": 1, "at_bat_number": 1, "pitch_number": 2, "events": None},
        {"game_pk": 1, "at_bat_number": 2, "pitch_number": 2, "events": None},
        {"game_pk": 1, "at_bat_number": 3, "pitch_number": 1, "events": "double"},
    ])
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(source)
        upsert.stream_last_pitches(spark, source, path, checkpoint).awaitTermination()
    got = upsert.stored_plate_appearances(spark, path)
    batch = events.plate_appearances(first.union(second))
    columns = ["game_pk", "at_bat_number", "pitch_number", "events", "is_hit"]
    assert rows(got, *columns) == rows(batch, *columns) == [(1, 1, 3, "single", True), (1, 3, 1, "double", True)]


def test_only_closed_days_are_appended(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    data = [(1, "2024-01-01 10:00:00", "a"), (1, "2024-01-01 23:00:00", "a"), (2, "2024-01-02 01:00:00", "b"), (1, "2024-01-05 00:00:00", "a")]
    table = spark.createDataFrame(data, "user_id bigint, ts string, event_type string").selectExpr("user_id", "cast(ts as timestamp) as ts", "event_type")
    table.write.parquet(source)
    stream = spark.readStream.schema(table.schema).parquet(source)
    daily.append_to(daily.stream_daily_totals(stream, "user_id"), path, checkpoint).awaitTermination()
    got = [(r["user_id"], str(r["day"]), r["daily_events"]) for r in spark.read.parquet(path).collect()]
    assert sorted(got) == [(1, "2024-01-01", 2), (2, "2024-01-02", 1)]
    assert daily.stream_daily_totals(table, "user_id").count() == 3


def test_a_correction_in_a_later_file_wins(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    one = {"game_pk": 1, "at_bat_number": 1, "pitch_number": 3}
    for event in ("single", "field_error"):
        pitches(spark, [one | {"events": event}]).coalesce(1).write.mode("append").parquet(source)
        upsert.stream_last_pitches(spark, source, path, checkpoint).awaitTermination()
        time.sleep(1.1)  # files are told apart by the second
    assert rows(upsert.stored_plate_appearances(spark, path), "events") == [("field_error",)]


def test_a_fresh_checkpoint_loads_new_files(spark, tmp_path):
    first, second, path = (str(tmp_path / n) for n in ("one", "two", "out"))
    for k, source in enumerate((first, second)):
        pitches(spark, [{"game_pk": g, "at_bat_number": 1, "pitch_number": 1, "events": "walk"} for g in (1 + 2 * k, 2 + 2 * k)]).write.parquet(source)
        upsert.stream_last_pitches(spark, source, path, str(tmp_path / f"check{k}")).awaitTermination()
    spark.catalog.clearCache()
    assert rows(upsert.stored_plate_appearances(spark, path), "game_pk") == [(1,), (2,), (3,), (4,)]


def test_open_days_are_kept(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    for data in ([(1, "2024-01-01 10:00:00", "a")], [(1, "2024-01-01 11:00:00", "a"), (2, "2024-01-05 01:00:00", "b")]):
        table = spark.createDataFrame(data, "user_id bigint, ts string, event_type string").selectExpr("user_id", "cast(ts as timestamp) as ts", "event_type")
        table.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(table.schema).parquet(source)
        daily.keep_in(daily.stream_daily_totals(stream, "user_id"), path, checkpoint, "user_id").awaitTermination()
    spark.catalog.clearCache()
    assert [(r[0], r[1]) for r in rows(spark.read.parquet(path), "user_id", "daily_events")] == [(1, 2), (2, 1)]


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="the given data is not here")
def test_streamed_slices_grow_in_number_with_the_shuffle(spark, monkeypatch):
    from priorline.catalog import REGISTRY, stream_queries
    from priorline.catalog.bindings import Tables

    found = []

    def stops(spark, source, *_, files_per_batch, **__):
        found.append((len(list(Path(source).glob("*.parquet"))), files_per_batch))
        raise OSError("enough")

    monkeypatch.setattr(stream_queries.upsert, "stream_last_pitches", stops)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        with pytest.raises(OSError, match="enough"):
            REGISTRY["stream_upsert"].build(Tables(spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found == [(7, 4)]
