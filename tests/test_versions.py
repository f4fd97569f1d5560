"""Versions: a write that stops after any step leaves a whole table."""

import pytest
from helpers import rows
from pyspark.sql import functions as F

from priorline.sources import tables, versions


def content(spark, path):
    return rows(tables.load_table(spark, path))


@pytest.mark.parametrize("step", ["write_version", "commit", "sweep"])
def test_a_write_that_stops_anywhere_leaves_a_whole_table(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    assert tables.load_table(spark, path) is None
    tables.save_table(spark.range(3), path)
    real = getattr(versions, step)

    def after(*args):
        real(*args)
        raise OSError("lost")

    def before(*args):
        raise OSError("lost")

    for how in (before, after):
        old = content(spark, path)
        monkeypatch.setattr(versions, step, how)
        with pytest.raises(OSError, match="lost"):
            tables.save_table(spark.range(5), path)
        monkeypatch.setattr(versions, step, real)
        assert content(spark, path) in (old, [(k,) for k in range(5)])
    tables.save_table(spark.range(2), path)
    assert content(spark, path) == [(0,), (1,)]
    assert len(versions.versions(spark, path)) == versions.KEPT


def test_a_plan_made_before_a_write_keeps_its_version(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.save_table(spark.range(3), path)
    pinned = tables.load_table(spark, path)
    tables.save_table(pinned.filter("id > 0"), path)
    assert pinned.count() == 3 and content(spark, path) == [(1,), (2,)]


def test_partitions_of_the_current_version_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    two = spark.range(6).withColumn("p", (F.col("id") % 2).cast("int"))
    tables.save_table(two, path, ["p"])
    tables.replace_partitions(two.filter("id = 3"), path, ["p"])
    spark.catalog.clearCache()
    assert content(spark, path) == [(0, 0), (2, 0), (3, 1), (4, 0)]


def test_a_plain_table_becomes_versioned(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(4).write.parquet(path)
    tables.save_table(tables.load_table(spark, path).filter("id > 1"), path)
    assert content(spark, path) == [(2,), (3,)]
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")) == ["_current", *versions.versions(spark, path)]
