"""Static dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from priorline import constants as C
from priorline import schemas


def teams(spark: SparkSession) -> DataFrame:
    """Club name and abbreviation of the thirty teams."""
    return spark.createDataFrame([(name, abbr) for abbr, name in C.TEAM_NAMES.items()], schemas.TEAM)


def seasons(spark: SparkSession, bounds: list[tuple[int, str, str]]) -> DataFrame:
    """``(season, start, end)`` from a list of season bounds."""
    rows = spark.createDataFrame(bounds, "season int, start string, end string")
    return rows.selectExpr("season", "cast(start as date) as start", "cast(end as date) as end")
