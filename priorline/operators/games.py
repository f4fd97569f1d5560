"""Game table: parsed weather and wind, and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.functions import text

GAME_COLUMNS = [
    "game_id", "away_team", "away_team_id", "home_team", "home_team_id",
    "away_runs", "home_runs", "total_runs", "venue", "weather_raw", "wind_raw",
    "temperature", "weather_conditions", "is_domed_stadium", "roof_closed",
    "wind_speed_mph", "wind_direction", "wind_affects_play",
]


def parse_weather(df: DataFrame, column: str = "weather") -> DataFrame:
    working = df.withColumns(text.tokens(F.col(column), "degrees")).withColumns(text.weather_digits())
    return working.withColumns(text.weather_columns()).drop(*text.WORKING)


def parse_wind(df: DataFrame, column: str = "wind") -> DataFrame:
    working = df.withColumns(text.tokens(F.col(column), "mph")).withColumns(text.wind_digits())
    return working.withColumns(text.wind_columns()).drop(*text.WORKING)


def domed_fallback(df: DataFrame) -> DataFrame:
    """Fill an unknown dome flag from the venue."""
    return df.withColumn("is_domed_stadium", text.domed_or_known(F.col("is_domed_stadium"), F.col("venue")))


def enrich_games(flat: DataFrame) -> DataFrame:
    """Flat box scores to the eighteen-column game table, in one projection."""
    return (
        flat.transform(parse_weather)
        .transform(parse_wind)
        .transform(domed_fallback)
        .withColumnsRenamed({"weather": "weather_raw", "wind": "wind_raw"})
        .select(*GAME_COLUMNS)
    )


def game_summary(games: DataFrame) -> DataFrame:
    """One row of totals. A null venue counts as one more distinct venue.

    Two aggregation levels: per venue first, so that the distinct count needs no separate pass
    and the heavy work is merged before the shuffle.
    """
    per_venue = games.groupBy("venue").agg(
        F.count(F.lit(1)).alias("games"),
        F.sum("total_runs").alias("runs"),
        F.count("total_runs").alias("runs_known"),
        F.min("temperature").alias("min_temperature"),
        F.max("temperature").alias("max_temperature"),
        F.count_if("is_domed_stadium").alias("domed"),
        F.count_if("wind_affects_play").alias("windy"),
    )
    return per_venue.agg(
        F.coalesce(F.sum("games"), F.lit(0)).alias("total_games"),
        F.try_divide(F.sum("runs"), F.sum("runs_known")).alias("average_total_runs"),
        F.count(F.lit(1)).alias("unique_venues"),
        F.min("min_temperature").alias("min_temperature"),
        F.max("max_temperature").alias("max_temperature"),
        F.coalesce(F.sum("domed"), F.lit(0)).alias("domed_games"),
        F.try_divide(F.sum("domed") * 100.0, F.sum("games")).alias("domed_percent"),
        F.coalesce(F.sum("windy"), F.lit(0)).alias("windy_games"),
        F.try_divide(F.sum("windy") * 100.0, F.sum("games")).alias("windy_percent"),
    )
