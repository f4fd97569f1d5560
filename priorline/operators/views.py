"""Result views: filters, pivots, summaries and display tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline import constants as C

from priorline.functions import numbers


def filter_results(
    results: DataFrame,
    team: str | None = None,
    inning: int | None = None,
    stat: str | None = None,
    team_names: Sequence[str] | None = None,
    min_probability: float = 0.0,
) -> DataFrame:
    """Conjunction of the given filters; pooled rows pass the team-name filter."""
    filtered = results
    if team is not None:
        filtered = filtered.filter(F.col("team") == team)
    if inning is not None:
        filtered = filtered.filter(F.col("inning") == inning)
    if stat is not None:
        filtered = filtered.filter(F.col("stat") == stat)
    if team_names:
        filtered = filtered.filter(F.col("team_name").isin(list(team_names)) | (F.col("team") == "Total"))
    if min_probability > 0:
        filtered = filtered.filter(F.col("probability") >= min_probability)
    return filtered


def display_rounding(results: DataFrame) -> DataFrame:
    """Percentage and decimal odds with two decimals."""
    return results.withColumns(
        {
            "probability_pct": numbers.percentage(F.col("probability")),
            "decimal_odds": F.round("decimal_odds", 2),
        }
    )


def drop_rename(results: DataFrame) -> DataFrame:
    """Display table: rounded columns under their display names, working columns dropped."""
    return display_rounding(results).drop("probability").withColumnsRenamed(C.DISPLAY_NAMES)


def odds_view(results: DataFrame) -> DataFrame:
    """Rows with decimal odds strictly between 1 and 1000, with a percentage."""
    priced = (F.col("decimal_odds") > 1) & (F.col("decimal_odds") < 1000)
    return results.filter(priced).withColumn("probability_pct", numbers.percentage(F.col("probability")))


def summary_by_team_stat(results: DataFrame) -> DataFrame:
    """Mean and highest probability, mean decimal odds and row count per team and statistic."""
    return results.groupBy("team", "stat").agg(
        F.avg("probability").alias("avg_probability"),
        F.max("probability").alias("max_probability"),
        F.avg("decimal_odds").alias("avg_decimal_odds"),
        F.count(F.lit(1)).alias("count"),
    )


def heatmap_pivot(
    results: DataFrame,
    index: Sequence[str] = ("game_pk", "inning", "team", "stat"),
    labels: Sequence[str] = tuple(C.BIN_LABELS),
) -> DataFrame:
    """One column per bin label, 0 where a bin is absent.

    The labels are given, so no job is needed to find them. Two probabilities for one cell are
    an error when the plan runs.
    """
    twice = F.raise_error(F.lit("more than one probability for one heat-map cell")).cast("double")
    cell = F.when(F.count("probability") > 1, twice).otherwise(F.max("probability"))
    return results.groupBy(*index).pivot("number_bin", list(labels)).agg(cell).na.fill(0.0, list(labels))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column, ordered."""
    return df.select(column).distinct().orderBy(column)


def team_name_options(results: DataFrame) -> DataFrame:
    """Distinct team names apart from the pooled one, ordered."""
    return distinct_values(results.filter(F.col("team") != "Total"), "team_name")


def sort_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ascending sort for a presentation sink, nulls first."""
    return df.orderBy(*keys)


def top_categories(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The most frequent non-null values; equal counts are settled by the value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), column).limit(n)


def head_n(df: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """First rows in key order."""
    return df.orderBy(*keys).limit(n)
