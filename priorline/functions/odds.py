"""Odds, histogram labels and key parsing for trial reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CERTAIN_ODDS = -99999
LONGEST_ODDS = 99999
SMALLEST_PRICED_PROBABILITY = 1e-9


def decimal_odds(probability: Column) -> Column:
    """``1 / p``; null for null, zero or negative probabilities."""
    return F.when(probability > 0, F.try_divide(F.lit(1.0), probability))


def american_odds(probability: Column) -> Column:
    """Whole-number American odds, rounded half to even; null outside ``(0, 1]``."""
    underdog = F.try_divide(F.lit(100.0), probability) - 100
    favourite = F.try_divide(probability, 1 - probability) * -100
    odds = F.when(probability < 0.5, underdog).otherwise(favourite)
    return (
        F.when(probability == 1, F.lit(CERTAIN_ODDS).cast("long"))
        .when(probability.isNull() | (probability <= 0) | (probability > 1), F.lit(None).cast("long"))
        .when(probability < SMALLEST_PRICED_PROBABILITY, F.lit(LONGEST_ODDS).cast("long"))
        .otherwise(F.bround(odds, 0).cast("long"))
    )


def histogram_bin(value: Column, max_bin: int) -> Column:
    """Bin of a count: null counts as 0, everything from ``max_bin`` up shares one bin; a negative count is an error."""
    refused = F.raise_error(F.concat(F.lit("a count is negative: "), value.cast("string"))).cast("int")
    return F.when(value < 0, refused).otherwise(_bin(value, max_bin))


def _bin(value: Column, max_bin: int) -> Column:
    return F.least(F.coalesce(value, F.lit(0)), F.lit(max_bin)).cast("int")


def bin_label(bin_value: Column, max_bin: int) -> Column:
    """``"0"``, ``"1"``, ... and ``"{max_bin}+"``."""
    return F.when(bin_value < max_bin, bin_value.cast("string")).otherwise(F.lit(f"{max_bin}+"))


def team_label(team: Column) -> Column:
    """``away`` to ``Away``."""
    return F.initcap(team)


def display_name(name: Column, team: Column) -> Column:
    """Team display name with the default ``Away Team`` / ``Home Team``."""
    return F.coalesce(name, F.concat(F.initcap(team), F.lit(" Team")))


def inning_number(key: Column) -> Column:
    """``inning_3`` or ``3`` to 3; null when the key holds no number there."""
    part = F.when(F.contains(key, F.lit("_")), F.try_element_at(F.split(key, "_"), F.lit(2))).otherwise(key)
    return part.try_cast("int")


def inning_rejects(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose inning key is present but holds no number: what ``inning_number`` turns to null."""
    return rows.filter(F.col(key).isNotNull() & inning_number(F.col(key)).isNull())
