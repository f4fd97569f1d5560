"""Pitches to classified plate appearances."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priorline import constants as C
from priorline.functions import outcomes

PA_KEYS = ["game_pk", "at_bat_number"]


def project_contract(pitches: DataFrame, columns: Sequence[str] = C.PITCH_COLUMNS) -> DataFrame:
    """Exactly the declared columns; a missing one is an analysis error."""
    return pitches.select(*columns)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of every key group.

    Filtering ``row_number() = 1`` lets Spark apply the limit per group before the shuffle as
    well (WindowGroupLimit), so a hot key sends at most one row per map task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(window))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def last_per_group(
    pitches: DataFrame,
    keys: Sequence[str] = PA_KEYS,
    order: str = "pitch_number",
    ties: Sequence[str] | None = None,
) -> DataFrame:
    """Last pitch of every plate appearance, nulls of that row included.

    A null ``order`` value ranks lowest. Ties are settled by the remaining columns in their
    declared order, so the result does not depend on how the input is partitioned.
    """
    if ties is None:
        ties = [c for c in pitches.columns if c not in {*keys, order}]
    return keep_first(pitches, keys, [F.col(c).desc_nulls_last() for c in (order, *ties)])


def classify_outcome(pa: DataFrame, event: str = "events") -> DataFrame:
    """Add the outcome class and drop rows whose event is null or unmapped."""
    classified = pa.withColumn(C.OUTCOME_COLUMN, outcomes.outcome_code(F.col(event)))
    return classified.filter(F.col(C.OUTCOME_COLUMN) != C.UNMAPPED_OUTCOME)


def event_flags(pa: DataFrame, event: str = "events") -> DataFrame:
    """Add the eleven ``is_*`` indicators."""
    return pa.withColumns(outcomes.event_flags(F.col(event)))


def plate_appearances(pitches: DataFrame) -> DataFrame:
    """Contract, last pitch, outcome class and flags in one chain."""
    return (
        pitches.transform(project_contract)
        .transform(last_per_group)
        .transform(classify_outcome)
        .transform(event_flags)
    )


def platoon_flag(pa: DataFrame) -> DataFrame:
    return pa.withColumn("is_platoon_adv", outcomes.platoon_flag(F.col("stand"), F.col("p_throws")))


def home_batter_flag(pa: DataFrame) -> DataFrame:
    return pa.withColumn("is_batter_home", outcomes.home_batter_flag(F.col("inning_topbot")))


def training_filter(
    df: DataFrame,
    years: Sequence[int] = C.TRAINING_YEARS,
    max_inning: int = C.TRAINING_MAX_INNING,
    year: str = "game_year",
) -> DataFrame:
    """Early innings of the training seasons."""
    return df.filter((F.col("inning") <= max_inning) & F.col(year).isin(list(years)))


def drop_nulls(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop rows with a null in any listed column. NaN is a value and stays (unlike ``na.drop``)."""
    return df.filter(reduce(and_, [F.col(c).isNotNull() for c in columns]))


def complete_records(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``drop_nulls`` over those of the listed columns that exist."""
    present = [c for c in columns if c in df.columns]
    return drop_nulls(df, present) if present else df


def season_of_date(df: DataFrame, seasons: DataFrame, date: str = "game_date") -> DataFrame:
    """Attach the season whose ``[start, end]`` holds the date; other dates are dropped.

    The ranges are unrolled to one row per day, which turns the range condition into an
    equality and leaves the join method to Spark.
    """
    days = F.explode(F.sequence(F.col("start"), F.col("end"), F.expr("interval 1 day")))
    return df.join(seasons.select("season", days.alias(date)), date, "inner")
