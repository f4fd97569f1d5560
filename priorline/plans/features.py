"""Feature tables: plate appearances, defence, training rows and the design matrix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline import constants as C
from priorline.operators import events, features, model, rates, totals

TRAINING_COLUMNS = [
    "game_pk", "batter", "pitcher", "home_team", "is_batter_home", "game_date", "year",
    C.OUTCOME_COLUMN, "is_platoon_adv",
    "pitcher_avg_a_daily_input", *C.PITCHER_RATE_COLUMNS,
    "batter_avg_daily_input", *C.BATTER_RATE_COLUMNS,
    "team_defense_oaa_input", "park_factor_input",
]


def entity_features(
    pa: DataFrame, entity: str, league: Mapping[str, float] | DataFrame = C.LEAGUE_RATES
) -> DataFrame:
    """Shrunken prior rates per entity and day, ready to join."""
    return (
        totals.entity_daily(pa, entity)
        .transform(totals.prior_totals, entity)
        .transform(rates.shrunken_rates, entity, league)
        .transform(features.select_by_prefix, entity)
    )


def pa_features(
    pa: DataFrame, league: Mapping[str, float] | DataFrame = C.LEAGUE_RATES
) -> DataFrame:
    """Plate appearances with batter and pitcher prior rates and the two context flags.

    ``pa`` is read three times (two narrow aggregations and the fact side); pass the stored
    table rather than the chain that derives it from pitches. The joins carry running totals, small
    whole numbers that compress well, and the rates are taken from them after the last shuffle.
    """
    joined = pa
    for entity in features.ENTITIES:
        counted = totals.prior_totals(totals.entity_daily(pa, entity), entity)
        joined = features.attach_entity_stats(joined, running_totals(counted, entity), entity)
    return rates_of_totals(joined, league)


def running_totals(counted: DataFrame, entity: str) -> DataFrame:
    """Entity, day and the running totals of ``prior_totals``."""
    return counted.select(entity, "game_date", *totals.prior_names(entity))


def rates_of_totals(joined: DataFrame, league: Mapping[str, float] | DataFrame = C.LEAGUE_RATES) -> DataFrame:
    """Prior rates and context flags of plate appearances that carry running totals, which are dropped."""
    carried = [c for entity in features.ENTITIES for c in totals.prior_names(entity)]
    for entity in features.ENTITIES:
        met = F.col(f"cum_pa{totals.ENTITY_SUFFIX[entity]}_prev_day").isNotNull()
        before = set(joined.columns)
        joined = rates.shrunken_rates(joined, entity, league)
        # A row without totals (a null player or day) has no rates.
        joined = joined.withColumns({c: F.when(met, F.col(c)) for c in joined.columns if c not in before})
    return joined.drop(*carried).transform(events.platoon_flag).transform(events.home_batter_flag)


def defense_features(
    oaa: DataFrame,
    pa: DataFrame,
    first_year: int = C.FIRST_YEAR,
    last_year: int | None = None,
) -> DataFrame:
    """Prior defence per player and year from yearly ratings and innings in the field."""
    history = (
        totals.entity_year_grid(oaa, first_year, last_year)
        .transform(totals.grid_left_fact, oaa)
        .transform(totals.grid_left_innings, totals.distinct_innings(pa))
    )
    return totals.player_prior_defense(history)


def training_table(
    pa_with_features: DataFrame,
    defense: DataFrame,
    factors: DataFrame,
    teams: DataFrame,
    years: Sequence[int] = C.TRAINING_YEARS,
    max_inning: int = C.TRAINING_MAX_INNING,
) -> DataFrame:
    """Early-inning rows of the training seasons with defence and park context, 29 columns.

    The season filter comes before the joins, so it prunes the scan. An infinite rating (one without innings) says
    nothing about a fielder and adds 0.
    """
    rows = events.training_filter(pa_with_features, years, max_inning).withColumnRenamed("game_year", "year")
    value = "outs_above_average_per_inning"
    known = defense.withColumn(value, F.when(F.abs(value) < float("inf"), F.col(value)))
    rows = features.role_playing_sum(rows, known)
    rows = features.lagged_year_join(rows, features.dim_lookup_inner(factors, teams))
    return rows.select(*TRAINING_COLUMNS)


def design_matrix(
    training: DataFrame,
    continuous: Sequence[str] = C.CONTINUOUS_COLUMNS,
    binary: Sequence[str] = C.BINARY_COLUMNS,
    label: str = C.OUTCOME_COLUMN,
    scaler: DataFrame | None = None,
) -> DataFrame:
    """Scaled model inputs in model order plus the label, complete rows only.

    Without a given scaler it is fitted on the same rows.
    """
    complete = events.drop_nulls(training, [*continuous, *binary, label])
    fitted = model.scaler_fit(complete, continuous) if scaler is None else scaler
    scaled = model.standardize(complete, fitted, continuous, binary)
    return scaled.select(*model.scaled_names(continuous, binary), F.col(label).alias("label"))
