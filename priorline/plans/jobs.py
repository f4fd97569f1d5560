"""The two runs of the pipeline: the daily feature update and the pre-game report.

Every sink is its own lazy plan, so an empty source leaves the other tables untouched.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline import constants as C
from priorline import schemas
from priorline.operators import estimate, events, games, model, rates, serving, totals, trials
from priorline.plans import features, increments, scoring
from priorline.session import stored
from priorline.sources import files, nested, tables, upsert


def update_plate_appearances(spark: SparkSession, pitches: DataFrame, root: str, batch: str) -> None:
    """New pitches into the plate-appearance table."""
    upsert.upsert_partitions(spark, f"{root}/plate_appearances", events.plate_appearances(pitches), batch)


def update_features(spark: SparkSession, root: str) -> None:
    """Features of the stored plate appearances, from the first month that changed on; by season and month."""
    increments.update_features(spark, root)


def update_park_factors(pages: DataFrame, root: str) -> None:
    factors = totals.map_to_long_factors(files.extract_embedded_maps(pages))
    tables.save_table(
        tables.require_rows(factors, "no park factors on the page"),
        f"{root}/park_factors",
    )


def update_defense(
    spark: SparkSession, oaa: DataFrame, root: str, last_year: int | None = None
) -> None:
    """Defence per player and year, up to the current year where none is given; ``oaa`` holds every year."""
    last_year = last_year or datetime.date.today().year
    pa = tables.load_table(spark, f"{root}/plate_appearances")
    if pa is not None:
        tables.save_table(
            features.defense_features(oaa, pa, C.FIRST_YEAR, last_year), f"{root}/defense"
        )


def update_projections(batters: DataFrame, pitchers: DataFrame, root: str) -> None:
    tables.save_table(rates.projection_pipeline(batters, "batter"), f"{root}/batter_projections")
    tables.save_table(rates.projection_pipeline(pitchers, "pitcher"), f"{root}/pitcher_projections")


def update_games(boxscores: DataFrame, root: str) -> None:
    """The game table from nested box scores: flattened, weather and wind parsed."""
    tables.save_table(games.enrich_games(nested.flatten_boxscore(boxscores)), f"{root}/games")


def snapshot_features(spark: SparkSession, root: str, date: str) -> None:
    """A dated copy of the day's feature rows; writing a date again replaces it."""
    featured = increments.load_features(spark, root)
    if featured is not None:
        day = featured.filter(F.col("game_date") == F.lit(date).cast("date"))
        tables.save_snapshot(day, f"{root}/feature_snapshots", date)


def catch_up(spark: SparkSession, landed: str, root: str, start: datetime.date, end: datetime.date) -> list[datetime.date]:
    """Load the landed pitches of each day of a range that has any, then bring the features up to date once.

    A day's files are in ``<landed>/<date>``; days without are passed over. A day loaded before changes nothing.
    """
    loaded = []
    for number in range((end - start).days + 1):
        day = start + datetime.timedelta(number)
        pitches = tables.load_table(spark, f"{landed.rstrip('/')}/{day}", schemas.PITCH)
        if pitches is not None:
            update_plate_appearances(spark, pitches, root, str(day))
            loaded.append(day)
    update_features(spark, root)
    return loaded


def fit_model(
    spark: SparkSession,
    root: str,
    teams: DataFrame,
    years: Sequence[int] = C.TRAINING_YEARS,
    chains: int = 0,
    draws: int = 0,
    continuous: Sequence[str] = C.CONTINUOUS_COLUMNS,
    binary: Sequence[str] = C.BINARY_COLUMNS,
) -> estimate.Mode:
    """Fit the outcome model on the stored features, defence and park factors; save what scoring needs.

    ``scaler`` and ``parameters`` are saved as one version each, ``posterior`` as well where draws are asked for. The
    training rows are stored once and read by the scaler and each Newton step.
    """
    featured = increments.load_features(spark, root)
    if featured is None:
        raise ValueError(f"there are no features in {root}")
    rows = features.training_table(featured, _table(spark, root, "defense"), _table(spark, root, "park_factors"), teams, years)
    rows = stored(events.drop_nulls(rows, [*continuous, *binary, C.OUTCOME_COLUMN]), "training")
    scaler = stored(model.scaler_fit(rows, continuous), "scaler")
    matrix = stored(features.design_matrix(rows, continuous, binary, scaler=scaler), "matrix")
    mode = estimate.posterior_mode(matrix, model.scaled_names(continuous, binary), len(C.OUTCOME_LABELS))
    if not mode.rows:
        raise ValueError("there are no training rows")
    tables.save_table(scaler, f"{root}/scaler")
    tables.save_table(estimate.parameter_rows(spark, mode).coalesce(1), f"{root}/parameters")
    if chains * draws:
        tables.save_table(estimate.posterior_draws(spark, mode, chains, draws), f"{root}/posterior")
    return mode


def pre_game(
    spark: SparkSession,
    schedule: DataFrame,
    lineup: DataFrame,
    handedness: DataFrame,
    root: str,
    now,
    within_hours: float | None = None,
    lead_minutes: int = C.LEAD_MINUTES,
) -> DataFrame:
    """Score the games that are due by the stored model, and keep the scored matchups by date and game.

    ``schedule`` has the columns of ``schemas.SCHEDULE``; ``now`` is a timestamp column. Without a due game nothing is
    written. Returns what was written.
    """
    due = stored(serving.upcoming_games(schedule, now, lead_minutes, within_hours), "due-games")
    due = due.withColumnRenamed("game_id", "game_pk")
    playing = due.select("game_pk", F.year("run_at_local").alias("year"), "venue_id")
    own = lineup.join(playing.select("game_pk"), "game_pk", "left_semi")
    scored = score_day(spark, playing, own, handedness, _table(spark, root, "scaler"), _table(spark, root, "parameters"), root)
    dated = scored.join(due.select("game_pk", F.to_date("run_at_local").alias("game_date")), "game_pk")
    dated = stored(dated, "scored")
    if dated.limit(1).count():
        tables.save_results(dated, f"{root}/scored")
    return dated


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    found = tables.load_table(spark, f"{root}/{name}")
    if found is None:
        raise ValueError(f"there is no table {name} in {root}")
    return found


def score_day(
    spark: SparkSession,
    games: DataFrame,
    lineup: DataFrame,
    handedness: DataFrame,
    scaler: DataFrame,
    parameters: DataFrame,
    root: str,
) -> DataFrame:
    """Scored matchups of all of a day's games from the stored tables."""

    return scoring.score_games(
        games, lineup, _table(spark, root, "batter_projections"), _table(spark, root, "pitcher_projections"), handedness,
        _table(spark, root, "defense"), _table(spark, root, "park_factors"), scaler, parameters,
    )


def report_day(
    trial_results: DataFrame, games: DataFrame, date: str, num_trials: int, root: str
) -> None:
    """Probability and odds report of a day's games, one partition per game."""
    report = trials.probabilities_and_odds(trial_results, num_trials, games)
    tables.save_results(
        report.withColumn("game_date", F.lit(date).cast("date")), f"{root}/results"
    )
