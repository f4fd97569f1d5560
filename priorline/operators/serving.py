"""Serving side: handedness, line-ups, starters, team defence and per-game inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priorline import constants as C
from priorline.functions import calendar
from priorline.operators.events import keep_first

BATTER_ROLE, PITCHER_ROLE = "B", "P"


def attach_handedness(
    projections: DataFrame, handedness: DataFrame, player_id: str = "xMLBAMID"
) -> DataFrame:
    """Add ``stand`` and ``p_throws``. The looked-up hand wins over one already there, then R."""
    lookup = handedness.select(
        F.col("player_id").alias(player_id),
        F.col("bat_side").alias("_stand"),
        F.col("pitch_hand").alias("_throws"),
    )

    def known(looked_up: str, existing: str):
        present = [F.col(existing)] if existing in projections.columns else []
        return F.coalesce(F.col(looked_up), *present, F.lit("R"))

    joined = projections.join(lookup, player_id, "left")
    return joined.withColumns(
        {"stand": known("_stand", "stand"), "p_throws": known("_throws", "p_throws")}
    ).drop("_stand", "_throws")


def player_ids(lineup: DataFrame) -> DataFrame:
    """Distinct ids of everybody in the line-ups."""
    return lineup.select("player_id").filter(F.col("player_id").isNotNull()).distinct()


def fill_missing_entities(ids: DataFrame, found: DataFrame) -> DataFrame:
    """One row per requested id, with R/R for the ids that were not found."""
    return ids.select("player_id").distinct().join(found, "player_id", "left").select(
        "player_id",
        F.coalesce("bat_side", F.lit("R")).alias("bat_side"),
        F.coalesce("pitch_hand", F.lit("R")).alias("pitch_hand"),
    )


def enhance_with_handedness(
    batters: DataFrame, pitchers: DataFrame, lineup: DataFrame, handedness: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Both projection tables with the known hands of the players in the line-ups.

    Unknown hands are not filled in beforehand: a hand already in the projections comes before
    the default.
    """
    hands = semi_filter(handedness, player_ids(lineup), "player_id")
    return attach_handedness(batters, hands), attach_handedness(pitchers, hands)


def semi_filter(projections: DataFrame, ids: DataFrame, player_id: str = "xMLBAMID") -> DataFrame:
    """Projections of the listed players."""
    right = ids.select(F.col("player_id").alias(player_id))
    return projections.join(right, player_id, "left_semi")


def both_sides(df: DataFrame) -> DataFrame:
    """Rows of the games that have a home and an away row; ``df`` is derived once, its games told by a window."""
    game = Window.partitionBy("game_pk")
    sides = {f"_{s}": F.max((F.col("side") == s).cast("int")).over(game) for s in ("home", "away")}
    return df.withColumns(sides).filter("_home = 1 and _away = 1").drop(*sides)


def assemble_lineup(
    lineup: DataFrame, projections: DataFrame, player_id: str = "xMLBAMID"
) -> DataFrame:
    """Batters with their eight rates and side, one row per batting slot.

    A batter without a projection is left out; a game with no batter left on a side is dropped.
    """
    rates = projections.select(
        F.col(player_id).alias("player_id"), *C.BATTER_RATE_COLUMNS, F.coalesce("stand", F.lit("R")).alias("stand")
    )
    batters = lineup.filter(F.col("role") == BATTER_ROLE).select("game_pk", "side", "slot", "player_id")
    return both_sides(batters.join(rates, "player_id", "inner"))


def starting_pitcher(
    lineup: DataFrame, projections: DataFrame, player_id: str = "xMLBAMID"
) -> DataFrame:
    """First listed pitcher of each side with his rates; both sides must have one."""
    rates = projections.select(
        F.col(player_id).alias("player_id"), *C.PITCHER_RATE_COLUMNS, F.coalesce("p_throws", F.lit("R")).alias("p_throws")
    )
    first = (F.col("role") == PITCHER_ROLE) & (F.col("slot") == 0)
    starters = lineup.filter(first).select("game_pk", "side", "player_id")
    return both_sides(starters.join(rates, "player_id", "inner"))


def team_defense(
    lineup: DataFrame,
    ratings: DataFrame,
    games: DataFrame,
    rating: str = "outs_above_average_per_inning",
    roles: Sequence[str] = (BATTER_ROLE,),
) -> DataFrame:
    """Summed rating of a side's fielders in the game's year, and how many had one.

    The fielders are the batting order by default; ids without a rating add 0.
    """
    fielders = lineup.filter(F.col("role").isin(list(roles))).join(
        games.select("game_pk", "year"), "game_pk", "inner"
    )
    scored = fielders.join(ratings.select("player_id", "year", rating), ["player_id", "year"], "left")
    return scored.groupBy("game_pk", "side").agg(
        F.coalesce(F.sum(rating), F.lit(0)).cast("double").alias("team_defense_rating"),
        F.count(rating).alias("fielders_counted"),
    )


def unique_factors(factors: DataFrame, keys: Sequence[str] = ("venue_id", "year")) -> DataFrame:
    """One factor per key. A duplicate key is an error when the plan runs, as it makes a lookup ambiguous."""
    ambiguous = F.concat(F.lit("more than one park factor for "), F.concat_ws("/", *keys))
    value = F.when(F.col("_n") > 1, F.raise_error(ambiguous).cast("double")).otherwise(F.col("park_factor"))
    counted = factors.groupBy(*keys).agg(
        F.max("park_factor").alias("park_factor"), F.count(F.lit(1)).alias("_n")
    )
    return counted.select(*keys, value.alias("park_factor"))


def factor_lookup(games: DataFrame, factors: DataFrame) -> DataFrame:
    """Park factor of the game's venue and year, neutral where there is none."""
    joined = games.join(unique_factors(factors), ["venue_id", "year"], "left")
    return joined.withColumn(
        "park_factor_input", F.coalesce("park_factor", F.lit(C.NEUTRAL_PARK_FACTOR))
    ).drop("park_factor")


def game_inputs(
    games: DataFrame, batters: DataFrame, starters: DataFrame, defense: DataFrame, factors: DataFrame
) -> DataFrame:
    """Serving table of all games at once: line-up arrays, starter structs and context.

    A side's array holds one element per distinct batting slot, that is, it rebuilds the array
    of one source line-up and cannot grow beyond it.
    """
    slot_rows = keep_first(batters, ["game_pk", "side", "slot"], [F.col("player_id")])
    slot = F.struct("slot", "player_id", "stand", *C.BATTER_RATE_COLUMNS)
    starter = F.struct("player_id", "p_throws", *C.PITCHER_RATE_COLUMNS)

    def of(side: str, value):
        return F.when(F.col("side") == side, value)

    lineups = slot_rows.groupBy("game_pk").agg(
        F.array_sort(F.collect_list(of("home", slot))).alias("home_lineup"),
        F.array_sort(F.collect_list(of("away", slot))).alias("away_lineup"),
    )
    pitchers = starters.groupBy("game_pk").agg(
        F.max(of("home", starter)).alias("home_pitcher"), F.max(of("away", starter)).alias("away_pitcher")
    )
    ratings = defense.groupBy("game_pk").agg(
        F.max(of("home", F.col("team_defense_rating"))).alias("home_team_defense_rating"),
        F.max(of("away", F.col("team_defense_rating"))).alias("away_team_defense_rating"),
    )
    return (
        factor_lookup(games, factors)
        .select("game_pk", "park_factor_input")
        .join(lineups, "game_pk", "inner")
        .join(pitchers, "game_pk", "inner")
        .join(ratings, "game_pk", "left")
        .na.fill(0.0, ["home_team_defense_rating", "away_team_defense_rating"])
    )


def matchups(
    games: DataFrame, batters: DataFrame, starters: DataFrame, defense: DataFrame, factors: DataFrame
) -> DataFrame:
    """One row per batter and game with all predictors.

    Away batters face the home starter and the home defence, and the other way round.
    """
    other_side = F.when(F.col("side") == "home", F.lit("away")).otherwise(F.lit("home"))
    opposing_starter = starters.select(
        "game_pk", other_side.alias("side"), F.col("player_id").alias("pitcher_id"), "p_throws", *C.PITCHER_RATE_COLUMNS
    )
    opposing_defense = defense.select(
        "game_pk", other_side.alias("side"), F.col("team_defense_rating").alias("team_defense_oaa_input")
    )
    context = factor_lookup(games, factors).select("game_pk", "park_factor_input")
    return (
        batters.join(opposing_starter, ["game_pk", "side"], "inner")
        .join(opposing_defense, ["game_pk", "side"], "left")
        .join(context, "game_pk", "inner")
        .withColumns(
            {
                "team_defense_oaa_input": F.coalesce("team_defense_oaa_input", F.lit(0.0)),
                "is_batter_home": F.when(F.col("side") == "home", 1).otherwise(0).cast("byte"),
            }
        )
    )


def upcoming_games(
    schedule: DataFrame, now, lead_minutes: int = C.LEAD_MINUTES, within_hours: float | None = None
) -> DataFrame:
    """Games to run: id and start known, status active, run time not before ``now``.

    ``now`` is a timestamp column or literal. With ``within_hours`` later games are left out.
    """
    status = F.lower(F.coalesce("status", F.lit("unknown")))
    planned = schedule.filter(
        F.col("game_id").isNotNull()
        & F.col("game_datetime").isNotNull()
        & ~status.rlike("|".join(C.INACTIVE_STATUSES))
    ).withColumn("run_at", calendar.run_time(calendar.instant(F.col("game_datetime")), lead_minutes))
    due = planned.withColumn("hours_until", calendar.hours_between(F.col("run_at"), now)).filter(
        F.col("run_at") >= now
    )
    if within_hours is not None:
        due = due.filter(F.col("hours_until") <= within_hours)
    return due.withColumn("run_at_local", calendar.in_zone(F.col("run_at"), C.LOCAL_ZONE))


def games_in_range(schedule: DataFrame, start, end) -> DataFrame:
    """Ids of the games in ``[start, end]``."""
    return schedule.filter(F.col("game_date").between(start, end)).select("game_id")


def game_by_id(schedule: DataFrame, game_id: int) -> DataFrame:
    """At most one schedule row of a game; the earliest entry if it is listed twice."""
    order = [c for c in ("game_date", "game_datetime", "status") if c in schedule.columns]
    return schedule.filter(F.col("game_id") == game_id).orderBy(*order).limit(1)
