"""Nested game documents to flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorline.operators.serving import BATTER_ROLE, PITCHER_ROLE


def _labelled(label: str) -> Column:
    """Value of the last ``{label, value}`` pair with that label, in any case."""
    pairs = F.filter("gameBoxInfo", lambda pair: F.lower(pair["label"]) == label)
    return F.coalesce(F.try_element_at(pairs, F.lit(-1))["value"])


def flatten_boxscore(boxscores: DataFrame) -> DataFrame:
    """One flat row per box score; absent runs are 0 and absent names ``Unknown``."""

    def runs(side: str) -> Column:
        return F.coalesce(F.col(f"{side}.teamStats.batting.runs"), F.lit(0).cast("bigint"))

    def name(side: str) -> Column:
        return F.coalesce(F.col(f"{side}.team.name"), F.lit("Unknown"))

    return boxscores.select(
        "game_id",
        name("away").alias("away_team"),
        F.col("away.team.id").alias("away_team_id"),
        name("home").alias("home_team"),
        F.col("home.team.id").alias("home_team_id"),
        runs("away").alias("away_runs"),
        runs("home").alias("home_runs"),
        (runs("away") + runs("home")).alias("total_runs"),
        *[_labelled(label).alias(label) for label in ("weather", "wind", "venue")],
    )


def flatten_lineup(feeds: DataFrame) -> DataFrame:
    """``(game_pk, side, role, slot, player_id)``: batting order and pitchers, slots from 0."""
    teams = "liveData.boxscore.teams"
    lists = [
        F.struct(
            F.lit(side).alias("side"), F.lit(role).alias("role"), F.col(f"{teams}.{side}.{field}").alias("ids")
        )
        for side in ("home", "away")
        for role, field in ((BATTER_ROLE, "battingOrder"), (PITCHER_ROLE, "pitchers"))
    ]
    sides = feeds.select(F.col("gamePk").alias("game_pk"), F.inline(F.array(*lists)))
    return sides.select(
        "game_pk", "side", "role", F.posexplode("ids").alias("slot", "player_id")
    )


def flatten_handedness(people: DataFrame) -> DataFrame:
    """``(player_id, bat_side, pitch_hand)``; an absent or empty side is R."""
    person = people.select(F.explode("people").alias("p"))
    return person.select(
        F.col("p.id").alias("player_id"),
        F.coalesce("p.batSide.code", F.lit("R")).alias("bat_side"),
        F.coalesce("p.pitchHand.code", F.lit("R")).alias("pitch_hand"),
    )
