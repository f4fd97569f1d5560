"""Classification of plate-appearance events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from priorline import constants as C


def outcome_code(event: Column) -> Column:
    """Event name to class 0-7; null and unmapped names give 99."""
    branches = reduce(
        lambda chain, item: chain.when(event.isin(item[1]), F.lit(item[0])),
        C.OUTCOME_EVENTS.items(),
        F,
    )
    return branches.otherwise(F.lit(C.UNMAPPED_OUTCOME))


def event_flags(event: Column) -> dict[str, Column]:
    """The eleven indicators. A null event gives null flags, except ``is_pa``."""
    vocabularies = {
        "is_ab": C.AT_BAT_EVENTS,
        "is_hit": C.HIT_EVENTS,
        "is_k": C.STRIKEOUT_EVENTS,
        "is_bb": C.WALK_EVENTS,
        "is_hbp": C.HIT_BY_PITCH_EVENTS,
        "is_1b": ["single"],
        "is_2b": ["double"],
        "is_3b": ["triple"],
        "is_hr": ["home_run"],
        "is_out": C.OUT_EVENTS,
    }
    flags = {"is_pa": event.isNotNull()}
    flags.update({name: event.isin(words) for name, words in vocabularies.items()})
    return flags


def platoon_flag(stand: Column, throws: Column) -> Column:
    """1 when batter side and pitcher hand are opposite, else 0 (switch hitters and nulls too)."""
    opposite = ((stand == "L") & (throws == "R")) | ((stand == "R") & (throws == "L"))
    return F.when(opposite, F.lit(1)).otherwise(F.lit(0))


def home_batter_flag(half: Column) -> Column:
    """1 in the bottom half of an inning, else 0, as a byte."""
    return F.when(half == "Bot", F.lit(1)).otherwise(F.lit(0)).cast("byte")
