"""Weather and wind descriptions to columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from priorline import constants as C


def strip(text: Column) -> Column:
    """Remove surrounding whitespace of every kind (``trim`` removes spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _after_comma(text: Column) -> Column:
    """Stripped text behind the first comma without trailing dots; null without a comma."""
    tail = F.substr(text, F.instr(text, ",") + 1)
    return F.when(F.contains(text, F.lit(",")), F.regexp_replace(strip(tail), r"\.+$", ""))


def _token_before(text: Column, unit: str) -> Column:
    """Last word before the unit; empty when there is none."""
    return F.regexp_extract(F.split(text, unit)[0], r"(\S+)\s*$", 1)


def _number(token: Column, keep: str) -> Column:
    digits = F.regexp_replace(token, keep, "")
    return F.when(digits != "", digits)


def tokens(text: Column, unit: str) -> dict[str, Column]:
    """Working columns shared by both parsers; each is read several times, so they are
    materialised in a projection of their own instead of being repeated per use."""
    return {
        "_text": text,
        "_unit": F.contains(F.lower(text), F.lit(unit)),
        "_token": _token_before(text, unit),
        "_tail": _after_comma(text),
    }


WORKING = ["_text", "_unit", "_token", "_tail", "_low", "_digits"]


def weather_digits() -> dict[str, Column]:
    return {"_low": F.lower(F.coalesce("_tail", F.lit(""))), "_digits": _number(F.col("_token"), r"\D")}


def weather_columns() -> dict[str, Column]:
    """``68 degrees, Roof Closed.`` to temperature, conditions, dome and roof columns.

    Empty text, or a unit with no word before it, gives four nulls.
    """
    unit, low = F.col("_unit"), F.col("_low")
    readable = (F.col("_text") != "") & ~(unit & (F.col("_token") == ""))
    closed, opened = F.contains(low, F.lit("roof closed")), F.contains(low, F.lit("roof open"))
    return {
        "temperature": F.when(readable & unit, F.col("_digits").try_cast("double")),
        "weather_conditions": F.when(readable, F.col("_tail")),
        "is_domed_stadium": F.when(readable, closed | opened),
        "roof_closed": F.when(readable & closed, F.lit(True)).when(readable & opened, F.lit(False)),
    }


def wind_digits() -> dict[str, Column]:
    return {"_low": F.lower("_tail"), "_digits": _number(F.col("_token"), r"[^0-9.]")}


def wind_columns() -> dict[str, Column]:
    """``7 mph, In From CF.`` to speed, normalised direction and effect columns.

    Empty text, a unit with no word before it, or an unreadable number gives three nulls.
    """
    unit, digits, direction = F.col("_unit"), F.col("_digits"), F.col("_tail")
    number = digits.try_cast("double")
    unreadable = unit & ((F.col("_token") == "") | (digits.isNotNull() & number.isNull()))
    readable = (F.col("_text") != "") & ~unreadable
    speed = F.when(unit, number)
    named = F.coalesce(direction, F.lit(""))
    affects = (F.coalesce(speed, F.lit(0.0)) > 0) & (named != "") & (F.coalesce("_low", F.lit("")) != "none")
    return {
        "wind_speed_mph": F.when(readable, speed),
        "wind_direction": F.when(readable, _normal_direction(direction, F.col("_low"))),
        "wind_affects_play": F.when(readable, affects),
    }


def _normal_direction(direction: Column, lowered: Column) -> Column:
    def mentions(*words: str) -> Column:
        return reduce(or_, [F.contains(lowered, F.lit(w)) for w in words])

    def field(prefix: str) -> Column:
        return (
            F.when(mentions("cf", "center"), F.lit(f"{prefix} CF"))
            .when(mentions("lf", "left"), F.lit(f"{prefix} LF"))
            .when(mentions("rf", "right"), F.lit(f"{prefix} RF"))
            .otherwise(direction)
        )

    return (
        F.when(mentions("in from"), field("In From"))
        .when(mentions("out to"), field("Out To"))
        .when(mentions("l to r", "left to right"), F.lit("L To R"))
        .when(mentions("r to l", "right to left"), F.lit("R To L"))
        .otherwise(direction)
    )


def domed_or_known(domed: Column, venue: Column) -> Column:
    """Dome flag, falling back to the list of known roofed venues and then to false."""
    return F.coalesce(domed, venue.isin(C.DOMED_VENUES), F.lit(False))
