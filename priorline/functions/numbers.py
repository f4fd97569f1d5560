"""Null, NaN and zero-denominator rules shared by the operators."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def fill_null(value: Column, default) -> Column:
    """Replace null by ``default``; NaN is left alone."""
    return F.coalesce(value, F.lit(default))


def fill_nan(value: Column, default=0.0) -> Column:
    """Replace NaN by ``default``; null is left alone."""
    return F.nanvl(value, F.lit(default))


def sum_horizontal(*columns: str | Column) -> Column:
    """Row-wise sum in which null counts as zero."""
    terms = [F.col(c) if isinstance(c, str) else c for c in columns]
    return reduce(add, [F.coalesce(t, F.lit(0)) for t in terms])


def clip(value: Column, low: float, high: float) -> Column:
    """Clamp to ``[low, high]``; null stays null and NaN stays NaN.

    ``least``/``greatest`` skip nulls and order NaN last, so both need their own branch.
    """
    return F.when(value.isNull() | F.isnan(value), value).otherwise(
        F.least(F.greatest(value, F.lit(low)), F.lit(high))
    )


def rate(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` with null for a zero denominator (also under ANSI)."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def signed_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio of two non-null counts: 0/0 is 0.0 and x/0 is an infinity with the sign of x."""
    infinite = F.when(numerator > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return (
        F.when((denominator == 0) & (numerator == 0), F.lit(0.0))
        .when(denominator == 0, infinite)
        .otherwise(F.try_divide(numerator.cast("double"), denominator.cast("double")))
    )


def percentage(probability: Column) -> Column:
    """Probability as a percentage with two decimals, for display."""
    return F.round(probability * 100, 2)
