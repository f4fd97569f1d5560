"""Shrunken rates from running totals, and projected rates from counting stats."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorline import constants as C
from priorline.functions import numbers
from priorline.operators.totals import ENTITY_SUFFIX

OUTCOME_RATES = ["k_pct", "bb_pct", "hbp_pct", "1b_pct", "2b_pct", "3b_pct", "hr_pct"]


def rate_column(entity: str, rate: str) -> str:
    """``batter_k_pct_daily_input`` / ``pitcher_k_pct_a_daily_input``."""
    return f"{entity}_{rate}{ENTITY_SUFFIX[entity]}_daily_input"


def shrunken_rates(
    totals: DataFrame,
    entity: str,
    league: Mapping[str, float] | DataFrame = C.LEAGUE_RATES,
    weights: Mapping[str, Mapping[str, float]] = C.SHRINKAGE_WEIGHTS,
) -> DataFrame:
    """Prior rates pulled towards the league: ``(count + league * w) / (trials + w)``.

    The batting average is per at-bat, every other rate per plate appearance. The weights are
    positive, so no denominator can be 0. ``non_k_out`` is what the seven outcome rates leave.
    ``league`` is a set of fixed rates, or the one-row result of ``league_rates``, which is then
    read as a scalar subquery.
    """
    suffix = ENTITY_SUFFIX[entity]
    measured = isinstance(league, DataFrame)
    source = totals
    if measured:
        row = league.select(F.struct(*[f"lg_{rate}" for rate in weights[entity]]).alias("league"))
        source = totals.withColumn("_league", row.scalar())

    def total(name: str) -> Column:
        return F.col(f"cum_{name}{suffix}_prev_day")

    rates = {}
    for rate, weight in weights[entity].items():
        count = total("h" if rate == "avg" else rate.removesuffix("_pct"))
        trials = total("ab" if rate == "avg" else "pa")
        mean = F.col("_league")[f"lg_{rate}"] if measured else F.lit(league[f"lg_{rate}"])
        pull = mean * F.lit(float(weight))
        rates[rate_column(entity, rate)] = (count + pull) / (trials + F.lit(float(weight)))
    named = [rate_column(entity, r) for r in OUTCOME_RATES]
    rest = 1 - numbers.sum_horizontal(*named)
    return (
        source.withColumns(rates)
        .withColumn(rate_column(entity, "non_k_out_pct"), rest)
        .drop("_league")
    )


def shrunken_rates_batter(totals: DataFrame, **options) -> DataFrame:
    return shrunken_rates(totals, "batter", **options)


def shrunken_rates_pitcher(totals: DataFrame, **options) -> DataFrame:
    return shrunken_rates(totals, "pitcher", **options)


def _remainder(entity: str) -> Column:
    """One minus the seven outcome rates; null if one of them is null."""
    order = ["1b_pct", "2b_pct", "3b_pct", "hr_pct", "k_pct", "bb_pct", "hbp_pct"]
    return F.lit(1.0) - reduce(add, [F.col(rate_column(entity, r)) for r in order])


_RATE_ORDER = ["1b_pct", "2b_pct", "3b_pct", "hr_pct", "k_pct", "bb_pct", "hbp_pct", "non_k_out_pct"]


def batter_projection_rates(projections: DataFrame) -> DataFrame:
    """Batter counting stats per plate appearance; walks include intentional ones.

    A zero ``PA`` gives null rates, which ``rate_offenders`` lists.
    """
    trials = F.col("PA")
    counts = {
        "1b_pct": F.col("1B"), "2b_pct": F.col("2B"), "3b_pct": F.col("3B"), "hr_pct": F.col("HR"),
        "k_pct": F.col("SO"), "bb_pct": F.col("BB") + F.col("IBB"), "hbp_pct": F.col("HBP"),
    }
    rates = {rate_column("batter", r): numbers.rate(n, trials) for r, n in counts.items()}
    return (
        projections.withColumns(rates)
        .withColumn(rate_column("batter", "non_k_out_pct"), _remainder("batter"))
        .select(
            "xMLBAMID", "PlayerName", "Team",
            *[rate_column("batter", r) for r in _RATE_ORDER],
            "PA", "AB", "H", "1B", "2B", "3B", "HR", "BB", "IBB", "SO", "HBP",
        )
    )


def optional_column(df: DataFrame, column: str, default: str, output: str) -> DataFrame:
    """``column`` with nulls replaced if the table has it, else the default everywhere."""
    value = F.coalesce(F.col(column), F.lit(default)) if column in df.columns else F.lit(default)
    return df.withColumn(output, value)


def pitcher_projection_rates(
    projections: DataFrame, league: Mapping[str, float] = C.LEAGUE_RATES, adjusted: bool = False
) -> DataFrame:
    """Pitcher counting stats per batter faced, with doubles and triples imputed.

    Plain: the league's double and triple rates. Adjusted: a share of the pitcher's own hit
    rate, scaled down for pitchers that strike out more batters than the league.
    """
    trials = F.col("TBF")
    counts = {"hr_pct": "HR", "k_pct": "SO", "bb_pct": "BB", "hbp_pct": "HBP"}
    rates = {rate_column("pitcher", r): numbers.rate(F.col(c), trials) for r, c in counts.items()}
    measured = projections.withColumns({**rates, "_hit_rate": numbers.rate(F.col("H"), trials)})

    def column(rate: str) -> Column:
        return F.col(rate_column("pitcher", rate))

    if adjusted:
        relative = numbers.clip(column("k_pct") / F.lit(league["lg_k_pct"]), 0.5, 1.5)
        doubles = F.col("_hit_rate") * league["lg_2b_rate_of_hits"] * (2.0 - relative)
        triples = F.col("_hit_rate") * league["lg_3b_rate_of_hits"] * (2.0 - relative)
    else:
        doubles, triples = F.lit(league["lg_2b_pct"]), F.lit(league["lg_3b_pct"])
    singles = F.col("_hit_rate") - column("hr_pct") - column("2b_pct") - column("3b_pct")
    return (
        measured.withColumns(
            {rate_column("pitcher", "2b_pct"): doubles, rate_column("pitcher", "3b_pct"): triples}
        )
        .withColumn(rate_column("pitcher", "1b_pct"), singles)
        .withColumn(rate_column("pitcher", "non_k_out_pct"), _remainder("pitcher"))
        .transform(optional_column, "Throws", "R", "p_throws")
        .select(
            "xMLBAMID", "PlayerName", "Team",
            *[rate_column("pitcher", r) for r in _RATE_ORDER],
            "p_throws",
            "TBF", "IP", "H", "HR", "SO", "BB", "HBP", "ERA", "WHIP",
        )
    )


def pitcher_projection_rates_adjusted(projections: DataFrame, **options) -> DataFrame:
    return pitcher_projection_rates(projections, adjusted=True, **options)


def rate_sum_check(rates: DataFrame, entity: str) -> DataFrame:
    """Add the sum of the eight rates and a warning flag for sums off 1 by more than 0.01."""
    total = reduce(add, [F.col(rate_column(entity, r)) for r in _RATE_ORDER])
    off = (F.col("total_rate_sum") < 0.99) | (F.col("total_rate_sum") > 1.01)
    return rates.withColumn("total_rate_sum", total).withColumn(
        "rate_sum_warning", F.coalesce(off, F.lit(False))
    )


def rate_offenders(checked: DataFrame, entity: str) -> DataFrame:
    """Rows a reviewer should see: a bad or missing rate sum, or a rate outside [0, 1]."""
    columns = [F.col(rate_column(entity, r)) for r in _RATE_ORDER]
    outside = reduce(lambda a, b: a | b, [(c < 0) | (c > 1) for c in columns])
    return checked.filter(
        F.col("rate_sum_warning") | F.col("total_rate_sum").isNull() | F.coalesce(outside, F.lit(False))
    )


def projection_pipeline(projections: DataFrame, entity: str, adjusted: bool = True) -> DataFrame:
    """Format, check and drop the check columns; ``adjusted`` picks the pitcher imputation."""
    if entity == "batter":
        formatted = batter_projection_rates(projections)
    elif entity == "pitcher":
        formatted = pitcher_projection_rates(projections, adjusted=adjusted)
    else:
        raise ValueError("entity must be 'batter' or 'pitcher'")
    return rate_sum_check(formatted, entity).drop("total_rate_sum", "rate_sum_warning")
