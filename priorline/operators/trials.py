"""Histograms of trial results and their probabilities and odds.

``trials(game_pk, trial_id, inning, team, <stats>)`` holds one row per trial, inning and team.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline import constants as C
from priorline.functions import odds

SIDE = ["game_pk", "inning", "team"]


def outcome_histogram(
    trials: DataFrame,
    stats: Sequence[str] = C.REPORT_STATS,
    max_bin: int = C.REPORT_MAX_BIN,
    innings: Sequence[int] | None = C.REPORT_INNINGS,
) -> DataFrame:
    """Trials per game, inning, team, statistic and bin. An absent statistic counts as 0.

    All bins of all statistics are counted in one pass: a group is one row of counters before and
    after the only shuffle, however many trials it has. The counters are turned into rows last.
    Statistics are counts and never negative.
    """
    kept = trials.filter(F.col("team").isin(C.REPORT_TEAMS))
    if innings is not None:
        kept = kept.filter(F.col("inning").isin(list(innings)))
    binned = kept.select(*SIDE, *[odds.histogram_bin(F.col(s), max_bin).alias(s) for s in stats])
    cells = [(s, b) for s in stats for b in range(max_bin + 1)]
    wide = binned.groupBy(*SIDE).agg(*[F.count_if(F.col(s) == b).alias(f"_{s}_{b}") for s, b in cells])
    rows = [
        F.struct(F.lit(s).alias("stat"), F.lit(b).alias("bin"), F.col(f"_{s}_{b}").alias("n")) for s, b in cells
    ]
    return wide.select(*SIDE, F.inline(F.array(*rows))).filter(F.col("n") > 0)


def _report_counts(
    histogram: DataFrame, teams: Sequence[str], max_bin: int, innings: Sequence[int]
) -> DataFrame:
    """One row per game, inning, team, statistic and bin, zero-filled; ``Total`` pools both teams.

    The grid is small and known, so it is built from conditional sums in one aggregation: no
    join against a generated grid and no second pass over the trials.
    """

    def cell(inning: int, team: str, bin_value: int) -> str:
        return f"_n_{inning}_{team}_{bin_value}"

    bins = range(max_bin + 1)
    here = (F.col("inning"), F.col("team"), F.col("bin"))
    sums = [
        F.coalesce(
            F.sum(F.when((here[0] == i) & (here[1] == t) & (here[2] == b), F.col("n"))), F.lit(0)
        ).alias(cell(i, t, b))
        for i in innings
        for t in C.REPORT_TEAMS
        for b in bins
    ]
    wide = histogram.groupBy("game_pk", "stat").agg(*sums)

    def count(inning: int, team: str, bin_value: int):
        members = C.REPORT_TEAMS if team == "Total" else [team]
        return sum(F.col(cell(inning, t, bin_value)) for t in members)

    rows = [
        F.struct(
            F.lit(i).cast("long").alias("inning"), F.lit(t).alias("team"), F.lit(b).alias("bin"),
            count(i, t, b).alias("n"),
        )
        for i in innings
        for t in teams
        for b in bins
    ]
    return wide.select("game_pk", "stat", F.inline(F.array(*rows)))


def _priced(counts: DataFrame, num_trials: int, max_bin: int) -> DataFrame:
    """Counts to probabilities and odds. The divisor is the number of trials asked for."""
    probability = F.col("n").cast("double") / F.lit(float(num_trials))
    return counts.withColumn("probability", probability).select(
        "game_pk", "inning", "team", "team_name", "stat",
        odds.bin_label(F.col("bin"), max_bin).alias("number_bin"),
        "probability",
        odds.decimal_odds(F.col("probability")).alias("decimal_odds"),
        odds.american_odds(F.col("probability")).alias("american_odds"),
    )


def _named(counts: DataFrame, games: DataFrame | None) -> DataFrame:
    """Display names of the teams, from ``games(game_pk, away_name, home_name)`` if given."""
    given, rows = F.lit(None).cast("string"), counts
    if games is not None:
        rows = counts.join(games.select("game_pk", "away_name", "home_name"), "game_pk", "left")
        given = F.when(F.col("team") == "away", F.col("away_name")).when(
            F.col("team") == "home", F.col("home_name")
        )
    total = F.col("team") == "Total"
    name = F.when(total, F.lit("Combined Total")).otherwise(odds.display_name(given, F.col("team")))
    return rows.withColumn("team_name", name).withColumn("team", odds.team_label(F.col("team")))


def team_probabilities(
    histogram: DataFrame,
    num_trials: int,
    games: DataFrame | None = None,
    max_bin: int = C.REPORT_MAX_BIN,
    innings: Sequence[int] = C.REPORT_INNINGS,
) -> DataFrame:
    """Probability and odds of every bin per team, zero-filled."""
    counts = _report_counts(histogram, C.REPORT_TEAMS, max_bin, innings)
    return _priced(_named(counts, games), num_trials, max_bin)


def total_probabilities(
    histogram: DataFrame,
    num_trials: int,
    max_bin: int = C.REPORT_MAX_BIN,
    innings: Sequence[int] = C.REPORT_INNINGS,
) -> DataFrame:
    """The two teams' bin counts pooled over one trial count.

    This is not the distribution of home plus away: the bins of one statistic sum to 2, and a
    pooled value above 1 has no American odds.
    """
    counts = _report_counts(histogram, ["Total"], max_bin, innings)
    return _priced(_named(counts, None), num_trials, max_bin)


def probabilities_and_odds(
    trials: DataFrame,
    num_trials: int,
    games: DataFrame | None = None,
    stats: Sequence[str] = C.REPORT_STATS,
    max_bin: int = C.REPORT_MAX_BIN,
    include_totals: bool = True,
) -> DataFrame:
    """Team and pooled report of every game that has trials; empty without a trial count.

    A game whose trials have no reported inning is kept, with zeros.
    """
    source = trials if num_trials > 0 else trials.filter(F.lit(False))
    histogram = outcome_histogram(source, stats, max_bin, innings=None)
    teams = [*C.REPORT_TEAMS, *(["Total"] if include_totals else [])]
    counts = _report_counts(histogram, teams, max_bin, C.REPORT_INNINGS)
    return _priced(_named(counts, games), max(num_trials, 1), max_bin)


def report_order(report: DataFrame, stats: Sequence[str] = C.REPORT_STATS) -> DataFrame:
    """Presentation order: game, inning, Away/Home/Total, statistic, bin."""

    def rank(column: str, values: Sequence[str]):
        return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))

    return report.orderBy(
        "game_pk", "inning", rank("team", ["Away", "Home", "Total"]), rank("stat", stats), "number_bin"
    )


def empirical_distribution(
    trials: DataFrame, stats: Sequence[str] = C.REPORT_STATS, max_bin: int = C.REPORT_MAX_BIN
) -> DataFrame:
    """Bin shares among the trials observed for an inning and team, zero-filled; any inning."""
    histogram = outcome_histogram(trials, stats, max_bin, innings=None)
    bins = range(max_bin + 1)
    per_bin = [
        F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("n"))), F.lit(0)).alias(f"_n_{b}") for b in bins
    ]
    wide = histogram.groupBy(*SIDE, "stat").agg(*per_bin, F.sum("n").alias("_total"))
    rows = [
        F.struct(
            odds.bin_label(F.lit(b), max_bin).alias("number"),
            F.try_divide(F.col(f"_n_{b}").cast("double"), F.col("_total")).alias("probability"),
        )
        for b in bins
    ]
    return wide.select(*SIDE, "stat", F.inline(F.array(*rows)))
