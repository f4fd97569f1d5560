"""Daily totals, strictly-prior running totals, and yearly defence."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorline import constants as C
from priorline.functions import numbers

# daily total -> flag it counts
COUNTED_FLAGS = {
    "pa": "is_pa", "ab": "is_ab", "h": "is_hit", "k": "is_k", "bb": "is_bb", "hbp": "is_hbp",
    "1b": "is_1b", "2b": "is_2b", "3b": "is_3b", "hr": "is_hr",
}
ENTITY_SUFFIX = {"batter": "", "pitcher": "_a"}


def entity_daily(pa: DataFrame, entity: str, day: str = "game_date") -> DataFrame:
    """Ten event counts per entity and day (partial counts are merged before the shuffle)."""
    counts = [F.count_if(flag).alias(f"daily_{name}") for name, flag in COUNTED_FLAGS.items()]
    return pa.groupBy(entity, day).agg(*counts)


def batter_daily(pa: DataFrame) -> DataFrame:
    return entity_daily(pa, "batter")


def pitcher_daily(pa: DataFrame) -> DataFrame:
    return entity_daily(pa, "pitcher")


def prior_sum(value: Column, keys: Sequence[str], order: str) -> Column:
    """Running total over the rows strictly before the current one; 0 on the first row."""
    before = (
        Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return F.coalesce(F.sum(value).over(before), F.lit(0))


def prior_names(entity: str) -> list[str]:
    """Names of an entity's running totals."""
    return [f"cum_{name}{ENTITY_SUFFIX[entity]}_prev_day" for name in COUNTED_FLAGS]


def prior_totals(daily: DataFrame, entity: str, day: str = "game_date") -> DataFrame:
    """``cum_*_prev_day`` columns: totals up to the previous day the entity appeared.

    A window partition holds one row per day of one entity, so its size is bounded by the
    calendar and not by the number of events. All ten sums share one window and one exchange.
    """
    suffix = ENTITY_SUFFIX[entity]
    totals = {
        f"cum_{name}{suffix}_prev_day": prior_sum(F.col(f"daily_{name}"), [entity], day)
        for name in COUNTED_FLAGS
    }
    return daily.withColumns(totals)


def batter_prior_totals(daily: DataFrame) -> DataFrame:
    return prior_totals(daily, "batter")


def pitcher_prior_totals(daily: DataFrame) -> DataFrame:
    return prior_totals(daily, "pitcher")


def league_rates(pa: DataFrame, years: Sequence[int] = C.LEAGUE_YEARS) -> DataFrame:
    """League rates of the baseline years as one row; 0.0 where the denominator is 0.

    ``lg_out_pct`` is one minus the on-base rates, so strikeouts count as outs in it.
    """
    sums = [F.count_if(flag).alias(name) for name, flag in COUNTED_FLAGS.items()]
    totals = pa.filter(F.col("game_year").isin(list(years))).agg(*sums)

    def share(name: str, denominator: str = "pa") -> Column:
        return F.coalesce(numbers.rate(F.col(name), F.col(denominator)), F.lit(0.0))

    rates = totals.select(
        share("h", "ab").alias("lg_avg"),
        *[share(n).alias(f"lg_{n}_pct") for n in ("k", "bb", "hbp", "1b", "2b", "3b", "hr")],
    )
    on_base = sum(F.col(f"lg_{n}_pct") for n in ("bb", "hbp", "1b", "2b", "3b", "hr"))
    return rates.withColumn("lg_out_pct", 1 - on_base)


def unpivot_ids(
    df: DataFrame,
    keys: Sequence[str] = ("game_pk", "game_year", "inning"),
    columns: Sequence[str] = tuple(C.FIELDER_COLUMNS),
) -> DataFrame:
    """Fielder columns to ``(keys, position_num_str, player_id)`` rows."""
    return df.unpivot(list(keys), list(columns), "position_num_str", "player_id")


def distinct_innings(pa: DataFrame) -> DataFrame:
    """Innings in the field per player and year; two positions in one inning count once.

    Duplicates are removed map-side first, and the distinct step spreads a hot player over
    its games before the final count.
    """
    fielded = unpivot_ids(pa).filter(F.col("player_id").isNotNull())
    once = fielded.select("game_pk", "game_year", "inning", "player_id").distinct()
    return once.groupBy("player_id", "game_year").agg(
        F.count(F.lit(1)).alias("total_innings_played")
    )


_INNINGS = 64
BITMAP_KEYS = ["player_id", "game_year", "block", "bucket"]


def innings_bitmaps(pa: DataFrame) -> DataFrame:
    """Innings in the field as bitmaps that add up: ``(player_id, game_year, block, bucket, innings)``.

    An inning of a game is one bit, whichever position it was played at, so bitmaps of loads that overlap can be merged.
    A bucket is one game, whose innings are the bits of one number: players meet few of the games, so wider bitmaps
    would be almost empty. Innings beyond 62 are in blocks of their own. A missing game or inning is one like others.
    """
    fielded = unpivot_ids(pa).filter(F.col("player_id").isNotNull())
    inning = F.coalesce("inning", F.lit(-1)) + 1
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(inning, F.lit(_INNINGS)).cast("int"))
    game = F.coalesce("game_pk", F.lit(-1)).cast("bigint")
    placed = fielded.select("player_id", "game_year", F.floor(inning / _INNINGS).alias("block"), game.alias("bucket"), bit.alias("bit"))
    return placed.groupBy(*BITMAP_KEYS).agg(F.bit_or("bit").alias("innings"))


def merged_bitmaps(*tables: DataFrame) -> DataFrame:
    """One bitmap per key from those of several loads."""
    both = reduce(DataFrame.unionByName, tables)
    return both.groupBy(*BITMAP_KEYS).agg(F.bit_or("innings").alias("innings"))


def counted_innings(bitmaps: DataFrame) -> DataFrame:
    """``distinct_innings`` from merged bitmaps; the history is not read again."""
    return bitmaps.groupBy("player_id", "game_year").agg(F.sum(F.bit_count("innings")).alias("total_innings_played"))


def entity_year_grid(
    fact: DataFrame, first_year: int = C.FIRST_YEAR, last_year: int | None = None
) -> DataFrame:
    """Every distinct player in every year of the range; without a last year up to the latest one of the facts."""
    last = fact.agg(F.max("year").cast("int").alias("last")).scalar() if last_year is None else F.lit(last_year)
    years = F.explode(F.sequence(F.lit(first_year), F.greatest(last, F.lit(first_year))))
    return fact.select("player_id").distinct().withColumn("year", years)


def grid_left_fact(grid: DataFrame, fact: DataFrame, value: str = "outs_above_average") -> DataFrame:
    """Yearly value on the grid, 0 where there is none."""
    rows = grid.join(fact.select("player_id", "year", value), ["player_id", "year"], "left")
    return rows.select("player_id", "year", F.coalesce(value, F.lit(0)).alias(value))


def grid_left_innings(grid: DataFrame, innings: DataFrame) -> DataFrame:
    """Innings played on the grid, 0 where there are none (``game_year`` is the year there)."""
    value = "total_innings_played"
    right = innings.select("player_id", F.col("game_year").alias("year"), value)
    rows = grid.join(right, ["player_id", "year"], "left")
    return rows.withColumn(value, F.coalesce(value, F.lit(0)))


def player_prior_defense(history: DataFrame) -> DataFrame:
    """Prior-years running rating and innings per player, and their ratio.

    0/0 gives 0.0; a rating without innings gives an infinity, as float division does.
    Partitions hold one row per year of one player.
    """
    sums = {
        "cumulative_oaa_prior": prior_sum(F.col("outs_above_average"), ["player_id"], "year"),
        "cumulative_innings_prior": prior_sum(F.col("total_innings_played"), ["player_id"], "year"),
    }
    ratio = numbers.signed_ratio(F.col("cumulative_oaa_prior"), F.col("cumulative_innings_prior"))
    return history.withColumns(sums).withColumn("outs_above_average_per_inning", ratio)


def lag_fill(
    df: DataFrame, value: str, keys: Sequence[str], order: str, output: str | None = None
) -> DataFrame:
    """Value of the previous row in the partition; 0 for the first row and for a null there."""
    previous = F.lag(value, 1).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn(output or f"{value}_lag", F.coalesce(previous, F.lit(0)))


FACTOR_FIELDS = ["venue_id", "venue_name", "main_team_id", "name_display_club"]


def map_to_long_factors(rows: DataFrame, fields: str = "fields", prefix: str = "metric_value_") -> DataFrame:
    """One row per venue and year from a map of text fields, whatever years it has; other fields are ignored."""
    of = lambda name: F.try_element_at(fields, F.lit(name))
    years = F.map_filter(fields, lambda key, _: F.startswith(key, F.lit(prefix)))
    plain = rows.select(
        of("venue_id").try_cast("int").alias("venue_id"), of("venue_name").alias("venue_name"),
        of("main_team_id").try_cast("int").alias("main_team_id"), of("name_display_club").alias("name_display_club"),
        F.explode(years).alias("key", "factor"),
    )
    year = F.substr("key", F.lit(len(prefix) + 1)).try_cast("int")
    return plain.select(*FACTOR_FIELDS, year.alias("year"), F.col("factor").try_cast("double").alias("park_factor"))


def wide_to_long_factors(wide: DataFrame, prefix: str = "metric_value_") -> DataFrame:
    """One row per venue and year from ``metric_value_YYYY`` columns; null factors keep a row."""
    keys = FACTOR_FIELDS
    measures = sorted(c for c in wide.columns if c.startswith(prefix))
    same_type = wide.select(*keys, *[F.col(c).cast("double").alias(c) for c in measures])
    return same_type.unpivot(keys, measures, "year", "park_factor").select(
        F.col("venue_id").cast("int").alias("venue_id"),
        *keys[1:],
        F.replace(F.col("year"), F.lit(prefix), F.lit("")).cast("int").alias("year"),
        "park_factor",
    )
