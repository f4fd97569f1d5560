import math

from helpers import rows
from pyspark.sql import functions as F

from priorline import constants as C
from priorline import schemas
from priorline.functions import numbers
from priorline.operators import rates, totals


def values(spark, expression, data, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(expression).collect()]


def test_clip_keeps_null_and_nan(spark):
    got = values(spark, numbers.clip(F.col("x"), 0.5, 1.5), [(0.1,), (9.0,), (1.0,), (None,), (float("nan"),)], "x double")
    assert got[:4] == [0.5, 1.5, 1.0, None] and math.isnan(got[4])


def test_fills_are_separate(spark):
    data, schema = [(None,), (float("nan"),), (2.0,)], "x double"
    got = values(spark, numbers.fill_null(F.col("x"), 0.0), data, schema)
    assert got[0] == 0.0 and math.isnan(got[1])
    assert values(spark, numbers.fill_nan(F.col("x")), data, schema) == [None, 0.0, 2.0]


def test_rate_of_zero_trials_is_null(spark):
    assert values(spark, numbers.rate(F.col("a"), F.col("b")), [(1, 0), (0, 0), (1, 4)], "a int, b int") == [None, None, 0.25]


def test_horizontal_sum(spark):
    assert values(spark, numbers.sum_horizontal("a", "b"), [(1.0, None), (None, None)], "a double, b double") == [1.0, 0.0]


def prior(spark, counts):
    columns = {f"cum_{n}_prev_day": counts.get(n, 0) for n in totals.COUNTED_FLAGS}
    schema = "batter bigint, game_date string, " + ", ".join(f"{c} bigint" for c in columns)
    return spark.createDataFrame([(1, "2023-05-01", *columns.values())], schema)


def test_first_day_is_the_league(spark):
    row = rates.shrunken_rates_batter(prior(spark, {})).first()
    assert math.isclose(row["batter_avg_daily_input"], C.LEAGUE_RATES["lg_avg"])
    assert math.isclose(row["batter_k_pct_daily_input"], C.LEAGUE_RATES["lg_k_pct"])
    assert all(0 < row[c] < 1 for c in C.BATTER_RATE_COLUMNS)
    assert math.isclose(sum(row[c] for c in C.BATTER_RATE_COLUMNS), 1.0)


def test_shrinkage_formula(spark):
    row = rates.shrunken_rates_batter(prior(spark, {"pa": 100, "ab": 90, "h": 30, "k": 20})).first()
    assert math.isclose(row["batter_k_pct_daily_input"], (20 + C.LEAGUE_RATES["lg_k_pct"] * 60) / 160)
    assert math.isclose(row["batter_avg_daily_input"], (30 + C.LEAGUE_RATES["lg_avg"] * 910) / 1000)


def batters(spark, *data):
    return spark.createDataFrame(list(data), schemas.BATTER_PROJECTION)


def test_batter_projection(spark):
    df = batters(
        spark,
        (1, "A", "T", 100.0, 90.0, 25.0, 15.0, 5.0, 1.0, 4.0, 8.0, 2.0, 20.0, 1.0),
        (2, "B", "T", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
        (3, "C", "T", 100.0, 90.0, 25.0, 15.0, 5.0, 1.0, 4.0, 8.0, None, 20.0, 1.0),
    )
    got = {r["xMLBAMID"]: r for r in rates.projection_pipeline(df, "batter").collect()}
    assert len(got[1]) == 22
    assert got[1]["batter_bb_pct_daily_input"] == 0.10
    assert math.isclose(got[1]["batter_non_k_out_pct_daily_input"], 0.44)
    assert got[2]["batter_k_pct_daily_input"] is None
    assert got[3]["batter_bb_pct_daily_input"] is None and got[3]["batter_non_k_out_pct_daily_input"] is None
    checked = rates.rate_sum_check(rates.batter_projection_rates(df), "batter")
    assert rows(checked, "xMLBAMID", "rate_sum_warning") == [(1, False), (2, False), (3, False)]
    assert rows(rates.rate_offenders(checked, "batter"), "xMLBAMID") == [(2,), (3,)]


def test_pitcher_projection_clips_the_strikeout_ratio(spark):
    schema = schemas.PITCHER_PROJECTION
    df = spark.createDataFrame(
        [(1, "A", "T", 100.0, 30.0, 20.0, 2.0, 90.0, 5.0, 1.0, 3.0, 1.0, None),
         (2, "B", "T", 100.0, 30.0, 20.0, 2.0, 1.0, 5.0, 1.0, 3.0, 1.0, "L")],
        schema,
    )
    got = {r["xMLBAMID"]: r for r in rates.pitcher_projection_rates_adjusted(df).collect()}
    assert math.isclose(got[1]["pitcher_2b_pct_a_daily_input"], 0.2 * 0.179 * 0.5)
    assert math.isclose(got[2]["pitcher_2b_pct_a_daily_input"], 0.2 * 0.179 * 1.5)
    assert (got[1]["p_throws"], got[2]["p_throws"]) == ("R", "L")
    plain = rates.pitcher_projection_rates(df.drop("Throws")).first()
    assert plain["p_throws"] == "R" and plain["pitcher_3b_pct_a_daily_input"] == C.LEAGUE_RATES["lg_3b_pct"]


def test_league_rates_without_rows_are_zero(spark):
    flags = ", ".join(f"{f} boolean" for f in totals.COUNTED_FLAGS.values())
    row = totals.league_rates(spark.createDataFrame([], f"game_year int, {flags}")).first()
    assert row["lg_avg"] == 0.0 and row["lg_out_pct"] == 1.0
