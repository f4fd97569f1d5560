import datetime

import pytest
from helpers import rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from priorline import constants as C
from priorline import schemas
from priorline.functions.outcomes import outcome_code
from priorline.operators import events, features, sets, totals


def pitches(spark, values):
    """Pitch rows from partial dicts."""
    day = datetime.date(2023, 5, 1)
    base = {c: None for c in C.PITCH_COLUMNS} | {"game_date": day, "game_year": 2023, "inning": 1}
    data = [tuple({**base, **v}[c] for c in C.PITCH_COLUMNS) for v in values]
    return spark.createDataFrame(data, schemas.PITCH)


def test_contract_needs_every_column(spark):
    with pytest.raises(AnalysisException):
        events.project_contract(spark.range(1)).schema  # noqa: B018


def test_last_pitch_keeps_nulls_and_ranks_null_numbers_lowest(spark):
    df = pitches(spark, [
        {"game_pk": 1, "at_bat_number": 1, "pitch_number": 1, "events": "single"},
        {"game_pk": 1, "at_bat_number": 1, "pitch_number": 2, "events": None},
        {"game_pk": 1, "at_bat_number": 2, "pitch_number": None, "events": "walk"},
        {"game_pk": 1, "at_bat_number": 2, "pitch_number": 1, "events": "double"},
        {"game_pk": 1, "at_bat_number": 3, "pitch_number": None, "events": "triple"},
    ])
    got = rows(events.last_per_group(df), "at_bat_number", "events")
    assert got == [(1, None), (2, "double"), (3, "triple")]


def test_ties_do_not_depend_on_partitioning(spark):
    df = pitches(spark, [
        {"game_pk": 1, "at_bat_number": 1, "pitch_number": 3, "batter": b, "events": e}
        for b, e in [(7, "walk"), (9, "single"), (8, "double"), (9, "triple")]
    ])
    one = rows(events.last_per_group(df.coalesce(1)))
    many = rows(events.last_per_group(df.repartition(4)))
    assert one == many
    assert one[0][3] == 9 and one[0][5] == "triple"


def test_limit_is_applied_before_the_shuffle(spark):
    df = pitches(spark, [{"game_pk": 1, "at_bat_number": 1, "pitch_number": 1}])
    plan = events.last_per_group(df)._jdf.queryExecution().executedPlan().toString()
    partial, exchange = plan.index("Partial"), plan.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in plan and partial > exchange  # plans print top-down


def test_outcome_classes(spark):
    names = [e for words in C.OUTCOME_EVENTS.values() for e in words] + ["intent_walk", "made_up", None]
    df = spark.createDataFrame([(n,) for n in names], "events string")
    got = dict(df.select("events", outcome_code(F.col("events"))).collect())
    for code, words in C.OUTCOME_EVENTS.items():
        assert all(got[w] == code for w in words)
    assert got["intent_walk"] == got["made_up"] == got[None] == C.UNMAPPED_OUTCOME
    kept = events.classify_outcome(df)
    assert kept.count() == len(names) - 3


def test_flags_of_null_and_special_events(spark):
    df = spark.createDataFrame([("field_error",), ("strikeout",), (None,), ("sac_fly",)], "events string")
    got = {r["events"]: r for r in events.event_flags(df).collect()}
    assert got["field_error"]["is_ab"] and got["field_error"]["is_out"]
    assert got["strikeout"]["is_k"] and not got["strikeout"]["is_out"]
    assert not got["sac_fly"]["is_ab"] and got["sac_fly"]["is_out"]
    assert got[None]["is_pa"] is False and got[None]["is_ab"] is None and got[None]["is_hbp"] is None


def test_context_flags(spark):
    df = spark.createDataFrame(
        [("L", "R", "Bot"), ("R", "L", "Top"), ("S", "R", None), ("L", "L", "Bot"), (None, "R", "Top")],
        "stand string, p_throws string, inning_topbot string",
    )
    got = events.home_batter_flag(events.platoon_flag(df))
    assert [r["is_platoon_adv"] for r in got.collect()] == [1, 1, 0, 0, 0]
    assert [r["is_batter_home"] for r in got.collect()] == [1, 0, 0, 1, 0]
    assert dict(got.dtypes)["is_batter_home"] == "tinyint"


def test_null_filters_keep_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "c")], "x double, y string")
    assert events.drop_nulls(df, ["x"]).count() == 2
    assert events.complete_records(df, ["x", "absent"]).count() == 2
    assert events.complete_records(df, ["absent"]).count() == 3


def daily(spark):
    data = [(1, "2023-05-01", 4), (1, "2023-05-09", 3), (1, "2023-05-10", 5), (2, "2023-05-01", 2), (3, "2023-05-09", 1)]
    df = spark.createDataFrame(data, "batter bigint, day string, daily_pa bigint")
    others = {f"daily_{n}": F.col("daily_pa") for n in totals.COUNTED_FLAGS}
    return df.withColumns(others).withColumn("game_date", F.to_date("day"))


def test_prior_totals_stay_in_the_entity_and_start_at_zero(spark):
    got = rows(totals.batter_prior_totals(daily(spark)), "batter", "day", "cum_pa_prev_day")
    assert got == [
        (1, "2023-05-01", 0), (1, "2023-05-09", 4), (1, "2023-05-10", 7), (2, "2023-05-01", 0), (3, "2023-05-09", 0),
    ]


def test_prior_totals_equal_a_self_join(spark):
    prior = totals.batter_prior_totals(daily(spark))
    a, b = prior.alias("a"), daily(spark).alias("b")
    summed = a.join(b, F.expr("a.batter = b.batter and b.game_date < a.game_date"), "left").groupBy(
        "a.batter", "a.game_date", "a.cum_hr_prev_day"
    ).agg(F.coalesce(F.sum("b.daily_hr"), F.lit(0)).alias("s"))
    assert summed.filter("cum_hr_prev_day <> s").count() == 0


def test_prior_totals_use_one_window(spark):
    plan = totals.batter_prior_totals(daily(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- Window [") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_two_positions_in_one_inning_count_once(spark):
    df = pitches(spark, [
        {"game_pk": 1, "at_bat_number": 1, "fielder_2": 50, "fielder_3": 50, "fielder_4": 60},
        {"game_pk": 1, "at_bat_number": 2, "fielder_2": 50},
        {"game_pk": 1, "at_bat_number": 3, "fielder_2": 50, "inning": 2},
    ])
    assert rows(totals.distinct_innings(df)) == [(50, 2023, 2), (60, 2023, 1)]


def test_defense_ratio_rules(spark):
    oaa = spark.createDataFrame([(1, 2021, 3), (2, 2022, 0), (3, 2021, -2)], "player_id bigint, year int, outs_above_average bigint")
    innings = spark.createDataFrame([(1, 2021, 6)], "player_id bigint, game_year int, total_innings_played bigint")
    history = totals.grid_left_innings(
        totals.grid_left_fact(totals.entity_year_grid(oaa, 2021, 2022), oaa), innings
    )
    got = {(r[0], r[1]): r for r in totals.player_prior_defense(history).collect()}
    assert got[1, 2022]["outs_above_average_per_inning"] == 0.5
    assert got[1, 2021]["outs_above_average_per_inning"] == 0.0
    assert got[3, 2022]["outs_above_average_per_inning"] == float("-inf")
    assert got[2, 2022]["cumulative_innings_prior"] == 0


def role_sums(spark, data, ratings):
    main = spark.createDataFrame(data, "k int, year int, a bigint, b bigint, c bigint")
    known = spark.createDataFrame(ratings, "player_id bigint, year int, outs_above_average_per_inning double")
    return rows(features.role_playing_sum(main, known, ["a", "b", "c"]), "k", "team_defense_oaa_input")


RATINGS = [(10, 2023, 0.5), (11, 2023, -1.0), (10, 2022, None)]


def test_role_sum(spark):
    data = [(1, 2023, 10, 10, None), (2, 2023, 11, 12, 10), (3, 2022, 10, 99, 98)]
    assert role_sums(spark, data, RATINGS) == [(1, 1.0), (2, -0.5), (3, 0.0)]


def test_role_sum_needs_no_keys(spark):
    """Null and repeated keys, equal rows and null years keep their rows and get their own sums."""
    data = [(None, 2023, 10, 11, None), (5, 2023, 10, None, None), (5, 2023, 11, None, None), (6, None, 10, 10, 10), (6, None, 10, 10, 10)]
    assert role_sums(spark, data, RATINGS) == sorted([(None, -0.5), (5, 0.5), (5, -1.0), (6, 0.0), (6, 0.0)], key=lambda r: [(v is None, str(v)) for v in r])


def test_role_sum_refuses_two_ratings(spark):
    with pytest.raises(Exception, match="more than one rating"):
        role_sums(spark, [(1, 2023, 10, None, None)], [*RATINGS, (10, 2023, 0.1)])


def test_lagged_factor_is_last_years_and_null_is_neutral(spark):
    factors = spark.createDataFrame(
        [("NYY", 2022, 104.0), ("NYY", 2022, 104.0), ("BOS", 2022, None)], "team_abbr string, year int, park_factor double"
    )
    main = spark.createDataFrame([("NYY", 2023), ("BOS", 2023), ("NYY", 2022)], "home_team string, year int")
    got = rows(features.lagged_year_join(main, factors), "home_team", "year", "park_factor_input")
    assert got == [("BOS", 2023, 100.0), ("NYY", 2022, None), ("NYY", 2023, 104.0)]


def test_unknown_entity_is_rejected(spark):
    with pytest.raises(ValueError):
        features.select_by_prefix(spark.range(1), "umpire")


def test_upsert_twice_equals_once_and_newest_wins(spark):
    schema = "game_pk bigint, at_bat_number int, hand string"
    history = spark.createDataFrame([(1, 1, "L"), (1, 2, "L")], schema)
    new = spark.createDataFrame([(1, 2, "R"), (1, 3, "R"), (1, 3, "A")], schema)
    once = sets.upsert_events(history, new)
    assert rows(once) == [(1, 1, "L"), (1, 2, "R"), (1, 3, "R")]
    assert rows(sets.upsert_events(once, new)) == rows(once)
    assert rows(sets.upsert_events(None, new)) == [(1, 2, "R"), (1, 3, "R")]
    assert rows(sets.upsert_events(history, new.limit(0))) == rows(history)
    assert rows(sets.dedupe_by_key(history, new)) == rows(once)


def test_union_widens(spark):
    narrow = spark.createDataFrame([(1, "a")], "n int, s string")
    wide = spark.createDataFrame([("b", 2**40)], "s string, n bigint")
    assert dict(sets.union_relaxed(narrow, wide).dtypes) == {"n": "bigint", "s": "string"}


def test_seasons(spark):
    df = spark.createDataFrame([("2023-04-01",), ("2023-11-02",), ("2023-12-24",)], "d string").selectExpr("cast(d as date) as game_date")
    from priorline.sources.dims import seasons

    got = events.season_of_date(df, seasons(spark, [(2023, "2023-03-30", "2023-11-02")]))
    assert got.count() == 2 and got.filter("season = 2023").count() == 2
