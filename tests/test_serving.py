import pytest
from helpers import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from priorline import constants as C
from priorline.operators import serving

LINEUP = "game_pk bigint, side string, role string, slot int, player_id bigint"
HANDS = "player_id bigint, bat_side string, pitch_hand string"


def projections(spark, ids, columns, extra=None):
    df = spark.createDataFrame([(i,) for i in ids], "xMLBAMID bigint")
    for k, c in enumerate(columns):
        df = df.withColumn(c, F.lit(0.01 * (k + 1)) + F.col("xMLBAMID") / 1000.0)
    return df.withColumn("p_throws", F.lit(extra)) if extra else df


def lineup(spark):
    data = [(1, "home", "B", 0, 10), (1, "home", "B", 1, 99), (1, "home", "B", 2, 11), (1, "away", "B", 0, 12),
            (1, "home", "P", 0, 20), (1, "home", "P", 1, 21), (1, "away", "P", 0, 22),
            (2, "home", "B", 0, 10), (2, "away", "B", 0, 99), (2, "home", "P", 0, 20), (2, "away", "P", 0, 22),
            (3, "home", "B", 0, 10), (3, "away", "B", 0, 11), (3, "home", "P", 0, 20)]
    return spark.createDataFrame(data, LINEUP)


def test_looked_up_hand_wins_then_existing_then_right(spark):
    pitchers = spark.createDataFrame([(1, "L"), (2, "L"), (3, None), (4, "R")], "xMLBAMID bigint, p_throws string")
    hands = spark.createDataFrame([(1, "S", "R"), (4, None, "L")], HANDS)
    got = rows(serving.attach_handedness(pitchers, hands), "xMLBAMID", "stand", "p_throws")
    assert got == [(1, "S", "R"), (2, "R", "L"), (3, "R", "R"), (4, "R", "L")]


def test_missing_entities_get_defaults(spark):
    ids = spark.createDataFrame([(1,), (2,), (2,)], "player_id bigint")
    hands = spark.createDataFrame([(1, "L", "S"), (7, "L", "L")], HANDS)
    assert rows(serving.fill_missing_entities(ids, hands)) == [(1, "L", "S"), (2, "R", "R")]


def tables(spark):
    batters = projections(spark, [10, 11, 12], C.BATTER_RATE_COLUMNS)
    pitchers = projections(spark, [20, 21, 22], C.PITCHER_RATE_COLUMNS, "L")
    hands = spark.createDataFrame([(10, "L", "R"), (20, "R", "R")], HANDS)
    return serving.enhance_with_handedness(batters, pitchers, lineup(spark), hands)


def test_lineups_and_starters(spark):
    batters, pitchers = tables(spark)
    built = serving.assemble_lineup(lineup(spark), batters)
    assert rows(built, "game_pk", "side", "slot", "player_id", "stand") == [
        (1, "away", 0, 12, "R"), (1, "home", 0, 10, "L"), (1, "home", 2, 11, "R"),
        (3, "away", 0, 11, "R"), (3, "home", 0, 10, "L"),
    ]
    starters = serving.starting_pitcher(lineup(spark), pitchers)
    assert rows(starters, "game_pk", "side", "player_id", "p_throws") == [
        (1, "away", 22, "L"), (1, "home", 20, "R"), (2, "away", 22, "L"), (2, "home", 20, "R"),
    ]


def game_parts(spark):
    batters, pitchers = tables(spark)
    games = spark.createDataFrame([(1, 2024, 5), (2, 2024, 5), (3, 2024, 6)], "game_pk bigint, year int, venue_id int")
    ratings = spark.createDataFrame(
        [(10, 2024, 1.5), (11, 2024, 0.5), (12, 2024, -2.0), (10, 2023, 9.0)],
        "player_id bigint, year int, outs_above_average_per_inning double",
    )
    factors = spark.createDataFrame([(5, 2024, 104.0), (6, 2024, None)], "venue_id int, year int, park_factor double")
    return {
        "games": games,
        "batters": serving.assemble_lineup(lineup(spark), batters),
        "starters": serving.starting_pitcher(lineup(spark), pitchers),
        "defense": serving.team_defense(lineup(spark), ratings, games),
        "factors": factors,
    }


def test_team_defense_counts_matches(spark):
    got = rows(game_parts(spark)["defense"], "game_pk", "side", "team_defense_rating", "fielders_counted")
    assert got[:3] == [(1, "away", -2.0, 1), (1, "home", 2.0, 2), (2, "away", 0.0, 0)]


def test_game_inputs(spark):
    got = serving.game_inputs(**game_parts(spark)).collect()
    assert [r["game_pk"] for r in got] == [1]
    game = got[0]
    assert [b["player_id"] for b in game["home_lineup"]] == [10, 11] and game["away_pitcher"]["player_id"] == 22
    assert (game["park_factor_input"], game["home_team_defense_rating"]) == (104.0, 2.0)


def test_batters_face_the_other_side(spark):
    got = rows(serving.matchups(**game_parts(spark)), "side", "slot", "pitcher_id", "team_defense_oaa_input", "is_batter_home")
    assert got == [("away", 0, 20, 2.0, 0), ("home", 0, 22, -2.0, 1), ("home", 2, 22, -2.0, 1)]


def test_ambiguous_factor_is_an_error(spark):
    parts = game_parts(spark)
    twice = parts["factors"].union(parts["factors"])
    with pytest.raises(PySparkException, match="more than one park factor"):
        serving.factor_lookup(parts["games"], twice).collect()
    assert rows(serving.factor_lookup(parts["games"], parts["factors"]), "game_pk", "park_factor_input") == [
        (1, 104.0), (2, 104.0), (3, 100.0),
    ]


def test_upcoming_games(spark):
    data = [
        (1, "2024-05-01T18:05:00Z", "Scheduled"), (2, "2024-05-01 18:05:00", None), (3, None, "Scheduled"),
        (None, "2024-05-01T18:05:00Z", "Scheduled"), (4, "2024-05-01T18:05:00Z", "Postponed"),
        (5, "2024-05-01T18:05:00Z", "Start Time TBD"), (6, "2024-05-01T12:00:00Z", "Scheduled"),
        (7, "2024-05-01T12:55:00Z", "Scheduled"), (8, "2024-05-02T12:00:00Z", "Scheduled"),
        (9, "2024-05-01T14:05:00-04:00", "Scheduled"), (10, "2024-05-01T18:05:00Z", "Suspended: Rain"),
    ]
    schedule = spark.createDataFrame(data, "game_id bigint, game_datetime string, status string")
    now = F.lit("2024-05-01 12:00:00").cast("timestamp")
    due = serving.upcoming_games(schedule, now)
    assert sorted(r["game_id"] for r in due.collect()) == [1, 2, 7, 8, 9]
    assert sorted(r["game_id"] for r in serving.upcoming_games(schedule, now, within_hours=8).collect()) == [1, 2, 7, 9]
    local = due.filter("game_id = 1").select(F.date_format("run_at_local", "HH:mm"), "hours_until").first()
    assert tuple(local) == ("13:10", 5 + 10 / 60)
    assert len({r["run_at"] for r in due.filter("game_id in (1, 2, 9)").collect()}) == 1


def test_schedule_lookups(spark):
    schedule = spark.createDataFrame([(1, "2024-05-01"), (2, "2024-05-02"), (2, "2024-05-03")], "game_id bigint, game_date string")
    assert rows(serving.games_in_range(schedule, "2024-05-02", "2024-05-03")) == [(2,), (2,)]
    assert rows(serving.game_by_id(schedule, 2)) == [(2, "2024-05-02")]
