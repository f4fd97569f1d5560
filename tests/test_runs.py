"""The commands end to end over landed files: catch up, fit, score the games that are due."""

import datetime
import json
import random

from helpers import rows
from pyspark.sql import functions as F
from test_events import pitches

from priorline import __main__ as cli
from priorline import constants as C
from priorline import schemas
from priorline.operators import model
from priorline.plans import jobs
from priorline.sources import dims, tables

NAMES = ["field_out", "single", "double", "triple", "home_run", "strikeout", "walk", "hit_by_pitch"]


def run(spark, *args):
    parsed = cli.parser().parse_args([str(a) for a in args])
    {"update-day": cli.update_day, "catch-up": cli.catch_up, "fit-model": cli.fit_model, "pre-game": cli.pre_game}[parsed.command](spark, parsed)


def test_catch_up_fit_and_pre_game(spark, tmp_path):
    root, landed = str(tmp_path / "root"), tmp_path / "landed"
    draw, club, abbr = random.Random(1), *dims.teams(spark).first()
    days = [datetime.date(2023, 4, d) for d in (3, 4, 6)]
    for day in days:
        pitches(spark, [
            {"game_pk": day.day, "at_bat_number": n, "pitch_number": 1, "batter": draw.randrange(1, 9), "pitcher": draw.randrange(11, 14),
             "events": draw.choice(NAMES), "game_date": day, "inning": draw.randrange(1, 4), "home_team": abbr, "fielder_2": 4,
             "inning_topbot": "Bot", "stand": "L", "p_throws": draw.choice("LR")}
            for n in range(60)
        ]).write.parquet(str(landed / str(day)))
    run(spark, "catch-up", "--root", root, "--landed", landed, "--start", "2023-04-01", "--end", "2023-04-08")
    assert tables.load_table(spark, f"{root}/pa_features").count() == 180
    assert jobs.catch_up(spark, str(landed), root, days[0], days[1]) == days[:2]  # nothing changes
    assert tables.load_table(spark, f"{root}/pa_features").count() == 180

    oaa, boxes = str(tmp_path / "oaa"), str(tmp_path / "boxes")
    spark.createDataFrame([(4, 2022, 2)], "player_id bigint, year int, outs_above_average bigint").write.parquet(oaa)
    spark.createDataFrame([(json.dumps({"game_id": 1, "gameBoxInfo": [{"label": "Wind", "value": "5 mph, Calm"}]}),)], "v string").write.text(boxes)
    run(spark, "update-day", "--root", root, "--batch", "x", "--oaa", oaa, "--last-year", 2023, "--boxscores", boxes, "--snapshot-date", "2023-04-04")
    assert tables.load_table(spark, f"{root}/games").count() == 1
    assert tables.load_snapshot(spark, f"{root}/feature_snapshots", "2023-04-04").count() == 60
    factors = spark.createDataFrame([(5, "V", 1, club, 2022, 101.0), (5, "V", 1, club, 2023, 103.0)], "venue_id int, venue_name string, main_team_id int, name_display_club string, year int, park_factor double")
    tables.save_table(factors, f"{root}/park_factors")
    run(spark, "fit-model", "--root", root, "--years", 2023, "--chains", 2, "--draws", 50)
    fitted = tables.load_table(spark, f"{root}/parameters")
    assert fitted.count() == 8 * (len(C.CONTINUOUS_COLUMNS) + len(C.BINARY_COLUMNS) + 1)
    assert tables.load_table(spark, f"{root}/scaler").count() == len(C.CONTINUOUS_COLUMNS)
    assert tables.load_table(spark, f"{root}/posterior").count() == 100 * fitted.count()
    assert model.posterior_mean(tables.load_table(spark, f"{root}/posterior")).count() == fitted.count()

    for name, ids, columns in (("batter", range(1, 9), C.BATTER_RATE_COLUMNS), ("pitcher", (11, 12), C.PITCHER_RATE_COLUMNS)):
        table = spark.createDataFrame([(i,) for i in ids], "xMLBAMID bigint").withColumns({c: F.lit(0.1) for c in columns})
        tables.save_table(table, f"{root}/{name}_projections")
    schedule, feeds, hands = (str(tmp_path / n) for n in ("schedule", "feeds", "hands"))
    spark.createDataFrame([
        (77, "2024-05-01", "2024-05-01 18:05:00", "Scheduled", 5, "H", "A"), (78, "2024-05-09", "2024-05-09 18:05:00", "Scheduled", 5, "H", "A"),
        (79, "2024-05-01", "2024-05-01 18:05:00", "Postponed", 5, "H", "A"),
    ], schemas.SCHEDULE).write.parquet(schedule)
    side = {"home": {"battingOrder": [1, 2, 3], "pitchers": [11]}, "away": {"battingOrder": [4, 5], "pitchers": [12]}}
    spark.createDataFrame([(json.dumps({"gamePk": g, "liveData": {"boxscore": {"teams": side}}}),) for g in (77, 78, 79)], "v string").write.text(feeds)
    spark.createDataFrame([(1, "L", "R")], schemas.HANDEDNESS).write.parquet(hands)
    args = ["pre-game", "--root", root, "--schedule", schedule, "--lineup", feeds, "--handedness", hands, "--within-hours", 30]
    run(spark, *args, "--now", "2024-05-01 10:00:00Z")
    scored = tables.load_table(spark, f"{root}/scored")
    assert rows(scored, "game_pk", "player_id") == [(77, p) for p in (1, 2, 3, 4, 5)]
    totals = scored.select(sum(F.col(f"p_{k}") for k in range(8)).alias("t")).collect()
    assert all(abs(r.t - 1) < 1e-9 for r in totals)
    run(spark, *args, "--now", "2025-01-01 10:00:00Z")  # nothing is due
    assert tables.load_table(spark, f"{root}/scored").count() == 5
