import datetime

import pytest
from helpers import rows
from pyspark.sql import functions as F

from priorline import __main__ as cli
from priorline import constants as C
from priorline import schemas, session
from priorline.operators import games
from priorline.plans import jobs
from priorline.operators import totals
from priorline.sources import dims, files, nested, tables, upsert
from test_events import pitches

WEATHER = {
    "68 degrees, Roof Closed.": (68.0, "Roof Closed", True, True),
    "82 degrees, Partly Cloudy.": (82.0, "Partly Cloudy", False, None),
    "-4 degrees, Snow": (4.0, "Snow", False, None),
    "Sunny": (None, None, False, None),
    " degrees, Clear": (None, None, None, None),
    "": (None, None, None, None),
    None: (None, None, None, None),
    # the unit is found in any case, but only lower-case text splits the number off
    "70 Degrees, Roof Open..": (None, "Roof Open", True, False),
    "warm degrees,\tHazy ": (None, "Hazy", False, None),
}
WIND = {
    "0 mph, None.": (0.0, "None", False),
    "7 mph, In From CF.": (7.0, "In From CF", True),
    "12 mph, Out To Left Center.": (12.0, "Out To CF", True),
    "5 mph, L To R.": (5.0, "L To R", True),
    "5 mph, right to left": (5.0, "R To L", True),
    "9 mph, Varies.": (9.0, "Varies", True),
    "9 mph": (9.0, None, False),
    "1.2.3 mph, Out To RF": (None, None, None),
    " mph, Out To RF": (None, None, None),
    "Calm": (None, None, False),
    "": (None, None, None),
    None: (None, None, None),
}


def test_weather_text(spark):
    df = spark.createDataFrame([(w,) for w in WEATHER], "weather string")
    for r in games.parse_weather(df).collect():
        assert tuple(r)[1:] == WEATHER[r["weather"]], r["weather"]


def test_wind_text(spark):
    df = spark.createDataFrame([(w,) for w in WIND], "wind string")
    for r in games.parse_wind(df).collect():
        assert tuple(r)[1:] == WIND[r["wind"]], r["wind"]


def test_box_scores(spark):
    data = [
        '{"game_id": 1, "away": {"team": {"name": "A", "id": 3}}, "home": {"teamStats": {"batting": {"runs": 4}}, "team": {}},'
        ' "gameBoxInfo": [{"label": "Venue", "value": "X"}, {"label": "venue", "value": "Chase Field"}, {"label": "Wind"}]}',
        '{"game_id": 2, "gameBoxInfo": []}',
    ]
    boxes = spark.createDataFrame([(d,) for d in data], "j string").select(F.from_json("j", schemas.BOXSCORE).alias("b")).select("b.*")
    flat = {r["game_id"]: r for r in nested.flatten_boxscore(boxes).collect()}
    assert (flat[1]["away_team"], flat[1]["home_team"], flat[1]["total_runs"], flat[1]["venue"]) == ("A", "Unknown", 4, "Chase Field")
    assert flat[2]["venue"] is None and flat[2]["total_runs"] == 0
    table = games.enrich_games(nested.flatten_boxscore(boxes))
    assert table.columns == games.GAME_COLUMNS
    assert rows(table, "game_id", "is_domed_stadium") == [(1, True), (2, False)]
    summary = games.game_summary(table).first()
    assert (summary["total_games"], summary["unique_venues"], summary["domed_games"]) == (2, 2, 1)


def test_lineups_and_hands(spark):
    feed = '{"gamePk": 9, "liveData": {"boxscore": {"teams": {"home": {"battingOrder": [5, 6], "pitchers": [7]}, "away": {"battingOrder": [], "pitchers": [8]}}}}}'
    feeds = spark.createDataFrame([(feed,)], "j string").select(F.from_json("j", schemas.GAME_FEED).alias("f")).select("f.*")
    assert rows(nested.flatten_lineup(feeds)) == [(9, "away", "P", 0, 8), (9, "home", "B", 0, 5), (9, "home", "B", 1, 6), (9, "home", "P", 0, 7)]
    people = '{"people": [{"id": 1, "batSide": {"code": "S"}, "pitchHand": {}}, {"id": 2}]}'
    df = spark.createDataFrame([(people,)], "j string").select(F.from_json("j", schemas.PEOPLE).alias("p")).select("p.*")
    assert rows(nested.flatten_handedness(df)) == [(1, "S", "R"), (2, "R", "R")]


def test_embedded_json(spark):
    pages = [
        '<script>var data = [{"id": 1, "v": "a;b"}, {"id": 2}]; x = 1;</script>',
        "no marker;", 'data = [{"id": 3}]\n;', 'data = [{"id": 4}];',
    ]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    assert rows(files.extract_embedded_json(df.filter("html not like '%x = 1%'"), "id int, v string")) == [(4, None)]
    assert files.extract_embedded_json(df.limit(1), "id int, v string").count() in (0, 2)


def test_json_array_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1},\n {"id": 2, "name": "x"}]')
    assert rows(files.read_json_rows(spark, str(tmp_path), "id int, name string")) == [(1, None), (2, "x")]


def test_game_log_layout(spark, tmp_path):
    assert len(schemas.GAME_LOG_COLUMNS) == len(set(schemas.GAME_LOG_COLUMNS)) == 161
    assert schemas.GAME_LOG_COLUMNS.index("visiting_3_id") == schemas.GAME_LOG_COLUMNS.index("visiting_2_pos") + 1
    (tmp_path / "log.txt").write_text("\n".join(",".join([f'"{20210401 + i}"', "0", "Thu", "BAL"] + [""] * 157) for i in range(2)))
    got = files.read_game_log_csv(spark, str(tmp_path / "log.txt"))
    assert rows(got, "date", "visiting_team") == [(20210401, "BAL"), (20210402, "BAL")]


def test_load_and_save(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.load_table(spark, path) is None
    tables.save_table(spark.range(3), path)
    tables.save_table(spark.range(2), path)
    assert tables.load_table(spark, path).count() == 2
    assert tables.load_snapshot(spark, path, "2024-01-01") is None
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    tables.save_table(spark.range(2).selectExpr("cast(id as int) as id"), a)
    tables.save_table(spark.range(2), b)
    assert tables.load_many(spark, [a, b], "id bigint").count() == 4
    assert dict(tables.load_many(spark, [a, b]).dtypes) == {"id": "bigint"}


def test_result_files_of_a_day(spark, tmp_path):
    day = tmp_path / "2024-05-01"
    for game in (11, 12):
        folder = tmp_path / f"w{game}"
        spark.range(1).coalesce(1).write.parquet(str(folder))
        day.mkdir(exist_ok=True)
        part = next(folder.glob("part-*.parquet"))
        (day / f"{game}_sim_probs.parquet").write_bytes(part.read_bytes())
    (day / "notes.txt").write_text("x")
    assert rows(tables.load_result_files(spark, str(day)), "game_pk") == [(11,), (12,)]
    assert tables.load_result_files(spark, str(tmp_path / "2024-05-02")) is None


def test_results_replace_only_their_partitions(spark, tmp_path):
    path = str(tmp_path / "r")
    schema = "game_date date, game_pk int, v int"
    day = datetime.date(2024, 5, 1)
    tables.save_results(spark.createDataFrame([(day, 1, 1), (day, 2, 1)], schema), path)
    tables.save_results(spark.createDataFrame([(day, 2, 9)], schema), path)
    assert rows(tables.load_partition(spark, path, "2024-05-01"), "game_pk", "v") == [(1, 1), (2, 9)]


def test_empty_source_is_an_error(spark):
    with pytest.raises(Exception, match="no data"):  # a failing subquery surfaces as a JVM error
        tables.require_rows(spark.range(0), "no data").collect()
    assert tables.require_rows(spark.range(2), "no data").count() == 2
    assert tables.empty_with_schema(spark, schemas.HANDEDNESS).count() == 0


def test_upsert_moves_replays_and_clears(spark, tmp_path):
    path = str(tmp_path / "pa")
    schema = "game_pk bigint, at_bat_number int, v string, game_date date"
    d1, d2, d3 = (datetime.date(2024, 5, d) for d in (1, 2, 3))

    def load(batch, *data):
        upsert.upsert_partitions(spark, path, spark.createDataFrame(list(data), schema), batch)

    load("a", (1, 1, "x", d1), (1, 2, "x", d1), (2, 1, "x", d2))
    load("b", (1, 2, "y", d1), (3, 1, "y", d3))
    expected = [(1, 1, "x", d1), (1, 2, "y", d1), (2, 1, "x", d2), (3, 1, "y", d3)]
    columns = ["game_pk", "at_bat_number", "v", "game_date"]
    assert rows(tables.load_table(spark, path), *columns) == expected
    load("b", (1, 2, "y", d1), (3, 1, "y", d3))
    assert rows(tables.load_table(spark, path), *columns) == expected
    load("c", (2, 1, "z", d3))  # the only row of the second day moves to the third
    spark.catalog.clearCache()
    got = rows(tables.load_table(spark, path), *columns)
    assert got == [(1, 1, "x", d1), (1, 2, "y", d1), (2, 1, "z", d3), (3, 1, "y", d3)]


SCHEMA = "game_pk bigint, at_bat_number int, v string, game_date date"
COLUMNS = ["game_pk", "at_bat_number", "v", "game_date"]
DAY = datetime.date(2024, 5, 1)


def loader(spark, path):
    def load(batch, *data):
        upsert.upsert_partitions(spark, path, spark.createDataFrame(list(data), SCHEMA), batch)
        spark.catalog.clearCache()
        return rows(tables.load_table(spark, path), *COLUMNS)

    return load


def test_an_old_load_replayed_changes_nothing(spark, tmp_path):
    load = loader(spark, str(tmp_path / "pa"))
    load("a", (1, 1, "old", DAY))
    expected = load("b", (1, 1, "corrected", DAY), (2, 1, "x", DAY))
    assert load("a", (1, 1, "old", DAY)) == expected == [(1, 1, "corrected", DAY), (2, 1, "x", DAY)]


def test_a_name_with_other_content_is_a_new_load(spark, tmp_path):
    load = loader(spark, str(tmp_path / "pa"))
    load("a", (1, 1, "x", DAY))
    assert load("a", (1, 1, "y", DAY), (2, 1, "z", DAY)) == [(1, 1, "y", DAY), (2, 1, "z", DAY)]


def test_null_partitions_keep_their_history(spark, tmp_path):
    load = loader(spark, str(tmp_path / "pa"))
    load("a", (1, 1, "x", None))
    assert load("b", (2, 1, "y", None)) == [(1, 1, "x", None), (2, 1, "y", None)]
    got = load("c", (1, 1, "x", DAY), (2, 1, "z", DAY))
    assert got == [(1, 1, "x", DAY), (2, 1, "z", DAY)]


def test_a_load_that_stopped_before_its_entry_is_completed_first(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "pa")
    load = loader(spark, path)
    load("a", (1, 1, "x", DAY))
    real = upsert.replace_partitions
    monkeypatch.setattr(upsert, "replace_partitions", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        load("b", (2, 1, "y", DAY))
    monkeypatch.setattr(upsert, "replace_partitions", real)
    assert load("c", (3, 1, "z", DAY)) == [(1, 1, "x", DAY), (2, 1, "y", DAY), (3, 1, "z", DAY)]


def test_a_failing_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.save_table(spark.range(3), path)
    with pytest.raises(Exception, match="no"):
        tables.save_table(spark.range(3).select(F.raise_error(F.lit("no")).alias("id")), path)
    assert tables.load_table(spark, path).count() == 3
    tables.save_table(tables.load_table(spark, path).filter("id > 0"), path)
    assert rows(tables.load_table(spark, path)) == [(1,), (2,)]


def test_one_date_bound_counts(spark):
    days = spark.createDataFrame([(datetime.date(2024, 5, d),) for d in (1, 2, 3)], "game_date date")
    assert tables.scan_by_date(days, start="2024-05-02").count() == 2
    assert tables.scan_by_date(days, end="2024-05-02").count() == 2
    assert rows(tables.scan_by_date(days)) == [(datetime.date(2024, 5, 3),)]


def test_newest_date_comes_from_footers(spark, tmp_path):
    days = [(datetime.date(2024, 5, d), d) for d in (1, 3, 2)]
    df = spark.createDataFrame(days, "game_date date, n int").repartition(3)
    plain, parted = str(tmp_path / "plain"), str(tmp_path / "parted")
    tables.save_table(df, plain)
    tables.save_table(df, parted, ["game_date"])
    text = tables._newest(spark, plain, "game_date", None)._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MAX(game_date)]" in text
    for path in (plain, parted):
        assert tables.newest_date(spark, path) == datetime.date(2024, 5, 3)
        assert rows(tables.scan_newest(spark, path), "n") == [(3,)]
    assert tables.newest_date(spark, str(tmp_path / "none")) is None and tables.scan_newest(spark, str(tmp_path / "none")) is None
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_park_factors_of_any_year(spark):
    html = 'data = [{"venue_id": 5, "name_display_club": "Cubs", "metric_value_2019": 101, "metric_value_2026": "97.5", "other": 1}];'
    found = totals.map_to_long_factors(files.extract_embedded_maps(spark.createDataFrame([(html,), ("none",)], "html string")))
    assert rows(found, "venue_id", "name_display_club", "year", "park_factor") == [(5, "Cubs", 2019, 101.0), (5, "Cubs", 2026, 97.5)]


def test_scratch_root_is_the_configured_folder(spark):
    assert session.scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_daily_run_and_report(spark, tmp_path):
    root, landed = str(tmp_path / "root"), str(tmp_path / "landed")
    pitches(spark, [
        {"game_pk": g, "at_bat_number": n, "pitch_number": 1, "batter": n, "pitcher": 9, "events": e, "fielder_2": 4,
         "game_date": datetime.date(2023, 5, g)}
        for g in (1, 2) for n, e in ((1, "single"), (2, "strikeout"), (3, "intent_walk"))
    ]).write.parquet(landed)
    oaa = str(tmp_path / "oaa")
    spark.createDataFrame([(4, 2023, 2)], "player_id bigint, year int, outs_above_average bigint").write.parquet(oaa)
    args = ["update-day", "--root", root, "--batch", "d1", "--pitches", landed, "--oaa", oaa, "--last-year", "2025"]
    cli.update_day(spark, cli.parser().parse_args(args))
    featured = tables.load_table(spark, f"{root}/pa_features")
    assert featured.count() == 4
    second = featured.filter("game_pk = 2 and batter = 1").first()
    expected = (1 + C.LEAGUE_RATES["lg_avg"] * 910) / 911
    assert abs(second["batter_avg_daily_input"] - expected) < 1e-12
    assert tables.load_table(spark, f"{root}/defense").count() == 5
    html = 'data = [{"venue_id": 5, "venue_name": "V", "main_team_id": 1, "name_display_club": "Cubs", "metric_value_2024": "104"}];'
    jobs.update_park_factors(spark.createDataFrame([(html,)], "html string"), root)
    assert rows(tables.load_table(spark, f"{root}/park_factors").filter("year = 2024"), "venue_id", "park_factor") == [(5, 104.0)]
    trials = spark.createDataFrame([(1, 0, 1, "home", 1, 1, 1, 1)], schemas.TRIALS)
    games_ = spark.createDataFrame([(1, "A", "B")], "game_pk bigint, away_name string, home_name string")
    jobs.report_day(trials, games_, "2023-05-01", 1, root)
    assert tables.load_partition(spark, f"{root}/results", "2023-05-01").count() == 216


def test_team_dimension(spark):
    assert dims.teams(spark).count() == 30
