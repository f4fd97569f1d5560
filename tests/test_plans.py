"""Shapes of the physical plans, and hot keys against brute force."""

import random
from collections import Counter, defaultdict

from helpers import rows
from pyspark.sql import functions as F
from test_events import pitches

from priorline import schemas
from priorline.operators import events, sets, totals, trials
from priorline.operators.features import attach_entity_stats
from priorline.plans import features
from priorline.session import configure


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored_pa(spark, tmp_path):
    path = str(tmp_path / "pa")
    df = pitches(spark, [{"game_pk": 1, "at_bat_number": 1, "pitch_number": 1, "batter": 3, "pitcher": 4, "events": "single"}])
    events.plate_appearances(df).write.parquet(path)
    return spark.read.parquet(path)


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    pa = stored_pa(spark, tmp_path)
    text = plan(events.training_filter(features.pa_features(pa), [2023]))
    fact = next(line for line in text.splitlines() if "FileScan" in line and "LessThanOrEqual(inning,3)" in line)
    assert "In(game_year, [2023])" in fact or "EqualTo(game_year,2023)" in fact
    daily = plan(totals.batter_daily(pa))
    schema = daily[daily.index("ReadSchema") :]
    assert "batter" in schema and "fielder_2" not in schema and "stand" not in schema


def test_features_have_no_cross_join_and_no_python(spark, tmp_path):
    text = plan(features.pa_features(stored_pa(spark, tmp_path)))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert operator not in text
    assert text.count("Window [") == 2


def test_an_upsert_of_rows_of_one_derivation_shuffles_them_once(spark, tmp_path):
    values = [(None if i % 10 == 0 else i, 1, i % 4, "single") for i in range(40)]
    path = str(tmp_path / "p")
    spark.createDataFrame(values, "game_pk bigint, at_bat_number int, pitch_number int, events string").write.parquet(path)
    last = events.last_per_group(spark.read.parquet(path).unionByName(spark.read.parquet(path)))
    history, new = last.filter("pitch_number < 3"), last.filter("pitch_number >= 2").withColumn("events", F.lit("walk"))
    upserted = sets.upsert_events(history, new)
    assert "isnotnull(game_pk" not in plan(upserted)  # a filter on one use of the derivation keeps its shuffle from being shared
    got = rows(upserted)
    # The null key's last row has pitch_number 2, so it is in both tables: null keys meet nothing.
    expected = [(i, 1, i % 4, "walk" if i % 4 >= 2 else "single") for i in range(40) if i % 10] + [(None, 1, 2, "single"), (None, 1, 2, "walk")]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_features_are_shuffled_as_whole_numbers(spark, tmp_path):
    """Rates are taken after the last shuffle; players without totals have none, as if the rates themselves were joined."""
    values = [{"game_pk": i, "at_bat_number": 1, "pitch_number": 1, "batter": None if i % 5 == 0 else i % 3, "pitcher": None if i % 7 == 0 else i % 4, "events": "single"} for i in range(40)]
    path = str(tmp_path / "pa")
    events.plate_appearances(pitches(spark, values)).write.parquet(path)
    pa = spark.read.parquet(path)
    found = features.pa_features(pa)
    below = [found._jdf.queryExecution().optimizedPlan()]
    joins = 0
    for node in below:
        below += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join":
            joins += 1
            assert "daily_input" not in node.output().mkString(",")
    assert joins == 2
    joined = pa
    for entity in ("batter", "pitcher"):
        joined = attach_entity_stats(joined, features.entity_features(pa, entity), entity)
    old = joined.transform(events.platoon_flag).transform(events.home_batter_flag)
    assert found.schema.names == old.schema.names and rows(found) == rows(old)
    assert found.filter("batter is null and batter_non_k_out_pct_daily_input is null").count() == 8


def test_daily_counts_are_merged_before_the_shuffle(spark, tmp_path):
    text = plan(totals.batter_daily(stored_pa(spark, tmp_path)))
    assert text.count("HashAggregate") == 2 and text.count("Exchange hashpartitioning") == 1


def test_histogram_shuffles_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, 1, 1, "home", 1, 1, 1, 1)], schemas.TRIALS).write.parquet(path)
    text = plan(trials.outcome_histogram(spark.read.parquet(path)))
    assert text.count("Exchange") == 1 and text.count("FileScan") == 1


def test_hot_keys_against_brute_force(spark):
    """A third of all rows has one key."""
    rng = random.Random(9)
    data = [
        (1 if rng.random() < 0.34 else rng.randint(2, 300), rng.randint(1, 3), rng.choice([None, *range(9)]), rng.randint(1, 9))
        for _ in range(6000)
    ]
    df = spark.createDataFrame(data, "game_pk bigint, at_bat_number int, pitch_number int, batter bigint").repartition(8)
    best = {}
    for g, a, p, b in data:
        rank = (-1 if p is None else p, b)
        best[g, a] = max(best.get((g, a), (-2, 0)), rank)
    got = rows(events.last_per_group(df))
    assert {(g, a): (-1 if p is None else p, b) for g, a, p, b in got} == best
    assert len(got) == len(best)

    upserted = sets.upsert_events(df.limit(0), df)
    assert upserted.count() == len(best)


def test_hot_game_in_reports_against_brute_force(spark):
    rng = random.Random(4)
    data = [
        (1 if rng.random() < 0.34 else rng.randint(2, 20), n, rng.randint(1, 4), rng.choice(["home", "away"]),
         rng.choice([None, *range(9)]), rng.randint(0, 3), rng.randint(0, 9), rng.randint(0, 2))
        for n in range(6000)
    ]
    df = spark.createDataFrame(data, schemas.TRIALS).repartition(8)
    counts, observed = Counter(), defaultdict(int)
    for game, _, inning, team, h, r, bb, hr in data:
        observed[game, inning, team] += 1
        for stat, v in (("H", h), ("R", r), ("BB", bb), ("HR", hr)):
            counts[game, inning, team, stat, min(v or 0, 5)] += 1
    got = trials.outcome_histogram(df, innings=None).collect()
    assert {(r["game_pk"], r["inning"], r["team"], r["stat"], r["bin"]): r["n"] for r in got} == dict(counts)
    for r in trials.empirical_distribution(df).collect():
        b = 5 if r["number"] == "5+" else int(r["number"])
        key = (r["game_pk"], r["inning"], r["team"])
        assert abs(r["probability"] - counts[(*key, r["stat"], b)] / observed[key]) < 1e-12


def test_hot_player_innings_against_brute_force(spark):
    rng = random.Random(6)
    values, expected = [], set()
    for game in range(60):
        for n in range(6):
            ids = {f"fielder_{k}": 7 if rng.random() < 0.4 else rng.choice([None, *range(20, 60)]) for k in range(2, 10)}
            inning = rng.randint(1, 3)
            values.append({"game_pk": game, "at_bat_number": n, "inning": inning, **ids})
            expected |= {(game, inning, v) for v in ids.values() if v is not None}
    brute = Counter(player for _, _, player in expected)
    got = totals.distinct_innings(pitches(spark, values).repartition(8))
    assert {r["player_id"]: r["total_innings_played"] for r in got.collect()} == dict(brute)


def test_merged_innings_equal_a_distinct_count(spark):
    rng = random.Random(7)
    values = [
        {"game_pk": rng.choice([None, *range(5), 10**9, 2**40]), "at_bat_number": n, "inning": rng.choice([None, 1, 2, 63, 64, 65, 130]),
         "game_year": rng.choice([2022, 2023, None]), **{f"fielder_{k}": rng.choice([None, 7, 8, 9]) for k in range(2, 10)}}
        for n in range(400)
    ]
    df = pitches(spark, values).repartition(6)
    loads = [totals.innings_bitmaps(df.filter(F.pmod("at_bat_number", F.lit(3)) == k)) for k in (0, 1, 2, 1)]
    merged = totals.merged_bitmaps(totals.merged_bitmaps(*loads[:2]), *loads[2:])
    columns = ["player_id", "game_year", "total_innings_played"]
    assert rows(totals.counted_innings(merged), *columns) == rows(totals.distinct_innings(df), *columns)
    assert totals.counted_innings(totals.innings_bitmaps(df.limit(0))).count() == 0


def test_a_bitmap_is_one_number(spark):
    """Each of a player's games, however far apart, costs a row of fixed small size."""
    values = [{"game_pk": 1000 * n, "inning": n % 130, "fielder_2": 7, "fielder_3": 7, "batter": 1, "pitcher": 2} for n in range(200)]
    bitmaps = totals.innings_bitmaps(pitches(spark, values))
    assert dict(bitmaps.dtypes)["innings"] == "bigint"
    seven = bitmaps.filter("player_id = 7")
    assert seven.count() == 200
    assert totals.counted_innings(seven).agg(F.sum("total_innings_played")).first()[0] == 200


def test_results_do_not_depend_on_partitioning(spark):
    rng = random.Random(8)
    names = ["single", "walk", "strikeout", "field_out", "home_run"]
    values = [
        {"game_pk": rng.randint(1, 30), "at_bat_number": rng.randint(1, 9), "pitch_number": rng.randint(1, 4),
         "batter": rng.randint(1, 5), "pitcher": rng.randint(1, 5), "events": rng.choice(names)}
        for _ in range(400)
    ]
    df = pitches(spark, values)
    columns = ["game_pk", "at_bat_number", "batter", "batter_k_pct_daily_input", "pitcher_hr_pct_a_daily_input"]
    few = features.pa_features(events.plate_appearances(df.coalesce(1))).select(*columns)
    many = features.pa_features(events.plate_appearances(df.repartition(7, F.rand(1)))).select(*columns)
    assert rows(few) == rows(many)


def test_scans_are_split_to_fit_a_sort_and_shuffles_go_after_each_query(spark):
    configure(spark)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "16MB"
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    counts = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    assert rows(counts) == rows(counts)  # a second action computes again what is gone
