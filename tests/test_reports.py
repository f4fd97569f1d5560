import pytest
from helpers import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from priorline import constants as C
from priorline import schemas
from priorline.functions import odds
from priorline.operators import trials, views


def test_odds(spark):
    data = [(0.0,), (1.0,), (0.5,), (0.25,), (0.8,), (1e-12,), (-0.1,), (1.5,), (None,)]
    df = spark.createDataFrame(data, "p double")
    got = [tuple(r) for r in df.select(odds.decimal_odds(F.col("p")), odds.american_odds(F.col("p"))).collect()]
    assert [a for _, a in got] == [None, -99999, -100, 300, -400, 99999, None, None, None]
    assert [d for d, _ in got] == [None, 1.0, 2.0, 4.0, 1.25, 1e12, None, 1 / 1.5, None]


def test_american_odds_round_half_to_even(spark):
    for odds_value in (102.5, 103.5):
        p = 100.0 / (odds_value + 100.0)
        got = spark.range(1).select(odds.american_odds(F.lit(p))).first()[0]
        assert got == round((100.0 / p) - 100.0)


def test_keys_and_labels(spark):
    df = spark.createDataFrame([("inning_3",), ("4",), ("extra",), ("inning_x",), (None,)], "k string")
    assert [r[0] for r in df.select(odds.inning_number(F.col("k"))).collect()] == [3, 4, None, None, None]
    bins = spark.createDataFrame([(0,), (5,), (9,), (None,)], "v bigint").select(odds.histogram_bin(F.col("v"), 5).alias("b"))
    assert [r[0] for r in bins.select(odds.bin_label(F.col("b"), 5)).collect()] == ["0", "5+", "5+", "0"]


def simple_trials(spark):
    data = []
    for game in (1, 2):
        for trial in range(4):
            for team in ("away", "home"):
                data.append((game, trial, 1, team, trial, 6 if trial == 3 else 0, None, 1))
    data.append((3, 0, 7, "home", 1, 1, 1, 1))
    return spark.createDataFrame(data, schemas.TRIALS)


def test_report_is_zero_filled_and_sums_to_one(spark):
    report = trials.probabilities_and_odds(simple_trials(spark), 4)
    assert report.count() == 3 * 3 * 3 * 4 * 6
    sums = report.filter("game_pk < 3 and inning = 1").groupBy("game_pk", "team", "stat").agg(F.sum("probability").alias("s"))
    assert {(r["team"], r["s"]) for r in sums.collect()} == {("Away", 1.0), ("Home", 1.0), ("Total", 2.0)}
    empty = report.filter("inning > 1 or game_pk = 3")
    assert empty.agg(F.sum("probability")).first()[0] == 0.0
    top = report.filter("game_pk = 1 and inning = 1 and team = 'Away' and stat = 'R' and number_bin = '5+'").first()
    assert (top["probability"], top["american_odds"], top["team_name"]) == (0.25, 300, "Away Team")
    certain = report.filter("game_pk = 1 and inning = 1 and team = 'Home' and stat = 'BB' and number_bin = '0'").first()
    assert (certain["probability"], certain["american_odds"]) == (1.0, -99999)
    pooled = report.filter("game_pk = 1 and inning = 1 and team = 'Total' and stat = 'BB' and number_bin = '0'").first()
    assert (pooled["probability"], pooled["american_odds"], pooled["team_name"]) == (2.0, None, "Combined Total")


def test_report_options(spark):
    names = spark.createDataFrame([(1, "Cubs", None)], "game_pk bigint, away_name string, home_name string")
    report = trials.probabilities_and_odds(simple_trials(spark), 4, names, stats=["H"], max_bin=2, include_totals=False)
    assert report.count() == 3 * 3 * 2 * 3
    assert rows(report.filter("game_pk = 1").select("team", "team_name").distinct()) == [("Away", "Cubs"), ("Home", "Home Team")]
    assert trials.probabilities_and_odds(simple_trials(spark), 0).count() == 0
    assert trials.probabilities_and_odds(simple_trials(spark).limit(0), 10).count() == 0


def test_report_reads_the_trials_once(spark, tmp_path):
    simple_trials(spark).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    plan = trials.probabilities_and_odds(stored, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_empirical_uses_observed_trials(spark):
    got = trials.empirical_distribution(simple_trials(spark))
    row = got.filter("game_pk = 3 and stat = 'H' and number = '1'").first()
    assert (row["inning"], row["probability"]) == (7, 1.0)
    assert got.filter("game_pk = 1 and stat = 'H' and team = 'away'").count() == 6


def test_views(spark):
    report = trials.probabilities_and_odds(simple_trials(spark), 4)
    assert views.filter_results(report).count() == report.count()
    picked = views.filter_results(report, team="Home", inning=1, stat="H", min_probability=0.2)
    assert picked.count() == 8
    named = views.filter_results(report, team_names=["Away Team"])
    assert {r[0] for r in named.select("team").distinct().collect()} == {"Away", "Total"}
    assert views.odds_view(report).filter("decimal_odds <= 1 or decimal_odds >= 1000").count() == 0
    heat = views.heatmap_pivot(report)
    assert heat.count() == 3 * 3 * 3 * 4 and heat.columns[-1] == "5+"
    assert set(C.DISPLAY_NAMES.values()) <= set(views.drop_rename(report).columns)
    assert rows(views.team_name_options(report)) == [("Away Team",), ("Home Team",)]
    summary = views.summary_by_team_stat(report).filter("team = 'Total' and stat = 'BB'").first()
    assert summary["count"] == 54 and summary["max_probability"] == 2.0


def test_heatmap_rejects_duplicates(spark):
    report = trials.probabilities_and_odds(simple_trials(spark), 4)
    with pytest.raises(PySparkException, match="more than one probability"):
        views.heatmap_pivot(report, index=["inning", "team", "stat"]).collect()


def test_top_categories_ties_and_nulls(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "b", "a", "c", None, None, None]], "v string")
    assert [tuple(r) for r in views.top_categories(df, "v", 2).collect()] == [("a", 2), ("b", 2)]


def test_negative_counts_and_unreadable_innings(spark):
    with pytest.raises(Exception, match="negative"):
        spark.createDataFrame([(-1,)], "v bigint").select(odds.histogram_bin(F.col("v"), 5)).collect()
    keys = spark.createDataFrame([("inning_3",), ("4",), ("extra",), (None,)], "k string")
    assert rows(odds.inning_rejects(keys, "k")) == [("extra",)]
