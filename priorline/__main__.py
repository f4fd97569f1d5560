"""Command line of the runs.

    python -m priorline update-day --root R --batch B [--pitches P] [--oaa P] [--park-pages P]
                                   [--batter-projections P --pitcher-projections P]
                                   [--boxscores P] [--snapshot-date D]
    python -m priorline catch-up   --root R --landed F --start D --end D
    python -m priorline fit-model  --root R [--years 2023 2024] [--chains N --draws N]
    python -m priorline pre-game   --root R --schedule P --lineup P --handedness P [--now T] [--within-hours H]
    python -m priorline report-day --root R --date D --num-trials N --trials P --games P
"""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from priorline import constants as C
from priorline import schemas
from priorline.plans import jobs
from priorline.session import configure
from priorline.sources import dims, files, nested


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="priorline")
    commands = root.add_subparsers(dest="command", required=True)
    day = commands.add_parser("update-day", help="bring the stored tables up to date")
    day.add_argument("--root", required=True)
    day.add_argument("--batch", required=True, help="name of this load; the same name replays it")
    for name in ("pitches", "oaa", "park-pages", "batter-projections", "pitcher-projections", "boxscores", "snapshot-date"):
        day.add_argument(f"--{name}")
    day.add_argument("--last-year", type=int)
    catch_up = commands.add_parser("catch-up", help="load the landed days of a range")
    for name in ("root", "landed", "start", "end"):
        catch_up.add_argument(f"--{name}", required=True)
    fit = commands.add_parser("fit-model", help="fit scaler and outcome model on the stored tables and save them")
    fit.add_argument("--root", required=True)
    fit.add_argument("--years", type=int, nargs="+", default=list(C.TRAINING_YEARS))
    fit.add_argument("--chains", type=int, default=0)
    fit.add_argument("--draws", type=int, default=0)
    pre = commands.add_parser("pre-game", help="score the games that are due by the stored model")
    for name in ("root", "schedule", "lineup", "handedness"):
        pre.add_argument(f"--{name}", required=True)
    pre.add_argument("--now", help="a time with zone; the present one where it is left out")
    pre.add_argument("--within-hours", type=float)
    report = commands.add_parser("report-day", help="probabilities and odds of a day's games")
    for name in ("root", "date", "trials", "games"):
        report.add_argument(f"--{name}", required=True)
    report.add_argument("--num-trials", type=int, required=True)
    return root


def update_day(spark: SparkSession, args: argparse.Namespace) -> None:
    """Every source that is given updates its own tables; the others stay as they are."""
    if args.pitches:
        pitches = spark.read.schema(schemas.PITCH).parquet(args.pitches)
        jobs.update_plate_appearances(spark, pitches, args.root, args.batch)
        jobs.update_features(spark, args.root)
    if args.snapshot_date:
        jobs.snapshot_features(spark, args.root, args.snapshot_date)
    if args.boxscores:
        jobs.update_games(spark.read.schema(schemas.BOXSCORE).json(args.boxscores), args.root)
    if args.park_pages:
        pages = spark.read.text(args.park_pages, wholetext=True).withColumnRenamed("value", "html")
        jobs.update_park_factors(pages, args.root)
    if args.oaa:
        oaa = spark.read.schema("player_id bigint, year int, outs_above_average bigint").parquet(args.oaa)
        jobs.update_defense(spark, oaa, args.root, args.last_year)
    if args.batter_projections and args.pitcher_projections:
        jobs.update_projections(
            files.read_json_rows(spark, args.batter_projections, schemas.BATTER_PROJECTION),
            files.read_json_rows(spark, args.pitcher_projections, schemas.PITCHER_PROJECTION),
            args.root,
        )


def catch_up(spark: SparkSession, args: argparse.Namespace) -> None:
    start, end = (datetime.date.fromisoformat(d) for d in (args.start, args.end))
    jobs.catch_up(spark, args.landed, args.root, start, end)


def fit_model(spark: SparkSession, args: argparse.Namespace) -> None:
    jobs.fit_model(spark, args.root, dims.teams(spark), args.years, args.chains, args.draws)


def pre_game(spark: SparkSession, args: argparse.Namespace) -> None:
    schedule = spark.read.schema(schemas.SCHEDULE).parquet(args.schedule)
    feeds = spark.read.schema(schemas.GAME_FEED).json(args.lineup)
    hands = spark.read.schema(schemas.HANDEDNESS).parquet(args.handedness)
    now = F.lit(args.now).cast("timestamp") if args.now else F.current_timestamp()
    jobs.pre_game(spark, schedule, nested.flatten_lineup(feeds), hands, args.root, now, args.within_hours)


def report_day(spark: SparkSession, args: argparse.Namespace) -> None:
    trials = spark.read.schema(schemas.TRIALS).parquet(args.trials)
    games = spark.read.schema("game_pk bigint, away_name string, home_name string").parquet(args.games)
    jobs.report_day(trials, games, args.date, args.num_trials, args.root)


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = configure(SparkSession.builder.appName("priorline").getOrCreate())
    runs = {"update-day": update_day, "catch-up": catch_up, "fit-model": fit_model, "pre-game": pre_game, "report-day": report_day}
    runs[args.command](spark, args)


if __name__ == "__main__":
    main()
