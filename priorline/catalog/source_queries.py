"""Readers and writers. Whatever is written goes to a fresh folder below the scratch root."""

from __future__ import annotations

from pyspark.sql import functions as F

from priorline import constants as C
from priorline import schemas
from priorline.catalog.bindings import PA_SQL, Tables, quoted, with_views
from priorline.catalog.event_queries import COUNTS, daily_sql
from priorline.catalog.registry import query
from priorline.operators import totals
from priorline.session import held, scratch_path
from priorline.sources import dims, files, key_index, nested, tables, upsert


@query(
    "load_table",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
)
def _(t: Tables):
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
    assert tables.load_table(t.spark, f"{t.folder}/no_such_table.parquet") is None
    return tables.load_table(t.spark, f"{t.folder}/orders.parquet", schema)


@query(
    "load_many",
    "SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, CAST(year(o_orderdate) AS INT) AS season FROM orders",
)
def _(t: Tables):
    """Even years were stored with an int key, odd years with a bigint key."""
    orders = t.table("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("season"))
    even, odd = scratch_path(t.spark, "even"), scratch_path(t.spark, "odd")
    narrow = orders.filter(F.col("season") % 2 == 0).withColumn("o_custkey", F.col("o_custkey").cast("int"))
    tables.save_table(narrow, even)
    tables.save_table(orders.filter(F.col("season") % 2 == 1), odd)
    return tables.load_many(t.spark, [even, odd], "o_orderkey bigint, o_custkey bigint, season int")


RESULTS_SQL = """
SELECT event_id, event_type, value, CAST(ts AS DATE) AS game_date, CAST(user_id % 5 AS INT) AS game_pk FROM events
"""


def _results(t: Tables):
    return t.table("events").select(
        "event_id", "event_type", "value", F.to_date("ts").alias("game_date"),
        (F.col("user_id") % 5).cast("int").alias("game_pk"),
    )


@query("save_results", RESULTS_SQL)
def _(t: Tables):
    path = scratch_path(t.spark, "results")
    tables.save_results(_results(t), path)
    tables.save_results(_results(t).filter(F.col("game_date") > F.lit("2024-01-20").cast("date")), path)
    return tables.load_table(t.spark, path)


@query("load_partition", f"SELECT * EXCLUDE (game_date) FROM ({RESULTS_SQL}) WHERE game_date = DATE '2024-01-05'")
def _(t: Tables):
    path = scratch_path(t.spark, "results")
    tables.save_results(_results(t), path)
    return tables.load_partition(t.spark, path, "2024-01-05")


@query("save_table", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def _(t: Tables):
    path = scratch_path(t.spark, "table")
    source = t.table("customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    tables.save_table(source.limit(0), path)
    tables.save_table(source, path, ["c_mktsegment"])
    return tables.load_table(t.spark, path)


@query("daily_snapshot", with_views("pitch", pa=PA_SQL, body=daily_sql("batter")))
def _(t: Tables):
    path = scratch_path(t.spark, "snapshot")
    tables.save_snapshot(totals.batter_daily(t.pa), path, "2001-11-05")
    columns = ["batter", "game_date", *[f"daily_{n}" for n in COUNTS]]
    return tables.load_snapshot(t.spark, path, "2001-11-05").select(*columns)


@query(
    "read_gamelog_csv",
    """SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS date, CAST(o_orderkey % 3 AS INT) AS game_num,
      concat('T', o_custkey) AS visiting_team, concat('T', o_custkey + 1) AS home_team,
      CAST(o_orderkey % 11 AS INT) AS visiting_score, o_orderpriority AS visiting_3_id, o_orderstatus AS acquisition_info
      FROM orders""",
)
def _(t: Tables):
    orders = t.table("orders")
    known = {
        "date": F.date_format("o_orderdate", "yyyyMMdd"),
        "game_num": F.col("o_orderkey") % 3,
        "visiting_team": F.concat(F.lit("T"), F.col("o_custkey")),
        "home_team": F.concat(F.lit("T"), F.col("o_custkey") + 1),
        "visiting_score": F.col("o_orderkey") % 11,
        "visiting_3_id": F.col("o_orderpriority"),
        "acquisition_info": F.col("o_orderstatus"),
    }
    row = [known.get(c, F.lit(None)).cast("string").alias(c) for c in schemas.GAME_LOG_COLUMNS]
    path = scratch_path(t.spark, "gamelog")
    orders.select(*row).write.option("header", False).csv(path)
    return files.read_game_log_csv(t.spark, path).select(*known)


@query(
    "read_json_rows",
    "SELECT event_id, event_type, value, CAST(json_extract(props, '$.k') AS INT) AS k FROM events",
)
def _(t: Tables):
    path = scratch_path(t.spark, "json")
    record = F.struct(
        "event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k")
    )
    t.table("events").select(F.to_json(F.array(record))).write.text(path)
    schema = "event_id bigint, event_type string, value double, k int"
    return files.read_json_rows(t.spark, path, schema, multi_line=False)


@query(
    "extract_embedded_json",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE event_id % 5 <> 0
      UNION ALL SELECT event_id + 1, NULL FROM events WHERE event_id % 5 <> 0""",
)
def _(t: Tables):
    """Pages with a two-element array behind the marker; every fifth page has no marker."""
    key = F.get_json_object("props", "$.k")
    data = F.concat(
        F.lit('[{"event_id": '), F.col("event_id"), F.lit(', "k": '), key, F.lit('}, {"event_id": '),
        F.col("event_id") + 1, F.lit("}]"),
    )
    page = F.when(F.col("event_id") % 5 == 0, F.lit("<html>nothing; here</html>")).otherwise(
        F.concat(F.lit("<script>\nvar data = "), data, F.lit(";\nvar x = 1;</script>"))
    )
    return files.extract_embedded_json(t.table("events").select(page.alias("html")), "event_id bigint, k int")


FEED_LINES = """
SELECT game_pk, side, role, CAST(slot AS INT) AS slot, game_pk * 10 + slot + {offset} AS player_id FROM (
  SELECT o_orderkey AS game_pk, '{side}' AS side, '{role}' AS role, unnest(generate_series(0, {last})) AS slot FROM orders)
"""


@query(
    "flatten_lineup",
    " UNION ALL ".join(
        FEED_LINES.format(side=side, role=role, offset=offset, last="o_orderkey % 9" if role == "B" else "o_orderkey % 3 - 1")
        for side, role, offset in (("home", "B", 1), ("away", "B", 2), ("home", "P", 3), ("away", "P", 4))),
)
def _(t: Tables):
    """Feeds with one to nine batters and none to two pitchers per side."""

    def ids(offset: int, count):
        start = F.col("o_orderkey") * 10 + offset
        # a step of one keeps the sequence of a zero count from running backwards
        steps = F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(steps, lambda i: start + i)

    def side(batters: int, pitchers: int):
        return F.struct(
            ids(batters, F.col("o_orderkey") % 9 + 1).alias("battingOrder"),
            ids(pitchers, F.col("o_orderkey") % 3).alias("pitchers"),
        )

    teams = F.struct(side(1, 3).alias("home"), side(2, 4).alias("away"))
    live = F.struct(F.struct(teams.alias("teams")).alias("boxscore")).alias("liveData")
    feeds = t.table("orders").select(F.col("o_orderkey").alias("gamePk"), live)
    return nested.flatten_lineup(feeds)


@query(
    "flatten_handedness",
    """SELECT c_custkey AS player_id, CASE WHEN c_nationkey % 3 = 0 THEN 'L' ELSE 'R' END AS bat_side,
        CASE WHEN c_nationkey % 4 = 0 THEN 'R' WHEN c_nationkey % 4 = 1 THEN 'S' ELSE 'L' END AS pitch_hand FROM customer
      UNION ALL SELECT -1 - c_custkey, 'R', 'R' FROM customer""",
)
def _(t: Tables):
    nation = F.col("c_nationkey")
    code = "struct<code:string>"
    bat = F.when(nation % 3 == 0, F.struct(F.lit("L").alias("code")))
    hand = F.struct(F.when(nation % 4 == 1, F.lit("S")).when(nation % 4 > 1, F.lit("L")).alias("code"))
    known = F.struct(F.col("c_custkey").alias("id"), bat.cast(code).alias("batSide"), hand.cast(code).alias("pitchHand"))
    blank = F.struct(
        (-1 - F.col("c_custkey")).alias("id"), F.lit(None).cast(code).alias("batSide"), F.lit(None).cast(code).alias("pitchHand")
    )
    return nested.flatten_handedness(t.table("customer").select(F.array(known, blank).alias("people")))


@query(
    "scan_by_date",
    with_views("pitch", body="""
      SELECT game_pk, at_bat_number, batter, game_date FROM pitch WHERE game_date BETWEEN DATE '1998-04-01' AND DATE '1998-04-30'
      UNION ALL SELECT game_pk, at_bat_number, batter, game_date FROM pitch WHERE game_date = (SELECT max(game_date) FROM pitch)"""),
)
def _(t: Tables):
    pitch = t.pitch.select("game_pk", "at_bat_number", "batter", "game_date")
    month = tables.scan_by_date(pitch, "1998-04-01", "1998-04-30")
    latest = tables.require_rows(tables.scan_by_date(pitch), "no data found")
    return month.unionByName(latest)


@query(
    "scan_newest",
    with_views("pitch", body="""
      SELECT game_pk, at_bat_number, batter, game_date FROM pitch WHERE game_date = (SELECT max(game_date) FROM pitch)"""),
)
def _(t: Tables):
    """The most recent date of a stored table, found in its file footers."""
    path = scratch_path(t.spark, "pitches")
    tables.save_table(t.pitch.select("game_pk", "at_bat_number", "batter", "game_date"), path)
    return tables.scan_newest(t.spark, path)


SEASONS = [
    (1996, "1996-04-01", "1996-11-02"), (1997, "1997-04-07", "1997-11-05"),
    (1998, "1998-03-30", "1998-11-01"), (1999, "1999-03-28", "1999-11-02"),
]


@query(
    "split_by_season",
    with_views("pitch", body="SELECT game_pk, at_bat_number, batter, game_date, season FROM pitch JOIN (VALUES "
      + ", ".join(f"(CAST({y} AS INT), DATE '{a}', DATE '{b}')" for y, a, b in SEASONS)
      + ") s(season, first, last) ON game_date BETWEEN first AND last"),
)
def _(t: Tables):
    path = scratch_path(t.spark, "seasons")
    pitch = t.pitch.select("game_pk", "at_bat_number", "batter", "game_date")
    tables.split_by_season(pitch, dims.seasons(t.spark, SEASONS), path)
    return tables.load_table(t.spark, path)


@query(
    "static_dim",
    f"""SELECT team_abbr, team_name, count(*) AS n FROM lineitem JOIN (SELECT unnest([{quoted(C.TEAM_NAMES)}]) AS team_abbr,
        unnest([{quoted(C.TEAM_NAMES.values())}]) AS team_name) teams
      ON team_abbr = list_extract([{quoted(C.TEAM_NAMES)}], 1 + CAST(l_suppkey % 30 AS INT)) GROUP BY ALL""",
)
def _(t: Tables):
    """Line items per club; the supplier number picks the club."""
    clubs = F.array(*[F.lit(a) for a in C.TEAM_NAMES])
    home = t.table("lineitem").select(F.element_at(clubs, (F.col("l_suppkey") % 30 + 1).cast("int")).alias("team_abbr"))
    counted = home.groupBy("team_abbr").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(dims.teams(t.spark), "team_abbr", "inner")


@query("empty_with_schema", with_views("trials", body="SELECT game_pk, trial_id, inning, team, H, R, BB, HR FROM trials"))
def _(t: Tables):
    return tables.empty_with_schema(t.spark, schemas.TRIALS).unionByName(t.view("trials"))


@query(
    "upsert_partitions",
    with_views("pitch", pa=PA_SQL, body="""
      SELECT game_pk, at_bat_number, events, game_date,
        CASE WHEN game_date BETWEEN DATE '1999-07-01' AND DATE '1999-12-31' THEN 'S' ELSE p_throws END AS p_throws FROM pa"""),
)
def _(t: Tables):
    """History to 1999, then an overlapping correction, then the rest twice and an old load again (replays)."""
    path = scratch_path(t.spark, "pa")
    _load_in_parts(t, path)
    return tables.load_table(t.spark, path).drop("month")


def _load_in_parts(t: Tables, path: str) -> None:
    """The plate appearances are a stored table, as in the daily run; five loads would derive them from the pitches five times."""
    with held(t.pa.select("game_pk", "at_bat_number", "events", "p_throws", "game_date"), "plate_appearances") as pa:

        def between(start: str, end: str):
            return pa.filter(F.col("game_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))

        year = F.year("game_date")
        loads = {
            "a": pa.filter(year < 2000),
            "b": between("1999-07-01", "1999-12-31").withColumn("p_throws", F.lit("S")),
            "c": pa.filter(year >= 2000),
        }
        # one partition per month keeps the number of files low
        for batch in ("a", "b", "c", "c", "a"):
            rows = loads[batch].withColumn("month", F.trunc("game_date", "month"))
            upsert.upsert_partitions(t.spark, path, rows, batch, partition="month")


@query(
    "key_index",
    with_views("pitch", pa=PA_SQL, body="""
      SELECT DISTINCT game_pk AS lead_key, CAST(date_trunc('month', game_date) AS DATE) AS held_in FROM pa"""),
)
def _(t: Tables):
    """The partitions of every key, as the index of a table loaded in parts names them."""
    path = scratch_path(t.spark, "pa")
    _load_in_parts(t, path)
    like = key_index.entries(tables.load_table(t.spark, path), "game_pk", "month")
    return key_index.load_index(t.spark, path, like).select(key_index.KEY, key_index.VALUE).distinct()
