"""Views that give the given tables the shape the operators expect.

Each view is one SQL text that Spark and DuckDB both run; ``{name}`` stands for a given table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from priorline import constants as C
from priorline.session import configure

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

FIRST_YEAR, LAST_YEAR = 1995, 2001
LEAGUE_YEARS = [1996, 1997]
TRAINING_YEARS = [1998, 1999]
NUM_TRIALS = 1000

_fielders = ",\n  ".join(
    (
        f"CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_suppkey + {k} * (l_partkey % 7) END AS fielder_{k}"
        if k == 2
        else f"l_suppkey + {k} * (l_partkey % 7) AS fielder_{k}"
    )
    for k in range(2, 10)
)
PITCH = f"""
SELECT l_orderkey AS game_pk, l_linenumber AS at_bat_number,
  CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE CAST(1 + l_suppkey % 6 AS INT) END AS pitch_number,
  l_partkey AS batter, l_suppkey AS pitcher,
  CASE CAST(l_quantity AS INT) % 16 WHEN 0 THEN 'single' WHEN 1 THEN 'double' WHEN 2 THEN 'triple'
    WHEN 3 THEN 'home_run' WHEN 4 THEN 'strikeout' WHEN 5 THEN 'strikeout_double_play' WHEN 6 THEN 'walk'
    WHEN 7 THEN 'catcher_interf' WHEN 8 THEN 'hit_by_pitch' WHEN 9 THEN 'field_out' WHEN 10 THEN 'force_out'
    WHEN 11 THEN 'sac_fly' WHEN 12 THEN 'field_error' WHEN 13 THEN 'fielders_choice'
    WHEN 14 THEN 'intent_walk' ELSE NULL END AS events,
  CASE l_returnflag WHEN 'R' THEN 'L' WHEN 'A' THEN 'R' ELSE 'S' END AS stand,
  CASE WHEN l_suppkey % 2 = 0 THEN 'L' ELSE 'R' END AS p_throws,
  CASE WHEN l_linestatus = 'O' THEN 'Bot' ELSE 'Top' END AS inning_topbot,
  concat('T', CAST(l_suppkey AS VARCHAR(20))) AS home_team,
  concat('T', CAST(l_suppkey + 1 AS VARCHAR(20))) AS away_team,
  CAST(l_shipdate AS DATE) AS game_date, 'R' AS game_type, CAST(NULL AS VARCHAR(9)) AS bb_type,
  l_linenumber % 4 AS balls, l_linenumber % 3 AS strikes, CAST(l_quantity AS INT) % 3 AS outs_when_up,
  CAST(1 + l_partkey % 9 AS INT) AS inning, CAST(year(l_shipdate) AS INT) AS game_year,
  {_fielders}
FROM {{lineitem}}
"""
TRIALS = """
SELECT l_suppkey AS game_pk, l_partkey AS trial_id, CAST(1 + l_partkey % 4 AS INT) AS inning,
  CASE WHEN l_linestatus = 'O' THEN 'home' ELSE 'away' END AS team,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity AS INT) % 7 END AS H,
  l_linenumber AS R, CAST(l_partkey % 4 AS INT) AS BB, CAST(l_suppkey % 3 AS INT) AS HR
FROM {lineitem}
"""
GAMES = """
SELECT o_orderkey AS game_pk, CAST(year(o_orderdate) AS INT) AS year, CAST(o_custkey AS INT) AS venue_id,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE concat('Club ', CAST(o_custkey AS VARCHAR(20))) END AS away_name,
  CASE WHEN o_orderstatus = 'F' THEN NULL ELSE concat('Club ', CAST(o_custkey + 1 AS VARCHAR(20))) END AS home_name
FROM {orders}
"""
LINEUP = """
SELECT l_orderkey AS game_pk, CASE WHEN l_suppkey % 2 = 0 THEN 'home' ELSE 'away' END AS side,
  CASE WHEN l_linenumber >= 6 THEN 'P' ELSE 'B' END AS role,
  CASE WHEN l_linenumber >= 6 THEN l_linenumber - 6 ELSE l_linenumber - 1 END AS slot,
  max(l_partkey) AS player_id
FROM {lineitem}
GROUP BY 1, 2, 3, 4
"""
_count = "CAST(count(CASE WHEN CAST(l_quantity AS INT) % 16 = {n} THEN 1 END) AS DOUBLE)"


def _counted(**columns: int) -> str:
    return ", ".join(f"{_count.format(n=n)} AS \"{name}\"" for name, n in columns.items())


_bat = _counted(**{"2B": 1, "3B": 2, "HR": 3, "SO": 4, "BB": 6, "HBP": 8, "1B": 0})
BATTER_PROJECTION = f"""
SELECT l_partkey AS xMLBAMID, concat('Player ', CAST(l_partkey AS VARCHAR(20))) AS PlayerName,
  concat('T', CAST(min(l_suppkey) AS VARCHAR(20))) AS Team,
  CASE WHEN l_partkey % 50 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(count(*) AS DOUBLE) END AS PA,
  CAST(count(*) - 2 AS DOUBLE) AS AB, CAST(8 AS DOUBLE) AS H, {_bat},
  CASE WHEN l_partkey % 37 = 0 THEN NULL ELSE CAST(1 AS DOUBLE) END AS IBB
FROM {{lineitem}} GROUP BY l_partkey
""".replace('"', "{q}")
_pit = _counted(HR=3, SO=4, BB=6, HBP=8)
PITCHER_PROJECTION = f"""
SELECT l_partkey AS xMLBAMID, concat('Player ', CAST(l_partkey AS VARCHAR(20))) AS PlayerName,
  concat('T', CAST(min(l_suppkey) AS VARCHAR(20))) AS Team,
  CASE WHEN l_partkey % 50 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(count(*) AS DOUBLE) END AS TBF,
  CAST(count(*) / 3 AS DOUBLE) AS IP, CAST(9 AS DOUBLE) AS H, {_pit},
  CAST(3 AS DOUBLE) AS ERA, CAST(1 AS DOUBLE) AS WHIP,
  CASE l_partkey % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'R' ELSE NULL END AS Throws
FROM {{lineitem}} GROUP BY l_partkey
""".replace('"', "{q}")
HANDEDNESS = """
SELECT c_custkey AS player_id,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'L' WHEN 'FURNITURE' THEN 'S' WHEN 'BUILDING' THEN NULL ELSE 'R' END
    AS bat_side,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'R' WHEN 'HOUSEHOLD' THEN 'L' WHEN 'BUILDING' THEN NULL ELSE 'R' END
    AS pitch_hand
FROM {customer}
"""
OAA = """
SELECT l_suppkey AS player_id, CAST(year(l_shipdate) AS INT) AS year,
  CAST(sum(l_quantity) AS BIGINT) % 21 - 10 AS outs_above_average
FROM {lineitem} GROUP BY 1, 2
"""
RATINGS = """
SELECT l_partkey AS player_id, CAST(year(l_shipdate) AS INT) AS year,
  CAST(CAST(sum(l_quantity) AS BIGINT) % 21 - 10 AS DOUBLE) AS outs_above_average_per_inning
FROM {lineitem} GROUP BY 1, 2
"""
_metrics = ", ".join(
    f"CASE WHEN (s_suppkey + {y}) % 11 = 0 THEN NULL ELSE CAST(90 + (s_suppkey * 7 + {y}) % 21 AS DOUBLE) END"
    f" AS metric_value_{y}"
    for y in range(FIRST_YEAR, LAST_YEAR + 1)
)
PARK_WIDE = f"""
SELECT CAST(s_suppkey AS INT) AS venue_id, s_name AS venue_name, s_nationkey AS main_team_id,
  s_name AS name_display_club, {_metrics}
FROM {{supplier}}
"""
TEAMS = """
SELECT CASE WHEN s_acctbal > 1000 THEN s_name ELSE concat('Old ', s_name) END AS team_name,
  concat('T', CAST(s_suppkey AS VARCHAR(20))) AS team_abbr
FROM {supplier}
"""
WEATHER = """
SELECT event_id AS game_id,
  CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' degrees, Clear' WHEN 3 THEN 'Sunny'
    ELSE concat(CASE WHEN event_id % 3 = 0 THEN '-' ELSE '' END, CAST(CAST(floor(value) AS INT) AS VARCHAR(9)),
      CASE event_id % 5 WHEN 0 THEN ' Degrees' ELSE ' degrees' END,
      CASE event_id % 4 WHEN 0 THEN ', Roof Closed.' WHEN 1 THEN ', Roof Open..'
        WHEN 2 THEN ',  Partly Cloudy. ' ELSE '' END) END AS weather,
  CASE event_id % 13 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' mph, L To R.' WHEN 3 THEN '1.2.3 mph, Out To RF.'
    WHEN 4 THEN 'Calm' WHEN 5 THEN '0 mph, None.'
    ELSE concat(CAST(CAST(floor(value) AS INT) % 20 AS VARCHAR(9)), ' mph',
      CASE event_id % 7 WHEN 0 THEN ', In From CF.' WHEN 1 THEN ', Out To Left Center.' WHEN 2 THEN ', l to r.'
        WHEN 3 THEN ', Varies.' WHEN 4 THEN ', Out To RF' WHEN 5 THEN ', right to left' ELSE '' END) END AS wind,
  CASE event_id % 6 WHEN 0 THEN 'Chase Field' WHEN 1 THEN NULL ELSE concat('Park ', CAST(user_id % 9 AS VARCHAR(9))) END
    AS venue,
  CASE WHEN user_id % 10 = 0 THEN NULL ELSE concat('Club ', CAST(user_id % 30 AS VARCHAR(9))) END AS away_team,
  concat('Club ', CAST((user_id + 1) % 30 AS VARCHAR(9))) AS home_team,
  user_id AS away_team_id, CASE WHEN user_id % 10 = 1 THEN NULL ELSE user_id + 1 END AS home_team_id,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id % 12 END AS away_runs, event_id % 7 AS home_runs
FROM {events}
"""
SCHEDULE = """
SELECT CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_orderkey END AS game_id,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) AS game_date,
  CASE WHEN o_orderkey % 103 = 0 THEN NULL
    ELSE concat(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)), ' 18:05:00') END AS game_datetime,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Scheduled' WHEN '2-HIGH' THEN 'Postponed: Rain' WHEN '3-MEDIUM' THEN NULL
    WHEN '4-NOT SPECIFIED' THEN 'Start TBD' ELSE 'Pre-Game' END AS status
FROM {orders}
"""
MEASURES = "SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM {lineitem}"

VIEWS = {
    "pitch": PITCH, "trials": TRIALS, "games": GAMES, "lineup": LINEUP,
    "batter_projection": BATTER_PROJECTION, "pitcher_projection": PITCHER_PROJECTION,
    "handedness": HANDEDNESS, "oaa": OAA, "ratings": RATINGS, "park_wide": PARK_WIDE,
    "teams": TEAMS, "weather": WEATHER, "schedule": SCHEDULE, "measures": MEASURES,
}


class Tables:
    """The given tables and the views over them, as Spark DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        used = {t: self.table(t) for t in TABLES if f"{{{t}}}" in text}
        return self.spark.sql(text.replace("{q}", "`").replace("VARCHAR(9)", "STRING").replace("VARCHAR(20)", "STRING"), **used)

    @cached_property
    def pitch(self) -> DataFrame:
        return self.view("pitch")

    @cached_property
    def pa(self) -> DataFrame:
        from priorline.operators.events import plate_appearances

        return plate_appearances(self.pitch)


def duck_view(name: str) -> str:
    """The view's text for DuckDB."""
    text = VIEWS[name].replace("{q}", '"')
    for table in TABLES:
        text = text.replace(f"{{{table}}}", table)
    return text.strip()


def with_views(*names: str, body: str, **ctes: str) -> str:
    """``WITH`` the named views and further CTEs, then the body."""
    parts = [f"{n} AS ({duck_view(n)})" for n in names]
    parts += [f"{n} AS ({text.strip()})" for n, text in ctes.items()]
    return f"WITH {', '.join(parts)} {body.strip()}"


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _pa_sql() -> str:
    """Last pitch per plate appearance, classified and flagged, in plain SQL over ``pitch``."""
    ties = [c for c in C.PITCH_COLUMNS if c not in ("game_pk", "at_bat_number", "pitch_number")]
    order = ", ".join(f"{c} DESC NULLS LAST" for c in ("pitch_number", *ties))
    return f"""
    SELECT * EXCLUDE (rn),
      CASE WHEN events IN ({quoted(C.OUT_EVENTS)}) THEN 0 WHEN events = 'single' THEN 1
        WHEN events = 'double' THEN 2 WHEN events = 'triple' THEN 3 WHEN events = 'home_run' THEN 4
        WHEN events IN ({quoted(C.STRIKEOUT_EVENTS)}) THEN 5 WHEN events IN ({quoted(C.WALK_EVENTS)}) THEN 6
        WHEN events = 'hit_by_pitch' THEN 7 ELSE 99 END AS pa_outcome_category,
      events IS NOT NULL AS is_pa, events IN ({quoted(C.AT_BAT_EVENTS)}) AS is_ab,
      events IN ({quoted(C.HIT_EVENTS)}) AS is_hit, events IN ({quoted(C.STRIKEOUT_EVENTS)}) AS is_k,
      events IN ({quoted(C.WALK_EVENTS)}) AS is_bb, events = 'hit_by_pitch' AS is_hbp,
      events = 'single' AS is_1b, events = 'double' AS is_2b, events = 'triple' AS is_3b,
      events = 'home_run' AS is_hr, events IN ({quoted(C.OUT_EVENTS)}) AS is_out
    FROM (SELECT *, row_number() OVER (PARTITION BY game_pk, at_bat_number ORDER BY {order}) AS rn FROM pitch)
    WHERE rn = 1"""


LAST_SQL = _pa_sql()
PA_SQL = f"SELECT * FROM ({LAST_SQL}) WHERE pa_outcome_category <> 99"
