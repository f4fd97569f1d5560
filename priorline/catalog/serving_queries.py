"""Projections, handedness, line-ups, schedules and serving tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from priorline import constants as C
from priorline.catalog.bindings import Tables, with_views
from priorline.catalog.registry import query, r6, rounded
from priorline.functions import calendar
from priorline.operators import rates, serving
from priorline.operators.totals import wide_to_long_factors

BAT = [f"batter_{r}_daily_input" for r in ("1b_pct", "2b_pct", "3b_pct", "hr_pct", "k_pct", "bb_pct", "hbp_pct")]
PIT = [f"pitcher_{r}_a_daily_input" for r in ("1b_pct", "2b_pct", "3b_pct", "hr_pct", "k_pct", "bb_pct", "hbp_pct")]
BAT_ALL = [*BAT, "batter_non_k_out_pct_daily_input"]
PIT_ALL = [*PIT, "pitcher_non_k_out_pct_a_daily_input"]

BATTER_RATES_SQL = f"""
SELECT *, 1.0 - ({" + ".join(BAT)}) AS batter_non_k_out_pct_daily_input FROM (SELECT *,
  "1B" / nullif(PA, 0) AS {BAT[0]}, "2B" / nullif(PA, 0) AS {BAT[1]}, "3B" / nullif(PA, 0) AS {BAT[2]},
  HR / nullif(PA, 0) AS {BAT[3]}, SO / nullif(PA, 0) AS {BAT[4]}, (BB + IBB) / nullif(PA, 0) AS {BAT[5]},
  HBP / nullif(PA, 0) AS {BAT[6]} FROM batter_projection)
"""


def pitcher_rates_sql(adjusted: bool) -> str:
    league = {k: f"CAST({v!r} AS DOUBLE)" for k, v in C.LEAGUE_RATES.items()}
    pull = f"(2.0 - least(greatest(so_rate / {league['lg_k_pct']}, 0.5), 1.5))"
    doubles = f"CASE WHEN so_rate IS NOT NULL THEN h_rate * {league['lg_2b_rate_of_hits']} * {pull} END"
    triples = f"CASE WHEN so_rate IS NOT NULL THEN h_rate * {league['lg_3b_rate_of_hits']} * {pull} END"
    if not adjusted:
        doubles, triples = league["lg_2b_pct"], league["lg_3b_pct"]
    return f"""
    SELECT *, 1.0 - ({" + ".join(PIT)}) AS pitcher_non_k_out_pct_a_daily_input FROM (
      SELECT *, h_rate - {PIT[3]} - {PIT[1]} - {PIT[2]} AS {PIT[0]} FROM (
        SELECT *, {doubles} AS {PIT[1]}, {triples} AS {PIT[2]}, so_rate AS {PIT[4]} FROM (
          SELECT *, H / nullif(TBF, 0) AS h_rate, HR / nullif(TBF, 0) AS {PIT[3]}, SO / nullif(TBF, 0) AS so_rate,
            BB / nullif(TBF, 0) AS {PIT[5]}, HBP / nullif(TBF, 0) AS {PIT[6]}, coalesce(Throws, 'R') AS p_throws
          FROM pitcher_projection)))"""


BAT_BODY = f"""SELECT xMLBAMID, PlayerName, Team, {', '.join(r6(c) for c in BAT_ALL)},
  PA, AB, H, "1B", "2B", "3B", HR, BB, IBB, SO, HBP FROM batter_rates"""
PIT_BODY = f"""SELECT xMLBAMID, PlayerName, Team, {', '.join(r6(c) for c in PIT_ALL)}, p_throws,
  TBF, {r6('IP')}, H, HR, SO, BB, HBP, ERA, WHIP FROM pitcher_rates"""


@query("batter_projection_rates", with_views("batter_projection", batter_rates=BATTER_RATES_SQL, body=BAT_BODY))
def _(t: Tables):
    return rounded(rates.batter_projection_rates(t.view("batter_projection")))


@query(
    "pitcher_projection_rates",
    with_views("pitcher_projection", pitcher_rates=pitcher_rates_sql(False), body=PIT_BODY),
)
def _(t: Tables):
    return rounded(rates.pitcher_projection_rates(t.view("pitcher_projection")))


@query(
    "pitcher_projection_rates_adjusted",
    with_views("pitcher_projection", pitcher_rates=pitcher_rates_sql(True), body=PIT_BODY),
)
def _(t: Tables):
    return rounded(rates.pitcher_projection_rates_adjusted(t.view("pitcher_projection")))


@query(
    "projection_pipeline",
    with_views("batter_projection", "pitcher_projection", batter_rates=BATTER_RATES_SQL,
      pitcher_rates=pitcher_rates_sql(True), body=f"""
      SELECT xMLBAMID, PlayerName, {r6(BAT_ALL[-1], 'non_k_out')}, {r6(BAT_ALL[5], 'bb')}, 'B' AS kind FROM batter_rates
      UNION ALL SELECT xMLBAMID, PlayerName, {r6(PIT_ALL[-1], 'non_k_out')}, {r6(PIT_ALL[5], 'bb')}, p_throws FROM pitcher_rates"""),
)
def _(t: Tables):
    batters = rates.projection_pipeline(t.view("batter_projection"), "batter")
    pitchers = rates.projection_pipeline(t.view("pitcher_projection"), "pitcher")
    return rounded(
        batters.select(
            "xMLBAMID", "PlayerName", F.col(BAT_ALL[-1]).alias("non_k_out"), F.col(BAT_ALL[5]).alias("bb"),
            F.lit("B").alias("kind"),
        ).unionByName(
            pitchers.select(
                "xMLBAMID", "PlayerName", F.col(PIT_ALL[-1]).alias("non_k_out"), F.col(PIT_ALL[5]).alias("bb"),
                F.col("p_throws").alias("kind"),
            )
        )
    )


CHECK_SQL = f"""
SELECT *, coalesce(total_rate_sum < 0.99 OR total_rate_sum > 1.01, false) AS rate_sum_warning
FROM (SELECT *, {" + ".join(PIT_ALL)} AS total_rate_sum FROM pitcher_rates)
"""


@query(
    "rate_sum_check",
    with_views("pitcher_projection", pitcher_rates=pitcher_rates_sql(True), checked=CHECK_SQL,
      body=f"SELECT xMLBAMID, {r6('total_rate_sum')}, rate_sum_warning FROM checked"),
)
def _(t: Tables):
    checked = rates.rate_sum_check(rates.pitcher_projection_rates_adjusted(t.view("pitcher_projection")), "pitcher")
    return rounded(checked.select("xMLBAMID", "total_rate_sum", "rate_sum_warning"))


@query(
    "rate_offenders",
    with_views("pitcher_projection", pitcher_rates=pitcher_rates_sql(True), checked=CHECK_SQL,
      body=f"""SELECT xMLBAMID, {r6(PIT_ALL[0])} FROM checked WHERE rate_sum_warning OR total_rate_sum IS NULL
        OR {" OR ".join(f"coalesce({c} < 0 OR {c} > 1, false)" for c in PIT_ALL)}"""),
)
def _(t: Tables):
    checked = rates.rate_sum_check(rates.pitcher_projection_rates_adjusted(t.view("pitcher_projection")), "pitcher")
    return rounded(rates.rate_offenders(checked, "pitcher").select("xMLBAMID", PIT_ALL[0]))


@query(
    "clip",
    """SELECT l_orderkey, l_linenumber, l_partkey,
      CASE WHEN l_quantity > 45 THEN NULL ELSE least(greatest(l_quantity / 20, 0.5), 1.5) END AS clipped FROM lineitem""",
)
def _(t: Tables):
    from priorline.functions.numbers import clip

    value = F.when(F.col("l_quantity") <= 45, F.col("l_quantity") / 20)
    return t.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", clip(value, 0.5, 1.5).alias("clipped"))


@query(
    "optional_column",
    with_views("pitcher_projection", body="""
      SELECT xMLBAMID, coalesce(Throws, 'R') AS p_throws, 'R' AS fallback FROM pitcher_projection"""),
)
def _(t: Tables):
    with_hand = rates.optional_column(t.view("pitcher_projection"), "Throws", "R", "p_throws")
    both = rates.optional_column(with_hand, "no_such_column", "R", "fallback")
    return both.select("xMLBAMID", "p_throws", "fallback")


HANDED_SQL = """
SELECT p.*, coalesce(h.bat_side, 'R') AS stand, coalesce(h.pitch_hand, {existing} 'R') AS {throws}
FROM {rates} p LEFT JOIN {hands} h ON p.xMLBAMID = h.player_id
"""


def _handed(rates_name: str, hands: str, existing: str = "", throws: str = "p_throws") -> str:
    return HANDED_SQL.format(rates=rates_name, hands=hands, existing=existing, throws=throws)


@query(
    "attach_handedness",
    with_views("pitcher_projection", "handedness", pitcher_rates=pitcher_rates_sql(True), body="""
      SELECT xMLBAMID, coalesce(bat_side, 'R') AS stand, coalesce(pitch_hand, p_throws, 'R') AS p_throws
      FROM pitcher_rates LEFT JOIN handedness ON xMLBAMID = player_id"""),
)
def _(t: Tables):
    pitchers = rates.pitcher_projection_rates_adjusted(t.view("pitcher_projection"))
    return serving.attach_handedness(pitchers, t.view("handedness")).select("xMLBAMID", "stand", "p_throws")


FILLED_SQL = """
SELECT ids.player_id, coalesce(bat_side, 'R') AS bat_side, coalesce(pitch_hand, 'R') AS pitch_hand
FROM (SELECT DISTINCT player_id FROM lineup) ids LEFT JOIN handedness ON ids.player_id = handedness.player_id
"""


@query("fill_missing_entities", with_views("lineup", "handedness", body=FILLED_SQL))
def _(t: Tables):
    return serving.fill_missing_entities(serving.player_ids(t.view("lineup")), t.view("handedness"))


@query(
    "semi_filter",
    with_views("lineup", "batter_projection", body="""
      SELECT xMLBAMID, PA, HR FROM batter_projection WHERE xMLBAMID IN (SELECT player_id FROM lineup WHERE role = 'P')"""),
)
def _(t: Tables):
    pitchers = serving.player_ids(t.view("lineup").filter(F.col("role") == "P"))
    return serving.semi_filter(t.view("batter_projection"), pitchers).select("xMLBAMID", "PA", "HR")


BATTERS_SQL = """
SELECT game_pk, side, slot, lineup.player_id, coalesce(bat_side, 'R') AS stand, b.* EXCLUDE (xMLBAMID)
FROM lineup JOIN batter_rates b ON lineup.player_id = xMLBAMID
LEFT JOIN handedness h ON lineup.player_id = h.player_id WHERE role = 'B'
"""
STARTERS_SQL = """
SELECT game_pk, side, lineup.player_id, coalesce(pitch_hand, p_throws, 'R') AS throws, p.* EXCLUDE (xMLBAMID, p_throws)
FROM lineup JOIN pitcher_rates p ON lineup.player_id = xMLBAMID
LEFT JOIN handedness h ON lineup.player_id = h.player_id WHERE role = 'P' AND slot = 0
"""
BOTH_SQL = "SELECT * FROM {0} WHERE game_pk IN (SELECT game_pk FROM {0} GROUP BY game_pk HAVING count(DISTINCT side) = 2)"
DEFENSE_SQL = """
SELECT game_pk, side, coalesce(sum(outs_above_average_per_inning), 0.0) AS team_defense_rating,
  count(outs_above_average_per_inning) AS fielders_counted
FROM lineup JOIN games USING (game_pk) LEFT JOIN ratings ON lineup.player_id = ratings.player_id AND games.year = ratings.year
WHERE role = 'B' GROUP BY game_pk, side
"""
FACTORS_SQL = " UNION ALL ".join(
    f"SELECT venue_id, CAST({y} AS INT) AS year, metric_value_{y} AS park_factor FROM park_wide" for y in range(1995, 2002)
)
CONTEXT_SQL = """
SELECT games.game_pk, games.venue_id, games.year, coalesce(park_factor, 100.0) AS park_factor_input
FROM games LEFT JOIN factors ON games.venue_id = factors.venue_id AND games.year = factors.year
"""
SERVING_VIEWS = ["lineup", "handedness", "batter_projection", "pitcher_projection", "games", "ratings", "park_wide"]
SERVING_CTES = {
    "batter_rates": BATTER_RATES_SQL,
    "pitcher_rates": pitcher_rates_sql(True),
    "some_batters": BATTERS_SQL,
    "batters": BOTH_SQL.format("some_batters"),
    "some_starters": STARTERS_SQL,
    "starters": BOTH_SQL.format("some_starters"),
    "defense": DEFENSE_SQL,
    "factors": FACTORS_SQL,
    "context": CONTEXT_SQL,
}


def serving_tables(t: Tables) -> dict:
    """Line-up, starter, defence and context tables over the given data."""
    games, lineup, hands = t.view("games"), t.view("lineup"), t.view("handedness")
    batters = rates.projection_pipeline(t.view("batter_projection"), "batter")
    pitchers = rates.projection_pipeline(t.view("pitcher_projection"), "pitcher")
    batters = serving.attach_handedness(batters, hands)
    pitchers = serving.attach_handedness(pitchers, hands)
    return {
        "games": games,
        "batters": serving.assemble_lineup(lineup, batters),
        "starters": serving.starting_pitcher(lineup, pitchers),
        "defense": serving.team_defense(lineup, t.view("ratings"), games),
        "factors": wide_to_long_factors(t.view("park_wide")),
    }


@query(
    "assemble_lineup",
    with_views(*SERVING_VIEWS, **SERVING_CTES, body=f"""
      SELECT game_pk, side, slot, player_id, stand, {', '.join(r6(c) for c in C.BATTER_RATE_COLUMNS)} FROM batters"""),
)
def _(t: Tables):
    return rounded(serving_tables(t)["batters"])


@query(
    "starting_pitcher",
    with_views(*SERVING_VIEWS, **SERVING_CTES, body=f"""
      SELECT game_pk, side, player_id, throws AS p_throws, {', '.join(r6(c) for c in C.PITCHER_RATE_COLUMNS)} FROM starters"""),
)
def _(t: Tables):
    return rounded(serving_tables(t)["starters"])


@query(
    "team_defense",
    with_views("lineup", "games", "ratings", body=DEFENSE_SQL),
)
def _(t: Tables):
    return serving.team_defense(t.view("lineup"), t.view("ratings"), t.view("games"))


@query(
    "factor_lookup",
    with_views("games", "park_wide", factors=FACTORS_SQL, context=CONTEXT_SQL,
      body="SELECT game_pk, venue_id, year, park_factor_input FROM context"),
)
def _(t: Tables):
    found = serving.factor_lookup(t.view("games"), wide_to_long_factors(t.view("park_wide")))
    return found.select("game_pk", "venue_id", "year", "park_factor_input")


@query(
    "game_inputs",
    with_views(*SERVING_VIEWS, **SERVING_CTES, body=f"""
      SELECT c.game_pk, park_factor_input,
        (SELECT count(*) FROM batters b WHERE b.game_pk = c.game_pk AND side = 'home') AS home_batters,
        (SELECT count(*) FROM batters b WHERE b.game_pk = c.game_pk AND side = 'away') AS away_batters,
        (SELECT arg_min(player_id, slot) FROM batters b WHERE b.game_pk = c.game_pk AND side = 'home') AS home_leadoff,
        (SELECT arg_min(player_id, slot) FROM batters b WHERE b.game_pk = c.game_pk AND side = 'away') AS away_leadoff,
        h.player_id AS home_pitcher_id, h.throws AS home_throws, {r6('h.pitcher_k_pct_a_daily_input', 'home_k')},
        a.player_id AS away_pitcher_id, a.throws AS away_throws, {r6('a.pitcher_k_pct_a_daily_input', 'away_k')},
        coalesce(hd.team_defense_rating, 0.0) AS home_team_defense_rating,
        coalesce(ad.team_defense_rating, 0.0) AS away_team_defense_rating
      FROM context c JOIN starters h ON c.game_pk = h.game_pk AND h.side = 'home'
      JOIN starters a ON c.game_pk = a.game_pk AND a.side = 'away'
      LEFT JOIN defense hd ON c.game_pk = hd.game_pk AND hd.side = 'home'
      LEFT JOIN defense ad ON c.game_pk = ad.game_pk AND ad.side = 'away'
      WHERE c.game_pk IN (SELECT game_pk FROM batters)"""),
)
def _(t: Tables):
    inputs = serving.game_inputs(**serving_tables(t))
    k = "pitcher_k_pct_a_daily_input"
    return rounded(
        inputs.select(
            "game_pk", "park_factor_input",
            F.size("home_lineup").cast("bigint").alias("home_batters"),
            F.size("away_lineup").cast("bigint").alias("away_batters"),
            F.col("home_lineup")[0]["player_id"].alias("home_leadoff"),
            F.col("away_lineup")[0]["player_id"].alias("away_leadoff"),
            F.col("home_pitcher.player_id").alias("home_pitcher_id"), F.col("home_pitcher.p_throws").alias("home_throws"),
            F.col(f"home_pitcher.{k}").alias("home_k"),
            F.col("away_pitcher.player_id").alias("away_pitcher_id"), F.col("away_pitcher.p_throws").alias("away_throws"),
            F.col(f"away_pitcher.{k}").alias("away_k"),
            "home_team_defense_rating", "away_team_defense_rating",
        )
    )


MATCHUPS_SQL = """
SELECT b.game_pk, b.side, b.slot, b.player_id, s.player_id AS pitcher_id, b.stand, s.throws AS p_throws,
  coalesce(d.team_defense_rating, 0.0) AS team_defense_oaa_input, park_factor_input,
  CAST(CASE WHEN b.side = 'home' THEN 1 ELSE 0 END AS TINYINT) AS is_batter_home, {rates}
FROM batters b JOIN starters s ON b.game_pk = s.game_pk AND b.side <> s.side
JOIN context c ON b.game_pk = c.game_pk
LEFT JOIN defense d ON b.game_pk = d.game_pk AND b.side <> d.side
""".format(rates=", ".join([*C.BATTER_RATE_COLUMNS, *[f"s.{c}" for c in C.PITCHER_RATE_COLUMNS]]))
MATCHUP_KEYS = ["game_pk", "side", "slot", "player_id", "pitcher_id", "stand", "p_throws",
                "team_defense_oaa_input", "park_factor_input", "is_batter_home"]
MATCHUP_RATES = [*C.BATTER_RATE_COLUMNS, *C.PITCHER_RATE_COLUMNS]


@query(
    "matchups",
    with_views(*SERVING_VIEWS, **SERVING_CTES, matchups=MATCHUPS_SQL, body=f"""
      SELECT {', '.join(MATCHUP_KEYS)}, {', '.join(r6(c) for c in MATCHUP_RATES)} FROM matchups"""),
)
def _(t: Tables):
    return rounded(serving.matchups(**serving_tables(t)).select(*MATCHUP_KEYS, *MATCHUP_RATES))


# --- schedules ---------------------------------------------------------------------------------
@query(
    "games_in_range",
    with_views("schedule", body="SELECT game_id FROM schedule WHERE game_date BETWEEN '1996-04-01' AND '1997-10-31'"),
)
def _(t: Tables):
    return serving.games_in_range(t.view("schedule"), "1996-04-01", "1997-10-31")


UPCOMING_SQL = """
SELECT game_id, status, strftime(run_at, '%Y-%m-%d %H:%M:%S') AS run_at,
  strftime((run_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M:%S') AS run_at_local,
  round(date_diff('second', TIMESTAMP '1997-06-01 12:00:00', run_at) / 3600, 6) + 0.0 AS hours_until
FROM (SELECT *, CAST(game_datetime AS TIMESTAMP) - INTERVAL 55 MINUTE AS run_at FROM schedule
  WHERE game_id IS NOT NULL AND game_datetime IS NOT NULL
    AND NOT regexp_matches(lower(coalesce(status, 'unknown')), 'tbd|postponed|cancelled|suspended'))
WHERE run_at >= TIMESTAMP '1997-06-01 12:00:00'
"""


@query("upcoming_games", with_views("schedule", body=UPCOMING_SQL))
def _(t: Tables):
    now = F.lit("1997-06-01 12:00:00").cast("timestamp")
    due = serving.upcoming_games(t.view("schedule"), now)

    def shown(c):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)

    return rounded(due.select("game_id", "status", shown("run_at"), shown("run_at_local"), "hours_until"))


@query(
    "calendar_exprs",
    with_views("schedule", body="""
      SELECT game_id, game_date, CAST(CAST(game_date AS DATE) - 1 AS DATE) AS yesterday, CAST(year(CAST(game_date AS DATE)) AS INT) AS year,
        strftime(CAST(game_datetime AS TIMESTAMP) - INTERVAL 55 MINUTE, '%Y-%m-%d %H:%M') AS run_at,
        round(date_diff('second', TIMESTAMP '1997-06-01 12:00:00', CAST(game_datetime AS TIMESTAMP)) / 3600, 6) + 0.0 AS hours
      FROM schedule"""),
)
def _(t: Tables):
    start = calendar.instant(F.col("game_datetime"))
    now = F.lit("1997-06-01 12:00:00").cast("timestamp")
    return rounded(
        t.view("schedule").select(
            "game_id", "game_date",
            calendar.yesterday(F.col("game_date").cast("date")).alias("yesterday"),
            calendar.year_of(F.col("game_date")).alias("year"),
            F.date_format(calendar.run_time(start, 55), "yyyy-MM-dd HH:mm").alias("run_at"),
            calendar.hours_between(start, now).alias("hours"),
        )
    )
