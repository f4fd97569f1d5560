"""Box scores, weather and wind text, and the game table."""

from __future__ import annotations

from pyspark.sql import functions as F

from priorline import constants as C
from priorline.catalog.bindings import Tables, quoted, with_views
from priorline.catalog.registry import query, r6, rounded
from priorline.operators import games, views
from priorline.sources import nested

FLAT_SQL = """
SELECT game_id, coalesce(away_team, 'Unknown') AS away_team, away_team_id, home_team, home_team_id,
  coalesce(away_runs, 0) AS away_runs, home_runs, coalesce(away_runs, 0) + home_runs AS total_runs, weather, wind, venue
FROM weather
"""
# last word before the unit; empty when there is none
_word = "regexp_extract(string_split({0}, '{1}')[1], '(\\S+)\\s*$', 1)"
_tail = (
    "CASE WHEN contains({0}, ',') THEN "
    "regexp_replace(regexp_replace(substr({0}, strpos({0}, ',') + 1), '^\\s+|\\s+$', '', 'g'), '\\.+$', '') END"
)
WEATHER_SQL = f"""
SELECT * EXCLUDE (unit, word, tail, bad),
  CASE WHEN NOT bad AND unit THEN TRY_CAST(nullif(regexp_replace(word, '\\D', '', 'g'), '') AS DOUBLE) END AS temperature,
  CASE WHEN NOT bad THEN tail END AS weather_conditions,
  CASE WHEN NOT bad THEN contains(lower(coalesce(tail, '')), 'roof closed') OR contains(lower(coalesce(tail, '')), 'roof open') END
    AS is_domed_stadium,
  CASE WHEN bad THEN NULL WHEN contains(lower(coalesce(tail, '')), 'roof closed') THEN true
    WHEN contains(lower(coalesce(tail, '')), 'roof open') THEN false END AS roof_closed
FROM (SELECT *, weather IS NULL OR weather = '' OR (unit AND word = '') AS bad FROM (
  SELECT *, contains(lower(weather), 'degrees') AS unit, {_word.format('weather', 'degrees')} AS word,
    {_tail.format('weather')} AS tail FROM {{source}}))
"""
WIND_SQL = f"""
SELECT * EXCLUDE (unit, word, tail, digits, bad, low),
  CASE WHEN NOT bad AND unit THEN TRY_CAST(digits AS DOUBLE) END AS wind_speed_mph,
  CASE WHEN bad THEN NULL WHEN contains(low, 'in from') THEN
      CASE WHEN regexp_matches(low, 'cf|center') THEN 'In From CF' WHEN regexp_matches(low, 'lf|left') THEN 'In From LF'
        WHEN regexp_matches(low, 'rf|right') THEN 'In From RF' ELSE tail END
    WHEN contains(low, 'out to') THEN
      CASE WHEN regexp_matches(low, 'cf|center') THEN 'Out To CF' WHEN regexp_matches(low, 'lf|left') THEN 'Out To LF'
        WHEN regexp_matches(low, 'rf|right') THEN 'Out To RF' ELSE tail END
    WHEN regexp_matches(low, 'l to r|left to right') THEN 'L To R'
    WHEN regexp_matches(low, 'r to l|right to left') THEN 'R To L' ELSE tail END AS wind_direction,
  CASE WHEN NOT bad THEN coalesce(CASE WHEN unit THEN TRY_CAST(digits AS DOUBLE) END, 0) > 0 AND coalesce(tail, '') <> ''
    AND coalesce(low, '') <> 'none' END AS wind_affects_play
FROM (SELECT *, wind IS NULL OR wind = '' OR (unit AND (word = '' OR (digits IS NOT NULL AND TRY_CAST(digits AS DOUBLE) IS NULL))) AS bad,
    lower(tail) AS low FROM (
  SELECT *, contains(lower(wind), 'mph') AS unit, {_word.format('wind', 'mph')} AS word,
    nullif(regexp_replace({_word.format('wind', 'mph')}, '[^0-9.]', '', 'g'), '') AS digits,
    {_tail.format('wind')} AS tail FROM {{source}}))
"""
GAME_SQL = f"""
SELECT game_id, away_team, away_team_id, home_team, home_team_id, away_runs, home_runs, total_runs, venue,
  weather AS weather_raw, wind AS wind_raw, temperature, weather_conditions,
  coalesce(is_domed_stadium, venue IN ({quoted(C.DOMED_VENUES)}), false) AS is_domed_stadium, roof_closed,
  wind_speed_mph, wind_direction, wind_affects_play FROM winded
"""
GAME_CTES = {
    "flat": FLAT_SQL,
    "weathered": WEATHER_SQL.format(source="flat"),
    "winded": WIND_SQL.format(source="weathered"),
    "game": GAME_SQL,
}


def boxscores(t: Tables):
    """Nested box scores built from the weather view; the venue label occurs twice."""
    return t.view("weather").select(
        "game_id", *[_side(s) for s in ("away", "home")],
        F.filter(
            F.array(
                _pair("Venue", F.concat(F.lit("old "), F.col("venue"))), _pair("WEATHER", F.col("weather")),
                _pair("Wind", F.col("wind")), _pair("venue", F.col("venue")),
            ),
            lambda pair: pair["value"].isNotNull(),
        ).alias("gameBoxInfo"),
    )


def _side(side: str):
    return F.struct(
        F.struct(F.struct(F.col(f"{side}_runs").alias("runs")).alias("batting")).alias("teamStats"),
        F.struct(F.col(f"{side}_team").alias("name"), F.col(f"{side}_team_id").alias("id")).alias("team"),
    ).alias(side)


def _pair(label: str, value):
    return F.struct(F.lit(label).alias("label"), value.alias("value"))


def game_table(t: Tables):
    return games.enrich_games(nested.flatten_boxscore(boxscores(t)))


@query("flatten_boxscore", with_views("weather", body=FLAT_SQL))
def _(t: Tables):
    return nested.flatten_boxscore(boxscores(t))


@query(
    "parse_weather",
    with_views("weather", parsed=WEATHER_SQL.format(source="weather"), body="""
      SELECT game_id, weather, temperature, weather_conditions, is_domed_stadium, roof_closed FROM parsed"""),
)
def _(t: Tables):
    parsed = games.parse_weather(t.view("weather"))
    return parsed.select("game_id", "weather", "temperature", "weather_conditions", "is_domed_stadium", "roof_closed")


@query(
    "parse_wind",
    with_views("weather", parsed=WIND_SQL.format(source="weather"), body="""
      SELECT game_id, wind, wind_speed_mph, wind_direction, wind_affects_play FROM parsed"""),
)
def _(t: Tables):
    parsed = games.parse_wind(t.view("weather"))
    return parsed.select("game_id", "wind", "wind_speed_mph", "wind_direction", "wind_affects_play")


@query("domed_fallback", with_views("weather", **GAME_CTES, body="SELECT game_id, venue, is_domed_stadium FROM game"))
def _(t: Tables):
    parsed = games.parse_weather(t.view("weather"))
    return games.domed_fallback(parsed).select("game_id", "venue", "is_domed_stadium")


@query("enrich_games", with_views("weather", **GAME_CTES, body="SELECT * FROM game"))
def _(t: Tables):
    return game_table(t)


@query(
    "game_summary",
    with_views("weather", **GAME_CTES, body=f"""
      SELECT count(*) AS total_games, {r6('avg(total_runs)', 'average_total_runs')},
        count(DISTINCT venue) + max(CAST(venue IS NULL AS INT)) AS unique_venues,
        min(temperature) AS min_temperature, max(temperature) AS max_temperature,
        count(*) FILTER (WHERE is_domed_stadium) AS domed_games,
        {r6('count(*) FILTER (WHERE is_domed_stadium) * 100.0::DOUBLE / count(*)', 'domed_percent')},
        count(*) FILTER (WHERE wind_affects_play) AS windy_games,
        {r6('count(*) FILTER (WHERE wind_affects_play) * 100.0::DOUBLE / count(*)', 'windy_percent')} FROM game"""),
)
def _(t: Tables):
    return rounded(games.game_summary(game_table(t)))


@query(
    "top_categories",
    with_views("weather", **GAME_CTES, body="""
      SELECT wind_direction, count(*) AS count FROM game WHERE wind_direction IS NOT NULL
      GROUP BY wind_direction ORDER BY count DESC, wind_direction LIMIT 5"""),
)
def _(t: Tables):
    return views.top_categories(game_table(t), "wind_direction")
