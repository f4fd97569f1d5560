"""Pitches, plate appearances, daily and prior totals, rates and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from priorline import constants as C
from priorline.catalog import bindings as B
from priorline.catalog.bindings import LAST_SQL, PA_SQL, Tables, with_views
from priorline.catalog.registry import query, r6, rounded
from priorline.operators import events, features, rates, sets, totals
from priorline.plans import features as plans
from priorline.plans import increments
from priorline.session import held, scratch_path, stored
from priorline.sources import upsert

COUNTS = {"pa": "is_pa", "ab": "is_ab", "h": "is_hit", "k": "is_k", "bb": "is_bb", "hbp": "is_hbp",
          "1b": "is_1b", "2b": "is_2b", "3b": "is_3b", "hr": "is_hr"}
FLAGS = [*COUNTS.values(), "is_out"]


def daily_sql(entity: str) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE {flag}) AS daily_{n}" for n, flag in COUNTS.items())
    return f"SELECT {entity}, game_date, {counts} FROM pa GROUP BY {entity}, game_date"


def prior_sql(entity: str) -> str:
    suffix = "_a" if entity == "pitcher" else ""
    sums = ", ".join(
        f"CAST(coalesce(sum(daily_{n}) OVER before, 0) AS BIGINT) AS cum_{n}{suffix}_prev_day" for n in COUNTS
    )
    return (
        f"SELECT *, {sums} FROM {entity}_daily WINDOW before AS (PARTITION BY {entity} ORDER BY game_date "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )


def rates_sql(entity: str, league: str | None = None) -> str:
    """Shrunken rates over ``<entity>_prior``; ``league`` names a one-row CTE of measured rates."""
    suffix = "_a" if entity == "pitcher" else ""
    names, terms = [], []
    for rate, weight in C.SHRINKAGE_WEIGHTS[entity].items():
        count = "h" if rate == "avg" else rate.removesuffix("_pct")
        trials = "ab" if rate == "avg" else "pa"
        mean = f"(SELECT lg_{rate} FROM {league})" if league else f"CAST({C.LEAGUE_RATES[f'lg_{rate}']!r} AS DOUBLE)"
        name = f"{entity}_{rate}{suffix}_daily_input"
        names.append(name)
        terms.append(
            f"(cum_{count}{suffix}_prev_day + {mean} * CAST({weight} AS DOUBLE))"
            f" / (cum_{trials}{suffix}_prev_day + CAST({weight} AS DOUBLE)) AS {name}"
        )
    rest = " + ".join(n for n in names if "_avg" not in n)
    return (
        f"SELECT *, 1 - ({rest}) AS {entity}_non_k_out_pct{suffix}_daily_input "
        f"FROM (SELECT *, {', '.join(terms)} FROM {entity}_prior)"
    )


RATES = {
    entity: [
        f"{entity}_{r}{'_a' if entity == 'pitcher' else ''}_daily_input"
        for r in [*C.SHRINKAGE_WEIGHTS[entity], "non_k_out_pct"]
    ]
    for entity in ("batter", "pitcher")
}


def chain(*entities: str, league: str | None = None) -> dict[str, str]:
    """CTEs from ``pa`` to the shrunken rates of the entities."""
    ctes = {"pa": PA_SQL}
    if league:
        ctes["league"] = league
    for entity in entities:
        ctes[f"{entity}_daily"] = daily_sql(entity)
        ctes[f"{entity}_prior"] = prior_sql(entity)
        ctes[f"{entity}_rates"] = rates_sql(entity, "league" if league else None)
    return ctes


def rounded_rates(entity: str) -> str:
    return ", ".join(r6(n) for n in RATES[entity])


PLATOON_SQL = (
    "CASE WHEN (stand = 'L' AND p_throws = 'R') OR (stand = 'R' AND p_throws = 'L') THEN 1 ELSE 0 END"
    " AS is_platoon_adv"
)
HOME_SQL = "CAST(CASE WHEN inning_topbot = 'Bot' THEN 1 ELSE 0 END AS TINYINT) AS is_batter_home"
LEAGUE_SQL = f"""
SELECT *, 1 - (lg_bb_pct + lg_hbp_pct + lg_1b_pct + lg_2b_pct + lg_3b_pct + lg_hr_pct) AS lg_out_pct FROM (
  SELECT coalesce(count(*) FILTER (WHERE is_hit) / nullif(count(*) FILTER (WHERE is_ab), 0), 0.0) AS lg_avg,
  {", ".join(f"coalesce(count(*) FILTER (WHERE {COUNTS[n]}) / nullif(count(*), 0), 0.0) AS lg_{n}_pct"
             for n in ("k", "bb", "hbp", "1b", "2b", "3b", "hr"))}
  FROM pa WHERE game_year IN (1996, 1997))
"""
LEAGUE_COLUMNS = ["lg_avg", *[f"lg_{n}_pct" for n in ("k", "bb", "hbp", "1b", "2b", "3b", "hr", "out")]]


@query("project_contract", with_views("pitch", body=f"SELECT {', '.join(C.PITCH_COLUMNS)} FROM pitch"))
def _(t: Tables):
    extra = t.pitch.withColumn("release_speed", F.col("balls") + 90)
    return events.project_contract(extra)


@query("last_per_group", with_views("pitch", last=LAST_SQL, body=f"SELECT {', '.join(C.PITCH_COLUMNS)} FROM last"))
def _(t: Tables):
    return events.last_per_group(events.project_contract(t.pitch))


@query(
    "classify_outcome",
    with_views("pitch", last=LAST_SQL, body="""
      SELECT game_pk, at_bat_number, events, pa_outcome_category FROM last WHERE pa_outcome_category <> 99"""),
)
def _(t: Tables):
    last = events.last_per_group(events.project_contract(t.pitch))
    return events.classify_outcome(last).select("game_pk", "at_bat_number", "events", C.OUTCOME_COLUMN)


@query(
    "event_flags",
    with_views("pitch", last=LAST_SQL, body=f"SELECT game_pk, at_bat_number, {', '.join(FLAGS)} FROM last"),
)
def _(t: Tables):
    last = events.last_per_group(events.project_contract(t.pitch))
    return events.event_flags(last).select("game_pk", "at_bat_number", *FLAGS)


@query("plate_appearances", with_views("pitch", pa=PA_SQL, body="SELECT * FROM pa"))
def _(t: Tables):
    return t.pa


@query(
    "platoon_flag",
    with_views("pitch", pa=PA_SQL, body=f"SELECT game_pk, at_bat_number, stand, p_throws, {PLATOON_SQL} FROM pa"),
)
def _(t: Tables):
    return events.platoon_flag(t.pa).select("game_pk", "at_bat_number", "stand", "p_throws", "is_platoon_adv")


@query(
    "home_batter_flag",
    with_views("pitch", pa=PA_SQL, body=f"SELECT game_pk, at_bat_number, inning_topbot, {HOME_SQL} FROM pa"),
)
def _(t: Tables):
    return events.home_batter_flag(t.pa).select("game_pk", "at_bat_number", "inning_topbot", "is_batter_home")


@query(
    "training_filter",
    with_views("pitch", body="""
      SELECT game_pk, at_bat_number, batter, inning, game_year FROM pitch
      WHERE inning <= 3 AND game_year IN (1998, 1999)"""),
)
def _(t: Tables):
    kept = events.training_filter(t.pitch, B.TRAINING_YEARS)
    return kept.select("game_pk", "at_bat_number", "batter", "inning", "game_year")


@query(
    "drop_nulls",
    with_views("pitch", body="""
      SELECT game_pk, at_bat_number, pitch_number, events, fielder_2 FROM pitch
      WHERE pitch_number IS NOT NULL AND events IS NOT NULL"""),
)
def _(t: Tables):
    kept = events.drop_nulls(t.pitch, ["pitch_number", "events"])
    return kept.select("game_pk", "at_bat_number", "pitch_number", "events", "fielder_2")


@query(
    "complete_records",
    with_views("pitch", body="""
      SELECT game_pk, at_bat_number, events, fielder_2 FROM pitch
      WHERE events IS NOT NULL AND fielder_2 IS NOT NULL"""),
)
def _(t: Tables):
    kept = events.complete_records(t.pitch, ["events", "fielder_2", "not_a_column"])
    return kept.select("game_pk", "at_bat_number", "events", "fielder_2")


@query("batter_daily", with_views("pitch", pa=PA_SQL, body=daily_sql("batter")))
def _(t: Tables):
    return totals.batter_daily(t.pa)


@query("pitcher_daily", with_views("pitch", pa=PA_SQL, body=daily_sql("pitcher")))
def _(t: Tables):
    return totals.pitcher_daily(t.pa)


def _prior_query(entity: str) -> str:
    return with_views("pitch", pa=PA_SQL, **{f"{entity}_daily": daily_sql(entity)}, body=prior_sql(entity))


@query("batter_prior_totals", _prior_query("batter"))
def _(t: Tables):
    return totals.batter_prior_totals(totals.batter_daily(t.pa))


@query("pitcher_prior_totals", _prior_query("pitcher"))
def _(t: Tables):
    return totals.pitcher_prior_totals(totals.pitcher_daily(t.pa))


@query(
    "league_rates",
    with_views("pitch", pa=PA_SQL, league=LEAGUE_SQL, body=f"SELECT {', '.join(r6(c) for c in LEAGUE_COLUMNS)} FROM league"),
)
def _(t: Tables):
    return rounded(totals.league_rates(t.pa, B.LEAGUE_YEARS))


def _rates_query(entity: str, league: str | None = None) -> str:
    body = f"SELECT {entity}, game_date, {rounded_rates(entity)} FROM {entity}_rates"
    return with_views("pitch", **chain(entity, league=league), body=body)


@query("shrunken_rates_batter", _rates_query("batter"))
def _(t: Tables):
    prior = totals.batter_prior_totals(totals.batter_daily(t.pa))
    return rounded(rates.shrunken_rates_batter(prior).select("batter", "game_date", *RATES["batter"]))


@query("shrunken_rates_pitcher", _rates_query("pitcher"))
def _(t: Tables):
    prior = totals.pitcher_prior_totals(totals.pitcher_daily(t.pa))
    return rounded(rates.shrunken_rates_pitcher(prior).select("pitcher", "game_date", *RATES["pitcher"]))


@query("shrunken_rates_measured_league", _rates_query("batter", LEAGUE_SQL))
def _(t: Tables):
    league = totals.league_rates(t.pa, B.LEAGUE_YEARS)
    return rounded(plans.entity_features(t.pa, "batter", league))


@query("select_by_prefix", _rates_query("pitcher"))
def _(t: Tables):
    prior = totals.pitcher_prior_totals(totals.pitcher_daily(t.pa))
    return rounded(features.select_by_prefix(rates.shrunken_rates_pitcher(prior), "pitcher"))


@query(
    "attach_batter_stats",
    with_views("pitch", **chain("batter"), body=f"""
      SELECT game_pk, at_bat_number, pa.batter, pa.game_date, {rounded_rates("batter")}
      FROM pa LEFT JOIN batter_rates USING (batter, game_date)"""),
)
def _(t: Tables):
    joined = features.attach_batter_stats(t.pa, plans.entity_features(t.pa, "batter"))
    return rounded(joined.select("game_pk", "at_bat_number", "batter", "game_date", *RATES["batter"]))


@query(
    "attach_pitcher_stats",
    with_views("pitch", **chain("pitcher"), body=f"""
      SELECT game_pk, at_bat_number, pa.pitcher, pa.game_date, {rounded_rates("pitcher")}
      FROM pa LEFT JOIN pitcher_rates USING (pitcher, game_date)"""),
)
def _(t: Tables):
    joined = features.attach_pitcher_stats(t.pa, plans.entity_features(t.pa, "pitcher"))
    return rounded(joined.select("game_pk", "at_bat_number", "pitcher", "game_date", *RATES["pitcher"]))


PA_FEATURES_SQL = f"""
SELECT pa.*, {", ".join(f"b.{c}" for c in RATES["batter"])}, {", ".join(f"p.{c}" for c in RATES["pitcher"])},
  {PLATOON_SQL}, {HOME_SQL}
FROM pa LEFT JOIN batter_rates b ON pa.batter = b.batter AND pa.game_date = b.game_date
LEFT JOIN pitcher_rates p ON pa.pitcher = p.pitcher AND pa.game_date = p.game_date
"""


@query(
    "pa_features",
    with_views("pitch", **chain("batter", "pitcher"), featured=PA_FEATURES_SQL, body=f"""
      SELECT game_pk, at_bat_number, batter, pitcher, game_date, pa_outcome_category, is_platoon_adv, is_batter_home,
      {rounded_rates("batter")}, {rounded_rates("pitcher")} FROM featured"""),
)
def _(t: Tables):
    return rounded(
        plans.pa_features(t.pa).select(
            "game_pk", "at_bat_number", "batter", "pitcher", "game_date", C.OUTCOME_COLUMN,
            "is_platoon_adv", "is_batter_home", *RATES["batter"], *RATES["pitcher"],
        )
    )


def _in_three_loads(t: Tables, root: str) -> None:
    """History, then recent days with early corrections wrongly dated, then the rows that put those right.

    The features are brought up to date after each load; days are corrected, added late and emptied on the way.
    """
    with held(t.pa.withColumn("month", F.trunc("game_date", "month").cast("date")), "plate_appearances") as pa:
        wrong = F.col("game_pk") % 7 == 0
        late = pa.filter(wrong & (F.year("game_date") == 1997))
        moved = late.withColumn("game_date", F.date_add("game_date", 45)).withColumn("month", F.trunc("game_date", "month").cast("date"))
        recent = pa.filter(F.year("game_date") >= 1998)
        for batch, rows in {
            "history": pa.filter(~wrong & (F.year("game_date") <= 1997) | (F.year("game_date") < 1997)),
            "recent": recent.unionByName(moved),
            "corrections": late,
        }.items():
            upsert.upsert_partitions(t.spark, f"{root}/plate_appearances", rows, batch, partition="month")
            increments.update_features(t.spark, root)


@query(
    "incremental_features",
    with_views("pitch", **chain("batter", "pitcher"), featured=PA_FEATURES_SQL, body=f"""
      SELECT game_pk, at_bat_number, batter, pitcher, game_date, game_year, pa_outcome_category, is_platoon_adv,
      is_batter_home, {rounded_rates("batter")}, {rounded_rates("pitcher")} FROM featured"""),
)
def _(t: Tables):
    """Features kept up to date over three loads equal those computed at once."""
    root = scratch_path(t.spark, "increments")
    _in_three_loads(t, root)
    return rounded(
        increments.load_features(t.spark, root).select(
            "game_pk", "at_bat_number", "batter", "pitcher", "game_date", "game_year", C.OUTCOME_COLUMN,
            "is_platoon_adv", "is_batter_home", *RATES["batter"], *RATES["pitcher"],
        )
    )


_carried = ", ".join(f'CAST(count(*) FILTER (WHERE {flag}) AS BIGINT) AS "{name}"' for name, flag in totals.COUNTED_FLAGS.items())


@query(
    "carried_totals",
    with_views("pitch", pa=PA_SQL, months="""
      SELECT DISTINCT CAST(date_trunc('month', game_date) AS DATE) AS m FROM pa WHERE pitcher IS NOT NULL""", body=f"""
      SELECT pitcher, m AS game_month, {_carried} FROM pa JOIN (SELECT m FROM months UNION
        SELECT CAST(max(m) + INTERVAL 1 MONTH AS DATE) FROM months) ON game_date < m
      WHERE pitcher IS NOT NULL GROUP BY ALL"""),
)
def _(t: Tables):
    """Pitchers' totals carried into each month, after three loads."""
    root = scratch_path(t.spark, "increments")
    _in_three_loads(t, root)
    carry = increments.load_carry(t.spark, root, "pitcher")
    return carry.select("pitcher", "game_month", *increments.COUNTS)


@query(
    "sum_horizontal",
    with_views("pitch", body=f"""
      SELECT game_pk, at_bat_number, batter, pitcher, CAST({' + '.join(f'coalesce({c}, 0)' for c in C.FIELDER_COLUMNS)} AS BIGINT)
        AS fielder_sum FROM pitch"""),
)
def _(t: Tables):
    from priorline.functions.numbers import sum_horizontal

    total = sum_horizontal(*C.FIELDER_COLUMNS).alias("fielder_sum")
    return t.pitch.select("game_pk", "at_bat_number", "batter", "pitcher", total)


@query(
    "unpivot_ids",
    with_views("pitch", body=" UNION ALL ".join(
        f"SELECT game_pk, game_year, inning, '{c}' AS position_num_str, {c} AS player_id FROM pitch"
        for c in C.FIELDER_COLUMNS)),
)
def _(t: Tables):
    return totals.unpivot_ids(t.pitch)


INNINGS_SQL = f"""
SELECT player_id, game_year, count(DISTINCT (game_pk, inning)) AS total_innings_played FROM (
  {" UNION ALL ".join(f"SELECT game_pk, game_year, inning, {c} AS player_id FROM pa" for c in C.FIELDER_COLUMNS)})
WHERE player_id IS NOT NULL GROUP BY player_id, game_year
"""


@query("merged_innings", with_views("pitch", pa=PA_SQL, body=INNINGS_SQL))
def _(t: Tables):
    """Innings from the bitmaps of overlapping loads: three that share out the seasons, and three seasons once more."""
    pa = stored(t.pa, "plate_appearances")
    loads = [totals.innings_bitmaps(pa.filter(F.col("game_year") % 3 == k)) for k in range(3)]
    again = totals.innings_bitmaps(pa.filter(F.col("game_year").between(1996, 1998)))
    return totals.counted_innings(totals.merged_bitmaps(*loads, again))


@query("distinct_innings", with_views("pitch", pa=PA_SQL, body=INNINGS_SQL))
def _(t: Tables):
    return totals.distinct_innings(t.pa)


GRID_SQL = """
SELECT player_id, CAST(year AS INT) AS year FROM (SELECT DISTINCT player_id FROM oaa), generate_series(1995, 2001) g(year)
"""
GRID_FACT_SQL = """
SELECT grid.player_id, grid.year, CAST(coalesce(outs_above_average, 0) AS BIGINT) AS outs_above_average
FROM grid LEFT JOIN oaa ON grid.player_id = oaa.player_id AND grid.year = oaa.year
"""
HISTORY_SQL = """
SELECT grid_fact.*, coalesce(total_innings_played, 0) AS total_innings_played FROM grid_fact
LEFT JOIN innings ON grid_fact.player_id = innings.player_id AND grid_fact.year = innings.game_year
"""
DEFENSE_SQL = """
SELECT *, CASE WHEN cumulative_innings_prior = 0 THEN
    CASE WHEN cumulative_oaa_prior = 0 THEN 0.0 WHEN cumulative_oaa_prior > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END
  ELSE cumulative_oaa_prior / cumulative_innings_prior END AS outs_above_average_per_inning
FROM (SELECT *, CAST(coalesce(sum(outs_above_average) OVER before, 0) AS BIGINT) AS cumulative_oaa_prior,
    CAST(coalesce(sum(total_innings_played) OVER before, 0) AS BIGINT) AS cumulative_innings_prior
  FROM history WINDOW before AS (PARTITION BY player_id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""
# infinities are shown as text so that they can be compared
_RATIO = "outs_above_average_per_inning"
SHOWN_SQL = f"""SELECT player_id, year, outs_above_average, total_innings_played, cumulative_oaa_prior,
  cumulative_innings_prior, {r6(f"CASE WHEN isinf({_RATIO}) THEN NULL ELSE {_RATIO} END", _RATIO)},
  CASE WHEN isinf({_RATIO}) THEN CASE WHEN {_RATIO} > 0 THEN 'inf' ELSE '-inf' END END AS infinite FROM defense"""
DEFENSE_CTES = {
    "pa": PA_SQL, "innings": INNINGS_SQL, "grid": GRID_SQL, "grid_fact": GRID_FACT_SQL,
    "history": HISTORY_SQL, "defense": DEFENSE_SQL,
}


def _shown(df):
    ratio = F.col(_RATIO)
    text = F.when(ratio == float("inf"), F.lit("inf")).when(ratio == -float("inf"), F.lit("-inf"))
    return df.withColumn("infinite", text).withColumn(_RATIO, F.when(F.abs(ratio) < float("inf"), ratio))


def _grid(t: Tables):
    return totals.entity_year_grid(t.view("oaa"), B.FIRST_YEAR, B.LAST_YEAR)


@query("entity_year_grid", with_views("oaa", body=GRID_SQL))
def _(t: Tables):
    return _grid(t)


@query("grid_left_fact", with_views("oaa", grid=GRID_SQL, body=GRID_FACT_SQL))
def _(t: Tables):
    return totals.grid_left_fact(_grid(t), t.view("oaa"))


@query(
    "grid_left_innings",
    with_views("pitch", "oaa", pa=PA_SQL, innings=INNINGS_SQL, grid=GRID_SQL, grid_fact=GRID_FACT_SQL, body=HISTORY_SQL),
)
def _(t: Tables):
    return totals.grid_left_innings(totals.grid_left_fact(_grid(t), t.view("oaa")), totals.distinct_innings(t.pa))


@query("player_prior_defense", with_views("pitch", "oaa", **DEFENSE_CTES, body=SHOWN_SQL))
def _(t: Tables):
    history = totals.grid_left_innings(
        totals.grid_left_fact(_grid(t), t.view("oaa")), totals.distinct_innings(t.pa)
    )
    return rounded(_shown(totals.player_prior_defense(history)))


@query("defense_features", with_views("pitch", "oaa", **DEFENSE_CTES, body=SHOWN_SQL))
def _(t: Tables):
    return rounded(_shown(plans.defense_features(t.view("oaa"), t.pa, B.FIRST_YEAR, B.LAST_YEAR)))


@query(
    "lag_fill",
    with_views("oaa", grid=GRID_SQL, grid_fact=GRID_FACT_SQL, body="""
      SELECT *, coalesce(lag(outs_above_average) OVER (PARTITION BY player_id ORDER BY year), 0) AS outs_above_average_lag
      FROM grid_fact"""),
)
def _(t: Tables):
    return totals.lag_fill(totals.grid_left_fact(_grid(t), t.view("oaa")), "outs_above_average", ["player_id"], "year")


@query(
    "fill_null_nan",
    """SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber < 7 THEN l_partkey END, 0) AS filled_null,
      round(CASE WHEN l_tax = 0 THEN 0.0 ELSE l_discount / l_tax END, 6) + 0.0 AS filled_nan FROM lineitem""",
)
def _(t: Tables):
    from priorline.functions.numbers import fill_nan, fill_null

    line = t.table("lineitem")
    ratio = F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.try_divide("l_discount", "l_tax"))
    return rounded(
        line.select(
            "l_orderkey", "l_linenumber",
            fill_null(F.when(F.col("l_linenumber") < 7, F.col("l_partkey")), 0).alias("filled_null"),
            fill_nan(ratio).alias("filled_nan"),
        )
    )


FACTORS_SQL = " UNION ALL ".join(
    f"SELECT venue_id, venue_name, main_team_id, name_display_club, CAST({y} AS INT) AS year, "
    f"metric_value_{y} AS park_factor FROM park_wide"
    for y in range(B.FIRST_YEAR, B.LAST_YEAR + 1)
)
NAMED_FACTORS_SQL = "SELECT factors.*, team_abbr FROM factors JOIN teams ON name_display_club = team_name"
LAGGED_SQL = """
SELECT DISTINCT team_abbr, year + 1 AS year, coalesce(park_factor, 100.0) AS park_factor_input FROM named_factors
"""


@query("wide_to_long_factors", with_views("park_wide", body=FACTORS_SQL))
def _(t: Tables):
    return totals.wide_to_long_factors(t.view("park_wide"))


@query("dim_lookup_inner", with_views("park_wide", "teams", factors=FACTORS_SQL, body=NAMED_FACTORS_SQL))
def _(t: Tables):
    return features.dim_lookup_inner(totals.wide_to_long_factors(t.view("park_wide")), t.view("teams"))


@query(
    "lagged_year_join",
    with_views("pitch", "park_wide", "teams", factors=FACTORS_SQL, named_factors=NAMED_FACTORS_SQL, lagged=LAGGED_SQL,
      body="""SELECT game_pk, at_bat_number, batter, pitcher, home_team, game_year, park_factor_input
        FROM pitch LEFT JOIN lagged ON home_team = team_abbr AND game_year = lagged.year"""),
)
def _(t: Tables):
    named = features.dim_lookup_inner(totals.wide_to_long_factors(t.view("park_wide")), t.view("teams"))
    joined = features.lagged_year_join(t.pitch, named, "game_year")
    return joined.select("game_pk", "at_bat_number", "batter", "pitcher", "home_team", "game_year", "park_factor_input")


def _role_sum_sql(source: str, ratings: str, keys: str, year: str) -> str:
    joins = " ".join(
        f"LEFT JOIN {ratings} r{k} ON m.fielder_{k} = r{k}.player_id AND m.{year} = r{k}.year" for k in range(2, 10)
    )
    total = " + ".join(f"coalesce(r{k}.outs_above_average_per_inning, 0)" for k in range(2, 10))
    return f"SELECT {keys}, {total} AS team_defense_oaa_input FROM {source} m {joins}"


ROLE_SUM_SQL = with_views(
    "pitch", "ratings", pa=PA_SQL,
    sums=_role_sum_sql("pa", "ratings", "game_pk, at_bat_number, m.game_year AS game_year", "game_year"),
    body=f"SELECT game_pk, at_bat_number, game_year, {r6('team_defense_oaa_input')} FROM sums",
)


@query("role_playing_sum", ROLE_SUM_SQL)
def _(t: Tables):
    summed = features.role_playing_sum(t.pa, t.view("ratings"), year="game_year")
    return rounded(summed.select("game_pk", "at_bat_number", "game_year", "team_defense_oaa_input"))


TRAINING_KEYS = ["game_pk", "batter", "pitcher", "home_team", "is_batter_home", "game_date", "year",
                 "pa_outcome_category", "is_platoon_adv"]
TRAINING_CTES = {
    **DEFENSE_CTES,
    **chain("batter", "pitcher"),
    "featured": PA_FEATURES_SQL,
    "factors": FACTORS_SQL,
    "named_factors": NAMED_FACTORS_SQL,
    "lagged": LAGGED_SQL,
    "finite_defense": """SELECT player_id, year, CASE WHEN isinf(outs_above_average_per_inning) THEN NULL
      ELSE outs_above_average_per_inning END AS outs_above_average_per_inning FROM defense""",
    "kept": "SELECT *, game_year AS year FROM featured WHERE inning <= 3 AND game_year IN (1998, 1999)",
    "training": _role_sum_sql("kept", "finite_defense", "m.*", "year"),
    "training_rows": """SELECT training.*, park_factor_input FROM training
      LEFT JOIN lagged ON home_team = team_abbr AND training.year = lagged.year""",
}
_training_measures = [*RATES["batter"], *RATES["pitcher"], "team_defense_oaa_input", "park_factor_input"]


def training(t: Tables):
    """The training table over the given data.

    Plate appearances and defence are stored tables in the pipeline, so they are stored here.
    """
    pa = stored(t.pa, "plate_appearances")
    defense = stored(plans.defense_features(t.view("oaa"), pa, B.FIRST_YEAR, B.LAST_YEAR), "defense")
    factors = totals.wide_to_long_factors(t.view("park_wide"))
    return plans.training_table(plans.pa_features(pa), defense, factors, t.view("teams"), B.TRAINING_YEARS)


@query(
    "training_table",
    with_views("pitch", "oaa", "park_wide", "teams", **TRAINING_CTES,
      body=f"SELECT {', '.join(TRAINING_KEYS)}, {', '.join(r6(c) for c in _training_measures)} FROM training_rows"),
)
def _(t: Tables):
    return rounded(training(t))


# --- unions, de-duplication, upserts ----------------------------------------------------------
SPLIT = "DATE '2000-01-01'"


def _history_and_new(t: Tables):
    """Overlapping loads: the second half-year of 1999 arrives again with another pitcher hand."""
    pa = t.pa.select("game_pk", "at_bat_number", "pitch_number", "events", "p_throws", "game_date")
    history = pa.filter(F.col("game_date") < F.lit("2000-01-01").cast("date"))
    new = pa.filter(F.col("game_date") >= F.lit("1999-07-01").cast("date")).withColumn("p_throws", F.lit("S"))
    return history, new


MERGED_SQL = with_views(
    "pitch", pa=PA_SQL,
    body="""SELECT game_pk, at_bat_number, pitch_number, events, game_date,
      CASE WHEN game_date >= DATE '1999-07-01' THEN 'S' ELSE p_throws END AS p_throws FROM pa""",
)


@query("dedupe_by_key", MERGED_SQL)
def _(t: Tables):
    return sets.dedupe_by_key(*_history_and_new(t))


@query("upsert_events", MERGED_SQL)
def _(t: Tables):
    return sets.upsert_events(*_history_and_new(t))


@query(
    "union_relaxed",
    """SELECT l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS n FROM lineitem
      UNION ALL SELECT o_orderkey, o_custkey FROM orders""",
)
def _(t: Tables):
    narrow = t.table("lineitem").selectExpr("l_orderkey as id", "l_linenumber as n")
    wide = t.table("orders").selectExpr("o_custkey as n", "o_orderkey as id")
    return sets.union_relaxed(narrow, wide)


@query("distinct_rows", "SELECT DISTINCT l_suppkey, l_linenumber, l_returnflag FROM lineitem")
def _(t: Tables):
    return sets.distinct_rows(t.table("lineitem").select("l_suppkey", "l_linenumber", "l_returnflag"))


@query(
    "id_set_ops",
    """SELECT id, true AS missing FROM (SELECT l_partkey AS id FROM lineitem UNION SELECT l_suppkey FROM lineitem)
        WHERE id NOT IN (SELECT c_custkey FROM customer)
      UNION ALL SELECT id, false FROM (SELECT l_partkey AS id FROM lineitem UNION SELECT l_suppkey FROM lineitem)""",
)
def _(t: Tables):
    line = t.table("lineitem")
    ids = sets.id_union(line.selectExpr("l_partkey as id"), line.selectExpr("l_suppkey as id"))
    missing = sets.id_difference(ids, t.table("customer").selectExpr("c_custkey as id"))
    return missing.withColumn("missing", F.lit(True)).unionByName(ids.withColumn("missing", F.lit(False)))


@query(
    "sort_keys",
    with_views("pitch", pa=PA_SQL, body="SELECT batter, game_date, count(*) AS n FROM pa GROUP BY 1, 2 ORDER BY 1, 2"),
)
def _(t: Tables):
    counts = t.pa.groupBy("batter", "game_date").agg(F.count(F.lit(1)).alias("n"))
    from priorline.operators.views import sort_keys

    return sort_keys(counts, ["batter", "game_date"])
