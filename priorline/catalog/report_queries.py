"""Trial histograms, probabilities, odds and the views over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from priorline import constants as C
from priorline.catalog.bindings import NUM_TRIALS, Tables, with_views
from priorline.catalog.registry import query, r6, rounded
from priorline.functions import odds
from priorline.operators import trials, views

STATS = ["H", "BB", "HR", "R"]
HISTOGRAM_SQL = """
SELECT game_pk, inning, team, stat, CAST(least(coalesce(v, 0), 5) AS INT) AS bin, count(*) AS n FROM (
  {0}) GROUP BY ALL
""".format(" UNION ALL ".join(f"SELECT game_pk, inning, team, '{s}' AS stat, {s} AS v FROM trials" for s in STATS))


def priced(columns: str, source: str) -> str:
    return f"""
    SELECT {columns}, CASE WHEN bin < 5 THEN CAST(bin AS VARCHAR) ELSE '5+' END AS number_bin, probability,
      CASE WHEN probability > 0 THEN 1.0 / probability END AS decimal_odds,
      CASE WHEN probability = 1 THEN -99999 WHEN probability <= 0 OR probability > 1 THEN NULL
        WHEN probability < 1e-9 THEN 99999
        WHEN probability < 0.5 THEN CAST(round_even(100.0 / probability - 100, 0) AS BIGINT)
        ELSE CAST(round_even(probability / (1 - probability) * -100, 0) AS BIGINT) END AS american_odds
    FROM (SELECT *, n / {NUM_TRIALS}.0::DOUBLE AS probability FROM ({source}))"""


GRID = "generate_series(1, 3) i(inning), (VALUES ('H'), ('BB'), ('HR'), ('R')) s(stat), generate_series(0, 5) b(bin)"
TEAM_SQL = priced(
    "game_pk, inning, team, team_name, stat",
    f"""SELECT g.game_pk, i.inning, concat(upper(t.team[1]), t.team[2:]) AS team,
        concat(upper(t.team[1]), t.team[2:], ' Team') AS team_name, s.stat, b.bin, coalesce(h.n, 0) AS n
      FROM (SELECT DISTINCT game_pk FROM trials) g, {GRID}, (VALUES ('away'), ('home')) t(team)
      LEFT JOIN histogram h ON h.game_pk = g.game_pk AND h.inning = i.inning AND h.team = t.team
        AND h.stat = s.stat AND h.bin = b.bin""",
)
TOTAL_SQL = priced(
    "game_pk, inning, team, team_name, stat",
    f"""SELECT g.game_pk, i.inning, 'Total' AS team, 'Combined Total' AS team_name, s.stat, b.bin,
        CAST(coalesce(sum(h.n), 0) AS BIGINT) AS n
      FROM (SELECT DISTINCT game_pk FROM trials) g, {GRID}
      LEFT JOIN histogram h ON h.game_pk = g.game_pk AND h.inning = i.inning AND h.stat = s.stat AND h.bin = b.bin
      GROUP BY ALL""",
)
SHOWN = ["game_pk", "inning", "team", "team_name", "stat", "number_bin"]
SHOWN_SQL = f"{', '.join(SHOWN)}, {r6('probability')}, {r6('decimal_odds')}, american_odds"
REPORT = {"histogram": HISTOGRAM_SQL, "team_report": TEAM_SQL, "total_report": TOTAL_SQL,
          "report": "SELECT * FROM team_report UNION ALL SELECT * FROM total_report"}


def histogram(t: Tables):
    return trials.outcome_histogram(t.view("trials"), innings=None)


def report(t: Tables):
    return trials.probabilities_and_odds(t.view("trials"), NUM_TRIALS)


@query(
    "outcome_histogram",
    with_views("trials", histogram=HISTOGRAM_SQL, body="SELECT * FROM histogram WHERE inning BETWEEN 1 AND 3"),
)
def _(t: Tables):
    return trials.outcome_histogram(t.view("trials"))


@query("team_probabilities", with_views("trials", **REPORT, body=f"SELECT {SHOWN_SQL} FROM team_report"))
def _(t: Tables):
    return rounded(trials.team_probabilities(histogram(t), NUM_TRIALS))


@query("total_probabilities", with_views("trials", **REPORT, body=f"SELECT {SHOWN_SQL} FROM total_report"))
def _(t: Tables):
    return rounded(trials.total_probabilities(histogram(t), NUM_TRIALS))


@query("probabilities_and_odds", with_views("trials", **REPORT, body=f"SELECT {SHOWN_SQL} FROM report"))
def _(t: Tables):
    return rounded(trials.report_order(report(t)))


@query(
    "named_report",
    with_views("trials", "games", **REPORT, body=f"""
      SELECT r.game_pk, inning, team, stat, number_bin, {r6('probability')},
        CASE team WHEN 'Total' THEN 'Combined Total' WHEN 'Away' THEN coalesce(away_name, 'Away Team')
          ELSE coalesce(home_name, 'Home Team') END AS team_name
      FROM report r LEFT JOIN games g ON r.game_pk = g.game_pk"""),
)
def _(t: Tables):
    named = trials.probabilities_and_odds(t.view("trials"), NUM_TRIALS, t.view("games"))
    return rounded(named.select("game_pk", "inning", "team", "stat", "number_bin", "probability", "team_name"))


@query(
    "empirical_distribution",
    with_views("trials", histogram=HISTOGRAM_SQL, body=f"""
      SELECT g.game_pk, g.inning, g.team, g.stat, CASE WHEN b.bin < 5 THEN CAST(b.bin AS VARCHAR) ELSE '5+' END AS number,
        {r6('coalesce(h.n, 0) / g.total', 'probability')}
      FROM (SELECT game_pk, inning, team, stat, sum(n) AS total FROM histogram GROUP BY ALL) g, generate_series(0, 5) b(bin)
      LEFT JOIN histogram h ON h.game_pk = g.game_pk AND h.inning = g.inning AND h.team = g.team AND h.stat = g.stat
        AND h.bin = b.bin"""),
)
def _(t: Tables):
    return rounded(trials.empirical_distribution(t.view("trials")))


PROBABILITY_SQL = "SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_quantity) AS INT) / 40.0::DOUBLE - 0.1 AS p FROM lineitem"


def _probability(t: Tables):
    return t.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.floor("l_quantity").cast("int") / F.lit(40.0) - F.lit(0.1)).alias("p")
    )


@query(
    "decimal_odds",
    f"SELECT l_orderkey, l_linenumber, l_partkey, {r6('CASE WHEN p > 0 THEN 1 / p END', 'odds')} FROM ({PROBABILITY_SQL})",
)
def _(t: Tables):
    return rounded(_probability(t).select("l_orderkey", "l_linenumber", "l_partkey", odds.decimal_odds(F.col("p")).alias("odds")))


@query(
    "american_odds",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p = 1 THEN -99999 WHEN p <= 0 OR p > 1 THEN NULL
        WHEN p < 1e-9 THEN 99999 WHEN p < 0.5 THEN CAST(round_even(100.0 / p - 100, 0) AS BIGINT)
        ELSE CAST(round_even(p / (1 - p) * -100, 0) AS BIGINT) END AS odds FROM ({PROBABILITY_SQL})""",
)
def _(t: Tables):
    return _probability(t).select("l_orderkey", "l_linenumber", "l_partkey", odds.american_odds(F.col("p")).alias("odds"))


@query(
    "bin_label",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(least(l_linenumber, 5) AS INT) AS bin,
      CASE WHEN l_linenumber < 5 THEN CAST(l_linenumber AS VARCHAR) ELSE '5+' END AS label FROM lineitem""",
)
def _(t: Tables):
    binned = odds.histogram_bin(F.col("l_linenumber"), 5)
    return t.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", binned.alias("bin"), odds.bin_label(binned, 5).alias("label")
    )


@query(
    "team_label",
    with_views("trials", body="""
      SELECT game_pk, trial_id, CASE team WHEN 'away' THEN 'Away' ELSE 'Home' END AS team,
        CASE WHEN H IS NULL THEN CASE team WHEN 'away' THEN 'Away Team' ELSE 'Home Team' END ELSE concat('Club ', H) END AS team_name
      FROM trials"""),
)
def _(t: Tables):
    name = F.concat(F.lit("Club "), F.col("H").cast("string"))
    return t.view("trials").select(
        "game_pk", "trial_id", odds.team_label(F.col("team")).alias("team"), odds.display_name(name, F.col("team")).alias("team_name")
    )


@query(
    "parse_inning_key",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_linenumber END AS inning FROM lineitem""",
)
def _(t: Tables):
    number = F.col("l_linenumber").cast("string")
    key = (
        F.when(F.col("l_partkey") % 5 == 0, F.lit("extra"))
        .when(F.col("l_partkey") % 5 == 1, number)
        .otherwise(F.concat(F.lit("inning_"), number))
    )
    return t.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", odds.inning_number(key).alias("inning"))


# --- views over the report ------------------------------------------------------------------------
@query(
    "filter_results",
    with_views("trials", **REPORT, body=f"""
      SELECT {SHOWN_SQL} FROM report WHERE inning = 2 AND stat = 'H' AND probability >= 0.001
        AND (team_name IN ('Away Team') OR team = 'Total')"""),
)
def _(t: Tables):
    return rounded(
        views.filter_results(report(t), inning=2, stat="H", team_names=["Away Team"], min_probability=0.001)
    )


@query(
    "odds_view",
    with_views("trials", **REPORT, body=f"""
      SELECT {SHOWN_SQL}, {r6('round(probability * 100, 2)', 'probability_pct')} FROM report
      WHERE decimal_odds > 1 AND decimal_odds < 1000"""),
)
def _(t: Tables):
    return rounded(views.odds_view(report(t)))


@query(
    "drop_rename",
    with_views("trials", **REPORT, body="""
      SELECT game_pk, inning, team, team_name AS "Team Name", stat, number_bin AS "Count",
        round(probability * 100, 2) + 0.0 AS "Probability (%)", round(decimal_odds, 2) + 0.0 AS "Decimal Odds",
        american_odds AS "American Odds" FROM report"""),
)
def _(t: Tables):
    return views.drop_rename(report(t))


@query(
    "display_rounding",
    with_views("trials", **REPORT, body="""
      SELECT game_pk, inning, team, stat, number_bin, round(probability * 100, 2) + 0.0 AS probability_pct,
        round(decimal_odds, 2) + 0.0 AS decimal_odds FROM report"""),
)
def _(t: Tables):
    shown = views.display_rounding(report(t))
    return shown.select("game_pk", "inning", "team", "stat", "number_bin", "probability_pct", "decimal_odds")


@query(
    "summary_by_team_stat",
    with_views("trials", **REPORT, body=f"""
      SELECT team, stat, {r6('avg(probability)', 'avg_probability')}, {r6('max(probability)', 'max_probability')},
        {r6('avg(decimal_odds)', 'avg_decimal_odds')}, count(*) AS count FROM report GROUP BY team, stat"""),
)
def _(t: Tables):
    return rounded(views.summary_by_team_stat(report(t)))


@query(
    "heatmap_pivot",
    with_views("trials", **REPORT, body="SELECT game_pk, inning, team, stat, " + ", ".join(
        r6(f"coalesce(max(probability) FILTER (WHERE number_bin = '{b}'), 0)", f'"{b}"') for b in C.BIN_LABELS)
      + " FROM report GROUP BY game_pk, inning, team, stat"),
)
def _(t: Tables):
    return rounded(views.heatmap_pivot(report(t)))


@query("distinct_values", with_views("trials", **REPORT, body="SELECT DISTINCT stat FROM report"))
def _(t: Tables):
    return views.distinct_values(report(t), "stat")


@query(
    "head_n",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20",
)
def _(t: Tables):
    orders = t.table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return views.head_n(orders, 20, ["o_totalprice", "o_orderkey"])
