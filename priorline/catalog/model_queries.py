"""Scaling, scoring, fitting and data checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from priorline import constants as C
from priorline.catalog.bindings import PA_SQL, Tables, with_views
from priorline.catalog.event_queries import TRAINING_CTES, training
from priorline.catalog.registry import query, r6, rounded
from priorline.catalog.serving_queries import (
    MATCHUP_KEYS,
    MATCHUPS_SQL,
    SERVING_CTES,
    SERVING_VIEWS,
    serving_tables,
)
from priorline.operators import estimate, model, serving
from priorline.plans import features, scoring
from priorline.session import stored

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
N_CLASSES = 8
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def line_rows(t: Tables):
    """Line items with their measures, two 0/1 columns and a class."""
    return t.table("lineitem").select(
        *KEYS, *MEASURES,
        (F.col("l_returnflag") == "R").cast("int").alias("is_returned"),
        (F.col("l_linestatus") == "O").cast("int").alias("is_open"),
        (F.col("l_partkey") % N_CLASSES).cast("int").alias("outcome"),
    )


LINES_SQL = f"""
SELECT {', '.join(KEYS)}, {', '.join(MEASURES)}, CAST(l_returnflag = 'R' AS INT) AS is_returned,
  CAST(l_linestatus = 'O' AS INT) AS is_open, CAST(l_partkey % 8 AS INT) AS outcome FROM lineitem
"""
BINARY = ["is_returned", "is_open"]
SCALER_SQL = "SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}" for c in MEASURES
) + " FROM lines"
SCALED_SQL = f"""
SELECT lines.*, {', '.join(f'({c} - m_{c}) / s_{c} AS {c}_z' for c in MEASURES)},
  {', '.join(f'CAST({c} AS DOUBLE) AS {c}_z' for c in BINARY)} FROM lines, scaler
"""
Z_NAMES = [f"{c}_z" for c in [*MEASURES, *BINARY]]


def beta(k: int, j: int) -> float:
    """A small coefficient pattern, zero for the last class."""
    return 0.0 if k == N_CLASSES - 1 else ((3 * k + 5 * j) % 7 - 3) / 4.0


def intercept(k: int) -> float:
    return 0.0 if k == N_CLASSES - 1 else (k % 3 - 1) / 2.0


def parameter_rows(t: Tables, n_predictors: int, classes: int = N_CLASSES):
    """The coefficient pattern as a long table."""
    rows = [("intercepts", None, k, intercept(k)) for k in range(classes)]
    rows += [("betas", j, k, beta(k, j)) for k in range(classes) for j in range(n_predictors)]
    return t.spark.createDataFrame(rows, "param string, predictor int, category int, value double")


def softmax_sql(source: str, names: list[str], keep: str) -> str:
    linear = [
        " + ".join([f"({intercept(k)!r}::DOUBLE)", *[f"{n} * ({beta(k, j)!r}::DOUBLE)" for j, n in enumerate(names)]])
        for k in range(N_CLASSES)
    ]
    scores = ", ".join(f"{expr} AS mu{k}" for k, expr in enumerate(linear))
    top = ", ".join(f"mu{k}" for k in range(N_CLASSES))
    weights = ", ".join(f"exp(mu{k} - top) AS e{k}" for k in range(N_CLASSES))
    total = " + ".join(f"e{k}" for k in range(N_CLASSES))
    shown = ", ".join(r6(f"e{k} / ({total})", f"p_{k}") for k in range(N_CLASSES))
    return (
        f"SELECT {keep}, {shown} FROM (SELECT *, {weights} FROM (SELECT *, greatest({top}) AS top "
        f"FROM (SELECT *, {scores} FROM {source})))"
    )


@query(
    "posterior_mean",
    """SELECT 'betas' AS param, CAST(i - 1 AS INT) AS predictor, CAST(vec_id % 8 AS INT) AS category,
        round(avg(CAST(embedding[i] AS DOUBLE)), 6) + 0.0 AS value
      FROM embeddings, unnest(generate_series(1, len(embedding))) AS u(i) GROUP BY ALL""",
)
def _(t: Tables):
    posterior = t.table("embeddings").select(
        F.lit("betas").alias("param"), F.col("label").alias("chain"), F.col("vec_id").alias("draw"),
        (F.col("vec_id") % 8).cast("int").alias("category"), F.posexplode("embedding").alias("predictor", "value"),
    )
    return rounded(model.posterior_mean(posterior.withColumn("value", F.col("value").cast("double"))))


@query(
    "scaler_fit",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r6(f'avg({c})', 'mean')}, {r6(f'stddev_pop({c})', 'scale')} FROM lineitem" for c in MEASURES),
)
def _(t: Tables):
    return rounded(model.scaler_fit(line_rows(t), MEASURES))


@query(
    "standardize",
    with_views(lines=LINES_SQL, scaler=SCALER_SQL, scaled=SCALED_SQL,
      body=f"SELECT {', '.join(KEYS)}, {', '.join(r6(z) for z in Z_NAMES)} FROM scaled"),
)
def _(t: Tables):
    lines = line_rows(t)
    scaled = model.standardize(lines, model.scaler_fit(lines, MEASURES), MEASURES, BINARY)
    return rounded(scaled.select(*KEYS, *Z_NAMES))


@query(
    "softmax_scores",
    with_views(lines=LINES_SQL, scaler=SCALER_SQL, scaled=SCALED_SQL, body=softmax_sql("scaled", Z_NAMES, ", ".join(KEYS))),
)
def _(t: Tables):
    lines = line_rows(t)
    scaled = model.standardize(lines, model.scaler_fit(lines, MEASURES), MEASURES, BINARY)
    coefficients = model.load_coefficients(parameter_rows(t, len(Z_NAMES)), len(Z_NAMES), N_CLASSES)
    scored = model.softmax_scores(scaled, Z_NAMES, coefficients)
    return rounded(scored.select(*KEYS, *[f"p_{k}" for k in range(N_CLASSES)]))


@query(
    "reference_category",
    with_views(lines=LINES_SQL, scaler=SCALER_SQL, scaled=SCALED_SQL, body=softmax_sql("scaled", Z_NAMES, ", ".join(KEYS))),
)
def _(t: Tables):
    lines = line_rows(t)
    scaled = model.standardize(lines, model.scaler_fit(lines, MEASURES), MEASURES, BINARY)
    short = parameter_rows(t, len(Z_NAMES), N_CLASSES - 1)
    arrays = model.coefficient_row(short, len(Z_NAMES), N_CLASSES - 1)
    full = model.reference_category(arrays, N_CLASSES)
    scored = model.softmax_scores(scaled, Z_NAMES, model.read_coefficients(full))
    return rounded(scored.select(*KEYS, *[f"p_{k}" for k in range(N_CLASSES)]))


@query(
    "design_matrix",
    with_views(lines=LINES_SQL, scaler=SCALER_SQL, scaled=SCALED_SQL,
      body=f"SELECT {', '.join(r6(z) for z in Z_NAMES)}, outcome AS label FROM scaled"),
)
def _(t: Tables):
    return rounded(features.design_matrix(line_rows(t), MEASURES, BINARY, "outcome"))


DESIGN_Z = [f"{c}_z" for c in [*C.CONTINUOUS_COLUMNS, *C.BINARY_COLUMNS]]
COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in [*C.CONTINUOUS_COLUMNS, *C.BINARY_COLUMNS])
TRAINING_SCALER_SQL = "SELECT " + ", ".join(
    f"avg({c}) AS \"m_{c}\", stddev_pop({c}) AS \"s_{c}\"" for c in C.CONTINUOUS_COLUMNS
) + " FROM complete"


@query(
    "training_design_matrix",
    with_views("pitch", "oaa", "park_wide", "teams", **TRAINING_CTES,
      complete=f"SELECT * FROM training_rows WHERE {COMPLETE}", fitted=TRAINING_SCALER_SQL,
      body=f"""SELECT {', '.join(f'round(({c} - "m_{c}") / (CASE WHEN "s_{c}" = 0 THEN 1.0 ELSE "s_{c}" END), 6) + 0.0 AS {c}_z' for c in C.CONTINUOUS_COLUMNS)},
        {', '.join(f'CAST({c} AS DOUBLE) AS {c}_z' for c in C.BINARY_COLUMNS)}, pa_outcome_category AS label
        FROM complete, fitted"""),
)
def _(t: Tables):
    return rounded(features.design_matrix(stored(training(t), "training")))


@query(
    "scaler_check",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r6(f'avg({c})', 'mean')}, {r6(f'stddev_pop({c})', 'deviation')} FROM lineitem"
        for c in MEASURES),
)
def _(t: Tables):
    """Unscaled columns are all reported; scaled ones are not (checked by the second part)."""
    lines = line_rows(t)
    scaled = model.standardize(lines, model.scaler_fit(lines, MEASURES), MEASURES, BINARY)
    offenders = model.scaler_check(scaled, [f"{c}_z" for c in MEASURES])
    return rounded(model.scaler_check(lines, MEASURES).unionByName(offenders))


@query(
    "value_counts",
    with_views("pitch", pa=PA_SQL, body="SELECT pa_outcome_category, count(*) AS count FROM pa GROUP BY 1 ORDER BY 1"),
)
def _(t: Tables):
    return model.value_counts(t.pa, C.OUTCOME_COLUMN).orderBy(C.OUTCOME_COLUMN)


@query(
    "contiguous_classes",
    with_views("pitch", pa=PA_SQL, body="""
      SELECT count(DISTINCT pa_outcome_category) AS n_classes,
        min(pa_outcome_category) = 0 AND max(pa_outcome_category) = count(DISTINCT pa_outcome_category) - 1 AS contiguous
      FROM pa"""),
)
def _(t: Tables):
    return model.contiguous_classes(t.pa, C.OUTCOME_COLUMN)


@query(
    "describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count({c}) AS count, {r6(f'avg({c})', 'mean')}, {r6(f'stddev_samp({c})', 'std')},
        min({c}) AS min, {r6(f'quantile_cont({c}, 0.25)', 'q25')}, {r6(f'quantile_cont({c}, 0.5)', 'q50')},
        {r6(f'quantile_cont({c}, 0.75)', 'q75')}, max({c}) AS max FROM lineitem""" for c in MEASURES)
    + " UNION ALL SELECT 'absent', 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL",
)
def _(t: Tables):
    lines = t.table("lineitem").withColumn("absent", F.lit(None).cast("double"))
    return rounded(model.describe(lines, [*MEASURES, "absent"]))


@query(
    "fit_outcome_model",
    with_views(lines=LINES_SQL, body="""SELECT outcome AS category, count(*) AS n, true AS calibrated FROM lines
      WHERE outcome IS NOT NULL AND """ + " AND ".join(f"{c} IS NOT NULL" for c in [*MEASURES, *BINARY]) + " GROUP BY 1"),
)
def _(t: Tables):
    """Rows per class, and whether the fitted model gives the class its share of them.

    Intercepts carry no penalty, so at the optimum the mean predicted probability of a class is its share.
    """
    matrix = stored(features.design_matrix(line_rows(t), MEASURES, BINARY, "outcome"), "matrix")
    fitted = scoring.fit_outcome_model(matrix, Z_NAMES, N_CLASSES)
    scored = model.softmax_scores(matrix, Z_NAMES, model.load_coefficients(fitted, len(Z_NAMES), N_CLASSES))
    means = scored.agg(*[F.avg(f"p_{k}").alias(f"p_{k}") for k in range(N_CLASSES)], F.count("*").alias("rows"))
    expected = means.select("rows", F.posexplode(F.array(*[f"p_{k}" for k in range(N_CLASSES)])).alias("category", "mean"))
    counted = matrix.groupBy(F.col("label").cast("int").alias("category")).agg(F.count("*").alias("n"))
    off = F.abs(F.col("mean") - F.col("n") / F.col("rows"))
    return counted.join(expected, "category").select("category", "n", (off < 1e-3).alias("calibrated"))


_complete = " AND ".join(f"{c} IS NOT NULL" for c in ["outcome", *MEASURES, *BINARY])


@query(
    "posterior_mode",
    with_views(lines=LINES_SQL, body=f"""SELECT outcome AS category, count(*) AS n, true AS stationary FROM lines
      WHERE {_complete} GROUP BY 1"""),
)
def _(t: Tables):
    """Rows per class, and whether the mode is stationary there: excess of each free class over its rows meets its prior."""
    matrix = stored(features.design_matrix(line_rows(t), MEASURES, BINARY, "outcome"), "matrix")
    fitted = scoring.fit_outcome_model(matrix, Z_NAMES, N_CLASSES)
    own = model.load_coefficients(fitted, len(Z_NAMES), N_CLASSES)
    scored = model.softmax_scores(matrix, Z_NAMES, own)
    columns = [F.lit(1.0), *[F.col(z) for z in Z_NAMES]]

    def off(k: int) -> Column:
        free = own.intercepts[k] / estimate.INTERCEPT_SD**2, *(b / estimate.BETA_SD**2 for b in own.betas[k])
        excess = [F.sum((F.col(f"p_{k}") - (F.col("label") == k).cast("double")) * x) + F.lit(prior) for x, prior in zip(columns, free)]
        return F.greatest(*[F.abs(e) for e in excess]) if len(excess) > 1 else F.abs(excess[0])

    sums = scored.agg(*[(off(k) / F.count("*")).alias(f"off_{k}") for k in range(N_CLASSES - 1)], F.count("*").alias("rows"))
    named = F.array(*[f"off_{k}" for k in range(N_CLASSES - 1)], F.lit(0.0))
    bounds = sums.select(F.posexplode(named).alias("category", "off"))
    counted = matrix.groupBy(F.col("label").cast("int").alias("category")).agg(F.count("*").alias("n"))
    return counted.join(bounds, "category").select("category", "n", (F.col("off") < 1e-8).alias("stationary"))


_DRAWS = 2000


@query(
    "posterior_draws",
    with_views(lines=LINES_SQL, body=f"""SELECT DISTINCT outcome AS category, {_DRAWS * (len(Z_NAMES) + 1)} AS n, true AS centred
      FROM lines WHERE {_complete}"""),
)
def _(t: Tables):
    """Draws per class, and whether their means are the estimate within five standard errors."""
    matrix = stored(features.design_matrix(line_rows(t), MEASURES, BINARY, "outcome"), "matrix")
    mode = estimate.posterior_mode(matrix, Z_NAMES, N_CLASSES)
    draws = stored(estimate.posterior_draws(t.spark, mode, 2, _DRAWS // 2), "draws")
    keys = ["param", "predictor", "category"]
    means = model.posterior_mean(draws).withColumnRenamed("value", "mean")
    spread = draws.groupBy(*keys).agg(F.stddev("value").alias("sd"), F.count("*").alias("n"))
    fitted = estimate.parameter_rows(t.spark, mode)
    left, right = means.alias("m"), spread.alias("s")
    same = [F.col(f"m.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    both = left.join(right, same).select("m.*", "sd", "n").alias("b")
    met = both.join(fitted.alias("f"), [F.col(f"b.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]).select("b.*", "value")
    near = F.abs(F.col("mean") - F.col("value")) <= 5 * F.col("sd") / F.sqrt("n") + 1e-12
    return met.groupBy("category").agg(F.sum("n").cast("int").alias("n"), F.bool_and(near).alias("centred"))


CONTINUOUS, ORDERED = C.CONTINUOUS_COLUMNS, [*C.CONTINUOUS_COLUMNS, *C.BINARY_COLUMNS]
MATCHUP_SCALER_SQL = "SELECT " + ", ".join(
    f"avg({c}) AS \"m_{c}\", CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS \"s_{c}\""
    for c in CONTINUOUS
) + " FROM complete_matchups"
MATCHUP_SCALED_SQL = f"""
SELECT matchups.*, {', '.join(f'({c} - "m_{c}") / "s_{c}" AS {c}_z' for c in CONTINUOUS)},
  CAST(CASE WHEN (stand = 'L' AND p_throws = 'R') OR (stand = 'R' AND p_throws = 'L') THEN 1 ELSE 0 END AS DOUBLE) AS is_platoon_adv_z,
  CAST(is_batter_home AS DOUBLE) AS is_batter_home_z FROM matchups, matchup_scaler
"""


@query(
    "score_outcomes",
    with_views(*SERVING_VIEWS, **SERVING_CTES, matchups=MATCHUPS_SQL,
      complete_matchups="SELECT * FROM matchups WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in CONTINUOUS),
      matchup_scaler=MATCHUP_SCALER_SQL, scaled_matchups=MATCHUP_SCALED_SQL,
      body=softmax_sql("scaled_matchups", [f"{c}_z" for c in ORDERED], ", ".join(MATCHUP_KEYS[:7]))),
)
def _(t: Tables):
    rows = stored(serving.matchups(**serving_tables(t)), "matchups")
    scaler = model.scaler_fit(rows, CONTINUOUS)
    scored = scoring.score_outcomes(rows, scaler, parameter_rows(t, len(ORDERED)))
    return rounded(scored.select(*MATCHUP_KEYS[:7], *[f"p_{k}" for k in range(N_CLASSES)]))
