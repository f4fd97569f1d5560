"""Scaling, model parameters and batch scoring with plain column arithmetic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorline import constants as C
from priorline.operators.events import complete_records

SCALED = "_z"


def posterior_mean(posterior: DataFrame) -> DataFrame:
    """Mean of every parameter over chains and draws.

    ``posterior(param, chain, draw, predictor, category, value)``; draws are reduced map-side.
    """
    return posterior.groupBy("param", "predictor", "category").agg(F.avg("value").alias("value"))


def scaler_fit(df: DataFrame, columns: Sequence[str] = C.CONTINUOUS_COLUMNS) -> DataFrame:
    """``(feature, mean, scale)`` over complete rows: population deviation, a zero scale becomes 1.

    A declared column that the table lacks is an analysis error.
    """
    moments = [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)] + [
        F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)
    ]
    row = complete_records(df, columns).agg(*moments)
    features = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"m{i}").alias("mean"),
            F.when(F.col(f"s{i}") == 0, F.lit(1.0)).otherwise(F.col(f"s{i}")).alias("scale"),
        )
        for i, c in enumerate(columns)
    ]
    return row.select(F.inline(F.array(*features)))


def _scaler_row(scaler: DataFrame, columns: Sequence[str]) -> Column:
    """The scaler as one struct, read as a scalar subquery (one row by construction)."""

    def of(column: str, part: str) -> Column:
        value = F.max(F.when(F.col("feature") == column, F.col(part)))
        missing = F.raise_error(F.lit(f"the scaler has no entry for {column}")).cast("double")
        return F.coalesce(value, missing)

    parts = [of(c, "mean").alias(f"m{i}") for i, c in enumerate(columns)]
    parts += [of(c, "scale").alias(f"s{i}") for i, c in enumerate(columns)]
    return scaler.agg(F.struct(*parts).alias("scaler")).scalar()


def read_scaler(
    scaler: DataFrame, columns: Sequence[str] = C.CONTINUOUS_COLUMNS
) -> dict[str, tuple[float, float]]:
    """A stored scaler as ``{feature: (mean, scale)}``; it must hold every column once.

    At most one row more than there are columns is read.
    """
    wanted = scaler.filter(F.col("feature").isin(list(columns))).limit(len(columns) + 1).collect()
    found = {row["feature"]: (row["mean"], row["scale"]) for row in wanted}
    if len(wanted) != len(columns) or set(found) != set(columns):
        raise ValueError(f"the scaler does not hold each of {list(columns)} once")
    return found


def standardize(
    df: DataFrame,
    scaler: DataFrame | Mapping[str, tuple[float, float]],
    continuous: Sequence[str] = C.CONTINUOUS_COLUMNS,
    binary: Sequence[str] = C.BINARY_COLUMNS,
) -> DataFrame:
    """Add ``<column>_z``: scaled continuous columns, and the 0/1 columns as doubles.

    A scaler fitted in the same job stays lazy (a scalar subquery); one that was read enters as
    constants. A column without an entry is an error in both cases.
    """
    lazy = isinstance(scaler, DataFrame)
    source = df.withColumn("_scaler", _scaler_row(scaler, continuous)) if lazy else df

    def scaled(i: int, column: str) -> Column:
        if lazy:
            return (F.col(column) - F.col("_scaler")[f"m{i}"]) / F.col("_scaler")[f"s{i}"]
        mean, scale = scaler[column]
        return (F.col(column) - F.lit(mean)) / F.lit(scale)

    columns = {f"{c}{SCALED}": scaled(i, c) for i, c in enumerate(continuous)}
    columns.update({f"{c}{SCALED}": F.col(c).cast("double") for c in binary})
    return source.withColumns(columns).drop("_scaler")


def scaled_names(
    continuous: Sequence[str] = C.CONTINUOUS_COLUMNS, binary: Sequence[str] = C.BINARY_COLUMNS
) -> list[str]:
    """Model input order: the continuous columns, then the 0/1 columns."""
    return [f"{c}{SCALED}" for c in (*continuous, *binary)]


def coefficient_row(
    parameters: DataFrame, n_predictors: int, n_classes: int
) -> DataFrame:
    """``(intercepts, betas)`` arrays from long ``(param, predictor, category, value)`` rows.

    Both arrays are indexed by class; ``betas[class]`` is indexed by predictor. If the parameters
    stop one class short, the last class is the reference and gets zeros; any other shape is an
    error when the plan runs.
    """
    intercept_rows = F.col("param") == "intercepts"
    categories = F.max("category") + 1
    width = F.max(F.when(~intercept_rows, F.col("predictor"))) + 1

    def value(category: int, predictor: int | None) -> Column:
        here = (F.col("category") == category) & (
            intercept_rows if predictor is None else (~intercept_rows & (F.col("predictor") == predictor))
        )
        found = F.max(F.when(here, F.col("value")))
        reference = F.when(F.max("category") == n_classes - 2, F.lit(0.0))
        return F.coalesce(found, reference) if category == n_classes - 1 else found

    shape_ok = (width == n_predictors) & categories.isin(n_classes, n_classes - 1)
    wrong = F.raise_error(
        F.concat(
            F.lit(f"expected {n_predictors} predictors and {n_classes} classes, found "),
            width.cast("string"), F.lit(" and "), categories.cast("string"),
        )
    )
    intercepts = F.array(*[value(k, None) for k in range(n_classes)])
    betas = F.array(
        *[F.array(*[value(k, j) for j in range(n_predictors)]) for k in range(n_classes)]
    )
    return parameters.agg(
        F.when(F.coalesce(shape_ok, F.lit(False)), intercepts)
        .otherwise(wrong.cast("array<double>"))
        .alias("intercepts"),
        betas.alias("betas"),
    )


@dataclass(frozen=True)
class Coefficients:
    """Model parameters by class: ``betas[class][predictor]``."""

    intercepts: list[float]
    betas: list[list[float]]


def read_coefficients(row: DataFrame) -> Coefficients:
    """The one row of ``coefficient_row``: ``n_classes * (n_predictors + 1)`` numbers."""
    found = row.select("intercepts", "betas").first()
    return Coefficients(list(found["intercepts"]), [list(b) for b in found["betas"]])


def load_coefficients(parameters: DataFrame, n_predictors: int, n_classes: int) -> Coefficients:
    """Coefficients from a stored ``(param, predictor, category, value)`` table.

    At most ``n_classes * (n_predictors + 1)`` rows are read, and one more to notice a larger
    table. A table one class short gets the zero reference class; other shapes are an error.
    """
    expected = n_classes * (n_predictors + 1)
    found = parameters.select("param", "predictor", "category", "value").limit(expected + 1).collect()
    cells = {(r["param"], r["category"], r["predictor"]): r["value"] for r in found}
    for classes in (n_classes, n_classes - 1):
        wanted = {("intercepts", k, None) for k in range(classes)} | {
            ("betas", k, j) for k in range(classes) for j in range(n_predictors)
        }
        if set(cells) == wanted and len(found) == len(wanted):
            missing = n_classes - classes
            intercepts = [cells["intercepts", k, None] for k in range(classes)] + [0.0] * missing
            betas = [[cells["betas", k, j] for j in range(n_predictors)] for k in range(classes)]
            return Coefficients(intercepts, betas + [[0.0] * n_predictors] * missing)
    raise ValueError(f"the parameters are not those of {n_predictors} predictors and {n_classes} classes")


def softmax_scores(
    df: DataFrame, features: Sequence[str], coefficients: Coefficients, prefix: str = "p_"
) -> DataFrame:
    """Add ``p_0 .. p_{n-1}``: softmax of ``intercept + x . beta``, shifted by the row maximum.

    The products are written out as column arithmetic with constant coefficients. Features are
    made non-nullable inside (a null becomes NaN and the result null again), which leaves the
    generated method small enough for the JVM to compile; with a null check per product it is
    not, and scoring runs an order of magnitude slower.
    """
    if any(len(beta) != len(features) for beta in coefficients.betas):
        raise ValueError(f"the model does not have {len(features)} predictors")
    classes = range(len(coefficients.intercepts))
    inputs = {f"_x_{j}": F.coalesce(F.col(f), F.lit(float("nan"))) for j, f in enumerate(features)}
    known = reduce(and_, [F.col(f).isNotNull() for f in features])

    def linear(k: int) -> Column:
        terms = [F.col(x) * F.lit(b) for x, b in zip(inputs, coefficients.betas[k])]
        return reduce(add, terms, F.lit(coefficients.intercepts[k]))

    scores, weights = [f"_mu_{k}" for k in classes], [f"_e_{k}" for k in classes]
    scored = df.withColumns({**inputs, "_known": known}).withColumns(
        {name: linear(k) for k, name in enumerate(scores)}
    )
    weighed = scored.withColumn("_top", F.greatest(*scores)).withColumns(
        {w: F.exp(F.col(s) - F.col("_top")) for w, s in zip(weights, scores)}
    )
    summed = weighed.withColumn("_total", reduce(add, [F.col(w) for w in weights]))
    shares = {f"{prefix}{k}": F.when(F.col("_known"), F.col(weights[k]) / F.col("_total")) for k in classes}
    return summed.withColumns(shares).drop(*inputs, "_known", "_top", "_total", *scores, *weights)


def reference_category(coefficients: DataFrame, n_classes: int) -> DataFrame:
    """Append a zero last class to arrays one class short; full arrays pass, others are an error."""
    size = F.size("intercepts")
    zero_beta = F.transform(F.col("betas")[0], lambda _: F.lit(0.0))
    wrong = F.raise_error(F.concat(F.lit(f"cannot extend to {n_classes} classes from "), size.cast("string")))

    def extended(column: str, zero: Column, kind: str) -> Column:
        return (
            F.when(size == n_classes, F.col(column))
            .when(size == n_classes - 1, F.concat(F.col(column), F.array(zero)))
            .otherwise(wrong.cast(kind))
        )

    return coefficients.withColumns(
        {
            "intercepts": extended("intercepts", F.lit(0.0), "array<double>"),
            "betas": extended("betas", zero_beta, "array<array<double>>"),
        }
    )


def scaler_check(
    scaled: DataFrame, columns: Sequence[str], tolerance: float = 0.1
) -> DataFrame:
    """Scaled columns whose mean is not about 0 or whose deviation is not about 1."""
    moments = [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)] + [
        F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)
    ]
    rows = [
        F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("deviation"))
        for i, c in enumerate(columns)
    ]
    measured = scaled.agg(*moments).select(F.inline(F.array(*rows)))
    good = (F.abs("mean") <= tolerance) & (F.abs(F.col("deviation") - 1) <= tolerance)
    return measured.filter(~F.coalesce(good, F.lit(False)))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def contiguous_classes(df: DataFrame, column: str) -> DataFrame:
    """One row: the number of classes, and whether they are exactly 0 .. n-1."""
    classes = df.select(column).distinct().agg(
        F.min(column).alias("low"), F.max(column).alias("high"), F.count(column).alias("n_classes")
    )
    ok = (F.col("low") == 0) & (F.col("high") == F.col("n_classes") - 1)
    return classes.select("n_classes", F.coalesce(ok, F.lit(False)).alias("contiguous"))


def describe(df: DataFrame, columns: Sequence[str], buckets: int = 256) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum, one row per column.

    A column without values has count 0 and nulls.
    """
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = values.unpivot([], list(columns), "feature", "value").filter(F.col("value").isNotNull())
    measures = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    moments = values.agg(
        *[F.struct(*[f(c).alias(name) for name, f in measures.items()]).alias(c) for c in columns]
    ).select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"`{c}`.{m}") for m in measures]) for c in columns]))
    )
    quartiles = exact_quantiles(long, [0.25, 0.5, 0.75], buckets).withColumnsRenamed(
        {"q0": "q25", "q1": "q50", "q2": "q75"}
    )
    return moments.join(quartiles, "feature", "left").select(
        "feature", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def exact_quantiles(long: DataFrame, shares: Sequence[float], buckets: int = 256) -> DataFrame:
    """Exact, linearly interpolated quantiles ``q0, q1, ...`` of ``(feature, value)`` rows.

    ``percentile`` would gather all distinct values of a column in one task. Here equal values
    are counted first, the distinct values are spread over ``buckets`` by approximate quantile
    edges, and ranks come from per-bucket running counts plus the totals of the lower buckets.
    The edges only balance the work; the ranks are exact wherever the edges fall.
    """
    steps = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    counted = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_n"))
    edges = counted.groupBy("feature").agg(
        F.percentile_approx("value", steps, 10_000).alias("_edges"), F.sum("_n").alias("_rows")
    )
    coarse = F.filter("_edges", lambda _, i: i % 16 == 15)
    edges = edges.withColumn("_coarse", coarse)
    # find the bucket in two steps: every 16th edge, then the edges up to the next of those
    passed = F.size(F.filter("_coarse", lambda edge: edge < F.col("value")))
    rest = F.filter(F.slice("_edges", passed * 16 + 1, 16), lambda edge: edge < F.col("value"))
    below = passed * 16 + F.size(rest)
    placed = counted.join(F.broadcast(edges), "feature", "inner").select(
        "feature", "value", "_n", "_rows", below.alias("_bucket")
    )
    lower = Window.partitionBy("feature").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("feature", "_bucket").agg(F.sum("_n").alias("_in_bucket"))
        .select("feature", "_bucket", F.coalesce(F.sum("_in_bucket").over(lower), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("feature", "_bucket").orderBy("value")
    ranked = placed.withColumn("_run", F.sum("_n").over(inside)).join(
        offsets, ["feature", "_bucket"], "inner"
    )
    last = F.col("_offset") + F.col("_run")
    position = [F.lit(p) * (F.col("_rows") - 1) for p in shares]

    def value_at(rank: Column) -> Column:
        return F.max(F.when((last - F.col("_n") <= rank) & (rank < last), F.col("value")))

    picked = ranked.groupBy("feature").agg(
        *[value_at(F.floor(r)).alias(f"_low{i}") for i, r in enumerate(position)],
        *[value_at(F.ceil(r)).alias(f"_high{i}") for i, r in enumerate(position)],
        F.max("_rows").alias("_rows"),
    )
    return picked.select(
        "feature",
        *[
            (
                F.col(f"_low{i}")
                + (F.col(f"_high{i}") - F.col(f"_low{i}")) * (r - F.floor(r))
            ).alias(f"q{i}")
            for i, r in enumerate(position)
        ],
    )
