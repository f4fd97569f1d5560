"""Multinomial logit with normal priors: the posterior mode by Newton's method, and draws around it.

Intercepts have the prior N(0, 1.5), coefficients N(0, 1), and the last class is pinned to zero. A step needs the loss,
its gradient and its Hessian at the present parameters: each task adds up its rows' parts with matrix products, Spark
adds the tasks' sums by position, and only the sums (a few thousand numbers) come to the driver, which solves one small
system. Rows are read once a step and never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline import schemas
from priorline.operators.events import drop_nulls

INTERCEPT_SD, BETA_SD = 1.5, 1.0
_ROWS = 8192


@dataclass(frozen=True)
class Mode:
    """``parameters[class][0]`` is the intercept, the others the coefficients, of all classes but the pinned last one.

    ``hessian`` is that of the negative log posterior over the flattened parameters; ``gradient`` the largest absolute
    entry of its gradient, divided by the number of rows.
    """

    parameters: np.ndarray
    hessian: np.ndarray
    gradient: float
    rows: int
    steps: int


def sums_at(theta: np.ndarray, x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Rows, loss, gradient and upper Hessian blocks (class by class) of the likelihood, as one row of numbers."""
    classes, width = theta.shape
    x = np.column_stack([np.ones(len(x)), x])
    score = np.column_stack([x @ theta.T, np.zeros(len(x))])
    score -= score.max(axis=1, keepdims=True)
    p = np.exp(score)
    total = p.sum(axis=1, keepdims=True)
    p /= total
    loss = float(np.sum(np.log(total[:, 0]) - score[np.arange(len(x)), label]))
    off = p[:, :classes] - (label[:, None] == np.arange(classes))
    blocks = []
    for k in range(classes):
        for m in range(k, classes):
            weight = p[:, k] * ((k == m) - p[:, m])
            blocks.append((x * weight[:, None]).T @ x)
    return np.concatenate([[len(x), loss], (off.T @ x).ravel(), *[b.ravel() for b in blocks]])


def _unpacked(sums: np.ndarray, theta: np.ndarray, precision: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
    """Rows, loss, gradient and Hessian with the priors' parts."""
    classes, width = theta.shape
    size = classes * width
    hessian, at = np.zeros((size, size)), 2 + size
    for k in range(classes):
        for m in range(k, classes):
            block = sums[at : at + width * width].reshape(width, width)
            hessian[k * width : (k + 1) * width, m * width : (m + 1) * width] = block
            hessian[m * width : (m + 1) * width, k * width : (k + 1) * width] = block.T
            at += width * width
    loss = sums[1] + 0.5 * float(np.sum(precision * theta**2))
    gradient = sums[2 : 2 + size] + (precision * theta).ravel()
    return int(sums[0]), loss, gradient, hessian + np.diag(precision.ravel())


def data_sums(matrix: DataFrame, features: Sequence[str], theta: np.ndarray, label: str = "label") -> np.ndarray:
    """``sums_at`` over all rows of a table, added up where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | float = 0.0
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS):
                part = batch.slice(first, _ROWS)
                x = np.column_stack([part.column(k).to_numpy(zero_copy_only=False) for k in range(len(features))])
                total = total + sums_at(theta, x, part.column(len(features)).to_numpy(zero_copy_only=False).astype(int))
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "part"])

    rows = matrix.select(*[F.col(f).cast("double") for f in features], F.col(label).cast("int"))
    added = rows.mapInArrow(run, "place long, part double").groupBy("place").agg(F.sum("part").alias("part"))
    classes, width = theta.shape
    out = np.zeros(2 + classes * width + classes * (classes + 1) // 2 * width * width)
    for place, part in added.collect():  # as many rows as there are sums
        out[place] = part
    return out


def posterior_mode(
    matrix: DataFrame, features: Sequence[str], n_classes: int, label: str = "label", tolerance: float = 1e-10, max_steps: int = 50
) -> Mode:
    """The mode, from rows with all features and a label of 0 to ``n_classes - 1`` (others are left out).

    Without rows it is zero, the priors' mode. A step that would not lower the loss is halved.
    """
    kept = drop_nulls(matrix, [*features, label]).filter(F.col(label).between(0, n_classes - 1))
    width = len(features) + 1
    precision = np.full((n_classes - 1, width), BETA_SD**-2)
    precision[:, 0] = INTERCEPT_SD**-2
    theta = np.zeros_like(precision)
    rows, loss, gradient, hessian = _unpacked(data_sums(kept, features, theta, label), theta, precision)
    steps = 0
    while np.abs(gradient).max() / max(rows, 1) > tolerance and steps < max_steps:
        step = np.linalg.solve(hessian, gradient).reshape(theta.shape)
        for _ in range(30):
            steps += 1
            tried = _unpacked(data_sums(kept, features, theta - step, label), theta - step, precision)
            # Near the mode losses agree to rounding, and the gradient tells more.
            if tried[1] <= loss or np.abs(tried[2]).max() < np.abs(gradient).max():
                break
            step = step / 2
        else:
            break
        theta = theta - step
        rows, loss, gradient, hessian = tried
    return Mode(theta, hessian, float(np.abs(gradient).max()) / max(rows, 1), rows, steps)


def _names(mode: Mode) -> list[tuple[str, int | None, int]]:
    """Parameter names in the order of the flattened parameters."""
    classes, width = mode.parameters.shape
    return [("intercepts", None, k) if j == 0 else ("betas", j - 1, k) for k in range(classes) for j in range(width)]


def parameter_rows(spark: SparkSession, mode: Mode) -> DataFrame:
    """``(param, predictor, category, value)`` of all classes, the last one zero."""
    classes, width = mode.parameters.shape
    rows = [(*name, float(v)) for name, v in zip(_names(mode), mode.parameters.ravel())]
    rows += [("intercepts", None, classes, 0.0)] + [("betas", j, classes, 0.0) for j in range(width - 1)]
    return spark.createDataFrame(rows, schemas.PARAMETERS)


POSTERIOR = ["chain", "draw", "param", "predictor", "category", "value"]


def normal(*parts) -> Column:
    """A standard normal number for each combination of columns: Box-Muller over two hashes of them."""
    high = F.lit(float(1 << 53))
    one, two = (F.shiftrightunsigned(F.xxhash64(*parts, F.lit(k)), 11).cast("double") for k in (1, 2))
    return F.sqrt(-2 * F.log((one + 1) / high)) * F.cos(2 * F.pi() * two / high)


def posterior_draws(spark: SparkSession, mode: Mode, chains: int = 4, draws: int = 1000, seed: int = 1) -> DataFrame:
    """Draws of all parameters from the normal distribution around the mode with the Hessian's inverse as covariance.

    ``(chain, draw, param, predictor, category, value)``, the pinned class zero in each. Numbers depend on the seed,
    chain, draw and parameter only, so reruns and lost tasks give the same draws.
    """
    factor = np.linalg.cholesky(np.linalg.inv(mode.hessian))
    size = len(factor)
    names = _names(mode)
    lower = [(i, j, float(factor[i, j])) for i in range(size) for j in range(i + 1)]
    lower_rows = spark.createDataFrame(lower, "i int, j int, part double")  # the square of the number of parameters
    place = spark.createDataFrame([(i, *n, float(v)) for i, (n, v) in enumerate(zip(names, mode.parameters.ravel()))], "i int, " + schemas.PARAMETERS)
    each = spark.range(chains * draws).select((F.col("id") / draws).cast("int").alias("chain"), (F.col("id") % draws).cast("int").alias("draw"))
    noise = each.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    noise = noise.withColumn("z", normal(F.lit(seed), "chain", "draw", "j"))
    moved = noise.join(F.broadcast(lower_rows), "j").groupBy("chain", "draw", "i").agg(F.sum(F.col("part") * F.col("z")).alias("off"))
    found = moved.join(F.broadcast(place), "i").withColumn("value", F.col("value") + F.col("off")).select(*POSTERIOR)
    classes, width = mode.parameters.shape
    zeros = [("intercepts", None, classes)] + [("betas", j, classes) for j in range(width - 1)]
    pinned = F.explode(F.array(*[
        F.struct(F.lit(p).alias("param"), F.lit(j).cast("int").alias("predictor"), F.lit(k).alias("category")) for p, j, k in zeros
    ]))
    last = each.withColumn("of", pinned).select("chain", "draw", "of.*", F.lit(0.0).alias("value"))
    return found.unionByName(last)
