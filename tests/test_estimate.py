"""Posterior mode and draws against a plain solver in NumPy."""

import numpy as np
from pyspark.sql import functions as F

from priorline.operators import estimate, model
from priorline.plans import scoring


def data(n=900, seed=3):
    g = np.random.default_rng(seed)
    x = np.column_stack([g.normal(size=n), g.normal(size=n), g.integers(0, 2, n)])
    score = np.column_stack([x @ [1.0, -0.5, 0.3] + 0.5, x @ [-0.7, 0.2, 0.0], np.zeros(n)])
    p = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)
    return x, (p.cumsum(axis=1) < g.random(n)[:, None]).sum(axis=1)


def plain_gradient(theta, x, y):
    x1 = np.column_stack([np.ones(len(x)), x])
    score = np.column_stack([x1 @ theta.T, np.zeros(len(x))])
    p = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)
    precision = np.ones_like(theta)
    precision[:, 0] = 1 / 1.5**2
    return ((p - np.eye(len(theta) + 1)[y])[:, :-1].T @ x1 + precision * theta).ravel()


def plain_mode(x, y, classes):
    """Newton with a Hessian by differences of the gradient."""
    theta = np.zeros((classes - 1, x.shape[1] + 1))
    for _ in range(25):
        gradient = plain_gradient(theta, x, y)
        hessian = np.empty((theta.size, theta.size))
        for k in range(theta.size):
            step = np.zeros(theta.size)
            step[k] = 1e-5
            step = step.reshape(theta.shape)
            hessian[k] = (plain_gradient(theta + step, x, y) - plain_gradient(theta - step, x, y)) / 2e-5
        theta = theta - np.linalg.solve(hessian, gradient).reshape(theta.shape)
    return theta, hessian


def matrix(spark, x, y):
    rows = [(*map(float, r), int(c)) for r, c in zip(x, y)] + [(None, 0.0, 0.0, 1), (0.0, 0.0, 1.0, None)]
    return spark.createDataFrame(rows, "a double, b double, c double, label int").repartition(5)


def test_mode_equals_a_plain_solver(spark):
    x, y = data()
    mode = estimate.posterior_mode(matrix(spark, x, y), ["a", "b", "c"], 3)
    theta, hessian = plain_mode(x, y, 3)
    assert mode.rows == 900 and mode.gradient < 1e-10 and mode.steps < 12
    assert np.abs(plain_gradient(mode.parameters, x, y)).max() < 1e-6
    assert np.allclose(mode.parameters, theta, atol=1e-8) and np.allclose(mode.hessian, hessian, rtol=1e-5, atol=1e-4)


def test_classes_told_apart_and_empty_tables_have_a_mode(spark):
    x = np.column_stack([np.repeat([-40.0, 40.0], 30), np.zeros(60), np.ones(60)])
    y = np.repeat([0, 1], 30)
    found = estimate.posterior_mode(matrix(spark, x, y), ["a", "b", "c"], 3)
    assert np.isfinite(found.parameters).all() and found.gradient < 1e-10
    none = estimate.posterior_mode(matrix(spark, x, y).limit(0), ["a", "b", "c"], 3)
    assert not none.parameters.any() and none.rows == 0


def test_parameters_score_as_the_model_states(spark):
    x, y = data(300, 4)
    df = matrix(spark, x, y)
    fitted = scoring.fit_outcome_model(df, ["a", "b", "c"], 3)
    scored = model.softmax_scores(df.na.drop(), ["a", "b", "c"], model.load_coefficients(fitted, 3, 3))
    chosen = [r["p"] for r in scored.select(F.element_at(F.array("p_0", "p_1", "p_2"), F.col("label") + 1).alias("p")).collect()]
    mode = estimate.posterior_mode(df, ["a", "b", "c"], 3)
    sums = estimate.sums_at(mode.parameters, x, y)
    assert abs(-np.log(chosen).sum() - sums[1]) < 1e-6


def test_draws_have_the_mode_and_the_covariance(spark):
    x, y = data(400, 5)
    mode = estimate.posterior_mode(matrix(spark, x, y), ["a", "b", "c"], 3)
    draws = estimate.posterior_draws(spark, mode, chains=4, draws=2500, seed=9)
    again = estimate.posterior_draws(spark, mode, chains=4, draws=2500, seed=9).repartition(3)
    assert draws.select(F.sum(F.xxhash64("chain", "draw", "category", F.round("value", 9)).cast("decimal(38,0)"))).first() == again.select(F.sum(F.xxhash64("chain", "draw", "category", F.round("value", 9)).cast("decimal(38,0)"))).first()
    wide = np.array([r[0] for r in (
        draws.filter("category < 2").groupBy("chain", "draw")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("category", F.coalesce("predictor", F.lit(-1)).alias("p"), "value"))), lambda s: s["value"]).alias("v"))
        .select("v").collect()
    )])
    covariance = np.linalg.inv(mode.hessian)
    se = np.sqrt(np.diag(covariance) / len(wide))
    assert wide.shape == (10_000, 8) and (np.abs(wide.mean(axis=0) - mode.parameters.ravel()) < 5 * se).all()
    assert np.allclose(np.cov(wide.T), covariance, atol=6 * np.diag(covariance).max() / 100)
    means = {(r.param, r.predictor, r.category): r.value for r in model.posterior_mean(draws).collect()}
    assert means["intercepts", None, 2] == 0.0 and len(means) == 12
    assert abs(means["betas", 0, 1] - mode.parameters[1, 1]) < 5 * se[5]
