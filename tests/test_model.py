import math
import statistics

import numpy as np
import pytest
from helpers import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from priorline.operators import model
from priorline.plans import features, scoring


def frame(spark):
    data = [(float(i), float(i % 3), 5.0, i % 2, i % 4) for i in range(40)]
    return spark.createDataFrame(data, "a double, b double, flat double, flag int, label int")


def test_scaler_uses_the_population_and_guards_zero(spark):
    got = model.read_scaler(model.scaler_fit(frame(spark), ["a", "flat"]), ["a", "flat"])
    assert math.isclose(got["a"][1], statistics.pstdev(range(40)))
    assert got["flat"] == (5.0, 1.0)


def test_lazy_and_read_scaler_agree(spark):
    df = frame(spark)
    fitted = model.scaler_fit(df, ["a", "b"])
    lazy = model.standardize(df, fitted, ["a", "b"], ["flag"])
    read = model.standardize(df, model.read_scaler(fitted, ["a", "b"]), ["a", "b"], ["flag"])
    assert rows(lazy) == rows(read)
    assert model.scaler_check(lazy, ["a_z", "b_z"]).count() == 0
    assert rows(model.scaler_check(df, ["a", "b"]), "feature") == [("a",), ("b",)]


def test_missing_scaler_entry_is_an_error(spark):
    df = frame(spark)
    fitted = model.scaler_fit(df, ["a"])
    with pytest.raises(Exception, match="no entry for b"):  # a failing subquery surfaces as a JVM error
        model.standardize(df, fitted, ["a", "b"], []).collect()
    with pytest.raises(ValueError, match="does not hold"):
        model.read_scaler(fitted, ["a", "b"])
    with pytest.raises(ValueError, match="does not hold"):
        model.read_scaler(fitted.union(fitted), ["a"])


def parameters(spark, classes, predictors):
    rng = np.random.default_rng(3)
    rows_ = [("intercepts", None, k, float(rng.normal())) for k in range(classes)]
    rows_ += [("betas", j, k, float(rng.normal())) for k in range(classes) for j in range(predictors)]
    return spark.createDataFrame(rows_, "param string, predictor int, category int, value double")


def test_softmax_matches_numpy(spark):
    df = frame(spark)
    found = model.read_coefficients(model.coefficient_row(parameters(spark, 8, 2), 2, 8))
    scored = model.softmax_scores(df, ["a", "b"], found)
    x = np.array([[r["a"], r["b"]] for r in df.collect()])
    mu = np.array(found.intercepts) + x @ np.array(found.betas).T
    expected = np.exp(mu - mu.max(axis=1, keepdims=True))
    expected /= expected.sum(axis=1, keepdims=True)
    got = np.array([[r[f"p_{k}"] for k in range(8)] for r in scored.collect()])
    assert np.allclose(got, expected) and np.allclose(got.sum(axis=1), 1.0)
    assert scored.columns == [*df.columns, *[f"p_{k}" for k in range(8)]]


def test_null_feature_gives_null_scores(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, 1.0)], "a double, b double")
    found = model.read_coefficients(model.coefficient_row(parameters(spark, 3, 2), 2, 3))
    got = model.softmax_scores(df, ["a", "b"], found).collect()
    assert got[0]["p_0"] is None and got[1]["p_0"] is not None


def test_reference_class(spark):
    short = model.coefficient_row(parameters(spark, 7, 2), 2, 7)
    full = model.read_coefficients(model.reference_category(short, 8))
    assert full.intercepts[-1] == 0.0 and full.betas[-1] == [0.0, 0.0]
    assert model.read_coefficients(model.coefficient_row(parameters(spark, 7, 2), 2, 8)).betas == full.betas
    with pytest.raises(PySparkException, match="cannot extend"):
        model.reference_category(short, 10).collect()
    with pytest.raises(PySparkException, match="expected 3 predictors"):
        model.coefficient_row(parameters(spark, 8, 2), 3, 8).collect()


def test_loaded_coefficients(spark):
    full = parameters(spark, 8, 2)
    assert model.load_coefficients(full, 2, 8) == model.read_coefficients(model.coefficient_row(full, 2, 8))
    short = model.load_coefficients(parameters(spark, 7, 2), 2, 8)
    assert short.intercepts[-1] == 0.0 and short.betas[-1] == [0.0, 0.0]
    for predictors, classes in ((3, 8), (2, 7), (2, 10)):
        with pytest.raises(ValueError, match="not those of"):
            model.load_coefficients(full, predictors, classes)


def test_posterior_mean(spark):
    draws = spark.createDataFrame(
        [("betas", c, d, 0, 1, float(c + d)) for c in range(2) for d in range(10)],
        "param string, chain int, draw int, predictor int, category int, value double",
    )
    assert rows(model.posterior_mean(draws)) == [("betas", 0, 1, 5.0)]


@pytest.mark.parametrize("buckets", [2, 32, 256])
def test_quartiles_match_pandas_for_skewed_values(spark, buckets):
    rng = np.random.default_rng(5)
    a = [float(v) for v in rng.lognormal(size=300)] + [1.0] * 150
    df = spark.createDataFrame([(v, float(i % 2)) for i, v in enumerate(a)], "a double, b double")
    got = {r["feature"]: r for r in model.describe(df, ["a", "b"], buckets).collect()}
    expected = df.toPandas().describe()
    for column in ("a", "b"):
        for name, label in (("count", "count"), ("mean", "mean"), ("std", "std"), ("q25", "25%"), ("q50", "50%"),
                            ("q75", "75%"), ("min", "min"), ("max", "max")):
            assert math.isclose(got[column][name], expected[column][label], rel_tol=1e-9), (column, name)


def test_class_checks(spark):
    df = frame(spark)
    assert tuple(model.contiguous_classes(df, "label").first()) == (4, True)
    assert tuple(model.contiguous_classes(df.filter("label <> 1"), "label").first()) == (3, False)
    assert rows(model.value_counts(df, "flag")) == [(0, 20), (1, 20)]


def test_fit_beats_class_frequencies(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 2))
    label = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)
    df = spark.createDataFrame(
        [(float(a), float(b), int(i % 2), int(k)) for i, ((a, b), k) in enumerate(zip(x, label))],
        "a double, b double, flag int, label int",
    )
    matrix = features.design_matrix(df, ["a", "b"], ["flag"], "label")
    names = ["a_z", "b_z", "flag_z"]
    fitted = scoring.fit_outcome_model(matrix, names, 3)
    found = model.read_coefficients(model.coefficient_row(fitted, 3, 3))
    assert found.intercepts[-1] == 0.0 and found.betas[-1] == [0.0, 0.0, 0.0]
    scored = model.softmax_scores(matrix, names, found)
    chosen = F.when(F.col("label") == 0, F.col("p_0")).when(F.col("label") == 1, F.col("p_1")).otherwise(F.col("p_2"))
    loss = scored.agg(F.avg(-F.log(chosen))).first()[0]
    shares = [r["count"] / 600 for r in model.value_counts(df, "label").collect()]
    assert loss < 0.8 * -sum(p * math.log(p) for p in shares)
    with pytest.raises(ValueError, match="expected 4 classes"):
        scoring.fit_outcome_model(matrix, names, 4)


def test_describe_keeps_a_column_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    got = {r["feature"]: r for r in model.describe(df, ["a", "b"]).collect()}
    assert (got["b"]["count"], got["b"]["mean"], got["b"]["q50"]) == (0, None, None) and got["a"]["q50"] == 2.0
