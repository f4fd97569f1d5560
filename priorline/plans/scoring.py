"""Model fit and batch scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline import constants as C
from priorline.operators import estimate, events, model, serving


def fit_outcome_model(
    matrix: DataFrame, features: Sequence[str], n_classes: int, max_iter: int = 50
) -> DataFrame:
    """Multinomial logit point estimate as ``(param, predictor, category, value)`` rows.

    The mode under the priors N(0, 1.5) of the intercepts and N(0, 1) of the coefficients, the last class pinned to zero.
    Labels are 0 to ``n_classes - 1``, and the largest one must occur.
    """
    found = matrix.agg(F.max(F.col("label").cast("int")).alias("most")).first()["most"]
    if found is None or found + 1 != n_classes:
        raise ValueError(f"expected {n_classes} classes in the data, found {0 if found is None else found + 1}")
    mode = estimate.posterior_mode(matrix, features, n_classes, max_steps=max_iter)
    return estimate.parameter_rows(matrix.sparkSession, mode)


def score_outcomes(
    matchups: DataFrame,
    scaler: DataFrame,
    parameters: DataFrame,
    continuous: Sequence[str] = C.CONTINUOUS_COLUMNS,
    binary: Sequence[str] = C.BINARY_COLUMNS,
    n_classes: int = len(C.OUTCOME_LABELS),
) -> DataFrame:
    """Outcome probabilities of every matchup, each scored once.

    ``matchups`` comes from ``serving.matchups``; the platoon flag is derived from its
    ``stand`` and ``p_throws``. The fitted scaler and parameters are read first, as a model is.
    """
    names = model.scaled_names(continuous, binary)
    coefficients = model.load_coefficients(parameters, len(names), n_classes)
    flagged = events.platoon_flag(matchups)
    scaled = model.standardize(flagged, model.read_scaler(scaler, continuous), continuous, binary)
    return model.softmax_scores(scaled, names, coefficients).drop(*names)


def score_games(
    games: DataFrame,
    lineup: DataFrame,
    batters: DataFrame,
    pitchers: DataFrame,
    handedness: DataFrame,
    defense: DataFrame,
    factors: DataFrame,
    scaler: DataFrame,
    parameters: DataFrame,
) -> DataFrame:
    """All line-up slots of all given games against their opposing starter, in one job.

    Hands are attached to all projections; only players of the line-ups come through the joins.
    """
    batters = serving.attach_handedness(batters, handedness)
    pitchers = serving.attach_handedness(pitchers, handedness)
    rows = serving.matchups(
        games,
        serving.assemble_lineup(lineup, batters),
        serving.starting_pitcher(lineup, pitchers),
        serving.team_defense(lineup, defense, games),
        factors,
    )
    return score_outcomes(rows, scaler, parameters)
