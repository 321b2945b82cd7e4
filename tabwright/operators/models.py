"""Candidate models on Spark MLlib and their search spaces."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.operators.boosting import HistBoosting
from tabwright.operators.problem import BINARY, REGRESSION, Problem

FEATURES, LABEL, WEIGHT = "features", "label", "weight"


@dataclass(frozen=True)
class TrainingFacts:
    """Figures of a training set that regularisation depends on."""

    rows: int
    label_std: float = 1.0


@dataclass(frozen=True)
class Preset:
    """Model sizes: ``reference`` trains full-size models, ``fast`` is for smoke checks."""

    trees: int
    forest_depth: int
    rounds: int
    boost_depth: int
    linear_iterations: int


REFERENCE = Preset(trees=100, forest_depth=12, rounds=100, boost_depth=5, linear_iterations=1000)
FAST = Preset(trees=10, forest_depth=4, rounds=5, boost_depth=3, linear_iterations=50)


@dataclass(frozen=True)
class Candidate:
    model_id: str
    name: str
    build: Callable[[dict, int, TrainingFacts], Estimator]
    space: dict[str, tuple]


# Model sizes and search ranges that must match.
# Search space entries: ("log", lo, hi), ("int", lo, hi, step), ("uniform", lo, hi), ("choice", [values])
FOREST_SPACE = {"n_estimators": ("int", 50, 200, 25), "max_depth": ("int", 4, 18, 1), "min_samples_split": ("int", 2, 10, 1)}
BOOST_SPACE = {
    "learning_rate": ("log", 0.01, 0.2), "max_iter": ("int", 50, 150, 25), "max_depth": ("int", 3, 10, 1),
    "l2_regularization": ("log", 1e-4, 10.0),
}
SUBSAMPLED_SPACE = {
    "n_estimators": ("int", 50, 150, 25), "max_depth": ("int", 3, 8, 1), "learning_rate": ("log", 0.01, 0.2),
    "subsample": ("uniform", 0.6, 1.0), "colsample": ("uniform", 0.6, 1.0),
}
FAST_TREES = {"n_estimators": ("int", 5, 10, 1), "max_depth": ("int", 2, 4, 1)}
FAST_BOOST = {
    "learning_rate": ("log", 0.01, 0.2), "max_iter": ("int", 2, 5, 1), "max_depth": ("int", 2, 3, 1),
    "l2_regularization": ("log", 1e-4, 10.0),
}
FAST_SUBSAMPLED = {
    "n_estimators": ("int", 2, 5, 1), "max_depth": ("int", 2, 3, 1), "learning_rate": ("log", 0.01, 0.2),
    "subsample": ("uniform", 0.6, 1.0), "colsample": ("uniform", 0.6, 1.0),
}


def candidates(problem: Problem, preset: Preset = REFERENCE) -> list[Candidate]:
    """Four candidates for the task, in the order that breaks leaderboard ties."""
    if problem.problem_type == REGRESSION:
        return _regressors(preset)
    return _classifiers(preset, problem.problem_type == BINARY, len(problem.classes))


def _classifiers(ps: Preset, binary: bool, classes: int) -> list[Candidate]:
    def logistic(p, seed, facts):
        # the penalty is a share of the summed weights, which balanced weights leave at the row count
        c = p.get("C", 1.0)
        return LogisticRegression(
            featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, maxIter=ps.linear_iterations,
            regParam=1.0 / (c * max(facts.rows, 1)), elasticNetParam=0.0, standardization=False)

    def forest(p, seed, facts):
        return RandomForestClassifier(**_forest(p, seed, ps), weightCol=WEIGHT, featureSubsetStrategy="sqrt")

    def boosted(p, seed, facts):
        return _boost(p, ps, max(classes, 2))

    def subsampled(p, seed, facts):
        return _per_class(GBTClassifier(**_subsampled(p, seed, ps)), binary)

    fast = ps == FAST
    return [
        Candidate("logistic_regression", "Logistic Regression", logistic, {"C": ("log", 1e-3, 10.0)}),
        Candidate("random_forest", "Random Forest", forest, FAST_TREES if fast else FOREST_SPACE),
        Candidate("gradient_boosting", "Gradient Boosting", boosted, FAST_BOOST if fast else BOOST_SPACE),
        Candidate("gbt_subsampled", "Gradient Boosting (subsampled)", subsampled, FAST_SUBSAMPLED if fast else SUBSAMPLED_SPACE),
    ]


def _regressors(ps: Preset) -> list[Candidate]:
    def ridge(p, seed, facts):
        # MLlib divides the penalty by the label deviation; scaling it back gives the plain ridge penalty
        alpha = p.get("alpha", 1.0)
        return LinearRegression(
            featuresCol=FEATURES, labelCol=LABEL, standardization=False, solver="normal",
            regParam=alpha / max(facts.rows, 1) * facts.label_std, elasticNetParam=0.0)

    def forest(p, seed, facts):
        return RandomForestRegressor(**_forest(p, seed, ps), featureSubsetStrategy="all")

    def boosted(p, seed, facts):
        return _boost(p, ps, 0)

    def subsampled(p, seed, facts):
        return GBTRegressor(**_subsampled(p, seed, ps))

    fast = ps == FAST
    return [
        Candidate("ridge", "Ridge Regression", ridge, {"alpha": ("log", 1e-3, 100.0)}),
        Candidate("random_forest_regressor", "Random Forest", forest, FAST_TREES if fast else FOREST_SPACE),
        Candidate("gradient_boosting_regressor", "Gradient Boosting", boosted, FAST_BOOST if fast else BOOST_SPACE),
        Candidate("gbt_subsampled_regressor", "Gradient Boosting (subsampled)", subsampled, FAST_SUBSAMPLED if fast else SUBSAMPLED_SPACE),
    ]


def _base(seed: int) -> dict:
    # long boosting is checkpointed so that it survives a lost executor
    return {"featuresCol": FEATURES, "labelCol": LABEL, "seed": seed, "checkpointInterval": 10}


def _forest(p: dict, seed: int, ps: Preset) -> dict:
    out = _base(seed) | {"numTrees": int(p.get("n_estimators", ps.trees)), "maxDepth": int(p.get("max_depth", ps.forest_depth))}
    if "min_samples_split" in p:  # closest MLlib notion: rows each child must keep
        out["minInstancesPerNode"] = math.ceil(p["min_samples_split"] / 2)
    out["cacheNodeIds"] = out["maxDepth"] > 8  # deep trees: keep each row's node instead of walking down
    return out


def _boost(p: dict, ps: Preset, classes: int) -> HistBoosting:
    return HistBoosting(
        classes, rounds=int(p.get("max_iter", ps.rounds)), learning_rate=float(p.get("learning_rate", 0.1)),
        max_depth=int(p.get("max_depth", ps.boost_depth)), l2=float(p.get("l2_regularization", 0.0)))


def _subsampled(p: dict, seed: int, ps: Preset) -> dict:
    return _base(seed) | {
        "maxIter": int(p.get("n_estimators", ps.rounds)), "stepSize": float(p.get("learning_rate", 0.08)),
        "maxDepth": int(p.get("max_depth", ps.boost_depth)), "subsamplingRate": float(p.get("subsample", 1.0)),
        "featureSubsetStrategy": str(float(p.get("colsample", 1.0))) if p.get("colsample", 1.0) < 1.0 else "all",
    }


def _per_class(gbt: GBTClassifier, binary: bool) -> Estimator:
    """Subsampled boosting is MLlib's, which is binary; several classes need one model each."""
    if binary:
        return gbt
    return OneVsRest(classifier=gbt, featuresCol=FEATURES, labelCol=LABEL)


def class_probabilities(scored: DataFrame) -> Column:
    """Array of class probabilities; derived from the margins when the model gives none."""
    if "probability" in scored.columns:
        return vector_to_array("probability")
    margins = vector_to_array("rawPrediction")
    # a boosted margin m stands for log-odds 2m
    odds = F.transform(margins, lambda m: 1.0 / (1.0 + F.exp(-2.0 * m)))
    total = F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)
    return F.transform(odds, lambda p: p / total)


def predictions(model, df: DataFrame, problem: Problem) -> DataFrame:
    """``df`` with prediction and, for classification, the ``probs`` array."""
    scored = model.transform(df)
    if problem.is_classification:
        scored = scored.withColumn("probs", class_probabilities(scored))
    return scored.drop("rawPrediction", "probability")
