"""Fold-wise evaluation of candidates, and the leaderboard."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwright.functions.columns import quoted
from tabwright.operators import features as feat
from tabwright.operators import metrics as met
from tabwright.operators.folds import FOLD, assign_folds
from tabwright.operators.models import LABEL, WEIGHT, Candidate, TrainingFacts, predictions
from tabwright.operators.problem import LOWER_IS_BETTER, Problem, encode_label
from tabwright.session import ensure_checkpoint_dir, local_table, reliable, spread

SMALL_ROWS = 500_000
#: Encoded rows that one task of a fit on all rows reads.
FIT_ROWS = 200_000

RESULT_SCHEMA = (
    "model_id string, name string, fold int, metric string, value double, "
    "train_size bigint, val_size bigint, fit_seconds double"
)


@dataclass
class FoldedData:
    """Fold-tagged training data with the statistics every model needs.

    The rows are written once to the checkpoint folder: all models and trials then see the same
    folds, and a lost executor re-reads them instead of recomputing an assignment.
    """

    rows: DataFrame
    problem: Problem
    plan: feat.FeaturePlan
    k: int
    encodings: list[feat.Encoding]
    counts: dict[tuple[int, float], int]  # (fold, class) -> rows; class is -1 for regression
    moments: dict[int, tuple[int, float, float]]  # fold -> (rows, label mean, label variance)
    cached: dict[int, DataFrame] = field(default_factory=dict)

    @property
    def folds_at_once(self) -> int:
        """Folds are evaluated side by side only while k encoded copies are small."""
        return self.k if sum(m[0] for m in self.moments.values()) <= SMALL_ROWS else 1

    def sizes(self, fold: int) -> tuple[int, int]:
        total = sum(m[0] for m in self.moments.values())
        held = self.moments.get(fold, (0, 0.0, 0.0))[0]
        return total - held, held

    def facts(self, fold: int) -> TrainingFacts:
        kept = [m for f, m in self.moments.items() if f != fold]
        _, std = feat._pool(kept)
        return TrainingFacts(sum(m[0] for m in kept), std or 1.0)

    def weights(self, fold: int) -> dict[float, float]:
        """Balanced class weights n / (k * n_class) of the training rows."""
        per: dict[float, int] = {}
        for (f, c), n in self.counts.items():
            if f != fold:
                per[c] = per.get(c, 0) + n
        total = sum(per.values())
        return {c: total / (len(per) * n) for c, n in per.items()}

    def encoded(self, fold: int) -> DataFrame:
        """(fold, label, weight, features) with statistics fitted without ``fold``; kept for all models."""
        if fold not in self.cached:
            out = feat.transform(self.rows, self.encodings[fold])
            weight = F.lit(1.0)
            if self.problem.is_classification:
                for c, w in self.weights(fold).items():
                    weight = F.when(F.col(LABEL) == c, F.lit(w)).otherwise(weight)
            self.cached[fold] = out.select(FOLD, LABEL, weight.alias(WEIGHT), "features").persist()
        return self.cached[fold]

    def release(self, fold: int | None = None) -> None:
        for f in [fold] if fold is not None else list(self.cached):
            if f in self.cached:
                self.cached.pop(f).unpersist()


def fold_data(
    df: DataFrame, problem: Problem, plan: feat.FeaturePlan, k: int, key_cols: list[str] | None = None, seed: int = 42
) -> FoldedData:
    """Drop rows without a target, tag folds, and fit all k encodings in a few shared passes."""
    wanted = list(dict.fromkeys([*plan.inputs, problem.target, *(key_cols or [])]))
    labelled = encode_label(df.select(*[quoted(c) for c in wanted]), problem)
    n = problem.n_values  # rows with a target, counted by the detection
    folded = assign_folds(labelled, k, key_cols, seed, LABEL if problem.stratified else None, rows=n)
    rows = reliable(spread(folded.select(FOLD, LABEL, *[quoted(c) for c in plan.inputs]), n))
    grouped = rows.groupBy(FOLD, (F.col(LABEL) if problem.is_classification else F.lit(-1.0)).alias("c")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(LABEL).alias("mean"), F.var_pop(LABEL).alias("var"))
    found = grouped.collect()  # folds x classes rows
    counts = {(r[FOLD], r["c"]): r["n"] for r in found}
    moments = {}
    for j in range(k):
        parts = [(r["n"], r["mean"], r["var"]) for r in found if r[FOLD] == j]
        if parts:
            mean, std = feat._pool(parts)
            moments[j] = (sum(p[0] for p in parts), mean, std * std)
    return FoldedData(rows, problem, plan, k, feat.fit_folds(rows, plan, k, rows=n), counts, moments)


def evaluate_fold(
    data: FoldedData, fold: int, jobs: list[tuple[str, Candidate, dict]], seed: int, parallelism: int = 4
) -> list[tuple]:
    """Fit every (id, candidate, params) on the other folds and score them on ``fold``.

    Fits run concurrently on the same cached rows; one grouped job scores all of them.
    """
    ensure_checkpoint_dir(data.rows.sparkSession)
    rows = data.encoded(fold)
    train, held = rows.where(F.col(FOLD) != fold), rows.where(F.col(FOLD) == fold)
    n_train, n_held = data.sizes(fold)
    facts = data.facts(fold)

    def fit(job):
        _, candidate, params = job
        start = time.time()
        model = candidate.build(params, seed + fold, facts).fit(train)
        return model, time.time() - start

    with ThreadPoolExecutor(parallelism) as pool:
        fitted = list(pool.map(fit, jobs))
    scored = None
    for (job_id, _, _), (model, _) in zip(jobs, fitted):
        keep = [LABEL, F.col("prediction").cast("double").alias("prediction")]
        if data.problem.is_classification:
            keep.append("probs")
        part = predictions(model, held, data.problem).select(F.lit(job_id).alias("model_id"), *keep)
        scored = part if scored is None else scored.unionByName(part)
    if data.problem.is_classification:
        wide = met.classification_metrics(scored, max(len(data.problem.classes), 2), ["model_id"], rows=n_held * len(jobs))
    else:
        wide = met.regression_metrics(scored, ["model_id"])
    seconds = {job[0]: took for job, (_, took) in zip(jobs, fitted)}
    names = {job[0]: job[1].name for job in jobs}
    return [
        (r["model_id"], names[r["model_id"]], fold, r["metric"], r["value"], n_train, n_held, seconds[r["model_id"]])
        for r in met.as_long(wide, ["model_id"]).collect()  # models x metrics rows
    ]


def cross_validate(data: FoldedData, models: list[Candidate], seed: int = 42, parallelism: int = 4) -> DataFrame:
    """Fold-metric table (model_id, name, fold, metric, value, sizes, fit_seconds)."""
    jobs = [(m.model_id, m, {}) for m in models]

    def one(fold: int) -> list[tuple]:
        try:
            return evaluate_fold(data, fold, jobs, seed, parallelism)
        finally:
            data.release(fold)

    with ThreadPoolExecutor(data.folds_at_once) as pool:
        rows = [r for part in pool.map(one, range(data.k)) for r in part]
    return local_table(data.rows.sparkSession, rows, RESULT_SCHEMA)


def cv_summary(fold_metrics: DataFrame) -> DataFrame:
    """(model_id, metric, mean, std, folds): population deviation over folds."""
    return fold_metrics.groupBy("model_id", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("folds"))


def leaderboard(fold_metrics: DataFrame, primary: str, metric_names: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per model: primary mean and deviation, every metric mean, training time, rank (1 is best).

    Ties go to the earlier model in ``order``, else to the smaller id.
    """
    key = met.ALIASES.get(primary, primary)
    means = fold_metrics.groupBy("model_id").pivot("metric", metric_names).agg(F.avg("value"))
    figures = [F.avg("value").alias("cv_mean"), F.stddev_pop("value").alias("cv_std")]
    if "fit_seconds" in fold_metrics.columns:
        figures += [F.first("name").alias("name"), F.sum("fit_seconds").alias("train_seconds")]
    main = fold_metrics.where(F.col("metric") == key).groupBy("model_id").agg(*figures)
    best_first = F.col("cv_mean").asc() if primary in LOWER_IS_BETTER else F.col("cv_mean").desc()
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model_id")) if order else F.col("model_id")
    ranked = Window.orderBy(best_first, place)  # one row per model
    return main.join(F.broadcast(means), "model_id").withColumn("rank", F.row_number().over(ranked))


def fold_table(fold_metrics: DataFrame, metric_names: list[str]) -> DataFrame:
    """One row per model and fold with its metrics as columns."""
    return fold_metrics.groupBy("model_id", FOLD).pivot("metric", metric_names).agg(F.first("value"))


def fit_full(data_or_df: DataFrame, problem: Problem, plan: feat.FeaturePlan, candidate: Candidate, params: dict, seed: int = 42):
    """Fit encoder and model on every labelled row; returns a ``PipelineModel``."""
    from pyspark.ml import PipelineModel

    ensure_checkpoint_dir(data_or_df.sparkSession)
    wanted = list(dict.fromkeys([*plan.inputs, problem.target]))
    labelled = encode_label(data_or_df.select(*[quoted(c) for c in wanted]), problem)
    encoder = feat.TabularEncoder(plan).fit(labelled)
    weight = F.lit(1.0)
    total = sum(problem.counts)
    for code, n in enumerate(problem.counts):
        weight = F.when(F.col(LABEL) == float(code), F.lit(total / (len(problem.counts) * n))).otherwise(weight)
    n, dealt = problem.n_values, labelled
    if n > FIT_ROWS:  # dealt while they are narrow: files hold few bytes, and a size estimate over joins is no guide
        dealt = labelled.repartition(max(labelled.sparkSession.sparkContext.defaultParallelism, -(-n // FIT_ROWS)))
    rows = encoder.transform(dealt).select(LABEL, weight.alias(WEIGHT), "features")
    rows = (rows if n > FIT_ROWS else spread(rows, n)).persist()
    try:
        stats = rows.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(LABEL).alias("s")).first()
        model = candidate.build(params, seed, TrainingFacts(stats["n"], stats["s"] or 1.0)).fit(rows)
    finally:
        rows.unpersist()
    return PipelineModel([encoder, model])
