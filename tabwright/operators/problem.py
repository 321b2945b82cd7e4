"""Detection of the modelling task from the target column."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import BOOLEAN, DATETIME, NUMERIC, TEXT, kind_of, present
from tabwright.functions.distinct import few_values
from tabwright.functions.ordered import dense_codes
from tabwright.operators.profile import instant
from tabwright.session import local_table

# Thresholds and names of the detection rules.
MAX_CLASSES = 20
DISCRETE_RATIO = 0.10
IMBALANCE = 2.0
BINARY, MULTICLASS, REGRESSION = "binary_classification", "multiclass_classification", "regression"
LOWER_IS_BETTER = {"rmse", "mae", "mse", "log_loss", "mape"}
METRICS = {
    BINARY: ["f1", "roc_auc", "accuracy", "precision", "recall"],
    MULTICLASS: ["f1_weighted", "accuracy", "precision_weighted", "recall_weighted"],
    REGRESSION: ["rmse", "mae", "r2"],
}


@dataclass
class Problem:
    """Task, metric and fold choice for one target. ``classes`` are in typed sort order and
    give the label codes 0..k-1 used everywhere: fit, metrics and decoding."""

    problem_type: str
    target: str
    target_dtype: str
    n_values: int
    n_distinct: int
    primary_metric: str
    metrics: list[str]
    stratified: bool
    classes: list[str] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    imbalance_ratio: float = 1.0
    imbalanced: bool = False
    reasons: list[str] = field(default_factory=list)

    @property
    def is_classification(self) -> bool:
        return self.problem_type != REGRESSION

    @property
    def higher_is_better(self) -> bool:
        return self.primary_metric not in LOWER_IS_BETTER

    def table(self, spark) -> DataFrame:
        """One-row problem table."""
        total = max(sum(self.counts), 1)
        shares = {c: round(n / total * 100, 2) for c, n in zip(self.classes, self.counts)}
        row = (self.problem_type, self.target, self.target_dtype, self.n_distinct, self.classes, shares,
               self.imbalanced, float(self.imbalance_ratio), self.primary_metric, self.metrics,
               "stratified" if self.stratified else "plain", self.reasons)
        return local_table(
            spark,
            [row],
            "problem_type string, target string, target_dtype string, n_distinct bigint, classes array<string>, "
            "class_distribution map<string,double>, imbalanced boolean, imbalance_ratio double, "
            "primary_metric string, metrics array<string>, cv_strategy string, reasons array<string>",
        )


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """(value, n, pct): share of each class in percent, rounded to 2."""
    counts = _value_counts(df, target)
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.select(
        F.col("v").cast("string").alias("value"), "n", F.round(F.col("n") * 100.0 / total, 2).alias("pct"))


def imbalance(df: DataFrame, target: str) -> DataFrame:
    """One row: majority share over minority share, rounded to 2, and the flag."""
    g = _value_counts(df, target).agg(F.max("n").alias("hi"), F.min("n").alias("lo"), F.sum("n").alias("total"))
    r = F.round((F.col("hi") / F.col("total")) / F.greatest(F.lit(1e-5), F.col("lo") / F.col("total")), 2)
    return g.select(r.alias("imbalance_ratio"), (r >= IMBALANCE).alias("imbalanced"))


def _value_counts(df: DataFrame, target: str) -> DataFrame:
    return (
        df.select(present(df, target).alias("v")).where("v is not null")
        .groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    )


def detect(df: DataFrame, target: str) -> Problem:
    """Decide the task. One scan tells whether the target has at most 20 distinct values, and lists them; every
    partition hands on no more than those. Only where there are more are they counted, for the report."""
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' not found in the table.")
    dtype = df.schema[target].dataType
    kind = kind_of(dtype)
    few = few_values(df, present(df, target), MAX_CLASSES)
    if few.values is not None:
        distinct, n = len(few.values), sum(few.counts)
    else:
        totals = _value_counts(df, target).agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n")).first()
        distinct, n = totals["d"], totals["n"]

    reasons = []
    if kind == BOOLEAN or (kind == NUMERIC and distinct == 2):
        task = BINARY
        reasons.append("The target has two values.")
    elif kind == TEXT:
        if distinct > MAX_CLASSES:
            raise ValueError(
                f"Target column '{target}' is text with {distinct} distinct values; it cannot be a class label.")
        task = BINARY if distinct == 2 else MULTICLASS
        reasons.append(f"The target is text with {distinct} classes.")
    elif kind == NUMERIC and distinct <= MAX_CLASSES and n and distinct / n < DISCRETE_RATIO:
        task = MULTICLASS
        reasons.append(f"The target is numeric with only {distinct} distinct values.")
    else:
        task = REGRESSION
        reasons.append(f"The target is continuous: {distinct} distinct values in {n} rows.")

    problem = Problem(task, target, dtype.simpleString(), n, distinct, "rmse", METRICS[task], task != REGRESSION,
                      reasons=reasons)
    if task == REGRESSION:
        reasons.append("Plain folds; the target has no classes to balance.")
        return problem
    problem.classes, problem.counts = few.values, few.counts
    if n:
        shares = [c / n for c in problem.counts]
        problem.imbalance_ratio = round(max(shares) / max(1e-5, min(shares)), 2)
    problem.imbalanced = problem.imbalance_ratio >= IMBALANCE
    if problem.imbalanced:
        reasons.append(f"Classes are imbalanced ({problem.imbalance_ratio}:1).")
    reasons.append("Stratified folds keep the class shares.")
    if task == BINARY:
        problem.primary_metric = "f1" if problem.imbalanced else "roc_auc"
    else:
        problem.primary_metric = "f1_weighted"
    return problem


def label_codes(df: DataFrame, target: str) -> DataFrame:
    """(value, code): classes in typed order (1, 2, 10) numbered from 0."""
    values = _value_counts(df, target).select("v")
    return dense_codes(values, [], "v", "code").select(F.col("v").cast("string").alias("value"), "code")


def encode_label(df: DataFrame, problem: Problem, name: str = "label") -> DataFrame:
    """Drop rows without a target and add the numeric label column."""
    y = present(df, problem.target)
    kept = df.where(y.isNotNull())
    if not problem.is_classification:
        dtype = df.schema[problem.target].dataType
        # a datetime is its microseconds, a date its days, since 1970
        number = instant(y, dtype) if kind_of(dtype) == DATETIME else y
        return kept.withColumn(name, number.cast("double"))
    known = F.array(*[F.lit(c) for c in problem.classes])  # at most 20 classes
    return kept.withColumn(name, (F.array_position(known, y.cast("string")) - 1).cast("double"))
