"""Evaluation metrics over prediction tables.

A prediction table has ``label``, ``prediction`` (class codes or values) and, for
classification, ``probs`` (array of class probabilities). ``group`` columns, such as model
and fold, give one metric row per group in the same job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import is_flat, one_row, ratio
from tabwright.functions.ordered import running_totals

# Fixed value: smallest probability and denominator (double precision epsilon).
EPS = 2.220446049250313e-16
ALIASES = {"f1_weighted": "f1", "precision_weighted": "precision", "recall_weighted": "recall"}


def confusion_counts(pred: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group..., label, prediction, n) of the pairs that occur."""
    return pred.groupBy(*(group or []), "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(pred: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Zero-filled matrix over the sorted union of labels and predictions."""
    group = group or []
    counts = confusion_counts(pred, group)
    classes = counts.select(*group, F.explode(F.array("label", "prediction")).alias("c")).distinct()
    # classes x classes: the class count is bounded by the detection rule
    listed = classes.groupBy(*group).agg(F.collect_set("c").alias("cs"))
    rows = listed.select(*group, "cs", F.explode("cs").alias("label"))
    grid = rows.select(*group, "label", F.explode("cs").alias("prediction"))
    return grid.join(counts, [*group, "label", "prediction"], "left").select(
        *group, "label", "prediction", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_scores(pred: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group..., class, support, predicted, tp, precision, recall, f1); 0 on a zero division."""
    group = group or []
    counts = confusion_counts(pred, group)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("tp")),
        F.struct(F.col("prediction").alias("class"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")),
    )
    per = (
        counts.select(*group, F.explode(sides).alias("s")).select(*group, "s.*")
        .groupBy(*group, "class")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    )
    zero_safe = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    return per.select(
        "*",
        zero_safe(F.col("tp"), F.col("predicted")).alias("precision"),
        zero_safe(F.col("tp"), F.col("support")).alias("recall"),
        zero_safe(F.col("tp") * 2, F.col("predicted") + F.col("support")).alias("f1"),
    )


def label_metrics(pred: DataFrame, group: list[str] | None = None, binary: bool = True) -> DataFrame:
    """(group..., accuracy, precision, recall, f1): class 1 if binary, else weighted by support."""
    group = group or []
    per = class_scores(pred, group)
    total = F.sum("support")
    if binary:
        pick = lambda m: F.coalesce(F.max(F.when(F.col("class") == 1.0, F.col(m))), F.lit(0.0))
    else:
        pick = lambda m: ratio(F.sum(F.col(m) * F.col("support")), total)
    return per.groupBy(*group).agg(
        ratio(F.sum("tp"), total).alias("accuracy"),
        *[pick(m).alias(m) for m in ("precision", "recall", "f1")],
    )


def log_loss(pred: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group..., log_loss, labels): clipped cross-entropy of the true class."""
    p = F.coalesce(F.get("probs", F.col("label").cast("int")), F.lit(0.0))
    clipped = F.least(F.greatest(p, F.lit(EPS)), F.lit(1.0 - EPS))
    return pred.groupBy(*(group or [])).agg(
        F.avg(-F.log(clipped)).alias("log_loss"),
        F.min("label").alias("_lo"), F.max("label").alias("_hi"),
    )


def auc_table(scores: DataFrame, group: list[str], rows: int | None = None, limit: int | None = None) -> DataFrame:
    """(group..., auc, positives, negatives) of a (group..., score, positive) table, ties half.

    Rows are folded to distinct scores first; the rank sum then needs a running total over
    distinct scores, which is range-partitioned when there are many.
    """
    pos = F.col("positive").cast("long")
    per_score = scores.groupBy(*group, "score").agg(F.sum(pos).alias("p"), F.sum(1 - pos).alias("q"))
    n = scores.count() if rows is None else rows
    ranked = running_totals(per_score, group, ["score"], {"below": F.col("q")}, rows=n, limit=limit)
    wins = F.col("p").cast("double") * (F.col("below").cast("double") + F.col("q").cast("double") / 2.0)
    return ranked.groupBy(*group).agg(
        F.sum(wins).alias("u"), F.sum("p").alias("positives"), F.sum("q").alias("negatives")
    ).select(
        *group, ratio(F.col("u"), F.col("positives").cast("double") * F.col("negatives").cast("double")).alias("auc"),
        "positives", "negatives",
    )


def roc_auc(pred: DataFrame, group: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """(group..., auc, positives, negatives) for class 1; auc is NULL when one class is absent."""
    scores = pred.select(*(group or []), F.get("probs", F.lit(1)).alias("score"), (F.col("label") == 1.0).alias("positive"))
    return auc_table(scores, group or [], rows)


def roc_auc_ovr(pred: DataFrame, n_classes: int, group: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """(group..., auc, classes): one-vs-rest AUC weighted by class prevalence."""
    group = group or []
    cells = pred.select(*group, "label", F.posexplode(F.slice("probs", 1, n_classes)).alias("class", "score"))
    scores = cells.select(*group, "class", "score", (F.col("label") == F.col("class")).alias("positive"))
    n = pred.count() if rows is None else rows
    per = auc_table(scores, [*group, "class"], rows=n * n_classes)
    return per.groupBy(*group).agg(
        # a class without both kinds of rows leaves the whole figure undefined
        F.when(F.count("auc") == F.count(F.lit(1)), ratio(F.sum(F.col("auc") * F.col("positives")), F.sum("positives"))).alias("auc"),
        F.count(F.lit(1)).alias("classes"),
    )


def classification_metrics(
    pred: DataFrame, n_classes: int, group: list[str] | None = None, rows: int | None = None
) -> DataFrame:
    """One row per group: accuracy, precision, recall, f1, roc_auc, log_loss, undefined.

    When AUC and log loss are undefined they read 0.5 and 0.0, and ``undefined`` is true.
    """
    group = group or []
    binary = n_classes <= 2
    labels = label_metrics(pred, group, binary)
    loss = log_loss(pred, group)
    auc = roc_auc(pred, group, rows) if binary else roc_auc_ovr(pred, n_classes, group, rows)
    auc = auc.select(*group, "auc")
    if group:
        joined = labels.join(loss, group).join(auc, group)
    else:
        joined = labels.withColumns({"l": one_row(loss), "a": one_row(auc)})  # one row each
        joined = joined.select("*", "l.*", "a.*")
    undefined = F.col("auc").isNull() | (F.col("_lo") == F.col("_hi"))
    return joined.select(
        *group, "accuracy", "precision", "recall", "f1",
        F.when(undefined, F.lit(0.5)).otherwise(F.col("auc")).alias("roc_auc"),
        F.when(undefined, F.lit(0.0)).otherwise(F.col("log_loss")).alias("log_loss"),
        undefined.alias("undefined"),
    )


def regression_metrics(pred: DataFrame, group: list[str] | None = None) -> DataFrame:
    """One row per group: mae, mse, rmse, r2, explained_variance, mape; one aggregation."""
    y, e = F.col("label").cast("double"), F.col("label").cast("double") - F.col("prediction").cast("double")
    sse = F.sum(e * e)
    return pred.groupBy(*(group or [])).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        _explained(sse, F.var_pop(y) * F.count(y), F.max(F.abs(e)) == 0.0, is_flat(y)).alias("r2"),
        _explained(F.var_pop(e), F.var_pop(y), is_flat(e), is_flat(y)).alias("explained_variance"),
        F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(EPS))).alias("mape"),
    )


def _explained(error, total, perfect, constant):
    """1 - error / total; a constant target scores 1 when perfect and 0 otherwise."""
    return F.when(constant, F.when(perfect, 1.0).otherwise(0.0)).otherwise(1.0 - F.try_divide(error, total))


def as_long(metrics: DataFrame, group: list[str]) -> DataFrame:
    """(group..., metric, value): unpivoted metric row."""
    names = [c for c in metrics.columns if c not in group and c != "undefined"]
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])
    return metrics.select(*group, F.explode(cells).alias("e")).select(*group, "e.metric", "e.value")


def primary_of(values: dict[str, float], wanted: str | None, classification: bool) -> tuple[str, float]:
    """Primary metric with its fallback (f1 or rmse); weighted names mean the weighted values."""
    name = wanted or ""
    key = ALIASES.get(name, name)
    if key not in values:
        name = key = "f1" if classification else "rmse"
    return name, values[key]


def report(metrics: DataFrame, digits: int = 4) -> DataFrame:
    """Metric values rounded for display."""
    return metrics.withColumn("value", F.round("value", digits))
