"""Table and target checks made before any analysis."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import UNSUPPORTED, kind_of, present
from tabwright.session import local_table

# Floors of the validation rules.
MIN_ROWS = 25
MIN_COLUMNS = 2

FINDING_SCHEMA = "severity string, code string, message string, n bigint"


def schema_findings(df: DataFrame, target: str | None = None) -> list[tuple]:
    """Checks that need no data: duplicate names, column floor, absent target."""
    found = []
    repeated = sorted(c for c, k in Counter(df.columns).items() if k > 1)
    if len(df.columns) < MIN_COLUMNS:
        found.append(
            ("error", "TOO_FEW_COLUMNS",
             f"The table has {len(df.columns)} column(s); at least {MIN_COLUMNS} are needed.",
             len(df.columns))
        )
    if repeated:
        found.append(
            ("error", "DUPLICATE_COLUMNS", "Column names occur more than once: " + ", ".join(repeated),
             len(repeated))
        )
    if target is not None and target not in df.columns:
        found.append(("error", "TARGET_MISSING", f"Target column '{target}' not found in the table.", 1))
    return found


def validate(df: DataFrame, target: str | None = None) -> DataFrame:
    """Findings table (severity, code, message, n): one aggregation over the whole table."""
    spark = df.sparkSession
    static = schema_findings(df, target)
    findings = local_table(spark, static, FINDING_SCHEMA)
    if any(code == "DUPLICATE_COLUMNS" for _, code, _, _ in static):
        # ambiguous names cannot be referenced: only the row floor is left to check
        counted = df.agg(F.count(F.lit(1)).alias("rows"))
        return findings.unionByName(_stack(counted, [_row_floor()]))

    names = df.columns
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count(present(df, c)).alias(f"c{i}") for i, c in enumerate(names)]
    rules = [_row_floor()]
    empty = F.filter(
        F.array(*[F.when(F.col(f"c{i}") == 0, F.lit(c)) for i, c in enumerate(names)]),
        lambda c: c.isNotNull(),
    )
    rules.append(
        F.when(
            (F.size(empty) > 0) & (F.col("rows") > 0),
            _finding("warning", "EMPTY_COLUMNS",
                     F.concat(F.lit("Columns without any value: "), F.array_join(empty, ", ")),
                     F.size(empty)),
        )
    )
    if target in names:
        t = names.index(target)
        kept, missing = F.col(f"c{t}"), F.col("rows") - F.col(f"c{t}")
        if kind_of(df.schema[target].dataType) != UNSUPPORTED:
            # a minimum and a maximum tell "fewer than two values" without a distinct shuffle
            aggs += [F.min(present(df, target)).alias("t_lo"), F.max(present(df, target)).alias("t_hi")]
            single = (kept == 0) | (F.col("t_lo") == F.col("t_hi"))
        else:
            single = kept == 0
        share = F.round(missing * F.lit(100.0) / F.col("rows"), 1)
        rules.append(
            F.when(
                (F.col("rows") > 0) & (kept == 0),
                _finding("error", "TARGET_ALL_NULL",
                         F.lit(f"Target column '{target}' has no values."), missing),
            )
        )
        rules.append(
            F.when(
                (missing > 0) & (kept > 0),
                _finding("warning", "TARGET_HAS_NULLS",
                         F.concat(F.lit(f"Target column '{target}' lacks a value in "),
                                  missing.cast("string"), F.lit(" row(s) ("), share.cast("string"),
                                  F.lit("%).")), missing),
            )
        )
        rules.append(
            F.when(
                single,
                _finding("error", "TARGET_SINGLE_VALUED",
                         F.lit(f"Target column '{target}' needs at least 2 distinct values."),
                         F.when(kept == 0, 0).otherwise(1)),
            )
        )
    return findings.unionByName(_stack(df.agg(*aggs), rules))


def verdict(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row: is_valid, error and warning counts, row and column counts."""
    findings = validate(df, target)
    totals = findings.agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    size = df.agg(F.count(F.lit(1)).alias("row_count"))
    return totals.select(
        (F.col("errors") == 0).alias("is_valid"),
        "errors",
        "warnings",
        size.scalar().alias("row_count"),
        F.lit(len(df.columns)).cast("long").alias("column_count"),
    )


def require_columns(df: DataFrame, names: list[str]) -> None:
    absent = [c for c in names if c not in df.columns]
    if absent:
        raise ValueError("missing feature columns: " + ", ".join(absent))


def _row_floor():
    rows = F.col("rows")
    return F.when(
        rows == 0, _finding("error", "EMPTY_TABLE", F.lit("The table has no rows."), rows)
    ).when(
        rows < MIN_ROWS,
        _finding("error", "TOO_FEW_ROWS",
                 F.concat(F.lit(f"Minimum {MIN_ROWS} rows are required; found "),
                          rows.cast("string"), F.lit(".")), rows),
    )


def _finding(severity, code, message, n):
    return F.struct(
        F.lit(severity).alias("severity"),
        F.lit(code).alias("code"),
        message.alias("message"),
        n.cast("long").alias("n"),
    )


def _stack(one_row: DataFrame, rules: list) -> DataFrame:
    return (
        one_row.select(F.explode(F.array(*rules)).alias("f"))
        .where(F.col("f").isNotNull())
        .select("f.*")
    )


