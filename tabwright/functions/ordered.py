"""Global numbering and running totals without a single-task sort.

Small inputs use a plain window. Larger ones are range-partitioned, checkpointed (so that
sampled range bounds can never change on a retry), totalled per partition, and the totals
of earlier partitions are added to a window that only spans one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwright.session import LIMITS, reliable


def running_totals(
    df: DataFrame,
    group: list[str],
    order: list[str],
    totals: dict[str, Column],
    rows: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Add, per group in ascending ``order``, the sum of each column over *earlier* rows.

    Rows must be unique on (group, order); callers aggregate to that grain first, which
    also folds a value held by a third of all rows into one row.
    """
    limit = limit or LIMITS.task_rows
    n = df.count() if rows is None else rows
    valued = df.withColumns({f"_v_{k}": c for k, c in totals.items()})
    if n <= limit:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        out = valued.withColumns(
            {k: F.coalesce(F.sum(f"_v_{k}").over(w), F.lit(0)) for k in totals}
        )
        return out.drop(*[f"_v_{k}" for k in totals])

    parts = max(2, -(-n // max(limit // 2, 1)))
    ranged = reliable(
        valued.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id())
    )
    # at most (partitions + groups) rows: one per piece of a group in a partition
    pieces = ranged.groupBy(*group, "_part").agg(
        *[F.sum(f"_v_{k}").alias(f"_p_{k}") for k in totals]
    )
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        *group,
        "_part",
        *[F.coalesce(F.sum(f"_p_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in totals],
    )
    inner = (
        Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    # the window needs this partitioning anyway, so the join may shuffle; null groups meet as well
    side = offsets.select(*[F.col(c).alias(f"_k_{c}") for c in [*group, "_part"]], *[f"_o_{k}" for k in totals])
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*group, "_part"]]
    joined = ranged.join(side, same).drop(*[f"_k_{c}" for c in [*group, "_part"]])
    out = joined.withColumns(
        {k: F.col(f"_o_{k}") + F.coalesce(F.sum(f"_v_{k}").over(inner), F.lit(0)) for k in totals}
    )
    return out.drop("_part", *[f"_v_{k}" for k in totals], *[f"_o_{k}" for k in totals])


def dense_codes(
    df: DataFrame, group: list[str], value: str, code: str, rows: int | None = None, limit: int | None = None
) -> DataFrame:
    """Number the distinct, sorted values of each group 0, 1, 2, ..."""
    return running_totals(
        df, group, [value], {code: F.lit(1).cast("long")}, rows=rows, limit=limit
    )
