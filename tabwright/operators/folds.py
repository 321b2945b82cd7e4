"""Shuffled and stratified fold assignment with exactly balanced folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwright.functions.columns import one_row, quoted
from tabwright.operators.profile import row_digest
from tabwright.session import LIMITS, fits, reliable

FOLD = "fold"
#: Rows that one task may sort to number them.
FOLD_ROWS = 400_000


def _digest(key_cols: list[str], seed: int) -> Column:
    key = F.concat_ws("|", F.lit(str(seed)), *[quoted(k).cast("string") for k in key_cols])
    return F.md5(key.cast("binary"))


def assign_folds(
    df: DataFrame,
    k: int,
    key_cols: list[str] | None = None,
    seed: int = 42,
    label: str | None = None,
    rows: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Add ``fold`` in 0..k-1; fold sizes (per class when ``label`` is given) differ by at most 1.

    Rows are numbered in the order of a seeded digest of their key, and of their content where keys are equal or
    none is given, so that key, seed and rows alone decide at any size and file layout; only rows equal in every
    column may change places. A large table is numbered by sorted range partitions plus the row counts of earlier
    ones: only its own columns are shuffled, once, and written to the checkpoint folder, so that later passes sort
    nothing. A null label is a class of its own.
    """
    limit = limit or FOLD_ROWS
    n = df.count() if rows is None else rows
    content = row_digest(df)
    first = _digest(key_cols, seed) if key_cols else F.md5(F.concat(F.lit(f"{seed}|"), content).cast("binary"))
    order = {"_h": first, "_r": content}
    groups = {"_g": quoted(label)} if label else {}
    if n <= limit:
        place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order)) - 1
        numbered = df.withColumns({**order, **groups}).withColumn("_place", place)
    else:
        numbered = _numbered(df, groups, order, max(2, -(-n // max(limit // 2, 1))))
    return numbered.select(*[quoted(c) for c in df.columns], (F.col("_place") % k).cast("int").alias(FOLD))


def _numbered(df: DataFrame, groups: dict[str, Column], order: dict[str, Column], parts: int) -> DataFrame:
    """``df`` with ``_place``, the place of a row in its group. The digests are made anew after the shuffle, which
    is less than to move them; a row's place in its sorted partition is the low half of its id there."""
    tagged = df.withColumn("_t", F.monotonically_increasing_id())  # spreads copies of one row
    ranged = tagged.repartitionByRange(parts, *groups.values(), *order.values(), "_t")
    within = ranged.withColumns({**groups, **order}).sortWithinPartitions(*groups, *order, "_t")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    stored = reliable(within.select(
        *[quoted(c) for c in df.columns], *groups, F.spark_partition_id().alias("_part"), row.alias("_at")))
    # at most (partitions + groups) rows: one per piece of a group in a partition
    pieces = stored.groupBy("_part", *groups).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")
    side = reliable(pieces.select("_part", *groups, shift.alias("_shift")).select(
        F.col("_part").alias("_k_part"), *[F.col(g).alias(f"_k{g}") for g in groups], "_shift"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{c}")) for c in ["_part", *groups]]
    few = fits(side, LIMITS.broadcast_rows)
    return stored.join(F.broadcast(side) if few else side, same).withColumn("_place", F.col("_at") + F.col("_shift"))


def fold_sizes(folded: DataFrame, *by: str) -> DataFrame:
    return folded.groupBy(*by, FOLD).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): balanced weights n / (k * n_class); one row per class."""
    counts = df.where(quoted(label).isNotNull()).groupBy(quoted(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    return counts.withColumn("t", one_row(total)).select(
        "label", "n", (F.col("t.total") / (F.col("t.k") * F.col("n"))).cast("double").alias("weight"))
