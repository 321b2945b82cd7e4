"""A set of distinct values that stays small: at most a given number of values with their counts, or "there are more"."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class FewValues:
    """``values`` (as text, in the order of their type) and ``counts``; None if there are more."""

    values: list[str] | None
    counts: list[int] | None


def _bounded(column: DataFrame, limit: int) -> DataFrame:
    """(v, n, more): the values of each partition with their counts, or one row with ``more`` if they are over ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kind = None, None
        for batch in batches:
            kind = batch.schema.field("v").type
            values = pc.drop_null(batch["v"])
            if held is not None and len(held) > limit:
                continue
            counted = pc.value_counts(values)
            part = pa.table([counted.field("values"), counted.field("counts")], names=["v", "n"])
            both = part if held is None else pa.concat_tables([held, part])
            held = both.group_by("v").aggregate([("n", "sum")]).rename_columns(["v", "n"])
        if held is None:
            return
        if len(held) > limit:
            held = pa.table([pa.nulls(1, kind), pa.array([1], pa.int64())], names=["v", "n"])
            yield from held.append_column("more", pa.array([True])).to_batches()
        else:
            yield from held.append_column("more", pa.array([False] * len(held), pa.bool_())).combine_chunks().to_batches()

    return column.select("v").mapInArrow(run, f"v {column.schema['v'].dataType.simpleString()}, n bigint, more boolean")


def few_values(df: DataFrame, value: Column, limit: int) -> FewValues:
    """The distinct values of a column if they are at most ``limit``, in one scan.

    Every partition hands on at most ``limit`` rows, whatever the column holds, so that no more is grouped; null is no
    value, and 0.0 and -0.0 are one."""
    number = df.select(value.alias("v"))
    plain = number.select(F.when(F.col("v") == 0, 0).otherwise(F.col("v")).cast(number.schema["v"].dataType).alias("v")) if (
        number.schema["v"].dataType.simpleString() in ("float", "double")) else number
    merged = _bounded(plain, limit).groupBy("v", "more").agg(F.sum("n").alias("n"))
    found = merged.orderBy(F.col("more").desc(), "v").limit(limit + 1).select(F.col("v").cast("string").alias("v"), "n", "more").collect()
    if any(r["more"] for r in found) or len(found) > limit:
        return FewValues(None, None)
    return FewValues([r["v"] for r in found], [r["n"] for r in found])


def few_numbers(df: DataFrame, columns: list[Column], limit: int) -> DataFrame:
    """(idx, few): the values of each number column in order, with their counts; null if they are over ``limit``.

    One scan for all columns; a partition hands on at most ``limit`` rows of each. Columns without values have no row."""

    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict | None] = [{} for _ in range(width)]
        for batch in batches:
            for i, known in enumerate(held):
                if known is None:
                    continue
                counted = pc.value_counts(pc.drop_null(batch.column(i)))
                if len(counted) <= limit:
                    for v, n in zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist()):
                        known[v] = known.get(v, 0) + n
                if max(len(counted), len(known)) > limit:
                    held[i] = None
        rows = [(i, v, n) for i, known in enumerate(held) for v, n in ([(None, None)] if known is None else known.items())]
        kinds = (pa.int32(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["idx", "v", "n"])

    parts = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(run, "idx int, v double, n bigint")
    merged = parts.groupBy("idx", "v").agg(F.sum("n").alias("n"))
    whole = (F.count("v") == F.count(F.lit(1))) & (F.count("v") <= limit)  # a null stands for too many values
    return merged.groupBy("idx").agg(F.when(whole, F.array_sort(F.collect_list(F.struct("v", "n")))).alias("few"))
