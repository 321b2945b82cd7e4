"""Records of delimited text with quoted line breaks, read in parallel byte ranges.

A range of a file cannot tell by itself whether it begins inside a quoted field. But how it ends depends on that one
bit alone: so each range is summed up as a function of it, the functions are chained along the file, and then every
range can cut its own records. Only the pieces at range borders are moved to be joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.session import LIMITS, scratch_path

_BOM = b"\xef\xbb\xbf"
_LAYOUT = "file string, range bigint, part int, first boolean, value binary"


def text_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """file, range (its start in the file) and value (bytes of a line, a carriage return at its end included)."""
    lines = spark.read.option("lineSep", "\n").text(paths)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), "value")


def left_open(value: Column, delimiter: str) -> Column:
    """Whether a text ends inside a quoted field; a quote within an unquoted field opens none."""
    start = f"(^|{re.escape(delimiter)})"
    single = F.replace(value, F.lit('""'), F.lit(""))
    return F.regexp_replace(single, start + '"[^"]*"', "$1").rlike(start + '"')


def _with_states(lines: DataFrame, delimiter: str) -> DataFrame:
    """Lines with their state at the end (true: in a quoted field) if they begin outside (``a``) and inside (``b``)."""
    some = F.contains("value", F.lit('"'))
    return lines.select(
        "file", "range", F.col("value").cast("binary").alias("value"), (some & left_open(F.col("value"), delimiter)).alias("a"),
        (~some | left_open(F.concat(F.lit('"'), "value"), delimiter)).alias("b"))


def range_states(lines: DataFrame) -> DataFrame:
    """file, range and open: whether each range begins inside a quoted field.

    One pass sums up each range as the pair of its end states; a range either fixes the state, keeps it or turns it,
    so that the state before a range is the last fixed one, turned as often as ranges did since."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, a, b = None, False, True
        for batch in batches:
            for file, start, if_out, if_in in zip(*(batch[c].to_pylist() for c in ("file", "range", "a", "b"))):
                if (file, start) != key:
                    if key:
                        yield row(key, a, b)
                    key, a, b = (file, start), False, True
                a, b = if_in if a else if_out, if_in if b else if_out
        if key:
            yield row(key, a, b)

    def row(key: tuple[str, int], a: bool, b: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": key[0], "range": key[1], "a": a, "b": b}])

    states = lines.select("file", "range", "a", "b").mapInArrow(summed, "file string, range bigint, a boolean, b boolean")
    so_far = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    fixed = F.when(F.col("a") == F.col("b"), F.col("a"))
    turned = F.col("a") & ~F.col("b")
    turns = states.withColumn("turns", F.sum(turned.cast("int")).over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(fixed.isNotNull(), F.struct(fixed.alias("state"), "turns")), ignorenulls=True).over(so_far)
    known = turns.withColumn("last", last).withColumn("before", F.coalesce(F.lag("turns").over(Window.partitionBy("file").orderBy("range")), F.lit(0)))
    odd = (F.col("before") - F.coalesce("last.turns", F.lit(0))) % 2 == 1
    return known.select("file", "range", (F.coalesce("last.state", F.lit(False)) != odd).alias("open"))


def _pieces(lines: DataFrame) -> DataFrame:
    """Rows of ``_LAYOUT``: a record that lies in one range (part 1), or what a range has of the record that is open
    at its begin (part 0) or end (part 2). ``first`` marks the first record of a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, held, part, first = None, False, [], 1, False
        out: list[dict] = []

        def put(kind: int) -> None:
            out.append({"file": key[0], "range": key[1], "part": kind, "first": first and kind > 0, "value": b"\n".join(held)})

        for batch in batches:
            for file, start, value, if_out, if_in, entry in zip(*(batch[c].to_pylist() for c in ("file", "range", "value", "a", "b", "open"))):
                if (file, start) != key:
                    if held:
                        put(0 if part == 0 else 2)
                    key, state, held, part, first = (file, start), entry, [], 0 if entry else 1, start == 0
                    if start == 0:
                        value = value.removeprefix(_BOM)
                if not state and value in (b"", b"\r"):
                    continue
                held.append(value)
                state = if_in if state else if_out
                if not state:
                    put(part)
                    held, part, first = [], 1, False
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=batches_schema)
                out.clear()
        if held:
            put(0 if part == 0 else 2)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=batches_schema)

    batches_schema = pa.schema([("file", pa.string()), ("range", pa.int64()), ("part", pa.int32()), ("first", pa.bool_()), ("value", pa.binary())])
    return lines.mapInArrow(run, _LAYOUT)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the checkpoint folder: what reads it cuts no text again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted_records(spark: SparkSession, paths: list[str] | str, delimiter: str) -> DataFrame:
    """file, first (the first record of a file) and value (bytes) of every record, line breaks in quotes included.

    Blank records are left out; a record that is still open at the end of a file ends there. Files are split like any
    text; a record is as long as it needs to be, over any number of ranges. The records are cut once and written to
    the checkpoint folder, however often the result is read."""
    lines = _with_states(text_lines(spark, paths), delimiter)
    states = _stored(range_states(lines), "ranges")
    ranges = states.limit(LIMITS.broadcast_rows + 1).count()  # a row per split: some 64 TB of text up to the limit
    side = F.broadcast(states) if ranges <= LIMITS.broadcast_rows else states
    if ranges <= LIMITS.broadcast_rows:
        known = lines.join(side, ["file", "range"])
    else:  # the shuffle loses the order of lines, which is that of their ids
        numbered = lines.withColumn("line", F.monotonically_increasing_id())
        known = numbered.join(side, ["file", "range"]).repartition("file", "range").sortWithinPartitions("file", "range", "line")
    pieces = _stored(_pieces(known.select("file", "range", "value", "a", "b", "open")), "pieces")
    border = pieces.where("part != 1")
    order = Window.partitionBy("file").orderBy("range", "part")  # two rows a range at most
    joined = border.withColumn("record", F.sum((F.col("part") == 2).cast("int")).over(order)).groupBy("file", "record").agg(
        F.max("first").alias("first"), F.sort_array(F.collect_list(F.struct("range", "part", "value"))).alias("parts"))
    # text lines are joined as bytes: hex keeps any encoding
    whole = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["value"])), "0A"))
    records = pieces.where("part = 1").select("file", "first", "value").unionByName(joined.select("file", "first", whole.alias("value")))
    ended = F.when(F.substring("value", -1, 1) == F.lit(b"\r"), F.substring(F.col("value"), F.lit(1), F.length("value") - 1)).otherwise(F.col("value"))
    return records.select("file", "first", ended.alias("value"))
