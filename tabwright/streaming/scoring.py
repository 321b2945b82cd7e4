"""Streaming scoring: the batch scoring plan over a stream, stateless and append-only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tabwright.operators.score import score
from tabwright.sources.bundle import Bundle
from tabwright.sources.versions import Reloading


def read_records(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Stream of input records from a folder; the schema is given, never inferred."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def score_stream(
    records: DataFrame, bundle: Bundle, output: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True
) -> StreamingQuery:
    """Start scoring; ``checkpoint`` must be on shared storage for exactly-once file output."""
    writer = score(records, bundle).writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start(output)


def score_stream_latest(
    records: DataFrame, root: str, output: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True,
    after_batch: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Score every micro-batch with the newest bundle that is published under ``root`` when the batch begins.

    A new version takes over between two batches, without a restart; ``bundle_version`` tells which one scored a row.
    Each batch has its own folder below ``output``, which a repeated batch overwrites: every row is there once, scored
    by one version. ``after_batch`` is called with the number of each batch."""
    bundles = Reloading(root)

    def one(batch: DataFrame, number: int) -> None:
        version, bundle = bundles.current(batch.sparkSession)
        scored = score(batch, bundle).withColumn("bundle_version", F.lit(version).cast("bigint"))
        scored.write.format(fmt).mode("overwrite").save(f"{output}/batch={number}")
        if after_batch:
            after_batch(number)

    writer = records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
