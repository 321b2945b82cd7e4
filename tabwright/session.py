"""Size limits, reliable checkpoints and partition helpers shared by all operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Bounds that decide between a simple plan and its distributed form.

    ``task_rows``       rows one sorted window partition or one value-count buffer may hold
    ``broadcast_rows``  rows of a (key, code) dictionary that may be broadcast
    """

    task_rows: int = 2_000_000
    broadcast_rows: int = 500_000


LIMITS = Limits()
SPLIT_BYTES = 128 * 1024 * 1024
ROWS_PER_TASK = 5_000  # below this a further partition costs more than it saves

_ARROW = {
    "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
    "array<string>": pa.list_(pa.string()), "map<string,double>": pa.map_(pa.string(), pa.float64()),
    "map<string,string>": pa.map_(pa.string(), pa.string()),
}


def local_table(spark: SparkSession, rows: list[tuple], layout: str) -> DataFrame:
    """A small driver-made table as a local relation (no Python workers involved)."""
    fields = [f.strip().split(" ", 1) for f in re.split(r",\s+(?![^<]*>)", layout)]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    arrays = []
    for values, (_, kind) in zip(columns, fields):
        if kind.startswith("map"):
            values = [list(v.items()) if v is not None else None for v in values]
        arrays.append(pa.array(list(values), type=_ARROW[kind.strip()]))
    return spark.createDataFrame(pa.table(arrays, names=[f[0].strip("`") for f in fields]))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder; a private one is made only for local masters."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="tabwright-ckpt-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def reliable(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    import uuid

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan; nothing is executed."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Use every core for an input that is too small to be split into one task per slot.

    A table larger than one split per slot is returned unchanged, so nothing large is ever
    shuffled here. A known small row count gives fewer partitions, because tiny tasks cost
    more than they do.
    """
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    if rows is not None and rows < ROWS_PER_TASK * slots:
        return df.repartition(max(1, -(-rows // ROWS_PER_TASK)))
    if estimated_bytes(df) >= slots * SPLIT_BYTES:
        return df
    return df.repartition(slots)


def dealt(df: DataFrame) -> DataFrame:
    """Deal narrow rows over all cores before work that costs far more per row than to move it; files and joins
    of few bytes would leave that to a few tasks."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


@contextmanager
def shared(df: DataFrame, rows: int | None = None) -> Iterator[DataFrame]:
    """Input for several passes. A small table is spread and kept once; a large one is left
    alone, because pruned re-scans are cheaper than holding it."""
    wide = spread(df, rows)
    if wide is df:
        yield df
        return
    wide = wide.persist()
    try:
        yield wide
    finally:
        wide.unpersist()


def pinned(df: DataFrame) -> DataFrame:
    """Materialise a summary whose row count is bounded by the column (or class) count."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def fits(df: DataFrame, limit: int) -> bool:
    """True when ``df`` holds at most ``limit`` rows; stops counting just beyond it."""
    return df.limit(limit + 1).agg(F.count(F.lit(1))).first()[0] <= limit
