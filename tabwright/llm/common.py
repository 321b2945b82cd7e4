"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.session import scratch_path


_owner: tuple[str, Callable[[], None]] | None = None


def claim(name: str, clear: Callable[[], None]) -> None:
    """Say whose word cache a Python worker holds from now on; another operator's cache is dropped, because reused
    workers would else hold those of all stages at once."""
    global _owner
    if _owner and _owner[0] != name:
        _owner[1]()
        give_back()
    _owner = (name, clear)


def give_back() -> None:
    """Return freed memory to the system: an idle worker stays beside the next stages, which need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


#: Bytes of rows that a task hands to its Python worker at once. Spark's own 10,000 rows (64 MB) of whole texts are held
#: several times over, in the heap, in direct buffers and in the worker, and the heap does not shrink again.
ARROW_BYTES = 2 * 1024 * 1024
_ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_texts(rows: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """``mapInArrow`` for rows with whole texts: batches end at ``ARROW_BYTES``, a longer row is one of its own. Spark
    has this limit for a whole session only; where the user has set it, theirs holds."""
    conf = rows.sparkSession.conf
    if conf.get(_ARROW_LIMIT, None) is None:
        conf.set(_ARROW_LIMIT, str(ARROW_BYTES))
    return rows.mapInArrow(f, ddl)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: lineage is cut, a lost executor
    costs nothing, and later reads prune columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys that ``lookup`` answers by broadcast: those of more rows than the larger of HOT_ROWS and a HOT_KEYS-th of all.
HOT_KEYS = 10_000
HOT_ROWS = 2_000


def lookup(rows: DataFrame, side: DataFrame, by: list[str], n: str, total: int) -> DataFrame:
    """``rows`` with the columns of the one row of ``side`` that has their key ``by``; rows without one are dropped.

    ``n`` is a column of ``side``: how many of the ``total`` rows have the key. The most frequent keys, of which there
    are ``HOT_KEYS`` at most, are broadcast, and their rows are dealt out by their content instead of their key."""
    limit = max(HOT_ROWS, total // HOT_KEYS)
    found = F.struct(*(c for c in side.columns if c not in by and c != n))
    hot = side.where(F.col(n) > limit).select(*by, found.alias("_hot"))
    # a salt of 0 that the optimiser does not see through, or it would deal by the key alone
    cold = side.where(F.col(n) <= limit).select(*by, F.least(F.col(n), F.lit(0)).cast("int").alias("_salt"), found.alias("_cold"))
    salt = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*(c for c in rows.columns if c not in by)), F.lit(1 << 20)) + 1)
    dealt = rows.join(F.broadcast(hot), by, "left").withColumn("_salt", salt.cast("int"))
    joined = dealt.join(cold, [*by, "_salt"], "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    return joined.where("_found is not null").select(*rows.columns, "_found.*")


def text_or_empty(column: Column | str = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def runs_of_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal ``key`` from batches sorted by it; a run may span batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        values = t[key].to_pylist()
        start = 0
        for i, v in enumerate(values):
            if held or i:
                if v != last:
                    if i > start:
                        held.append(t.slice(start, i - start))
                    yield pa.concat_tables(held)
                    held, start = [], i
            last = v
        held.append(t.slice(start))
    if held:
        yield pa.concat_tables(held)
