"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import kept

BINS = 1024
QUERY_BLOCK = 1024
ROW_BLOCK = 4096
#: Bytes of query vectors that may be broadcast to the scoring tasks.
BROADCAST_BYTES = 64 * 1024 * 1024


def integer_vector(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null where the vector or a component is null or not finite."""
    x = embedding.cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(x.isNotNull() & finite, F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))))


def _blocks(rows: DataFrame) -> DataFrame:
    """Pack (vec_id, v) within each partition into rows (dim, block, ids, values, longest)."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            dims = np.asarray(batch["dim"])
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                for start in range(0, own.num_rows, ROW_BLOCK):
                    piece = own.slice(start, ROW_BLOCK)
                    values = np.asarray(piece["v"].flatten(), dtype=np.float64).reshape(piece.num_rows, dim)
                    yield pa.RecordBatch.from_pylist([{
                        "dim": int(dim), "block": (part << 32) + n, "ids": piece["vec_id"].to_pylist(),
                        "values": piece["v"].flatten().to_pylist(),
                        "longest": float(np.sqrt((values ** 2).sum(axis=1)).max()) if dim else 0.0}], schema=layout)
                    n += 1

    layout = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("values", pa.list_(pa.int64())), ("longest", pa.float64())])
    return rows.mapInArrow(packed, "dim int, block bigint, ids array<bigint>, values array<bigint>, longest double")


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products: in double where that is exact, else in 64-bit integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0 ** 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def _scored(pairs: DataFrame, emit: Callable[[dict, np.ndarray, np.ndarray], dict], layout: pa.Schema, ddl: str) -> DataFrame:
    """Score each (query block, row block) and let ``emit`` say what is kept of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                dim = row["dim"].as_py()
                array = lambda name: np.asarray(row[name].values, dtype=np.int64)
                state = {name: array(name) for name in ("query_ids", "lo", "hi", "need")}
                ids = array("ids")
                scores = _scores(array("vectors").reshape(len(state["query_ids"]), dim), array("values").reshape(len(ids), dim))
                out = emit(state, ids, scores)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in layout], schema=layout)

    return pairs.mapInArrow(run, ddl)


def _pairs(state: DataFrame, rows: DataFrame, blocks: int, small: bool) -> DataFrame:
    """Every query block beside every row block of its dimension."""
    queries = state.groupBy("dim", "qblock").agg(F.collect_list(F.struct("query_id", "v", "lo", "hi", "need")).alias("_q")).select(
        "dim", "qblock", F.col("_q.query_id").alias("query_ids"), F.flatten("_q.v").alias("vectors"),
        F.col("_q.lo").alias("lo"), F.col("_q.hi").alias("hi"), F.col("_q.need").alias("need"))
    if small:
        return rows.join(F.broadcast(queries), "dim")
    spots = rows.select("dim", "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("qblock"))
    return spots.join(queries, ["dim", "qblock"]).join(rows, ["dim", "block"])


def _histogram(state: dict, ids: np.ndarray, scores: np.ndarray, k: int, bins: int) -> dict:
    """Counts per bin of each query's interval, for the bins that the block's own k best reach: no lower bin of a
    block can decide where the k-th value of all rows lies."""
    lowest = np.iinfo(np.int64).min
    scores = np.where(ids[None, :] == state["query_ids"][:, None], lowest, scores)
    n = scores.shape[1]
    best = scores if n <= k else np.partition(scores, n - k, axis=1)[:, n - k:]
    lo, hi = state["lo"][:, None], state["hi"][:, None]
    width = (hi - lo) // bins + 1
    q, j = np.nonzero((best >= lo) & (best <= hi) & (best > lowest))
    key, counts = np.unique(q * bins + (best[q, j] - lo[q, 0]) // width[q, 0], return_counts=True)
    return {"query_id": state["query_ids"][key // bins], "bin": key % bins, "n": counts}


def _winners(state: dict, ids: np.ndarray, scores: np.ndarray, k: int) -> dict:
    """The block's rows at or above each query's k-th value, k at most by score and then smaller id."""
    own = ids[None, :] == state["query_ids"][:, None]
    q, j = np.nonzero((scores >= state["lo"][:, None]) & ~own)
    s = scores[q, j]
    order = np.lexsort((ids[j], -s, q))
    q, j, s = q[order], j[order], s[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(q)) + 1]) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff([*first, len(q)]).astype(np.int64))
    keep = place < k
    return {"query_id": state["query_ids"][q[keep]], "vec_id": ids[j[keep]], "score": s[keep]}


def exact_top_k(queries: DataFrame, rows: DataFrame, k: int = 5, bins: int = BINS) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best rows of each query by integer inner product.

    Both frames have vec_id and v (array of bigint, see ``integer_vector``). Rows with a null vec_id or v take no
    part; a row is compared with queries of its length only, and not with the query of its own vec_id. Queries that
    repeat a vec_id count once (the smallest vector). Ties go to the smaller vec_id; a query with fewer than ``k``
    rows gets all. No queries or rows give no result.
    Scores are taken to be below 2 ** 61.

    Each round scores everything in blocks and sums a histogram over the interval that holds a query's k-th value;
    that bin is the next interval, until it is one value wide. The rows at or above it are then ranked. Only the
    number of queries, their bytes and the longest vector reach the driver.
    """
    usable = lambda df: df.where("vec_id is not null and v is not null").select("vec_id", "v", F.size("v").alias("dim"))
    asked = usable(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    blocks = kept(_blocks(usable(rows)), "vectors")
    longest = blocks.agg(F.max("longest")).first()[0] or 0.0
    n, most = asked.agg(F.count(F.lit(1)), F.sum(8 * F.size("v") + 64)).first()
    parts = max(1, -(-n // QUERY_BLOCK))
    small = (most or 0) <= BROADCAST_BYTES
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    reach = F.ceil(F.least(norm * F.lit(longest) * F.lit(1.000001), F.lit(2.0 ** 61))) + 1
    state = kept(asked.select(
        F.col("vec_id").alias("query_id"), "v", "dim", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("qblock"),
        (-reach).alias("lo"), reach.alias("hi"), F.lit(k).cast("bigint").alias("need")), "queries")
    hist_layout = pa.schema([("query_id", pa.int64()), ("bin", pa.int64()), ("n", pa.int64())])
    while state.where("lo < hi").limit(1).count():
        open_ = state.where("lo < hi")
        found = _scored(_pairs(open_, blocks, parts, small), lambda s, i, x: _histogram(s, i, x, k, bins), hist_layout, "query_id bigint, bin bigint, n bigint")
        total = found.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        reached = total.withColumn("upto", F.sum("n").over(down)).join(state.select("query_id", "need"), "query_id")
        spot = reached.where("upto >= need").groupBy("query_id").agg(F.max(F.struct("bin", (F.col("upto") - F.col("n")).alias("above"))).alias("_spot"))
        width = F.expr(f"(hi - lo) div {bins}") + 1
        lower = F.col("lo") + F.col("_spot.bin") * width
        missing = F.col("_spot").isNull()  # fewer than k rows in all: every one of them is wanted
        moving = F.col("lo") < F.col("hi")
        state = kept(state.join(spot, "query_id", "left").select(
            "query_id", "v", "dim", "qblock",
            F.when(moving & ~missing, lower).otherwise(F.col("lo")).alias("lo"),
            F.when(moving & ~missing, F.least(F.col("hi"), lower + width - 1)).when(moving, F.col("lo")).otherwise(F.col("hi")).alias("hi"),
            F.when(moving & ~missing, F.col("need") - F.col("_spot.above")).otherwise(F.col("need")).alias("need")), "queries")
    layout = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    best = _scored(_pairs(state, blocks, parts, small), lambda s, i, x: _winners(s, i, x, k), layout, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
