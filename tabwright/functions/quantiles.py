"""Exact, interpolated quantiles that stay exact when a column has billions of values.

``percentile`` keeps one buffer entry per distinct value in a single task. That is right for small inputs. For larger
ones the values of the wanted ranks are found by radix selection over all columns at once, see ``rank_values``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwright.session import LIMITS, local_table

#: Counters that a task of the selection holds at most.
COUNTERS = 1 << 22


def quantile_columns(
    df: DataFrame,
    wanted: dict[str, Column],
    probs: list[float],
    rows: int | None = None,
    limit: int | None = None,
) -> dict[str, Column]:
    """Aggregate expressions (array<double>, one slot per probability) for ``df.agg``.

    Small inputs get Spark's exact ``percentile`` inside the caller's own aggregation;
    larger ones are solved here and returned as constants.
    """
    limit = limit or LIMITS.task_rows
    n = df.count() if rows is None else rows
    if n <= limit:
        return {k: F.percentile(c, F.array(*[F.lit(p) for p in probs])) for k, c in wanted.items()}
    solved = exact_quantiles(df, wanted, probs, limit)
    return {
        k: F.array(*[F.lit(v).cast("double") for v in values]) for k, values in solved.items()
    }


def ranked_quantiles(
    freq: DataFrame, group: str, value: str, weights: dict[str, Column], probs: list[float]
) -> DataFrame:
    """(group, n_distinct, total, <name>...) from a table of distinct values with counts.

    ``weights`` names one count column per wanted set; each yields an array of interpolated
    quantiles. One sort per group serves all sets, so a group must be small enough for one task.
    """
    sets = range(len(weights))
    ranked = freq.select(
        group, F.col(value).cast("double").alias("_v"), *[w.alias(f"_w{i}") for i, w in enumerate(weights.values())]
    )
    ranked = ranked.selectExpr("*", *[
        f"sum(_w{i}) OVER (PARTITION BY {group} ORDER BY _v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _c{i}"
        for i in sets
    ]).selectExpr("*", *[f"max(_c{i}) OVER (PARTITION BY {group}) AS _n{i}" for i in sets])
    picks = []
    for i in sets:
        for j, p in enumerate(probs):
            pos = f"(_n{i} - 1) * {float(p)}D"
            picks += [
                f"min(CASE WHEN _c{i} > floor({pos}) AND _w{i} > 0 THEN _v END) AS _a{i}_{j}",
                f"min(CASE WHEN _c{i} > ceil({pos}) AND _w{i} > 0 THEN _v END) AS _b{i}_{j}",
                f"max({pos}) AS _p{i}_{j}",
            ]
    found = ranked.groupBy(group).agg(*map(F.expr, ["count(1) AS n_distinct", "max(_n0) AS total", *picks]))
    between = lambda a, b, pos: f"if({a} = {b}, {a}, (floor({pos}) + 1 - {pos}) * {a} + ({pos} - floor({pos})) * {b})"
    return found.selectExpr(group, "n_distinct", "total", *[
        "array(" + ", ".join(between(f"_a{i}_{j}", f"_b{i}_{j}", f"_p{i}_{j}") for j in range(len(probs))) + f") AS {name}"
        for i, name in enumerate(weights)
    ])


def exact_quantiles(
    df: DataFrame, wanted: dict[str, Column], probs: list[float], limit: int
) -> dict[str, list[float | None]]:
    """``{name: [quantile, ...]}`` by ``rank_values``."""
    rows = df.select(F.array(*[c.cast("double") for c in wanted.values()]).alias("a"), F.lit(0).alias("part"))
    found = part_quantiles(rows, len(wanted), 1, False, probs, limit)
    return {name: found[i, 0] for i, name in enumerate(wanted)}


def part_quantiles(
    rows: DataFrame, width: int, parts: int, leave_out: bool, probs: list[float], limit: int | None = None
) -> dict[tuple[int, int], list[float | None]]:
    """Quantiles of every column of ``rows`` (a: array<double>, part: int) over all rows, or with ``leave_out`` over the
    rows outside each part; keys are (column, part left out)."""
    cells = rows.select("part", F.posexplode("a").alias("i", "x")).where("x is not null and not isnan(x)")
    counts: dict[tuple[int, int], int] = {}
    for r in cells.groupBy("i", "part").agg(F.count(F.lit(1)).alias("n")).collect():  # a row per column and part
        counts[r["i"], r["part"]] = r["n"]
    sets, wanted = {}, set()
    for i in range(width):
        for j in range(parts):
            n = sum(counts.get((i, p), 0) for p in range(parts) if not leave_out or p != j)
            sets[i, j] = [p * (n - 1) for p in probs] if n else None
            wanted |= {(i, j if leave_out else -1, rank) for pos in sets[i, j] or () for rank in (math.floor(pos), math.ceil(pos))}
    value = rank_values(rows, sorted(wanted), parts, limit or LIMITS.task_rows)
    out: dict[tuple[int, int], list[float | None]] = {}
    for (i, j), places in sets.items():
        at = lambda rank: value[i, j if leave_out else -1, rank]  # noqa: B023, E731
        out[i, j] = [_between(at(math.floor(pos)), at(math.ceil(pos)), pos) for pos in places] if places else [None] * len(probs)
    return out


def rank_values(
    rows: DataFrame, wanted: list[tuple[int, int, int]], parts: int, limit: int
) -> dict[tuple[int, int, int], float]:
    """The value of every wanted (column, part left out or -1, rank from 0 in ascending order).

    Doubles are read as 64-bit keys of the same order. Each round counts the keys under every open prefix by their
    next bits, map-side, and one row per search says which bits the rank has; all searches share a scan, and the plan
    has the same size for any number of columns and parts. Once at most ``limit`` values lie under the open prefixes,
    a last scan counts those one by one. A value that repeats in a third of all rows is one counter."""
    searches = [{"i": i, "left": j, "rank": rank, "prefix": 0, "known": 0, "at": rank} for i, j, rank in wanted]
    if not searches:
        return {}
    spark = rows.sparkSession
    under = None
    while searches[0]["known"] < 64:
        known = searches[0]["known"]
        cells = sorted({(s["i"], s["prefix"]) for s in searches})
        number = {cell: k for k, cell in enumerate(cells)}
        last = known > 0 and under is not None and under <= limit
        bits = 64 - known if last else min(64 - known, max(4, min(16, (COUNTERS // (len(cells) * parts)).bit_length() - 1)))
        counted = _key_counts(rows, cells, known, bits, parts, last).groupBy("cell", "part", "bucket").agg(F.sum("n").alias("n"))
        table = local_table(
            spark, [(k, number[s["i"], s["prefix"]], s["left"], s["at"]) for k, s in enumerate(searches)],
            "search bigint, cell bigint, left bigint, at bigint")
        own = counted.join(F.broadcast(table), "cell").where("part <> left")  # a row per search
        sums = own.groupBy("search", "at", "bucket").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("search").orderBy("bucket"))  # at most 2^16 buckets, or ``limit`` values
        hit = sums.withColumn("upto", upto).where("upto > at and upto - n <= at").collect()
        under = 0
        seen = set()
        for r in hit:
            s = searches[r["search"]]
            s.update(prefix=s["prefix"] << bits | r["bucket"], known=known + bits, at=s["at"] - (r["upto"] - r["n"]))
            if (s["i"], s["prefix"], s["left"]) not in seen:
                seen.add((s["i"], s["prefix"], s["left"]))
                under += r["n"]
    keys = np.array([s["prefix"] for s in searches], dtype=np.uint64)
    values = np.where(keys >> np.uint64(63) == 1, keys ^ np.uint64(1 << 63), ~keys).view(np.float64)
    return {(s["i"], s["left"], s["rank"]): float(v) for s, v in zip(searches, values)}


def _key_counts(rows: DataFrame, cells: list[tuple[int, int]], known: int, bits: int, parts: int, single: bool) -> DataFrame:
    """(cell, part, bucket, n): how many keys under the prefix of each (column, prefix) have which next ``bits``."""
    rest, below = np.uint64(64 - known), np.uint64(64 - known - bits)
    columns = sorted({i for i, _ in cells})
    names = pa.schema([("cell", pa.int64()), ("part", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None if single else np.zeros((len(cells), parts << bits), np.int64)
        for batch in batches:
            values = batch["a"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1) if batch.num_rows else None
            if values is None:
                continue
            part = batch["part"].to_numpy().astype(np.int64)
            keys = {}
            for i in columns:
                some = ~np.isnan(values[:, i])
                u = (values[some, i] + 0.0).view(np.uint64)  # -0.0 is 0.0
                keys[i] = np.where(u >> np.uint64(63) == 1, ~u, u | np.uint64(1 << 63)), part[some]
            for k, (i, prefix) in enumerate(cells):
                key, own = keys[i]
                if known:
                    under = key >> rest == np.uint64(prefix)
                    key, own = key[under], own[under]
                bucket = (key >> below if bits < 64 else key) & np.uint64((1 << bits) - 1)
                if single:
                    found, n = np.unique(np.stack([own, bucket.astype(np.int64)], axis=1), axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (np.full(len(n), k), found[:, 0], found[:, 1], n)], schema=names)
                else:
                    counts[k] += np.bincount(own << bits | bucket.astype(np.int64), minlength=parts << bits)
        if counts is not None:
            cell, at = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (cell, at >> bits, at & ((1 << bits) - 1), counts[cell, at])], schema=names)

    return rows.select("a", "part").mapInArrow(run, "cell bigint, part bigint, bucket bigint, n bigint")


def _between(lower: float, upper: float, pos: float) -> float:
    if lower == upper:
        return lower
    below = math.floor(pos)
    return (below + 1 - pos) * lower + (pos - below) * upper
