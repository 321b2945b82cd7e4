"""Removal of repeated runs of lines, found by prefix doubling over the line sequences of all documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import kept, lookup, map_texts

#: Words that a repeated run must have, and the fewer that one must have which occurs in OFTEN documents or more.
LEAST_WORDS = 50
COMMON_WORDS = 6
OFTEN = 30
_NO_ID = -(2 ** 63)
KEY = ("d", "f", "p")


def shortest_runs(words: list[int], least: int) -> list[list[int]]:
    """For each line, the lengths of the runs from it that have ``least`` words and cannot lose their last line, or
    cannot lose their first. Each run of ``least`` words or more is covered by such runs inside it."""
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words)])
    found: list[set[int]] = [set() for _ in range(n)]
    ends = np.searchsorted(total, total[:n] + least)  # first end with enough words
    for i in np.flatnonzero(ends <= n):
        found[i].add(int(ends[i]) - int(i))
    starts = np.searchsorted(total, total[1:] - least, side="right") - 1  # last start with enough words
    for e in np.flatnonzero(starts >= 0):
        found[int(starts[e])].add(int(e) + 1 - int(starts[e]))
    return [sorted(s - {0}) for s in found]


def fingerprint(text: Column) -> Column:
    return F.xxhash64(text)


def line_rows(docs: DataFrame, least: int, common: int = COMMON_WORDS) -> DataFrame:
    """A row (d, f, p, line, runs, common) per line: document key (doc_id, text fingerprint), place, digest, lengths of
    runs of ``least`` words, and of runs of ``common`` words that are not among them. Rows of ``docs`` that repeat
    doc_id and text give equal rows."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, f, p, ids, runs, short = [], [], [], [], [], []
            for doc, mark, text in zip(*(batch[c].to_pylist() for c in ("d", "f", "text"))):
                own = text.split("\n")
                d += [doc] * len(own)
                f += [mark] * len(own)
                p += range(len(own))
                ids += [hashlib.md5(x.encode("utf-8", "surrogatepass")).digest() for x in own]
                words = [len(x.split()) for x in own]
                long = shortest_runs(words, least)
                runs += long
                short += [[n for n in x if n not in y] for x, y in zip(shortest_runs(words, common), long)]
                if len(d) > 20_000:
                    yield batch_of(d, f, p, ids, runs, short)
                    d, f, p, ids, runs, short = [], [], [], [], [], []
            yield batch_of(d, f, p, ids, runs, short)

    def batch_of(d, f, p, ids, runs, short) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(d, pa.int64()), pa.array(f, pa.int64()), pa.array(p, pa.int32()), pa.array(ids, pa.binary()), *(pa.array(x, pa.list_(pa.int32())) for x in (runs, short))],
            names=["d", "f", "p", "line", "runs", "common"])

    rows = docs.where("text is not null").select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("d"), fingerprint(F.col("text")).alias("f"), "text")
    return map_texts(rows, lines, "d bigint, f bigint, p int, line binary, runs array<int>, common array<int>")


def _named(rows: DataFrame, total: int, often: int, *by: str) -> DataFrame:
    """Replace the columns ``by`` by rank ``r``: the first place in corpus order of an equal value. Rows whose value
    occurs at one place only are dropped, for no longer prefix of theirs can repeat; ``common`` is emptied where fewer
    than ``often`` rows have the value. A value may have any share of the at most ``total`` rows."""
    first = F.min(F.struct(*KEY))
    classes = rows.groupBy(*by).agg(
        first.alias("r"), F.max(F.struct(*KEY)).alias("_last"), F.count(F.lit(1)).alias("_n")).where("r != _last").drop("_last")
    classes = classes.withColumn("_often", F.col("_n") >= often)
    named = lookup(rows, classes, list(by), "_n", total)
    return named.withColumn("common", F.when(F.col("_often"), F.col("common"))).drop("_often", *by)


def _marked(lengths: str, long: bool) -> Column:
    return F.transform(F.coalesce(lengths, F.array().cast("array<int>")), lambda n: F.struct(n.alias("n"), F.lit(long).alias("long")))


def repeated_runs(docs: DataFrame, least: int = LEAST_WORDS, common: int = COMMON_WORDS, often: int = OFTEN) -> DataFrame:
    """Runs (d, f, p, n): ``n`` lines from line ``p`` of a document that also occur earlier, of ``least`` words or more,
    or of ``common`` words or more and in ``often`` documents or more.

    Prefix doubling: rank 0 of a place stands for its line, rank k for the 2**k lines from it, made of the ranks
    k-1 of the place and of the place 2**(k-1) on. Equal ranks are the intervals of the suffix array whose longest
    common prefix is at least 2**k lines; an interval of n lines is named by the ranks of its first and its last
    2**k lines. Places alone in their class leave, so only repeated lines go on. A place has one row, or the joins of
    places would multiply those of repeated documents.
    """
    rows = kept(line_rows(docs, least, common), "rows")
    level = kept(_named(rows, rows.count(), often, "line").distinct(), "lines")
    found, k = [], 0
    while True:
        size = 1 << k
        lengths = F.concat(_marked("runs", True), _marked("common", False))
        wanted = level.select(*KEY, "r", F.explode(lengths).alias("_run")).select(*KEY, "r", "_run.*").where(F.col("n").between(size, 2 * size - 1))
        tail = level.select("d", "f", F.col("p").alias("q"), F.col("r").alias("r2"))
        whole = wanted.withColumn("q", F.col("p") + F.col("n") - size).join(tail, ["d", "f", "q"])
        here = F.struct(*KEY)
        ranked = whole.groupBy("n", "r", "r2", "long").agg(
            F.min(here).alias("_first"), F.max(here).alias("_end"), F.count_distinct(F.when(~F.col("long"), F.struct("d", "f"))).alias("_docs")).where(
            F.col("long") & (F.col("_first") != F.col("_end")) | (F.col("_docs") >= often))
        found.append(whole.join(ranked, ["n", "r", "r2", "long"]).where(here != F.col("_first")).select(*KEY, "n"))
        more = level.where(F.greatest(F.array_max("runs"), F.array_max("common")) >= 2 * size)
        if not more.limit(1).count():
            break
        after = level.select("d", "f", (F.col("p") - size).alias("p"), F.col("r").alias("r2"))
        pairs = level.withColumnRenamed("r", "r1").join(after, list(KEY))
        level = kept(_named(pairs, level.count(), often, "r1", "r2"), "lines")
        k += 1
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def dedup_lines(docs: DataFrame, least: int = LEAST_WORDS, common: int = COMMON_WORDS, often: int = OFTEN) -> DataFrame:
    """``docs`` with their columns, text without later copies of repeated line runs, and two more columns: n_lines
    and deleted_lines (places from 0).

    Lines end at a line feed; a run is any number of neighbouring whole lines with ``least`` words together, or with
    ``common`` words where it occurs in ``often`` documents or more (the usual headers and footers). Of the copies
    of a maximal repeated run the first stays, in order of doc_id (null first), then text fingerprint, then place;
    copies may overlap and may lie in one document. Rows that repeat doc_id and text are one document. A null text
    stays null with no lines; an empty text has one empty line; no rows give no rows.
    """
    runs = repeated_runs(docs, least, common, often)
    gone = runs.select("d", "f", F.explode(F.sequence(F.col("p"), F.col("p") + F.col("n") - 1)).alias("line"))
    by_doc = gone.groupBy("d", "f").agg(F.sort_array(F.collect_set("line")).alias("_gone"))
    rows = docs.select(F.struct("*").alias("_row")).withColumn("_d", F.coalesce(F.col("_row.doc_id").cast("bigint"), F.lit(_NO_ID))).withColumn(
        "_f", fingerprint(F.col("_row.text")))
    found = rows.join(by_doc, (F.col("_d") == F.col("d")) & (F.col("_f") == F.col("f")), "left")
    text, lines = F.col("_row.text"), F.split(F.col("_row.text"), "\n", -1)
    left = F.array_join(F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains("_gone", i), x)), lambda x: x.isNotNull()), "\n")
    changed = F.when(F.col("_gone").isNull() | text.isNull(), text).otherwise(left)
    return found.select(
        *(changed.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns),
        F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce("_gone", F.array().cast("array<int>")).alias("deleted_lines"))
