"""Frequencies of long texts by digest: the texts themselves are neither shuffled nor held, but for the few that win."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.columns import present
from tabwright.session import LIMITS, fits, pinned

#: Characters of a text that its frequency row carries, to order equally frequent texts.
PREFIX = 24
_KEY = ["idx", "h", "g"]


def _digest(text: Column) -> Column:
    return F.struct(
        F.xxhash64(text).alias("h"), F.xxhash64(F.lit(PREFIX), text).alias("g"), F.octet_length(text).alias("bytes"),
        F.substring(text, 1, PREFIX).alias("prefix"))


def _texts(df: DataFrame, names: list[str], missing: str | None) -> list[Column]:
    texts = [present(df, c).cast("string") for c in names]
    return [F.coalesce(t, F.lit(missing)) for t in texts] if missing is not None else texts


def digest_counts(df: DataFrame, names: list[str], missing: str | None = None) -> DataFrame:
    """(idx, h, g, n, bytes, prefix, clash): a row per distinct text of each column, keyed by 128 bits.

    ``clash`` tells that texts of one key differ in length or beginning. Missing values are left out, or read as the
    text ``missing``."""
    cells = F.array(*[F.when(t.isNotNull(), _digest(t)) for t in _texts(df, names, missing)])
    rows = df.select(F.posexplode(cells).alias("idx", "d")).where("d is not null").select("idx", "d.*")
    return rows.groupBy(*_KEY).agg(
        F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"), F.min("prefix").alias("prefix"),
        ((F.min("bytes") != F.max("bytes")) | (F.min("prefix") != F.max("prefix"))).alias("clash"))


def _fetched(df: DataFrame, names: list[str], keys: DataFrame, missing: str | None) -> DataFrame:
    """(idx, n, v): the text of each of ``keys`` (idx, h, g, n), found by another scan of the columns."""
    cells = F.array(*[F.when(t.isNotNull(), F.struct(F.xxhash64(t).alias("h"), F.xxhash64(F.lit(PREFIX), t).alias("g"), t.alias("v")))
                      for t in _texts(df, names, missing)])
    rows = df.select(F.posexplode(cells).alias("idx", "d")).where("d is not null").select("idx", "d.*")
    side = F.broadcast(pinned(keys)) if fits(keys, LIMITS.task_rows // 100) else keys
    return rows.join(side, _KEY).groupBy(*_KEY).agg(F.first("n").alias("n"), F.min("v").alias("v")).select("idx", "n", "v")


def text_frequencies(df: DataFrame, names: list[str]) -> DataFrame:
    """(idx, n_non_null, n_distinct, text_bytes, top: struct of neg (minus the count) and v) of each text column.

    The most frequent text wins, of several the smallest. Shuffled are digests, and texts only of the rows whose
    column winner is still open: those that share the count and the beginning of the first. Where two texts have one
    128-bit key, the columns are counted by the texts themselves."""
    counts = digest_counts(df, names).persist()
    try:
        stats = pinned(counts.groupBy("idx").agg(  # a row per column
            F.sum("n").alias("n_non_null"), F.count(F.lit(1)).alias("n_distinct"), F.sum(F.col("n") * F.col("bytes")).alias("text_bytes"),
            F.min(F.struct((-F.col("n")).alias("neg"), "prefix")).alias("first"), F.bool_or("clash").alias("clash")))
        if not stats.where("clash").isEmpty():
            return _by_text(df, names)
        first = stats.select("idx", (-F.col("first.neg")).alias("n"), F.col("first.prefix").alias("prefix"))
        open_keys = counts.join(F.broadcast(first), ["idx", "n", "prefix"], "left_semi").select(*_KEY, "n")
        top = pinned(_fetched(df, names, open_keys, None).groupBy("idx").agg(F.min("v").alias("v")))
    finally:
        counts.unpersist()
    return stats.join(F.broadcast(top), "idx").select(
        "idx", "n_non_null", "n_distinct", "text_bytes", F.struct(F.col("first.neg").alias("neg"), "v").alias("top"))


def _by_text(df: DataFrame, names: list[str]) -> DataFrame:
    rows = df.select(F.posexplode(F.array(*_texts(df, names, None))).alias("idx", "v")).where("v is not null")
    counts = rows.groupBy("idx", "v").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("idx").agg(
        F.sum("n").alias("n_non_null"), F.count(F.lit(1)).alias("n_distinct"), F.sum(F.col("n") * F.octet_length("v")).alias("text_bytes"),
        F.min(F.struct((-F.col("n")).alias("neg"), "v")).alias("top"))


def top_texts(df: DataFrame, column: str, k: int, missing: str) -> DataFrame:
    """(value, n): the ``k`` most frequent texts of a column, equal counts in text order; missing ones as ``missing``."""
    counts = digest_counts(df, [column], missing).persist()
    try:
        if not counts.where("clash").isEmpty():
            rows = df.select(_texts(df, [column], missing)[0].alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
            return pinned(rows.orderBy(F.col("n").desc(), "value").limit(k))
        ahead = counts.orderBy(F.col("n").desc(), "prefix").limit(k).select("n", "prefix").collect()
        if not ahead:
            return counts.select(F.lit("").alias("value"), "n").limit(0)
        last = ahead[-1]  # the k-th; whatever shares its count and beginning is still open
        wanted = counts.where((F.col("n") > last["n"]) | ((F.col("n") == last["n"]) & (F.col("prefix") <= last["prefix"])))
        found = _fetched(df, [column], wanted.select(*_KEY, "n"), missing)
        return pinned(found.orderBy(F.col("n").desc(), "v").limit(k).select(F.col("v").alias("value"), "n"))
    finally:
        counts.unpersist()


def frequent_texts(df: DataFrame, names: list[str], k: int) -> DataFrame:
    """(idx, top: array of (v, n), rest): the ``k`` most frequent texts that occur twice or more, and the highest count of
    any other text of the column."""
    counts = digest_counts(df, names)
    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy("idx").orderBy(F.col("n").desc(), "prefix", "h", "g"))).where(F.col("place") <= k + 1)
    ahead = pinned(ranked.select(*_KEY, "n", "place"))  # k + 1 rows a column
    kept = ahead.where((F.col("place") <= k) & (F.col("n") > 1))
    texts = _fetched(df, names, kept.select(*_KEY, "n"), None).groupBy("idx").agg(F.collect_list(F.struct("v", "n")).alias("top"))
    rest = ahead.groupBy("idx").agg(F.coalesce(F.max(F.when((F.col("place") > k) | (F.col("n") == 1), F.col("n"))), F.lit(0)).alias("rest"))
    empty = F.array().cast("array<struct<v:string,n:bigint>>")
    return pinned(rest.join(texts, "idx", "left").select("idx", F.coalesce("top", empty).alias("top"), "rest"))
