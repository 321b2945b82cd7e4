"""Profiles that grow with the table: a stored state per batch and column, merged without reading old data again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.functions.columns import (
    BOOLEAN,
    DATETIME,
    NUMERIC,
    TEXT,
    UNSUPPORTED,
    as_double,
    columns_of_kind,
    is_floating,
    kind_of,
    numeric_cells,
    present,
    quoted,
)
from tabwright.functions.distinct import few_numbers
from tabwright.functions.texts import frequent_texts
from tabwright.operators.profile import _describe, _fixed_width, _number_cells
from tabwright.session import local_table

#: Sizes of the sketches: distinct counts within about 0.8 %, ranks within about 0.5 %.
HLL_BITS = 14
KLL_SIZE = 800
#: Texts that a state keeps with their counts.
KEPT_TEXTS = 64
#: Values up to which a number column's state holds every value with its count.
KEPT_VALUES = 64

STATE = (
    "position int, column string, dtype string, kind string, width int, floating boolean, n_rows bigint, n bigint, text_bytes bigint, "
    "lo double, hi double, mean double, m2 double, m3 double, zeros bigint, ones bigint, distinct binary, ranks binary, "
    "top array<struct<v:string,n:bigint>>, rest bigint, few array<struct<v:double,n:bigint>>")
_NUMBERS = ["lo", "hi", "mean", "m2", "m3", "zeros", "ones", "ranks", "few"]
_PARTS = ["n", "text_bytes", *_NUMBERS, "distinct", "top", "rest"]


def _shaped(df: DataFrame, names: list[str], **columns: Column | str) -> DataFrame:
    kinds = dict(f.strip().split(" ", 1) for f in STATE.split(", "))
    labels = F.array(*[F.lit(c) for c in names])
    return df.select(F.get(labels, F.col("idx")).alias("column"), *[
        (F.col(columns[p]) if isinstance(columns.get(p), str) else columns.get(p, F.lit(None))).cast(kinds[p]).alias(p) for p in _PARTS])


def _numbers(df: DataFrame, numeric: list[str], dates: list[str]) -> DataFrame:
    names = [*numeric, *dates]
    found = _number_cells(df, names).groupBy("idx").agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.xxhash64("l", "d", "s"), HLL_BITS).alias("distinct"))
    if not numeric:
        return _shaped(found, names, n="n", distinct="distinct")
    x = F.col("x")
    m2 = F.var_pop(x) * F.count(x)
    moments = numeric_cells(df, numeric).groupBy("idx").agg(
        F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mean"), m2.alias("m2"),
        F.coalesce(F.skewness(x) * F.pow(m2, F.lit(1.5)) / F.sqrt(F.count(x)), F.lit(0.0)).alias("m3"),
        F.count_if(x == 0).alias("zeros"), F.count_if(x == 1).alias("ones"), F.kll_sketch_agg_double(x, KLL_SIZE).alias("ranks"))
    few = few_numbers(df, [as_double(df, c) for c in numeric], KEPT_VALUES)
    both = found.join(F.broadcast(moments), "idx", "left").join(F.broadcast(few), "idx", "left")  # a row per column
    return _shaped(both, names, n="n", distinct="distinct", **{c: c for c in _NUMBERS})


def _texts(df: DataFrame, names: list[str]) -> DataFrame:
    cells = F.array(*[present(df, c).cast("string") for c in names])
    rows = df.select(F.posexplode(cells).alias("idx", "v")).where("v is not null")
    counts = rows.groupBy("idx").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("v")).alias("text_bytes"),
        F.hll_sketch_agg(F.xxhash64("v"), HLL_BITS).alias("distinct"), F.min("v").alias("least"))
    both = counts.join(F.broadcast(frequent_texts(df, names, KEPT_TEXTS)), "idx", "left")  # a row per column
    least = F.array(F.struct(F.col("least").alias("v"), F.lit(1).cast("bigint").alias("n")))  # where every text occurs once
    return _shaped(both.withColumn("top", F.when(F.size("top") > 0, F.col("top")).otherwise(least)), names,
                   **{c: c for c in ("n", "text_bytes", "distinct", "top", "rest")})


def profile_state(df: DataFrame) -> DataFrame:
    """One row of ``STATE`` per column of a batch: counts, extremes, moments, sketches of distinct values and ranks, the
    values of number columns that have few, and the most frequent texts. ``rest`` is the highest count of a text that is not kept; of texts that occur once
    the smallest is kept where there are no others. The plan has a fixed size whatever the number of columns."""
    layout = local_table(
        df.sparkSession,
        [(i, f.name, f.dataType.simpleString(), kind_of(f.dataType), _fixed_width(f.dataType), is_floating(f.dataType)) for i, f in enumerate(df.schema.fields)],
        "position int, column string, dtype string, kind string, width int, floating boolean")
    rows = df.agg(F.count(F.lit(1))).scalar()
    parts = []
    numeric, dates = columns_of_kind(df, NUMERIC), columns_of_kind(df, DATETIME)
    if numeric or dates:
        parts.append(_numbers(df, numeric, dates))
    if text := [c for c in df.columns if kind_of(df.schema[c].dataType) in (TEXT, BOOLEAN)]:
        parts.append(_texts(df, text))
    if opaque := columns_of_kind(df, UNSUPPORTED):
        one = df.agg(*[F.count(quoted(c)).alias(f"c{i}") for i, c in enumerate(opaque)])
        cells = one.select(F.posexplode(F.array(*[F.col(f"c{i}") for i in range(len(opaque))])).alias("idx", "n"))
        parts.append(_shaped(cells, opaque, n="n"))
    stats = parts[0]
    for part in parts[1:]:
        stats = stats.unionByName(part)
    state = layout.join(stats, "column", "left").withColumn("n_rows", rows).withColumn("n", F.coalesce("n", F.lit(0)))
    return state.select(*[c.split(" ")[0] for c in STATE.split(", ")])


def save_state(state: DataFrame, path: str, batch: str) -> None:
    """Keep the state of a batch below ``path``; a batch that is written again replaces its own."""
    state.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def load_states(spark: SparkSession, path: str) -> DataFrame:
    """The states of every batch below ``path``, a row per batch and column."""
    return spark.read.schema(STATE).parquet(f"{path}/*")


def merge_states(states: DataFrame) -> DataFrame:
    """One state per column from those of any batches, in any order and grouping; states can be merged again."""
    column = Window.partitionBy("column")  # a row per batch
    mean = F.sum(F.col("n") * F.col("mean")).over(column) / F.nullif(F.sum(F.when(F.col("mean").isNotNull(), F.col("n"))).over(column), F.lit(0))
    d = F.col("mean") - F.col("_mean")
    shifted = states.withColumn("_mean", mean)
    merged = shifted.groupBy("column").agg(
        *[F.min(c).alias(c) for c in ("position", "dtype", "kind", "width", "floating")], F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n"),
        F.sum("text_bytes").alias("text_bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("_mean").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * d * d).alias("m2"),
        F.sum(F.col("m3") + 3 * d * F.col("m2") + F.col("n") * d * d * d).alias("m3"),
        F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("ranks").alias("ranks"), F.collect_list(F.struct("top", "rest")).alias("_tops"), F.sum("rest").alias("_rest"),
        F.count_if(F.col("lo").isNotNull() & F.col("few").isNull()).alias("_many"))
    numbers = states.select("column", F.explode("few").alias("f")).groupBy("column", "f.v").agg(F.sum("f.n").alias("n"))
    few = numbers.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("_few"))  # at most KEPT_VALUES a batch
    listed = states.select("column", F.explode("top").alias("t")).groupBy("column", "t.v").agg(F.sum("t.n").alias("n"))
    ranked = listed.withColumn("_place", F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").desc(), "v")))
    tops = ranked.where(F.col("_place") <= KEPT_TEXTS + 1).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("_place", "v", "n"))).alias("_top"))
    out = merged.join(tops, "column", "left").join(few, "column", "left").withColumn(
        "few", F.when((F.col("_many") == 0) & (F.size("_few") <= KEPT_VALUES), F.col("_few")))
    kept = F.transform(F.slice("_top", 1, KEPT_TEXTS), lambda t: F.struct(t["v"].alias("v"), t["n"].alias("n")))
    next_one = F.coalesce(F.get("_top", F.lit(KEPT_TEXTS))["n"], F.lit(0))
    # a text that a batch did not keep occurs there ``rest`` times at most
    rest = F.when(F.col("_rest").isNotNull(), F.col("_rest") + next_one)
    return out.withColumn("top", F.coalesce(kept, F.when(F.col("_rest").isNotNull(), F.array().cast("array<struct<v:string,n:bigint>>")))).withColumn("rest", rest).select(
        *[c.split(" ")[0] for c in STATE.split(", ")])


def state_profile(state: DataFrame) -> DataFrame:
    """Profile table of a state, as ``column_profile`` gives it.

    Counts, shares, extremes, mean, deviation, skewness and bytes are exact, and so are the quartiles of columns of at most
    ``KEPT_VALUES`` numbers; distinct counts and other quartiles come from sketches. ``top_exact`` tells whether no text that was left out can be the most frequent one. ``is_exact`` is true
    for columns without values of a sketched kind."""
    n = F.col("n").cast("double")
    flat = (F.col("n") <= 1) | (F.col("lo") == F.col("hi"))
    g1 = F.sqrt(n) * F.col("m3") / F.nullif(F.pow("m2", F.lit(1.5)), F.lit(0.0))
    skew = F.when((F.col("n") <= 2) | flat, F.lit(0.0)).otherwise(F.coalesce(g1 * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2.0, F.lit(0.0)), F.lit(0.0)))
    number = F.col("lo").isNotNull()
    zero_one = F.coalesce((F.col("zeros") > 0) & (F.col("ones") > 0) & (F.col("zeros") + F.col("ones") == F.col("n")), F.lit(False))
    best = F.array_sort(F.transform("top", lambda t: F.struct((-t["n"]).alias("less"), t["v"].alias("v"))))
    upto = F.transform("few", lambda t, i: F.struct(t["v"].alias("v"), F.aggregate(
        F.slice("few", F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda total, f: total + f["n"]).alias("n")))

    def quartile(p):
        place = (F.element_at("_upto", -1)["n"] - 1) * p
        at = lambda k: F.get(F.filter("_upto", lambda t: t["n"] > k), F.lit(0))["v"]
        low, high = at(F.floor(place)), at(F.ceil(place))
        exact = F.when(low == high, low).otherwise((F.floor(place) + 1 - place) * low + (place - F.floor(place)) * high)
        return F.when(F.size("_upto") > 0, exact).otherwise(F.when(number, F.kll_sketch_get_quantile_double("ranks", F.lit(p))))

    rows = state.agg(F.max("n_rows")).first()[0] or 0  # every column has the rows of the table
    shaped = state.withColumn("_best", F.get(best, F.lit(0))).withColumn("_upto", upto).select(
        "position", "column", "dtype", "kind", "width", F.col("n").alias("n_non_null"),
        F.when(F.col("kind") != UNSUPPORTED, F.when(F.col("distinct").isNotNull(), F.hll_sketch_estimate("distinct")).otherwise(F.lit(0))).alias("n_distinct"),
        F.col("lo").alias("min"), F.col("hi").alias("max"), "mean",
        F.when(number, F.when(flat, F.lit(0.0)).otherwise(F.sqrt(F.col("m2") / (n - 1.0)))).alias("std"),
        F.when(number, skew).alias("skew"), quartile(0.25).alias("q25"), quartile(0.5).alias("median"), quartile(0.75).alias("q75"),
        zero_one.alias("zero_one"),
        F.when(zero_one, F.concat(F.when(F.col("zeros") >= F.col("ones"), "0").otherwise("1"), F.when(F.col("floating"), ".0").otherwise("")))
        .otherwise(F.col("_best.v")).alias("top_value"),
        F.when(zero_one, F.greatest("zeros", "ones")).otherwise(-F.col("_best.less")).alias("top_count"),
        F.when(F.col("kind") == TEXT, F.col("text_bytes")).alias("text_bytes"),
        (F.col("top").isNull() | (F.coalesce(-F.col("_best.less"), F.lit(0)) > F.col("rest")) | (F.col("n") == 0)).alias("top_exact"))
    table = _describe(shaped, rows, True)
    return table.join(F.broadcast(shaped.select("column", "top_exact")), "column").withColumn(  # a row per column
        "is_exact", (F.col("n_non_null") == 0) | F.col("n_distinct").isNull())
