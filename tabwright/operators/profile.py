"""Column and dataset profile.

The plan has a fixed size whatever the number of columns: numeric columns are read as
(column, value) cells and aggregated by column; distinct counts come from value-frequency
tables grouped by (column, value), so a hot value is folded map-side. Only the finished
profile, one row per column, is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import (
    BOOLEAN,
    DATETIME,
    NUMERIC,
    TEXT,
    UNSUPPORTED,
    adjusted_skew,
    as_double,
    columns_of_kind,
    is_floating,
    kind_of,
    numeric_cells,
    one_row,
    present,
    quoted,
    ratio,
    sample_std,
)
from tabwright.functions.quantiles import part_quantiles, ranked_quantiles
from tabwright.functions.texts import text_frequencies
from tabwright.session import LIMITS, local_table, pinned, shared

# Thresholds of the semantic-type rules.
HIGH_CARDINALITY = 50
ID_RATIO = 0.95
ID_MIN_ROWS = 30

PROFILE_COLUMNS = [
    "position", "column", "dtype", "semantic_type", "n_rows", "n_non_null", "null_count", "null_pct",
    "n_distinct", "distinct_ratio", "is_constant", "is_high_cardinality", "min", "max", "mean", "std",
    "median", "q25", "q75", "skew", "top_value", "top_count", "top_pct", "data_bytes", "is_exact",
]


def value_counts(df: DataFrame, names: list[str], value: str = "string") -> DataFrame:
    """Frequency table (idx, v, n) of the non-missing values of ``names``."""
    cells = F.array(*[present(df, c).cast(value) for c in names])
    return (
        df.select(F.posexplode(cells).alias("idx", "v"))
        .where(F.col("v").isNotNull())
        .groupBy("idx", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _number_cells(df: DataFrame, names: list[str]) -> DataFrame:
    """(idx, l, d, s): every non-missing numeric or datetime value in a lossless form.

    Integers and instants go to ``l``, floating values to ``d``; decimals keep their digits in
    ``s`` next to their size in ``d``. One frequency table then serves all of them.
    """
    cells = []
    for c in names:
        dtype, col = df.schema[c].dataType, present(df, c)
        l, d, s = F.lit(None).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("string")
        if isinstance(dtype, T.IntegralType):
            l = col.cast("bigint")
        elif is_floating(dtype):
            d = col.cast("double")
        elif isinstance(dtype, T.DecimalType):
            d, s = col.cast("double"), col.cast("string")
        else:
            l = instant(col, dtype)
        cells.append(F.struct(l.alias("l"), d.alias("d"), s.alias("s")))
    return (
        df.select(F.posexplode(F.array(*cells)).alias("idx", "c")).select("idx", "c.l", "c.d", "c.s")
        .where("l is not null or d is not null")
    )


def instant(col, dtype: T.DataType):
    """Microseconds (days for dates); for zone-less timestamps taken from the fields, so that no
    two of them meet in a clock change."""
    if isinstance(dtype, T.DateType):
        return F.unix_date(col).cast("bigint")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col)
    seconds = (F.hour(col) * 3600 + F.minute(col) * 60).cast("bigint")
    micros = (F.extract(F.lit("SECOND"), col) * 1_000_000).cast("bigint")
    return F.unix_date(col.cast("date")).cast("bigint") * 86_400_000_000 + seconds * 1_000_000 + micros


def _number_stats(df: DataFrame, numeric: list[str], dates: list[str], rows: int, approx: bool) -> DataFrame:
    """Statistics of numeric columns, and counts of datetime columns."""
    names = [*numeric, *dates]
    x = F.col("x")
    column = F.get(_names(names), F.col("idx")).alias("column")
    probs = [0.25, 0.5, 0.75]
    stats = [
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.avg(x).alias("mean"),
        sample_std(x).alias("std"),
        adjusted_skew(x).alias("skew"),
        F.count_if(x == 0).alias("zeros"),
        F.count_if(x == 1).alias("ones"),
    ]
    cells = _number_cells(df, names)
    if approx:
        key = F.xxhash64("l", "d", "s")
        counts = cells.groupBy("idx").agg(
            F.count(F.lit(1)).alias("n_non_null"),
            F.approx_count_distinct(key, 0.01).alias("n_distinct"),
            F.percentile_approx(F.coalesce(F.col("d"), F.col("l").cast("double")), probs, 10_000).alias("q"),
        )
    else:
        # the frequency table gives the counts and, while it is small enough for one task per
        # column, the quartiles too; larger inputs bracket the quartiles instead
        freq = cells.groupBy("idx", "l", "d", "s").agg(F.count(F.lit(1)).alias("n"))
        if rows <= LIMITS.task_rows:
            v = F.coalesce(F.col("d"), F.col("l").cast("double")).alias("v")
            counts = ranked_quantiles(freq.select("idx", v, "n"), "idx", "v", {"q": F.col("n")}, probs).select(
                "idx", F.col("total").alias("n_non_null"), "n_distinct", "q")
        else:
            cells_of = df.select(F.array(*[as_double(df, c) for c in numeric]).alias("a"), F.lit(0).alias("part")) if numeric else None
            exact = part_quantiles(cells_of, len(numeric), 1, False, probs) if numeric else {}
            quartiles = df.sparkSession.createDataFrame([(i, q) for (i, _), q in exact.items()], "idx int, q array<double>")
            counts = freq.groupBy("idx").agg(
                F.sum("n").alias("n_non_null"), F.count(F.lit(1)).alias("n_distinct")
            ).join(F.broadcast(quartiles), "idx", "left")  # a row per column
    if not numeric:
        return _shaped(counts.select("*", column).withColumn("text_bytes", F.lit(None).cast("long")))
    moments = numeric_cells(df, numeric).groupBy("idx").agg(*stats)
    out = counts.join(F.broadcast(moments), "idx", "left").select("*", column)  # one row per column
    # exactly {0, 1}: every value is a zero or a one and both occur
    two_valued = F.coalesce(
        (F.col("zeros") > 0) & (F.col("ones") > 0) & (F.col("zeros") + F.col("ones") == F.col("n_non_null")), F.lit(False))
    top_is_zero = F.col("zeros") >= F.col("ones")
    # a floating 0/1 column prints its values as 0.0 and 1.0
    suffix = _names([".0" if is_floating(df.schema[c].dataType) else "" for c in numeric])
    number = F.col("min").isNotNull()
    return out.select(
        "column", "n_non_null", "n_distinct", "min", "max", "mean", "std", "skew",
        F.when(number, F.col("q")[0]).alias("q25"), F.when(number, F.col("q")[1]).alias("median"),
        F.when(number, F.col("q")[2]).alias("q75"),
        two_valued.alias("zero_one"),
        F.when(two_valued, F.concat(F.when(top_is_zero, "0").otherwise("1"), F.get(suffix, F.col("idx"))))
        .alias("top_value"),
        F.when(two_valued, F.greatest("zeros", "ones")).alias("top_count"),
        F.lit(None).cast("long").alias("text_bytes"),
    )


def _text_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """Counts, most frequent value and bytes of text and boolean columns."""
    out = text_frequencies(df, names)
    flags = F.array(*[F.lit(kind_of(df.schema[c].dataType) == BOOLEAN) for c in names])
    return _shaped(
        out.select("*", F.get(_names(names), F.col("idx")).alias("column"))
        .withColumn("text_bytes", F.when(~F.get(flags, F.col("idx")), F.col("text_bytes"))),
        F.col("top.v"), -F.col("top.neg"))


def _shaped(df: DataFrame, top=None, top_n=None) -> DataFrame:
    empty = {c: F.lit(None).cast("double").alias(c)
             for c in ("min", "max", "mean", "std", "skew", "q25", "median", "q75")}
    return df.select(
        "column",
        F.col("n_non_null"),
        F.col("n_distinct"),
        *empty.values(),
        F.lit(False).alias("zero_one"),
        (F.lit(None) if top is None else top).cast("string").alias("top_value"),
        (F.lit(None) if top_n is None else top_n).cast("long").alias("top_count"),
        "text_bytes",
    )


def _opaque_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """Nested columns: only the number of values is known."""
    one = df.agg(*[F.count(quoted(c)).alias(f"c{i}") for i, c in enumerate(names)])
    cells = one.select(F.posexplode(F.array(*[F.col(f"c{i}") for i in range(len(names))])).alias("idx", "n_non_null"))
    return _shaped(
        cells.select(
            F.get(_names(names), F.col("idx")).alias("column"), "n_non_null",
            F.lit(None).cast("long").alias("n_distinct"), F.lit(None).cast("long").alias("text_bytes")))


def _names(names: list[str]):
    return F.array(*[F.lit(c) for c in names])


def column_profile(df: DataFrame, approx: bool = False, rows: int | None = None) -> DataFrame:
    """Profile table: one row per column, see ``PROFILE_COLUMNS``.

    ``approx=True`` swaps exact distinct counts and quantiles of numeric and datetime columns for
    sketches; ``is_exact`` says per column which was used.
    """
    rows = df.count() if rows is None else rows
    spark = df.sparkSession
    fields = df.schema.fields
    layout = local_table(
            spark,
        [
            (i, f.name, f.dataType.simpleString(), kind_of(f.dataType), _fixed_width(f.dataType))
            for i, f in enumerate(fields)
        ],
        "position int, column string, dtype string, kind string, width int",
    )
    parts = []
    numeric, dates = columns_of_kind(df, NUMERIC), columns_of_kind(df, DATETIME)
    if numeric or dates:
        parts.append(_number_stats(df, numeric, dates, rows, approx))
    if text := [c for c in df.columns if kind_of(df.schema[c].dataType) in (TEXT, BOOLEAN)]:
        parts.append(_text_stats(df, text))
    if opaque := columns_of_kind(df, UNSUPPORTED):
        parts.append(_opaque_stats(df, opaque))
    stats = parts[0]
    for part in parts[1:]:
        stats = stats.unionByName(part)
    joined = layout.join(pinned(stats), "column", "left")  # one row per column on both sides
    return _describe(joined, rows, approx)


def _describe(joined: DataFrame, rows: int, approx: bool) -> DataFrame:
    """Semantic types, flags and shares of the finished per-column statistics."""
    n = f"{float(max(rows, 1))}D"
    typed = joined.selectExpr(
        "*",
        f"{rows}L AS n_rows",
        "CAST(coalesce(n_non_null, 0) AS BIGINT) AS nn",
        "CASE WHEN kind <> 'unsupported' THEN CAST(coalesce(n_distinct, 0) AS BIGINT) END AS nd",
        f"CASE WHEN kind <> 'unsupported' THEN coalesce(n_distinct, 0) / {n} END AS share",
        "lower(column) = 'id' OR lower(column) LIKE '%\\_id' OR lower(column) LIKE 'id\\_%' "
        "OR lower(column) LIKE '%identifier%' AS id_name",
    ).selectExpr(
        "*",
        f"""CASE WHEN kind IN ('unsupported', 'boolean', 'datetime') THEN kind
                 WHEN kind = 'numeric' AND coalesce(zero_one, false) THEN 'boolean'
                 WHEN kind = 'numeric' THEN 'numerical'
                 WHEN share >= {ID_RATIO}D AND id_name OR share > {ID_RATIO}D AND {rows} > {ID_MIN_ROWS} THEN 'id'
                 ELSE 'categorical' END AS semantic_type""",
    )
    numbers = [f"CASE WHEN semantic_type = 'numerical' THEN {c} END AS {c}"
               for c in ("min", "max", "mean", "std", "median", "q25", "q75", "skew")]
    tops = {"top_value": "top_value", "top_count": "top_count", "top_pct": "try_divide(top_count * 100D, CAST(nn AS DOUBLE))"}
    return typed.selectExpr(
        "position", "column", "dtype", "semantic_type", "n_rows",
        "nn AS n_non_null",
        "n_rows - nn AS null_count",
        f"round((n_rows - nn) / {n} * 10000D) / 100D AS null_pct",
        "nd AS n_distinct",
        "round(share * 10000D) / 10000D AS distinct_ratio",
        "coalesce(nd <= 1, false) AS is_constant",
        f"coalesce(semantic_type IN ('categorical', 'id') AND nd > {HIGH_CARDINALITY}, false) AS is_high_cardinality",
        *numbers,
        *[f"CASE WHEN semantic_type IN ('categorical', 'boolean', 'id') THEN {e} END AS {c}" for c, e in tops.items()],
        "CAST(coalesce(text_bytes, width * nn, 0) AS BIGINT) AS data_bytes",
        f"{'kind NOT IN (%s, %s)' % (repr(NUMERIC), repr(DATETIME)) if approx else 'true'} AS is_exact",
    )


def _fixed_width(data_type: T.DataType) -> int:
    if isinstance(data_type, (T.BooleanType, T.ByteType)):
        return 1
    if isinstance(data_type, T.ShortType):
        return 2
    if isinstance(data_type, (T.IntegerType, T.FloatType, T.DateType)):
        return 4
    return 8


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: n_rows, duplicate_rows = rows equal to an earlier row (nulls equal).

    Narrow rows are grouped by their columns. Wide or text rows are grouped by a 256-bit
    digest of an unambiguous encoding, so the shuffle moves 64 bytes per distinct row
    instead of the row; copies are folded before the shuffle either way.
    """
    keys = _row_keys(df)
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
    )


def _row_keys(df: DataFrame) -> list:
    width = sum(8 if kind_of(f.dataType) in (NUMERIC, BOOLEAN, DATETIME) else 64 for f in df.schema.fields)
    if width <= 64:
        return [present(df, c).alias(f"k{i}") for i, c in enumerate(df.columns)]
    return [row_digest(df).alias("k")]


def row_digest(df: DataFrame):
    """SHA-256 of all columns, length-prefixed so that no two rows share an encoding."""
    parts = []
    for f in df.schema.fields:
        col = present(df, f.name)
        if kind_of(f.dataType) == UNSUPPORTED:
            text = F.to_json(F.struct(col.alias("v")))
        elif is_floating(f.dataType):
            text = F.when(col == 0, F.lit("0.0")).otherwise(col.cast("string"))  # -0.0 equals 0.0
        else:
            text = col.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def dataset_profile(df: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """One row with the table-level figures."""
    columns = pinned(column_profile(df)) if columns is None else columns
    n_cols = len(df.columns)
    per_type = [
        F.count_if(F.col("semantic_type") == t).alias(name)
        for t, name in (("numerical", "numerical_columns"), ("boolean", "boolean_columns"),
                        ("datetime", "datetime_columns"))
    ]
    sums = columns.agg(
        F.sum("null_count").alias("missing_cells"),
        F.sum("data_bytes").alias("data_bytes"),
        *per_type,
        # an id column is a categorical column as well
        F.count_if(F.col("semantic_type").isin("categorical", "id")).alias("categorical_columns"),
        F.count_if(F.col("is_constant")).alias("constant_columns"),
        F.count_if(F.col("is_high_cardinality")).alias("high_cardinality_columns"),
    )
    return duplicate_count(df).withColumn("s", one_row(sums)).select("n_rows", "duplicate_rows", "s.*").select(
        "n_rows",
        F.lit(n_cols).cast("long").alias("n_columns"),
        "missing_cells",
        F.coalesce(ratio(F.col("missing_cells") * 100.0, F.col("n_rows") * n_cols), F.lit(0.0)).alias("missing_pct"),
        "duplicate_rows",
        F.coalesce(ratio(F.col("duplicate_rows") * 100.0, F.col("n_rows")), F.lit(0.0)).alias("duplicate_pct"),
        "data_bytes",
        (F.col("data_bytes") / (1024.0 * 1024.0)).alias("data_mb"),
        "numerical_columns", "categorical_columns", "boolean_columns", "datetime_columns",
        "constant_columns", "high_cardinality_columns",
    )


def columns_by_type(columns: DataFrame) -> DataFrame:
    """(semantic_type, columns): the column lists of the profile."""
    typed = columns.select(
        F.explode(
            F.when(F.col("semantic_type") == "id", F.array(F.lit("id"), F.lit("categorical")))
            .otherwise(F.array("semantic_type"))
        ).alias("semantic_type"),
        F.struct("position", "column").alias("c"),
    )
    return typed.groupBy("semantic_type").agg(
        F.transform(F.sort_array(F.collect_list("c")), lambda c: c["column"]).alias("columns")
    )


def summary_view(dataset: DataFrame) -> DataFrame:
    """Key/value view of the dataset profile with formatted percentages."""
    pct = lambda n, p: F.concat(F.col(n).cast("string"), F.lit(" ("), F.format_string("%.2f", F.col(p)), F.lit("%)"))
    items = [
        ("Rows", F.col("n_rows").cast("string")),
        ("Columns", F.col("n_columns").cast("string")),
        ("Missing Cells", pct("missing_cells", "missing_pct")),
        ("Duplicate Rows", pct("duplicate_rows", "duplicate_pct")),
        ("Numerical", F.col("numerical_columns").cast("string")),
        ("Categorical", F.col("categorical_columns").cast("string")),
        ("Boolean", F.col("boolean_columns").cast("string")),
        ("Datetime", F.col("datetime_columns").cast("string")),
        ("Data Size", F.format_string("%.2f MB", F.col("data_mb"))),
    ]
    return dataset.select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("item"), v.alias("value")) for k, v in items])).alias("e")
    ).select("e.*")


def column_preview(df: DataFrame, key_cols: list[str], n: int = 5) -> DataFrame:
    """(column, values): the first ``n`` values in key order as text, missing as NaN."""
    top = df.orderBy(*[quoted(k) for k in key_cols]).limit(n)
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                F.coalesce(
                    F.to_json(quoted(f.name)) if kind_of(f.dataType) == UNSUPPORTED
                    else present(df, f.name).cast("string"),
                    F.lit("NaN"),
                ).alias("value"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    ranked = top.select(F.struct(*[quoted(k) for k in key_cols]).alias("k"), F.explode(cells).alias("e"))
    return (
        ranked.groupBy("e.position", "e.column")
        .agg(F.sort_array(F.collect_list(F.struct("k", "e.value"))).alias("s"))
        .select("column", F.transform("s", lambda s: s["value"]).alias("values"))
    )


def quick_stats(df: DataFrame) -> DataFrame:
    """Row, column, missing, duplicate and numeric-column counts of a freshly loaded table."""
    one = df.agg(*[F.count(present(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    filled = sum((F.col(f"c{i}") for i in range(len(df.columns))), F.lit(0))
    numeric = len(columns_of_kind(df, NUMERIC))
    return duplicate_count(df).withColumn("s", one_row(one)).select("n_rows", "duplicate_rows", "s.*").select(
        F.col("n_rows").alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        (F.col("n_rows") * len(df.columns) - filled).cast("long").alias("missing"),
        F.col("duplicate_rows").alias("duplicates"),
        F.lit(numeric).cast("long").alias("numeric_columns"),
    )


class Profile:
    """A finished profile: ``columns`` and ``dataset`` tables plus driver-side rows for planning."""

    def __init__(self, df: DataFrame, approx: bool = False):
        with shared(df) as table:
            self.columns = pinned(column_profile(table, approx=approx))
            self.dataset = pinned(dataset_profile(table, self.columns))
        self.rows = {r["column"]: r for r in self.columns.orderBy("position").collect()}
        self.totals = self.dataset.first()

    def named(self, *semantic_types: str) -> list[str]:
        return [c for c, r in self.rows.items() if r["semantic_type"] in semantic_types]

    @property
    def numerical(self) -> list[str]:
        return self.named("numerical")
