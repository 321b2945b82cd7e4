"""Type rules and column expressions used by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC, TEXT, BOOLEAN, DATETIME, UNSUPPORTED = "numeric", "text", "boolean", "datetime", "unsupported"


def kind_of(data_type: T.DataType) -> str:
    """Physical family of a Spark type."""
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    return UNSUPPORTED


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def quoted(name: str) -> Column:
    """Reference a column whose name may contain dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing."""
    col = quoted(name)
    if is_floating(df.schema[name].dataType):
        return F.when(~F.isnan(col), col)
    return col


def nan_to_null(df: DataFrame) -> DataFrame:
    """One missing concept: NaN becomes NULL in every floating column."""
    floating = [f.name for f in df.schema.fields if is_floating(f.dataType)]
    if not floating:
        return df
    return df.withColumns({c: present(df, c) for c in floating})


def as_double(df: DataFrame, name: str) -> Column:
    """Numeric or boolean column as double, NaN as NULL."""
    return present(df, name).cast("double")


def columns_of_kind(df: DataFrame, *kinds: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) in kinds]


def numeric_cells(df: DataFrame, names: list[str], *keep: str) -> DataFrame:
    """Long form (keep..., idx, x) of the non-missing numeric cells.

    One fixed-size plan for any number of columns: a single scan, one generator, and
    aggregates by ``idx`` that combine map-side into at most one row per column.
    """
    cells = F.array(*[as_double(df, c) for c in names])
    return (
        df.select(*[quoted(k) for k in keep], F.posexplode(cells).alias("idx", "x"))
        .where(F.col("x").isNotNull())
    )


def is_flat(x: Column) -> Column:
    """All values equal. Merged moments of a constant carry rounding noise, its extremes do not."""
    return F.min(x) == F.max(x)


def adjusted_skew(x: Column) -> Column:
    """Bias-adjusted sample skewness (G1); 0 for constants and for n <= 2."""
    n = F.count(x).cast("double")
    g1 = F.skewness(x)
    scaled = g1 * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2.0, F.lit(0.0))
    flat = (F.count(x) <= 2) | is_flat(x)
    return F.when(flat, F.lit(0.0)).otherwise(F.coalesce(scaled, F.lit(0.0)))


def sample_std(x: Column) -> Column:
    """Sample standard deviation, 0 when fewer than two values or all equal."""
    return F.when((F.count(x) <= 1) | is_flat(x), F.lit(0.0)).otherwise(F.stddev_samp(x))


def one_row(df: DataFrame) -> Column:
    """A one-row table as a scalar subquery (struct of its columns)."""
    return df.select(F.struct("*").alias("r")).scalar()


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, NULL when b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pearson(x: Column, y: Column) -> Column:
    """Correlation that yields NULL instead of an ANSI error when one side is constant."""
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(~is_flat(x) & ~is_flat(y), r)
