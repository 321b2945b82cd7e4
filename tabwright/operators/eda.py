"""Correlations, distribution views and factual insights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import (
    as_double,
    kind_of,
    numeric_cells,
    NUMERIC,
    adjusted_skew,
    one_row,
    present,
    sample_std,
)
from tabwright.functions.distinct import few_values
from tabwright.functions.gram import pair_moments
from tabwright.functions.quantiles import quantile_columns
from tabwright.functions.texts import top_texts
from tabwright.operators.profile import Profile
from tabwright.session import local_table, spread

# Thresholds and sizes of the insight rules and views.
TOP_PAIRS = 5
STRONG_R = 0.70
SKEW_LIMIT = 2.0
TARGET_SKEW = 1.0
MANY_VALUES = 10
IMBALANCE = 2.0
HISTOGRAM_BINS = 35
TOP_CATEGORIES = 10
FENCE = 1.5


def correlation_pairs(df: DataFrame, names: list[str]) -> DataFrame:
    """(c1, c2, r, n) for every column pair c1 before c2, pairwise-complete, r rounded to 3.

    Masked matrix products per partition, see ``pair_moments``: no row per pair is made."""
    labels = F.array(*[F.lit(c) for c in names])
    return pair_moments(df, names).select(
        F.get(labels, F.col("i")).alias("c1"), F.get(labels, F.col("j")).alias("c2"), F.round("r", 3).alias("r"), "n", "i", "j")


def correlation_matrix(df: DataFrame, names: list[str]) -> DataFrame:
    """Long symmetric matrix (c1, c2, r) with its diagonal; empty below two columns.

    A constant or empty column has no correlation: r is NULL, also on the diagonal.
    """
    if len(names) < 2:
        return local_table(df.sparkSession, [], "c1 string, c2 string, r double")
    pairs = correlation_pairs(df, names)
    upper = pairs.select(
        F.explode(F.array(F.struct("c1", "c2", "r"), F.struct(F.col("c2").alias("c1"), F.col("c1").alias("c2"), "r"))).alias("e")
    ).select("e.*")
    labels = F.array(*[F.lit(c) for c in names])
    diagonal = numeric_cells(df, names).groupBy("idx").agg(
        F.when(F.min("x") < F.max("x"), F.lit(1.0)).alias("r")
    ).select(F.get(labels, F.col("idx")).alias("c1"), F.get(labels, F.col("idx")).alias("c2"), "r")
    known = upper.unionByName(diagonal)
    grid = local_table(df.sparkSession, [(a, b) for a in names for b in names], "c1 string, c2 string")
    return grid.join(F.broadcast(known), ["c1", "c2"], "left")  # k*k rows: bounded by the schema


def top_correlations(df: DataFrame, names: list[str], top_k: int = TOP_PAIRS) -> DataFrame:
    """Strongest pairs by the rounded |r|; ties in column order."""
    return (
        correlation_pairs(df, names).where(F.col("r").isNotNull())
        .orderBy(F.abs("r").desc(), "i", "j").limit(top_k).select("c1", "c2", "r", "n")
    )


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """One row for a two-valued target: shares in percent, ratio, imbalance flag; else no row."""
    shares = class_counts(df, target).agg(
        F.count(F.lit(1)).alias("classes"),
        F.min(F.struct((-F.col("n")).alias("neg"), "value")).alias("major"),
        F.max(F.struct((-F.col("n")).alias("neg"), "value")).alias("minor"),
        F.sum("n").alias("total"),
    ).where("classes = 2")
    pct = lambda side: F.col(f"{side}.neg") * -100.0 / F.col("total")
    out = shares.select(
        F.col("major.value").alias("majority_class"), pct("major").alias("majority_pct"),
        F.col("minor.value").alias("minority_class"), pct("minor").alias("minority_pct"),
    )
    return out.withColumn(
        "ratio", F.col("majority_pct") / F.greatest(F.lit(0.1), F.col("minority_pct"))
    ).withColumn("imbalanced", F.col("ratio") >= IMBALANCE)


def target_numeric(df: DataFrame, target: str, rows: int | None = None) -> DataFrame:
    """One row for a numeric target with more than ten distinct values; else no row."""
    df = spread(df.select(as_double(df, target).alias("t")))
    t = F.col("t")
    q = quantile_columns(df, {"t": t}, [0.5], rows=rows)["t"]
    stats = df.agg(
        F.avg(t).alias("mean"), F.element_at(q, 1).alias("median"), sample_std(t).alias("std"),
        adjusted_skew(t).alias("skew"),
    )
    many = few_values(df, t, MANY_VALUES).values is None
    shape = F.when(F.col("skew") > TARGET_SKEW, "right-skewed").when(
        F.col("skew") < -TARGET_SKEW, "left-skewed").otherwise("symmetric")
    return stats.where(F.lit(many)).select("mean", "median", "std", "skew", shape.alias("shape"))


def class_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n): class frequency of the non-missing values as text."""
    v = present(df, column).cast("string").alias("value")
    return df.select(v).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def top_categories(df: DataFrame, column: str, k: int = TOP_CATEGORIES) -> DataFrame:
    """(value, n): most frequent values; missing counts as the text ``nan``."""
    return top_texts(df, column, k, "nan")


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(bin, lo, hi, n): equal-width bins over [min, max]; empty bins are kept with n = 0."""
    x = as_double(df, column)
    cells = df.select(x.alias("x")).where("x is not null")
    span = cells.agg(F.min("x").alias("lo0"), F.max("x").alias("hi0"))
    width = (F.col("hi0") - F.col("lo0")) / float(bins)
    tagged = cells.withColumn("s", one_row(span)).select("x", "s.*").select(
        F.when(F.col("hi0") > F.col("lo0"),
               F.least(F.floor((F.col("x") - F.col("lo0")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
        .otherwise(F.lit(0)).cast("int").alias("bin")
    )
    counted = tagged.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    frame = span.where("lo0 is not null").select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(F.broadcast(counted), "bin", "left").select(  # at most `bins` rows
        "bin", (F.col("lo0") + F.col("bin") * width).alias("lo"),
        (F.col("lo0") + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def box_stats(df: DataFrame, column: str, rows: int | None = None) -> DataFrame:
    """One row: quartiles, whiskers (extreme values inside the fences) and the outlier count."""
    df = spread(df.select(as_double(df, column).alias("x")))
    q = quantile_columns(df, {"x": F.col("x")}, [0.25, 0.5, 0.75], rows=rows)["x"]
    fenced = df.agg(q.alias("q")).select(
        F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"),
    )
    iqr = F.col("q75") - F.col("q25")
    fenced = fenced.select("*", (F.col("q25") - FENCE * iqr).alias("fence_lo"), (F.col("q75") + FENCE * iqr).alias("fence_hi"))
    inside = F.col("x").between(F.col("fence_lo"), F.col("fence_hi"))
    return (
        df.where("x is not null").withColumn("f", one_row(fenced)).select("x", "f.*")
        .groupBy("q25", "median", "q75")
        .agg(
            F.min(F.when(inside, F.col("x"))).alias("whisker_lo"),
            F.max(F.when(inside, F.col("x"))).alias("whisker_hi"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def outlier_points(df: DataFrame, column: str, rows: int | None = None) -> DataFrame:
    """Rows whose value lies outside the 1.5 IQR fences."""
    x = as_double(df, column)
    q = quantile_columns(df, {"x": x}, [0.25, 0.75], rows=rows)["x"]
    fence = df.agg(q.alias("_q")).select(
        (F.col("_q")[0] - FENCE * (F.col("_q")[1] - F.col("_q")[0])).alias("_lo"),
        (F.col("_q")[1] + FENCE * (F.col("_q")[1] - F.col("_q")[0])).alias("_hi"),
    )
    return df.withColumn("_f", one_row(fence)).where((x < F.col("_f._lo")) | (x > F.col("_f._hi"))).drop("_f")


def inspect_column(profile: Profile, column: str) -> DataFrame:
    return profile.columns.where(F.col("column") == column)


def skewed_features(profile: Profile, target: str | None = None) -> DataFrame:
    """Two most skewed numeric features beyond the limit, target left out."""
    c = profile.columns
    keep = (F.col("semantic_type") == "numerical") & (F.col("n_non_null") > 10) & (F.abs("skew") > SKEW_LIMIT)
    if target:
        keep &= F.col("column") != target
    return c.where(keep).orderBy(F.abs("skew").desc(), "position").limit(2).select("column", "skew")


def missing_leaders(profile: Profile) -> DataFrame:
    """Three columns with the highest missing share."""
    return (
        profile.columns.where("null_pct > 0").orderBy(F.col("null_pct").desc(), "position").limit(3)
        .select("column", "null_pct")
    )


INSIGHT_SCHEMA = "category string, title string, description string, importance string, feature string, value double"


def insights(df: DataFrame, profile: Profile, target: str | None = None) -> DataFrame:
    """Insight table: text plus the number behind it. Every part is already a few rows."""
    rows: list[tuple] = []
    n = profile.totals["n_rows"]
    if target and target in df.columns:
        about = profile.rows[target]
        if about["n_distinct"] == 2:
            t = target_distribution(df, target).first()
            word = "imbalanced" if t["imbalanced"] else "well-balanced"
            rows.append((
                "Target", "Binary Target Distribution",
                f"'{target}' is {word}: {t['majority_pct']:.1f}% '{t['majority_class']}' against "
                f"{t['minority_pct']:.1f}% '{t['minority_class']}', ratio {t['ratio']:.1f}:1.",
                "high" if t["imbalanced"] else "info", target, float(t["ratio"])))
        elif kind_of(df.schema[target].dataType) == NUMERIC and about["n_distinct"] and about["n_distinct"] > MANY_VALUES:
            s = about["skew"]
            shape = "right-skewed" if s > TARGET_SKEW else "left-skewed" if s < -TARGET_SKEW else "symmetric"
            rows.append((
                "Target", "Continuous Target Profile",
                f"'{target}' averages {about['mean']:,.2f} (median {about['median']:,.2f}, standard deviation "
                f"{about['std']:,.2f}); its distribution is {shape} (skew {s:.2f}).",
                "high", target, float(s)))
    if len(profile.numerical) >= 2:
        for p in top_correlations(df, profile.numerical, 3).collect():
            if abs(p["r"]) >= STRONG_R:
                rows.append((
                    "Correlation", "Strong Multicollinearity",
                    f"'{p['c1']}' and '{p['c2']}' move together (Pearson r {p['r']:+.2f}).",
                    "medium", f"{p['c1']},{p['c2']}", float(p["r"])))
    skewed = skewed_features(profile, target).collect()
    if skewed:
        listed = ", ".join(f"'{r['column']}' ({r['skew']:.2f})" for r in skewed)
        rows.append(("Distribution", "Substantial Feature Skewness", f"Strong skew in {listed}.", "medium",
                     skewed[0]["column"], float(skewed[0]["skew"])))
    gaps = missing_leaders(profile).collect() if n else []
    if gaps:
        listed = ", ".join(f"'{r['column']}' ({r['null_pct']:.1f}%)" for r in gaps)
        rows.append(("Missingness", "Missing Values Present", f"Values are missing mainly in {listed}.", "info",
                     gaps[0]["column"], float(gaps[0]["null_pct"])))
    return local_table(df.sparkSession, rows, INSIGHT_SCHEMA)


