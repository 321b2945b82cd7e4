import pytest
from pyspark.sql import functions as F

from tabwright.functions.distinct import _bounded, few_values
from tabwright.operators.problem import detect


def test_few_and_many_values(spark):
    df = spark.range(1000).select(
        (F.col("id") % 20).alias("a"), (F.col("id") % 21).alias("b"), F.when(F.col("id") % 2 == 0, 0.0).otherwise(-0.0).alias("z"),
        F.when(F.col("id") % 10 > 0, F.concat(F.lit("v"), (F.col("id") % 3).cast("string"))).alias("t"), F.lit(None).cast("string").alias("none"),
        (F.col("id") % 2 == 0).alias("flag"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 4).cast("int")).alias("day"),
        (F.col("id") % 3).cast("decimal(10,2)").alias("dec"), "id").repartition(7)
    for c in df.columns:
        values = {r[c]: r["n"] for r in df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).collect() if r[c] is not None}
        for limit in (3, 20):
            got = few_values(df, F.col(c), limit)
            if len(values) > limit:
                assert got.values is None
            else:
                assert got.counts == [values[v] for v in sorted(values)] and len(got.values) == len(values)
    assert few_values(df, F.col("z"), 1).values == ["0.0"] and few_values(df, F.col("dec"), 5).values == ["0.00", "1.00", "2.00"]
    assert few_values(df.limit(0), F.col("a"), 3).values == []


def test_no_more_than_the_limit_leaves_a_partition(spark):
    df = spark.range(0, 5000, 1, 4).select(F.col("id").alias("v"))
    assert _bounded(df, 20).count() == 4
    problem = detect(df.withColumn("x", F.lit(1)), "v")
    assert (problem.problem_type, problem.n_distinct, problem.n_values) == ("regression", 5000, 5000)
    with pytest.raises(ValueError, match="5000 distinct"):
        detect(df.select(F.col("v").cast("string").alias("v"), F.lit(1).alias("x")), "v")
