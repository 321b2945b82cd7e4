"""The distributed forms must give the results of the simple ones (small limits force them)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.functions.ordered import dense_codes, running_totals
from tabwright.functions.quantiles import exact_quantiles, part_quantiles, ranked_quantiles
from tabwright.operators import cv, problem
from tabwright.operators import features as feat
from tabwright.operators import metrics as met
from tabwright.operators.folds import assign_folds, fold_sizes


def values(kind):
    rng = np.random.default_rng(11)
    if kind == "normal":
        return rng.normal(size=4001)
    if kind == "wild":  # spread over hundreds of orders of magnitude, both signs
        return np.sign(rng.normal(size=3000)) * 10.0 ** rng.uniform(-200, 200, 3000)
    if kind == "hot":  # one value in a third of all rows
        return np.concatenate([np.full(1000, 7.0), rng.uniform(0, 20, 2000)])
    return rng.integers(0, 5000, 3001).astype(float)


@pytest.mark.parametrize("kind", ["normal", "wild", "hot", "integers"])
def test_bracketed_quantiles_are_exact(spark, kind):
    x = values(kind)
    df = spark.createDataFrame([(float(v), float(v) if i % 2 else None) for i, v in enumerate(x)], "x double, h double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df, {"x": F.col("x"), "h": F.col("h")}, probs, limit=64)
    assert got["x"] == pytest.approx(list(np.quantile(x, probs)), rel=1e-12)
    assert got["h"] == pytest.approx(list(np.quantile(x[1::2], probs)), rel=1e-12)


def test_quantiles_of_an_empty_column(spark):
    df = spark.range(10).select(F.lit(None).cast("double").alias("x"))
    assert exact_quantiles(df, {"x": F.col("x")}, [0.5], 4) == {"x": [None]}


def test_ranked_quantiles(spark):
    x = np.round(values("hot"), 1)
    freq = spark.createDataFrame([(float(v),) for v in x], "v double").groupBy(F.lit(0).alias("g"), "v").agg(F.count("*").alias("n"))
    row = ranked_quantiles(freq, "g", "v", {"q": F.col("n")}, [0.25, 0.5, 0.9]).first()
    assert row["q"] == pytest.approx(list(np.quantile(x, [0.25, 0.5, 0.9])), rel=1e-12)
    assert row["n_distinct"] == len(set(x))


def test_running_totals_range_partitioned(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("v"), F.lit(1).alias("n"))
    a = {tuple(r) for r in running_totals(df, ["g"], ["v"], {"t": F.col("n")}).collect()}
    b = {tuple(r) for r in running_totals(df, ["g"], ["v"], {"t": F.col("n")}, limit=200).select("g", "v", "n", "t").collect()}
    assert a == b


def test_dense_codes_of_text(spark):
    df = spark.range(700).select(F.md5(F.col("id").cast("string")).alias("v"))
    got = [r["v"] for r in dense_codes(df, [], "v", "c", limit=50).orderBy("c").collect()]
    assert got == sorted(got) and len(got) == 700


def test_auc_many_scores_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    score, y = np.round(rng.uniform(size=900), 2), rng.integers(0, 2, 900)
    df = spark.createDataFrame([(float(s), bool(t)) for s, t in zip(score, y)], "score double, positive boolean")
    pos, neg = score[y == 1], score[y == 0]
    want = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    for limit in (None, 20):
        assert met.auc_table(df, [], limit=limit).first()["auc"] == pytest.approx(want, rel=1e-12)


def test_two_level_folds_equal_global_numbering(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("y"))
    for label in (None, "y"):
        plain = {tuple(r) for r in assign_folds(df, 5, ["id"], label=label).select("id", "fold").collect()}
        split = {tuple(r) for r in assign_folds(df, 5, ["id"], label=label, limit=400).select("id", "fold").collect()}
        assert plain == split


def test_folds_with_a_hot_key_are_the_same_at_any_size(spark):
    # a third of all rows share one key, some rows repeat whole, some labels are null
    df = spark.range(3000).select(
        F.when(F.col("id") < 1000, F.lit(-1)).otherwise(F.col("id")).alias("k"), (F.col("id") % 700).alias("v"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("y"))
    for label in (None, "y"):
        for keys in (["k"], None):
            plain = sorted(map(str, assign_folds(df, 4, keys, label=label).collect()))
            split = assign_folds(df.repartition(5), 4, keys, label=label, limit=200)
            assert plain == sorted(map(str, split.collect()))
            by = [label] if label else []
            for group in fold_sizes(split, *by).groupBy(*by).agg(F.max("n") - F.min("n"), F.sum("n")).collect():
                assert group[-2] <= 1 and group[-1] in (1000, 3000)


def test_passes_over_folds_of_a_large_table_sort_and_shuffle_nothing(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "a").alias("y"))
    for label in (None, "y"):
        plan = assign_folds(df, 5, ["id"], label=label, limit=200)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" in plan and not any(step in plan for step in ("hashpartitioning", "rangepartitioning", "Window", "Sort"))


def test_no_single_task_numbers_a_million_rows(spark):
    folded = assign_folds(spark.range(500).withColumn("v", F.lit("x")), 3, ["id"], rows=1_200_000)
    assert "SinglePartition" not in folded._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["n"] for r in fold_sizes(folded).collect()) == [166, 167, 167]


def test_a_fit_on_all_rows_deals_them_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(cv, "FIT_ROWS", 100)
    df = spark.range(2000).coalesce(1).selectExpr("id * 0.5d as y", "id % 7 as a", "concat('v', id % 50) as c")
    seen = []

    class Any:
        def build(self, params, seed, facts):
            return self

        def fit(self, rows):
            seen.extend(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect())
            return self

    p = problem.detect(df, "y")
    cv.fit_full(df, p, feat.FeaturePlan(numeric=["a"], ordinal=["c"]), Any(), {})
    assert sum(seen) == 2000 and max(seen) <= 150


def test_folds_without_a_key(spark):
    df = spark.range(101).select(F.lit(1).alias("same"))
    sizes = [r["n"] for r in fold_sizes(assign_folds(df, 5)).collect()]
    assert sorted(sizes) == [20, 20, 20, 20, 21]


def test_hot_and_rare_dictionary_lookup(spark):
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") < 1000, "hot").when(F.col("id") < 1100, None).otherwise(F.concat(F.lit("v"), (F.col("id") % 1500).cast("string"))).alias("v"))
    entries = feat.ordinal_dictionary(rows, "v").where("value <> 'v7'")
    small = {tuple(r) for r in feat.lookup(rows, F.col("v"), entries, "code").select("id", "code").collect()}
    large = {tuple(r) for r in feat.lookup(rows, F.col("v"), entries, "code", limit=10).select("id", "code").collect()}
    assert small == large and len(large) == 3000


def test_lookup_reads_the_rows_once_and_takes_long_values(spark):
    rows = spark.range(300).select("id", F.concat(F.repeat(F.lit("x"), (F.col("id") % 40 * 5).cast("int")), F.lit("é")).alias("v"))
    entries = feat.ordinal_dictionary(rows, "v")
    small = {tuple(r) for r in feat.lookup(rows, F.col("v"), entries, "code").select("id", "code").collect()}
    marked = rows.withColumn("mark", F.lit("once"))
    plan = feat.lookup(marked, F.col("v"), entries, "code", limit=10)
    assert {tuple(r) for r in plan.select("id", "code").collect()} == small and len({c for _, c in small}) == 40
    assert str(plan._jdf.queryExecution().analyzed()).count("once AS mark") == 1


@pytest.mark.parametrize("limit", [50, 100_000])
def test_quantiles_of_all_columns_and_folds_at_once(spark, limit):
    rng = np.random.default_rng(3)
    x = np.column_stack([values("normal")[:2000], np.tile([0.0, -0.0, 5.0, -7.5], 500), values("wild")[:2000]])
    x[rng.uniform(size=x.shape) < 0.2] = np.nan
    part = rng.integers(0, 3, 2000)
    df = spark.createDataFrame([(v.tolist(), int(p)) for v, p in zip(x, part)], "a array<double>, part int").repartition(5)
    probs = [0.0, 0.3, 0.5, 1.0]
    got = part_quantiles(df, 3, 3, True, probs, limit)
    for i in range(3):
        for j in range(3):
            own = x[part != j, i]
            assert got[i, j] == pytest.approx(list(np.quantile(own[~np.isnan(own)], probs)), rel=1e-12)
