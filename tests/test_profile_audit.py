"""Profile, validation and audit on small frames with hand-derived or pandas results."""

import math
from datetime import date, datetime
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwright.functions import gram, texts
from tabwright.operators import audit as aud
from tabwright.operators import eda
from tabwright.operators.profile import Profile, column_preview, columns_by_type, duplicate_count, summary_view
from tabwright.operators.validate import validate, verdict


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def audit_fixture(spark):
    rows = [(f"ID_{i}", 42, None if i < 15 else float(i), i, i % 2) for i in range(50)]
    return frame(spark, rows, "id_col string, const_col long, missing_col double, num_col long, target long")


def codes(findings):
    return {r["code"]: (r["severity"], r["n"]) for r in findings.collect()}


def test_validation_rules(spark):
    ten = frame(spark, [(i, i % 2) for i in range(10)], "a long, target long")
    assert codes(validate(ten, "target")) == {"TOO_FEW_ROWS": ("error", 10)}
    thirty = frame(spark, [(i, 1) for i in range(30)], "a long, target long")
    assert "TARGET_MISSING" in codes(validate(thirty, "nope"))
    assert "TARGET_SINGLE_VALUED" in codes(validate(thirty, "target"))
    good = frame(spark, [(i, "x", i % 2) for i in range(35)], "a long, b string, target long")
    assert codes(validate(good, "target")) == {}
    row = verdict(good, "target").first()
    assert row["is_valid"] and row["row_count"] == 35 and row["column_count"] == 3


@pytest.mark.parametrize("n, fine", [(24, False), (25, True)])
def test_row_floor_edge(spark, n, fine):
    df = frame(spark, [(i, i) for i in range(n)], "a long, b long")
    assert (codes(validate(df)) == {}) is fine


def test_duplicate_names_and_empty_table(spark):
    df = frame(spark, [(1, 2)] * 30, "a long, b long").toDF("a", "a")
    assert "DUPLICATE_COLUMNS" in codes(validate(df))
    empty = frame(spark, [], "a long, b string")
    assert "EMPTY_TABLE" in codes(validate(empty))
    p = Profile(empty)
    assert p.totals["n_rows"] == 0 and p.rows["a"]["is_constant"]


def test_audit_fixture_score(spark):
    df = audit_fixture(spark)
    p = Profile(df)
    issues = aud.audit(df, p, "target")
    found = {(r["rule_id"], r["feature"]) for r in issues.collect()}
    assert found == {("MODERATE_MISSINGNESS", "missing_col"), ("ZERO_VARIANCE", "const_col")}
    score = aud.audit_score(issues, 5).first()
    assert (score["overall_score"], score["healthy_checks"]) == (75, 7)
    assert p.rows["id_col"]["semantic_type"] == "id"


def test_profile_matches_pandas(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({
        "x": rng.exponential(3.0, 200), "y": rng.normal(size=200), "z": rng.integers(0, 9, 200),
        "s": rng.choice(["a", "b", "c"], 200),
    })
    pdf.loc[::9, "x"] = np.nan
    p = Profile(spark.createDataFrame(pdf))
    for c in ("x", "y", "z"):
        r, s = p.rows[c], pdf[c].dropna()
        want = {"min": s.min(), "max": s.max(), "mean": s.mean(), "std": s.std(), "median": s.median(),
                "q25": s.quantile(0.25), "q75": s.quantile(0.75), "skew": s.skew()}
        for k, v in want.items():
            assert r[k] == pytest.approx(v, rel=1e-9, abs=1e-12), (c, k)
        assert r["n_distinct"] == s.nunique() and r["null_count"] == pdf[c].isna().sum()
    counts = pdf["s"].value_counts()
    top = sorted(counts[counts == counts.max()].index)[0]
    assert p.rows["s"]["top_value"] == top and p.rows["s"]["top_count"] == counts.max()


def test_semantic_edges(spark):
    rows = [(i % 2, None if i % 3 == 0 else i % 2, float(i % 2), i % 2 + 1, bool(i % 2), datetime(2024, 1, 1 + i % 20),
             date(2024, 1, 1), Decimal("1.50"), [1.0], float("nan"), None) for i in range(40)]
    df = frame(spark, rows,
               "zo long, zo_null long, zo_float double, one_two long, flag boolean, ts timestamp, day date, "
               "money decimal(10,2), nested array<double>, nan_col double, none_col string")
    p = Profile(df)
    kinds = {c: r["semantic_type"] for c, r in p.rows.items()}
    assert kinds == {
        "zo": "boolean", "zo_null": "boolean", "zo_float": "boolean", "one_two": "numerical", "flag": "boolean",
        "ts": "datetime", "day": "datetime", "money": "numerical", "nested": "unsupported", "nan_col": "numerical",
        "none_col": "categorical"}
    assert p.rows["nan_col"]["null_count"] == 40 and p.rows["nan_col"]["is_constant"]
    assert p.rows["zo_float"]["top_value"] == "0.0" and p.rows["flag"]["top_value"] == "false"
    assert p.rows["money"]["is_constant"] and p.rows["day"]["n_distinct"] == 1 and p.rows["ts"]["n_distinct"] == 20
    assert p.rows["nested"]["null_count"] == 0
    lists = {r["semantic_type"]: r["columns"] for r in columns_by_type(p.columns).collect()}
    assert lists["datetime"] == ["ts", "day"]
    assert summary_view(p.dataset).count() > 5


@pytest.mark.parametrize("n_null, rule", [(500, None), (501, "MODERATE_MISSINGNESS"), (4000, "MODERATE_MISSINGNESS"), (4001, "HIGH_MISSINGNESS")])
def test_missingness_edges(spark, n_null, rule):
    df = spark.range(10_000).select(F.when(F.col("id") >= n_null, F.col("id")).alias("x"), F.col("id").alias("y"))
    found = {r["rule_id"] for r in aud.audit(df, Profile(df)).collect() if r["feature"] == "x"}
    assert found == ({rule} if rule else set())


@pytest.mark.parametrize("levels, flagged", [(50, False), (51, True)])
def test_cardinality_edge(spark, levels, flagged):
    df = spark.range(500).select((F.col("id") % levels).cast("string").alias("c"), F.col("id"))
    found = {r["rule_id"] for r in aud.audit(df, Profile(df)).collect()}
    assert ("HIGH_CARDINALITY" in found) is flagged


def test_duplicates_count_nulls_and_signed_zero(spark):
    df = frame(spark, [(None, 0.0), (None, -0.0), (1, float("nan")), (1, None), (2, 5.0)], "a long, b double")
    assert duplicate_count(df).first()["duplicate_rows"] == 2
    wide = df.withColumn("t", F.lit("x" * 100)).withColumn("u", F.lit("y"))
    assert duplicate_count(wide).first()["duplicate_rows"] == 2


def test_duplicate_severity_edge(spark):
    for extra, severity in ((10, "warning"), (11, "critical")):
        base = spark.range(100 - extra).select("id", F.lit("x").alias("v"))
        df = base.union(base.orderBy("id").limit(extra))
        rows = [r for r in aud.audit(df, Profile(df)).collect() if r["rule_id"] == "DUPLICATE_ROWS"]
        assert rows[0]["severity"] == severity


def test_leakage_needs_more_than_twenty_pairs(spark):
    for pairs, hit in ((20, False), (21, True)):
        df = spark.range(40).select(
            F.col("id").alias("y"), F.when(F.col("id") < pairs, F.col("id") * 2 + 1).alias("x"))
        rules = {r["rule_id"] for r in aud.audit(df, Profile(df), "y").collect()}
        assert ("TARGET_LEAKAGE" in rules) is hit


def test_constant_has_no_correlation(spark):
    df = spark.range(1000).repartition(7).select(F.col("id").cast("double").alias("a"), F.lit(0.1).alias("k"))
    m = {(r["c1"], r["c2"]): r["r"] for r in eda.correlation_matrix(df, ["a", "k"]).collect()}
    assert m == {("a", "a"): 1.0, ("a", "k"): None, ("k", "a"): None, ("k", "k"): None}
    assert Profile(df).rows["k"]["skew"] == 0.0
    assert eda.correlation_matrix(df, ["a"]).count() == 0


def test_wide_correlation_matches_numpy(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(60, 12)), columns=[f"c{i}" for i in range(12)])
    pdf.loc[::5, "c3"] = np.nan
    want = pdf.corr().round(3)
    got = eda.correlation_matrix(spark.createDataFrame(pdf), list(pdf.columns)).collect()
    assert len(got) == 144
    assert all(math.isclose(r["r"], want.loc[r["c1"], r["c2"]], abs_tol=1.1e-3) for r in got)


def test_histogram_and_box_edges(spark):
    flat = spark.range(5).select(F.lit(2.0).alias("x"))
    assert [r["n"] for r in eda.histogram(flat, "x").orderBy("bin").collect()] == [5] + [0] * 34
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "x double")
    box = eda.box_stats(df, "x").first()
    assert (box["whisker_lo"], box["whisker_hi"], box["n_outliers"]) == (1.0, 4.0, 1)
    assert [r["x"] for r in eda.outlier_points(df, "x").collect()] == [100.0]


def test_preview_and_insights(spark):
    df = frame(spark, [(i, None if i == 1 else f"v{i}") for i in range(8)], "k long, s string")
    rows = {r["column"]: r["values"] for r in column_preview(df, ["k"], 3).collect()}
    assert rows == {"k": ["0", "1", "2"], "s": ["v0", "NaN", "v2"]}
    t = audit_fixture(spark)
    titles = {r["title"] for r in eda.insights(t, Profile(t), "target").collect()}
    assert {"Binary Target Distribution", "Missing Values Present", "Strong Multicollinearity"} <= titles


def test_approximate_profile_is_labelled(spark):
    df = spark.range(1000).select("id", (F.col("id") % 5).cast("string").alias("s"))
    from tabwright.operators.profile import column_profile

    rows = {r["column"]: r for r in column_profile(df, approx=True).collect()}
    assert not rows["id"]["is_exact"] and abs(rows["id"]["n_distinct"] - 1000) < 50
    assert rows["s"]["n_distinct"] == 5


def test_text_frequencies_by_digest(spark, monkeypatch):
    shared = "the same beginning of many texts, "
    rows = [(shared + str(i % 40), "abc"[i % 3] if i % 7 else None, None, f"u{i}") for i in range(400)] + [(None, "ß", None, "u0")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string").repartition(4)
    want = {}
    for i in range(4):
        n = pd.Series([r[i] for r in rows if r[i] is not None], dtype=object).value_counts()
        if len(n):
            top = min(n.items(), key=lambda kv: (-kv[1], kv[0]))
            want[i] = (int(n.sum()), len(n), sum(int(c) * len(t.encode()) for t, c in n.items()), top[1], top[0])
    for raw in (False, True):
        if raw:  # keys that clash: every text has the same digest
            monkeypatch.setattr(texts, "_digest", lambda t: F.struct(
                F.lit(1).cast("bigint").alias("h"), F.lit(1).cast("bigint").alias("g"), F.octet_length(t).alias("bytes"), F.substring(t, 1, 24).alias("prefix")))
        got = {r["idx"]: (r["n_non_null"], r["n_distinct"], r["text_bytes"], -r["top"]["neg"], r["top"]["v"]) for r in texts.text_frequencies(df, df.columns).collect()}
        assert got == want
        for c, k in (("a", 3), ("b", 2), ("d", 5), *([] if raw else [("c", 1)])):
            values = pd.Series(["nan" if v is None else v for v in (r[df.columns.index(c)] for r in rows)]).value_counts()
            top = sorted(((-n, v) for v, n in values.items()))[:k]
            assert [(r["value"], r["n"]) for r in texts.top_texts(df, c, k, "nan").collect()] == [(v, -n) for n, v in top]
    assert texts.top_texts(df.limit(0), "a", 3, "nan").count() == 0


def test_correlations_of_many_columns(spark, monkeypatch):
    r = np.random.default_rng(1)
    a = r.normal(size=(300, 7))
    a[:, 1] = a[:, 0] * 2 + 1e6
    a[r.random((300, 7)) < 0.3] = np.nan
    a[:, 3] = 7.1  # constant
    a[:, 4] = np.where(np.isnan(a[:, 5]), a[:, 4], 1e9 + 0.5)  # constant where the sixth has a value
    a[:, 6] = np.where(np.arange(300) == 5, 1.0, np.nan)  # one value
    names = list("abcdefg")
    df = spark.createDataFrame(pd.DataFrame(a, columns=names))
    for tile in (gram.TILE, 3):
        monkeypatch.setattr(gram, "TILE", tile)
        got = {(x["i"], x["j"]): (x["n"], x["r"]) for x in gram.pair_moments(df, names).collect()}
        for i in range(7):
            for j in range(i + 1, 7):
                both = ~np.isnan(a[:, i]) & ~np.isnan(a[:, j])
                x, y = a[both, i], a[both, j]
                flat = len(x) < 2 or x.min() == x.max() or y.min() == y.max()
                n, c = got.get((i, j), (0, None))
                assert n == len(x) and (c is None if flat else c == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9))
    wide = spark.range(200).select(*[F.rand(i).alias(f"c{i}") for i in range(120)])
    plan = str(gram._tile(wide.select(F.array(*wide.columns).alias("a")), 0, 120, 120, [0.0] * 120)._jdf.queryExecution().optimizedPlan())
    assert "Generate" not in plan and gram.pair_moments(wide, wide.columns).count() == 120 * 119 // 2
    assert gram.pair_moments(df.limit(0), names).count() == 0
