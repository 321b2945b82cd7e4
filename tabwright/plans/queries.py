"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.functions.columns import as_double
from tabwright.operators import audit as aud
from tabwright.operators import cv, eda, explain, folds, models, problem, profile, profile_state, search, validate
from tabwright.operators import features as feat
from tabwright.operators import metrics as met
from tabwright.operators.score import feature_schema, score
from tabwright.plans import views
from tabwright.plans.pipeline import run
from tabwright.session import scratch_path
from tabwright.sources import delimited, reports, runlog
from tabwright.sources.bundle import Bundle, load_bundle, save_bundle
from tabwright.sources.versions import manifest, publish
from tabwright.streaming.scoring import read_records, score_stream, score_stream_latest

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 6


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def derived(spark: SparkSession, sf: str, view: tuple[str, list[str]]) -> DataFrame:
    """A view of ``views``: source table and projection."""
    source, exprs = view
    return table(spark, sf, source).selectExpr(*exprs)


def rounded(*names: str, digits: int = DIGITS) -> list:
    return [F.round(n, digits).alias(n) for n in names]


# --- profile -----------------------------------------------------------------------------

STATS = ("min", "max", "mean", "std", "median", "q25", "q75", "skew")


def profile_rows(p: profile.Profile) -> DataFrame:
    return p.columns.select(
        F.col("column").alias("column_name"), "semantic_type", "null_count", "null_pct", "n_distinct", "distinct_ratio",
        "is_constant", "is_high_cardinality", *rounded(*STATS, digits=4), "top_value", "top_count", *rounded("top_pct"))


def profile_columns(spark, sf):
    return profile_rows(profile.Profile(table(spark, sf, "events")))


def profile_lines(spark, sf):
    return profile_rows(profile.Profile(table(spark, sf, "lineitem")))


def profile_dirty(spark, sf):
    return profile_rows(profile.Profile(derived(spark, sf, views.DIRTY_ORDERS)))


def profile_dataset(spark, sf):
    d = profile.Profile(derived(spark, sf, views.LOOSE_LINES)).dataset
    return d.select("n_rows", "n_columns", "missing_cells", *rounded("missing_pct"), "duplicate_rows",
                    *rounded("duplicate_pct"), "data_bytes", "numerical_columns", "categorical_columns", "boolean_columns")


def profile_merged(spark, sf):
    """The profile from the stored states of three batches, and whether its sketched figures are near the exact ones."""
    d = table(spark, sf, "lineitem")
    path = scratch_path(spark, "profile-states")
    for k in range(3):
        profile_state.save_state(profile_state.profile_state(d.where(F.col("l_orderkey") % 3 == k)), path, f"part-{k}")
    merged = profile_state.state_profile(profile_state.merge_states(profile_state.load_states(spark, path)))
    exact = profile.column_profile(d).select("column", *[F.col(c).alias(f"{c}_") for c in ("n_distinct", "min", "max", "q25", "median", "q75")])
    close = [F.coalesce(F.abs(F.col(c) - F.col(f"{c}_")) <= 0.05 * (F.col("max_") - F.col("min_")), F.col(f"{c}_").isNull()) for c in ("q25", "median", "q75")]
    distinct = F.abs(F.col("n_distinct") - F.col("n_distinct_")) <= 0.05 * F.col("n_distinct_")
    near = merged.join(exact, "column").withColumn("near", distinct & close[0] & close[1] & close[2])
    return near.select(
        F.col("column").alias("column_name"), "semantic_type", "null_count", "null_pct", "is_constant",
        *rounded("min", "max", "mean", "std", "skew", digits=4), "top_value", "top_count", "near")


def semantic_types(spark, sf):
    p = profile.Profile(table(spark, sf, "customer"))
    return profile.columns_by_type(p.columns).select("semantic_type", F.array_join("columns", ",").alias("columns"))


def summary(spark, sf):
    p = profile.Profile(derived(spark, sf, views.LOOSE_LINES))
    return profile.summary_view(p.dataset)


def duplicate_rows(spark, sf):
    return profile.duplicate_count(derived(spark, sf, views.LOOSE_LINES))


def duplicate_rows_wide(spark, sf):
    return profile.duplicate_count(table(spark, sf, "documents").select("text", "lang"))


def missing_cells(spark, sf):
    p = profile.column_profile(derived(spark, sf, views.DIRTY_ORDERS))
    return p.select(F.col("column").alias("column_name"), "null_count", "null_pct")


def top_category(spark, sf):
    p = profile.column_profile(table(spark, sf, "part")).where("semantic_type = 'categorical'")
    return p.select(F.col("column").alias("column_name"), "top_value", "top_count", *rounded("top_pct"))


def column_preview(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return profile.column_preview(d, ["o_orderkey"]).select(
        F.col("column").alias("column_name"), F.array_join("values", "|").alias("first_values"))


def quick_stats(spark, sf):
    return profile.quick_stats(derived(spark, sf, views.DIRTY_ORDERS))


# --- validation, audit -------------------------------------------------------------------


def validate_target(spark, sf):
    return validate.validate(derived(spark, sf, views.DIRTY_ORDERS), "o_totalprice").select("severity", "code", "n")


def validate_small(spark, sf):
    return validate.validate(table(spark, sf, "region")).select("severity", "code", "n")


def validate_verdict(spark, sf):
    return validate.verdict(derived(spark, sf, views.DIRTY_ORDERS), "spare")


def _issues(spark, sf, view, target=None):
    d = derived(spark, sf, view)
    return aud.audit(d, profile.Profile(d), target), len(d.columns)


def _issue_rows(issues):
    return issues.select("rule_id", F.coalesce("feature", F.lit("*")).alias("feature"), "severity", *rounded("metric_value"))


def audit_issues(spark, sf):
    return _issue_rows(_issues(spark, sf, views.DIRTY_ORDERS, "gross")[0])


def audit_cardinality(spark, sf):
    return _issue_rows(_issues(spark, sf, views.DOCUMENT_FACTS, "doc_id")[0])


def audit_duplicates(spark, sf):
    return _issue_rows(_issues(spark, sf, views.LOOSE_LINES)[0].where("rule_id = 'DUPLICATE_ROWS'"))


def audit_score(spark, sf):
    issues, width = _issues(spark, sf, views.DIRTY_ORDERS, "gross")
    return aud.audit_score(issues, width)


def audit_view(spark, sf):
    issues, _ = _issues(spark, sf, views.LOOSE_LINES)
    return aud.issue_view(issues).select("severity", "rule_id", "feature")


def audit_outliers(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return aud.outlier_shares(d, profile.Profile(d)).select(F.col("column").alias("column_name"), "n", "outliers", *rounded("outlier_pct"))


def audit_leakage(spark, sf):
    d = derived(spark, sf, views.DIRTY_ORDERS)
    out = aud.leakage_correlations(d, profile.Profile(d), "gross")
    return out.select(F.col("column").alias("column_name"), "n", *rounded("r"))


def report_json(spark, sf):
    issues, width = _issues(spark, sf, views.LOOSE_LINES)
    return reports.rows_as_json(aud.audit_score(issues, width))


def report_issues(spark, sf):
    """The issue list as it is read back from the JSON report."""
    issues, width = _issues(spark, sf, views.LOOSE_LINES)
    report = reports.audit_report(issues, aud.audit_score(issues, width))
    listed = F.from_json("report", "issues array<struct<rule_id:string,feature:string,severity:string,metric_value:double>>")["issues"]
    return _issue_rows(report.select(F.explode(listed).alias("i")).select("i.*"))


# --- EDA ---------------------------------------------------------------------------------

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def correlation_matrix(spark, sf):
    return eda.correlation_matrix(table(spark, sf, "lineitem"), LINE_NUMBERS)


def correlation_gaps(spark, sf):
    d = derived(spark, sf, views.DIRTY_ORDERS)
    return eda.correlation_matrix(d, ["o_custkey", "o_totalprice", "gross", "batch"])


def top_correlations(spark, sf):
    return eda.top_correlations(table(spark, sf, "lineitem"), LINE_NUMBERS, 3).select("c1", "c2", "r")


def insight_target_binary(spark, sf):
    out = eda.target_distribution(table(spark, sf, "labels"), "quality")
    return out.select("majority_class", "minority_class", *rounded("majority_pct", "minority_pct", "ratio"), "imbalanced")


def insight_target_numeric(spark, sf):
    return eda.target_numeric(table(spark, sf, "orders"), "o_totalprice").select(*rounded("mean", "median", "std", "skew", digits=4), "shape")


def insight_multicollinearity(spark, sf):
    d = derived(spark, sf, views.DIRTY_ORDERS)
    p = profile.Profile(d)
    strong = eda.top_correlations(d, p.numerical, 3).where(F.abs("r") >= eda.STRONG_R)
    return strong.select("c1", "c2", "r")


def insight_skew(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    out = eda.skewed_features(profile.Profile(d), "doc_id")
    return out.select(F.col("column").alias("column_name"), *rounded("skew", digits=4))


def insight_missing(spark, sf):
    d = derived(spark, sf, views.DIRTY_ORDERS)
    return eda.missing_leaders(profile.Profile(d)).select(F.col("column").alias("column_name"), "null_pct")


def insight_table(spark, sf):
    d = derived(spark, sf, views.DIRTY_ORDERS)
    out = eda.insights(d, profile.Profile(d), "gross")
    return out.select("category", "title", "importance", "feature")


def histogram(spark, sf):
    return eda.histogram(table(spark, sf, "orders"), "o_totalprice").select("bin", "n")


def class_frequency(spark, sf):
    return eda.class_counts(table(spark, sf, "lineitem"), "l_linenumber")


def boxplot(spark, sf):
    out = eda.box_stats(table(spark, sf, "documents"), "n_chars")
    return out.select(*rounded("q25", "median", "q75", "whisker_lo", "whisker_hi"), "n_outliers")


def outlier_rows(spark, sf):
    return eda.outlier_points(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars")


def top_categories(spark, sf):
    return eda.top_categories(derived(spark, sf, views.DIRTY_ORDERS), "o_orderpriority")


def inspect_column(spark, sf):
    p = profile.Profile(table(spark, sf, "part"))
    return eda.inspect_column(p, "p_size").select(F.col("column").alias("column_name"), "n_distinct", *rounded(*STATS, digits=4))


# --- problem -----------------------------------------------------------------------------

TARGETS = [("orders", "o_orderstatus"), ("orders", "o_totalprice"), ("labels", "quality"), ("lineitem", "l_linenumber"),
           ("documents", "lang"), ("events", "ts")]


def detect_problem(spark, sf):
    out = None
    for name, target in TARGETS:
        one = problem.detect(table(spark, sf, name), target).table(spark)
        out = one if out is None else out.unionByName(one)
    return out.select("target", "problem_type", "n_distinct", "imbalanced", "imbalance_ratio", "primary_metric", "cv_strategy")


def class_distribution(spark, sf):
    return problem.class_distribution(table(spark, sf, "events"), "event_type")


def imbalance(spark, sf):
    return problem.imbalance(table(spark, sf, "labels"), "toxic")


# --- features ----------------------------------------------------------------------------


def feature_plan(spark, sf):
    d = table(spark, sf, "part")
    plan = feat.plan_features(profile.Profile(d), "p_retailprice")
    return plan.table(spark).select(F.col("column").alias("column_name"), "role")


def drop_null_target(spark, sf):
    d = derived(spark, sf, views.DIRTY_ORDERS)
    d = problem.encode_label(d, problem.detect(d, "o_totalprice"))
    return d.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("gross"), 0).alias("total"))


def _order_encoding(spark, sf):
    d = derived(spark, sf, views.DIRTY_ORDERS)
    return d, feat.fit(d, feat.FeaturePlan(numeric=["o_totalprice"]))


def impute_median(spark, sf):
    d, enc = _order_encoding(spark, sf)
    filled = F.coalesce(as_double(d, "o_totalprice"), F.lit(enc.numeric["o_totalprice"].median))
    return d.select("o_orderkey", F.round(filled, DIGITS).alias("value"))


def scale_standard(spark, sf):
    d, enc = _order_encoding(spark, sf)
    return d.select("o_orderkey", F.round(feat.scaled(d, "o_totalprice", enc.numeric["o_totalprice"]), DIGITS).alias("value"))


def impute_mode(spark, sf):
    d = derived(spark, sf, views.DIRTY_ORDERS)
    return feat.mode_table(d, ["o_orderstatus", "o_orderpriority"]).select(F.col("column").alias("column_name"), "mode")


def one_hot(spark, sf):
    d = table(spark, sf, "customer")
    enc = feat.fit(d, feat.FeaturePlan(one_hot=["c_mktsegment"]))
    from pyspark.ml.functions import vector_to_array

    cells = feat.transform(d, enc).select("c_custkey", F.posexplode(vector_to_array("features")).alias("i", "value"))
    return cells.select("c_custkey", F.get(F.array(*[F.lit(n) for n in enc.names]), F.col("i")).alias("feature"), "value")


def ordinal_encode(spark, sf):
    d = table(spark, sf, "part")
    entries = feat.ordinal_dictionary(d, "p_name")
    return feat.lookup(d.select("p_partkey", "p_name"), F.col("p_name"), entries, "code").select("p_partkey", "code")


def label_encode(spark, sf):
    return problem.label_codes(table(spark, sf, "lineitem"), "l_linenumber")


def class_weights(spark, sf):
    out = folds.class_weights(table(spark, sf, "orders"), "o_orderstatus")
    return out.select("label", "n", *rounded("weight"))


def leave_fold_out_stats(spark, sf):
    d = _folded_orders(spark, sf)
    out = feat.leave_fold_out_table(d, ["o_totalprice", "o_custkey"], 3)
    return out.select(F.col("column").alias("column_name"), "fold", *rounded("median", "mean", "std", digits=4))


def fold_safe_transform(spark, sf):
    d = _folded_orders(spark, sf)
    states = feat.fit_folds(d, feat.FeaturePlan(numeric=["o_totalprice"]), 3)
    value = None
    for j, enc in enumerate(states):
        own = feat.scaled(d, "o_totalprice", enc.numeric["o_totalprice"])
        value = F.when(F.col("fold") == j, own) if value is None else value.when(F.col("fold") == j, own)
    return d.select("o_orderkey", "fold", F.round(value, DIGITS).alias("value"))


def leave_fold_out_modes(spark, sf):
    d = folds.assign_folds(table(spark, sf, "documents").select("doc_id", "lang", "source"), 3, ["doc_id"])
    counts = feat.fold_value_counts(d, ["lang", "source"], 3)
    best = counts.groupBy("idx", "j").agg(F.min(F.struct((-F.col("n")).alias("neg"), "v")).alias("m"))
    return best.select(F.get(F.array(F.lit("lang"), F.lit("source")), F.col("idx")).alias("column_name"),
                       F.col("j").alias("fold"), F.col("m.v").alias("mode"), (-F.col("m.neg")).alias("n"))


def _folded_orders(spark, sf):
    d = derived(spark, sf, views.DIRTY_ORDERS).select("o_orderkey", "o_custkey", "o_totalprice")
    return folds.assign_folds(d, 3, ["o_orderkey"])


def kfold(spark, sf):
    return folds.assign_folds(table(spark, sf, "orders").select("o_orderkey"), 5, ["o_orderkey"])


def stratified_kfold(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return folds.assign_folds(d, 5, ["doc_id"], label="lang")


# --- metrics -----------------------------------------------------------------------------


def _binary(spark, sf):
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    p = F.col("n_chars").cast("double") / (F.col("n_chars") + 1500)
    return joined.select(
        "lang", F.col("quality").cast("double").alias("label"), F.when(p > 0.5, 1.0).otherwise(0.0).alias("prediction"),
        F.array(1.0 - p, p).alias("probs"))


def _three_way(spark, sf):
    a = F.col("o_totalprice") / 600000.0
    label = F.array_position(F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.col("o_orderstatus")) - 1
    return table(spark, sf, "orders").select(
        label.cast("double").alias("label"), (F.substring("o_orderpriority", 1, 1).cast("int") % 3).cast("double").alias("prediction"),
        F.array(a * 0.6, (1.0 - a) * 0.6, F.lit(0.4)).alias("probs"))


def _regression(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_returnflag", F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 2000.0).alias("prediction"))


def metrics_binary(spark, sf):
    out = met.classification_metrics(_binary(spark, sf), 2)
    return out.select(*rounded("accuracy", "precision", "recall", "f1", "roc_auc", "log_loss"), "undefined")


def metrics_binary_grouped(spark, sf):
    out = met.classification_metrics(_binary(spark, sf), 2, ["lang"])
    return out.select("lang", *rounded("accuracy", "precision", "recall", "f1", "roc_auc", "log_loss"))


def metrics_multiclass(spark, sf):
    out = met.classification_metrics(_three_way(spark, sf), 3)
    return out.select(*rounded("accuracy", "precision", "recall", "f1", "roc_auc", "log_loss"))


def roc_auc(spark, sf):
    return met.roc_auc(_binary(spark, sf)).select(*rounded("auc"), "positives", "negatives")


def roc_auc_ovr(spark, sf):
    return met.roc_auc_ovr(_three_way(spark, sf), 3).select(*rounded("auc"), "classes")


def log_loss(spark, sf):
    return met.log_loss(_binary(spark, sf)).select(*rounded("log_loss"))


def confusion_matrix(spark, sf):
    return met.confusion_matrix(_three_way(spark, sf))


def metrics_regression(spark, sf):
    out = met.regression_metrics(_regression(spark, sf), ["l_returnflag"])
    return out.select("l_returnflag", *rounded("mse", digits=1), *rounded("mae", "rmse", digits=4),
                      *rounded("r2", "explained_variance", "mape"))


# --- result tables -----------------------------------------------------------------------


def _fold_metrics(spark, sf):
    """A fold-metric table derived from the data: flags as models, line numbers as folds."""
    d = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model_id"), F.col("l_linenumber").alias("fold")).agg(
        F.avg("l_discount").alias("rmse"), F.avg("l_tax").alias("r2"))
    return met.as_long(d, ["model_id", "fold"])


def cv_summary(spark, sf):
    return cv.cv_summary(_fold_metrics(spark, sf)).select("model_id", "metric", *rounded("mean", "std"), "folds")


def leaderboard(spark, sf):
    out = cv.leaderboard(_fold_metrics(spark, sf), "rmse", ["r2", "rmse"])
    return out.select("model_id", *rounded("cv_mean", "cv_std", "r2", "rmse"), F.col("rank").cast("long").alias("rank"))


def fold_table(spark, sf):
    return cv.fold_table(_fold_metrics(spark, sf), ["r2", "rmse"]).select("model_id", "fold", *rounded("r2", "rmse"))


def _trials(spark, sf):
    d = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("trial"))
    return d.agg(F.avg(F.col("l_discount") + F.col("l_tax")).alias("score")).withColumn(
        "params", F.create_map(F.lit("line"), F.col("trial").cast("string")))


def trial_best_curve(spark, sf):
    out = search.trial_curve(_trials(spark, sf), False, 0.1)
    return out.select("trial", *rounded("score", "running_best", "baseline", "best", "delta"))


def best_trial(spark, sf):
    return search.best_trial(_trials(spark, sf), True).select("trial", *rounded("score"), F.col("params")["line"].alias("line"))


WEIGHTS = {"l_quantity": 0.5, "l_discount": -20.0, "l_tax": 8.0}


def _line_shap(spark, sf):
    d = table(spark, sf, "lineitem")
    means = d.agg(*[F.avg(c).alias(c) for c in WEIGHTS]).first().asDict()
    return explain.linear_shap(d, ["l_orderkey", "l_linenumber"], {c: F.col(c) for c in WEIGHTS}, WEIGHTS, means)


def linear_shap(spark, sf):
    return _line_shap(spark, sf).select("l_orderkey", "l_linenumber", "feature", *rounded("value", "phi"))


def global_importance(spark, sf):
    return explain.global_importance(_line_shap(spark, sf))


def local_top_contributions(spark, sf):
    d = table(spark, sf, "part")
    weights = {"p_size": 2.0, "p_retailprice": -0.7, "name_length": 3.5}
    cells = {"p_size": F.col("p_size"), "p_retailprice": F.col("p_retailprice"), "name_length": F.length("p_name")}
    means = d.agg(*[F.avg(x).alias(c) for c, x in cells.items()]).first().asDict()
    phi = explain.linear_shap(d, ["p_partkey"], cells, weights, means)
    out = explain.local_contributions(phi, ["p_partkey"], k=2)
    return out.select("p_partkey", "feature", *rounded("phi"), "rank", "direction")


def row_explanations(spark, sf):
    """Each part with its key, a carried column and its contributions in order."""
    d = table(spark, sf, "part")
    weights = {"p_size": 2.0, "p_retailprice": -0.7, "name_length": 3.5}
    cells = {"p_size": F.col("p_size"), "p_retailprice": F.col("p_retailprice"), "name_length": F.length("p_name")}
    means = d.agg(*[F.avg(x).alias(c) for c, x in cells.items()]).first().asDict()
    phi = explain.linear_shap(d, ["p_partkey", "p_brand"], cells, weights, means)
    rows = explain.row_explanations(phi, ["p_partkey", "p_brand"], k=2)
    return rows.select(
        "p_partkey", "p_brand", F.array_join(F.transform("contributions", lambda c: c["feature"]), ",").alias("features"),
        F.array_join(F.transform("contributions", lambda c: c["direction"]), ",").alias("directions"))


def feature_schema_table(spark, sf):
    d = table(spark, sf, "part")
    plan = feat.FeaturePlan(numeric=["p_size", "p_retailprice"], one_hot=["p_type"], ordinal=["p_name"])
    return feature_schema(d, plan).select(
        "name", "is_numerical", "sample_value", F.array_join("unique_values", "|").alias("unique_values"))


def run_history(spark, sf):
    runs = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderstatus").alias("experiment"),
        F.concat(F.lit("run-"), F.col("o_custkey").cast("string")).alias("run_name"), F.lit("FINISHED").alias("status"),
        F.when(F.col("o_orderpriority") == "5-LOW", "deleted").otherwise("active").alias("lifecycle"),
        F.col("o_orderdate").alias("start_time"),
        F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("params"),
        F.create_map(F.lit("total"), F.col("o_totalprice")).alias("metrics"))
    out = runlog.run_history(runs, "O")
    return out.select(F.col("Run ID").alias("run_id"), F.col("Status").alias("status"),
                      F.date_format("Timestamp", "yyyy-MM-dd").alias("started"), F.col("Run Name").alias("run_name"),
                      "param_priority", "metric_total")


def run_cleaning(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.create_map(F.lit("text"), F.col("text")).alias("params"),
        F.create_map(F.lit("size"), F.col("n_chars").cast("string"), F.lit("lang"), F.col("lang")).alias("metrics"))
    out = runlog.clean_runs(d)
    return out.select("doc_id", F.col("params")["text"].alias("text"), F.col("metrics")["size"].alias("size"),
                      F.size("metrics").cast("long").alias("n_metrics"))


def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "customer-csv")
    table(spark, sf, "customer").write.option("header", True).option("sep", ";").csv(path)
    return delimited.read_delimited(spark, path)


def csv_text_roundtrip(spark, sf):
    """Texts with line breaks, commas and quotes, written as delimited text and read back in byte ranges."""
    path = scratch_path(spark, "documents-csv")
    broken = F.regexp_replace("text", "[.] ", ".\n")
    texts = table(spark, sf, "documents").select("doc_id", F.concat(F.lit('"'), broken).alias("text"), "lang", "source")
    texts.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return delimited.read_delimited(spark, path).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "lang", "source")


def csv_dialects(spark, sf):
    """A folder of two dialects: Latin-1 with semicolons, and UTF-8 with commas, another column order and one more."""
    path = scratch_path(spark, "customer-dialects")
    accented = F.concat("c_name", F.lit(" é")).alias("c_name")
    customers = table(spark, sf, "customer").select("c_custkey", accented, "c_acctbal")
    latin = customers.where("c_custkey % 3 = 0").write.option("header", True).option("sep", ";")
    latin.option("encoding", "ISO-8859-1").csv(f"{path}/latin")
    other = customers.where("c_custkey % 3 > 0").select("c_acctbal", "c_name", "c_custkey", F.lit("日本").alias("place"))
    other.write.option("header", True).csv(f"{path}/utf8")
    return delimited.read_delimited(spark, f"{path}/*").select("c_custkey", "c_name", "c_acctbal", "place")


def csv_headers(spark, sf):
    """Dialect of each file that the order table is written to with padded names and an unnamed empty column."""
    path = scratch_path(spark, "orders-padded")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias(" o_orderkey "), "o_totalprice", F.lit(None).cast("string").alias("Unnamed: 2"))
    orders.write.option("header", True).option("sep", "|").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    dialects = delimited.file_dialects(spark, path).agg(
        F.max("encoding").alias("encoding"), F.min("delimiter").alias("delimiter"), F.max("delimiter").alias("last")).first()
    read = delimited.read_delimited(spark, path)
    return read.agg(F.count("o_orderkey").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).select(
        "n", "total", F.lit(",".join(read.columns)).alias("names"), F.lit(dialects["encoding"]).alias("encoding"),
        F.lit(dialects["delimiter"] if dialects["delimiter"] == dialects["last"] else "?").alias("delimiter"))


def type_inference(spark, sf):
    """The dirty order table as text with markers, typed back."""
    d = derived(spark, sf, views.DIRTY_ORDERS).select("o_orderkey", "o_totalprice", "o_orderpriority", "spare")
    text = d.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.coalesce(F.col("o_totalprice").cast("string"), F.lit("NA")).alias("o_totalprice"),
        F.coalesce("o_orderpriority", F.lit("null")).alias("o_orderpriority"),
        F.lit("n/a").alias("spare"))
    return delimited.infer_types(text)


def row_cap(spark, sf):
    """How many rows a read with a cap gives, and how many of them the table has."""
    path = scratch_path(spark, "orders-csv")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    orders.write.option("header", True).csv(path)
    capped = delimited.read_delimited(spark, path, max_rows=100)
    found = capped.join(orders.withColumn("there", F.lit(1)), ["o_orderkey", "o_totalprice"], "left")
    return found.agg(F.count(F.lit(1)).alias("rows"), F.count("there").alias("known"))


# --- models (rows only) ------------------------------------------------------------------


def _labelled_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf, "labels"), "doc_id")


def _document_data(spark, sf, k=3):
    d = _labelled_documents(spark, sf)
    p = problem.detect(d, "quality")
    plan = feat.plan_features(profile.Profile(d), "quality", ["doc_id"])
    return d, p, plan, cv.fold_data(d, p, plan, k, ["doc_id"])


def cv_benchmark(spark, sf):
    _, p, _, data = _document_data(spark, sf)
    return cv.cross_validate(data, models.candidates(p, models.FAST))


def cv_regression(spark, sf):
    d = table(spark, sf, "part")
    p = problem.detect(d, "p_retailprice")
    plan = feat.plan_features(profile.Profile(d), "p_retailprice", ["p_partkey"])
    data = cv.fold_data(d, p, plan, 3, ["p_partkey"])
    return cv.cross_validate(data, models.candidates(p, models.FAST))


def tune(spark, sf):
    _, p, _, data = _document_data(spark, sf)
    return search.tune(data, models.candidates(p)[0], p.primary_metric).trials


def tune_curve(spark, sf):
    """The trials of a full search: number, and whether the running best is one of the scores and none is above it."""
    _, p, _, data = _document_data(spark, sf)
    found = search.tune(data, models.candidates(p)[0], p.primary_metric)
    curve = search.trial_curve(found.trials, found.maximize, found.baseline)
    ok = (F.col("running_best") >= F.col("score")) & (F.col("best") >= F.col("running_best"))
    return curve.select(F.col("trial").cast("long").alias("trial"), ok.alias("ok"))


def cv_sizes(spark, sf):
    """Folds of each candidate, rows held out in all of them, and the folds whose two sides do not make the table."""
    d, p, _, data = _document_data(spark, sf, 5)
    parts = cv.cross_validate(data, models.candidates(p, models.FAST)).select("model_id", "fold", "train_size", "val_size").distinct()
    n = d.where("quality is not null").count()
    return parts.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("folds"), F.sum("val_size").alias("held"),
        F.count_if(F.col("train_size") + F.col("val_size") != n).alias("uneven"))


def _fitted(spark, sf, index, preset=models.REFERENCE):
    d = _labelled_documents(spark, sf)
    p = problem.detect(d, "quality")
    plan = feat.plan_features(profile.Profile(d), "quality", ["doc_id"])
    pipeline = cv.fit_full(d, p, plan, models.candidates(p, preset)[index], {})
    return d, p, plan, pipeline


def tree_shap(spark, sf):
    d, _, _, fitted = _fitted(spark, sf, 1, models.FAST)
    encoder, model = fitted.stages
    return explain.tree_shap(encoder.transform(d), ["doc_id"], model, encoder.encoding.names)


def sampled_shapley(spark, sf):
    d, _, _, fitted = _fitted(spark, sf, 0)
    encoder, model = fitted.stages
    encoded = encoder.transform(d)
    return explain.sampled_shap(encoded, ["doc_id"], model, encoder.encoding.names, True, explain.background(encoded), 4)


def _misses(phi, expected):
    """Rows and classes explained, and those whose attributions do not add up to base and output."""
    keys = [c for c in ("doc_id", "class") if c in phi.columns]
    sums = phi.groupBy(*keys).agg(F.sum("phi").alias("phi"), F.first("base").alias("base"))
    off = F.abs(F.col("phi") + F.col("base") - F.col("output")) > 1e-6
    return sums.join(expected, keys, "left").agg(
        F.count(F.lit(1)).alias("sets"), F.count_if(F.coalesce(off, F.lit(True))).alias("off"))


def tree_additivity(spark, sf):
    d, _, _, fitted = _fitted(spark, sf, 1)
    encoder, model = fitted.stages
    encoded = encoder.transform(d)
    phi = explain.tree_shap(encoded, ["doc_id"], model, encoder.encoding.names)
    scored = model.transform(encoded)
    return _misses(phi, scored.select("doc_id", F.posexplode(models.class_probabilities(scored)).alias("class", "output")))


def sampled_additivity(spark, sf):
    d, _, _, fitted = _fitted(spark, sf, 0)
    encoder, model = fitted.stages
    encoded = encoder.transform(d)
    centres = explain.background(encoded)
    phi = explain.sampled_shap(encoded, ["doc_id"], model, encoder.encoding.names, True, centres)

    def chance(rows):
        scored = model.transform(rows)
        return scored.withColumn("output", F.get(models.class_probabilities(scored), F.lit(1)))

    start = spark.createDataFrame([(Vectors.dense(c),) for c in centres], ["features"])
    base = chance(start).agg(F.avg("output")).first()[0]
    return _misses(phi.withColumn("base", F.lit(base)), chance(encoded).select("doc_id", "output"))


def sampled_class_additivity(spark, sf):
    """Attributions of every class of a model of five classes, from one scoring pass."""
    d = table(spark, sf, "customer")
    p = problem.detect(d, "c_mktsegment")
    plan = feat.FeaturePlan(numeric=["c_acctbal", "c_nationkey"])
    encoder, model = cv.fit_full(d, p, plan, models.candidates(p)[0], {}).stages
    encoded = encoder.transform(d)
    centres = explain.background(encoded)
    codes = explain.class_codes(model)
    phi = explain.sampled_shap(encoded, ["c_custkey"], model, encoder.encoding.names, True, centres, classes=codes)
    start = model.transform(spark.createDataFrame([(Vectors.dense(c),) for c in centres], ["features"]))
    bases = start.select(F.posexplode(models.class_probabilities(start)).alias("class", "v")).groupBy("class").agg(F.avg("v").alias("base"))
    scored = model.transform(encoded)
    chances = scored.select("c_custkey", F.posexplode(models.class_probabilities(scored)).alias("class", "output"))
    sums = phi.groupBy("c_custkey", "class").agg(F.sum("phi").alias("phi")).join(F.broadcast(bases), "class")  # a row per class
    off = F.abs(F.col("phi") + F.col("base") - F.col("output")) > 1e-6
    return sums.join(chances, ["c_custkey", "class"], "left").agg(
        F.count(F.lit(1)).alias("sets"), F.count_if(F.coalesce(off, F.lit(True))).alias("off"))


def model_importance(spark, sf):
    _, _, _, fitted = _fitted(spark, sf, 1)
    encoder, model = fitted.stages
    return explain.model_importance(spark, model, encoder.encoding.names)


def _saved(spark, sf):
    d, p, plan, fitted = _fitted(spark, sf, 0)
    types = {c: d.schema[c].dataType.simpleString() for c in plan.inputs}
    bundle = Bundle(fitted, plan, "quality", p.problem_type, p.classes, types, "logistic_regression", "Logistic Regression",
                    p.primary_metric)
    path = save_bundle(spark, bundle, scratch_path(spark, "bundle"))
    return d, load_bundle(spark, path)


def batch_score(spark, sf):
    d, bundle = _saved(spark, sf)
    return score(d, bundle).drop("probabilities")


def stream_score(spark, sf):
    d, bundle = _saved(spark, sf)
    source, output, state = (scratch_path(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    d.write.parquet(source)
    score_stream(read_records(spark, source, d.schema), bundle, output, state).awaitTermination()
    return spark.read.parquet(output).drop("probabilities")


def score_consistency(spark, sf):
    """Rows scored, and those whose class chances do not add up to 1 or whose label is not the likeliest."""
    d, bundle = _saved(spark, sf)
    chances = F.map_values("probabilities")
    even = F.abs(F.aggregate(chances, F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9
    likeliest = F.try_element_at("probabilities", F.col("predicted_quality")) == F.array_max(chances)
    return score(d, bundle).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.coalesce(even, F.lit(False))).alias("uneven"),
        F.count_if(~F.coalesce(likeliest, F.lit(False))).alias("unlikely"))


def stream_equals_batch(spark, sf):
    """Rows that a stream scored, and those that one way of scoring gives and the other does not."""
    d, bundle = _saved(spark, sf)
    source, output, state = (scratch_path(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    d.write.parquet(source)
    score_stream(read_records(spark, source, d.schema), bundle, output, state).awaitTermination()
    sides = [x.select("doc_id", "predicted_quality", F.round("probability", 9).alias("chance"), F.lit(side).alias("side"))
             for side, x in ((1, spark.read.parquet(output)), (-1, score(d, bundle)))]
    rows = sides[0].unionByName(sides[1]).groupBy("doc_id", "predicted_quality", "chance").agg(
        F.sum("side").alias("surplus"), F.count_if(F.col("side") == 1).alias("n"))
    return rows.agg(F.sum("n").alias("rows"), F.count_if(F.col("surplus") != 0).alias("different"))


def stream_reload(spark, sf):
    """A stream during which a second bundle is published: rows scored, versions that scored some, rows that were not
    scored exactly once, and rows whose chance is not that of their version."""
    d, p, plan, fitted = _fitted(spark, sf, 0)
    types = {c: d.schema[c].dataType.simpleString() for c in plan.inputs}
    bundle = lambda model, name: Bundle(model, plan, "quality", p.problem_type, p.classes, types, name, name, p.primary_metric)
    source, root, output, state = (scratch_path(spark, n) for n in ("stream-in", "bundles", "stream-out", "stream-state"))
    d.repartition(4, "doc_id").write.parquet(source)
    second = cv.fit_full(d, p, plan, models.candidates(p)[0], {"C": 0.01})
    publish(spark, bundle(fitted, "first"), root)
    records = read_records(spark, source, d.schema, files_per_trigger=1)
    swap = lambda batch: publish(spark, bundle(second, "second"), root) if batch == 0 else None
    score_stream_latest(records, root, output, state, after_batch=swap).awaitTermination()
    got = spark.read.parquet(output).select("doc_id", "bundle_version", "probability")
    want = [score(d, load_bundle(spark, r["path"])).select("doc_id", F.lit(r["version"]).alias("bundle_version"), F.col("probability").alias("expected"))
            for r in manifest(spark, root).collect()]  # two versions
    every = want[0].unionByName(want[1]).join(got, ["doc_id", "bundle_version"], "left")
    rows = every.groupBy("doc_id").agg(F.count("probability").alias("times"), F.count_if(F.abs(F.col("probability") - F.col("expected")) > 1e-9).alias("off"))
    totals = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("times") != 1).alias("uneven"), F.sum("off").alias("off"))
    return totals.withColumn("versions", got.agg(F.count_distinct("bundle_version")).scalar())


def model_card(spark, sf):
    return _saved(spark, sf)[1].card(spark).drop("created_at")


def pipeline_run(spark, sf):
    """The steps of a run with its default trials, folds and full-size models."""
    out = run(table(spark, sf, "part"), "p_retailprice", scratch_path(spark, "artifacts"), ["p_partkey"])
    return out.step_table(spark).select("step", "status", "message")


ALL: list[Query] = [
    profile_columns, profile_lines, profile_dirty, profile_merged, profile_dataset, semantic_types, summary, duplicate_rows, duplicate_rows_wide,
    missing_cells, top_category, column_preview, quick_stats, validate_target, validate_small, validate_verdict,
    audit_issues, audit_cardinality, audit_duplicates, audit_score, audit_view, audit_outliers, audit_leakage, report_json, report_issues,
    correlation_matrix, correlation_gaps, top_correlations, insight_target_binary, insight_target_numeric,
    insight_multicollinearity, insight_skew, insight_missing, insight_table, histogram, class_frequency, boxplot,
    outlier_rows, top_categories, inspect_column, detect_problem, class_distribution, imbalance, feature_plan,
    drop_null_target, impute_median, scale_standard, impute_mode, one_hot, ordinal_encode, label_encode, class_weights,
    leave_fold_out_stats, leave_fold_out_modes, fold_safe_transform, kfold, stratified_kfold, metrics_binary,
    metrics_binary_grouped, metrics_multiclass, roc_auc, roc_auc_ovr, log_loss, confusion_matrix, metrics_regression,
    cv_summary, leaderboard, fold_table, trial_best_curve, best_trial, linear_shap, global_importance,
    local_top_contributions, row_explanations, sampled_class_additivity, feature_schema_table, run_history, run_cleaning, csv_roundtrip, csv_text_roundtrip, csv_dialects, csv_headers,
    type_inference, row_cap,
    cv_benchmark, cv_regression, tune, tree_shap, sampled_shapley, model_importance, batch_score, stream_score, model_card,
    pipeline_run, tune_curve, cv_sizes, tree_additivity, sampled_additivity, score_consistency, stream_equals_batch, stream_reload,
]

QUERIES: dict[str, Query] = {q.__name__: q for q in ALL}
