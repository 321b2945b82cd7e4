"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "profile_columns", "profile_lines", "duplicate_rows", "duplicate_rows_wide", "audit_issues", "audit_outliers",
    "correlation_matrix", "top_correlations", "insight_target_numeric", "histogram", "boxplot", "top_categories",
    "detect_problem", "feature_plan", "scale_standard", "one_hot", "ordinal_encode", "kfold", "stratified_kfold",
    "leave_fold_out_stats", "fold_safe_transform", "metrics_binary", "metrics_multiclass", "metrics_regression", "roc_auc_ovr",
    "confusion_matrix", "leaderboard", "linear_shap", "global_importance", "local_top_contributions", "run_history",
    "csv_roundtrip", "csv_text_roundtrip", "profile_merged", "row_explanations", "cv_regression", "tree_shap", "batch_score", "stream_score",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tabwright.plans.queries import QUERIES

    for name in ("profile_columns", "csv_roundtrip"):  # start the session and the Python workers outside the timings
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_wall_clock", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "preset": "fast models; batch_score full-size",
    }))
    spark.stop()


if __name__ == "__main__":
    main()
