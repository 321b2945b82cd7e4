"""Independent SQL for the registered queries, runnable by DuckDB on the same tables."""

from __future__ import annotations

from tabwright.plans.views import DIRTY_ORDERS, DOCUMENT_FACTS, LOOSE_LINES, as_sql

DIRTY = f"d AS ({as_sql(DIRTY_ORDERS)})"
LOOSE = f"d AS ({as_sql(LOOSE_LINES)})"


def _numeric(c: str, src: str, floating: bool) -> str:
    zero_one = f"count(DISTINCT {c}) = 2 AND min({c}) = 0 AND max({c}) = 1"
    suffix = ".0" if floating else ""
    number = lambda e: f"CASE WHEN {zero_one} THEN NULL ELSE round(CAST({e} AS DOUBLE), 4) END"
    skew = f"CASE WHEN count({c}) <= 2 THEN 0.0 WHEN min({c}) = max({c}) THEN 0.0 ELSE skewness({c}) END"
    std = f"CASE WHEN count({c}) <= 1 THEN 0.0 ELSE stddev_samp({c}) END"
    filled = lambda e: f"CASE WHEN count({c}) = 0 THEN NULL ELSE {e} END"
    ones, zeros = f"count(*) FILTER (WHERE {c} = 1)", f"count(*) FILTER (WHERE {c} = 0)"
    return f"""
      SELECT '{c}' AS column_name, CASE WHEN {zero_one} THEN 'boolean' ELSE 'numerical' END AS semantic_type,
        {_common(c)},
        false AS is_high_cardinality,
        {number(f'min({c})')} AS min, {number(f'max({c})')} AS max, {number(f'avg({c})')} AS mean,
        {number(filled(std))} AS std, {number(f'quantile_cont({c}, 0.5)')} AS median,
        {number(f'quantile_cont({c}, 0.25)')} AS q25, {number(f'quantile_cont({c}, 0.75)')} AS q75,
        {number(filled(skew))} AS skew,
        CASE WHEN {zero_one} THEN CASE WHEN {zeros} >= {ones} THEN '0{suffix}' ELSE '1{suffix}' END END AS top_value,
        CASE WHEN {zero_one} THEN greatest({zeros}, {ones}) END AS top_count,
        CASE WHEN {zero_one} THEN round(greatest({zeros}, {ones}) * 100.0 / count({c}), 6) END AS top_pct
      FROM {src}"""


def _common(c: str) -> str:
    return f"""count(*) - count({c}) AS null_count,
        round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct,
        count(DISTINCT {c}) AS n_distinct,
        round(CAST(count(DISTINCT {c}) AS DOUBLE) / count(*), 4) AS distinct_ratio,
        count(DISTINCT {c}) <= 1 AS is_constant"""


def _empty() -> str:
    return ", ".join(f"CAST(NULL AS DOUBLE) AS {s}" for s in ("min", "max", "mean", "std", "median", "q25", "q75", "skew"))


def _text(c: str, src: str) -> str:
    named = c == "id" or c.endswith("_id") or c.startswith("id_") or "identifier" in c
    at_least = "TRUE" if named else "FALSE"
    share = f"CAST(count(DISTINCT {c}) AS DOUBLE) / count(*)"
    top = f"(SELECT {c} AS v, count(*) AS n FROM {src} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1)"
    return f"""
      SELECT '{c}' AS column_name,
        CASE WHEN ({share} >= 0.95 AND {at_least}) OR ({share} > 0.95 AND count(*) > 30) THEN 'id' ELSE 'categorical' END
          AS semantic_type,
        {_common(c)},
        count(DISTINCT {c}) > 50 AS is_high_cardinality,
        {_empty()},
        (SELECT v FROM {top} t) AS top_value, (SELECT n FROM {top} t) AS top_count,
        round((SELECT n FROM {top} t) * 100.0 / count({c}), 6) AS top_pct
      FROM {src}"""


def _datetime(c: str, src: str) -> str:
    return f"""
      SELECT '{c}' AS column_name, 'datetime' AS semantic_type, {_common(c)}, false AS is_high_cardinality, {_empty()},
        CAST(NULL AS VARCHAR) AS top_value, CAST(NULL AS BIGINT) AS top_count, CAST(NULL AS DOUBLE) AS top_pct
      FROM {src}"""


def profile_sql(src: str, ints=(), floats=(), texts=(), dates=()) -> str:
    parts = [_numeric(c, src, False) for c in ints] + [_numeric(c, src, True) for c in floats]
    parts += [_text(c, src) for c in texts] + [_datetime(c, src) for c in dates]
    return "\nUNION ALL\n".join(parts)


DIRTY_PROFILE = profile_sql(
    "d", ["o_orderkey", "o_custkey", "batch"], ["o_totalprice", "spare", "gross"], ["o_orderstatus", "o_orderpriority"])
LOOSE_PROFILE = profile_sql("d", ["l_linenumber"], ["l_discount", "l_tax"], ["l_returnflag", "l_linestatus"])

# Audit rules over a profile p and a target column
DUPLICATES = """
  SELECT 'DUPLICATE_ROWS' AS rule_id, '*' AS feature,
    CASE WHEN dup * 100.0 / n > 10 THEN 'critical' ELSE 'warning' END AS severity, CAST(dup AS DOUBLE) AS metric_value
  FROM (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d) u) AS dup FROM d) x WHERE dup > 0
"""


def _profile_rules() -> str:
    return """
  SELECT 'HIGH_MISSINGNESS', column_name, 'critical', null_pct FROM p WHERE null_pct > 40
  UNION ALL SELECT 'MODERATE_MISSINGNESS', column_name, 'warning', null_pct FROM p WHERE null_pct > 5 AND null_pct <= 40
  UNION ALL SELECT 'ZERO_VARIANCE', column_name, 'critical', CAST(n_distinct AS DOUBLE) FROM p WHERE is_constant
  UNION ALL SELECT 'IDENTIFIER_COLUMN', column_name, 'warning', distinct_ratio FROM p
    WHERE is_high_cardinality AND semantic_type = 'id'
  UNION ALL SELECT 'HIGH_CARDINALITY', column_name, 'warning', CAST(n_distinct AS DOUBLE) FROM p
    WHERE is_high_cardinality AND semantic_type = 'categorical'
"""


def _outliers(c: str) -> str:
    return f"""
  SELECT 'POTENTIAL_OUTLIERS', '{c}', 'warning', round(o * 100.0 / n, 6) FROM (
    SELECT count(x) AS n, count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS o,
      max(q3) - max(q1) AS iqr
    FROM (SELECT CAST({c} AS DOUBLE) AS x, quantile_cont({c}, 0.25) OVER () AS q1, quantile_cont({c}, 0.75) OVER () AS q3
          FROM d WHERE {c} IS NOT NULL) v
  ) w WHERE n > 20 AND iqr > 0 AND o * 100.0 / n > 5"""


def _leak(c: str, target: str) -> str:
    return f"""
  SELECT 'TARGET_LEAKAGE', '{c}', 'critical', round(abs(r), 6) FROM (
    SELECT count(*) AS n, CASE WHEN min({c}) = max({c}) OR min({target}) = max({target}) THEN NULL ELSE corr({c}, {target}) END AS r
    FROM d WHERE {c} IS NOT NULL AND {target} IS NOT NULL) v WHERE n > 20 AND abs(r) >= 0.98"""


def audit_sql(view: str, prof: str, numerics: list[str], target: str | None) -> str:
    parts = [DUPLICATES, _profile_rules()]
    parts += [_outliers(c) for c in numerics if c != target]
    if target:
        parts += [_leak(c, target) for c in numerics if c != target]
    return f"WITH {view}, p AS ({prof}), issues AS ({' UNION ALL '.join(parts)})"


DIRTY_AUDIT = audit_sql(DIRTY, DIRTY_PROFILE, ["o_orderkey", "o_custkey", "o_totalprice", "batch", "gross"], "gross")
LOOSE_AUDIT = audit_sql(LOOSE, LOOSE_PROFILE, ["l_linenumber", "l_discount", "l_tax"], None)
SCORE = """
  SELECT greatest(0, 100 - 20 * count(*) FILTER (WHERE severity = 'critical') - 5 * count(*) FILTER (WHERE severity = 'warning'))
      AS overall_score,
    greatest(0, {width} + 4 - count(*)) AS healthy_checks,
    count(*) FILTER (WHERE severity = 'warning') AS warning_count,
    count(*) FILTER (WHERE severity = 'critical') AS critical_count FROM issues"""


def _corr(a: str, b: str) -> str:
    return (f"(SELECT CASE WHEN min({a}) = max({a}) OR min({b}) = max({b}) THEN NULL ELSE round(corr({a}, {b}), 3) END "
            f"FROM d WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")


def matrix_sql(names: list[str]) -> str:
    cells = []
    for a in names:
        for b in names:
            r = f"(SELECT CASE WHEN min({a}) < max({a}) THEN 1.0 END FROM d)" if a == b else _corr(a, b)
            cells.append(f"SELECT '{a}' AS c1, '{b}' AS c2, CAST({r} AS DOUBLE) AS r")
    return "\nUNION ALL ".join(cells)


def pairs_sql(names: list[str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{a}' AS c1, '{b}' AS c2, {i} AS i, {j} AS j, {_corr(a, b)} AS r"
        for i, a in enumerate(names) for j, b in enumerate(names) if i < j)


LINES = "d AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)"
LINE_NAMES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def detect_sql(table: str, target: str, kind: str) -> str:
    if kind == "text":
        task = "CASE WHEN d = 2 THEN 'binary_classification' WHEN d <= 20 THEN 'multiclass_classification' END"
    elif kind == "number":
        task = ("CASE WHEN d = 2 THEN 'binary_classification' WHEN d <= 20 AND CAST(d AS DOUBLE) / n < 0.1 "
                "THEN 'multiclass_classification' ELSE 'regression' END")
    else:
        task = "'regression'"
    return f"""
  SELECT '{target}' AS target, task AS problem_type, d AS n_distinct,
    task <> 'regression' AND ratio >= 2 AS imbalanced,
    CASE WHEN task = 'regression' THEN 1.0 ELSE ratio END AS imbalance_ratio,
    CASE WHEN task = 'regression' THEN 'rmse' WHEN task = 'multiclass_classification' THEN 'f1_weighted'
      WHEN ratio >= 2 THEN 'f1' ELSE 'roc_auc' END AS primary_metric,
    CASE WHEN task = 'regression' THEN 'plain' ELSE 'stratified' END AS cv_strategy
  FROM (SELECT d, ratio, {task} AS task FROM (
    SELECT count(*) AS d, sum(c) AS n,
      round((CAST(max(c) AS DOUBLE) / sum(c)) / greatest(0.00001, CAST(min(c) AS DOUBLE) / sum(c)), 2) AS ratio
    FROM (SELECT {target}, count(*) AS c FROM {table} WHERE {target} IS NOT NULL GROUP BY 1) g) h) t"""


FOLDED = f"""{DIRTY}, f AS (SELECT *, CAST((row_number() OVER (
  ORDER BY md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR))), o_orderkey) - 1) % 3 AS INTEGER) AS fold FROM d)"""


def left_out_sql(c: str) -> str:
    """Per held-out fold j: median of the other folds, then moments of the imputed values."""
    return f"""
  SELECT '{c}' AS column_name, CAST(j AS INTEGER) AS fold, median, avg(coalesce(x, median)) AS mean,
    stddev_pop(coalesce(x, median)) AS std
  FROM (SELECT k.j, CAST(f.{c} AS DOUBLE) AS x, median(CAST(f.{c} AS DOUBLE)) OVER (PARTITION BY k.j) AS median
        FROM f JOIN (SELECT unnest([0, 1, 2]) AS j) k ON f.fold <> k.j) v
  GROUP BY j, median"""


BINARY = """b AS (SELECT l.doc_id, d.lang, CAST(l.quality AS DOUBLE) AS label,
  CAST(d.n_chars AS DOUBLE) / (d.n_chars + 1500) AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
  s AS (SELECT *, CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END AS prediction FROM b)"""


def binary_sql(group: str) -> str:
    by = f"GROUP BY {group}" if group else ""
    lead = f"{group}," if group else ""
    over = f"PARTITION BY {group}" if group else ""
    auc_join = f"JOIN a ON m.{group} = a.{group}" if group else ", a"
    pick = f"m.{group}," if group else ""
    undefined = "" if group else ", (pos = 0 OR neg = 0) AS undefined"
    return f"""WITH {BINARY},
  r AS (SELECT *, rank() OVER ({over} ORDER BY p) AS lo, count(*) OVER ({over + ' ' if over else ''}ORDER BY p) AS hi FROM s),
  a AS (SELECT {lead} sum(CASE WHEN label = 1 THEN (lo + hi) / 2.0 ELSE 0 END) AS ranks,
      count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM r {by}),
  m AS (SELECT {lead} avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy,
      CAST(count(*) FILTER (WHERE label = 1 AND prediction = 1) AS DOUBLE) AS tp,
      count(*) FILTER (WHERE prediction = 1) AS pp, count(*) FILTER (WHERE label = 1) AS p1,
      avg(-ln(least(greatest(CASE WHEN label = 1 THEN p ELSE 1 - p END, 2.220446049250313e-16), 1 - 2.220446049250313e-16))) AS ll
      FROM s {by})
  SELECT {pick} round(accuracy, 6) AS accuracy, round(coalesce(tp / nullif(pp, 0), 0), 6) AS precision,
    round(coalesce(tp / nullif(p1, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(pp + p1, 0), 0), 6) AS f1,
    CASE WHEN pos = 0 OR neg = 0 THEN 0.5 ELSE round((ranks - CAST(pos AS DOUBLE) * (pos + 1) / 2) / (CAST(pos AS DOUBLE) * neg), 6) END
      AS roc_auc,
    CASE WHEN pos = 0 OR neg = 0 THEN 0.0 ELSE round(ll, 6) END AS log_loss {undefined}
  FROM m {auc_join}"""


THREE = """t AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0.0 WHEN 'O' THEN 1.0 ELSE 2.0 END AS label,
  CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) % 3 AS DOUBLE) AS prediction,
  o_totalprice / CAST(600000.0 AS DOUBLE) AS a FROM orders),
  s AS (SELECT label, prediction, a * CAST(0.6 AS DOUBLE) AS p0, (1 - a) * CAST(0.6 AS DOUBLE) AS p1, CAST(0.4 AS DOUBLE) AS p2 FROM t)"""
OVR = """e AS (SELECT c, CASE c WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS p, label = c AS hit
    FROM s, (SELECT unnest([0, 1, 2]) AS c) k),
  r AS (SELECT *, rank() OVER (PARTITION BY c ORDER BY p) AS lo, count(*) OVER (PARTITION BY c ORDER BY p) AS hi FROM e),
  u AS (SELECT c, CAST(count(*) FILTER (WHERE hit) AS DOUBLE) AS pos, count(*) FILTER (WHERE NOT hit) AS neg,
    sum(CASE WHEN hit THEN (lo + hi) / 2.0 ELSE 0 END) AS ranks FROM r GROUP BY c),
  auc AS (SELECT sum((ranks - pos * (pos + 1) / 2) / (pos * neg) * pos) / sum(pos) AS auc, count(*) AS classes FROM u)"""

FOLD_METRICS = """g AS (SELECT l_returnflag AS model_id, l_linenumber AS fold, avg(l_discount) AS rmse, avg(l_tax) AS r2
  FROM lineitem GROUP BY 1, 2),
  fm AS (SELECT model_id, fold, 'rmse' AS metric, rmse AS value FROM g UNION ALL SELECT model_id, fold, 'r2', r2 FROM g)"""
TRIALS = "t AS (SELECT l_linenumber AS trial, avg(l_discount + l_tax) AS score FROM lineitem GROUP BY 1)"

LINE_SHAP = """m AS (SELECT avg(l_quantity) AS mq, avg(l_discount) AS md, avg(l_tax) AS mt FROM lineitem),
  s AS (SELECT l_orderkey, l_linenumber, 'l_quantity' AS feature, l_quantity AS value, 0.5 * (l_quantity - mq) AS phi FROM lineitem, m
    UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount, -20.0 * (l_discount - md) FROM lineitem, m
    UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax, 8.0 * (l_tax - mt) FROM lineitem, m)"""

PART_SHAP = """m AS (SELECT avg(p_size) AS ms, avg(p_retailprice) AS mp, avg(length(p_name)) AS ml FROM part),
  s AS (SELECT p_partkey, 'p_size' AS feature, 2.0 * (CAST(p_size AS DOUBLE) - ms) AS phi FROM part, m
    UNION ALL SELECT p_partkey, 'p_retailprice', -CAST(0.7 AS DOUBLE) * (p_retailprice - mp) FROM part, m
    UNION ALL SELECT p_partkey, 'name_length', 3.5 * (CAST(length(p_name) AS DOUBLE) - ml) FROM part, m),
  r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(phi) DESC, feature) AS rank FROM s)"""

ORACLES: dict[str, str] = {
    "profile_columns": profile_sql("events", ["event_id", "user_id"], ["value"], ["event_type", "props"], ["ts"]),
    "profile_lines": profile_sql(
        "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
        ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"], ["l_shipdate"]),
    "profile_merged": f"""SELECT column_name, semantic_type, null_count, null_pct, is_constant, min, max, mean, std, skew, top_value, top_count,
        true AS near FROM ({profile_sql(
            "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
            ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"], ["l_shipdate"])}) q""",
    "profile_dirty": f"WITH {DIRTY} SELECT * FROM ({DIRTY_PROFILE}) q",
    "profile_dataset": f"""WITH {LOOSE} SELECT count(*) AS n_rows, CAST(5 AS BIGINT) AS n_columns,
        CAST(0 AS BIGINT) AS missing_cells, CAST(0 AS DOUBLE) AS missing_pct,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d) u) AS duplicate_rows,
        round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d) u)) * 100.0 / count(*), 6) AS duplicate_pct,
        CAST(count(*) * 20 + sum(octet_length(encode(l_returnflag)) + octet_length(encode(l_linestatus))) AS BIGINT) AS data_bytes,
        CAST(3 AS BIGINT) AS numerical_columns, CAST(2 AS BIGINT) AS categorical_columns, CAST(0 AS BIGINT) AS boolean_columns
        FROM d""",
    "semantic_types": """SELECT 'numerical' AS semantic_type, 'c_custkey,c_nationkey,c_acctbal' AS columns
        UNION ALL SELECT 'id', (SELECT CASE WHEN count(DISTINCT c_name) > 0.95 * count(*) THEN 'c_name' END FROM customer)
        UNION ALL SELECT 'categorical',
          (SELECT CASE WHEN count(DISTINCT c_mktsegment) <= 0.95 * count(*) THEN 'c_name,c_mktsegment' END FROM customer)""",
    "summary": f"""WITH {LOOSE} SELECT 'Rows' AS item, CAST(count(*) AS VARCHAR) AS value FROM d
        UNION ALL SELECT 'Columns', '5' UNION ALL SELECT 'Numerical', '3' UNION ALL SELECT 'Categorical', '2'
        UNION ALL SELECT 'Boolean', '0' UNION ALL SELECT 'Datetime', '0' UNION ALL SELECT 'Missing Cells', '0 (0.00%)'
        UNION ALL SELECT 'Duplicate Rows', printf('%d (%.2f%%)', n - u, (n - u) * 100.0 / n)
          FROM (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS u FROM d)
        UNION ALL SELECT 'Data Size', printf('%.2f MB', (count(*) * 20 + sum(octet_length(encode(l_returnflag)) + octet_length(encode(l_linestatus)))) / 1048576.0)
          FROM d""",
    "duplicate_rows": f"""WITH {LOOSE} SELECT count(*) AS n_rows,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d) u) AS duplicate_rows FROM d""",
    "duplicate_rows_wide": """SELECT count(*) AS n_rows,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents) u) AS duplicate_rows FROM documents""",
    "missing_cells": f"""WITH {DIRTY} SELECT column_name, null_count, null_pct FROM ({DIRTY_PROFILE}) q""",
    "top_category": f"""SELECT column_name, top_value, top_count, top_pct FROM (
        {profile_sql('part', texts=['p_name', 'p_brand', 'p_type'])}) q WHERE semantic_type = 'categorical'""",
    "column_preview": """WITH f AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 5)
        SELECT 'o_orderkey' AS column_name, string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY o_orderkey) AS first_values FROM f
        UNION ALL SELECT 'o_custkey', string_agg(CAST(o_custkey AS VARCHAR), '|' ORDER BY o_orderkey) FROM f
        UNION ALL SELECT 'o_orderpriority', string_agg(o_orderpriority, '|' ORDER BY o_orderkey) FROM f""",
    "quick_stats": f"""WITH {DIRTY} SELECT count(*) AS rows, CAST(8 AS BIGINT) AS columns,
        CAST(8 * count(*) - count(o_orderkey) - count(o_custkey) - count(o_orderstatus) - count(o_totalprice)
          - count(o_orderpriority) - count(batch) - count(spare) - count(gross) AS BIGINT) AS missing,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d) u) AS duplicates, CAST(6 AS BIGINT) AS numeric_columns FROM d""",
    "validate_target": f"""WITH {DIRTY}
        SELECT 'warning' AS severity, 'EMPTY_COLUMNS' AS code, CAST(1 AS BIGINT) AS n FROM d HAVING count(spare) = 0
        UNION ALL SELECT 'warning', 'TARGET_HAS_NULLS', count(*) - count(o_totalprice) FROM d
          HAVING count(o_totalprice) BETWEEN 1 AND count(*) - 1""",
    "validate_small": """SELECT 'error' AS severity, 'TOO_FEW_ROWS' AS code, count(*) AS n FROM region HAVING count(*) < 25""",
    "validate_verdict": f"""WITH {DIRTY} SELECT count(spare) > 0 AS is_valid, CAST(2 AS BIGINT) AS errors, CAST(1 AS BIGINT) AS warnings,
        count(*) AS row_count, CAST(8 AS BIGINT) AS column_count FROM d""",
    "audit_issues": f"{DIRTY_AUDIT} SELECT rule_id, feature, severity, round(metric_value, 6) AS metric_value FROM issues",
    "audit_cardinality": audit_sql(
        f"d AS ({as_sql(DOCUMENT_FACTS)})", profile_sql("d", ["doc_id", "n_chars"], [], ["ref_id", "text", "source"]),
        ["doc_id", "n_chars"], "doc_id") + " SELECT rule_id, feature, severity, round(metric_value, 6) AS metric_value FROM issues",
    "audit_duplicates": f"WITH {LOOSE} {DUPLICATES}",
    "audit_score": f"{DIRTY_AUDIT} {SCORE.format(width=8)}",
    "audit_view": f"""{LOOSE_AUDIT} SELECT severity, rule_id, CASE feature WHEN '*' THEN 'Dataset Global' ELSE feature END AS feature
        FROM issues""",
    "audit_outliers": """WITH v AS (SELECT 'n_chars' AS column_name, CAST(n_chars AS DOUBLE) AS x,
          quantile_cont(n_chars, 0.25) OVER () AS q1, quantile_cont(n_chars, 0.75) OVER () AS q3 FROM documents
        UNION ALL SELECT 'doc_id', CAST(doc_id AS DOUBLE), quantile_cont(doc_id, 0.25) OVER (), quantile_cont(doc_id, 0.75) OVER ()
          FROM documents)
        SELECT column_name, count(*) AS n, count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers,
          round(count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) * 100.0 / count(*), 6) AS outlier_pct
        FROM v GROUP BY 1""",
    "audit_leakage": f"WITH {DIRTY} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n, CASE WHEN min({c}) = max({c}) THEN NULL ELSE round(corr({c}, gross), 6) END AS r "
        f"FROM d WHERE {c} IS NOT NULL AND gross IS NOT NULL HAVING count(*) > 0"
        for c in ["o_orderkey", "o_custkey", "o_totalprice", "batch", "spare"]),
    "report_json": f"""{LOOSE_AUDIT}, sc AS ({SCORE.format(width=5)})
        SELECT concat('{{"overall_score":', overall_score, ',"healthy_checks":', healthy_checks, ',"warning_count":', warning_count,
          ',"critical_count":', critical_count, '}}') AS json FROM sc""",
    "report_issues": f"{LOOSE_AUDIT} SELECT rule_id, feature, severity, round(metric_value, 6) AS metric_value FROM issues",
    "correlation_matrix": f"WITH {LINES} {matrix_sql(LINE_NAMES)}",
    "correlation_gaps": f"WITH {DIRTY} {matrix_sql(['o_custkey', 'o_totalprice', 'gross', 'batch'])}",
    "top_correlations": f"""WITH {LINES}, q AS ({pairs_sql(LINE_NAMES)})
        SELECT c1, c2, r FROM q WHERE r IS NOT NULL ORDER BY abs(r) DESC, i, j LIMIT 3""",
    "insight_target_binary": """WITH g AS (SELECT quality, count(*) AS n, sum(count(*)) OVER () AS t FROM labels GROUP BY 1),
        r AS (SELECT *, row_number() OVER (ORDER BY n DESC, quality) AS i FROM g)
        SELECT CAST(max(CASE WHEN i = 1 THEN quality END) AS VARCHAR) AS majority_class,
          CAST(max(CASE WHEN i = 2 THEN quality END) AS VARCHAR) AS minority_class,
          round(max(CASE WHEN i = 1 THEN n * 100.0 / t END), 6) AS majority_pct,
          round(max(CASE WHEN i = 2 THEN n * 100.0 / t END), 6) AS minority_pct,
          round(max(CASE WHEN i = 1 THEN n * 100.0 / t END) / greatest(0.1, max(CASE WHEN i = 2 THEN n * 100.0 / t END)), 6) AS ratio,
          max(CASE WHEN i = 1 THEN n * 100.0 / t END) / greatest(0.1, max(CASE WHEN i = 2 THEN n * 100.0 / t END)) >= 2 AS imbalanced
        FROM r HAVING count(*) = 2""",
    "insight_target_numeric": """SELECT round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median,
        round(stddev_samp(o_totalprice), 4) AS std, round(skewness(o_totalprice), 4) AS skew,
        CASE WHEN skewness(o_totalprice) > 1 THEN 'right-skewed' WHEN skewness(o_totalprice) < -1 THEN 'left-skewed'
          ELSE 'symmetric' END AS shape FROM orders HAVING count(DISTINCT o_totalprice) > 10""",
    "insight_multicollinearity": f"""WITH {DIRTY},
        q AS ({pairs_sql(['o_orderkey', 'o_custkey', 'o_totalprice', 'batch', 'spare', 'gross'])}),
        k AS (SELECT * FROM q WHERE r IS NOT NULL ORDER BY abs(r) DESC, i, j LIMIT 3)
        SELECT c1, c2, r FROM k WHERE abs(r) >= 0.7""",
    "insight_skew": """SELECT 'n_chars' AS column_name, round(skewness(n_chars), 4) AS skew FROM documents
        HAVING abs(skewness(n_chars)) > 2 AND count(n_chars) > 10""",
    "insight_missing": f"""WITH {DIRTY} SELECT column_name, null_pct FROM ({DIRTY_PROFILE}) q WHERE null_pct > 0
        ORDER BY null_pct DESC LIMIT 3""",
    "insight_table": f"""WITH {DIRTY}, q AS ({pairs_sql(['o_orderkey', 'o_custkey', 'o_totalprice', 'batch', 'spare', 'gross'])}),
        k AS (SELECT * FROM q WHERE r IS NOT NULL ORDER BY abs(r) DESC, i, j LIMIT 3)
        SELECT 'Target' AS category, 'Continuous Target Profile' AS title, 'high' AS importance, 'gross' AS feature FROM d
          HAVING count(DISTINCT gross) > 10
        UNION ALL SELECT 'Correlation', 'Strong Multicollinearity', 'medium', concat(c1, ',', c2) FROM k WHERE abs(r) >= 0.7
        UNION ALL SELECT 'Missingness', 'Missing Values Present', 'info', 'spare' FROM d HAVING count(spare) = 0""",
    "histogram": """WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
        b AS (SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 35)), 34) AS INTEGER) AS bin FROM orders, m)
        SELECT CAST(k AS INTEGER) AS bin, count(b.bin) AS n FROM (SELECT unnest(range(35)) AS k) g LEFT JOIN b ON b.bin = g.k GROUP BY 1""",
    "class_frequency": "SELECT CAST(l_linenumber AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 1",
    "boxplot": """WITH v AS (SELECT CAST(n_chars AS DOUBLE) AS x, quantile_cont(n_chars, 0.25) OVER () AS q1,
          quantile_cont(n_chars, 0.5) OVER () AS q2, quantile_cont(n_chars, 0.75) OVER () AS q3 FROM documents),
        w AS (SELECT *, x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM v)
        SELECT round(max(q1), 6) AS q25, round(max(q2), 6) AS median, round(max(q3), 6) AS q75,
          round(min(CASE WHEN inside THEN x END), 6) AS whisker_lo, round(max(CASE WHEN inside THEN x END), 6) AS whisker_hi,
          count(*) FILTER (WHERE NOT inside) AS n_outliers FROM w""",
    "outlier_rows": """WITH v AS (SELECT doc_id, n_chars, quantile_cont(n_chars, 0.25) OVER () AS q1,
          quantile_cont(n_chars, 0.75) OVER () AS q3 FROM documents)
        SELECT doc_id, n_chars FROM v WHERE n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1)""",
    "top_categories": f"""WITH {DIRTY} SELECT coalesce(o_orderpriority, 'nan') AS value, count(*) AS n FROM d GROUP BY 1
        ORDER BY n DESC, value LIMIT 10""",
    "inspect_column": f"""SELECT column_name, n_distinct, min, max, mean, std, median, q25, q75, skew
        FROM ({profile_sql('part', ints=['p_size'])}) q""",
    "detect_problem": " UNION ALL ".join([
        detect_sql("orders", "o_orderstatus", "text"), detect_sql("orders", "o_totalprice", "number"),
        detect_sql("labels", "quality", "number"), detect_sql("lineitem", "l_linenumber", "number"),
        detect_sql("documents", "lang", "text"), detect_sql("events", "ts", "other")]),
    "class_distribution": """SELECT event_type AS value, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct
        FROM events GROUP BY 1""",
    "imbalance": """SELECT round((CAST(max(n) AS DOUBLE) / sum(n)) / greatest(0.00001, CAST(min(n) AS DOUBLE) / sum(n)), 2) AS imbalance_ratio,
        round((CAST(max(n) AS DOUBLE) / sum(n)) / greatest(0.00001, CAST(min(n) AS DOUBLE) / sum(n)), 2) >= 2 AS imbalanced
        FROM (SELECT toxic, count(*) AS n FROM labels GROUP BY 1) g""",
    "feature_plan": f"""SELECT column_name, CASE WHEN column_name = 'p_retailprice' OR is_constant OR semantic_type = 'id' THEN 'dropped'
          WHEN semantic_type = 'numerical' THEN 'numeric' WHEN n_distinct <= 25 THEN 'one_hot' ELSE 'ordinal' END AS role
        FROM ({profile_sql('part', ['p_partkey', 'p_size'], ['p_retailprice'], ['p_name', 'p_brand', 'p_type'])}) q""",
    "drop_null_target": f"""WITH {DIRTY} SELECT count(*) AS rows, round(sum(gross), 0) AS total FROM d WHERE o_totalprice IS NOT NULL""",
    "impute_median": f"""WITH {DIRTY} SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM d)), 6) AS value
        FROM d""",
    "scale_standard": f"""WITH {DIRTY}, i AS (SELECT o_orderkey, coalesce(o_totalprice, (SELECT median(o_totalprice) FROM d)) AS x FROM d)
        SELECT o_orderkey, round((x - (SELECT avg(x) FROM i)) / (SELECT stddev_pop(x) FROM i), 6) AS value FROM i""",
    "impute_mode": f"""WITH {DIRTY} SELECT 'o_orderstatus' AS column_name, (SELECT o_orderstatus FROM d WHERE o_orderstatus IS NOT NULL
          GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode
        UNION ALL SELECT 'o_orderpriority', (SELECT o_orderpriority FROM d WHERE o_orderpriority IS NOT NULL
          GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""",
    "one_hot": """SELECT c.c_custkey, concat('c_mktsegment_', s.level) AS feature,
        CAST(CASE WHEN c.c_mktsegment = s.level THEN 1 ELSE 0 END AS DOUBLE) AS value
        FROM customer c, (SELECT DISTINCT c_mktsegment AS level FROM customer) s""",
    "ordinal_encode": """SELECT p_partkey, dense_rank() OVER (ORDER BY p_name) - 1 AS code FROM part""",
    "label_encode": """SELECT CAST(v AS VARCHAR) AS value, row_number() OVER (ORDER BY v) - 1 AS code
        FROM (SELECT DISTINCT l_linenumber AS v FROM lineitem) u""",
    "class_weights": """SELECT o_orderstatus AS label, count(*) AS n,
        round(CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)), 6) AS weight FROM orders GROUP BY 1""",
    "leave_fold_out_stats": f"""WITH {FOLDED} SELECT column_name, fold, round(median, 4) AS median, round(mean, 4) AS mean,
        round(std, 4) AS std FROM ({left_out_sql('o_totalprice')} UNION ALL {left_out_sql('o_custkey')}) q""",
    "leave_fold_out_modes": """WITH f AS (SELECT lang, source, (row_number() OVER (
          ORDER BY md5(concat_ws('|', '42', CAST(doc_id AS VARCHAR))), doc_id) - 1) % 3 AS fold FROM documents),
        c AS (SELECT 'lang' AS column_name, k.j, lang AS v, count(*) AS n FROM f JOIN (SELECT unnest([0, 1, 2]) AS j) k ON fold <> k.j
            GROUP BY ALL
          UNION ALL SELECT 'source', k.j, source, count(*) FROM f JOIN (SELECT unnest([0, 1, 2]) AS j) k ON fold <> k.j GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY column_name, j ORDER BY n DESC, v) AS i FROM c)
        SELECT column_name, CAST(j AS INTEGER) AS fold, v AS mode, n FROM r WHERE i = 1""",
    "fold_safe_transform": f"""WITH {FOLDED}, st AS ({left_out_sql('o_totalprice')})
        SELECT f.o_orderkey, f.fold, round((coalesce(f.o_totalprice, st.median) - st.mean) / st.std, 6) AS value
        FROM f JOIN st ON f.fold = st.fold""",
    "kfold": """SELECT o_orderkey, CAST((row_number() OVER (
        ORDER BY md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR))), o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders""",
    "stratified_kfold": """SELECT doc_id, lang, CAST((row_number() OVER (PARTITION BY lang
        ORDER BY md5(concat_ws('|', '42', CAST(doc_id AS VARCHAR))), doc_id) - 1) % 5 AS INTEGER) AS fold FROM documents""",
    "metrics_binary": binary_sql(""),
    "metrics_binary_grouped": binary_sql("lang"),
    "metrics_multiclass": f"""WITH {THREE}, {OVR},
        pc AS (SELECT c, CAST(count(*) FILTER (WHERE label = c AND prediction = c) AS DOUBLE) AS tp,
          count(*) FILTER (WHERE prediction = c) AS pp, count(*) FILTER (WHERE label = c) AS sup
          FROM s, (SELECT unnest([0, 1, 2]) AS c) k GROUP BY c)
        SELECT round(sum(tp) / sum(sup), 6) AS accuracy, round(sum(coalesce(tp / nullif(pp, 0), 0) * sup) / sum(sup), 6) AS precision,
          round(sum(coalesce(tp / nullif(sup, 0), 0) * sup) / sum(sup), 6) AS recall,
          round(sum(coalesce(2 * tp / nullif(pp + sup, 0), 0) * sup) / sum(sup), 6) AS f1,
          (SELECT round(auc, 6) FROM auc) AS roc_auc,
          (SELECT round(avg(-ln(least(greatest(CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 2.220446049250313e-16),
            1 - 2.220446049250313e-16))), 6) FROM s) AS log_loss
        FROM pc""",
    "roc_auc": f"""WITH {BINARY}, r AS (SELECT *, rank() OVER (ORDER BY p) AS lo, count(*) OVER (ORDER BY p) AS hi FROM s),
        a AS (SELECT sum(CASE WHEN label = 1 THEN (lo + hi) / 2.0 ELSE 0 END) AS ranks, count(*) FILTER (WHERE label = 1) AS positives,
          count(*) FILTER (WHERE label = 0) AS negatives FROM r)
        SELECT round((ranks - CAST(positives AS DOUBLE) * (positives + 1) / 2) / (CAST(positives AS DOUBLE) * negatives), 6) AS auc,
          positives, negatives FROM a""",
    "roc_auc_ovr": f"WITH {THREE}, {OVR} SELECT round(auc, 6) AS auc, classes FROM auc",
    "log_loss": f"""WITH {BINARY} SELECT round(avg(-ln(least(greatest(CASE WHEN label = 1 THEN p ELSE 1 - p END,
        2.220446049250313e-16), 1 - 2.220446049250313e-16))), 6) AS log_loss FROM s""",
    "confusion_matrix": f"""WITH {THREE}, c AS (SELECT label AS v FROM s UNION SELECT prediction FROM s)
        SELECT CAST(a.v AS DOUBLE) AS label, CAST(b.v AS DOUBLE) AS prediction, count(s.label) AS n FROM c a CROSS JOIN c b
        LEFT JOIN s ON s.label = a.v AND s.prediction = b.v GROUP BY 1, 2""",
    "metrics_regression": """WITH s AS (SELECT l_returnflag, l_extendedprice AS y, l_extendedprice - l_quantity * 2000 AS e FROM lineitem)
        SELECT l_returnflag, round(avg(abs(e)), 4) AS mae, round(avg(e * e), 1) AS mse, round(sqrt(avg(e * e)), 4) AS rmse,
          round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2, round(1 - var_pop(e) / var_pop(y), 6) AS explained_variance,
          round(avg(abs(e) / greatest(abs(y), 2.220446049250313e-16)), 6) AS mape FROM s GROUP BY 1""",
    "cv_summary": f"""WITH {FOLD_METRICS} SELECT model_id, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
        count(*) AS folds FROM fm GROUP BY 1, 2""",
    "leaderboard": f"""WITH {FOLD_METRICS}, a AS (SELECT model_id, avg(rmse) AS cv_mean, stddev_pop(rmse) AS cv_std, avg(r2) AS r2 FROM g
          GROUP BY 1)
        SELECT model_id, round(cv_mean, 6) AS cv_mean, round(cv_std, 6) AS cv_std, round(r2, 6) AS r2, round(cv_mean, 6) AS rmse,
          row_number() OVER (ORDER BY cv_mean, model_id) AS rank FROM a""",
    "fold_table": f"WITH {FOLD_METRICS} SELECT model_id, fold, round(r2, 6) AS r2, round(rmse, 6) AS rmse FROM g",
    "trial_best_curve": f"""WITH {TRIALS} SELECT trial, round(score, 6) AS score,
        round(min(score) OVER (ORDER BY trial), 6) AS running_best, CAST(0.1 AS DOUBLE) AS baseline,
        round(min(score) OVER (), 6) AS best, round(-(score - 0.1), 6) AS delta FROM t""",
    "best_trial": f"""WITH {TRIALS} SELECT trial, round(score, 6) AS score, CAST(trial AS VARCHAR) AS line FROM t
        ORDER BY t.score DESC, trial LIMIT 1""",
    "linear_shap": f"""WITH {LINE_SHAP} SELECT l_orderkey, l_linenumber, feature, round(value, 6) AS value, round(phi, 6) AS phi FROM s""",
    "global_importance": f"WITH {LINE_SHAP} SELECT feature, round(avg(abs(phi)), 5) AS importance FROM s GROUP BY 1",
    "local_top_contributions": f"""WITH {PART_SHAP} SELECT p_partkey, feature, round(phi, 6) AS phi, CAST(rank AS INTEGER) AS rank,
        CASE WHEN phi >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM r WHERE rank <= 2""",
    "row_explanations": f"""WITH {PART_SHAP} SELECT p_partkey, p_brand, string_agg(feature, ',' ORDER BY rank) AS features,
        string_agg(CASE WHEN phi >= 0 THEN 'positive' ELSE 'negative' END, ',' ORDER BY rank) AS directions
        FROM r JOIN part USING (p_partkey) WHERE rank <= 2 GROUP BY 1, 2""",
    "sampled_class_additivity": "SELECT count(*) * count(DISTINCT c_mktsegment) AS sets, 0 AS off FROM customer",
    "feature_schema_table": """WITH u AS (SELECT 'p_type' AS name, p_type AS v FROM part UNION SELECT 'p_name', p_name FROM part),
        r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY v) AS i FROM u)
        SELECT name, false AS is_numerical, min(v) AS sample_value, string_agg(v, '|' ORDER BY v) AS unique_values FROM r
          WHERE i <= 20 GROUP BY 1
        UNION ALL SELECT 'p_size', true, CAST(min(p_size) AS VARCHAR), NULL FROM part
        UNION ALL SELECT 'p_retailprice', true, CAST(min(p_retailprice) AS VARCHAR), NULL FROM part""",
    "run_history": """SELECT CAST(o_orderkey AS VARCHAR) AS run_id, 'FINISHED' AS status, strftime(o_orderdate, '%Y-%m-%d') AS started,
        concat('run-', o_custkey) AS run_name, o_orderpriority AS param_priority, o_totalprice AS metric_total
        FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW'
        ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 50""",
    "run_cleaning": """SELECT doc_id, substr(text, 1, 250) AS text, CAST(n_chars AS DOUBLE) AS size, CAST(1 AS BIGINT) AS n_metrics
        FROM documents""",
    "csv_roundtrip": """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer""",
    "csv_text_roundtrip": r"""SELECT doc_id, sha256('"' || regexp_replace(text, '[.] ', '.' || chr(10), 'g')) AS text_sha256, lang, source FROM documents""",
    "csv_dialects": """SELECT c_custkey, c_name || ' é' AS c_name, c_acctbal, CASE WHEN c_custkey % 3 > 0 THEN '日本' END AS place FROM customer""",
    "csv_headers": """SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, 'o_orderkey,o_totalprice' AS names, 'UTF-8' AS encoding,
        '|' AS delimiter FROM orders""",
    "type_inference": f"WITH {DIRTY} SELECT o_orderkey, o_totalprice, o_orderpriority, spare FROM d",
    "row_cap": "SELECT least(count(*), 100) AS rows, least(count(*), 100) AS known FROM orders",
    "tune_curve": "SELECT range + 1 AS trial, true AS ok FROM range(15)",
    "cv_sizes": """SELECT m.model_id, 5 AS folds, (SELECT count(*) FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL) AS held, 0 AS uneven
        FROM (VALUES ('logistic_regression'), ('random_forest'), ('gradient_boosting'), ('gbt_subsampled')) m(model_id)""",
    "stream_reload": """SELECT count(DISTINCT doc_id) AS rows, 0 AS uneven, 0 AS off, least(2, count(*)) AS versions FROM documents JOIN labels USING (doc_id)""",
    "tree_additivity": "SELECT 2 * count(DISTINCT doc_id) AS sets, 0 AS off FROM documents JOIN labels USING (doc_id)",
    "sampled_additivity": "SELECT count(DISTINCT doc_id) AS sets, 0 AS off FROM documents JOIN labels USING (doc_id)",
    "score_consistency": "SELECT count(*) AS rows, 0 AS uneven, 0 AS unlikely FROM documents JOIN labels USING (doc_id)",
    "stream_equals_batch": "SELECT count(*) AS rows, 0 AS different FROM documents JOIN labels USING (doc_id)",
}
