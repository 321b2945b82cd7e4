"""Problem detection, preprocessing, models, search, explanation, scoring, sources, end to end."""

import json
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from tabwright.operators import cv, explain, models, problem, search
from tabwright.operators import features as feat
from tabwright.operators import metrics as met
from tabwright.operators.folds import FOLD
from tabwright.operators.profile import Profile
from tabwright.operators.score import feature_schema, score, score_records
from tabwright.plans.pipeline import STEPS, run
from tabwright.sources import delimited, reports, runlog
from tabwright.sources.bundle import load_bundle
from tabwright.streaming.scoring import read_records, score_stream


@pytest.fixture(scope="module")
def binary(spark):
    rng = np.random.default_rng(1)
    n = 240
    a, b = rng.normal(size=n), rng.exponential(size=n)
    c = rng.choice(["red", "green", "blue"], n)
    y = np.where(a + (c == "red") + rng.normal(scale=0.5, size=n) > 0.6, "yes", "no")
    rows = [(i, float(a[i]) if i % 11 else None, float(b[i]), str(c[i]), str(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "key long, a double, b double, c string, y string").cache()


@pytest.fixture(scope="module")
def prepared(binary):
    p = problem.detect(binary, "y")
    plan = feat.plan_features(Profile(binary), "y", ["key"])
    return p, plan


def test_detection(spark):
    def of(values, kind):
        return problem.detect(spark.createDataFrame([(v,) for v in values], f"t {kind}"), "t")

    text = of(["churn", "stay"] * 50, "string")
    assert text.problem_type == problem.BINARY and text.stratified and text.classes == ["churn", "stay"]
    skewed = of([0] * 85 + [1] * 15, "long")
    assert (skewed.imbalance_ratio, skewed.primary_metric) == (5.67, "f1")
    assert of([float(i) * 1.1 for i in range(100)], "double").problem_type == problem.REGRESSION
    assert of([i % 20 for i in range(201)], "long").problem_type == problem.MULTICLASS  # share just below 0.10
    assert of([i % 20 for i in range(200)], "long").problem_type == problem.REGRESSION  # share of exactly 0.10
    assert of([i % 21 for i in range(500)], "long").problem_type == problem.REGRESSION
    assert of([1, 2, 10] * 40, "long").classes == ["1", "2", "10"]
    with pytest.raises(ValueError):
        of([f"t{i % 21}" for i in range(100)], "string")


def test_datetime_target_is_regression(spark):
    base = spark.range(40).select("id", F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    df = base.withColumns({"at": F.col("day").cast("timestamp"), "plain": F.col("day").cast("timestamp_ntz")})
    for target, unit in (("day", 1), ("at", 86_400_000_000), ("plain", 86_400_000_000)):
        found = problem.detect(df, target)
        assert not found.is_classification
        label = [r["label"] for r in problem.encode_label(df, found).orderBy("id").collect()]
        assert label[39] - label[0] == 39 * unit


def test_preprocessing_survives_unseen_and_missing(spark):
    train = spark.createDataFrame(
        [(1.0, "A", "i1", 0), (2.0, "B", "i2", 1), (None, "A", "i3", 0), (10.0, None, "i4", 1)],
        "num1 double, cat1 string, id_col string, target long")
    test = spark.createDataFrame([(None, "new"), (3.0, None)], "num1 double, cat1 string")
    plan = feat.FeaturePlan(numeric=["num1"], one_hot=["cat1"], ordinal=[])
    enc = feat.fit(train, plan)
    assert enc.names == ["num1", "cat1_A", "cat1_B"] and enc.numeric["num1"].median == 2.0
    rows = [r["v"] for r in feat.transform(test, enc).select(vector_to_array("features").alias("v")).collect()]
    filled = np.array([1.0, 2.0, 2.0, 10.0])
    assert rows[0] == pytest.approx([(2.0 - filled.mean()) / filled.std(), 0.0, 0.0])
    assert rows[1][1:] == [1.0, 0.0]
    with pytest.raises(ValueError, match="cat1"):
        feat.transform(test.drop("cat1"), enc)


def test_encoder_split_edge(spark):
    df = spark.range(600).select(
        (F.col("id") % 25).cast("string").alias("c25"), (F.col("id") % 26).cast("string").alias("c26"), "id", F.lit(1).alias("k"))
    plan = feat.plan_features(Profile(df), "id")
    assert plan.one_hot == ["c25"] and plan.ordinal == ["c26"] and plan.dropped["k"] == "constant"


def test_statistics_leave_the_fold_out(binary, prepared):
    p, plan = prepared
    data = cv.fold_data(binary, p, plan, 3, ["key"])
    pdf = data.rows.toPandas()
    for j, enc in enumerate(data.encodings):
        x = pdf.loc[pdf[FOLD] != j, "a"]
        filled = x.fillna(x.median())
        s = enc.numeric["a"]
        assert (s.median, s.mean, s.std) == pytest.approx((x.median(), filled.mean(), filled.std(ddof=0)), rel=1e-9)
    sizes = pdf.groupby(["label", FOLD]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1)).max() <= 1
    w = data.weights(0)
    kept = pdf[pdf[FOLD] != 0]["label"]
    assert w[1.0] == pytest.approx(len(kept) / (2 * (kept == 1).sum()))


def test_category_only_in_validation_fold(spark):
    df = spark.createDataFrame([(0, "rare"), (1, "x"), (2, "x"), (1, "y"), (2, "y")], "fold int, c string")
    enc = feat.fit_folds(df, feat.FeaturePlan(one_hot=["c"]), 3)
    assert enc[0].levels["c"] == ["x", "y"] and enc[1].levels["c"] == ["rare", "x", "y"]
    assert enc[0].modes["c"] == "x"


def test_ridge_and_logistic_closed_forms(spark):
    rng = np.random.default_rng(2)
    x, noise = rng.normal(size=(300, 2)), rng.normal(size=300)
    y = x @ [2.0, -1.0] + 3 + noise
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], "a double, b double, y double")
    p = problem.detect(df, "y")
    plan = feat.FeaturePlan(numeric=["a", "b"])
    model = cv.fit_full(df, p, plan, models.candidates(p)[0], {"alpha": 50.0}).stages[1]
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + 50.0 * np.eye(2), z.T @ (y - y.mean()))
    assert model.coefficients.toArray() == pytest.approx(want, rel=1e-6)

    label = (y > 3).astype(int)
    dfc = spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(x, label)], "a double, b double, y long")
    pc = problem.detect(dfc, "y")
    fitted = cv.fit_full(dfc, pc, plan, models.candidates(pc)[0], {"C": 0.1}).stages[1]
    w, b = fitted.coefficients.toArray(), fitted.intercept
    weight = np.where(label == 1, len(label) / (2 * label.sum()), len(label) / (2 * (1 - label).sum()))
    prob = 1 / (1 + np.exp(-(z @ w + b)))
    # gradient of the penalised loss with C = 0.1 vanishes at the optimum
    assert np.abs(0.1 * z.T @ (weight * (prob - label)) + w).max() < 1e-3
    assert abs((weight * (prob - label)).sum()) < 1e-3


def test_benchmark_and_leaderboard(binary, prepared):
    p, plan = prepared
    found = models.candidates(p, models.FAST)
    result = cv.cross_validate(cv.fold_data(binary, p, plan, 3, ["key"]), found)
    board = cv.leaderboard(result, p.primary_metric, ["accuracy", "f1", "roc_auc"], [m.model_id for m in found]).orderBy("rank").collect()
    assert len(board) == 4 and board[0]["cv_mean"] > 0.6
    assert result.select("fold").distinct().count() == 3
    assert cv.fold_table(result, ["f1"]).count() == 12
    assert cv.cv_summary(result).where("folds = 3").count() == 24


def test_leaderboard_ties_follow_candidate_order(spark):
    rows = [(m, f, "rmse", 1.0) for m in ("b", "a") for f in (0, 1)]
    table = spark.createDataFrame(rows, "model_id string, fold int, metric string, value double")
    assert cv.leaderboard(table, "rmse", ["rmse"], ["b", "a"]).where("rank = 1").first()["model_id"] == "b"


def test_multiclass_boosting_has_probabilities(spark):
    rows = [(float(i % 3) + (i % 7) / 10, i % 3 + 1) for i in range(90)]
    df = spark.createDataFrame(rows, "a double, t long")
    p = problem.detect(df, "t")
    fitted = cv.fit_full(df, p, feat.FeaturePlan(numeric=["a"]), models.candidates(p, models.FAST)[2], {})
    labelled = problem.encode_label(df, p)
    pred = models.predictions(fitted.stages[1], fitted.stages[0].transform(labelled), p)
    sums = pred.select(F.aggregate("probs", F.lit(0.0), lambda a, b: a + b).alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in sums)
    assert met.classification_metrics(pred.select("label", "prediction", "probs"), 3).first()["accuracy"] > 0.9


def test_metric_edges(spark):
    one = spark.createDataFrame([(1.0, 1.0, [0.2, 0.8])] * 3, "label double, prediction double, probs array<double>")
    row = met.classification_metrics(one, 2).first()
    assert row["undefined"] and row["roc_auc"] == 0.5 and row["log_loss"] == 0.0
    missed = spark.createDataFrame([(1.0, 0.0, [0.9, 0.1]), (0.0, 0.0, [0.9, 0.1])], one.schema)
    row = met.classification_metrics(missed, 2).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)
    flat = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0)], "label double, prediction double")
    assert met.regression_metrics(flat).first()["r2"] == 0.0
    assert met.primary_of({"f1": 0.4, "accuracy": 0.9}, "f1_weighted", True) == ("f1_weighted", 0.4)
    assert met.primary_of({"rmse": 2.0}, None, False) == ("rmse", 2.0)


def test_search_space_and_proposals():
    import random

    rng = random.Random(0)
    space = {"lr": ("log", 0.01, 0.2), "n": ("int", 50, 150, 25), "s": ("uniform", 0.6, 1.0), "k": ("choice", ["a", "b"])}
    history = []
    for _ in range(30):
        p = search.propose(space, history, rng, True)
        assert 0.01 <= p["lr"] <= 0.2 and p["n"] in (50, 75, 100, 125, 150) and 0.6 <= p["s"] <= 1.0 and p["k"] in "ab"
        history.append((p, -abs(math.log(p["lr"] / 0.05))))
    late = [abs(math.log(h[0]["lr"] / 0.05)) for h in history[15:]]
    early = [abs(math.log(h[0]["lr"] / 0.05)) for h in history[:10]]
    assert np.mean(late) < np.mean(early)


def test_tuning_keeps_the_better(binary, prepared):
    p, plan = prepared
    out = search.tune(cv.fold_data(binary, p, plan, 3, ["key"]), models.candidates(p, models.FAST)[1], p.primary_metric, n_trials=4)
    assert out.trials.count() == 4 and out.best_score >= out.baseline and out.delta >= 0
    assert out.summary().count() == 1
    curve = search.trial_curve(out.trials, True, out.baseline).orderBy("trial").collect()
    assert [r["running_best"] for r in curve] == sorted(r["running_best"] for r in curve)


def exact_shapley(tables, x):
    """Brute force over all feature subsets of the leaf game."""
    from itertools import combinations

    m, c = len(x), tables[0].values.shape[1]

    def game(s):
        total = np.zeros(c)
        for t in tables:
            inside = (x[t.feature] > t.lo) & (x[t.feature] <= t.hi)
            share = np.where(np.isin(t.feature, list(s)), inside, t.z)
            total += (share.prod(axis=1)[:, None] * t.values).sum(axis=0)
        return total

    phi = np.zeros((c, m))
    for j in range(m):
        others = [i for i in range(m) if i != j]
        for size in range(m):
            w = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
            for s in combinations(others, size):
                phi[:, j] += w * (game({*s, j}) - game(set(s)))
    return phi


@pytest.mark.parametrize("index", [1, 2])
def test_tree_shap_is_exact_and_additive(spark, binary, prepared, index):
    p, plan = prepared
    fitted = cv.fit_full(binary, p, plan, models.candidates(p, models.FAST)[index], {})
    encoder, model = fitted.stages
    encoded = encoder.transform(binary)
    names = encoder.encoding.names
    phi = explain.tree_shap(encoded, ["key"], model, names)
    sums = phi.groupBy("key", "class").agg((F.sum("phi") + F.first("base")).alias("total"))
    scored = model.transform(encoded)
    if index == 1:
        out = scored.select("key", F.posexplode(vector_to_array("probability")).alias("class", "out"))
    else:
        out = scored.select("key", F.lit(1).alias("class"), vector_to_array("rawPrediction")[1].alias("out"))
    worst = sums.join(out, ["key", "class"]).agg(F.max(F.abs(F.col("total") - F.col("out"))), F.count("*")).first()
    assert worst[0] < 1e-9 and worst[1] == (480 if index == 1 else 240)
    tables, _ = explain.read_trees(spark, model)
    x = np.array(encoded.orderBy("key").select(vector_to_array("features").alias("v")).first()["v"])
    assert explain.leaf_attributions(x[None], tables)[0] == pytest.approx(exact_shapley(tables, x), abs=1e-9)


def test_linear_and_sampled_shap_agree(binary, prepared):
    p, plan = prepared
    fitted = cv.fit_full(binary, p, plan, models.candidates(p)[0], {})
    encoder, model = fitted.stages
    encoded = encoder.transform(binary)
    kind, phi = explain.explain(encoded, ["key"], model, encoder.encoding.names, True)
    assert kind == "linear"
    total = phi.groupBy("key").agg((F.sum("phi") + F.first("base")).alias("t"))
    raw = model.transform(encoded).select("key", vector_to_array("rawPrediction")[1].alias("r"))
    assert total.join(raw, "key").agg(F.max(F.abs(F.col("t") - F.col("r")))).first()[0] < 1e-9
    few = encoded.where("key < 3")
    walks = explain.sampled_shap(few, ["key"], model, encoder.encoding.names, True, explain.background(encoded, n=2), 2)
    assert walks.count() == 3 * len(encoder.encoding.names)
    top = explain.local_contributions(phi, ["key"]).where("rank = 1")
    assert top.count() == 240
    shown = explain.with_original(phi, binary, ["key"], plan.inputs)
    assert {r["original"] for r in shown.where("feature = 'c_red'").collect()} == {"Encoded"}
    assert explain.model_importance(binary.sparkSession, model, encoder.encoding.names).count() == len(encoder.encoding.names)


def test_delimited_sources(spark, tmp_path):
    def put(name, data):
        path = tmp_path / name
        path.write_bytes(data if isinstance(data, bytes) else data.encode())
        return str(path)

    df = delimited.read_delimited(spark, put("a.csv", "col1,col2,target\n1,A,0\n2,B,1\n3,C,0\n"))
    assert df.dtypes == [("col1", "bigint"), ("col2", "string"), ("target", "bigint")] and df.count() == 3
    for sep in "\t;|":
        df = delimited.read_delimited(spark, put(f"s{ord(sep)}.csv", f"colA{sep}colB\n1{sep}x\n2{sep}y\n"))
        assert df.columns == ["colA", "colB"]
    for name, data in (("e.csv", ""), ("w.csv", "  \n \n"), ("h.csv", "a,b\n")):
        with pytest.raises(ValueError, match="empty|no rows"):
            delimited.read_delimited(spark, put(name, data))
    with pytest.raises(ValueError, match="exist"):
        delimited.read_delimited(spark, str(tmp_path / "none.csv"))
    df = delimited.read_delimited(spark, put("l.csv", "name,v\nMüller,1\nÉtage,2\n".encode("latin-1")))
    assert [r["name"] for r in df.collect()] == ["Müller", "Étage"]
    text = " a ,b,c,d,e,f,\n1,NA,yes,true,1d,2.5,\n,null,no,False,2,1e3,\n3,7,No,TRUE,3,nan,\n"
    df = delimited.read_delimited(spark, put("t.csv", text))
    assert df.dtypes == [("a", "bigint"), ("b", "bigint"), ("c", "string"), ("d", "boolean"), ("e", "string"), ("f", "double")]
    assert df.where("a is null").count() == 1 and df.where("f is null").count() == 1
    broken = put("q.csv", 'a,b\n1,"two\nlines, ""so"""\n2,"x"\n5,7" pipe\n')
    for multiline in (False, True):
        df = delimited.read_delimited(spark, broken, multiline=multiline)
        assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, 'two\nlines, "so"'), (2, "x"), (5, '7" pipe')]
    fine = put("u.csv", 'a,b\n1,"x, ""y"""\n"2",""\n3,7" pipe\n')
    assert delimited.read_delimited(spark, fine).where("a is not null").count() == 3
    same = delimited.read_delimited(spark, put("d.csv", "a, a\n1,2\n3,4\n"))
    assert same.columns == ["a", "a"]
    assert delimited.read_delimited(spark, put("r.csv", "a,b\n1,2\n3,4\n"), max_rows=1).count() == 1


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "runs")
    runlog.log_run(spark, path, "first", {"p": "x" * 300, "d": {"a": 1}}, {"m": 1, "bad": "abc"}, {"t": 1}, {"r": [1]})
    runlog.log_run(spark, path, "second", {"q": 2}, {"m": "2.5"})
    rows = runlog.run_history(runlog.read_runs(spark, path)).collect()
    assert [r["Run Name"] for r in rows] == ["second", "first"]
    assert len(rows[1]["param_p"]) == 250 and rows[0]["metric_m"] == 2.5 and "metric_bad" not in rows[0].asDict()
    assert len(runlog.run_history(runlog.read_runs(spark, path), max_runs=1).collect()) == 1


def test_end_to_end_and_scoring(spark, binary, tmp_path):
    out = run(binary, "y", str(tmp_path / "art"), ["key"], trials=2, folds=3, preset=models.FAST)
    steps = out.step_table(spark).collect()
    assert [r["step"] for r in steps] == STEPS and {r["status"] for r in steps} == {"completed"}
    keys = [r["key"] for r in out.attributions.select("key").distinct().collect()]
    assert len(keys) == binary.where("y is not null").count()  # every row is explained
    assert out.importance.count() > 0 and out.run_id
    bundle = load_bundle(spark, str(tmp_path / "art" / "bundle"))
    scored = score(binary, bundle)
    rows = scored.collect()
    assert {r["predicted_y"] for r in rows} == {"yes", "no"}
    assert all(abs(sum(r["probabilities"].values()) - 1) < 1e-9 for r in rows)
    assert all((r["probability"] > 0.5) == (r["predicted_y"] == "yes") for r in rows if abs(r["probability"] - 0.5) > 1e-9)
    agree = np.mean([r["predicted_y"] == r["y"] for r in rows])
    assert agree > 0.7  # labels are decoded with the right names
    one = score_records(spark, bundle, [{"a": 3, "b": 0.1, "c": "red"}, {"a": -3.0, "b": 0.1, "c": "unseen"}]).collect()
    assert [r["predicted_y"] for r in one] == ["yes", "no"]
    with pytest.raises(ValueError, match="no records"):
        score_records(spark, bundle, [])
    with pytest.raises(ValueError, match="b"):
        score_records(spark, bundle, [{"a": 1.0, "c": "red"}])
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    binary.write.parquet(source)
    score_stream(read_records(spark, source, binary.schema), bundle, sink, str(tmp_path / "state")).awaitTermination()
    streamed = {(r["key"], r["predicted_y"]) for r in spark.read.parquet(sink).collect()}
    assert streamed == {(r["key"], r["predicted_y"]) for r in rows}
    delimited.write_predictions(scored, str(tmp_path / "pred"))
    assert delimited.read_delimited(spark, str(tmp_path / "pred")).count() == 240
    assert bundle.card(spark).first()["target"] == "y" and bundle.schema_table(spark).count() == 3
    history = runlog.run_history(runlog.read_runs(spark, str(tmp_path / "art" / "runs"))).first()
    assert history["param_target"] == "y" and history["metric_tuned_best_score"] >= history["metric_baseline_score"] - 1e-12


def test_registered_run_is_of_full_size(spark, tmp_path, monkeypatch):
    """The registered run benchmarks full-size models on all folds and searches past the random trials."""
    from tabwright.plans import queries

    spark.range(60).selectExpr("id AS p_partkey", "double(id * 37 % 101) AS p_retailprice", "double(id % 7) AS size").write.parquet(str(tmp_path / "part.parquet"))
    known, jobs_of, propose = [], [], search.propose

    def scored(data, fold, jobs, seed, parallelism=4):  # the fits are left out
        jobs_of.extend((name, fold, candidate, params) for name, candidate, params in jobs)
        return [(name, candidate.name, fold, "rmse", 1.0 + len(name) + len(params), *data.sizes(fold), 0.0) for name, candidate, params in jobs]

    monkeypatch.setattr(search, "propose", lambda space, history, *a: known.append(len(history)) or propose(space, history, *a))
    monkeypatch.setattr(cv, "evaluate_fold", scored)
    steps = queries.pipeline_run(spark, str(tmp_path)).collect()
    assert [r["step"] for r in steps] == STEPS and {r["status"] for r in steps} == {"completed"}
    assert len(known) == search.TRIALS and sum(n >= search.STARTUP_TRIALS for n in known) == 5
    benchmarked = [(name, fold) for name, fold, candidate, _ in jobs_of if name == candidate.model_id]
    assert len(set(benchmarked)) == len(benchmarked) == 20  # four models, five folds
    facts = models.TrainingFacts(48)
    forest, boosted = (next(c for _, _, c, _ in jobs_of if c.model_id == name).build({}, 0, facts) for name in ("random_forest_regressor", "gradient_boosting_regressor"))
    assert (forest.getNumTrees(), forest.getMaxDepth(), boosted.rounds) == (100, 12, 100)


def test_failed_step_is_marked(spark):
    from tabwright.plans.pipeline import Run

    state, told = Run("t"), []
    with pytest.raises(ValueError, match="Minimum"):
        run(spark.range(5).select("id", F.col("id").alias("t")), "t", state=state, step_callback=lambda *x: told.append(x))
    assert state.status["validation"][0] == "failed" and state.status["validation"][2] and state.status["profiling"][0] == "pending"
    assert told == [("validation", "running"), ("validation", "failed")]


def test_reports(spark):
    from tabwright.operators import audit as aud

    df = spark.range(60).select("id", F.lit(1).alias("k"))
    issues = aud.audit(df, Profile(df))
    doc = json.loads(reports.audit_report(issues, aud.audit_score(issues, 2)).first()["report"])
    assert doc["critical_count"] == 1 and doc["issues"][0]["rule_id"] == "ZERO_VARIANCE"
    schema = feature_schema(df.withColumn("s", F.lit("x")), feat.FeaturePlan(numeric=["id"], one_hot=["s"])).collect()
    assert {r["name"]: r["unique_values"] for r in schema} == {"id": None, "s": ["x"]}


def test_tree_attributions_are_worked_out_once_per_cell(spark, monkeypatch):
    rng = np.random.default_rng(2)
    lo, hi = np.where(rng.random((30, 3)) < 0.4, -np.inf, 0.25), np.where(rng.random((30, 3)) < 0.4, np.inf, 0.75)
    leaves = [explain.LeafTable(np.tile([2, 0, 1], (30, 1)), lo, hi, rng.random((30, 3)), rng.normal(size=(30, 2)))]
    x = np.round(rng.uniform(-1, 2, (500, 3)), 2)
    x[:9] = [[np.nan, 0.25, 0.75], [-np.inf, np.inf, 0.5], [0.25, 0.75, np.nan]] * 3
    want, seen = explain.leaf_attributions(x, leaves), []
    real = explain.leaf_attributions
    monkeypatch.setattr(explain, "leaf_attributions", lambda part, tables: seen.append(len(part)) or real(part, tables))
    for cap in (10, 4_000_000):
        seen.clear()
        monkeypatch.setattr(explain, "KNOWN_CELLS", cap)
        found = explain.CellAttributions(leaves, 3)
        assert np.array_equal(np.concatenate([found(x[:200]), found(x[200:])]), want)
        assert sum(seen) <= 125 * (2 if cap == 10 else 1)


def test_costly_attributions_are_dealt_over_all_cores(spark):
    rows = spark.range(40).coalesce(1).select("id", array_to_vector(F.array(F.col("id").cast("double"), F.lit(1.0))).alias("features"))
    model = LinearRegression(labelCol="id", regParam=0.1).fit(rows)
    phi = explain.sampled_shap(rows, ["id"], model, ["a", "b"], False, [[0.0, 0.0]])
    assert "REPARTITION_BY_NUM" in phi._jdf.queryExecution().executedPlan().toString()
    forest = RandomForestRegressor(labelCol="id", numTrees=2, maxDepth=2).fit(rows)
    assert "REPARTITION_BY_NUM" in explain.tree_shap(rows, ["id"], forest, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
