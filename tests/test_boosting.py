import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabwright.operators import explain
from tabwright.operators.boosting import HistBoosting, HistBoostingModel
from tabwright.operators.models import candidates
from tabwright.operators.problem import MULTICLASS, Problem


def table(spark, x, y):
    df = spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y))], "k bigint, x array<double>, label double")
    return df.withColumn("features", array_to_vector("x")).repartition(3)


def data(n=400, seed=1):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.normal(size=n), r.integers(0, 4, n).astype(float), r.uniform(size=n), np.full(n, 2.0)])
    return x, x[:, 0] + np.where(x[:, 1] > 1, 2.0, -1.0), r


def best_stump(x, g, h, l2, least):
    """Every cut between two different values, by the closed form."""
    worth = lambda a, b: a * a / (b + l2)
    best = None
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) >= least:
                gain = worth(g[left].sum(), h[left].sum()) + worth(g[~left].sum(), h[~left].sum()) - worth(g.sum(), h.sum())
                if best is None or gain > best[0] + 1e-9:
                    best = gain, f, cut, -g[left].sum() / (h[left].sum() + l2), -g[~left].sum() / (h[~left].sum() + l2)
    return best


@pytest.mark.parametrize("classes, l2", [(0, 0.0), (0, 7.0), (2, 0.0), (2, 3.0), (3, 1.5)])
def test_one_cut_is_the_closed_form(spark, classes, l2):
    x, value, r = data(120)  # few enough values for a bin each
    y = value if classes == 0 else np.digitize(value, np.quantile(value, np.arange(1, classes) / classes)).astype(float)
    model = HistBoosting(classes, rounds=1, learning_rate=0.5, max_depth=1, l2=l2, min_rows=10).fit(table(spark, x, y))
    if classes == 0:
        base = np.full((120, 1), y.mean())
        g, h = base - y[:, None], np.ones((120, 1))
    else:
        share = np.array([(y == k).mean() for k in range(classes)])
        p = np.full((120, 1), share[1]) if classes == 2 else np.tile(share, (120, 1))
        g = p - (y[:, None] if classes == 2 else y[:, None] == np.arange(classes))
        h, base = p * (1 - p), (np.log(p / (1 - p)) if classes == 2 else np.log(p))
    want = base.copy()
    for k in range(g.shape[1]):
        _, f, cut, left, right = best_stump(x, g[:, k], h[:, k], l2, 10)
        want[:, k] += 0.5 * np.where(x[:, f] <= cut, left, right)
    assert np.allclose(model.margins(x), want)


def test_rounds_lower_the_loss_and_survive_saving(spark, tmp_path):
    x, value, r = data()
    y = np.digitize(value, [-0.5, 1.0]).astype(float)
    df = table(spark, x, y)
    loss = []
    for rounds in (1, 4, 23):
        model = HistBoosting(3, rounds=rounds, max_depth=3, l2=0.1).fit(df)
        scored = model.transform(df)
        rows = scored.select("label", "prediction", vector_to_array("probability").alias("p")).collect()
        assert all(abs(sum(q["p"]) - 1) < 1e-9 and q["prediction"] == np.argmax(q["p"]) for q in rows)
        loss.append(-np.mean([np.log(q["p"][int(q["label"])]) for q in rows]))
        assert len(model.trees) == rounds and all(len(t) == 3 for t in model.trees)
    assert loss[0] > loss[1] > loss[2] and np.mean([q["label"] == q["prediction"] for q in rows]) > 0.95
    strong = HistBoosting(3, rounds=4, max_depth=3, l2=1e6).fit(df)
    assert np.abs(strong.margins(x) - strong.base).max() < 0.01  # a large penalty keeps the base
    PipelineModel([model]).write().overwrite().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m")).stages[0]
    assert isinstance(back, HistBoostingModel) and np.array_equal(back.margins(x), model.margins(x))
    few = df.limit(25)
    kind, phi = explain.explain(few, ["k"], model, list("abcd"), True)
    sums = {(q["k"], q["class"]): q["s"] for q in phi.groupBy("k", "class").agg((F.sum("phi") + F.first("base")).alias("s")).collect()}
    margins = {q["k"]: q["m"] for q in model.transform(few).select("k", vector_to_array("rawPrediction").alias("m")).collect()}
    assert kind == "tree" and len(sums) == 75
    assert all(abs(s - margins[k][c]) < 1e-9 for (k, c), s in sums.items())


def test_the_second_boosting_round_starts_where_the_first_ended(spark):
    x, y, _ = data()
    df = table(spark, x, y)
    deep = HistBoosting(rounds=12, learning_rate=0.3, max_depth=2, min_rows=5).fit(df)  # scores are written out in between
    margins = np.full(len(y), y.mean())
    for one in deep.trees:
        bins = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(deep.edges)], axis=1)
        node = one[0].nodes_of(bins)
        for leaf in np.unique(node):
            assert one[0].value[leaf] == pytest.approx(-0.3 * (margins - y)[node == leaf].mean(), abs=1e-9)
            assert one[0].rows[leaf] == (node == leaf).sum() >= 5
        margins += np.array(one[0].value)[node]
    assert np.allclose(margins, deep.margins(x)[:, 0])


def test_several_classes_need_no_model_each():
    problem = Problem(MULTICLASS, "y", "string", 100, 3, "f1_weighted", [], True, classes=["a", "b", "c"])
    boosted = next(c for c in candidates(problem) if c.model_id == "gradient_boosting")
    estimator = boosted.build({"l2_regularization": 2.5, "max_iter": 50}, 1, None)
    assert isinstance(estimator, HistBoosting) and (estimator.classes, estimator.l2, estimator.rounds) == (3, 2.5, 50) and "l2_regularization" in boosted.space
