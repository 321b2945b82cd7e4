"""Histogram gradient boosting with an l2 penalty and a loss for several classes.

The rows stay in Spark as bytes, one bin per feature. Every level of a round is one job: each partition adds up the
gradients of its rows per node, feature and bin, the sums are added by key and give the best cut of each, and only one
row per node and feature reaches the driver, which holds the trees.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.session import reliable, spread

#: Rounds after which the scores of the rows are written out again.
KEEP_EVERY = 10
LEAST_GAIN = 1e-12
_BEST = ["gain", "cut", "gl", "hl", "nl", "g", "h", "n"]


@dataclass
class Tree:
    """Nodes as lists: a row goes left where its bin is at most ``cut``; ``left`` is -1 in a leaf."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    rows: list[float] = field(default_factory=list)

    def add(self, value: float = 0.0, rows: float = 0.0) -> int:
        for name, x in (("feature", 0), ("cut", 0), ("left", -1), ("right", -1), ("value", value), ("rows", rows)):
            getattr(self, name).append(x)
        return len(self.left) - 1

    def nodes_of(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row is in so far."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        node, every = np.zeros(len(bins), int), np.arange(len(bins))
        while True:
            inner = left[node] >= 0
            if not inner.any():
                return node
            down = np.where(bins[every, feature[node]] <= cut[node], left[node], right[node])
            node = np.where(inner, down, node)


def _added(scores: np.ndarray, bins: np.ndarray, trees: list[list[Tree]]) -> np.ndarray:
    for one in trees:
        for k, tree in enumerate(one):
            scores[:, k] += np.array(tree.value)[tree.nodes_of(bins)]
    return scores


def _gradients(scores: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of squared error, or of the log loss of two or of more classes."""
    if classes == 0:
        return scores - y[:, None], np.ones_like(scores)
    if classes == 2:
        p, hit = 1.0 / (1.0 + np.exp(-scores)), y[:, None]
    else:
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        p, hit = e / e.sum(axis=1, keepdims=True), (y[:, None] == np.arange(classes)).astype(float)
    return p - hit, p * (1.0 - p)


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    bins = np.frombuffer(b"".join(batch["bins"].to_pylist()), np.uint8).reshape(n, -1)
    return bins, batch["y"].to_numpy(), batch["scores"].flatten().to_numpy().reshape(n, -1).copy()


class HistBoosting(Estimator):
    """Boosted trees on binned features. ``classes`` is 0 for a number, else the number of label codes from 0.

    A cut needs ``min_rows`` rows on either side and the best gain G²/(H + l2) of both sides over that of the node;
    a leaf is worth -G/(H + l2), times ``learning_rate``. Several classes have one tree each per round, grown from the
    same scores. Rows of unknown label are the caller's to drop; weights are not used."""

    def __init__(self, classes: int = 0, rounds: int = 100, learning_rate: float = 0.1, max_depth: int = 5, l2: float = 0.0,
                 bins: int = 255, min_rows: int = 20, features: str = "features", label: str = "label"):
        super().__init__()
        self.classes, self.rounds, self.learning_rate, self.max_depth, self.l2 = classes, rounds, learning_rate, max_depth, l2
        self.bins, self.min_rows, self.features, self.label = min(bins, 255), min_rows, features, label

    def _fit(self, dataset: DataFrame) -> HistBoostingModel:
        rows = spread(dataset.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("double").alias("y")))
        edges = self._edges(rows)
        base = self._base(rows)
        data = reliable(self._binned(rows, edges, base))
        done: list[list[Tree]] = []
        pending: list[list[Tree]] = []
        for _ in range(self.rounds):
            new = self._round(data, pending, len(edges), len(base))
            if all(t.left[0] < 0 for t in new):
                break
            done.append(new)
            pending.append(new)
            if len(pending) == KEEP_EVERY:
                data, pending = reliable(self._advanced(data, pending)), []
        return HistBoostingModel(self.classes, base, [e.tolist() for e in edges], done, self.features)

    def _edges(self, rows: DataFrame) -> list[np.ndarray]:
        """Upper bounds of the bins of each feature, but for the last bin."""
        shares = [k / self.bins for k in range(1, self.bins)]
        cells = rows.select(F.posexplode("x").alias("i", "v"))
        found = {r["i"]: r["q"] for r in cells.groupBy("i").agg(F.percentile_approx("v", shares, 10_000).alias("q"), F.max("v").alias("hi")).select(
            "i", F.filter("q", lambda q: q < F.col("hi")).alias("q")).collect()}  # a row per feature
        return [np.unique(found[i]) for i in range(len(found))]

    def _base(self, rows: DataFrame) -> list[float]:
        if self.classes == 0:
            return [float(rows.agg(F.avg("y")).first()[0] or 0.0)]
        counts = {int(r["y"]): r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per class
        n = np.array([counts.get(k, 0) for k in range(self.classes)], float)
        p = np.clip(n / max(n.sum(), 1.0), 1e-6, 1.0)
        return [float(np.log(p[1] / p[0]))] if self.classes == 2 else np.log(p).tolist()

    def _binned(self, rows: DataFrame, edges: list[np.ndarray], base: list[float]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                bins = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.tobytes() for b in bins], pa.binary()), batch["y"], pa.array([base] * len(bins), pa.list_(pa.float64()))], names=["bins", "y", "scores"])

        return rows.mapInArrow(run, "bins binary, y double, scores array<double>")

    def _advanced(self, data: DataFrame, trees: list[list[Tree]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    bins, _, scores = _read(batch)
                    scores = _added(scores, bins, trees)
                    yield pa.RecordBatch.from_arrays([batch["bins"], batch["y"], pa.array(list(scores), pa.list_(pa.float64()))], names=["bins", "y", "scores"])

        return data.mapInArrow(run, data.schema)

    def _round(self, data: DataFrame, pending: list[list[Tree]], width: int, outputs: int) -> list[Tree]:
        trees = [Tree() for _ in range(outputs)]
        active = [(k, trees[k].add()) for k in range(outputs)]
        for _ in range(self.max_depth):
            best: dict[int, dict] = {}
            for r in self._cuts(data, pending, trees, active, width).collect():  # a row per open node and feature
                slot, feature = divmod(r["key"], width)
                if slot not in best or (r["gain"], -feature) > (best[slot]["gain"], -best[slot]["feature"]):
                    best[slot] = {**r.asDict(), "feature": feature}
            following = []
            for slot, (k, node) in enumerate(active):
                cut, tree = best.get(slot), trees[k]
                if cut is None:
                    continue
                tree.rows[node] = cut["n"]
                tree.value[node] = self._worth(cut["g"], cut["h"])
                if cut["gain"] <= LEAST_GAIN:
                    continue
                tree.feature[node], tree.cut[node] = cut["feature"], int(cut["cut"])
                tree.left[node] = tree.add(self._worth(cut["gl"], cut["hl"]), cut["nl"])
                tree.right[node] = tree.add(self._worth(cut["g"] - cut["gl"], cut["h"] - cut["hl"]), cut["n"] - cut["nl"])
                following += [(k, c) for c in (tree.left[node], tree.right[node]) if tree.rows[c] >= 2 * self.min_rows]
            active = following
            if not active:
                break
        return trees

    def _worth(self, g: float, h: float) -> float:
        return -self.learning_rate * g / (h + self.l2) if h + self.l2 > 0 else 0.0

    def _cuts(self, data: DataFrame, pending: list[list[Tree]], trees: list[Tree], active: list[tuple[int, int]], width: int) -> DataFrame:
        """key (open node x width + feature) and the best cut there with its sums."""
        classes, bins, l2, least = self.classes, self.bins, self.l2, self.min_rows

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(active), 3, width * bins))
            for batch in batches:
                if not batch.num_rows:
                    continue
                own, y, scores = _read(batch)
                g, h = _gradients(_added(scores, own, pending), y, classes)
                place = own + np.arange(width) * bins
                nodes = {k: trees[k].nodes_of(own) for k in {k for k, _ in active}}
                for slot, (k, node) in enumerate(active):
                    here = nodes[k] == node
                    at = place[here].ravel()
                    for m, weight in enumerate((g[here, k], h[here, k], np.ones(here.sum()))):
                        total[slot, m] += np.bincount(at, np.repeat(weight, width), minlength=width * bins)
            cells = total.reshape(len(active), 3, width, bins).transpose(0, 2, 1, 3).reshape(-1, 3 * bins)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells)), pa.int64()), pa.array(list(cells), pa.list_(pa.float64()))], names=["key", "sums"])

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for key, sums in zip(batch["key"].to_pylist(), batch["sums"]):
                    own = sums.values.to_numpy()
                    total[key] = total[key] + own if key in total else own
            out = []
            for key, sums in total.items():
                g, h, n = np.cumsum(sums.reshape(3, bins), axis=1)
                if n[-1] == 0:
                    continue
                worth = lambda a, b: np.divide(a * a, b + l2, out=np.zeros_like(a), where=b + l2 > 0)
                gain = worth(g, h) + worth(g[-1] - g, h[-1] - h) - worth(g[-1:], h[-1:])
                gain[(n < least) | (n[-1] - n < least)] = -np.inf
                cut = int(gain.argmax())
                out.append((key, float(gain[cut]) if np.isfinite(gain[cut]) else -1.0, float(cut), g[cut], h[cut], n[cut], g[-1], h[-1], n[-1]))
            columns = list(zip(*out)) if out else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[1:])], names=["key", *_BEST])

        parts = data.mapInArrow(summed, "key bigint, sums array<double>")
        return parts.repartition("key").mapInArrow(chosen, "key bigint, " + ", ".join(f"{c} double" for c in _BEST))


class HistBoostingModel(Model, MLWritable, MLReadable):
    """Fitted trees, with the bounds of the bins to read a vector by."""

    def __init__(self, classes: int, base: list[float], edges: list[list[float]], trees: list[list[Tree]], features: str = "features"):
        super().__init__()
        self.numClasses, self.base, self.edges, self.trees, self.features = classes, base, edges, trees, features

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(self.edges)], axis=1)
        return _added(np.tile(self.base, (len(x), 1)), bins, self.trees)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = dataset.sparkSession.sparkContext.broadcast((self.numClasses, self.base, self.edges, self.trees))  # the model's own size

        @F.pandas_udf("array<double>")
        def margins(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = HistBoostingModel(*shared.value)
            for s in batches:
                yield pd.Series(list(model.margins(np.stack(s.to_numpy()))) if len(s) else [], dtype=object)

        out = dataset.withColumn("_m", margins(vector_to_array(self.features)))
        if self.numClasses == 0:
            return out.withColumn("prediction", F.get("_m", F.lit(0))).drop("_m")
        m = F.get("_m", F.lit(0))
        raw = F.array(-m, m) if self.numClasses == 2 else F.col("_m")
        chance = 1.0 / (1.0 + F.exp(-m))
        high = F.transform("_m", lambda v: F.exp(v - F.array_max("_m")))
        total = F.aggregate(high, F.lit(0.0), lambda a, b: a + b)
        chances = F.array(1.0 - chance, chance) if self.numClasses == 2 else F.transform(high, lambda v: v / total)
        best = (F.array_position(raw, F.array_max(raw)) - 1).cast("double")
        return out.withColumns({"rawPrediction": array_to_vector(raw), "probability": array_to_vector(chances), "prediction": best}).drop("_m")

    def write(self) -> MLWriter:
        return _BoostingWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _BoostingReader()


class _BoostingWriter(MLWriter):
    def __init__(self, model: HistBoostingModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        state = json.dumps({"classes": m.numClasses, "base": m.base, "edges": m.edges, "features": m.features, "trees": [[asdict(t) for t in one] for one in m.trees]})
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"state": state})


class _BoostingReader(MLReader):
    def load(self, path: str) -> HistBoostingModel:
        state = json.loads(DefaultParamsReader.loadMetadata(path, self.sparkSession)["state"])
        trees = [[Tree(**t) for t in one] for one in state.pop("trees")]
        return HistBoostingModel(trees=trees, **state)
