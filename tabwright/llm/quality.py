"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer trained on its posterior."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import claim, give_back, map_texts

#: Common short words of the languages the stop-word labeller knows.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or an had they which you were their one all we "
    "der die das und in zu den ist nicht von mit sich auf für als auch es an werden aus er hat dass sie nach bei um am sind noch wie einem über "
    "le la les de des du et en un une est que qui dans pour pas sur au par plus avec ce il ne se son sont aux ou elle "
    "el los las y del que en un una por con no su para es al lo como más o pero sus le ha este si".split())

BUCKETS = 512
#: Rows on which the scorer is trained, about: those whose hash falls in this share of all.
SAMPLE = 20_000
HASH_SPACE = 1 << 40
EM_ROUNDS = 50
#: Bounds of P(vote + | bad) and P(vote + | good): junk is of several kinds, so a good vote never proves much,
#: while a labeller that calls good texts bad is rarely of use.
PLUS_IF_BAD = (0.1, 0.9)
PLUS_IF_GOOD = (0.5, 0.998)
CACHED_WORDS = 200_000
#: Rows whose feature vectors a task holds at once.
FEATURE_ROWS = 1000
_PLAIN = set(".,;:!?'\"()-")
_MARKS = ".,;:!?'\"()-*#$%&|<>=_~"


@dataclass
class Measures:
    """What the labellers look at, per text."""

    words: int
    upper: float
    symbols: float
    repeated: float
    pairs: float
    top: float
    bare: float
    stops: float
    shouts: float
    marked: float


class _Words(dict):
    """A number for each word met, and a table row of its traits: letters, capitals, rare marks, exclamation marks,
    0/1 for bare marks, doubled end marks and stop words, and the hash bucket of its shape."""

    def __init__(self):
        super().__init__()
        self.traits = np.zeros((1024, 8), np.int32)

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n == len(self.traits):
            self.traits = np.concatenate([self.traits, np.zeros_like(self.traits)])
        core, mark = (word[:-1], word[-1]) if word[-1] in ".,;:?" else (word, "")
        if core.isalpha() and core[1:].islower():  # the usual word, by the same rules
            big = core[0].isupper()
            shape = ("A" if big else "a") + ("" if big else "a") + ("a" if big else "") + ("a" if big and len(core) > 2 else "") + mark
            self.traits[n] = (len(core), big, 0, 0, 0, 0, core.lower() in STOP_WORDS, _bucket(shape))
        else:
            odd = [c for c in word if not c.isalnum()]
            self.traits[n] = (
                sum(map(str.isalpha, word)), sum(map(str.isupper, word)), sum(c not in _PLAIN for c in odd), word.count("!"),
                len(odd) == len(word), len(odd) > 1 and odd[-1] == odd[-2] and word[-1] == odd[-1], word.strip(_MARKS).lower() in STOP_WORDS,
                _bucket(shape_of(word)))
        self[word] = n
        return n

    def numbers(self, text: str | None) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
        words = text.split() if text else []
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


_words = _Words()


def shape_of(word: str) -> str:
    """Letter cases, digits and marks of a word, runs cut to two."""
    shape = ""
    for c in word:
        s = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if shape[-2:] != s * 2:
            shape += s
    return shape


@lru_cache(maxsize=10_000)
def _bucket(shape: str) -> int:
    return 1 + zlib.crc32(shape.encode("utf-8", "replace")) % (BUCKETS - 2)


class Counted:
    """The word numbers of a text, and its distinct words with their counts: votes and features share them."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.w = _words.numbers(text)
        self.distinct, self.n = np.unique(self.w, return_counts=True)
        self.traits = _words.traits[self.distinct]
        self.repeats = int((self.w[1:] == self.w[:-1]).sum())


def measures(c: Counted) -> Measures:
    n = max(1, len(c.w))
    letters, upper, symbols, shouts, bare, marked, stops = (c.n @ c.traits[:, :7]).tolist()
    pairs = np.sort(c.w[:-1] << 32 | c.w[1:])
    different = min(len(pairs), 1) + int((pairs[1:] != pairs[:-1]).sum())
    return Measures(
        len(c.w), upper / max(1, letters), symbols / max(1, len(c.text)), c.repeats / n, different / max(1, len(c.w) - 1),
        int(c.n.max(initial=0)) / n, bare / n, stops / n, shouts / n, marked / n)


def _two_sided(value: float, good: float, bad: float) -> int:
    return 1 if value <= good else -1 if value >= bad else 0


#: Overlapping labellers: 1 good, -1 bad, 0 no opinion. Few words give no opinion where a share means little.
LABELLERS = {
    "capitals": lambda m: _two_sided(m.upper, 0.15, 0.4) if m.words >= 5 else 0,
    "symbols": lambda m: _two_sided(m.symbols, 0.01, 0.05),
    "repeats": lambda m: _two_sided(m.repeated, 0.03, 0.2) if m.words >= 5 else 0,
    "same_pairs": lambda m: (1 if m.pairs >= 0.5 else -1 if m.pairs <= 0.2 else 0) if m.words >= 20 else 0,
    "one_word": lambda m: _two_sided(m.top, 0.1, 0.2) if m.words >= 20 else 0,
    "bare_marks": lambda m: _two_sided(m.bare, 0.05, 0.2) if m.words >= 5 else 0,
    "stop_words": lambda m: (1 if m.stops >= 0.12 else -1 if m.stops <= 0.04 else 0) if m.words >= 30 else 0,
    "shouting": lambda m: _two_sided(m.shouts, 0.02, 0.2),
    "marked_words": lambda m: _two_sided(m.marked, 0.02, 0.2),
}


def votes(text: str | None, counted: Counted | None = None) -> str:
    """One character per labeller: +, - or 0; all 0 without words."""
    if not text or not text.strip():
        return "0" * len(LABELLERS)
    m = measures(counted or Counted(text))
    return "".join("-0+"[f(m) + 1] for f in LABELLERS.values())


@dataclass
class WeakLabels:
    """P(good) and P(vote + | class, some vote) per labeller, class 0 bad and 1 good. No opinion says nothing."""

    prior: float
    tables: np.ndarray  # labeller x class

    def posterior(self, pattern: str) -> float:
        log = np.log([1 - self.prior, self.prior])
        for j, vote in enumerate(pattern):
            if vote != "0":
                log = log + np.log(self.tables[j] if vote == "+" else 1 - self.tables[j])
        return float(1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700))))

    def accuracy(self) -> dict[str, float]:
        """Share of right votes among the votes each labeller gives."""
        right = self.prior * self.tables[:, 1] + (1 - self.prior) * (1 - self.tables[:, 0])
        return dict(zip(LABELLERS, right.tolist()))


def fit_weak_labels(patterns: dict[str, int], rounds: int = EM_ROUNDS) -> WeakLabels:
    """Expectation-maximisation over vote patterns and their counts; starts from "bad where any labeller says so"."""
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], dtype=float)
    v = np.array([["-0+".index(c) - 1 for c in p] for p in names], dtype=float).reshape(len(names), len(LABELLERS))
    plus, minus = (v > 0).astype(float), (v < 0).astype(float)
    # one bad vote outweighs the good ones at the start: junk shows by one sign, and most labellers see other signs
    good = np.where(minus.any(axis=1), 0.2, 0.9)
    for _ in range(rounds):
        weight = np.stack([n * (1 - good), n * good])
        prior = float(np.clip((weight[1].sum() + 1) / (n.sum() + 2), 1e-3, 1 - 1e-3))
        tables = ((weight @ plus + 0.5) / (weight @ (plus + minus) + 1)).T
        tables = np.stack([tables[:, 0].clip(*PLUS_IF_BAD), tables[:, 1].clip(*PLUS_IF_GOOD)], axis=1)
        log = np.log([1 - prior, prior])[:, None] + np.log(tables).T @ plus.T + np.log(1 - tables).T @ minus.T
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
    return WeakLabels(prior, tables)


def features(text: str | None, counted: Counted | None = None) -> np.ndarray:
    """Share of each shape bucket; bucket 0 holds words equal to the one before, the last the share of distinct words."""
    c = counted or Counted(text)
    out = np.zeros(BUCKETS)
    if len(c.w):
        out[:] = np.bincount(c.traits[:, 7], weights=c.n, minlength=BUCKETS)
        out[0] = c.repeats
        out /= len(c.w)
        out[-1] = len(c.distinct) / len(c.w)
    return np.sqrt(out)


@dataclass
class QualityModel:
    weak: WeakLabels
    weights: np.ndarray
    intercept: float

    def score(self, text: str | None, counted: Counted | None = None) -> float:
        return float(1 / (1 + np.exp(-np.clip(features(text, counted) @ self.weights + self.intercept, -700, 700))))


def _mapped(docs: DataFrame, ddl: str, f) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality", _words.clear)
        for batch in batches:
            yield from f(batch)
        give_back()

    return map_texts(docs, run, ddl)


def vote_counts(docs: DataFrame) -> dict[str, int]:
    """How many texts have each vote pattern, over all rows; at most 3 to the number of labellers come back."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality", _words.clear)
        n: Counter = Counter()
        for batch in batches:
            n.update(votes(t.as_py()) for t in batch["text"])
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["votes", "n"])

    rows = map_texts(docs.select("text"), counted, "votes string, n bigint").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    return {r["votes"]: r["n"] for r in rows}


def fit_quality(docs: DataFrame, sample: int = SAMPLE) -> QualityModel | None:
    """Weak-label model from the votes on all texts, then logistic regression on the posterior labels of about
    ``sample`` rows, chosen by a hash of the row. None where there is no text with words."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    patterns = vote_counts(docs)
    silent = "0" * len(LABELLERS)
    if not set(patterns) - {silent}:
        return None
    weak = fit_weak_labels({p: n for p, n in patterns.items() if p != silent})
    share = min(1.0, sample / sum(patterns.values()))
    chosen = docs.where("text is not null").where(F.pmod(F.xxhash64(*docs.columns), F.lit(HASH_SPACE)) < int(share * HASH_SPACE)).select("text")

    def labelled(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start in range(0, batch.num_rows, FEATURE_ROWS):
            x, good = [], []
            for t in batch["text"].slice(start, FEATURE_ROWS):
                counted = Counted(t.as_py())
                x.append(features(counted.text, counted))
                good.append(weak.posterior(votes(counted.text, counted)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(good, pa.float64())], names=["x", "good"])

    rows = _mapped(chosen, "x array<double>, good double", labelled)
    both = F.array(F.struct(F.lit(1.0).alias("label"), F.col("good").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("good")).alias("weight")))
    train = rows.select("x", F.explode(both).alias("l")).select(array_to_vector("x").alias("features"), "l.label", "l.weight").persist()
    try:
        model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=40, standardization=False).fit(train)
    finally:
        train.unpersist()
    return QualityModel(weak, model.coefficients.toArray(), float(model.intercept))


def score_quality(docs: DataFrame, model: QualityModel | None, threshold: float = 0.5, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns, votes, posterior (weak-label model), score (linear scorer) and good (score at or above
    ``threshold``) of every row. A text that is null or has no words has score 0 and is not good; without a model
    every text is such. Rows stay as they are."""
    known: dict[str, float] = {}  # at most 3 to the number of labellers

    def chance(pattern: str) -> float:
        if pattern not in known:
            known[pattern] = model.weak.posterior(pattern)
        return known[pattern]

    def scored(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        said, some, posterior, score = [], [], [], []
        for t in batch["text"]:
            counted = Counted(t.as_py())
            text = counted.text
            said.append(votes(text, counted))
            some.append(model is not None and bool(text.strip()))
            posterior.append(chance(said[-1]) if some[-1] else 0.0)
            score.append(model.score(text, counted) if some[-1] else 0.0)
        yield pa.RecordBatch.from_arrays(
            [*(batch[c] for c in carry), pa.array(said, pa.string()), pa.array(posterior, pa.float64()), pa.array(score, pa.float64()),
             pa.array([s and x >= threshold for s, x in zip(some, score)], pa.bool_())],
            names=[*carry, "votes", "posterior", "score", "good"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return _mapped(docs.select(*carry, "text"), f"{kinds}, votes string, posterior double, score double, good boolean", scored)


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text the scorer finds good, with all their columns."""
    model = fit_quality(docs)

    def passed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [t.as_py() for t in batch["_row"].field("text")]
        yield batch.filter(pa.array([model is not None and bool(t and t.strip()) and model.score(t) >= threshold for t in texts], pa.bool_()))

    packed = docs.select(F.struct("*").alias("_row"))
    return _mapped(packed, packed.schema.simpleString().removeprefix("struct<")[:-1], passed).select("_row.*")
