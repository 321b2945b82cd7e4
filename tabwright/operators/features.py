"""Leakage-safe preprocessing: plan, fit (for all folds at once), transform, persistence.

Numeric features: median imputation, then scaling by mean and population deviation of the
imputed values. Categorical features: mode imputation, then one indicator per sorted level
(at most 25 levels) or an ordinal code from a dictionary table; unseen values become all
zeros or -1. For k folds every statistic is fitted k times, each time without one fold, from
one pass over (column, fold) moments and one over (column, fold, value) counts.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import as_double, numeric_cells, present, quoted
from tabwright.functions.ordered import dense_codes
from tabwright.functions.quantiles import part_quantiles, ranked_quantiles
from tabwright.operators.folds import FOLD
from tabwright.operators.profile import Profile
from tabwright.operators.validate import require_columns
from tabwright.session import LIMITS, fits, local_table, shared

# Fixed value: most levels a one-hot feature may have.
MAX_ONE_HOT = 25
MAX_LISTED = 1000  # levels a hand-made plan may one-hot encode
UNSEEN = -1.0
SPREAD_KEYS = 65_536
HOT_SHARE = 1000  # a value is hot when it holds more than 1/1000 of the rows: at most 1000 are


@dataclass
class FeaturePlan:
    numeric: list[str] = field(default_factory=list)
    one_hot: list[str] = field(default_factory=list)
    ordinal: list[str] = field(default_factory=list)
    dropped: dict[str, str] = field(default_factory=dict)

    @property
    def inputs(self) -> list[str]:
        return [*self.numeric, *self.one_hot, *self.ordinal]

    def table(self, spark) -> DataFrame:
        rows = [(c, "numeric", None) for c in self.numeric]
        rows += [(c, "one_hot", None) for c in self.one_hot]
        rows += [(c, "ordinal", None) for c in self.ordinal]
        rows += [(c, "dropped", why) for c, why in self.dropped.items()]
        return local_table(spark, rows, "column string, role string, reason string")


def plan_features(profile: Profile, target: str, excluded: list[str] | None = None) -> FeaturePlan:
    """Choose features and encoders from the profile; dropped columns are listed with a reason."""
    plan = FeaturePlan()
    out = {target: "target", **{c: "excluded" for c in excluded or []}}
    flags = []
    for c, r in profile.rows.items():
        kind = r["semantic_type"]
        if c in out:
            plan.dropped[c] = out[c]
        elif r["is_constant"]:
            plan.dropped[c] = "constant"
        elif kind in ("id", "datetime", "unsupported"):
            plan.dropped[c] = kind
        elif kind == "numerical":
            plan.numeric.append(c)
        elif r["n_distinct"] > MAX_ONE_HOT:
            plan.ordinal.append(c)
        elif kind == "boolean":
            flags.append(c)
        else:
            plan.one_hot.append(c)
    plan.one_hot += flags
    return plan


@dataclass
class NumericState:
    median: float
    mean: float
    std: float


@dataclass
class Encoding:
    """Fitted statistics of one training set. ``dictionary`` holds (feature, value, code, n)."""

    plan: FeaturePlan
    numeric: dict[str, NumericState]
    modes: dict[str, str | None]
    levels: dict[str, list[str]]
    dictionary: DataFrame | None = None

    @property
    def names(self) -> list[str]:
        out = list(self.plan.numeric)
        for c in self.plan.one_hot:
            out += [f"{c}_{level}" for level in self.levels[c]]
        return out + list(self.plan.ordinal)

    def state_json(self) -> str:
        return json.dumps(
            {
                "plan": asdict(self.plan),
                "numeric": {c: asdict(s) for c, s in self.numeric.items()},
                "modes": self.modes,
                "levels": self.levels,
            }
        )

    @staticmethod
    def from_json(text: str, dictionary: DataFrame | None) -> Encoding:
        raw = json.loads(text)
        return Encoding(
            FeaturePlan(**raw["plan"]),
            {c: NumericState(**s) for c, s in raw["numeric"].items()},
            raw["modes"],
            raw["levels"],
            dictionary,
        )


def scaled(df: DataFrame, name: str, s: NumericState) -> Column:
    """Imputed and scaled numeric column."""
    return (F.coalesce(as_double(df, name), F.lit(s.median)) - F.lit(s.mean)) / F.lit(s.std)


def filled_text(df: DataFrame, name: str, mode: str | None) -> Column:
    return F.coalesce(present(df, name).cast("string"), F.lit(mode))


def transform(df: DataFrame, enc: Encoding, output: str = "features") -> DataFrame:
    """Add the encoded feature vector; expressions only, plus one dictionary join per ordinal."""
    require_columns(df, enc.plan.inputs)
    cells = [scaled(df, c, enc.numeric[c]) for c in enc.plan.numeric]
    for c in enc.plan.one_hot:
        v = filled_text(df, c, enc.modes[c])
        cells += [F.coalesce(v == F.lit(level), F.lit(False)).cast("double") for level in enc.levels[c]]
    out = df
    codes = []
    for i, c in enumerate(enc.plan.ordinal):
        entries = enc.dictionary.where(F.col("feature") == c).select("value", "code", "n")
        out = lookup(out, filled_text(df, c, enc.modes[c]), entries, f"_code{i}")
        codes.append(f"_code{i}")
    cells += [F.coalesce(F.col(k).cast("double"), F.lit(UNSEEN)) for k in codes]
    return out.withColumn(output, array_to_vector(F.array(*cells))).drop(*codes)


def lookup(df: DataFrame, key: Column, entries: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """Left join of a (value, code, n) dictionary. A dictionary proven small is broadcast; keys are at most 97
    bytes (longer values by digest), so its rows bound its bytes. Otherwise hot values (never more than 1000) are
    broadcast and rare ones are shuffled; rows that need no rare value get a spread key that matches nothing, so a
    value held by a third of the rows loads no single task. The rows are read once."""
    limit = limit or LIMITS.broadcast_rows
    keyed = df.withColumn("_key", _short(key))
    side = entries.select(_short(F.col("value")).alias("_key"), F.col("code").alias(name), "n")
    if fits(side, limit):
        return keyed.join(F.broadcast(side.drop("n")), "_key", "left").drop("_key")
    total = side.agg(F.sum("n")).first()[0]
    is_hot = F.col("n") > total / HOT_SHARE
    hot = side.where(is_hot).select("_key", F.col(name).alias("_hot"))
    rare = side.where(~is_hot).select(F.col("_key").alias("_rare"), name)
    spread_key = F.concat(F.lit("-"), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD_KEYS)).cast("string"))
    wanted = F.when(F.col("_hot").isNull() & F.col("_key").isNotNull(), F.col("_key")).otherwise(spread_key)
    matched = keyed.join(F.broadcast(hot), "_key", "left").withColumn("_rare", wanted).join(rare, "_rare", "left")
    return matched.withColumn(name, F.coalesce("_hot", name)).drop("_key", "_rare", "_hot")


def _short(value: Column) -> Column:
    """A join key of at most 97 bytes: the value after ``=``, or the digest of a long one after ``#``."""
    long = F.octet_length(value) > 96
    return F.when(long, F.concat(F.lit("#"), F.sha2(value.cast("binary"), 256))).otherwise(F.concat(F.lit("="), value))


def fit(df: DataFrame, plan: FeaturePlan) -> Encoding:
    """Fit on every row."""
    return fit_folds(df.withColumn(FOLD, F.lit(0)), plan, 1, leave_out=False)[0]


def fit_folds(
    df: DataFrame, plan: FeaturePlan, k: int, leave_out: bool = True, rows: int | None = None
) -> list[Encoding]:
    """One encoding per fold, each fitted on the rows of all other folds."""
    with shared(df.select(FOLD, *[quoted(c) for c in plan.inputs]), rows) as table:
        numeric = _numeric_states(table, plan.numeric, k, leave_out)
        modes, levels, dictionaries = _category_states(table, plan, k, leave_out)
    return [Encoding(plan, numeric[j], modes[j], levels[j], dictionaries[j]) for j in range(k)]


def fold_moments(df: DataFrame, names: list[str]) -> DataFrame:
    """(fold, idx, n, mean, var, lo, hi): one row per column and fold."""
    return numeric_cells(df, names, FOLD).groupBy(FOLD, "idx").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"),
        F.min("x").alias("lo"), F.max("x").alias("hi"),
    )


def fold_medians(df: DataFrame, names: list[str], k: int, leave_out: bool = True, rows: int | None = None) -> DataFrame:
    """(idx, medians): exact medians of each column, slot j leaving fold j out."""
    rows = df.count() if rows is None else rows
    if rows <= LIMITS.task_rows:
        freq = numeric_cells(df, names, FOLD).groupBy("idx", "x").agg(
            F.count(F.lit(1)).alias("c"), *[F.count_if(F.col(FOLD) == j).alias(f"f{j}") for j in range(k)])
        kept = {f"m{j}": (F.col("c") - F.col(f"f{j}")) if leave_out else F.col("c") for j in range(k)}
        found = ranked_quantiles(freq, "idx", "x", kept, [0.5])
        return found.select("idx", F.array(*[F.get(m, F.lit(0)) for m in kept]).alias("medians"))
    cells = df.select(F.array(*[as_double(df, c) for c in names]).alias("a"), F.col(FOLD).cast("int").alias("part"))
    found = part_quantiles(cells, len(names), k, leave_out, [0.5])
    medians = [(i, [found[i, j][0] for j in range(k)]) for i in range(len(names))]
    return df.sparkSession.createDataFrame(medians, "idx int, medians array<double>")


def _numeric_states(df, names, k, leave_out) -> list[dict[str, NumericState]]:
    if not names:
        return [{} for _ in range(k)]
    rows = {r[FOLD]: r["n"] for r in df.groupBy(FOLD).agg(F.count(F.lit(1)).alias("n")).collect()}
    moments = {(r["idx"], r[FOLD]): r for r in fold_moments(df, names).collect()}
    medians = {r["idx"]: r["medians"] for r in fold_medians(df, names, k, leave_out, sum(rows.values())).collect()}
    out = []
    for j in range(k):
        used = [f for f in rows if not leave_out or f != j]
        state = {}
        for i, c in enumerate(names):
            parts = [moments[(i, f)] for f in used if (i, f) in moments]
            if not parts:
                state[c] = NumericState(0.0, 0.0, 1.0)
                continue
            median = medians[i][j]
            # imputed values join the moments as one more part: n_missing copies of the median
            gaps = sum(rows[f] for f in used) - sum(p["n"] for p in parts)
            mean, std = _pool([(p["n"], p["mean"], p["var"]) for p in parts] + [(gaps, median, 0.0)])
            flat = min(p["lo"] for p in parts) == max(p["hi"] for p in parts)
            state[c] = NumericState(median, mean, 1.0 if flat or std == 0.0 else std)
        out.append(state)
    return out


def _pool(parts: list[tuple[int, float, float]]) -> tuple[float, float]:
    """Mean and population deviation of a union of groups given as (n, mean, variance)."""
    n = sum(p[0] for p in parts)
    mean = math.fsum(p[0] * p[1] for p in parts if p[0]) / n
    var = math.fsum(p[0] * (p[2] + (p[1] - mean) ** 2) for p in parts if p[0]) / n
    return mean, math.sqrt(max(var, 0.0))


def fold_value_counts(df: DataFrame, names: list[str], k: int, leave_out: bool = True) -> DataFrame:
    """(idx, j, v, n): value counts of each column for every training set j (fold j left out).

    Values are counted once per fold; the k training sets are derived from those counts.
    """
    cells = F.array(*[present(df, c).cast("string") for c in names])
    counts = (
        df.select(FOLD, F.posexplode(cells).alias("idx", "v")).where("v is not null")
        .groupBy("idx", "v").agg(
            F.count(F.lit(1)).alias("total"),
            *[F.count_if(F.col(FOLD) == j).alias(f"f{j}") for j in range(k)],
        )
    )
    left = [(F.col("total") - F.col(f"f{j}")) if leave_out else F.col("total") for j in range(k)]
    return (
        counts.select("idx", "v", F.posexplode(F.array(*left)).alias("j", "n")).where("n > 0")
    )


def _category_states(df, plan: FeaturePlan, k: int, leave_out: bool):
    names = [*plan.one_hot, *plan.ordinal]
    modes: list[dict] = [{c: None for c in names} for _ in range(k)]
    levels: list[dict] = [{c: [] for c in plan.one_hot} for _ in range(k)]
    if not names:
        return modes, levels, [None] * k
    counts = fold_value_counts(df, names, k, leave_out).persist()
    try:
        best = counts.groupBy("idx", "j").agg(F.min(F.struct((-F.col("n")).alias("neg"), "v")).alias("m"))
        for r in best.collect():  # one row per column and fold
            modes[r["j"]][names[r["idx"]]] = r["m"]["v"]
        n_hot = len(plan.one_hot)
        if n_hot:  # at most 25 levels each, by plan; a hand-made plan is held to a bound as well
            listed = counts.where(F.col("idx") < n_hot).select("idx", "j", "v")
            if not fits(listed, MAX_LISTED * n_hot * k):
                raise ValueError("a one-hot feature has too many levels; encode it as ordinal")
            for r in listed.orderBy("v").collect():
                levels[r["j"]][names[r["idx"]]].append(r["v"])
        dictionaries = [None] * k
        if plan.ordinal:
            wanted = counts.where(F.col("idx") >= n_hot)
            coded = dense_codes(wanted, ["idx", "j"], "v", "code")
            labels = F.array(*[F.lit(c) for c in names])
            kept = coded.select(
                F.get(labels, F.col("idx")).alias("feature"), "j", F.col("v").alias("value"),
                F.col("code").cast("long").alias("code"), "n",
            ).persist()
            kept.count()
            dictionaries = [kept.where(F.col("j") == j).drop("j") for j in range(k)]
    finally:
        counts.unpersist()
    return modes, levels, dictionaries


def leave_fold_out_table(df: DataFrame, names: list[str], k: int) -> DataFrame:
    """(column, fold, median, mean, std): what each fold's rows are imputed and scaled with."""
    plan = FeaturePlan(numeric=list(names))
    rows = [
        (c, j, s.median, s.mean, s.std)
        for j, enc in enumerate(fit_folds(df, plan, k))
        for c, s in enc.numeric.items()
    ]
    return local_table(df.sparkSession, rows, "column string, fold int, median double, mean double, std double")


def mode_table(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, mode): most frequent value, ties to the smallest."""
    labels = F.array(*[F.lit(c) for c in names])
    counts = fold_value_counts(df.withColumn(FOLD, F.lit(0)), names, 1, leave_out=False)
    return counts.groupBy("idx").agg(F.min(F.struct((-F.col("n")).alias("neg"), "v")).alias("m")).select(
        F.get(labels, F.col("idx")).alias("column"), F.col("m.v").alias("mode"))


def ordinal_dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, code, n): sorted categories numbered from 0."""
    v = present(df, column).cast("string").alias("value")
    counts = df.select(v).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return dense_codes(counts, [], "value", "code")


class TabularEncoder(Estimator):
    """Pipeline stage that fits an ``Encoding`` for a feature plan."""

    def __init__(self, plan: FeaturePlan, output: str = "features"):
        super().__init__()
        self.plan, self.output = plan, output

    def _fit(self, dataset: DataFrame) -> TabularEncoding:
        return TabularEncoding(fit(dataset, self.plan), self.output)


class TabularEncoding(Model, MLWritable, MLReadable):
    """Fitted stage; its statistics are saved as metadata and its dictionary as Parquet."""

    def __init__(self, encoding: Encoding, output: str = "features"):
        super().__init__()
        self.encoding, self.output = encoding, output

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return transform(dataset, self.encoding, self.output)

    def write(self) -> MLWriter:
        return _EncodingWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _EncodingReader()


class _EncodingWriter(MLWriter):
    def __init__(self, model: TabularEncoding):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        enc = self.model.encoding
        spark = self.sparkSession
        extra = {"state": enc.state_json(), "output": self.model.output, "hasDictionary": enc.dictionary is not None}
        DefaultParamsWriter.saveMetadata(self.model, path, spark, extraMetadata=extra)
        if enc.dictionary is not None:
            enc.dictionary.write.parquet(f"{path}/dictionary")


class _EncodingReader(MLReader):
    def load(self, path: str) -> TabularEncoding:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        dictionary = self.sparkSession.read.parquet(f"{path}/dictionary") if meta["hasDictionary"] else None
        return TabularEncoding(Encoding.from_json(meta["state"], dictionary), meta["output"])
