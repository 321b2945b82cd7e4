import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators.profile import column_profile
from tabwright.operators.profile_state import load_states, merge_states, profile_state, save_state, state_profile

EXACT = ["position", "dtype", "semantic_type", "n_rows", "n_non_null", "null_count", "null_pct", "is_constant", "min", "max", "top_value",
         "top_count", "data_bytes"]


def odd_table(spark):
    r = np.random.default_rng(4)
    rows = [(i, float(r.normal(1e6, 1.0)) if i % 5 else None, int(r.integers(0, 2)), "abcdefgh"[min(int(r.exponential(2)), 7)] if i % 7 else None,
             f"text {i}", bool(i % 3 == 0), None, 7.5, [i]) for i in range(3000)]
    return spark.createDataFrame(rows, "k bigint, x double, flag int, level string, name string, yes boolean, none string, same double, list array<int>").withColumn(
        "day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("k") % 90).cast("int"))).repartition(4)


def test_merged_batches_profile_like_the_whole(spark, tmp_path):
    df = odd_table(spark)
    # uneven batches, one of them empty and one where a column has no value
    for name, part in (("a", df.where("k < 100")), ("b", df.where("k between 100 and 2500")), ("c", df.where("k > 2500")), ("d", df.where("k < 0"))):
        save_state(profile_state(part), str(tmp_path), name)
    save_state(profile_state(df.where("k < 100")), str(tmp_path), "a")  # written again: replaced
    states = load_states(spark, str(tmp_path))
    merged = merge_states(states)
    twice = merge_states(merge_states(states.where("n_rows < 600")).unionByName(merge_states(states.where("n_rows >= 600"))))
    want = {r["column"]: r for r in column_profile(df).collect()}
    whole = {r["column"]: r for r in state_profile(profile_state(df)).collect()}
    for state in (merged, twice):
        got = {r["column"]: r for r in state_profile(state).collect()}
        assert got.keys() == want.keys()
        for c, w in want.items():
            assert [got[c][e] for e in EXACT] == [w[e] for e in EXACT], c
            for m in ("mean", "std", "skew"):
                assert got[c][m] == (None if w[m] is None else pytest.approx(w[m], rel=1e-6, abs=1e-6)), (c, m)
            if w["n_distinct"] is not None:
                assert abs(got[c]["n_distinct"] - w["n_distinct"]) <= 0.03 * w["n_distinct"] + 0.5
            if w["median"] is not None:
                values = np.sort([r[0] for r in df.select(F.col(c).cast("double")).where(F.col(c).isNotNull()).collect()])
                for q, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
                    low, high = np.searchsorted(values, got[c][q], "left") / len(values), np.searchsorted(values, got[c][q], "right") / len(values)
                    assert low - 0.02 <= p <= high + 0.02 and abs(got[c][q] - whole[c][q]) <= 0.05 * (w["max"] - w["min"]) + 1e-9
        assert got["level"]["top_exact"] and not got["name"]["top_exact"]


def test_states_of_an_empty_table(spark):
    empty = odd_table(spark).limit(0)
    got = {r["column"]: r for r in state_profile(merge_states(profile_state(empty).unionByName(profile_state(empty)))).collect()}
    assert len(got) == len(empty.columns) and all(r["n_rows"] == 0 and r["n_non_null"] == 0 for r in got.values())


def test_quartiles_of_few_values_are_exact(spark):
    """A rank just beside a border between two values: a sketch gives either of them."""
    counts = [545, 640, 602, 617, 595, 600, 602, 601, 588, 610]  # 2,999 of 6,000 rows are 4 or less
    values = np.repeat(np.arange(10), counts)
    np.random.default_rng(5).shuffle(values)
    rows = [(int(v), float(i % 2) if i % 3 else None, float(i), None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "v bigint, half double, many double, none double").withColumn("zero", F.when(F.col("v") < 5, F.lit(-0.0)).otherwise(0.0))
    parts = [profile_state(df.where(F.col("many") % 3 == k)) for k in range(3)]
    states = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(profile_state(df.limit(0)))
    got = {r["column"]: r for r in state_profile(merge_states(states)).collect()}
    want = {r["column"]: r for r in column_profile(df).collect()}
    for c in ("v", "half", "none", "zero"):
        assert [got[c][q] for q in ("q25", "median", "q75")] == [want[c][q] for q in ("q25", "median", "q75")], c
    assert got["v"]["median"] == 5.0 and abs(got["many"]["median"] - 3000) < 120
    kept = {r["column"]: r["few"] for r in merge_states(states).select("column", "few").collect()}
    assert [r["n"] for r in kept["v"]] == counts and kept["many"] is None and len(kept["zero"]) == 1
