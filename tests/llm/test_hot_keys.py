"""Keys that hold much of a table, and rows that are judged one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_quality_lines import deleted_by_pairs

from tabwright.llm import common
from tabwright.llm.chat import CHUNK, ROLES, fit_chat_model
from tabwright.llm.common import lookup
from tabwright.llm.exact_dedup import drop_copies, exact_groups
from tabwright.llm.jaccard_join import MAP_BITS, _of_wanted, keep_one
from tabwright.llm.line_dedup import dedup_lines


@pytest.fixture
def hot(monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)


def test_lookup_deals_out_hot_keys(spark, hot):
    rows = spark.range(900).select("id", F.when(F.col("id") < 600, 0).otherwise(F.col("id") % 200).alias("k"), F.lit("x").alias("_salt_"))
    side = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("k != 7")
    got = {tuple(r) for r in lookup(rows, side, ["k"], "n", 900).select("id", "k", "first").collect()}
    assert got == {tuple(r) for r in rows.join(side, "k").select("id", "k", "first").collect()} and len(got) > 800


def test_half_of_all_lines_are_blank(spark, hot):
    docs = [[x for i in range(12) for x in (f"a{(d * i) % 9} b c", "")] for d in range(14)]
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(docs)], "doc_id bigint, text string").repartition(4)
    want = deleted_by_pairs(docs, 9)
    got = {r["doc_id"]: r["deleted_lines"] for r in dedup_lines(df, 9).collect()}
    assert got == {i: sorted(g) for i, g in enumerate(want)} and any(want)


def test_half_of_all_texts_are_empty(spark, hot):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.when(F.col("id") % 4 == 0, F.lit(""))).otherwise(
        F.concat(F.lit("t"), (F.col("id") % 60).cast("string"))).alias("text"))
    rows = exact_groups(df).collect()
    assert len(rows) == 300 and {(r["keep_id"], r["group_size"]) for r in rows if r["doc_id"] % 2 == 0} == {(0, 150)}
    assert {r["group_size"] for r in rows if r["doc_id"] % 2} == {5} and sum(r["kept"] for r in rows) == 31


def texts(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


A, B, C = "one two three four five six seven eight", "a whole other text of eight words here", "??"


@pytest.mark.parametrize("rows, want", [
    ([(1, A), (2, A), (2, B)], [(1, A), (2, B)]),
    ([(1, A), (1, A), (2, A)], [(1, A)]),
    ([(1, A), (1, B), (2, A), (2, C), (2, C), (3, B)], None),
])
def test_no_text_is_lost_where_ids_repeat(spark, rows, want):
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id bigint, text string, node string, _id int")
    assert texts(drop_copies(df)) == sorted(want or [(1, A), (1, B), (2, C)])
    got = keep_one(df)
    assert got.columns == df.columns and texts(got) == sorted(want or [(1, A), (1, B), (2, C), (2, C)])  # texts without words stay


def test_a_map_of_fixed_size_keeps_every_wanted_id(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    wanted = docs.where("doc_id % 100 = 3").select(F.col("doc_id").alias("first_id"))
    got = {r["doc_id"] for r in _of_wanted(docs, wanted).collect()}
    assert {i for i in range(3000) if i % 100 == 3} <= got and len(got) < 40 and MAP_BITS == 1 << 26
    assert _of_wanted(docs, wanted.limit(0)).count() == 0


def test_moves_across_blocks_are_counted(spark):
    rows, n = [], 3 * CHUNK + 40
    r = np.random.default_rng(2)
    roles = [None if x == 3 else ROLES[x] for x in r.integers(0, 4, n)]
    rows = [(1, t, roles[t], f"x{t}") for t in range(n)] + [(2, t, roles[t], "y") for t in range(CHUNK + 5, CHUNK + 60)] + [(3, None, "user", f"z{t}") for t in range(50)] + [(3, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    turn, first = np.ones((len(ROLES), len(ROLES))), np.ones(len(ROLES))
    for conv in (1, 2, 3):
        was = None
        own = sorted((-1 if t is None else t, x, ROLES.index(role) if role else -1) for c, t, role, x in rows if c == conv)
        for k, (_, _, role) in enumerate(own):
            if role >= 0 and k == 0:
                first[role] += 1
            elif role >= 0 and was >= 0:
                turn[was, role] += 1
            was = role
    model = fit_chat_model(df)
    assert np.allclose(np.exp(model.turn), turn / turn.sum(axis=1, keepdims=True)) and np.allclose(np.exp(model.first), first / first.sum())
