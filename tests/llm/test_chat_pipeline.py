import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tabwright.llm import chat
from tabwright.llm.chat import ROLES, ChatModel, fit_chat_model, format_chat, marker_of
from tabwright.llm.common import kept
from tabwright.llm.queries import QUERIES, tokenizer_file
from test_jaccard import brute as all_pairs
from test_quality_lines import deleted_by_pairs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, place int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)


def test_markers():
    assert marker_of("User: hi") == (ROLES.index("user"), 6) and marker_of("<|assistant|> x")[0] == ROLES.index("assistant")
    assert marker_of("[system] x")[0] == ROLES.index("system") and marker_of("Note: x") == (-1, 0) and marker_of("plain") == (-1, 0)


def whole_viterbi(group, model):
    """One pass over all lines of a conversation."""
    lines, scores, moves = chat._observed(group, model)
    at, back = model.first + scores[0], []
    for s, move in zip(scores[1:], moves[1:]):
        step = at[:, None] + move
        back.append(step.argmax(axis=0))
        at = step.max(axis=0) + s
    path = [int(at.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return [(t, ROLES[r]) for (_, t), r in zip(lines, path[::-1])]


def test_blocks_give_the_path_of_the_whole(spark):
    import pyarrow as pa

    r = random.Random(6)
    rows = []
    for t in range(1600):
        text = "\n".join("x" * r.choice([3, 60, 200, 500]) + r.choice(["", "?"]) + f" {t}" for _ in range(r.randint(1, 3)))
        rows.append((1, t, r.choice(["user", "assistant", None, None, "system"]), text))
    rows += [(2, 0, None, "hello?"), (2, 1, "assistant", "User: yes\nno")]
    df = conversations(spark, rows)
    model = fit_chat_model(df)
    got = {}
    for x in format_chat(df, model).collect():
        got.setdefault(x["conv_id"], []).append((x["turn"], x["part"], x["role"], x["rendered"], x["opens"]))
    for conv in (1, 2):
        table = pa.Table.from_pylist([{"conv_id": c, "place": t, "turn": t, "role": role, "text": text} for c, t, role, text in rows if c == conv])
        want = whole_viterbi(table, model)
        lines = []
        for _, _, role, rendered, opens in sorted(got[conv]):
            body = rendered.split("|>\n", 2)[-1] if opens else rendered
            lines += [(x, role) for x in body.removesuffix("\n").split("\n")]
        assert lines == want


def test_odd_rows(spark):
    rows = [(None, None, None, None), (1, None, "User", "a"), (1, 0, "bot", ""), (1, 0, "bot", ""), (1, 1, "who", "x" * 200000), (2, 3, "user", "q?\nAssistant: answer")]
    out = format_chat(conversations(spark, rows)).collect()
    assert {(r["conv_id"], r["turn"]) for r in out} == {(None, None), (1, None), (1, 0), (1, 1), (2, 3)}
    parts = sorted((r["part"], r["role"], r["rendered"]) for r in out if r["conv_id"] == 2)
    assert parts == [(0, "user", "<|user|>\nq?\n"), (1, "assistant", "<|end|>\n<|assistant|>\nanswer\n")]
    assert format_chat(conversations(spark, rows).limit(0)).count() == 0


def test_hidden_roles_are_recovered(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    test = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5 == 0
    model = fit_chat_model(turns.where(~test))
    hidden = turns.where(test).withColumn("role", F.lit(None).cast("string"))
    found = format_chat(hidden, model).where("part = 0").select("conv_id", "turn", F.col("role").alias("got"))
    right, n = found.join(turns, ["conv_id", "turn"]).agg(F.sum((F.col("got") == F.col("role")).cast("int")), F.count("*")).first()
    assert n > 50 and right / n > 0.9


def test_query_keeps_given_roles_and_text(spark):
    turns = {(r["conv_id"], r["turn"]): r for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    out = QUERIES["op4_chat_format"](spark, SF).collect()
    assert {(r["conv_id"], r["turn"]) for r in out} == set(turns)
    same = sum(r["role"] == turns[r["conv_id"], r["turn"]]["role"] for r in out)
    assert same / len(out) > 0.99
    for r in out:
        if r["part"] == 0:
            assert turns[r["conv_id"], r["turn"]]["text"].split("\n")[0] in r["rendered"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(kept(f(spark, out[-1], SF), name))
    return out


def rows_of(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_keep_the_columns_and_do_their_work(spark, stages):
    docs, good, lines, single, masked, packed = stages
    assert all(s.columns == docs.columns for s in stages[1:-1])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stayed = {r["doc_id"] for r in good.collect()}
    clean = [i in stayed for i, q in labels.items() if q == 1]
    junk = [i in stayed for i, q in labels.items() if q == 0]
    assert np.mean(clean) > 0.97 and np.mean(junk) < 0.3
    before = rows_of(good)
    own = [t.split("\n") for _, t in before]
    seen, repeated = set(), set()
    for x in (x for o in own for x in o):
        (repeated if x in seen else seen).add(x)
    number = iter(range(10 ** 9))
    gone = deleted_by_pairs([[x if x in repeated else f"#{next(number)}" for x in o] for o in own], 50)
    assert rows_of(lines) == [(i, "\n".join(x for p, x in enumerate(t.split("\n")) if p not in g)) for (i, t), g in zip(before, gone)]
    classes = all_pairs(rows_of(lines))
    assert {i for i, _ in rows_of(single)} == {d for d, c, _ in classes if d == c}
    assert {i for i, _ in rows_of(masked)} == {i for i, _ in rows_of(single)}
    assert not any("AKIA" in t for _, t in rows_of(masked))
    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    want = sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows_of(masked))
    assert packed.agg(F.sum("length")).first()[0] == want


def test_run_gives_what_the_stages_give(spark, stages):
    key = ["doc_id", "piece", "length"]
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, stages[-1].select(*key).collect()))


def test_stages_take_odd_and_no_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a plain text of some words", "en", "s", 5), (3, "a plain text of some words", None, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for df in (docs, docs.limit(0)):
        for name, f in corpus_pipeline.STAGES:
            f(spark, df, SF).collect()


def test_chat_model_of_no_rows(spark):
    assert isinstance(fit_chat_model(conversations(spark, [(1, 1, "user", "x")]).limit(0)), ChatModel)
