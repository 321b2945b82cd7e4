import os
import random

import numpy as np
import pytest

from tabwright.llm import jaccard_join
from tabwright.llm.components import components
from tabwright.llm.jaccard_join import keep_one, near_classes, recall, shingles
from tabwright.llm.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def brute(docs, similarity=0.8, width=5):
    """Every pair, on word tuples."""
    import re

    sets = []
    for _, t in docs:
        w = re.findall(r"\w+", (t or "").lower())
        sets.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    links = [0] * len(docs)
    root = list(range(len(docs)))
    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i in range(len(docs)):
        for j in {j for x in sets[i] for j in by[x] if j < i}:
            if docs[i][0] is not None and docs[j][0] is not None and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    low = {}
    for (d, _), r in zip(docs, root):
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return sorted(((d, low[r] if d is not None else None, n) for (d, _), r, n in zip(docs, root, links)), key=repr)


def made(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, i = [], 0
    for _ in range(40):
        words = [r.choice(vocabulary) for _ in range(r.randint(60, 160))]
        for _ in range(r.choice([1, 1, 2, 5])):
            own = list(words)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            docs.append((i, " ".join(own)))
            i += 1
    base = [r.choice(vocabulary) for _ in range(150)]
    for _ in range(150):  # one large group of near copies
        own = list(base)
        own[r.randrange(150)] = r.choice(vocabulary)
        docs.append((i, " ".join(own)))
        i += 1
    docs += [(i + 1, "one two"), (i + 2, "One, two!"), (i + 3, "one two three"), (i + 4, None), (i + 5, ""), (i + 6, "?!"), (None, "one two"), (0, docs[0][1]), (0, "other text of the same id and more")]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_and_links_are_those_of_all_pairs(spark, seed):
    docs = made(seed)
    df = spark.createDataFrame([(*d, b"x", "y", 1) for d in docs], "doc_id bigint, text string, node binary, `group` string, n int").repartition(6)
    got = sorted((tuple(r) for r in near_classes(df).collect()), key=repr)
    assert got == brute(docs)
    assert near_classes(df.limit(0)).count() == 0


def test_one_of_each_class_stays(spark):
    docs = made(3)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    classes = {(d, c) for d, c, _ in brute(docs)}
    want = {d for d, c in classes if d == c}
    assert {r["doc_id"] for r in keep_one(df).collect()} - {None} == want - {None}


def test_query_recall(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op3_ngram_jaccard_join"](spark, SF).collect()), key=repr) == brute(docs)


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    root = {}
    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = {x["id"]: x["label"] for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_recall_grows_as_prefixes_shorten():
    assert all(recall(0.8, d) > recall(0.8, d + 1) for d in range(1, 8)) and recall(0.8, 6) > 0.99


def test_shingles_of_odd_texts():
    assert len(shingles(None)) == len(shingles("?!")) == 0 and len(shingles("a b")) == 1
    assert (shingles("A b c d e f") == shingles("a, b. c d e f!")).all() and len(shingles("a b c d e f")) == 2
    assert np.intersect1d(shingles("a b c d"), shingles("a b c d x")).size == 0
