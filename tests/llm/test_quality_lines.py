import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tabwright.llm import quality
from tabwright.llm.line_dedup import COMMON_WORDS, OFTEN, dedup_lines, repeated_runs, shortest_runs
from tabwright.llm.quality import LABELLERS, fit_quality, fit_weak_labels, keep_good, score_quality, vote_counts, votes
from tabwright.llm.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def deleted_by_pairs(docs, least):
    """Every pair of places, extended as far as it goes; later copies of runs of enough words go."""
    places = [(d, p) for d, lines in enumerate(docs) for p in range(len(lines))]
    gone = [set() for _ in docs]
    for b, (d2, p2) in enumerate(places):
        for d1, p1 in places[:b]:
            n = words = 0
            while p1 + n < len(docs[d1]) and p2 + n < len(docs[d2]) and docs[d1][p1 + n] == docs[d2][p2 + n]:
                words += len(docs[d1][p1 + n].split())
                n += 1
            if n and words >= least:
                gone[d2] |= set(range(p2, p2 + n))
    return gone


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_against_all_pairs(spark, seed):
    r = random.Random(seed)
    pool = ["a", "b c", "d e f", "", "g h i j", "k l m n o p"]
    docs = [[r.choice(pool) for _ in range(r.randint(1, 14))] for _ in range(14)]
    docs += [docs[0], docs[3] + ["x"], ["y", *docs[3]], ["a"] * 40]
    least = r.choice([1, 4, 7, 12])
    df = spark.createDataFrame([(i, "\n".join(t), "z", 5) for i, t in enumerate(docs)], "doc_id bigint, text string, d string, p int").repartition(5)
    want = deleted_by_pairs(docs, least)
    for row in dedup_lines(df, least).collect():
        i = row["doc_id"]
        assert row["deleted_lines"] == sorted(want[i]), (i, docs[i], least)
        assert row["text"] == "\n".join(x for p, x in enumerate(docs[i]) if p not in want[i]) and row["n_lines"] == len(docs[i]) and row["d"] == "z"


def deleted_by_windows(docs, common, often):
    """Every run of whole lines with ``common`` words that ``often`` documents have: all but its first copy go."""
    at = {}
    for d, lines in enumerate(docs):
        for a in range(len(lines)):
            words = 0
            for b in range(a, len(lines)):
                words += len(lines[b].split())
                if words >= common:
                    at.setdefault(tuple(lines[a:b + 1]), []).append((d, a))
    gone = [set() for _ in docs]
    for run, places in at.items():
        if len({d for d, _ in places}) >= often:
            for d, a in places[1:] if places == sorted(places) else sorted(places)[1:]:
                gone[d] |= set(range(a, a + len(run)))
    return gone


@pytest.mark.parametrize("seed", range(3))
def test_both_rules_against_brute_force(spark, seed):
    r = random.Random(seed)
    pool = ["a", "b c", "d e f", "", "g h i j", "k l m n o p"]
    docs = [[r.choice(pool) if r.random() < 0.7 else f"own {d} {i}" for i in range(r.randint(1, 12))] for d in range(24)]
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(docs)], "doc_id bigint, text string").repartition(5)
    want = [x | y for x, y in zip(deleted_by_pairs(docs, 9), deleted_by_windows(docs, 3, 8))]
    rows = {x["doc_id"]: x["deleted_lines"] for x in dedup_lines(df, 9, 3, 8).collect()}
    assert rows == {i: sorted(g) for i, g in enumerate(want)} and any(want)


def test_line_dedup_of_odd_rows(odd_docs, no_docs):
    rows = dedup_lines(odd_docs, 1).collect()
    assert len(rows) == odd_docs.count()
    assert [(r["text"], r["n_lines"]) for r in rows if r["doc_id"] == 3] == [(None, 0)]
    assert [(r["text"], r["n_lines"]) for r in rows if r["doc_id"] == 4] == [("", 1)]
    assert [r["deleted_lines"] for r in rows if r["doc_id"] == 7] == [[], []]
    assert [r["deleted_lines"] for r in rows if r["doc_id"] == 2] == [[0]]
    assert dedup_lines(no_docs).count() == 0


def test_common_lines_go_though_they_are_short(spark):
    line, edge, pair, chance = "one two three four five six seven", "a b c d e f g", ["u v w", "x y z"], "Les."
    docs = []
    for i in range(OFTEN + 5):
        own = [f"own {i}", line, f"more {i}", chance, f"end {i}", *pair, f"last {i}", line if i % 2 else f"odd {i}"]
        docs.append(own + ([edge, edge] if i < OFTEN - 1 else []))
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(docs)], "doc_id bigint, text string").repartition(5)
    rows = {r["doc_id"]: r["deleted_lines"] for r in dedup_lines(df).collect()}
    want = {i: [1] * (i > 0) + [5, 6] * (i > 0) + [8] * (i % 2) for i in range(len(docs))}
    assert rows == want


def test_rows_of_one_document_count_once(spark):
    lines = [f"a{i} b" for i in range(40)]
    docs = [(1, "\n".join(["x", *lines]))] + [(2, "\n".join([*lines, "y"]))] * 3 + [(3, "\n".join(lines[:8]))] * 3
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    small = repeated_runs(df.where("doc_id = 3").unionByName(df.where("doc_id = 1")), 16)
    assert [tuple(r) for r in small.select("d", "p", "n").collect()] == [(3, 0, 8)]
    runs = repeated_runs(df)
    assert 0 < runs.count() == runs.distinct().count()
    rows = dedup_lines(df).collect()
    assert len(rows) == 7
    assert [r["deleted_lines"] for r in rows if r["doc_id"] == 2] == [list(range(40))] * 3
    assert [r["deleted_lines"] for r in rows if r["doc_id"] in (1, 3)] == [[]] * 4
    common = spark.createDataFrame([(1, "one two three four five six seven")] * (OFTEN + 5) + [(2, "one two three four five six seven")], "doc_id bigint, text string")
    assert all(r["deleted_lines"] == [] for r in dedup_lines(common).collect())


def test_shortest_runs():
    assert shortest_runs([60, 5, 3], 50) == [[1, 2, 3], [], []]
    assert shortest_runs([20, 20, 20], 50) == [[3], [], []]
    assert shortest_runs([], 50) == []


def test_line_dedup_query_deletes_what_pairs_do(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    lines = [t.split("\n") for _, t in docs]
    seen, repeated = set(), set()
    for own in lines:
        for x in own:
            (repeated if x in seen else seen).add(x)
    unique = iter(range(10 ** 9))
    want = deleted_by_pairs([[x if x in repeated else next(unique) and f"#{next(unique)}" for x in own] for own in lines], 50)
    want = [x | y for x, y in zip(want, deleted_by_windows(lines, COMMON_WORDS, OFTEN))]
    rows = {r["doc_id"]: r for r in QUERIES["op8_line_dedup"](spark, SF).collect()}
    assert len(rows) == len(docs) and any(want)
    for (i, _), own, gone in zip(docs, lines, want):
        assert rows[i]["deleted_lines"] == sorted(gone)
        assert rows[i]["text_sha256"] == hashlib.sha256("\n".join(x for p, x in enumerate(own) if p not in gone).encode()).hexdigest()


def test_em_finds_accuracies():
    r = random.Random(2)
    n, right = {}, 0
    truth = []
    for _ in range(5000):
        good = r.random() < 0.8
        p = "".join("0" if r.random() < 0.1 else "+" if good else ("-" if r.random() < 0.5 else "+") for _ in LABELLERS)
        n[p] = n.get(p, 0) + 1
        truth.append((p, good))
    weak = fit_weak_labels(n)
    right = sum((weak.posterior(p) >= 0.5) == good for p, good in truth) / len(truth)
    assert right > 0.95 and abs(weak.prior - 0.8) < 0.05 and all(a > 0.6 for a in weak.accuracy().values())


def test_votes_of_plain_and_odd_texts():
    assert votes(None) == votes(" \n") == "0" * len(LABELLERS)
    assert "-" not in votes("This is a plain sentence of the usual kind, and it is not long.")
    assert "-" in votes("AND!! THE!! ONE!! WITH!! SHOUTS!!") and "-" in votes("der " * 60)


def test_quality_of_odd_rows(odd_docs, no_docs):
    assert sum(vote_counts(odd_docs).values()) == odd_docs.count()
    rows = score_quality(odd_docs, fit_quality(odd_docs)).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(not r["good"] and r["score"] == 0 for r in rows if r["doc_id"] in (3, 4))
    assert fit_quality(no_docs) is None and score_quality(no_docs, None).count() == 0 and keep_good(no_docs).count() == 0
    assert keep_good(odd_docs).columns == odd_docs.columns


def test_quality_agrees_with_labels(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    rows = QUERIES["op5_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    clean = rows.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    junk = rows.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    print("kept of clean and junk", clean, junk)
    assert clean > 0.97 and junk < 0.25


def test_usual_words_have_the_traits_of_the_general_rule():
    from tabwright.llm.quality import STOP_WORDS, _bucket, _Words, shape_of

    words = _Words()
    for w in ["the", "The", "of,", "Is.", "a", "A", "As", "Straße?", "éa;", "an", "xX", "Ab:", "I", "I.", "ǅa", "İa", "ªa"]:
        row = words.traits[words.numbers(w)[0]].tolist()
        odd = [c for c in w if not c.isalnum()]
        assert row == [sum(map(str.isalpha, w)), sum(map(str.isupper, w)), 0, 0, 0, 0, w.strip(".,;:?").lower() in STOP_WORDS, _bucket(shape_of(w))], (w, odd)


def test_em_row_by_row(spark):
    """The model fitted on pattern counts is that of plain loops over rows."""
    r = random.Random(4)
    rows = ["".join(r.choice("+++-0") if r.random() < 0.7 else r.choice("--0+") for _ in LABELLERS) for _ in range(300)]
    counts = {p: rows.count(p) for p in set(rows)}
    clip = lambda x, low, high: min(max(x, low), high)
    good = [0.2 if "-" in p else 0.9 for p in rows]
    for _ in range(quality.EM_ROUNDS):
        prior = clip((sum(good) + 1) / (len(rows) + 2), 1e-3, 1 - 1e-3)
        tables = []
        for j in range(len(LABELLERS)):
            pair = []
            for side, bounds in ((0, quality.PLUS_IF_BAD), (1, quality.PLUS_IF_GOOD)):
                weight = [g if side else 1 - g for g in good]
                plus = sum(w for w, p in zip(weight, rows) if p[j] == "+")
                some = sum(w for w, p in zip(weight, rows) if p[j] != "0")
                pair.append(clip((plus + 0.5) / (some + 1), *bounds))
            tables.append(pair)
        good = []
        for p in rows:
            odds = [1 - prior, prior]
            for j, vote in enumerate(p):
                if vote != "0":
                    odds = [o * (tables[j][s] if vote == "+" else 1 - tables[j][s]) for s, o in enumerate(odds)]
            good.append(odds[1] / sum(odds))
    weak = fit_weak_labels(counts)
    assert abs(weak.prior - prior) < 1e-9 and abs(weak.tables - tables).max() < 1e-9
    assert all(abs(weak.posterior(p) - g) < 1e-9 for p, g in zip(rows, good))


def test_features_and_scores_are_plain_shares(spark):
    texts = ["The the cat, the cat sat!! On 12 MATS -- and and and so on.", "wow", "A1 b2 \U0001F642 ... x" * 40]
    for text in texts:
        words = text.split()
        want = [0.0] * quality.BUCKETS
        for w in words:
            want[quality._bucket(quality.shape_of(w))] += 1
        want[0] = sum(a == b for a, b in zip(words, words[1:]))
        want = [x / len(words) for x in want]
        want[-1] = len(set(words)) / len(words)
        got = quality.features(text)
        assert abs(got - [x ** 0.5 for x in want]).max() < 1e-12
        weights = [((i * 37) % 11 - 5) / 5 for i in range(quality.BUCKETS)]
        import numpy as np

        model = quality.QualityModel(fit_weak_labels({"+" * len(LABELLERS): 3}), np.array(weights), -0.3)
        margin = sum(w * x ** 0.5 for w, x in zip(weights, want)) - 0.3
        assert abs(model.score(text) - 1 / (1 + np.exp(-margin))) < 1e-9
