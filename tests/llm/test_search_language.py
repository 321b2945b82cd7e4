import os
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tabwright.llm import topk
from tabwright.llm.langid import Profiles, learn_profiles, letters_of, ngram_counts, predict_language
from tabwright.llm.queries import QUERIES
from tabwright.llm.topk import exact_top_k, integer_vector

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def brute(rows, step, k):
    v = {i: np.floor(256 * np.array(x, dtype=float)).astype(object) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)}
    out = set()
    for q in v:
        if q % step == 0:
            found = sorted((-int(sum(v[q] * v[c])), c) for c in v if c != q and len(v[c]) == len(v[q]))[:k]
            out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(found)}
    return out


def test_top_k_with_ties_bad_vectors_and_few_rows(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in r.normal(size=4)]) for i in range(300)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(300, 420)]
    rows += [(420, None), (421, [1.0, None, 0.0, 0.0]), (422, [float("nan")] * 4), (423, [float("inf")] * 4), (None, [1.0] * 4), (430, [1.0, 2.0]), (440, [0.5, 0.5]), (450, []), (460, [1e9, 1e9, -1e9, 1.0])]
    df = spark.createDataFrame([(*x, "q", 1) for x in rows], "vec_id bigint, embedding array<double>, dim string, score int").repartition(3)
    vectors = df.select("vec_id", integer_vector(F.col("embedding")).alias("v"))
    for k in (1, 5):
        got = exact_top_k(vectors.where("vec_id % 10 = 0"), vectors, k)
        assert {tuple(x) for x in got.collect()} == brute(rows, 10, k)
    monkeypatch.setattr(topk, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    got = exact_top_k(vectors.where("vec_id % 10 = 0"), vectors, 5, bins=64)
    assert {tuple(x) for x in got.collect()} == brute(rows, 10, 5)
    assert exact_top_k(vectors.limit(0), vectors, 5).count() == 0
    assert exact_top_k(vectors, vectors.limit(0), 5).count() == 0


def test_letters_and_ngrams():
    assert "".join(map(chr, letters_of("  Ab,c--É 12"))) == " ab c é "
    assert len(letters_of("12 !")) == 0
    grams, counts = ngram_counts(letters_of("aa a"))
    got = dict(zip(grams.tolist(), counts.tolist()))
    a, s = ord("a"), 32
    assert got == {a: 3, s << 21 | a: 2, a << 21 | a: 1, a << 21 | s: 2, s << 42 | a << 21 | a: 1, a << 42 | a << 21 | s: 1, a << 42 | s << 21 | a: 1, s << 42 | a << 21 | s: 1}


def test_long_texts_are_counted_in_steps(monkeypatch):
    words = letters_of("the quick brown fox jumps over the lazy dog " * 30)
    whole = ngram_counts(words)
    monkeypatch.setattr("tabwright.llm.langid.STEP", 17)
    assert all((a == b).all() for a, b in zip(whole, ngram_counts(words)))


def test_language_of_odd_rows(odd_docs, no_docs):
    profiles = learn_profiles(odd_docs)
    rows = {r["doc_id"]: r for r in predict_language(odd_docs, profiles).collect()}
    assert [rows[i]["lang_pred"] for i in (3, 4, 8)] == ["und"] * 3 and rows[3]["score"] == 0
    assert rows[1]["lang_pred"] == "en" and rows[6]["lang_pred"] == "fr" and all(0 <= r["score"] <= 1 for r in rows.values())
    assert predict_language(odd_docs, profiles).count() == odd_docs.count()
    assert learn_profiles(no_docs) == {} and predict_language(odd_docs, {}).where("lang_pred <> 'und'").count() == 0
    assert predict_language(no_docs, profiles).count() == 0


def test_ties_go_to_the_first_language_by_name():
    assert Profiles({"b": [97], "a": [97]}, 10).predict("a")[0] == "a"


def test_held_out_accuracy(spark):
    found = QUERIES["op2_language_id"](spark, SF)
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    right, n = found.where("held_out").join(lang, "doc_id").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and right / n > 0.95


def naive_ranks(counts, most=400):
    """N-grams by count, then by length and code points, and their places."""
    order = sorted(counts, key=lambda g: (-counts[g], len(g), list(map(ord, g))))
    return {g: i for i, g in enumerate(order[:most])}


def naive_counts(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    s = f" {' '.join(words)} " if words else ""
    return Counter(s[i:i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1) if s[i:i + n] != " ")


def test_query_against_plain_strings(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in docs}
    totals = {}
    for i, text, lang in docs:
        if not held[i] and lang is not None and text is not None:
            totals.setdefault(lang, Counter()).update(naive_counts(text))
    profiles = {lang: naive_ranks(n) for lang, n in sorted(totals.items()) if n}
    want = {}
    for i, text, _ in docs:
        own = naive_ranks(naive_counts(text))
        far = {lang: sum(abs(p[g] - r) if g in p else 400 for g, r in own.items()) for lang, p in profiles.items()}
        best = min(far, key=lambda lang: (far[lang], lang))
        want[i] = (held[i], best, 1 - far[best] / (400 * len(own))) if own else (held[i], "und", 0.0)
    got = {r["doc_id"]: (r["held_out"], r["lang_pred"], r["score"]) for r in QUERIES["op2_language_id"](spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][:2] == w[:2] and abs(got[i][2] - w[2]) < 1e-12 for i, w in want.items())
