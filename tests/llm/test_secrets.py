import hashlib
import os
import re
import random

from pyspark.sql import functions as F

from tabwright.llm.queries import QUERIES
from tabwright.llm.secrets import _before, random_limits, redact_secrets, scan_secrets, written

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
RULES = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def base_of(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, rule, good) in enumerate(RULES) for m in rule.finditer(text or "") if good(m)]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


TEXTS = [
    None, "", "password: hunter2x tokens=abc token = 'abcdefgh' ", "passwd:token:abcdefgh secret:abcdef", "é🙂 API_KEY=\"a.b-c=d/e+f\" x",
    "AKIA" + "A1" * 8 + " AKIAAKIA" + "Z" * 15 + " AKIA123", "0123456789abcdef0123456789abcdef 0123456789ABCDEF", "token=" + "0f" * 20 + "password==xx1234",
    "secret: " * 300 + "🙂 token=abcdef1 " * 500, "x" * 50000, "AKIA" * 30,
]


def test_base_spans_of_hand_written_texts(spark):
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(TEXTS)] * 2, "doc_id bigint, text string, _text string, secret_spans string")
    rows = scan_secrets(docs).select("doc_id", written(F.filter("secret_spans", lambda s: s["kind"] < 3)).alias("spans")).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        assert r["spans"] == ",".join(base_of(TEXTS[r["doc_id"]])), r["doc_id"]
    assert scan_secrets(docs.limit(0)).count() == 0


def test_running_totals_of_long_arrays(spark):
    n = [random.Random(1).randint(0, 9) for _ in range(1000)]
    got = spark.range(1).select(F.array(*(F.lit(x).cast("bigint") for x in n)).alias("a")).select(_before(F.col("a")).alias("b")).first()["b"]
    assert got == [sum(n[:i]) for i in range(len(n))]


def test_query_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op6_secret_scan"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = base_of(docs[r["doc_id"]])
        assert [s for s in r["spans"].split(",") if s and not s.startswith("random")] == base
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))


def test_query_counts_every_span_of_its_kind(spark, tmp_path):
    texts = ["0123456789abcdef" * 2, "token=abcdef1 token=abcdef2 AKIA" + "A1" * 9 + " " + "0a" * 12 + " secret: abcdef3", "AKIA" + "Z" * 16, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op6_secret_scan"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"], r["n_random"]) for r in rows} == {
        0: (0, 0, 1, 0), 1: (3, 1, 1, 0), 2: (0, 1, 0, 0), 3: (0, 0, 0, 0)}


def words(r, n):
    return " ".join("".join(r.choice(["ou", "re", "the", "tion", "an", "eau", "er", "ing", "s"]) for _ in range(r.randint(2, 14))) for _ in range(n))


def test_random_tokens_are_found_and_words_are_not(spark):
    r = random.Random(5)
    symbols = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    docs, planted = [], {}
    for i in range(400):
        text = words(r, 60)
        if i % 4 == 0:
            planted[i] = "".join(r.choice(symbols) for _ in range(40))
            text += f" {planted[i]} " + words(r, 5)
        elif i % 4 == 1:
            text += " section_12_of_the_manual_for_the_machine_2024 "
        docs.append((i, text))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert random_limits(df)
    rows = {x["doc_id"]: [s for s in x["secret_spans"] if s["kind"] == 3] for x in scan_secrets(df).collect()}
    hit = sum(any(docs[i][1][s["start"]:s["end"]] == t for s in rows[i]) for i, t in planted.items())
    assert hit >= 0.9 * len(planted)
    assert sum(len(rows[i]) for i in rows if i not in planted) <= 2


def test_random_tokens_are_found_in_a_corpus_of_short_words(spark):
    r = random.Random(5)
    symbols = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(r.choice(symbols) for _ in range(40)) for _ in range(40)]
    docs = spark.createDataFrame([(i, f"here {k} and") for i, k in enumerate(keys)] + [(40, "a few short words"), (41, None)], "doc_id bigint, text string")
    rows = {x["doc_id"]: [tuple(s) for s in x["secret_spans"]] for x in scan_secrets(docs).collect()}
    hit = sum(rows[i] == [(5, 3, 45)] for i in range(40))
    print("found", hit)
    assert hit > 20 and rows[40] == rows[41] == []
    plain = spark.createDataFrame([(1, "section_12_of_the_manual_for_the_machine_2024")], "doc_id bigint, text string")
    assert [r["secret_spans"] for r in scan_secrets(plain).collect()] == [[]]


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "a token=abcdefgh b", "k"), (2, None, "k"), (3, "é🙂 token=" + "0f" * 20 + " c", "k"), (4, "plain", None)], "doc_id bigint, text string, _whole string")
    rows = {r["doc_id"]: r for r in redact_secrets(docs).collect()}
    assert [rows[i]["text"] for i in (1, 2, 3, 4)] == ["a [SECRET] b", None, "é🙂 [SECRET] c", "plain"]
    assert rows[1]["_whole"] == "k" and redact_secrets(docs).columns == docs.columns


def test_letters_alone_are_tested_too(spark):
    r = random.Random(8)
    alphabets = {"both": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    for name, least in (("both", 60), ("upper", 60)):
        planted = {i: "".join(r.choice(alphabets[name]) for _ in range(40)) for i in range(100)}
        long = {i: "".join(r.choice(alphabets[name]) for _ in range(100)) for i in range(100, 140)}
        docs = [(i, f"{words(r, 40)} {t} {words(r, 5)}") for i, t in {**planted, **long}.items()] + [(i, words(r, 60)) for i in range(200, 500)]
        rows = {x["doc_id"]: [s for s in x["secret_spans"] if s["kind"] == 3] for x in scan_secrets(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
        text = dict(docs)
        found = [i for i, t in planted.items() if any(text[i][s["start"]:s["end"]] == t for s in rows[i])]
        assert len(found) >= least, (name, len(found))
        assert sum(any(text[i][s["start"]:s["end"]] == t for s in rows[i]) for i, t in long.items()) >= 38
        assert sum(len(rows[i]) for i in range(200, 500)) <= 2
    plain = ["Donaudampfschifffahrtsgesellschaftskapitaen", "getElementByIdentifierFromTheDocument", "antidisestablishmentarianism"]
    rows = scan_secrets(spark.createDataFrame([(i, f"a {t} b") for i, t in enumerate(plain)], "doc_id bigint, text string")).collect()
    assert all(not x["secret_spans"] for x in rows)


def test_battery_and_tables_are_those_of_the_models(spark):
    import numpy as np
    import secret_models as m

    from tabwright.llm import secrets

    g = np.random.default_rng(11)
    tokens = ["".join(g.choice(list(a), n)) for a in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for n in (20, 33, 70) for _ in range(6)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, _text string")
    seen = 0
    for row in secrets._tested(df).select("i", F.explode("_tested").alias("t")).select("i", "t.*").collect():
        t = tokens[row["i"]]
        kind = row["stratum"] // secrets.KIND_STEP
        if row["ordinary"] or kind == 0 and not (set(t) - set("0123456789abcdef") and set(t) - set("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")):
            continue
        v = np.array([[ord(c) for c in (t.lower() if kind == 1 else t)]]) - (97 if kind == 1 else 0)
        alphabet = {0: 62, 1: 26}[kind]
        assert row["bin"] == m.bins(v, alphabet, m.VOWEL[v] if kind == 1 else m.above_median(v))[0], t
        seen += 1
    assert seen > 25
    near = lambda got, want: all(abs(a - b) <= 2 + 0.15 * abs(b) or a >= 300 and b >= 300 for a, b in zip(got[1:], want[1:]))
    shares = secrets.MODEL_SHARES
    for i in (0, 2):
        assert near(m.word_row(g, [20, *secrets.STRATA][i], shares, 60_000), secrets.MODEL_BINS[i])
    for i in (0, 3):
        assert near(m.letter_row(g, [20, *secrets.LETTER_STRATA][i], secrets.LETTER_SHARES, 60_000), secrets.LETTER_BINS[i])
