"""Spelling variants, fill-in-the-middle and decontamination against brute force."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.llm import decontaminate, fill_in_middle, spelling
from tabwright.llm.decontaminate import contamination, remove_contamination
from tabwright.llm.fill_in_middle import Frames, frames_of, restore, store_frames
from tabwright.llm.fm_index import FMIndex, suffix_array
from tabwright.llm.queries import QUERIES
from tabwright.llm.spelling import WordIndex, spelling_groups

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_suffix_arrays_and_phrase_positions():
    r = random.Random(1)
    texts = [[r.randrange(1, s) for _ in range(n)] for n, s in ((0, 3), (1, 3), (60, 2), (500, 3), (500, 900))] + [[1] * 300, [1, 2] * 200]
    for t in texts:
        t = np.array(t, dtype=np.int64)
        assert suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    t = np.array([r.randrange(1, 7) for _ in range(2000)])
    index = FMIndex(t, 7)
    for size in (1, 3, 5):
        phrases = np.array([[r.randrange(1, 7) for _ in range(size)] for _ in range(30)])
        for p, low, high in zip(phrases, *index.intervals(phrases)):
            want = [i for i in range(len(t) - size + 1) if (t[i:i + size] == p).all()]
            assert sorted(index.positions_of(np.arange(low, high)).tolist()) == want


# spelling variants


def one_error(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def brute_spelling(docs):
    n = brute_words(docs)
    variants = {}
    for w in n:  # words that share a string one deletion away, or are one
        for i in range(len(w)):
            variants.setdefault(w[:i] + w[i + 1:], set()).add(w)
    near = {w: set() for w in n}
    for v, some in variants.items():
        for a in some:
            for b in some | ({v} & n.keys()):
                if a != b and b not in near[a] and one_error(a, b):
                    near[a].add(b)
                    near[b].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    root = {}
    for w in n:
        last = w
        while form[last] is not None:
            last = form[last]
        root[w] = last
    return sorted((w, form[w], root[w], n[w], len(near[w]), n.get(form[w])) for w in n)


def found_spelling(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def spelled_docs(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abé") for _ in range(r.randrange(6, 10))) for _ in range(60)] + ["Straßenbahn", "ÀÁÂÃÄÅÆ×÷", "aaaaaaaa", "aaaaaaa"]
    docs = []
    for i in range(150):
        words = []
        for _ in range(r.randrange(0, 60)):
            w = base[min(int(r.expovariate(0.15)), len(base) - 1)]
            if r.random() < 0.1:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1:], w[:k] + r.choice("abéÉ") + w[k:], w[:k] + r.choice("abcé") + w[k + 1:]])
            words.append(r.choice([w, w.upper() if w.isascii() else w, w.capitalize()]))
        docs.append((i, r.choice([" ", ", ", "1", "Ā"]).join(words)))
    docs += [(500 + i, "chainword " * 20 + "chainwrd " * 3 * (i % 4 == 0) + "chanwrd " * (i % 20 == 0)) for i in range(40)]  # a form of a form
    return docs + [(3, docs[3][1]), (None, docs[4][1]), (None, None), (200, None), (201, ""), (202, "x" * 5000 + " " + "x" * 4999), (203, "x" * 5000 + " " + "x" * 4999)]


@pytest.mark.parametrize("block", [8000, 40])
def test_spelling_groups_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)  # small blocks: groups are split over several indexes
    docs = spelled_docs(block)
    df = spark.createDataFrame([(*d, "w", 1, "p") for d in docs], "doc_id bigint, text string, word string, n int, part string").repartition(5)
    got = found_spelling(spelling_groups(df))
    assert got == brute_spelling(docs)
    assert sum(f is not None for _, f, *_ in got) > 5 and any(f is not None and f != root for _, f, root, *_ in got)
    assert spelling_groups(df.limit(0)).count() == 0


def test_spelling_query_over_the_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found_spelling(QUERIES["op11_spelling_groups"](spark, SF)) == brute_spelling(docs)


def test_each_near_pair_comes_from_one_half():
    r = random.Random(5)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(4, 8))) for _ in range(500)})
    index, got = WordIndex(words), []
    for size in range(4, 8):
        some = [w for w in words if len(w) == size] + ["z" * size]
        for kind in spelling.ERRORS.values():
            for right in (True, False):
                got += [(some[q], words[w]) for q, w in zip(*index.near(some, kind, right))]
    assert sorted(got) == sorted((a, b) for a in words for b in words if one_error(a, b))


# fill-in-the-middle


def brute_middle(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("size", [1, 7, 16 * 1024])
def test_middles_of_odd_texts_and_small_frames(spark, odd_docs, size):
    r = random.Random(size)
    odd = [(r_["doc_id"], r_["text"]) for r_ in odd_docs.collect()]
    more = [(100 + i, "".join(r.choice("ab éß日🙂<PSM>\n") for _ in range(r.randrange(0, 90)))) for i in range(150)] + [(300, "a<"), (301, "<P"), (302, "x<M>y"), (303, "a" * 60), (304, "S>" * 30 + "<")]
    df = spark.createDataFrame([(*d, "f", 1, "o") for d in odd + more], "doc_id bigint, text string, frames string, n int, output string")
    frames = store_frames(df, size)
    done = fill_in_middle.fill_in_middle(frames).withColumn("restored", restore(F.col("output"), F.col("form")))
    rows = done.collect()
    got = [(x["doc_id"], x["n"], x["form"], x["prefix_chars"], x["middle_chars"], x["output"]) for x in rows]
    assert sorted(got, key=repr) == sorted((brute_middle(*d) for d in odd + more), key=repr)
    assert {x["form"] for x in rows} == {"plain", "spm", "psm"}
    assert sorted(x["restored"] for x in rows) == sorted(t or "" for _, t in odd + more)
    assert all(hashlib.sha256(x["output"].encode()).hexdigest() == x["output_sha256"] for x in rows)
    assert fill_in_middle.fill_in_middle(store_frames(df.limit(0))).count() == 0


def test_only_the_cut_frames_are_opened(monkeypatch):
    text = ("word " * 20_000 + "x" * 40_000 + " end").encode()
    stored = Frames(frames_of(text))
    assert max(len(stored.data(i)) for i in range(len(stored.frames))) <= fill_in_middle.FRAME_BYTES + 3
    opened = []
    monkeypatch.setattr(Frames, "data", lambda self, i, data=Frames.data: opened.append(i) or data(self, i))
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text.decode())
    for unit in (0, 1, 17_003, 39_999, 40_000, 40_001, 40_002, len(units)):
        opened.clear()
        frame, at, chars = stored.place(unit)
        assert len(opened) <= 1 and chars == len("".join(units[:unit]))
        assert b"".join(stored.stream((0, 0, 0), (frame, at, chars))).decode() == "".join(units[:unit])


# decontamination


def brute_hits(docs, items, width=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))

    phrases = {}
    for item, text in items:
        w = words(text)
        size = min(width, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            phrases.setdefault(tuple(w[i:i + size]), set()).add(item)
    sizes = {len(p) for p in phrases}
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in phrases:
                    hit |= set(range(i, i + size))
                    found |= phrases[tuple(w[i:i + size])]
        names = sorted(str(i) for i in found if i is not None)
        places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        spans = []
        for i in sorted(hit):
            if i - 1 in hit:
                spans[-1] = spans[-1][0], places[i][1]
            else:
                spans.append(places[i])
        clean = text
        for a, b in reversed(spans):
            clean = clean[:a] + clean[b:]
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit), spans, clean))
    return sorted(out, key=repr)


def leaky(seed):
    r = random.Random(seed)
    vocabulary = ["Ab", "c", "é", "DE", "f0", "日", "9", "zz"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([2, 5, 10, 11, 30, 60])))) for i in range(14)]
    items += [(5, "one more text of item five"), (None, "text of no item"), (20, None), (21, ""), (22, "?!"), (23, items[0][1]), (0, items[0][1]), (24, "c")]
    docs = []
    for i in range(120):
        parts = [" ".join(r.choice([*vocabulary, "other", "wé"]) for _ in range(r.randrange(0, 40))) for _ in range(3)]
        if r.random() < 0.5:
            w = (r.choice(items)[1] or "").split()
            a = r.randrange(0, max(1, len(w)))
            parts.insert(1, r.choice([" ", "-", "\n"]).join(w[a:a + r.randrange(1, 40)]))
        docs.append((i, r.choice([" ", ".  ", ""]).join(parts)))
    docs += [(3, docs[3][1]), (3, "another text of three"), (None, items[5][1]), (200, None), (201, ""), (202, "--"), (203, " ".join(t or "" for _, t in items) * 30), (204, "a text of no item: nothing, One more-text of item FIVE!")]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_hits_items_and_spans(spark, monkeypatch, small):
    if small:  # several blocks of phrases, items in pieces, several shards a batch
        for name, value in (("BLOCK_BYTES", 200), ("PIECE", 7), ("SHARD_WORDS", 300)):
            monkeypatch.setattr(decontaminate, name, value)
    docs, items = leaky(4)
    columns = "bigint, text string, items string, _text string, runs int, _row string"
    df = spark.createDataFrame([(*d, "i", "t", 1, "r") for d in docs], f"doc_id {columns}").repartition(4)
    bench = spark.createDataFrame([(*d, "i", "t", 1, "r") for d in items], f"item_id {columns}")
    want = brute_hits(docs, items)
    rows = contamination(df, bench).collect()
    assert sorted(((x["doc_id"], x["n_words"], x["n_hit"], x["n_items"], x["items_sha256"], x["contaminated"], [tuple(s) for s in x["spans"]]) for x in rows), key=repr) == [w[:7] for w in want]
    cut = remove_contamination(df, bench)
    assert cut.columns == df.columns
    assert sorted(((x["doc_id"], x["text"]) for x in cut.collect()), key=repr) == sorted(((w[0], w[7]) for w in want), key=repr)
    assert contamination(df.limit(0), bench).count() == 0
    assert contamination(df, bench.limit(0)).where("contaminated or n_hit > 0").count() == 0
