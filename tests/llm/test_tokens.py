import hashlib
import os
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabwright.llm import common, packing
from tabwright.llm.bpe import decode_ids, encode_texts, fragments, ids_as_array, joinable_pairs, word_coder
from tabwright.llm.exact_dedup import drop_copies, exact_groups
from tabwright.llm.jaccard_join import _signed
from tabwright.llm.line_dedup import line_rows
from tabwright.llm.packing import best_fit_plan, byte_coder, pack
from tabwright.llm.quality import score_quality
from tabwright.llm.queries import QUERIES, tokenizer_file

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORDS, BYTES = tokenizer_file("word_bpe_49k.json"), tokenizer_file("byte_bpe_50k.json")


def texts_for(seed=7, n=400):
    r = random.Random(seed)
    pool = ["the", "Straße", "it's", "WE'LL", " ", "  ", "\n", "\t", "\r\n", "!!", "½", "²", "ª", "123", "_", "\xa0", "İ", "日本", "<|endoftext|>",
            "<|startoftext|>", "🙂", "é", "\x1c", "\x85", "Σ", "don't", "...", "\xad", "\x7f", "qzx", "'", "\x00", "à"]
    return ["".join(r.choice(pool) + r.choice(["", " ", " "]) for _ in range(r.randint(0, 12))) for _ in range(n)]


def test_word_encoding_is_the_librarys():
    tok, coder = Tokenizer.from_file(WORDS), word_coder(WORDS)
    texts = texts_for()
    ids, decoded, counts = coder.encode(texts)
    for text, i, d, n in zip(texts, ids, decoded, counts):
        want = tok.encode(text, add_special_tokens=False).ids
        assert i == " ".join(map(str, want)) and n == len(want), repr(text)
        assert d == tok.decode(want, skip_special_tokens=False), repr(text)


def test_fragments_are_cut_where_no_token_joins():
    assert fragments("abcab", joinable_pairs(["ab", "bc</w>"], "</w>")) == ["abc", "ab"]
    assert fragments("x", set()) == ["x"]
    coder = word_coder(WORDS)
    assert len(fragments(coder.symbols("qzxj日本"), coder.joinable)) > 1


def test_byte_encoding_is_the_librarys():
    tok, coder = Tokenizer.from_file(BYTES), byte_coder(BYTES)
    texts = texts_for(8)
    for text, got in zip(texts, coder.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_byte_encoder_remembers_a_bounded_number_of_words_and_chunks(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_CHUNKS", 100)
    tok, coder = Tokenizer.from_file(BYTES), packing.ByteCoder(BYTES)
    texts = [f"word{i}, and{i}. it's" for i in range(300)]
    got = [coder.encode([t])[0] for t in texts]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(len(v) for v in vars(coder).values() if isinstance(v, dict) and v is not coder.alphabet) <= 103


def test_byte_encoder_leaves_places_to_chunks_that_come_again(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_CHUNKS", 100)
    monkeypatch.setattr(packing, "FOR_REPEATED", 50)
    monkeypatch.setattr(packing, "SEEN_PLACES", 1 << 16)
    tok, coder = Tokenizer.from_file(BYTES), packing.ByteCoder(BYTES)
    texts = [f"once{i}x{i} again{i % 5} here" for i in range(300)] + ["both, parts " + "long" * 100] * 2
    got = [coder.encode([t])[0] for t in texts]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert {" again4", " here", "both,", "both", ",", " parts"} <= coder.chunks.keys() and len(coder.chunks) < 70
    assert max(map(len, coder.chunks)) < 20


def test_words_of_usual_chunks_are_those_of_the_pattern():
    coder = byte_coder(BYTES)
    cores = ["a", "été", "ªº", "don't", "it's", "x2", "½", "a½", "²", "_", "a_", "", "'s", "İ", "ß\n", "日本", "٣", "a\xad", "\xa0b"]
    for chunk in (s + c + m for s in ("", " ") for c in cores for m in ("", ".", ",", ";", ":", "!", "?", "..", "'")):
        assert coder._words(chunk) == coder.pieces.findall(chunk), repr(chunk)


def test_byte_encoder_holds_little_memory():
    coder = packing.ByteCoder(BYTES)
    tracemalloc.start()
    try:
        for start in range(0, 500_000, 5_000):
            coder.encode([" ".join(f"w{i:x}" for i in range(start, start + 5_000))])
        assert tracemalloc.get_traced_memory()[0] < 50e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("sizes", [[], [0, 0, 0], [packing.TEXT_BYTES // 3] * 10, [5, 2 * packing.TEXT_BYTES, 0, 7, 3 * packing.TEXT_BYTES]])
def test_little_text_is_cut_into_chunks_at_once(sizes):
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(sizes)), pa.int64()), pa.array(["é" * (n // 2) + "e" * (n % 2) for n in sizes], pa.string())], names=["doc_id", "_text"])
    batch = pa.concat_batches([whole, whole]).slice(len(sizes))
    parts = list(packing._slices(batch))
    assert [i for p in parts for i in p["doc_id"].to_pylist()] == list(range(len(sizes)))
    assert all(p.num_rows == 1 or sum(len(t.encode()) for t in p["_text"].to_pylist()) <= packing.TEXT_BYTES for p in parts)
    assert len(parts) <= 2 * sum(sizes) // packing.TEXT_BYTES + 1


def test_memory_goes_back_when_another_operator_takes_a_worker(monkeypatch):
    done = []
    monkeypatch.setattr(common, "_owner", None)
    monkeypatch.setattr(common, "give_back", lambda: done.append("back"))
    for name in ("a", "a", "b"):
        common.claim(name, lambda name=name: done.append(name))
    assert done == ["a", "back"]


def test_encode_odd_rows_and_round_trip(odd_docs, no_docs):
    tok = Tokenizer.from_file(WORDS)
    rows = encode_texts(odd_docs, WORDS).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    assert len(rows) == odd_docs.count()
    for r in rows:
        want = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == " ".join(map(str, want)) and r["n_tokens"] == len(want)
    coded = encode_texts(odd_docs, WORDS)
    back = decode_ids(coded.select("doc_id", ids_as_array(F.col("ids")).alias("ids")), WORDS).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == sorted((r["doc_id"] or 0, r["decoded"]) for r in rows)
    assert encode_texts(no_docs, WORDS).count() == 0


def test_query_over_documents_is_the_librarys(spark):
    tok = Tokenizer.from_file(WORDS)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op9_bpe"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = tok.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def best_fit_by_piece(lengths, size):
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(room) if r >= n]
        if fit:
            room[min(fit)[1]] -= n
        else:
            room.append(size - n)
    return len(room)


@pytest.mark.parametrize("seed", range(20))
def test_plan_over_counts_is_best_fit(seed):
    r = random.Random(seed)
    size = r.choice([10, 64, 2048])
    lengths = [r.randint(1, size) if r.random() < 0.5 else r.choice([1, 3, size // 2, size // 3 + 1]) for _ in range(r.randint(0, 300))]
    counts = {}
    for n in lengths:
        counts[n] = counts.get(n, 0) + 1
    bins, ranks = {}, {}
    for n, first, last, each, base, offset in best_fit_plan(counts, size):
        for k in range(last - first + 1):
            bins.setdefault(base + k // each, []).append((offset + k % each * n, n))
        ranks.setdefault(n, []).extend(range(first, last + 1))
    assert {n: sorted(v) for n, v in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= size
    assert len(bins) == best_fit_by_piece(lengths, size)


def check_packing(rows, docs, size=2048):
    tok = Tokenizer.from_file(BYTES)
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text in docs:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[i], key=lambda r: (r["piece"], r["sequence_id"]))
        for r in own:
            part = ids[r["start"]:r["start"] + r["length"]]
            assert len(part) == r["length"] and (r["piece"] == 0 or r["length"] == size)
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
        assert {r["piece"] for r in own} == set(range(-(-len(ids) // size)))
        assert sum(r["length"] for r in own) % len(ids) == 0
    for places in by_bin.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= size


def test_packing_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_packing(QUERIES["op10_best_fit_packing"](spark, SF).collect(), docs)


def test_packing_odd_rows(odd_docs, no_docs, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    crc = F.crc32("ids").alias("ids_crc32")
    check_packing(pack(odd_docs, BYTES).select("*", crc).collect(), docs)
    monkeypatch.setattr("tabwright.llm.packing.BROADCAST_ROWS", 0)
    check_packing(pack(odd_docs.repartition(4), BYTES, 16).select("*", crc).collect(), docs, 16)
    assert pack(no_docs, BYTES).count() == 0


def test_exact_dedup_odd_rows(odd_docs, no_docs):
    rows = {(r["doc_id"]): r for r in exact_groups(odd_docs).collect()}
    assert exact_groups(odd_docs).count() == odd_docs.count()
    assert (rows[1]["keep_id"], rows[1]["group_size"]) == (1, 3) and rows[2]["keep_id"] == 1 and rows[None]["keep_id"] == 1
    assert not rows[2]["kept"] and not rows[None]["kept"] and rows[1]["kept"] and rows[7]["kept"]
    assert rows[3]["keep_id"] == rows[4]["keep_id"] == 3 and rows[7]["group_size"] == 2
    assert rows[3]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert exact_groups(no_docs).count() == 0
    assert {r["doc_id"] for r in drop_copies(odd_docs).collect()} == {1, 3, 5, 6, 7, 8, 9}


def test_exact_dedup_compares_content_where_digests_collide(odd_docs):
    good = sorted(map(repr, exact_groups(odd_docs).collect()))
    weak = exact_groups(odd_docs, digest=lambda c: F.length(c) % 2)
    assert sorted(map(repr, weak.collect())) == good


def largest_batch(rows):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["n"])

    return common.map_texts(rows, sizes, "n bigint").agg(F.max("n")).first()[0]


def test_workers_get_texts_in_small_batches(spark):
    limit, texts = common._ARROW_LIMIT, spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 500).alias("text"))
    old = spark.conf.get(limit, None)
    try:
        for operator in (lambda: packing.token_pieces(texts, BYTES), lambda: score_quality(texts, None), lambda: line_rows(texts, 50), lambda: _signed(texts, 5)):
            spark.conf.unset(limit)
            operator()
            assert spark.conf.get(limit) == str(common.ARROW_BYTES)
        assert largest_batch(texts) < 1.1 * common.ARROW_BYTES
        spark.conf.set(limit, "100000")  # the user's own
        assert largest_batch(texts) < 110_000 and spark.conf.get(limit) == "100000"
    finally:
        spark.conf.set(limit, old) if old else spark.conf.unset(limit)
