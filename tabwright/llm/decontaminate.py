"""Benchmark decontamination: an FM-index of each training shard is searched for the phrases of the test items."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.fm_index import FMIndex, spread_ranges

WIDTH = 10
#: Words of an item that make one piece of it, text bytes of the pieces that are broadcast at once, words of a shard.
PIECE = 5_000
BLOCK_BYTES = 4 * 1024 * 1024
SHARD_WORDS = 1 << 20

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: A word byte for itself in lower case, a blank for any other.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of digits, letters and characters beyond ASCII; only A-Z are lower-cased."""
    return text.translate(_LOWER).split() if text else []


@dataclass
class Phrases:
    """Numbers of the words (2 and up) and, per length, the distinct phrases and the items that have each."""

    words: dict[bytes, int]
    tables: list[np.ndarray]
    starts: list[np.ndarray]
    items: list[np.ndarray]
    names: list[str]


def phrases_of(rows: list[tuple[str | None, list[bytes]]], width: int) -> Phrases:
    """Phrases of (item name, words) rows: every run of ``width`` words, or all the words if there are fewer."""
    numbers: dict[bytes, int] = {}
    names = sorted({name for name, _ in rows if name is not None})
    place = {name: i for i, name in enumerate(names)} | {None: -1}
    found: dict[int, list[tuple[np.ndarray, int]]] = {}
    for name, words in rows:
        if words:
            coded = np.array([numbers.setdefault(w, len(numbers) + 2) for w in words])
            runs = np.lib.stride_tricks.sliding_window_view(coded, min(width, len(coded)))
            found.setdefault(runs.shape[1], []).append((runs, place[name]))
    tables, starts, items = [], [], []
    for _, parts in sorted(found.items()):
        runs = np.concatenate([r for r, _ in parts])
        owner = np.concatenate([np.full(len(r), i) for r, i in parts])
        table, phrase = np.unique(runs, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([phrase.reshape(-1), owner], axis=1), axis=0)
        pairs = pairs[pairs[:, 1] >= 0]
        tables.append(table)
        starts.append(np.searchsorted(pairs[:, 0], np.arange(len(table) + 1)))
        items.append(pairs[:, 1])
    return Phrases(numbers, tables, starts, items, names)


def _blocks(benchmark: DataFrame, width: int) -> Iterator[Phrases]:
    """The phrases of all items, in blocks of about ``BLOCK_BYTES``: long items are cut into pieces that overlap by
    ``width`` - 1 words, and a block is the pieces of one hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch["name"], batch["text"]):
                words = words_of(text.as_py())
                starts = range(0, max(1, len(words) - width + 1), PIECE) if words else ()
                pieces = [b" ".join(words[s:s + PIECE + width - 1]) for s in starts]
                if pieces:
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(pieces), pa.string()), pa.array(pieces, pa.binary())], names=["name", "piece"])

    items = benchmark.select(F.col("item_id").cast("string").alias("name"), F.col("text").cast("binary").alias("text"))
    pieces = items.mapInArrow(cut, "name string, piece binary").distinct()
    total = pieces.agg(F.sum(F.length("piece"))).first()[0] or 0
    count = -(-total // BLOCK_BYTES)
    for block in range(count):
        rows = pieces.where(F.pmod(F.xxhash64("name", "piece"), F.lit(count)) == block).collect()
        yield phrases_of([(r["name"], bytes(r["piece"]).split()) for r in rows], width)


@dataclass
class Shard:
    """Words of some texts as symbols: 1 is whatever stands between two words that phrases have, once."""

    symbols: np.ndarray
    text: np.ndarray  # which text a symbol belongs to, and which word of it it is
    word: np.ndarray


def _shard(coded: list[np.ndarray]) -> Shard:
    ends = np.cumsum([len(c) + 1 for c in coded])
    symbols = np.ones(ends[-1], np.int64)
    text = np.repeat(np.arange(len(coded)), [len(c) + 1 for c in coded])
    for c, end in zip(coded, ends):
        symbols[end - len(c) - 1:end - 1] = np.maximum(c, 1)
    word = np.arange(len(symbols)) - (ends - [len(c) + 1 for c in coded])[text]
    keep = symbols > 1
    keep[1:] |= symbols[:-1] > 1
    return Shard(symbols[keep], text[keep], word[keep])


def _search(shard: Shard, phrases: Phrases) -> tuple[list[tuple[int, int, int]], dict[int, set[int]]]:
    """Merged hit runs (text, first word, end word) of a shard, and the items that occur in each text."""
    n = len(shard.symbols)
    change = np.zeros(n + 1, np.int64)
    by_text: dict[int, set[int]] = {}
    index = FMIndex(shard.symbols, len(phrases.words) + 2)
    for table, starts, items in zip(phrases.tables, phrases.starts, phrases.items):
        low, high = index.intervals(table)
        phrase, ranks = spread_ranges(low, high)
        at = index.positions_of(ranks)
        change[at] += 1  # one phrase of a length begins at a position
        change[at + table.shape[1]] -= 1
        pairs = np.unique(shard.text[at] * len(table) + phrase)
        text, phrase = pairs // len(table), pairs % len(table)
        owner, place = spread_ranges(starts[phrase], starts[phrase + 1])
        for t, i in np.unique(np.stack([text[owner], items[place]], axis=1), axis=0).tolist():
            by_text.setdefault(t, set()).add(i)
    hit = np.concatenate([[0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(hit)).reshape(-1, 2)
    return [(int(shard.text[a]), int(shard.word[a]), int(shard.word[b - 1]) + 1) for a, b in edges], by_text


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _scanned(rows: DataFrame, phrases: Phrases) -> DataFrame:
    """``rows`` with the hits of one block of phrases added to columns ``runs`` and ``items``."""
    shared = rows.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        number = phrases.words.get
        for batch in batches:
            coded, counts, held, first = [], [], 0, 0
            runs = [[tuple(x.values()) for x in r] for r in batch["runs"].to_pylist()]
            items = [set(i) for i in batch["items"].to_pylist()]

            def flush() -> None:
                nonlocal coded, held, first
                hits, found = _search(_shard(coded), phrases) if coded else ([], {})
                for t, a, b in hits:
                    runs[first + t].append((a, b))
                for t, names in found.items():
                    items[first + t].update(phrases.names[i] for i in names)
                first, coded, held = first + len(coded), [], 0

            for text in batch["_text"]:
                words = words_of(text.as_py())
                counts.append(len(words))
                coded.append(np.fromiter(map(number, words, repeat(0)), np.int32, len(words)))
                held += len(words)
                if held >= SHARD_WORDS:
                    flush()
            flush()
            done = [[{"first": a, "end": b} for a, b in _merged(r)] for r in runs]
            yield pa.RecordBatch.from_arrays(
                [batch["_row"], batch["_text"], pa.array(counts, pa.int64()), pa.array(done, batch.schema.field("runs").type),
                 pa.array([sorted(i) for i in items], pa.list_(pa.string()))], names=["_row", "_text", "n_words", "runs", "items"])

    return rows.mapInArrow(run, rows.schema)


def _found(docs: DataFrame, benchmark: DataFrame, width: int, carry: list[str]) -> DataFrame:
    """_row (struct of ``carry``), _text, n_words, runs of hit words and items of every row."""
    rows = docs.select(F.struct(*carry).alias("_row"), F.col("text").cast("binary").alias("_text")).selectExpr(
        "_row", "_text", "0L AS n_words", "CAST(array() AS array<struct<first:bigint,end:bigint>>) AS runs", "CAST(array() AS array<string>) AS items")
    some = False
    for phrases in _blocks(benchmark, width):
        rows, some = _scanned(rows, phrases), True
    return rows if some else _scanned(rows, phrases_of([], width))


def _places(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Bytes from the first to the last word of each run of words."""
    words = [m.span() for m in _WORD.finditer(text)] if runs else []
    return [(words[a][0], words[b - 1][1]) for a, b in runs]


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids as sorted strings), items_sha256, spans and contaminated of every row.

    Needs doc_id and text of ``docs``, item_id and text of ``benchmark``; other columns are ignored. Words are runs
    of digits, letters and characters beyond ASCII, only A-Z lower-cased. A phrase is ``width`` words of an item in a
    row, or all words of an item that has fewer. A word of a document inside any occurrence of a phrase is hit;
    ``spans`` are the (start, end) code points from the first to the last word of each run of hit words. Null and
    empty texts have no words; an item without words has no phrases; equal item_ids are one item, and the phrases of
    items whose item_id is null count as hits but are not listed. Rows stay as they are, repeated ones and null
    doc_ids too. Empty tables give no rows or no hits.

    Each shard of texts (``SHARD_WORDS`` words, or one longer text) is indexed whole: words that no phrase has cannot
    be hit, so that each run of them is one separator. Nothing is shuffled but the items; the phrases are broadcast in
    blocks of ``BLOCK_BYTES``, and every block scans the rows once.
    """

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [[tuple(x.values()) for x in r] for r in batch["runs"].to_pylist()]
            spans = []
            for text, own in zip(batch["_text"], runs):
                starts = np.zeros(0)
                if own:
                    text = text.as_py()
                    starts = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                spans.append([{"start": int(starts[a]), "end": int(starts[b])} for a, b in _places(text, own)] if own else [])
            items = batch["items"].to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch["_row"].field("doc_id"), batch["n_words"], pa.array([sum(b - a for a, b in r) for r in runs], pa.int64()),
                 pa.array([len(i) for i in items], pa.int64()), batch["items"],
                 pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array([bool(r) for r in runs], pa.bool_())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items", "items_sha256", "spans", "contaminated"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _found(docs, benchmark, width, ["doc_id"]).mapInArrow(
        placed, f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items array<string>, items_sha256 string, "
        "spans array<struct<start:bigint,end:bigint>>, contaminated boolean")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with the spans of ``contamination`` cut out of text, all columns and rows kept; null stays null."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, own in zip(batch["_text"].to_pylist(), batch["runs"].to_pylist()):
                at = 0
                parts = []
                for a, b in _places(text, [tuple(x.values()) for x in own]) if own else ():
                    parts.append(text[at:a])
                    at = b
                texts.append(b"".join([*parts, text[at:]]) if own else text)
            yield pa.RecordBatch.from_arrays([batch["_row"], pa.array(texts, pa.binary())], names=["_row", "_text"])

    columns = [f"`{c}`" for c in docs.columns]
    found = _found(docs, benchmark, width, columns)
    rows = found.mapInArrow(cut, found.select("_row", "_text").schema)
    return rows.select(*(F.col("_text").cast("string").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns))
