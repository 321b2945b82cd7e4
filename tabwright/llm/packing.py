"""Best-fit packing of token sequences, planned over the histogram of lengths."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.bpe import byte_alphabet
from tabwright.llm.common import claim, give_back, kept, map_texts, text_or_empty
from tabwright.session import fits, local_table

#: Rows (partition, length, offset) that may be broadcast: 24 bytes each.
BROADCAST_ROWS = 1_000_000

#: Chunks (a word with its space and marks) and their words whose ids a Python worker remembers, about 180 bytes each.
CACHED_CHUNKS = 300_000
#: The last so many of them are left to chunks that come again.
FOR_REPEATED = 100_000
#: Characters of the longest chunk that is remembered.
LONGEST_CHUNK = 100
#: Places of a table that says which chunks came before; it is emptied when half of it is used.
SEEN_PLACES = 1 << 22
#: Bytes of texts that are cut into chunks at once: the chunks of a text take ten times its room.
TEXT_BYTES = 256 * 1024

#: Marks that are a word of their own behind letters.
_MARKS = {".", ",", ";", ":", "!", "?"}
_OTHER = re.compile("[^\t-\r\x20-\x7e\xa0-ɏ]")


class ByteCoder:
    """Encoder for a byte-level BPE file whose words begin with their space; ids as little-endian unsigned 32 bits."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.space = self.alphabet[ord(" ")]
        self.as_bytes = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size())]
        self.pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
        self.chunks: dict[str, bytes] = {}  # and words: a chunk without marks is one
        self.seen, self.used = bytearray(SEEN_PLACES), 0

    def _ids(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            symbols = word.replace(" ", self.space)  # every other printable byte stands for itself
        else:
            symbols = word.encode().decode("latin-1").translate(self.alphabet)
        return b"".join([self.as_bytes[t.id] for t in self.model.tokenize(symbols)])

    def _words(self, chunk: str) -> list[str]:
        core = chunk.removeprefix(" ")
        if core.isalpha():
            return [chunk]
        if core[-1:] in _MARKS and core[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.pieces.findall(chunk)

    def _learn(self, new: set[str]) -> list[str]:
        """Add ``new`` chunks and their words to ``chunks``; returns those that were added."""
        known, added = self.chunks, []
        for chunk in new:
            if chunk not in known:  # else it is a word of an earlier one
                words = self._words(chunk)
                for word in words:
                    if word not in known:
                        known[word] = self._ids(word)
                        added.append(word)
                if len(words) > 1:
                    known[chunk] = b"".join([known[word] for word in words])
                    added.append(chunk)
        return added

    def _forget(self, added: list[str]) -> None:
        """Take chunks out again, but for those that are to stay: where places are few, only a chunk stays that, or
        one of its hash, came before. Most come once, and would leave no room for the others."""
        known, seen = self.chunks, self.seen
        room = CACHED_CHUNKS - len(known) + len(added)
        for chunk in added:
            place = hash(chunk) % SEEN_PLACES
            if len(chunk) <= LONGEST_CHUNK and room > (0 if seen[place] else FOR_REPEATED):
                room -= 1
            else:
                del known[chunk]
                if not seen[place]:
                    seen[place] = 1
                    self.used += 1
        if self.used > SEEN_PLACES // 2:
            self.seen, self.used = bytearray(SEEN_PLACES), 0

    def encode(self, batch: list[str]) -> list[bytes]:
        """A single space between other characters always starts a word, so a text with no doubled or outer spaces
        is cut there and each distinct chunk is encoded once; any other text goes to the tokenizer as it is."""
        split = []
        for t in batch:
            plain = t and "  " not in t and t[0] != " " and t[-1] != " " and not _OTHER.search(t) and not any(s in t for s in self.special)
            split.append(t.replace(" ", "\0 ").split("\0") if plain else None)
        known = self.chunks
        added = self._learn({c for c in set().union(*(c for c in split if c)) if c not in known})
        out = [b"".join(map(known.__getitem__, chunks)) if chunks else self._whole(t) for t, chunks in zip(batch, split)]
        self._forget(added)
        return out

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def byte_coder(path: str) -> ByteCoder:
    return ByteCoder(path)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in runs of at most ``TEXT_BYTES`` of text; a longer text is a run of its own."""
    ends = np.cumsum(pc.binary_length(batch["_text"]).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        upto = max(start + 1, int(np.searchsorted(ends, before + TEXT_BYTES, "right")))
        yield batch.slice(start, upto - start)
        start = upto


def token_pieces(docs: DataFrame, path: str, size: int = 2048, closing_id: int = 0) -> DataFrame:
    """Pieces of at most ``size`` ids: doc_id, piece, start, length, ids, and the place of the piece among those of
    its length in its partition (part, nth). A document is its ids and then ``closing_id``; only a longer one is
    cut, so that all its pieces but the first are full."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        claim("bytes", byte_coder.cache_clear)
        part = TaskContext.get().partitionId()
        coder, seen = byte_coder(path), np.zeros(size + 1, dtype=np.int64)
        closing = closing_id.to_bytes(4, "little")
        for batch in batches:
            for rows in _slices(batch):
                index, out = [], []
                for i, ids in enumerate(coder.encode(rows["_text"].to_pylist())):
                    ids += closing
                    n = len(ids) // 4
                    bounds = [0, *range(n % size or min(n, size), n + 1, size)]
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        index.append(i)
                        out.append((k, a, b - a, ids[4 * a:4 * b], part, int(seen[b - a])))
                        seen[b - a] += 1
                columns = list(zip(*out))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"].take(pa.array(index)), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                    names=["doc_id", "piece", "start", "length", "ids", "part", "nth"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(
        docs.select("doc_id", text_or_empty().alias("_text")), pieces, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary, part int, nth bigint")


def best_fit_plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit-decreasing over counts: (length, first, last, per_bin, bin, offset).

    The pieces of ``length`` ranked first..last (inclusive) fill bins from ``bin`` on, ``per_bin`` in each from
    ``offset`` on. Bins of equal history are handled as one range, so the work and the plan grow with the number
    of lengths, not with the number of pieces."""
    open_bins: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges (first bin, bins)
    plan, bins = [], 0

    def put(length: int, rank: int, left: int, first: int, n: int, room: int) -> int:
        """Fill bins of one range with the next pieces; returns how many pieces went in."""
        each = min(room // length, left)
        full = min(n, left // each)
        plan.append((length, rank, rank + full * each - 1, each, first, size - room))
        open_bins.setdefault(room - each * length, []).append((first, full))
        if full < n:
            open_bins.setdefault(room, []).append((first + full, n - full))
        return full * each

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = min((r for r in open_bins if r >= length), default=None)
            if room is None:
                each = min(size // length, left)
                fresh = left // each
                first, n, room = bins, fresh, size
                bins += fresh
            else:
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
            done = put(length, rank, left, first, n, room)
            rank, left = rank + done, left - done
    return plan


def pack(docs: DataFrame, path: str, size: int = 2048, closing_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id and offset of every piece of ``docs``.

    Null text counts as empty (one closing id). Repeated rows and null doc_ids are packed as they come; other
    columns are ignored; no rows give no rows. Only the count of each length reaches the driver (``size`` numbers
    at most) and only the plan leaves it. The rank of a piece within its length is its place in its own partition
    plus the counts of earlier partitions, so pieces are written once and never shuffled for it.
    """
    spark = docs.sparkSession
    pieces = kept(token_pieces(docs, path, size, closing_id), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept(counts.select("part", "length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")), "offsets")
    if fits(offsets, BROADCAST_ROWS):
        offsets = F.broadcast(offsets)
    ranked = pieces.join(offsets, ["part", "length"]).withColumn("_rank", F.col("_before") + F.col("nth"))
    totals = {r["length"]: r["_n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("_n")).collect()}
    plan = local_table(spark, best_fit_plan(totals, size), "_length bigint, _first bigint, _last bigint, _each bigint, _bin bigint, _offset bigint")
    nth = F.col("_rank") - F.col("_first")
    return ranked.join(F.broadcast(plan), (F.col("length") == F.col("_length")) & F.col("_rank").between(F.col("_first"), F.col("_last"))).select(
        "doc_id", "piece", "start", "length", "ids",
        (F.col("_bin") + F.floor(nth / F.col("_each"))).cast("bigint").alias("sequence_id"),
        (F.col("_offset") + (nth % F.col("_each")) * F.col("length")).alias("offset"))
