"""Fill-in-the-middle transformation over seekable compressed frames."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a frame, about: a frame ends at the first whole character from there on.
FRAME_BYTES = 16 * 1024
LEVEL = 1
#: Share of documents, in percent, that are transformed, and of those the share with the suffix first.
TRANSFORMED = 90
SUFFIX_FIRST = 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Output texts that are handed back at once, in bytes.
BATCH_BYTES = 16 * 1024 * 1024

_FRAMES = pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("data", pa.binary())]))
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def unit_starts(text: np.ndarray, inside: bool = False) -> np.ndarray:
    """True at each byte that begins a unit: a run of letters A-Z and a-z, or any other character. ``inside`` says
    that the byte before ``text`` is such a letter."""
    letter = _LETTER[text]
    before = np.concatenate([[inside], letter[:-1]]) if len(text) else letter
    return np.where(letter, ~before, (text & 0xC0) != 0x80)


def frames_of(text: bytes, size: int = FRAME_BYTES) -> list[dict]:
    """Independent zstandard frames of ``text`` in order, each with the units and characters that begin before it; a
    last frame without data has those of the whole text."""
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    data = np.frombuffer(text, np.uint8)
    units = np.concatenate([[0], np.cumsum(unit_starts(data))])
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        out.append({"units": int(units[start]), "chars": int(chars[start]), "data": compress(text[start:end])})
        start = end
    return [*out, {"units": int(units[-1]), "chars": int(chars[-1]), "data": b""}]


class Frames:
    """A stored text: places are found by the counts, and only the frames that are asked for are decompressed."""

    def __init__(self, frames: list[dict]):
        self.frames = frames
        self.units = [f["units"] for f in frames]
        self.open = zstandard.ZstdDecompressor().decompress

    def data(self, i: int) -> bytes:
        return self.open(self.frames[i]["data"]) if i < len(self.frames) - 1 else b""

    def place(self, unit: int) -> tuple[int, int, int]:
        """(frame, byte in it, characters before) where ``unit`` begins; the number of all units gives the end."""
        if unit >= self.units[-1]:
            return len(self.frames) - 1, 0, self.frames[-1]["chars"]
        i = bisect_right(self.units, unit) - 1  # the last frame before which that many units begin: it begins in there
        data = np.frombuffer(self.data(i), np.uint8)
        inside = int(unit_starts(data).sum()) > self.units[i + 1] - self.units[i]  # its first letters go on with a unit
        at = int(np.flatnonzero(unit_starts(data, inside))[unit - self.units[i]])
        return i, at, self.frames[i]["chars"] + int(((data[:at] & 0xC0) != 0x80).sum())

    def stream(self, start: tuple[int, int, int], end: tuple[int, int, int]) -> Iterator[bytes]:
        """The text between two places, frame by frame."""
        for i in range(start[0], end[0] + 1):
            data = self.data(i)
            yield data[start[1] if i == start[0] else 0:end[1] if i == end[0] else None]

    def holds(self, *marks: str) -> bool:
        """True if some mark is in the text, across frames too."""
        wanted = [m.encode() for m in marks]
        tail, longest = b"", max(map(len, wanted)) - 1
        for i in range(len(self.frames) - 1):
            data = tail + self.data(i)
            if any(m in data for m in wanted):
                return True
            tail = data[-longest:]
        return False


def draws(doc_id: str, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers of a document: the first digits of the SHA-256 of seed and id."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def store_frames(docs: DataFrame, size: int = FRAME_BYTES) -> DataFrame:
    """doc_id and frames (array of units, chars, data) of every row: its text in independent zstandard frames of
    ``size`` bytes, with the units and characters before each. Null counts as empty and has the closing frame alone.
    Written as Parquet, the rows serve any number of draws. Rows stay as they are; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames = [frames_of(t.as_py() or b"", size) for t in batch["_text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(frames, _FRAMES)], names=["doc_id", "frames"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("_text")).mapInArrow(
        run, f"doc_id {kind}, frames array<struct<units:bigint,chars:bigint,data:binary>>")


def _formed(stored: Frames, doc_id: str, seed: int) -> tuple[str, int | None, int | None, Iterator[bytes]]:
    """Form, characters of prefix and middle, and the output as a stream."""
    n = stored.units[-1]
    h1, h2, h3, h4 = draws(doc_id, seed)
    first, last = (0, 0, 0), stored.place(n)
    if n == 0 or h3 % 100 >= TRANSFORMED or stored.holds(PREFIX, SUFFIX, MIDDLE):
        return "plain", None, None, stored.stream(first, last)
    a, b = (stored.place(cut) for cut in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, suffix = (PREFIX, first, a), (SUFFIX, b, last)
    form, parts = ("spm", (suffix, prefix)) if h4 % 100 < SUFFIX_FIRST else ("psm", (prefix, suffix))

    def output() -> Iterator[bytes]:
        for mark, start, end in (*parts, (MIDDLE, a, b)):
            yield mark.encode()
            yield from stored.stream(start, end)

    return form, a[2], b[2] - a[2], output()


def fill_in_middle(frames: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output and output_sha256 of every row of ``store_frames``.

    A text is cut at two units drawn from doc_id and ``seed`` into prefix, middle and suffix. ``form`` is plain (the
    text itself, no lengths) for texts that are empty or hold a mark and for the drawn tenth; else spm (suffix first)
    for the drawn fifth and psm for the rest. Only the frames of the two cuts are read to find them; digest and output
    are streamed over the frames in order. A null doc_id draws as the empty string. Rows stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, name, frames in zip(batch["doc_id"], batch["_name"], batch["frames"]):
                stored = Frames(frames.as_py())
                form, prefix, middle, parts = _formed(stored, name.as_py() or "", seed)
                digest, output = hashlib.sha256(), bytearray()
                for part in parts:
                    digest.update(part)
                    output += part
                rows.append((doc_id, stored.units[-1], form, prefix, middle, bytes(output), digest.hexdigest()))
                held += len(output)
                if held >= BATCH_BYTES:
                    yield as_batch(rows, batch.schema.field("doc_id").type)
                    rows, held = [], 0
            yield as_batch(rows, batch.schema.field("doc_id").type)

    def as_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        columns = [pa.array([r[i].as_py() if i == 0 else r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])

    kind = frames.schema["doc_id"].dataType.simpleString()
    done = frames.select("doc_id", F.col("doc_id").cast("string").alias("_name"), "frames").mapInArrow(
        run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary, output_sha256 string")
    return done.withColumn("output", F.col("output").cast("string"))


def restore(output: Column, form: Column) -> Column:
    """The text of an output: the parts between its marks, put in their first order."""
    between = lambda start, end: F.substring(output, start, end - start)
    p, s, m = (F.locate(mark, output) for mark in (PREFIX, SUFFIX, MIDDLE))
    middle = between(m + len(MIDDLE), F.length(output) + 1)
    psm = F.concat(between(p + len(PREFIX), s), middle, between(s + len(SUFFIX), m))
    spm = F.concat(between(p + len(PREFIX), m), middle, between(s + len(SUFFIX), p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
