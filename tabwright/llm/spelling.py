"""Spelling variants of the corpus vocabulary by search schemes on bidirectional FM-indexes."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import kept, runs_of_key
from tabwright.llm.fm_index import BothWays

LEAST_CHARS = 7
LEAST_COUNT = 2
#: A run whose hash this number divides loses a letter.
SLIP = 31
#: A form must be this many times as frequent as the word.
RATIO = 10
#: Words of one index; a group of words of equal length and half beyond this is split over several.
BLOCK = 8_000
#: Distinct words that a task counts before it hands the counts on, and queries that are searched at once.
HELD = 400_000
QUERIES_AT_ONCE = 4096

_LOWER = {c: c + 32 for c in range(65, 91)}
_END = 1


def vocabulary(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n: runs of letters (A-Z, a-z, U+00C0 to U+00FF) of all texts with A-Z lower-cased, counted.

    A run whose CRC-32 with its doc_id in front is a multiple of ``SLIP`` loses the character at that number modulo
    its length. Results shorter than ``least_chars`` or rarer than ``least_count`` are left out. Null texts have no
    runs; a null doc_id reads as the empty string; repeated rows count again."""
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least_chars},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch["name"], batch["text"]):
                start = zlib.crc32(f"{name.as_py() or ''}:".encode())
                for word, n in Counter(runs.findall(text.as_py() or "")).items():
                    word = word.lower() if word.isascii() else word.translate(_LOWER)
                    h = zlib.crc32(word.encode(), start)
                    if h % SLIP == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least_chars:
                            continue
                    held[word] += n
            if len(held) >= HELD:
                yield counts(held)
                held.clear()
        yield counts(held)

    def counts(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    found = docs.select(F.col("doc_id").cast("string").alias("name"), "text").mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class WordIndex:
    """Bidirectional index of delimited words (ascending, distinct, of Latin-1 characters)."""

    def __init__(self, words: list[str]):
        self.raw = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("latin-1"), np.uint8)
        self.starts = np.flatnonzero(self.raw == 10)[:-1] + 1
        used = np.unique(self.raw)  # the line break is the smallest
        self.code = np.full(256, -1)
        self.code[used] = np.arange(len(used)) + _END
        self.index = BothWays(self.code[self.raw], len(used) + 1)

    def _extended(self, state, symbol: np.ndarray, right: bool):
        """The states that go on with a symbol, and which those are."""
        known = np.flatnonzero(symbol >= 0)
        state = self.index.extend(tuple(x[known] for x in state), symbol[known], right)
        alive = np.flatnonzero(state[2] > 0)
        return tuple(x[alive] for x in state), known[alive]

    def near(self, queries: list[str], kind: str, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of the words one error of ``kind`` away from a query; the queries have one length.

        ``right``: the first half matches exactly, from the middle to the delimiter before it, and the second half is
        extended with the error. Else the second half matches exactly with the delimiter after it, and the first half
        is extended to the left; pairs that also share the first half are left out there. Each pair comes once."""
        raw = np.frombuffer("".join(queries).encode("latin-1"), np.uint8).reshape(len(queries), -1)
        letters, half = self.code[raw], raw.shape[1] // 2
        first, second = letters[:, :half][:, ::-1], letters[:, half:]  # from the middle outward
        exact, rest = (first, second) if right else (second, first)
        end = np.full((len(queries), 1), _END)
        state, q = self.index.start(len(queries)), np.arange(len(queries))
        for symbol in np.hstack([exact, end]).T:
            state, alive = self._extended(state, symbol[q], not right)
            q = q[alive]
        rest = np.hstack([rest, end])
        last = rest.shape[1] - 1
        branches = []
        for k in range(last + 1):  # the error comes after k exact letters; of equal results only the outermost is taken
            if kind == "insert" or kind == "replace" and k < last:
                owner, symbol, each = self.index.extend_by_each(state, right)
                fine = (symbol > _END) & (symbol != rest[q[owner], k])
                branches.append((*(x[fine] for x in each), q[owner[fine]], np.full(fine.sum(), k + (kind == "replace"))))
            elif k < last:
                fine = rest[q, k] != rest[q, k + 1]
                branches.append((*(x[fine] for x in state), q[fine], np.full(fine.sum(), k + 1)))
            state, alive = self._extended(state, rest[q, k], right)
            q = q[alive]
        *state, q, used = (np.concatenate(b) for b in zip(*branches))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(q):  # the remaining letters and the delimiter, exactly
            state, alive = self._extended(state, rest[q, used], right)
            q, used = q[alive], used[alive] + 1
            closed = used > last
            found.append((q[closed], state[0][closed]))
            state, q, used = tuple(x[~closed] for x in state), q[~closed], used[~closed]
        query = np.concatenate([f[0] for f in found]) if found else np.zeros(0, int)
        # among the suffixes that begin with a delimiter, the last of all is first, then the words follow in order
        word = np.concatenate([f[1] for f in found]) - 2 if found else np.zeros(0, int)
        if not right:
            same = np.ones(len(query), bool)
            for j in range(half):
                same &= self.raw[self.starts[word] + j] == raw[query, j]
            query, word = query[~same], word[~same]
        return query, word


#: Error that leads from a query to a word of so many characters more.
ERRORS = {-1: "delete", 0: "replace", 1: "insert"}


def _groups(words: DataFrame, more: int, right: bool) -> DataFrame:
    """Where the near words of ``more`` characters more than each word are kept: by their length, and by what a query
    of that length or one character less or more is sure to share with them, the least exact half."""
    length = F.length("word") + more
    share = F.floor((length - 1) / 2) if right else F.floor(length / 2)
    part = F.substring(F.col("word"), F.lit(1), share.cast("int")) if right else F.substring(F.col("word"), (F.length("word") - share + 1).cast("int"), share.cast("int"))
    return words.select("word", "n", F.lit(right).alias("right"), length.alias("length"), part.alias("part"), F.lit(more).alias("more"))


def _near_counts(words: DataFrame, shards: int) -> DataFrame:
    """word, n_near and best (struct of -n and word) per index that a word was searched in."""
    members = _groups(words, 0, True).unionByName(_groups(words, 0, False))
    group = ["right", "length", "part"]
    hot = F.broadcast(members.groupBy(*group).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK).select(
        *group, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))  # at most a row for BLOCK / 2 words
    asked = None
    for more in ERRORS:
        for right in (True, False):
            queries = _groups(words, more, right).where(F.col("length") >= LEAST_CHARS)
            asked = queries if asked is None else asked.unionByName(queries)
    blocks = F.coalesce("blocks", F.lit(1))
    own = members.join(hot, group, "left").withColumn("block", F.pmod(F.xxhash64("word"), blocks).cast("int")).withColumn("query", F.lit(False))
    sent = asked.join(hot, group, "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("query", F.lit(True))
    shard = F.pmod(F.xxhash64(*group, "block"), F.lit(shards)) * 2 + F.col("right").cast("int")
    rows = own.unionByName(sent).select(shard.alias("shard"), "right", "query", "more", "word", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of_key(batches, "shard"):
            own = table.filter(pa.compute.invert(table["query"]))
            if not own.num_rows:
                continue
            words = sorted(zip(own["word"].to_pylist(), own["n"].to_pylist()))
            index, counts = WordIndex([w for w, _ in words]), np.array([n for _, n in words])
            right = own["right"][0].as_py()
            asked: dict[tuple[int, int], set[str]] = {}
            sent = table.filter(table["query"])
            for word, more in zip(sent["word"].to_pylist(), sent["more"].to_pylist()):
                asked.setdefault((len(word), more), set()).add(word)
            for (_, more), queries in sorted(asked.items()):
                queries = list(queries)
                for s in range(0, len(queries), QUERIES_AT_ONCE):
                    part = queries[s:s + QUERIES_AT_ONCE]
                    q, w = index.near(part, ERRORS[more], right)
                    by = np.lexsort((w, -counts[w], q))
                    q, w = q[by], w[by]
                    found, start, near = np.unique(q, return_index=True, return_counts=True)
                    best = [{"less": -int(counts[i]), "word": words[i][0]} for i in w[start]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part[i] for i in found], pa.string()), pa.array(near, pa.int64()),
                         pa.array(best, pa.struct([("less", pa.int64()), ("word", pa.string())]))], names=["word", "n_near", "best"])

    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "word string, n_near bigint, best struct<less:bigint,word:string>")


def _roots(links: DataFrame) -> DataFrame:
    """word and root of every (word, form): the last form of the chain, by doubling the steps until none goes further."""
    reached = kept(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reached = kept(reached.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not reached.where("moved").limit(1).count():
            return reached.select("word", "root")
        reached = reached.select("word", "root")


def spelling_groups(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``vocabulary``.

    Two words are near if they differ by exactly one inserted, deleted or replaced character. The form of a word is
    its most frequent near word (ties: the smallest in code-point order) if that is at least ``RATIO`` times as
    frequent, else null; the root is the last of a chain of forms, or the word itself. Needs doc_id and text, other
    columns are ignored; see ``vocabulary`` for nulls and repeated rows. Texts without such words give no rows.

    One error leaves one half of a word whole. So words are kept by length and the least half they share with a near
    word, in indexes of about ``BLOCK`` words; each word is sent to the indexes of its two halves and of the three
    lengths. A group of more words is split and its queries go to every part. No pair is written out: each index gives
    a word's number of near words in it and the best of them.
    """
    words = kept(vocabulary(docs), "words")
    shards = max(1, -(-2 * words.count() // BLOCK))
    near = _near_counts(words, shards)
    rows = words.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("struct<less:bigint,word:string>").alias("best")).unionByName(
        near.select("word", F.lit(None).cast("bigint").alias("n"), "n_near", "best"))
    best = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    much = F.coalesce(-F.col("best.less") >= RATIO * F.col("n"), F.lit(False))
    formed = kept(best.select("word", F.when(much, F.col("best.word")).alias("form"), "n", "n_near", F.when(much, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
