"""Chat formatting: a hidden Markov model over speaker markers and line features, decoded by Viterbi in chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import kept, runs_of_key, text_or_empty

#: Names that speakers go by in transcripts, per role.
ALIASES = {
    "system": ["system", "instruction", "instructions"],
    "user": ["user", "human", "prompter", "question", "q"],
    "assistant": ["assistant", "bot", "ai", "gpt", "model", "answer", "a"],
    "tool": ["tool", "function"],
}
ROLES = list(ALIASES)
_ROLE = {name: i for i, names in enumerate(ALIASES.values()) for name in names}
MARKER = re.compile(r"^\s*(?:<\|(\w+)\|>:?|\[(\w+)\]:?|(?:#+\s*|\*\*)?(\w+)(?:\*\*)?\s*:)\s*", re.A)
#: Turns of a conversation that are decoded together.
CHUNK = 512
#: P(the speaker named is the speaker), P(the next line of a row is the same speaker's).
TRUSTED = 0.995
STAYS = 0.995
_NO_TURN = -1


def marker_of(line: str) -> tuple[int, int]:
    """Role number of a leading speaker marker and where the line's own text begins; (-1, 0) without one."""
    m = MARKER.match(line)
    role = _ROLE.get((m[1] or m[2] or m[3]).lower(), -1) if m else -1
    return (role, m.end()) if role >= 0 else (-1, 0)


def feature_of(line: str) -> int:
    """Class of a line by length, question mark and shape: 0 to 23."""
    text = line.strip()
    size = sum(len(text) > n for n in (0, 40, 120, 300, 800))
    return size * 4 + 2 * text.endswith("?") + bool(re.match(r"([-*•>]|\d+[.)]|```|    )", line))


FEATURES = 24


@dataclass
class ChatModel:
    """Log probabilities: a line feature given its role, a row's role given the role before, the first role."""

    feature: np.ndarray
    turn: np.ndarray
    first: np.ndarray


def _lines(text: str) -> list[str]:
    return text.split("\n")


def _prepared(turns: DataFrame) -> DataFrame:
    """Distinct rows with a chunk key: conversation and block of turns. Null turns come first."""
    place = F.coalesce(F.col("turn").cast("bigint"), F.lit(_NO_TURN))
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"),
        text_or_empty().alias("text"), place.alias("place"), F.floor(place / F.lit(CHUNK)).cast("bigint").alias("chunk")).distinct()
    return rows.withColumn("key", F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.col("chunk").cast("string")))


def role_number(role: Column) -> Column:
    names = F.lower(F.trim(role))
    return F.coalesce(*(F.when(names.isin(ALIASES[r]), F.lit(i)) for i, r in enumerate(ROLES)), F.lit(-1))


def fit_chat_model(turns: DataFrame) -> ChatModel:
    """Counts over all rows whose role is known, plus one each; changes of role are counted between all neighbouring
    rows of a conversation, within blocks of ``CHUNK`` turns and then from the last row of a block to the first of the
    next. A few hundred counts reach the driver."""
    rows = _prepared(turns).withColumn("r", role_number(F.col("role")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(ROLES), FEATURES), np.int64)
        for batch in batches:
            for r, text in zip(batch["r"].to_pylist(), batch["text"].to_pylist()):
                for line in _lines(text):
                    n[r, feature_of(line[marker_of(line)[1]:])] += 1
        r, f = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(f, pa.int32()), pa.array(n[r, f], pa.int64())], names=["r", "f", "n"])

    feature = np.ones((len(ROLES), FEATURES))
    for x in rows.where("r >= 0").select("r", "text").mapInArrow(counted, "r int, f int, n bigint").groupBy("r", "f").agg(F.sum("n").alias("n")).collect():
        feature[x["r"], x["f"]] += x["n"]
    turn, first = np.ones((len(ROLES), len(ROLES))), np.ones(len(ROLES))
    before = Window.partitionBy("key").orderBy("place", "text", "role")
    moves = rows.withColumn("was", F.lag("r").over(before)).where("r >= 0 and was >= 0").select("was", "r")
    row = F.struct("place", "text", "role", "r")
    edges = rows.groupBy("conv_id", "chunk").agg(F.min(row).alias("head"), F.max(row).alias("last"))
    blocks = Window.partitionBy("conv_id").orderBy("chunk")  # a row per block
    over = edges.select(F.lag("last.r").over(blocks).alias("was"), F.col("head.r").alias("r")).where("r >= 0 and (was is null or was >= 0)")
    for x in moves.unionByName(over).groupBy("was", "r").agg(F.count(F.lit(1)).alias("n")).collect():
        if x["was"] is None:
            first[x["r"]] += x["n"]
        else:
            turn[x["was"], x["r"]] += x["n"]
    log = lambda a: np.log(a / a.sum(axis=-1, keepdims=True))
    return ChatModel(log(feature), log(turn), log(first))


def _observed(group: pa.Table, model: ChatModel) -> tuple[list, np.ndarray, list]:
    """Lines (row, text) of a chunk in order, their log likelihoods per role, and the matrix into each line."""
    rows = sorted(group.to_pylist(), key=lambda r: (r["place"], r["text"], r["role"] or ""))
    lines, scores, moves = [], [], []
    n = len(ROLES)
    same = np.full((n, n), np.log((1 - STAYS) / (n - 1)))
    np.fill_diagonal(same, np.log(STAYS))
    for row in rows:
        named = _ROLE.get((row["role"] or "").strip().lower(), -1)
        for k, line in enumerate(_lines(row["text"])):
            role, start = marker_of(line)
            if role < 0 and k == 0:
                role, start = named, 0
            score = model.feature[:, feature_of(line[start:])].copy()
            if role >= 0:
                score += np.where(np.arange(n) == role, np.log(TRUSTED), np.log((1 - TRUSTED) / (n - 1)))
            lines.append((row, line[start:]))
            scores.append(score)
            moves.append(model.turn if k == 0 or role >= 0 else same)
    return lines, np.array(scores), moves


def _through(scores: np.ndarray, moves: list, first: np.ndarray | None) -> np.ndarray:
    """Best log weight from each role before the chunk to each role at its end; from one start where ``first`` is given."""
    best = np.full((len(ROLES), len(ROLES)), -np.inf)
    np.fill_diagonal(best, 0.0)
    for i, (s, move) in enumerate(zip(scores, moves)):
        if i == 0 and first is not None:
            best = np.tile(first + s, (len(ROLES), 1))
        else:
            best = (best[:, :, None] + move[None]).max(axis=1) + s
    return best


def _path(scores: np.ndarray, moves: list, first: np.ndarray | None, entry: int, exit_: int) -> list[int]:
    """Viterbi between a known role before the chunk (none at the start of a conversation) and its last role."""
    at = first + scores[0] if first is not None else moves[0][entry] + scores[0]
    back = []
    for s, move in zip(scores[1:], moves[1:]):
        step = at[:, None] + move
        back.append(step.argmax(axis=0))
        at = step.max(axis=0) + s
    path = [exit_]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def format_chat(turns: DataFrame, model: ChatModel | None = None) -> DataFrame:
    """Canonical rendering of transcripts: conv_id, turn, part, role, opens and rendered.

    ``turns`` has conv_id, turn, role and text; other columns are ignored. The role column, where it names a known
    speaker, is a marker before the row's first line, and so is a leading 'Name:', '[name]' or '<|name|>' in any
    line; markers are trusted but not certain. The roles of all lines of a conversation are the Viterbi path over
    markers, line features and changes of speaker. Neighbouring lines of one role in a row are one part; ``opens``
    says that the role differs from the line before, and the ``rendered`` texts of a conversation, joined in order of
    turn and part and closed by '<|end|>', are its canonical form.

    Rows equal in conv_id, turn, role and text count once; rows of one turn follow each other by text. Null turns
    come first, null conv_ids are one conversation, a null or unknown role is no marker, null text is empty (one
    empty line). No rows give no rows. A conversation is decoded in blocks of ``CHUNK`` turns: each block gives its
    weights between end roles, those of a conversation are chained, and each block is then decoded between fixed ends.
    """
    model = model or fit_chat_model(turns)
    rows = kept(_prepared(turns), "turns")
    chunks = rows.groupBy("conv_id").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    spread = rows.join(chunks, rows["conv_id"].eqNullSafe(chunks["conv_id"])).drop(chunks["conv_id"]).select(
        "conv_id", "turn", "role", "text", "place", "chunk", "key", (F.col("chunk") == F.col("low")).alias("starts"), (F.col("low") != F.col("high")).alias("long"))

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of_key(batches, "key"):
            _, scores, moves = _observed(group, model)
            whole = _through(scores, moves, model.first if group["starts"][0].as_py() else None)
            yield pa.RecordBatch.from_pylist([{"conv_id": group["conv_id"][0].as_py(), "chunk": group["chunk"][0].as_py(), "key": group["key"][0].as_py(), "w": whole.ravel().tolist()}], schema=weight_layout)

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of_key(batches, "conv"):
            parts = sorted(group.to_pylist(), key=lambda r: r["chunk"])
            at, back = None, []
            for p in parts:
                w = np.array(p["w"]).reshape(len(ROLES), len(ROLES))
                step = w[:1] if at is None else at[:, None] + w
                back.append(step.argmax(axis=0))
                at = step.max(axis=0)
            ends = [int(at.argmax())]
            for b in reversed(back[1:]):
                ends.append(int(b[ends[-1]]))
            ends = ends[::-1]
            yield pa.RecordBatch.from_pylist([{"key": p["key"], "entry": ends[i - 1] if i else -1, "exit": ends[i]} for i, p in enumerate(parts)], schema=end_layout)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of_key(batches, "key"):
            lines, scores, moves = _observed(group, model)
            entry, exit_ = group["entry"][0].as_py(), group["exit"][0].as_py()
            starts = group["starts"][0].as_py()
            if exit_ is None:
                exit_ = int(_through(scores, moves, model.first)[0].argmax())
            path = _path(scores, moves, model.first if starts else None, entry, exit_)
            out, last, before = [], None, -1 if starts else entry
            for (row, text), role in zip(lines, path):
                if row is not last or role != before:
                    out.append({"conv_id": row["conv_id"], "turn": row["turn"], "part": out[-1]["part"] + 1 if row is last else 0, "role": ROLES[role],
                                "opens": role != before, "first": before < 0, "lines": [text]})
                else:
                    out[-1]["lines"].append(text)
                last, before = row, role
            for x in out:
                head = ("" if x.pop("first") else "<|end|>\n") + f"<|{x['role']}|>\n" if x["opens"] else ""
                x["rendered"] = head + "\n".join(x.pop("lines")) + "\n"
            yield pa.RecordBatch.from_pylist(out, schema=out_layout)

    weight_layout = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("key", pa.string()), ("w", pa.list_(pa.float64()))])
    end_layout = pa.schema([("key", pa.string()), ("entry", pa.int32()), ("exit", pa.int32())])
    out_layout = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int32()), ("role", pa.string()), ("opens", pa.bool_()), ("rendered", pa.string())])
    by_key = lambda df: df.repartition("key").sortWithinPartitions("key")
    long_ = by_key(spread.where("long")).mapInArrow(weights, "conv_id bigint, chunk bigint, key string, w array<double>")
    named = long_.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")))
    ends = named.repartition("conv").sortWithinPartitions("conv").mapInArrow(chained, "key string, entry int, exit int")
    placed = spread.where("long").join(ends, "key").select(*spread.columns, "entry", "exit").unionByName(
        spread.where("not long").withColumn("entry", F.lit(-1)).withColumn("exit", F.lit(None).cast("int")))
    return by_key(placed).mapInArrow(decoded, "conv_id bigint, turn bigint, part int, role string, opens boolean, rendered string")
