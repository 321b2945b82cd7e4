"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 400
LONGEST = 3
STEP = 1_000_000
#: Distinct n-grams a learning task holds before it passes them on.
HELD = 2_000_000
SALTS = 16


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-case words, one space around each; empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    words = np.where(letter, codes, 32)[keep].astype(np.int64)
    ends = [32] if words[-1] != 32 else []
    return np.concatenate([[32], words, ends]).astype(np.int64)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    grams, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(where, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)


def ngram_counts(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of one to three code points (21 bits each) in ascending order, and their counts."""
    parts = []
    for start in range(0, len(words), STEP):
        w = words[start:start + STEP + LONGEST - 1]
        n = min(STEP, len(words) - start)
        one = w[:n]
        two = (w[:-1] << 21 | w[1:])[:n]
        three = (w[:-2] << 42 | w[1:-1] << 21 | w[2:])[:n]
        grams, counts = np.unique(np.concatenate([one[one != 32], two, three]), return_counts=True)
        parts.append((grams, counts))
    return _merged(parts)


def top_ngrams(grams: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    return grams[np.argsort(-counts, kind="stable")[:most]]


def learn_profiles(labelled: DataFrame, most: int = PROFILE) -> dict[str, list[int]]:
    """The ``most`` frequent n-grams of each language, best first, from columns text and lang.

    N-grams are counted per task and language, then summed; ties go to the smaller n-gram. Rows with a null text or
    lang are left out. ``most`` numbers per language reach the driver.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            langs = batch["lang"].to_pylist()
            for lang, text in zip(langs, batch["text"]):
                words = letters_of(text.as_py())
                if len(words):
                    held.setdefault(lang, []).append(ngram_counts(words))
                    if len(held[lang]) >= 200:
                        held[lang] = [_merged(held[lang])]
            if sum(len(p[0]) for parts in held.values() for p in parts) > HELD:
                yield from emitted(held)
                held = {}
        yield from emitted(held)

    def emitted(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            grams, counts = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])

    found = labelled.select("text", "lang").dropna().mapInArrow(counted, "lang string, gram bigint, n bigint")
    total = found.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS)))
    best = lambda *key: Window.partitionBy(*key).orderBy(F.desc("n"), "gram")
    some = total.withColumn("r", F.row_number().over(best("lang", "salt"))).where(F.col("r") <= most)
    top = some.withColumn("r", F.row_number().over(best("lang"))).where(F.col("r") <= most)
    profiles: dict[str, list] = {}
    for row in top.select("lang", "gram", "r").collect():
        profiles.setdefault(row["lang"], []).append((row["r"], row["gram"]))
    return {lang: [g for _, g in sorted(ranks)] for lang, ranks in sorted(profiles.items())}


class Profiles:
    """Ranks of all profile n-grams by language; an n-gram absent from a profile is ``most`` places out."""

    def __init__(self, profiles: dict[str, list[int]], most: int):
        self.most, self.langs = most, sorted(profiles)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], dtype=np.int64))
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, dtype=np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.grams, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        words = letters_of(text) if text else ()
        if not len(words) or not self.langs:
            return "und", 0.0
        top = top_ngrams(*ngram_counts(words), self.most)
        at = np.searchsorted(self.grams, top)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != top)] = len(self.grams)
        ranks = self.ranks[:, at]
        out = np.where(ranks < 0, self.most, np.abs(ranks - np.arange(len(top)))).sum(axis=1)
        best = int(out.argmin())
        return self.langs[best], 1.0 - float(out[best]) / (self.most * len(top))


def predict_language(docs: DataFrame, profiles: dict[str, list[int]], most: int = PROFILE, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns, lang_pred and score of each row, from its whole text alone.

    lang_pred is the language at the least out-of-place distance (ties: the first by name), 'und' with score 0 where
    text is null or has no letter; score is 1 - distance / largest distance. Rows stay as they are.
    """

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(profiles, most)
        for batch in batches:
            found = [known.predict(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in carry), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*carry, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*carry, "text").mapInArrow(predicted, f"{kinds}, lang_pred string, score double")
