"""Byte-pair encoding by forced-boundary splitting, and decoding."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import claim, text_or_empty

#: Words whose encoding a Python worker remembers; later ones are encoded anew for each batch.
CACHED_WORDS = 300_000
#: Chunks (a word with its marks) that it remembers, about 400 bytes each.
CACHED_CHUNKS = 600_000
ROWS_PER_BATCH = 2000

#: Characters for which the plain word pattern below and the tokenizer's own pattern agree.
_OTHER = re.compile("[^\t-\r\x20-\x7e\xa0-ɏ]")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes for themselves, the
    others by the next free code points from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def joinable_pairs(tokens, suffix: str = "") -> set[str]:
    """Every pair of neighbouring symbols inside some token of the vocabulary."""
    pairs = set()
    for token in tokens:
        token = token.removesuffix(suffix) if suffix else token
        pairs.update(a + b for a, b in zip(token, token[1:]))
    return pairs


def fragments(word: str, joinable: set[str]) -> list[str]:
    """Cut ``word`` between symbols that no token has side by side: no merge can cross such a cut."""
    cuts = [i for i in range(1, len(word)) if word[i - 1:i + 1] not in joinable]
    return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]


class WordCoder:
    """Encoder for a byte-level BPE file with word ends and split by words; decoding joins tokens by a space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model = config["model"]
        self.whole = Tokenizer.from_file(path)
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ending = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.suffix)
        self.inner = models.BPE(vocab=model["vocab"], merges=merges)
        self.joinable = joinable_pairs(model["vocab"], self.suffix)
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.specials = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.token = {i: t for t, i in [*model["vocab"].items(), *self.special.items()]}
        self.pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|(?:[^\w\s]|_)+")
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.space = self.alphabet[ord(" ")]
        self.encoded: dict[str, tuple[str, str]] = {}
        self.ids: dict[str, str] = {}
        self.texts: dict[str, str] = {}

    def symbols(self, word: str) -> str:
        if word.isascii() and word.isprintable():
            return word.replace(" ", self.space)  # every other printable byte stands for itself
        return word.encode().decode("latin-1").translate(self.alphabet)

    def of_symbols(self, symbols: str) -> list[int]:
        """Ids of one word: its fragments are encoded on their own, and only the last carries the word end."""
        *first, last = fragments(symbols, self.joinable)
        ending = [t.id for t in self.ending.tokenize(last)]
        return [t.id for f in first for t in self.inner.tokenize(f)] + ending if first else ending

    def _word(self, word: str) -> tuple[str, str]:
        """Ids and token strings of a word, each joined by a space."""
        found = self.encoded.get(word)
        if found is None:
            ids = self.of_symbols(self.symbols(word))
            found = " ".join(map(str, ids)), " ".join([self.token[i] for i in ids])
            if len(self.encoded) < CACHED_WORDS:
                self.encoded[word] = found
        return found

    def _segment(self, text: str) -> list[int]:
        """Ids of a text without special tokens, by the tokenizer's own normaliser and word split."""
        normal = self.whole.normalizer.normalize_str(text)
        return [i for word, _ in self.whole.pre_tokenizer.pre_tokenize_str(normal) for i in self.of_symbols(word)]

    def general(self, text: str) -> list[int]:
        return [i for part in self.specials.split(text) if part
                for i in ([self.special[part]] if part in self.special else self._segment(part))]

    def _learn(self, chunks: set[str], ids: dict[str, str], texts: dict[str, str]) -> None:
        for chunk in chunks:
            words = [self._word(word) for word in self.pieces.findall(chunk)]
            ids[chunk], texts[chunk] = words[0] if len(words) == 1 else (" ".join([w[0] for w in words]), " ".join([w[1] for w in words]))

    def encode(self, batch: list[str]) -> tuple[list[str], list[str], list[int]]:
        """Space-joined decimal ids, decoded text and token count of each text.

        White space never is part of a token here, so a text's ids are those of its space-separated chunks; each
        distinct chunk is encoded once. Texts with rarer characters or special tokens take the tokenizer's own
        normaliser and split before the fragments."""
        split = [None if _OTHER.search(t) or self.specials.search(t) else t.lower().split() for t in batch]
        new = set().union(*(words for words in split if words)) - self.ids.keys()
        if len(self.ids) + len(new) <= CACHED_CHUNKS:
            self._learn(new, self.ids, self.texts)
            ids, texts = self.ids, self.texts
        else:
            more, said = {}, {}
            self._learn(new, more, said)
            ids, texts = _Both(self.ids, more), _Both(self.texts, said)
        out = []
        for text, words in zip(batch, split):
            if words is None:
                found = self.general(text)
                out.append((" ".join(map(str, found)), " ".join(map(self.token.__getitem__, found))))
            else:
                out.append((" ".join(map(ids.__getitem__, words)), " ".join(map(texts.__getitem__, words))))
        return [o[0] for o in out], [o[1] for o in out], [o[0].count(" ") + 1 if o[0] else 0 for o in out]


class _Both(dict):
    """The new words of a batch, then the remembered ones."""

    def __init__(self, known: dict, more: dict):
        super().__init__(more)
        self.known = known

    def __missing__(self, key):
        return self.known[key]


@lru_cache(maxsize=2)
def word_coder(path: str) -> WordCoder:
    return WordCoder(path)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by a space) and decoded text of each row of ``docs``.

    ``path`` names a tokenizer file that every executor has. Null counts as empty, and an empty text has no
    tokens: n_tokens 0, ids and decoded ''. Rows stay as they are, repeated ones and null doc_ids too; other
    columns are ignored. ``ids_as_array`` gives the ids as numbers.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words", word_coder.cache_clear)
        coder = word_coder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_BATCH):
                part = batch.slice(start, ROWS_PER_BATCH)
                ids, texts, counts = coder.encode(part["_text"].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("_text")).mapInArrow(
        encoded, f"doc_id {kind}, n_tokens bigint, ids string, decoded string")


def ids_as_array(ids: Column) -> Column:
    return F.when(ids == "", F.array().cast("array<int>")).otherwise(F.split(ids, " ").cast("array<int>"))


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids (array of int): token strings joined by a space, special tokens
    kept. Ids outside the vocabulary are skipped; null counts as no ids."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = word_coder(path).token
        for batch in batches:
            texts = [" ".join(token[i] for i in row or () if i in token) for row in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(decoded, f"doc_id {kind}, text string")
