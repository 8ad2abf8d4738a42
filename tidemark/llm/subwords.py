"""Whole-document BPE encoding and decoding, long unsplit text by tree concatenation.

The tokenizer drops white space and never lets a token span it, so a text is
the concatenation of its words, and each distinct word is encoded once while a
worker remembers it: Latin ones piece by piece with the tokenizer's own model,
others with the whole tokenizer. Text without white space for more than `leaf` characters cannot be had
that way. Such a document is cut into halves until no piece is longer; the
pieces are rows of their own and are encoded in parallel. At each join, from
the leaves up, a window of text around it is encoded and doubled until both
sides agree: it repeats a token of the left side (same bytes, same id) before
the join and one of the right side after it. Then

    left up to its token + window between both + right from its token on

is the encoding of the whole, exactly. For BPE merges by rank, a sequence of
tokens is the encoding of a run if and only if each two neighbours encode to
themselves, and every two neighbours of that sequence stand side by side in one
of the three encodings. A window that grows to the whole of a side needs no
agreement there. Cuts never part a character from a mark that composes with
it, nor an added token's string.

Null text is empty and has no ids. Repeated rows are encoded as often as they
occur; a null doc_id is kept. An empty table gives no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, ready, text_of
from .nptext import chunks

LEAF = 1 << 15
FIRST_WINDOW = 48
#: Words remembered by a worker, in bytes; beyond that those not met again since the last time are forgotten.
KEEP = 1 << 28
WORD = re.compile(rf"[^{BLANK[1:]}+")
WORD_END = "</w>"
#: Words of smaller characters only are in composed normal form, and lower case changes each character by itself.
LATIN = "\u0130"


def default_words() -> str:
    """The installed tokenizer file of the lower-cased 49k word vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def later_marks() -> frozenset[int]:
    """Characters that may change or join what stands before them in composed normal form."""
    out = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for point in range(0x110000):
        parts = unicodedata.decomposition(chr(point)).split()
        if parts and not parts[0].startswith("<"):
            out.update(int(p, 16) for p in parts[1:])
    return frozenset(out)


def starts_afresh(char: str) -> bool:
    return char < "\x80" or (not unicodedata.combining(char) and ord(char) not in later_marks())


def byte_signs() -> list[str]:
    """The sign of each byte in byte-level vocabularies: printable Latin-1 ones stand for themselves, the rest follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


BYTE_SIGNS = byte_signs()


def latin_split(own: dict) -> regex.Pattern | None:
    """The pattern by which the tokenizer splits words, if it normalises and splits as the word vocabulary does."""
    normal = [n["type"] for n in (own.get("normalizer") or {}).get("normalizers", [])]
    steps = (own.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if normal != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"] or not steps[0]["invert"] or steps[1]["use_regex"]:
        return None
    # to the tokenizer U+001C to U+001F are no white space
    return regex.compile(steps[0]["pattern"]["Regex"].replace(r"[^\s\p{L}", r"[^\x09-\x0D\x20\x85\xA0\p{L}"))


class Subwords:
    """A tokenizer file without truncation and padding, with its words remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path) as f:
            own = json.load(f)
        self.added = [t["content"] for t in own.get("added_tokens", [])]
        self.split = latin_split(own)
        names = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(names.values(), default=-1) + 1, np.int64)
        for name, k in names.items():
            self.bytes_of[k] = len(name) if name in self.added else len(name.removesuffix(WORD_END))
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.held = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, by its words."""
        parts = [WORD.findall(t) for t in texts]
        if self.held > KEEP // 2:
            self.before, self.words, self.held = self.words, {}, 0
        other = []
        for word in {w for p in parts for w in p}.difference(self.words):
            if word in self.before:
                self.learn(word, self.before[word])
            elif self.split and max(word) < LATIN and not any(t in word for t in self.added):
                self.learn(word, b"".join(map(self.piece, self.split.findall(word.lower()))))
            else:
                other.append(word)
        for word, found in zip(other, self.tokenizer.encode_batch(other, add_special_tokens=False)):
            self.learn(word, np.array(found.ids, np.int32).tobytes())
        return [np.frombuffer(b"".join(map(self.words.__getitem__, p)), np.int32) for p in parts]

    def learn(self, word: str, ids: bytes) -> bytes:
        self.words[word] = ids
        self.held += 200 + 4 * len(word) + len(ids)
        return ids

    def piece(self, low: str) -> bytes:
        """Ids of a lower-case piece that the tokenizer does not split."""
        known = self.words.get(low)
        if known is None and (known := self.before.get(low)) is not None:
            self.learn(low, known)
        elif known is None:
            signs = low if low.isascii() and low.isprintable() else "".join(map(BYTE_SIGNS.__getitem__, low.encode()))
            known = self.learn(low, np.array([t.id for t in self.tokenizer.model.tokenize(signs)], np.int32).tobytes())
        return known

    def afresh(self, text: str, at: int, step: int) -> int:
        """The first place from `at` on, in steps of 1 or -1, where a cut leaves both sides to themselves; 0 or the end if there is none."""
        while 0 < at < len(text):
            inside = [i for t in self.added for i in [text.find(t, max(0, at - len(t) + 1), at + len(t) - 1)] if 0 <= i < at < i + len(t)]
            if inside:
                at = inside[0] if step < 0 else inside[0] + len(next(t for t in self.added if text.startswith(t, inside[0])))
            elif starts_afresh(text[at]):
                return at
            else:
                at += step
        return max(0, min(at, len(text)))

    def leaves(self, text: str, leaf: int) -> list[str]:
        """The text in halves, and halves of those, until none is longer than `leaf`."""
        if len(text) <= max(leaf, 1):
            return [text]
        at = self.afresh(text, len(text) // 2, 1)
        at = at if at < len(text) else self.afresh(text, len(text) // 2, -1)
        return self.leaves(text[:at], leaf) + self.leaves(text[at:], leaf) if 0 < at < len(text) else [text]

    def joined(self, left: str, a: np.ndarray, right: str, b: np.ndarray) -> np.ndarray:
        """Ids of left + right from the ids of both."""
        reach = FIRST_WINDOW
        while True:
            begin, end = self.afresh(left, max(0, len(left) - reach), -1), self.afresh(right, min(reach, len(right)), 1)
            window = self.whole(left[begin:] + right[:end])
            before = int(self.bytes_of[self.whole(left[begin:])].sum())
            starts = np.cumsum(self.bytes_of[window]) - self.bytes_of[window] - before
            low, high = 0, len(window)
            head, tail = a[:0], b[:0]
            if begin:
                near = a[max(0, len(a) - before) :]  # a token has a byte at least
                at = -np.cumsum(self.bytes_of[near][::-1])[::-1]
                where = {(s, i): k for k, (s, i) in enumerate(zip(at.tolist(), near.tolist()))}
                same = [(k, where[s, i]) for k, (s, i) in enumerate(zip(starts.tolist(), window.tolist())) if s + self.bytes_of[i] <= 0 and (s, i) in where]
                if same:
                    low, head = same[-1][0] + 1, a[: len(a) - len(near) + same[-1][1] + 1]
            if end < len(right):
                near = b[: int(self.bytes_of[window].sum()) - before]
                at = np.cumsum(self.bytes_of[near]) - self.bytes_of[near]
                where = {(s, i): k for k, (s, i) in enumerate(zip(at.tolist(), near.tolist()))}
                same = [(k, where[s, i]) for k, (s, i) in enumerate(zip(starts.tolist(), window.tolist())) if s >= 0 and (s, i) in where]
                if same:
                    high, tail = same[0][0], b[same[0][1] :]
            if (low or not begin) and (len(tail) or end == len(right)) and low <= high:
                return np.concatenate((head, window[low:high], tail))
            reach *= 2

    def tree(self, parts: list[tuple[str, np.ndarray]]) -> np.ndarray:
        """Ids of the texts in a row from the ids of each."""
        while len(parts) > 1:
            pairs = [(x + y, self.joined(x, a, y, b)) for (x, a), (y, b) in zip(parts[::2], parts[1::2])]
            parts = pairs + parts[len(pairs) * 2 :]
        return parts[0][1] if parts else np.zeros(0, np.int32)

    def back(self, ids: list) -> list[str]:
        """The text of each list of ids, special tokens kept."""
        return [self.tokenizer.decode(i if isinstance(i, list) else i.tolist(), skip_special_tokens=False) for i in ids]


@cache
def subwords(path: str) -> Subwords:
    return Subwords(path)


def lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *values])))


def unsplit(text: Column, leaf: int) -> Column:
    """Whether the text goes on for more than `leaf` characters without white space."""
    return (F.char_length(text) > leaf) & F.array_max(F.transform(F.split(text, BLANK), F.char_length)).__gt__(leaf)


def encode(docs: DataFrame, path: str | None = None, leaf: int = LEAF, decoded: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and its ids, and the text that they decode to if `decoded`."""
    ready(docs.sparkSession)
    path = path or default_words()
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    long_text = unsplit(F.col("text"), leaf)
    names, schema = ["doc_id", "ids"], "doc_id long, ids array<int>"
    if decoded:
        names, schema = [*names, "text"], schema + ", text string"

    def results(ids):
        return [lists(ids), pa.array(subwords(path).back(ids), pa.string())] if decoded else [lists(ids)]

    def by_words(batches):
        for batch in batches:
            for start, end in chunks(texts := batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), *results(subwords(path).texts(texts[start:end]))], names=names)

    def cut(batches):
        for batch in batches:
            for row, key, body in zip(*(c.to_pylist() for c in batch.columns)):
                parts = subwords(path).leaves(body, leaf)
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(parts, pa.string())], names=["row", "doc_id", "at", "text"])

    def by_leaf(batches):
        for batch in batches:
            ids = lists([subwords(path).whole(t) for t in batch.column(3).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=["row", "doc_id", "at", "text", "ids"])

    def up(found: pa.Table) -> pa.Table:
        found = found.sort_by("at")
        parts = [(t, np.array(i, np.int32)) for t, i in zip(found["text"].to_pylist(), found["ids"].to_pylist())]
        return pa.table([found["doc_id"].slice(0, 1), *results([subwords(path).tree(parts)])], names=names)

    leaves = rows.where(long_text).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(cut, "row long, doc_id long, at int, text string")
    leaves = leaves.repartition("row", "at").mapInArrow(by_leaf, "row long, doc_id long, at int, text string, ids array<int>")
    whole = leaves.groupBy("row").applyInArrow(up, schema)
    return rows.where(~long_text).mapInArrow(by_words, schema).unionByName(whole)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Rows of doc_id and ids with the decoded text, special tokens kept. Null ids count as none."""
    ready(encoded.sparkSession)
    path = path or default_words()

    def back(batches):
        for batch in batches:
            texts = subwords(path).back([i or [] for i in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(back, "doc_id long, ids array<int>, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """Token count and the SHA-256 of the ids (decimal, joined by a space) and of the decoded text."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
