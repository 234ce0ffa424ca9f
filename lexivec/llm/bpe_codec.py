"""Operator 5, BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch that are not yet known go into a trie; a depth-first walk carries the last-token state of
each prefix (bpe.LastTokenStates), so the encoding of a prefix that words share is computed once. The ids of a text are
the joined ids of its words; decoding maps ids back to tokens.

Edge cases: a null or empty text has no ids and decodes to ""; texts of any length are encoded whole; null ids and
repeated rows are kept row by row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexivec.llm import bpe, common

#: Fixed value: the public word pattern of this tokenizer family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordCodec:
    """A lower-casing BPE tokenizer with word ends, from its file. Words never reach over white space."""

    def __init__(self, path: str):
        import regex

        self.states, self.vocab, added = bpe.load(path)
        self.find = regex.compile(PATTERN)
        self.added = dict(added)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if added else None
        letter, digit, blank = ("".join(c for c in map(chr, range(0x530)) if regex.match(kind, c)) for kind in (r"\p{L}", r"\p{N}", r"\s"))
        # the kinds of words begin with different characters, so the most frequent kind is tried first
        self.find_near = re.compile(f"[{letter}]+|'(?:s|t|re|ve|m|ll|d)|[{digit}]|[^{re.escape(blank)}{letter}{digit}]+").findall
        self.symbols = "".join(bpe.byte_symbols())
        self.token_of = {i: bpe.unpacked(t) for t, i in self.vocab.items()} | {i: t for t, i in added}
        self.marked = {c: chr(ord(c) + bpe.LAST) for c in self.symbols}
        self.words: dict[str, bytes] = {}
        self.most = 250_000

    def split(self, text: str) -> list[str]:
        """The words of a text, in lower case. Below bpe.FAR a pattern of plain ranges finds the same words sooner."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ") if "Σ" in text else text
        text = text.lower()
        if not bpe.FAR.search(text):
            return self.find_near(text)
        same = bpe.CLASSES.stand_in(text)
        return self.find.findall(text) if same is text else [text[m.start() : m.end()] for m in self.find.finditer(same)]

    def spelt(self, word: str) -> str:
        """A word in the byte-level alphabet, its last symbol marked."""
        if not (word.isascii() and word.isprintable()):
            word = codecs.charmap_decode(word.encode(), "strict", self.symbols)[0]
        return word[:-1] + self.marked[word[-1]]

    def learn(self, wanted: list[str]) -> None:
        """Put words into the memory: the trie walk over them."""
        self.words.update(zip(wanted, self.states.encode_all([self.spelt(w) for w in wanted])))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        cut = [self.cut.split(t) if self.cut and any(a in t for a in self.added) else [t] for t in texts]
        found = [[self.split(p) if k % 2 == 0 else p for k, p in enumerate(parts)] for parts in cut]
        wanted: set[str] = set()
        wanted.update(*(p for parts in found for p in parts[::2]))
        if len(self.words) > self.most:  # what this batch needs stays, the rest is forgotten
            self.words = {w: ids for w, ids in self.words.items() if w in wanted}
        self.learn(list(wanted - self.words.keys()))
        known = self.words.__getitem__
        return [b"".join([b"".join(map(known, p)) if k % 2 == 0 else self.added[p].to_bytes(4, "little") for k, p in enumerate(parts)]) for parts in found]

    def decode(self, ids: bytes) -> str:
        """As the library does with special tokens kept; the file names no decoder, so tokens are joined by spaces."""
        return " ".join(map(self.token_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    if path not in _CODECS:
        _CODECS[path] = WordCodec(path)
    return _CODECS[path]


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Per row: id, n_tokens and, of `outputs`, ids (array<int>), decoded (string), ids_sha256 and decoded_sha256 (of the
    ids as little-endian unsigned 32-bit integers, and of the decoded text in UTF-8). Maps, never shuffles."""
    common.small_batches(df.sparkSession)
    kinds = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    outputs = tuple(o for o in kinds if o in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in common.slices(batches):
            ids = c.encode_batch(batch.column("text").to_pylist())
            columns = {"id": batch.column("id"), "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64())}
            decoded = [c.decode(i) for i in ids] if {"decoded", "decoded_sha256"} & set(outputs) else []
            made = {
                "ids": lambda: pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32())),
                "decoded": lambda: pa.array(decoded, pa.string()),
                "ids_sha256": lambda: pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                "decoded_sha256": lambda: pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
            }
            columns |= {o: made[o]() for o in outputs}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint" + "".join(f", {o} {kinds[o]}" for o in outputs)
    return common.texts_of(df, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
