"""Operator 1, token counts: a prefix dynamic programme gives the exact token count at every prefix of a text.

Truncation ("how long a prefix fits in n tokens?") and budget questions are answered from the stored counts, without
encoding again. The programme (bpe.LastTokenStates) runs inside a pre-token; across pre-tokens counts add up.

Edge cases: a null or empty text has 0 tokens, 0 bytes and the prefix counts [0]; texts of any length are taken whole;
null ids and repeated rows are counted row by row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lexivec.llm import bpe, common

#: Fixed value: the public pre-tokenizer pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Counter:
    """Token counts of a byte-level BPE tokenizer, from its file."""

    def __init__(self, path: str):
        import regex

        self.states, _, added = bpe.load(path)
        self.find, self.blank = regex.compile(PATTERN), regex.compile(r" \s| \Z")
        self.before_space = regex.compile(r"\s ")
        self.added = regex.compile("(" + "|".join(regex.escape(a) for a, _ in added) + ")") if added else None
        self.added_first = [a for a, _ in added]
        self.symbols = bpe.byte_symbols()
        self.words = bpe.Memory(lambda w: self.states.counts(self.spelt(w))[-1])
        self.chunks = bpe.Memory(lambda c: self.pieces(" " + c))

    def spelt(self, word: str) -> str:
        return "".join(map(self.symbols.__getitem__, word.encode()))

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.find.finditer(bpe.CLASSES.stand_in(text))]

    def pieces(self, text: str) -> int:
        if text[1:].isalpha() and text.isascii() and text[0] == " ":
            return self.words[text]
        same = bpe.CLASSES.stand_in(text)
        if same is text:
            return sum(map(self.words.__getitem__, self.find.findall(text)))
        return sum(self.words[text[m.start() : m.end()]] for m in self.find.finditer(same))

    def parts(self, text: str) -> list[str]:
        """The text cut at added tokens, which stand at odd places; most texts have none."""
        return self.added.split(text) if self.added and any(a in text for a in self.added_first) else [text]

    def chunked(self, part: str) -> list[str] | None:
        """The part cut before single spaces; each chunk but the first is counted with its space. None if a blank
        follows a space, where pre-tokens reach over the cut."""
        return None if self.blank.search(part) else part.split(" ")

    def count(self, text: str) -> int:
        total = 0
        for k, part in enumerate(self.parts(text)):
            if k % 2:
                total += 1
            elif (chunks := self.chunked(part)) is None:
                total += self.pieces(part)
            else:
                total += (self.pieces(chunks[0]) if chunks[0] else 0) + sum(map(self.chunks.__getitem__, chunks[1:]))
        return total

    def prefix_counts(self, text: str) -> list[int]:
        """For each p from 0 to len(text): the token count of text[:p]."""
        out, base, parts = [0], 0, self.parts(text)
        for k, part in enumerate(parts):
            if k % 2:  # a prefix of an added token is ordinary text, joined to what stands before it
                before = parts[k - 1]
                out += [sum(self.words[(before + part[:p])[a:b]] for a, b in self.spans(before + part[:p])) + base - self.count_part(before) for p in range(1, len(part))] + [base + 1]
                base += 1
                continue
            start = base
            spans = self.spans(part)
            i = 0
            while i < len(spans):
                a, b = spans[i]
                if part[a:b].isspace():  # a blank run is one pre-token while it ends the prefix
                    e = b
                    while e < len(part) and part[e].isspace():
                        e += 1
                    out += self.within(part[a:e], base)
                    while i < len(spans) and spans[i][1] <= e:
                        base += self.words[part[slice(*spans[i])]]
                        i += 1
                    if e > b and i < len(spans) and spans[i][0] < e:  # the run's last blank begins the next word
                        a, b = spans[i]
                        out += self.within(part[a:b], base)[1:]
                        base += self.words[part[a:b]]
                        i += 1
                    continue
                word = part[a:b]
                inside = self.within(word, base)
                if len(word) == 3 and word[0] == "'" and word[1:].isalpha():  # cut, a contraction is a mark and a letter
                    inside[1] = base + self.words["'"] + self.words[word[1]]
                out += inside
                base += self.words[word]
                i += 1
            assert base >= start
        return out

    def count_part(self, part: str) -> int:
        return sum(self.words[part[a:b]] for a, b in self.spans(part))

    def within(self, word: str, base: int) -> list[int]:
        counts, out, at = self.states.counts(self.spelt(word)), [], 0
        for c in word:
            at += len(c.encode())
            out.append(base + counts[at])
        return out

    def fitting(self, text: str, limit: int) -> int:
        """The largest p such that text[:p] has at most `limit` tokens, read off the prefix counts of the one chunk in
        which the limit is passed."""
        total = start = 0
        # where blanks or added tokens meet a cut, a longer prefix can have fewer tokens: then the text is one chunk
        whole = len(self.parts(text)) > 1 or self.blank.search(text) or self.before_space.search(text)
        for j, chunk in enumerate([text] if whole else text.split(" ")):
            piece = (" " if j else "") + chunk
            more = limit + 1 if whole else self.pieces(piece)
            if total + more > limit:
                counts = self.prefix_counts(piece)
                return start + max(p for p, c in enumerate(counts) if total + c <= limit)
            total, start = total + more, start + len(piece)
        return start


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(df: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text", store_prefixes: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit, fit_chars (code points of the longest prefix within `limit` tokens)
    and, if asked for, prefix_tokens: the token count of each of the text's n_chars + 1 prefixes. Maps, never shuffles."""
    spark = df.sparkSession
    common.small_batches(spark)
    fields = [("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fit_chars", pa.int64())]
    fields += [("prefix_tokens", pa.list_(pa.int32()))] * store_prefixes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for batch in common.slices(batches):
            texts = batch.column("text").to_pylist()
            if store_prefixes:
                prefixes = [c.prefix_counts(t) for t in texts]
                tokens = [p[-1] for p in prefixes]
            else:
                tokens = [c.count(t) for t in texts]
            fit = [len(t) if n <= limit else c.fitting(t, limit) for t, n in zip(texts, tokens)]
            columns = [batch.column("id"), pa.array(common.byte_lengths(batch.column("text"))), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens]), pa.array(fit, pa.int64())]
            columns += [pa.array(prefixes, pa.list_(pa.int32()))] if store_prefixes else []
            yield pa.RecordBatch.from_arrays(columns, names=["id"] + [n for n, _ in fields])
            c.words.turn()
            c.chunks.turn()

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint" + ", prefix_tokens array<int>" * store_prefixes
    return common.texts_of(df, id_col, text_col).mapInArrow(count, schema).withColumnRenamed("id", id_col)
