"""Token-bounded, overlapping chunks of sections, and what identifies them.

Counting tokens is injected: anything with count(text), longest_prefix(text, n) and shortest_suffix(text, n). The default
counts words and marks by a regular expression, and answers from the words' places without counting again.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.functions.text import basename, is_blank, sha1_prefix, tokens
from lexivec.session import importable

ENDINGS = ".!?"


class WordTokens:
    """Words (runs of letters, digits and underscores) and single other marks."""

    name = "words"
    pattern = re.compile(r"\w+|[^\w\s]")

    def count(self, text: str) -> int:
        return sum(1 for _ in self.pattern.finditer(text))

    def longest_prefix(self, text: str, n: int) -> int:
        """The length of the longest prefix of at most n tokens: up to where token n + 1 starts."""
        for k, m in enumerate(self.pattern.finditer(text)):
            if k == n:
                return m.start()
        return len(text)

    def shortest_suffix(self, text: str, n: int) -> int:
        """The last start from which at least n tokens follow: the last character of the n-th token from the end."""
        ends = [m.end() for m in self.pattern.finditer(text)]
        return ends[-n] - 1 if 0 < n <= len(ends) else len(text)


@dataclass
class CountedTokens:
    """Any counting function whose count grows with the text; cuts are found by bisection."""

    count: Callable[[str], int]
    name: str = "custom"

    def longest_prefix(self, text: str, n: int) -> int:
        return bisect_left(range(len(text)), True, key=lambda k: self.count(text[: k + 1]) > n)

    def shortest_suffix(self, text: str, n: int) -> int:
        after = bisect_left(range(len(text)), True, key=lambda k: self.count(text[k:]) < n)
        return after - 1 if after else len(text)


@dataclass
class Chunker:
    """Greedy filling: pages flow into a buffer of max_tokens; a full buffer is flushed as a chunk, and the next one starts
    with the last overlap_tokens tokens of it, on its last page. Counts add up part by part, one more for each joining
    space, so a chunk's size is near max_tokens, not exact."""

    max_tokens: int = 512
    overlap_tokens: int = 50
    tokens: object = None
    strip_whole: bool = False

    def __post_init__(self):
        if self.max_tokens <= 0 or not 0 <= self.overlap_tokens < self.max_tokens:
            raise ValueError("max_tokens must be positive and overlap_tokens from 0 to less than max_tokens")
        self.tokens = self.tokens or WordTokens()

    def fitting(self, text: str, n: int) -> str:
        """What is taken of a text that exceeds n tokens: up to the last sentence end in the last quarter of the longest
        prefix, else that prefix, else one character."""
        cut = self.tokens.longest_prefix(text, n)
        if not cut:
            return text[:1]
        end = max(text.rfind(c, cut - cut // 4, cut) for c in ENDINGS)
        return text[: end + 1] if end > 0 else text[:cut]

    def overlap(self, chunk: str) -> str:
        """What the next chunk repeats: the shortest suffix of overlap_tokens tokens, from after its last sentence end."""
        if not self.overlap_tokens or self.tokens.count(chunk) <= self.overlap_tokens:
            return ""
        tail = chunk[self.tokens.shortest_suffix(chunk, self.overlap_tokens) :]
        ends = [k + 2 for k in range(len(tail) - 1) if tail[k] in ENDINGS and tail[k + 1].isspace()]
        return tail[ends[-1] :] if ends and ends[-1] < len(tail) else tail

    def split(self, pages: list[tuple[int, str]]) -> list[tuple[str, list[int]]]:
        """(text, pages) of the chunks of a section's (page number, text) pages."""
        chunks: list[tuple[str, list[int]]] = []
        parts: list[str] = []
        seen: set[int] = set()
        used = 0

        def flush() -> None:
            nonlocal parts, seen, used
            text = " ".join(parts).strip()
            chunks.append((text, sorted(seen)))
            again = self.overlap(text)
            parts, used = ([again], self.tokens.count(again)) if again else ([], 0)
            seen = {max(seen)} if again else set()

        for number, rest in pages:
            while rest:
                room = self.max_tokens - used - bool(parts)
                if room <= 0:
                    flush()
                    continue
                size = self.tokens.count(rest)
                whole = size <= room
                piece = rest if whole else self.fitting(rest, room)
                used += bool(parts) + (size if whole else 0)
                parts.append(piece)
                seen.add(number)
                rest = rest[len(piece) :]
                if not whole:
                    flush()
        if parts:
            chunks.append((" ".join(parts).strip(), sorted(seen)))
        return chunks

    def section(self, pages: list[tuple[int, str]]) -> list[tuple[str, list[int]]]:
        """A section without text gives nothing; one that fits gives its pages joined by line ends; others are split."""
        whole = "\n".join(t or "" for _, t in pages)
        if not whole.strip():
            return []
        if self.tokens.count(whole) <= self.max_tokens:
            return [(whole.strip() if self.strip_whole else whole, sorted({n for n, _ in pages}))]
        return self.split([(n, t or "") for n, t in pages])


SECTION = "source_document string, heading_text string, full_heading_path string, level int, start_page int, end_page int, page_texts array<struct<page_number: int, text: string>>"


def chunk_id(source_document: Column, path: Column, index: Column, digits: int = 12) -> Column:
    own = F.when(F.coalesce(path, F.lit("")) == "", F.lit("nosection")).otherwise(sha1_prefix(path, digits))
    return F.concat(source_document, F.lit("_bookmark_"), own, F.lit("_chunk_"), index.cast("string"))


def embedding_text(source_document: Column, section_path: Column, section: Column, text: Column) -> Column:
    """What is embedded of a chunk: lines for document and section where they are not empty, a blank line, the text."""
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    where = F.when(full(section_path), section_path).otherwise(section)
    head = F.concat(F.when(full(source_document), F.concat(F.lit("Document: "), source_document, F.lit("\n"))).otherwise(""), F.when(full(where), F.concat(F.lit("Section: "), where, F.lit("\n"))).otherwise(""))
    return F.concat(head, F.when(head != "", F.lit("\n")).otherwise(""), F.coalesce(text, F.lit("")))


def chunk_sections(sections: DataFrame, chunker: Chunker | None = None) -> DataFrame:
    """Sections (SECTION) to chunks: chunk_id, text, source_document, chunk_index, chunk_total, start_page, end_page, section,
    section_path, metadata. Each section is a row of its own, split where it lies: no shuffle."""
    importable(sections.sparkSession)
    chunker = chunker or Chunker()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                pages = [(p["page_number"], p["text"]) for p in (r.page_texts if r.page_texts is not None else [])]
                found = chunker.section(pages)
                out += [(r.source_document, r.heading_text, r.full_heading_path, r.level, r.start_page, r.end_page, text, numbers, k, len(found)) for k, (text, numbers) in enumerate(found)]
            yield pd.DataFrame(out, columns=names)

    names = ["source_document", "heading_text", "full_heading_path", "level", "section_start", "section_end", "text", "pages", "chunk_index", "chunk_total"]
    kinds = "source_document string, heading_text string, full_heading_path string, level int, section_start int, section_end int, text string, pages array<int>, chunk_index int, chunk_total int"
    return assemble(sections.select("source_document", "heading_text", "full_heading_path", "level", "start_page", "end_page", "page_texts").mapInPandas(run, kinds))


def assemble(parts: DataFrame) -> DataFrame:
    """The chunk record of each part of a section."""
    document, path, heading = F.col("source_document"), F.col("full_heading_path"), F.col("heading_text")
    named = lambda c: F.nullif(c, F.lit(""))
    base = F.create_map(F.lit("ChunkType"), F.lit("Bookmark"), F.lit("BookmarkLevel"), F.col("level").cast("string"))
    with_pages = F.map_concat(base, F.create_map(F.lit("Pages"), F.array_join(F.col("pages").cast("array<string>"), ",")))
    return parts.select(
        chunk_id(document, path, F.col("chunk_index")).alias("chunk_id"),
        "text",
        "source_document",
        "chunk_index",
        "chunk_total",
        F.coalesce(F.array_min("pages"), "section_start").alias("start_page"),
        F.coalesce(F.array_max("pages"), "section_end").alias("end_page"),
        F.coalesce(named(heading), document).alias("section"),
        F.coalesce(named(path), named(heading), document).alias("section_path"),
        F.when(F.size("pages") > 0, with_pages).otherwise(base).alias("metadata"),
    )


def sections_of_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Plain texts as sections: one a document, each line that is not blank a page."""
    lines = F.transform(F.split(F.coalesce(text_col, F.lit("")), "\n", -1), lambda t, k: F.struct((k + 1).cast("int").alias("page_number"), t.alias("text")))
    pages = F.filter(lines, lambda p: ~is_blank(p["text"]))
    return docs.select(F.concat(F.lit("doc_"), F.col(id_col).cast("string")).alias("source_document"), F.lit("").alias("heading_text"), F.lit("").alias("full_heading_path"), F.lit(1).alias("level"), F.lit(1).alias("start_page"), F.size(pages).alias("end_page"), pages.alias("page_texts"))


def fixed_stride_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 512, overlap: int = 50) -> DataFrame:
    """(id, chunk_index, chunk_total, n_tokens, text): the native approximation, windows of `size` words every size - overlap
    words, the words joined by spaces. Without any Python."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap from 0 to less than size")
    step = size - overlap
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("_t")).where(F.size("_t") > 0)
    total = F.greatest(F.lit(1), F.ceil((F.size("_t") - overlap) / F.lit(step)).cast("int"))
    cut = words.withColumn("chunk_total", total).select("id", "_t", "chunk_total", F.explode(F.sequence(F.lit(0), F.col("chunk_total") - 1)).alias("chunk_index"))
    part = cut.withColumn("_p", F.slice("_t", F.col("chunk_index") * step + 1, F.lit(size)))
    return part.select("id", "chunk_index", "chunk_total", F.size("_p").alias("n_tokens"), F.array_join("_p", " ").alias("text"))


def source_name(path: Column) -> Column:
    return basename(path)
