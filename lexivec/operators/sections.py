"""Sections from word blocks, page texts, outlines and HTML.

Word blocks: source_document, seq, page_number, text, font_size, font_name, is_bold, is_italic, color_key, top, bottom, x0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from lexivec.functions.text import is_blank, round1, squeeze, strip
from lexivec.operators.chunking import SECTION
from lexivec.session import importable

DOC = "source_document"


def readable(blocks: DataFrame, skip_pages: int = 0, max_font_size: float | None = None) -> DataFrame:
    """Blocks after skipped pages, not blank, and not larger than the cap (larger words go altogether, body or not)."""
    kept = blocks.where((F.col("page_number") > skip_pages) & ~is_blank(F.col("text"))).withColumn("text", strip(F.col("text")))
    return kept.where(F.col("font_size") <= max_font_size) if max_font_size is not None else kept


def reading_order() -> list[str]:
    return ["page_number", "top", "bottom", "x0", "seq"]


def font_statistics(blocks: DataFrame, heading_color: str | None = None, max_font_size: float | None = None) -> DataFrame:
    """Per document: average, largest, smallest and body font size and the distinct heading sizes, largest first. The body
    size is the most frequent size to one decimal, of equals the one seen first; headings exceed 1.1 times the body."""
    return _statistics(blocks, heading_color, max_font_size).drop("_rounded")


def _statistics(blocks: DataFrame, heading_color: str | None, max_font_size: float | None) -> DataFrame:
    """font_statistics and _rounded, the document's sizes to one decimal by size: sizes are rounded once, not once a word."""
    raw = blocks.where("font_size > 0").groupBy(DOC, "font_size", "color_key").agg(F.count("*").alias("n"), F.min("seq").alias("seen"))
    sized = raw.withColumn("rounded", round1(F.col("font_size")))  # a row a size of a document, not a word
    own_color = F.lit(heading_color).isNull() | (F.col("color_key") == F.lit(heading_color))
    counts = sized.groupBy(DOC, "rounded").agg(F.sum("n").alias("n"), F.min("seen").alias("seen"), F.max(F.when(own_color, 1).otherwise(0)).alias("coloured"), F.sum(F.col("n") * F.col("font_size")).alias("s"), F.max("font_size").alias("hi"), F.min("font_size").alias("lo"), F.collect_set("font_size").alias("own"))
    body = F.max_by("rounded", F.struct(F.col("n"), -F.col("seen")))
    whole = counts.groupBy(DOC).agg((F.sum("s") / F.sum("n")).alias("average_size"), F.max("hi").alias("max_size"), F.min("lo").alias("min_size"), body.alias("body_size"), F.collect_list(F.struct("rounded", "coloured", "own")).alias("_sizes"))
    fits = lambda x: (x["rounded"] > F.col("body_size") * 1.1) & (x["coloured"] == 1) & (F.lit(True) if max_font_size is None else x["rounded"] <= F.lit(max_font_size))
    sizes = F.sort_array(F.transform(F.filter("_sizes", fits), lambda x: x["rounded"]), asc=False)
    rounded = F.map_from_entries(F.flatten(F.transform("_sizes", lambda x: F.transform(x["own"], lambda size: F.struct(size, x["rounded"])))))
    whole = whole.select(DOC, "average_size", "max_size", "min_size", "body_size", sizes.alias("heading_sizes"), rounded.alias("_rounded"))
    every = blocks.select(DOC).distinct().join(whole, DOC, "left")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("average_size", "max_size", "min_size", "body_size")}
    return every.withColumns(zero | {"heading_sizes": F.coalesce("heading_sizes", F.array().cast("array<double>"))})


def heading_level(rounded: Column, size: Column, bold: Column, color: Column, sizes: Column, body: Column, heading_color: str | None = None) -> Column:
    """1 for the largest heading size and so on; bold text of the body's size or more is one level below all; else 0."""
    at = F.array_position(sizes, rounded).cast("int")
    level = F.when(at > 0, at).when(bold & (size >= body), F.size(sizes) + 1).otherwise(0)
    return level if heading_color is None else F.when(F.coalesce(color, F.lit("")) == heading_color, level).otherwise(0)


def line_breaks(blocks: DataFrame) -> DataFrame:
    """breaks: does a block start a new line against the one before it on its page (its top lies more than 0.8 of the
    former's height, at least 1, below the former's)? First blocks of a page do not."""
    before = W.partitionBy(DOC, "page_number").orderBy(*reading_order()[1:])
    height = F.greatest(F.lit(1.0), F.lag("bottom").over(before) - F.lag("top").over(before))
    return blocks.withColumn("breaks", F.coalesce(F.col("top") - F.lag("top").over(before) > height * 0.8, F.lit(False)))


def paragraph_breaks(blocks: DataFrame) -> DataFrame:
    """breaks by the finer rule: none on one line; one after a gap of 1.5 line heights; after one of 0.3 only behind a mark
    that ends a sentence or a list number. Heights are averages of both blocks, 10 where under 1."""
    w = W.partitionBy(DOC, "page_number").orderBy(*reading_order()[1:])
    lag = lambda c: F.lag(c).over(w)
    average = (F.abs(lag("bottom") - lag("top")) + F.abs(F.col("bottom") - F.col("top"))) / 2
    height = F.when(average < 1, 10.0).otherwise(average)
    level = (F.abs(lag("bottom") - F.col("bottom")) < height * 0.3) & (F.abs(lag("top") - F.col("top")) < height * 0.3)
    gap = F.col("top") - lag("bottom")
    before = F.regexp_replace(lag("text"), r"(?U)\s+$", "")
    closes = before.rlike(r"[.?!:;]$") | before.rlike(r"(?s)^\p{Nd}.*[.)]$")
    return blocks.withColumn("breaks", F.coalesce(F.when(level, False).when(gap > height * 1.5, True).otherwise((gap > height * 0.3) & closes), F.lit(False)))


def page_texts(blocks: DataFrame) -> DataFrame:
    """(source_document, page_number, text) of blocks with breaks: joined by line ends and spaces."""
    piece = F.struct(*reading_order()[1:], F.concat(F.when(F.col("breaks"), "\n").otherwise(" "), F.col("text")).alias("_t"))
    joined = blocks.groupBy(DOC, "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["_t"]), "").alias("text"))
    return joined.withColumn("text", F.expr("substring(text, 2)"))


@dataclass
class Outline:
    """Folds a document's blocks, in reading order, into sections: heading runs open one, other blocks are its body."""

    depth: int = 2
    keep_bodyless: bool = False

    def fold(self, rows: Iterator[tuple]) -> list[tuple]:
        """rows: (text, page, size, bold, level, breaks). A run continues on its page while sizes stay within 0.5 of the
        run's first. A heading is entered into the path only when body follows, unless keep_bodyless."""
        sections: list[tuple] = []
        path: dict[int, str] = {}
        run: list | None = None  # [words, size, page, level]
        now: dict = {"heading": "", "path": "", "level": 1, "start": 1, "pages": {}}
        last_page, body_before = None, False

        def close() -> None:
            pages = [{"page_number": p, "text": t} for p in sorted(now["pages"]) if (t := "".join(now["pages"][p]).strip())]
            if pages:
                sections.append((now["heading"], now["path"], now["level"], now["start"], pages[-1]["page_number"], pages))

        def enter() -> None:
            nonlocal now
            words, _, page, level = run
            title = " ".join(words).strip()
            path[level] = title
            for deeper in [k for k in path if k > level]:
                del path[deeper]
            now = {"heading": title, "path": " > ".join(path[k] for k in sorted(path) if k <= level), "level": level, "start": page, "pages": {}}

        for text, page, size, level, breaks in rows:
            if 0 < level <= self.depth:
                if run and abs(size - run[1]) < 0.5 and page == last_page:
                    run[0].append(text)
                else:
                    if run and self.keep_bodyless:
                        enter()
                    elif not run:
                        close()
                        now = {**now, "pages": {}}
                    run = [[text], size, page, level]
                body_before = False
            else:
                if run:
                    enter()
                    run, body_before = None, False
                parts = now["pages"].setdefault(page, [])
                if parts:
                    parts.append("\n" if breaks and body_before and last_page == page else " ")
                parts.append(text)
                body_before = True
            last_page = page
        if not run:
            close()
        return sections


def format_sections(blocks: DataFrame, max_heading_depth: int = 2, heading_color: str | None = None, max_font_size: float | None = None, skip_pages: int = 0, keep_bodyless_headings: bool = False) -> DataFrame:
    """Sections (chunking.SECTION) of word blocks by font. Sizes, levels and breaks are columns; the fold is one pass over a
    document's blocks, which come sorted and are not held, and is the one step that needs them in sequence."""
    if max_heading_depth < 1:
        raise ValueError("max_heading_depth must be at least 1")
    importable(blocks.sparkSession)
    kept = readable(blocks, skip_pages, max_font_size)
    stats = _statistics(kept, heading_color, max_font_size)
    rows = line_breaks(kept).join(stats, DOC).withColumn("_r", F.try_element_at("_rounded", F.col("font_size")))
    rows = rows.withColumn("level", heading_level(F.col("_r"), F.col("font_size"), F.col("is_bold"), F.col("color_key"), F.col("heading_sizes"), F.col("body_size"), heading_color))
    outline, schema = Outline(max_heading_depth, keep_bodyless_headings), to_arrow_schema(T.StructType.fromDDL(SECTION))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        held: list[dict] = []
        for name, own in groupby(blocks, key=lambda row: row[0]):
            held += [dict(zip(schema.names, (name, *section))) for section in outline.fold(row[1:] for row in own)]
            if len(held) >= 256:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    # dealt anew, as a skewed join may have split a document
    order = [F.col(c).asc_nulls_last() for c in (DOC, *reading_order())]
    ready = rows.select(DOC, "text", "page_number", "font_size", "level", "breaks", *reading_order()[1:]).repartition(DOC).sortWithinPartitions(*order)
    return ready.select(DOC, "text", "page_number", "font_size", "level", "breaks").mapInArrow(fold, SECTION)


def simple_sections(pages: DataFrame, skip_pages: int = 0) -> DataFrame:
    """One section a document, of its pages (source_document, page_number, text) that are not blank."""
    if skip_pages < 0:
        raise ValueError("skip_pages must not be negative")
    total = pages.groupBy(DOC).agg(F.max("page_number").cast("int").alias("end_page"))
    full = pages.where((F.col("page_number") > skip_pages) & ~is_blank(F.col("text")))
    whole = full.groupBy(DOC).agg(F.array_sort(F.collect_list(F.struct(F.col("page_number").cast("int").alias("page_number"), strip(F.col("text")).alias("text")))).alias("page_texts"))
    return whole.join(total, DOC).select(DOC, F.lit("").alias("heading_text"), F.lit("").alias("full_heading_path"), F.lit(1).alias("level"), F.lit(skip_pages + 1).alias("start_page"), "end_page", "page_texts")


def outline_paths(bookmarks: DataFrame, max_depth: int | None = None, skip_pages: int = 0) -> DataFrame:
    """Outline rows (source_document, seq, title, level, page_number) with full_title: the titles of the nearest former rows
    of each lower level and its own, joined by " > ". Empty titles go; a missing page is 1.
    Without max_depth all levels stay: the deepest is looked up first, by a small job."""
    rows = bookmarks.where(~is_blank(F.col("title"))).withColumns({"title": strip(F.col("title")), "page_number": F.coalesce("page_number", F.lit(1))})
    order = W.partitionBy(DOC).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    # of each level the last title so far and where it stood; a shallower row in between ends it
    most = max_depth or rows.agg(F.max("level")).first()[0] or 1
    for k in range(1, most + 1):
        rows = rows.withColumn(f"_{k}", F.last(F.when(F.col("level") == k, F.struct("seq", "title")), ignorenulls=True).over(order))
    parts = [F.when((F.col("level") >= k) & (F.lit(True) if k == 1 else F.greatest(*[F.coalesce(F.col(f"_{j}.seq"), F.lit(-1)) for j in range(1, k)], F.lit(-1)) < F.col(f"_{k}.seq")), F.col(f"_{k}.title")) for k in range(1, most + 1)]
    rows = rows.withColumn("full_title", F.concat_ws(" > ", *parts)).drop(*[f"_{k}" for k in range(1, most + 1)])
    return rows.where((F.col("level") <= most) & (F.col("page_number") > skip_pages))


def normalised(text: str) -> str:
    return re.sub(r"\s+", " ", (text or "").strip())


def find_heading(page: str, title: str) -> int:
    """Where a heading starts on a page: as it is, else word by word, each within ten characters and its own length of the
    one before; a wider gap starts over behind the first word. -1 if nowhere."""
    lower, words = page.lower(), normalised(title).lower().split(" ")
    if not page or not words[0]:
        return -1
    if (whole := lower.find(title.lower())) >= 0:
        return whole
    start = 0
    while (first := lower.find(words[0], start)) >= 0:
        at, again = first + len(words[0]), False
        for word in words[1:]:
            found = lower.find(word, at)
            if found < 0:
                return -1
            if found - at > len(word) + 10:
                again = True
                break
            at = found + len(word)
        if not again:
            return first
        start = first + len(words[0])
    return -1


def heading_end(page: str, title: str, start: int) -> int:
    """Where the text behind a heading at `start` begins."""
    end, lower = start + len(title), page.lower()
    if lower[start:end] != title.lower():
        end = at = start
        for word in filter(None, normalised(title).lower().split(" ")):
            if (found := lower.find(word, at)) < 0:
                break
            end = at = found + len(word)
    while end < len(page) and page[end].isspace():
        end += 1
    return end


def mapped_offset(joined: str, broken: str, offset: int) -> int:
    """An offset into space-joined text as one into the same text with line breaks, by counting what is not white space."""
    if offset <= 0:
        return 0
    wanted = sum(not c.isspace() for c in joined[:offset])
    for k, c in enumerate(broken):
        wanted -= not c.isspace()
        if wanted <= 0:
            return k + 1
    return len(broken)


def locate(pages: dict[int, str], title: str, expected: int, total: int) -> tuple[int, int]:
    """The page and place of a heading: the expected page and the two after it, then the one before; else (-1, -1)."""
    for p in [*range(expected, min(expected + 2, total) + 1), expected - 1]:
        if p >= 1 and (at := find_heading(pages.get(p, ""), title)) >= 0:
            return p, at
    return -1, -1


def slice_outline(rows: list[tuple[str, str, int, int]], pages: dict[int, str], broken: dict[int, str]) -> list[tuple]:
    """rows: (title, full title, level, page). Each bookmark's text runs from behind its heading to where the next starts."""
    total, out = max(pages, default=0), []
    places = [(p, at) if (p := (found := locate(pages, title, page, total))[0]) > 0 and (at := found[1]) >= 0 else (page, 0) for title, _, _, page in rows]
    for k, (title, full, level, _) in enumerate(rows):
        first, start = places[k]
        begin = heading_end(pages.get(first, ""), title, start)
        last, stop = places[k + 1] if k + 1 < len(rows) else (total, None)
        texts = []
        for p in range(first, last + 1):
            joined = pages.get(p, "")
            if not joined:
                continue
            text = broken.get(p) or joined
            a = mapped_offset(joined, text, begin) if p == first else 0
            b = mapped_offset(joined, text, stop) if stop is not None and p == last else len(text)
            if part := text[a:b].strip():
                texts.append({"page_number": p, "text": part})
        if texts:
            out.append((title, full, level, first, texts[-1]["page_number"], texts))
    return out


def outline_sections(bookmarks: DataFrame, pages: DataFrame, max_depth: int | None = None, skip_pages: int = 0) -> DataFrame:
    """Sections of documents with an outline; pages: source_document, page_number, text and broken_text (or null). Headings
    are searched in sequence, so a document's rows meet in one task."""
    importable(pages.sparkSession)
    rows = outline_paths(bookmarks, max_depth, skip_pages)
    marks = rows.groupBy(DOC).agg(F.array_sort(F.collect_list(F.struct("page_number", "level", "seq", "title", "full_title"))).alias("marks"))
    texts = pages.where(F.col("page_number") > skip_pages).groupBy(DOC).agg(F.collect_list(F.struct("page_number", squeeze(F.col("text")).alias("text"), F.col("broken_text"))).alias("pages"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                joined = {p["page_number"]: p["text"] for p in r.pages}
                broken = {p["page_number"]: p["broken_text"] for p in r.pages if p["broken_text"]}
                out += [(r.source_document, *s) for s in slice_outline([(m["title"], m["full_title"], m["level"], m["page_number"]) for m in r.marks], joined, broken)]
            yield pd.DataFrame(out, columns=[DOC, "heading_text", "full_heading_path", "level", "start_page", "end_page", "page_texts"])

    return marks.join(texts, DOC).mapInPandas(run, SECTION)


def html_sections(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, section_index, level, heading, heading_path, text_chars) of the h1 to h3 headings of HTML pages, natively: the
    text between headings without tags, and the path of the nearest former headings of lower levels."""
    heading = r"(?is)<h([1-3])\b[^>]*>(.*?)</h[1-3]\s*>"
    bare = lambda c: squeeze(F.regexp_replace(c, r"(?s)<[^>]*>", " "))
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.regexp_extract_all(html, F.lit(heading), F.lit(1)).alias("_l"),
        F.regexp_extract_all(html, F.lit(heading), F.lit(2)).alias("_h"),
        F.slice(F.split(html, heading, -1), F.lit(2), F.greatest(F.lit(0), F.size(F.split(html, heading, -1)) - 1)).alias("_t"),
    )
    long = rows.select("id", F.posexplode(F.arrays_zip("_l", "_h", "_t")).alias("section_index", "_s"))
    long = long.select("id", "section_index", F.col("_s._l").cast("int").alias("level"), bare(F.col("_s._h")).alias("heading"), F.length(bare(F.col("_s._t"))).alias("text_chars"))
    order = W.partitionBy("id").orderBy("section_index").rowsBetween(W.unboundedPreceding, 0)
    last = {k: F.last(F.when(F.col("level") == k, F.struct("section_index", "heading")), ignorenulls=True).over(order) for k in (1, 2, 3)}
    long = long.withColumns({f"_{k}": c for k, c in last.items()})
    at = lambda k: F.coalesce(F.col(f"_{k}.section_index"), F.lit(-1))
    two = F.when((F.col("level") >= 2) & (at(2) > at(1)), F.col("_2.heading"))
    three = F.when((F.col("level") >= 3) & (at(3) > F.greatest(at(1), at(2))), F.col("_3.heading"))
    return long.select("id", "section_index", "level", "heading", F.concat_ws(" > ", F.col("_1.heading"), two, three).alias("heading_path"), "text_chars")
