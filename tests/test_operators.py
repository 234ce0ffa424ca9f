import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexivec.operators import adjacency, chunking, dense, fusion, rerank, sections, sparse

CHUNK = "chunk_id string, text string, source_document string, chunk_index int, chunk_total int, start_page int, end_page int, section string, section_path string"


def slow_split(c: chunking.Chunker, pages):
    """The rules of greedy filling, written down once more with plain counting."""
    out, parts, seen, used = [], [], set(), 0
    count = c.tokens.count

    def overlap(t):
        if not c.overlap_tokens or count(t) <= c.overlap_tokens:
            return ""
        start = max(k for k in range(len(t) + 1) if count(t[k:]) >= c.overlap_tokens)
        tail, cut = t[start:], 0
        for k in range(len(tail) - 1):
            if tail[k] in ".!?" and tail[k + 1].isspace():
                cut = k + 2
        return tail[cut:] if 0 < cut < len(tail) else tail

    def flush():
        nonlocal parts, seen, used
        t = " ".join(parts).strip()
        out.append((t, sorted(seen)))
        o = overlap(t)
        parts, used, seen = ([o], count(o), {max(seen)}) if o else ([], 0, set())

    for n, rest in pages:
        while rest:
            room = c.max_tokens - used - (1 if parts else 0)
            if room <= 0:
                flush()
            elif count(rest) <= room:
                used += count(rest) + (1 if parts else 0)
                parts.append(rest)
                seen.add(n)
                rest = ""
            else:
                k = max(k for k in range(len(rest) + 1) if count(rest[:k]) <= room)
                if k == 0:
                    piece = rest[:1]
                else:
                    ends = [i for i in range(max(0, k - k // 4), k) if rest[i] in ".!?"]
                    piece = rest[: ends[-1] + 1] if ends and ends[-1] > 0 else rest[:k]
                parts.append(piece)
                seen.add(n)
                rest = rest[len(piece) :]
                flush()
    if parts:
        out.append((" ".join(parts).strip(), sorted(seen)))
    return out


@pytest.mark.parametrize("size,overlap", [(5, 0), (7, 2), (12, 11), (3, 1)])
def test_greedy_chunks(size, overlap):
    text = "One two three. Four five! Six seven, eight nine? Ten eleven twelve thirteen. " * 3
    pages = [(1, text), (2, "Alpha beta gamma."), (4, "Word " * 30)]
    c = chunking.Chunker(size, overlap)
    assert c.split(pages) == slow_split(c, pages)
    other = chunking.Chunker(size, overlap, chunking.CountedTokens(chunking.WordTokens().count))
    assert other.split(pages) == c.split(pages)


def test_chunker_refuses():
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            chunking.Chunker(size, overlap)


def test_chunk_sections(spark):
    rows = [("d", "Head", "A > Head", 2, 3, 4, [(3, "one two"), (4, "three")]), ("e", "", "", 1, 1, 1, [(1, "  ")]), ("f", "", "", 1, 1, 1, [])]
    got = chunking.chunk_sections(spark.createDataFrame(rows, chunking.SECTION)).collect()
    assert len(got) == 1
    assert got[0]["text"] == "one two\nthree" and got[0]["section_path"] == "A > Head" and got[0]["metadata"] == {"ChunkType": "Bookmark", "BookmarkLevel": "2", "Pages": "3,4"}


WORDS = [
    ("Title", 1, 16.0, False, 10.0), ("Intro", 1, 12.0, False, 40.0), ("body", 1, 10.0, False, 60.0), ("text", 1, 10.0, False, 60.0), ("below", 1, 10.0, False, 75.0), ("more", 1, 10.0, False, 75.0),
    ("next", 2, 10.0, False, 10.0), ("page", 2, 10.0, False, 10.0), ("Strong", 2, 10.0, True, 40.0), ("end", 2, 10.0, False, 60.0),
]


def blocks(spark, words):
    rows = [("d", k, p, t, s, "F", b, False, "default", top, top + 10.0, float(k)) for k, (t, p, s, b, top) in enumerate(words)]
    return spark.createDataFrame(rows, "source_document string, seq int, page_number int, text string, font_size double, font_name string, is_bold boolean, is_italic boolean, color_key string, top double, bottom double, x0 double")


def test_format_sections(spark):
    got = sections.format_sections(blocks(spark, WORDS), max_heading_depth=3).orderBy("start_page", "heading_text").collect()
    assert [(r["heading_text"], r["full_heading_path"], r["level"]) for r in got] == [("Intro", "Intro", 2), ("Strong", "Intro > Strong", 3)]
    assert [(p["page_number"], p["text"]) for p in got[0]["page_texts"]] == [(1, "body text\nbelow more"), (2, "next page")]
    kept = sections.format_sections(blocks(spark, WORDS), max_heading_depth=3, keep_bodyless_headings=True).collect()
    assert {r["full_heading_path"] for r in kept} == {"Title > Intro", "Title > Intro > Strong"}
    with pytest.raises(ValueError):
        sections.format_sections(blocks(spark, WORDS), max_heading_depth=0)


def test_font_statistics_tie(spark):
    words = [("a", 1, 11.0, False, 0.0), ("b", 1, 10.0, False, 0.0), ("c", 1, 10.0, False, 0.0), ("d", 1, 11.0, False, 0.0), ("e", 1, 20.0, False, 0.0)]
    r = sections.font_statistics(blocks(spark, words)).first()
    assert r["body_size"] == 11.0 and r["heading_sizes"] == [20.0] and r["max_size"] == 20.0


def test_outlines(spark):
    marks = spark.createDataFrame([("d", 0, "One", 1, 1), ("d", 1, "Sub", 2, 1), ("d", 2, "Two", 1, 2), ("d", 3, "Deep", 2, None), ("d", 4, " ", 1, 1)], "source_document string, seq int, title string, level int, page_number int")
    paths = {r["title"]: r["full_title"] for r in sections.outline_paths(marks).collect()}
    assert paths == {"One": "One", "Sub": "One > Sub", "Two": "Two", "Deep": "Two > Deep"}
    pages = spark.createDataFrame([("d", 1, "x One first Sub second part", None), ("d", 2, "still Two third", "still\nTwo third")], "source_document string, page_number int, text string, broken_text string")
    got = {r["heading_text"]: [p["text"] for p in r["page_texts"]] for r in sections.outline_sections(marks.where("seq < 3"), pages).collect()}
    assert got == {"One": ["first"], "Sub": ["second part", "still"], "Two": ["third"]}


def test_heading_search():
    assert sections.find_heading("see the Great  Wall of", "great wall") == 8
    assert sections.find_heading("great xxxxxxxxxxxxxxxxxxxxxxxxx great wall", "great  wall") == 32
    assert sections.find_heading("nothing", "else") == -1
    assert sections.heading_end("Great  Wall of", "great wall", 0) == 12


def test_outlines_deeper_than_nine(spark):
    marks = spark.createDataFrame([("d", k, f"t{k}", k, 1) for k in range(1, 13)], "source_document string, seq int, title string, level int, page_number int")
    paths = {r["title"]: r["full_title"] for r in sections.outline_paths(marks).collect()}
    assert len(paths) == 12 and paths["t12"] == " > ".join(f"t{k}" for k in range(1, 13))
    assert sections.outline_paths(marks, 3).count() == 3 and sections.outline_paths(marks.limit(0)).count() == 0


def test_simple_sections(spark):
    pages = spark.createDataFrame([("d", 1, "skip"), ("d", 2, " b "), ("d", 3, "  "), ("e", 1, " ")], "source_document string, page_number int, text string")
    got = sections.simple_sections(pages, 1).collect()
    assert [(r["source_document"], r["start_page"], r["end_page"], [p["text"] for p in r["page_texts"]]) for r in got] == [("d", 2, 3, ["b"])]


def hits(spark, rows):
    return spark.createDataFrame(rows, CHUNK + ", rank int")


def test_adjacency(spark):
    chunks = [(f"{d}{i}", f"t{i}", d, i, 5 if d == "a" else 0, 1, 1, None, None) for d in "ab" for i in range(5)]
    store = spark.createDataFrame(chunks, CHUNK)
    found = hits(spark, [(*chunks[0], 1), (*chunks[4], 2), (*chunks[3], 3), (*chunks[7], 4)])
    got = adjacency.expand(found, store, 1).orderBy("rank").collect()
    assert [(r["chunk_id"], r["is_hit"]) for r in got] == [("a0", True), ("a4", True), ("a3", True), ("b2", True), ("a1", False), ("a2", False), ("b1", False), ("b3", False)]
    assert adjacency.expand(found, store, 0).count() == 4
    assert [r["chunk_id"] for r in adjacency.fetch(store, "a", [1, 9]).collect()] == ["a1"] and adjacency.fetch(store, "a", []).count() == 0


def test_cosine_batch_in_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(50)] + [(50, [])]
    corpus = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    queries = corpus.where("vec_id % 10 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    whole = sorted(map(tuple, dense.cosine_batch_top_k(corpus, queries, 4).collect()))
    monkeypatch.setattr(dense, "QUERY_NUMBERS", 4)
    assert sorted(map(tuple, dense.cosine_batch_top_k(corpus, queries, 4).collect())) == whole
    one = dense.cosine_top_k(corpus, rows[10][1], 4).collect()
    assert [(r["vec_id"], r["score"]) for r in one] == [(i, s) for q, i, s, _ in sorted(whole, key=lambda r: r[3]) if q == 10]


def test_prefetch_and_fusion(spark):
    assert fusion.prefetch_sizes(10) == (28, 12) and fusion.prefetch_sizes(10, 0, 0) == (10, 10)
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "query_id int, id int, rank int")
    b = spark.createDataFrame([(0, 2, 1), (0, 3, 2)], "query_id int, id int, rank int")
    assert [(r["id"], r["score"]) for r in fusion.fuse([a, b], 5).orderBy("rank").collect()] == [(2, round(0.5 + 1 / 3, 6)), (1, 0.5), (3, round(1 / 3, 6))]


def test_sparse_stats_can_be_frozen(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, "!!"), (4, None)], "id bigint, text string")
    p = sparse.term_frequency(docs, "id", "text")
    s = sparse.corpus_stats(docs, "id", "text").first()
    assert (s["n"], s["total_length"], s["average_length"], s["n_terms"]) == (2, 5, 2.5, 3)
    assert sparse.corpus_totals(docs.limit(0), "text").first()["average_length"] == 1.0
    weights = sparse.bm25_weights(p, sparse.document_frequency(p), sparse.corpus_totals(docs, "text"))
    assert weights.count() == 4
    packed = sparse.packed(weights)
    assert [x["idx"] for x in packed.where("id = 1").first()["vector"]] == sorted(x["idx"] for x in packed.where("id = 1").first()["vector"])
    assert sparse.unpacked(packed).count() == 4


RERANK = "query_id int, query string, source_document string, section_path string, section string, text string, start_page int, end_page int, original_rank int"


def test_rerank(spark):
    h = spark.createDataFrame([(0, "x y", "d", None, None, t, 1, 2, k + 1) for k, t in enumerate(["none", "x", "x y", "y"])], RERANK)
    got = rerank.cross_encoder(h, rerank.lexical_scorer, 3).orderBy("new_rank").collect()
    assert [(r["original_rank"], r["relevance_score"]) for r in got] == [(3, 10.0), (2, 5.0), (4, 5.0)]
    short = rerank.cross_encoder(h, lambda q, t: pd.Series([0.5]), 2).orderBy("new_rank").collect() if h.count() > 1 else []
    assert [(r["original_rank"], round(r["relevance_score"], 3)) for r in short][:1] == [(1, 5.0)]
    replies = spark.createDataFrame([(0, '[{"score":4},{"score":9},{"score":6},{}]')], "query_id int, reply string")
    got = rerank.language_model(h, replies, 5).orderBy("new_rank").collect()
    assert [(r["original_rank"], r["relevance_score"]) for r in got] == [(2, 9.0), (3, 6.0), (4, 5.0)]
    assert "Chunk: 3" in rerank.prompts(h).first()["prompt"]


def test_context(spark):
    rows = [(0, "q", "d", "A > B", "B", "text one", 1, 2, 1), (0, "q", "d", "d", "S", "text two", 3, 3, 2), (0, "q", "d", "d", "d", None, None, 3, 3)]
    got = rerank.context(spark.createDataFrame(rows, RERANK), "original_rank").first()["context"]
    assert got == "Context from documents:\n\n[Source: d, Section: A > B, Pages: 1-2]\ntext one\n\n[Source: d, Section: S, Pages: 3-3]\ntext two\n\n[Source: d, Pages: None-3]\n\n"


def test_paragraph_breaks(spark):
    words = [("End.", 1, 10.0, False, 0.0), ("Next", 1, 10.0, False, 15.0), ("line", 1, 10.0, False, 30.0), ("far", 1, 10.0, False, 60.0)]
    got = [r["breaks"] for r in sections.paragraph_breaks(blocks(spark, words)).orderBy("seq").collect()]
    assert got == [False, True, False, True]


def test_html(spark):
    pages = spark.createDataFrame([(1, "<h1>A <b>x</b></h1>t<h2>B</h2>u<h3>C</h3><h1>D</h1><h3>E</h3>"), (2, None)], "page_id bigint, html string")
    got = sections.html_sections(pages).orderBy("section_index").collect()
    assert [r["heading_path"] for r in got] == ["A x", "A x > B", "A x > B > C", "D", "D > E"]
    assert F.col("x") is not None
