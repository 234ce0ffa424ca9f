"""The queries of the engine's own operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexivec.functions.scores import parsed_scores
from lexivec.functions.text import sha1_prefix, term_hash, tokens, uuid5
from lexivec.functions.vectors import l2_normalised, norm
from lexivec.operators import adjacency, chunking, dense, fusion, rerank, sections, sparse
from lexivec.plans.service import RagService, Settings
from lexivec.session import importable, scratch
from lexivec.sources import files
from lexivec.sources.store import ChunkStore, from_payload, latest, to_payload

QUERY = "the thing and of ther shore entation ing"
FENCE = "```"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.term_frequency(read(spark, sf_dir, "documents"), "doc_id", "text")


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, QUERY)], "query_id bigint, query string")


def tokenize_counts(spark, sf_dir):
    words = tokens(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"))


def term_frequency(spark, sf_dir):
    return postings(spark, sf_dir).select(F.col("id").alias("doc_id"), "term", "tf", "length")


def document_frequency(spark, sf_dir):
    return sparse.document_frequency(postings(spark, sf_dir))


def corpus_stats(spark, sf_dir):
    return sparse.corpus_stats(read(spark, sf_dir, "documents"), "doc_id", "text").withColumn("average_length", F.round("average_length", 6))


def bm25_weights(spark, sf_dir):
    found = postings(spark, sf_dir)
    weights = sparse.bm25_weights(found, sparse.document_frequency(found), sparse.corpus_totals(read(spark, sf_dir, "documents"), "text"))
    return weights.select(F.col("id").alias("doc_id"), "term", F.round("weight", 6).alias("weight"))


def tf_sparse_weights(spark, sf_dir):
    return sparse.tf_weights(postings(spark, sf_dir)).select(F.col("id").alias("doc_id"), "term", F.round("weight", 6).alias("weight"))


def _named(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("doc_id"), "score", "rank")


def bm25_topk(spark, sf_dir):
    return _named(sparse.top_k(sparse.sparse_scores(read(spark, sf_dir, "documents"), "doc_id", "text", asked(spark)), 10))


def bm25_classic_topk(spark, sf_dir):
    return _named(sparse.top_k(sparse.sparse_scores(read(spark, sf_dir, "documents"), "doc_id", "text", asked(spark), classic=True), 10))


def idf_query_topk(spark, sf_dir):
    return _named(sparse.top_k(sparse.sparse_scores(read(spark, sf_dir, "documents"), "doc_id", "text", asked(spark), "idf"), 10))


def bm25_batch_topk(spark, sf_dir):
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return sparse.top_k(sparse.sparse_scores(read(spark, sf_dir, "documents"), "doc_id", "text", queries), 5).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


def _vector(df: DataFrame) -> list[float]:
    first = df.orderBy("vec_id").select("embedding").first()
    return list(first["embedding"]) if first else []


def cosine_topk(spark, sf_dir):
    corpus = read(spark, sf_dir, "embeddings")
    return dense.cosine_top_k(corpus, _vector(corpus), 10)


def cosine_batch_topk(spark, sf_dir):
    corpus = read(spark, sf_dir, "embeddings")
    queries = corpus.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return dense.cosine_batch_top_k(corpus, queries, 10)


def l2_normalize_norms(spark, sf_dir):
    v = l2_normalised(F.col("embedding"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"), F.round(norm(v), 6).alias("unit_norm"), F.round(F.element_at(v, 1), 6).alias("first"))


def centroid_by_label(spark, sf_dir):
    return dense.centroids(read(spark, sf_dir, "embeddings")).select("label", "pos", F.round("mean", 6).alias("mean"), "n")


def _prefetch(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    n_dense, n_sparse = fusion.prefetch_sizes(10)
    near = cosine_topk_n(spark, sf_dir, n_dense)
    return near, sparse.top_k(sparse.sparse_scores(read(spark, sf_dir, "documents"), "doc_id", "text", asked(spark)), n_sparse)


def cosine_topk_n(spark, sf_dir, n: int) -> DataFrame:
    corpus = read(spark, sf_dir, "embeddings")
    return dense.cosine_top_k(corpus, _vector(corpus), n).select(F.lit(0).cast("bigint").alias("query_id"), F.col("vec_id").alias("id"), "score", "rank")


def prefetch_topk(spark, sf_dir):
    near, found = _prefetch(spark, sf_dir)
    return near.withColumn("side", F.lit("dense")).unionByName(found.withColumn("side", F.lit("sparse"))).select("side", "id", "score", "rank")


def hybrid_topk(spark, sf_dir):
    return _named(fusion.fuse(list(_prefetch(spark, sf_dir)), 10))


def rrf_fusion(spark, sf_dir):
    """The literature's constant of 60 over whole lists of 50."""
    found = sparse.top_k(sparse.sparse_scores(read(spark, sf_dir, "documents"), "doc_id", "text", asked(spark), classic=True), 50)
    return _named(fusion.fuse([cosine_topk_n(spark, sf_dir, 50), found], 20, rrf_k=60))


def fixed_stride_chunks(spark, sf_dir):
    found = chunking.fixed_stride_chunks(read(spark, sf_dir, "documents"), "doc_id", "text", 128, 16)
    return found.select(F.col("id").alias("doc_id"), F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("chunk_total").cast("bigint").alias("chunk_total"), F.col("n_tokens").cast("bigint").alias("n_tokens"), F.sha1("text").alias("text_sha1"))


def chunk_ids(spark, sf_dir):
    document, path = F.concat(F.lit("doc_"), F.col("doc_id").cast("string")), F.concat("lang", F.lit(" > "), "source")
    return read(spark, sf_dir, "documents").select("doc_id", chunking.chunk_id(document, path, F.lit(0)).alias("chunk_id"), chunking.chunk_id(document, F.lit(""), F.lit(0)).alias("bare_id"), sha1_prefix(path, 10).alias("short_hash"))


def embedding_text(spark, sf_dir):
    text = chunking.embedding_text(F.col("source"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang")), F.lit("body"), F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha1(text).alias("text_sha1"), F.length(text).cast("bigint").alias("n_chars"))


def greedy_chunks(spark, sf_dir):
    whole = chunking.sections_of_lines(read(spark, sf_dir, "documents"), "doc_id", "text")
    return chunking.chunk_sections(whole).select("chunk_id", "source_document", "chunk_index", "chunk_total", "start_page", "end_page", "section", "section_path", "text")


def chats_as_chunks(spark, sf_dir) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    total = turns.groupBy("conv_id").agg(F.count("*").cast("int").alias("chunk_total"))
    return turns.join(total, "conv_id").select(F.concat_ws("_", "conv_id", "turn").alias("chunk_id"), "text", F.col("conv_id").cast("string").alias("source_document"), F.col("turn").cast("int").alias("chunk_index"), "chunk_total", F.col("turn").cast("int").alias("start_page"), F.col("turn").cast("int").alias("end_page"), F.col("role").alias("section"), F.lit(None).cast("string").alias("section_path"))


def read_chats(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("chunk_id"), "text")


def _chat_hits(spark, sf_dir, k: int) -> tuple[DataFrame, DataFrame]:
    chunks = chats_as_chunks(spark, sf_dir)
    best = sparse.top_k(sparse.sparse_scores(read_chats(spark, sf_dir), "chunk_id", "text", asked(spark)), k)
    return chunks.join(F.broadcast(best.select(F.col("id").alias("chunk_id"), "rank")), "chunk_id").select(*chunks.columns, "rank"), chunks


def adjacent_expand(spark, sf_dir):
    hits, chunks = _chat_hits(spark, sf_dir, 20)
    return adjacency.expand(hits, chunks, 1).select("source_document", "chunk_index", "is_hit", "rank")


def fetch_by_indices(spark, sf_dir):
    keys = spark.createDataFrame([(str(c), None, i) for c in range(30) for i in (0, 2)], "source_document string, section_path string, chunk_index int")
    return adjacency.fetch_many(chats_as_chunks(spark, sf_dir), keys).select("source_document", "chunk_index", F.sha1("text").alias("text_sha1"))


def fetch_neighbours(spark, sf_dir):
    """By keys from a whole table: the indices beside each user's turn, in every conversation."""
    asked = read(spark, sf_dir, "conversations").where("role = 'user'")
    keys = asked.select(F.col("conv_id").cast("string").alias("source_document"), F.lit(None).cast("string").alias("section_path"), F.explode(F.array((F.col("turn") - 1).cast("int"), (F.col("turn") + 1).cast("int"))).alias("chunk_index"))
    return adjacency.fetch_many(chats_as_chunks(spark, sf_dir), keys).select("source_document", "chunk_index", F.sha1("text").alias("text_sha1"))


def upsert_latest(spark, sf_dir):
    old = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    new = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), "text")
    return latest(old, new).select("chunk_id", F.sha1("text").alias("text_sha1"))


def texts_as_chunks(spark, sf_dir, table: str, key: str, document: Column) -> DataFrame:
    """A table's texts as chunks of documents, numbered in each by key."""
    whole = W.partitionBy("source_document")
    rows = read(spark, sf_dir, table).select(F.col(key).alias("k"), "text", document.cast("string").alias("source_document"))
    none = lambda kind: F.lit(None).cast(kind)
    return rows.select(F.col("k").cast("string").alias("chunk_id"), "text", "source_document", (F.row_number().over(whole.orderBy("k")) - 1).cast("int").alias("chunk_index"), F.count("*").over(whole).cast("int").alias("chunk_total"), none("int").alias("start_page"), none("int").alias("end_page"), none("string").alias("section"), none("string").alias("section_path"), none("array<float>").alias("embedding"), none("map<string,string>").alias("metadata"))


def _store(spark, sf_dir) -> ChunkStore:
    """A fresh store of all documents, by source."""
    store = ChunkStore(spark, scratch(spark, "store"), buckets=8)
    store.append(texts_as_chunks(spark, sf_dir, "documents", "doc_id", F.col("source")))
    return store


def _items(spark, sf_dir) -> DataFrame:
    return texts_as_chunks(spark, sf_dir, "benchmark", "item_id", F.lit("benchmark"))


def _stored(store: ChunkStore) -> DataFrame:
    return store.read().select("chunk_id", "source_document", F.sha1("text").alias("text_sha1"))


def store_upsert(spark, sf_dir):
    """Items replace the documents of their numbers, which lie under other documents and so in other buckets."""
    store = _store(spark, sf_dir)
    store.upsert(_items(spark, sf_dir))
    return _stored(store)


def store_append(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.append(_items(spark, sf_dir))
    return _stored(store)


def store_clear(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.clear()
    store.append(_items(spark, sf_dir))
    return _stored(store)


def delete_document(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.delete_document("src0")
    return store.read().select(F.col("chunk_id").cast("bigint").alias("doc_id"), F.col("source_document").alias("source"))


def stored_bm25_topk(spark, sf_dir):
    """bm25_topk over the sparse vectors that the store keeps."""
    found = sparse.top_k(sparse.counted_scores(_store(spark, sf_dir).counts().withColumn("id", F.col("id").cast("bigint")), asked(spark)), 10)
    return _named(found)


def stored_tf_topk(spark, sf_dir):
    """idf_query_topk over the sparse vectors that the store keeps."""
    found = sparse.top_k(sparse.counted_scores(_store(spark, sf_dir).counts().withColumn("id", F.col("id").cast("bigint")), asked(spark), "idf"), 10)
    return _named(found)


def rag_search_hybrid(spark, sf_dir):
    """The service over a store: dense and sparse lists, their fusion, the best 5 and their neighbours. Documents have the
    vectors of their numbers, ten a file; the query has the first vector."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("_v"))
    chunks = texts_as_chunks(spark, sf_dir, "documents", "doc_id", F.concat(F.lit("d"), F.floor(F.col("doc_id") / 10)))
    chunks = chunks.join(vectors, "chunk_id", "left").withColumn("embedding", F.col("_v")).drop("_v")
    store, first = ChunkStore(spark, scratch(spark, "store"), buckets=8), _vector(read(spark, sf_dir, "embeddings"))
    store.append(chunks)
    service = RagService(store, Settings(mode="hybrid", truncate_before_expand=True), embedder=lambda texts: texts.map(lambda _: first))
    return service.search(QUERY, 5).select(F.col("chunk_id").cast("bigint").alias("doc_id"), "is_hit", "rank")


def llm_rerank_topk(spark, sf_dir):
    """Two queries of the same hits: one whose reply scores them by their ids, one that got no reply."""
    hits = _rerank_hits(spark, sf_dir)
    score = F.struct("original_rank", F.format_string('{"id":%d,"score":%d}', F.col("original_rank") - 1, F.col("doc_id") % 11).alias("s"))
    replies = hits.groupBy("query_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(score)), lambda x: x["s"]), ","), F.lit("]")).alias("reply"))
    both = hits.unionByName(hits.withColumn("query_id", F.lit(1)))
    return rerank.language_model(both, replies, 5).select("query_id", "doc_id", F.round("relevance_score", 6).alias("relevance_score"), "original_rank", "new_rank")


def _rerank_hits(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    best = sparse.top_k(sparse.sparse_scores(read(spark, sf_dir, "documents"), "doc_id", "text", asked(spark)), 20)
    hits = docs.join(F.broadcast(best.select(F.col("id").alias("doc_id"), F.col("rank").alias("original_rank"))), "doc_id")
    return hits.select(F.lit(0).alias("query_id"), F.lit(QUERY).alias("query"), "doc_id", F.col("source").alias("source_document"), F.col("lang").alias("section_path"), F.lit("").alias("section"), "text", "original_rank")


def rerank_scores_topk(spark, sf_dir):
    found = rerank.cross_encoder(_rerank_hits(spark, sf_dir), rerank.lexical_scorer, 5)
    return found.select("doc_id", F.round("relevance_score", 6).alias("relevance_score"), "original_rank", "new_rank")


def rerank_min_relevance(spark, sf_dir):
    hits = rerank.score_pairs(_rerank_hits(spark, sf_dir), rerank.lexical_scorer, "s").withColumn("relevance_score", F.round(F.col("s") * 10, 6))
    return rerank.minimum_relevance(hits, 5, 7.0).select("doc_id", "relevance_score", "original_rank", "new_rank")


def _replies(spark, sf_dir) -> DataFrame:
    """A reply of each shape a model may give: good, fenced, a score over 10, one missing, wrong length, no JSON."""
    n = F.col("n_chars").cast("string")
    shape = F.col("doc_id") % 5
    good = F.concat(F.lit('[{"id":0,"score":'), (F.col("n_chars") % 14).cast("string"), F.lit('},{"id":1},{"id":2,"score":2.5}]'))
    reply = F.when(shape == 0, good).when(shape == 1, F.concat(F.lit(FENCE + "json\n"), good, F.lit("\n" + FENCE))).when(shape == 2, F.lit('[{"id":0,"score":9}]')).when(shape == 3, F.concat(F.lit("none "), n)).otherwise(F.concat(F.lit("  "), good))
    return read(spark, sf_dir, "documents").select("doc_id", reply.alias("reply"))


def llm_score_parse(spark, sf_dir):
    scores = _replies(spark, sf_dir).select("doc_id", F.posexplode(parsed_scores(F.col("reply"), F.lit(3))).alias("pos", "score"))
    return scores.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "score")


def context_string(spark, sf_dir):
    hits, _ = _chat_hits(spark, sf_dir, 5)
    return rerank.context(hits.withColumn("query_id", F.lit(0))).select("query_id", "context")


def html_heading_sections(spark, sf_dir):
    found = sections.html_sections(read(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), F.col("section_index").cast("bigint").alias("section_index"), "level", "heading", "heading_path")


def blocks(spark, sf_dir) -> DataFrame:
    """Documents as word blocks: seven words a line, capitalised words set larger, each text line a page."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line"))
    words = lines.select("doc_id", "p", F.posexplode(F.split("line", " ", -1)).alias("w", "word")).where("word <> ''")
    size = F.when(F.col("word").rlike("^[A-Z]"), 14.04).when(F.length("word") > 9, 12.04).otherwise(10.04)
    top = F.floor(F.col("w") / 7) * 12.0
    return words.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source_document"), (F.col("p") * 100000 + F.col("w")).cast("int").alias("seq"), (F.col("p") + 1).alias("page_number"), F.col("word").alias("text"),
        size.alias("font_size"), F.lit("Serif").alias("font_name"), F.lit(False).alias("is_bold"), F.lit(False).alias("is_italic"), F.lit("default").alias("color_key"), top.alias("top"), (top + 10.0).alias("bottom"), (F.col("w") % 7).cast("double").alias("x0"),
    )


def font_statistics(spark, sf_dir):
    found = sections.font_statistics(blocks(spark, sf_dir))
    return found.select("source_document", F.round("average_size", 6).alias("average_size"), "max_size", "min_size", "body_size", F.array_join(F.col("heading_sizes").cast("array<string>"), ",").alias("heading_sizes"))


def line_breaks(spark, sf_dir):
    return sections.line_breaks(blocks(spark, sf_dir)).groupBy("source_document", "page_number").agg(F.sum(F.col("breaks").cast("bigint")).alias("n_breaks"), F.count("*").alias("n_words"))


def format_sections(spark, sf_dir):
    return sections.format_sections(blocks(spark, sf_dir)).select("source_document", "heading_text", "full_heading_path", "level", "start_page", "end_page", F.size("page_texts").alias("n_pages"))


def term_hashes(spark, sf_dir):
    """Terms that share their CRC-32 with another one, if any, and how many numbers there are."""
    terms = postings(spark, sf_dir).select("term").distinct().withColumn("h", term_hash(F.col("term")))
    return terms.agg(F.count("*").alias("n_terms"), F.countDistinct("h").alias("n_hashes"), F.max("h").alias("max_hash"))


def hashed_vectors(spark, sf_dir):
    """Every document through the default embedder."""
    found = dense.embed(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", dense.hashed_embedding(64))
    return found.select("doc_id", F.size("embedding").alias("dimensions"), F.round(norm(F.col("embedding")), 4).alias("norm"))


def rag_search(spark, sf_dir):
    """Sparse retrieval of twice k, neighbours, the lexical reranker, the best k: over conversations, turn by turn."""
    hits, chunks = _chat_hits(spark, sf_dir, 10)
    wide = adjacency.expand(hits, chunks, 1).withColumns({"query_id": F.lit(0), "query": F.lit(QUERY), "original_rank": F.col("rank")})
    found = rerank.cross_encoder(wide, rerank.lexical_scorer, 5)
    return found.select("source_document", "chunk_index", "is_hit", F.round("relevance_score", 6).alias("relevance_score"), "original_rank", "new_rank")


def readable_blocks(spark, sf_dir):
    """Words that are left of each document after its first page, without the largest ones."""
    return sections.readable(blocks(spark, sf_dir), skip_pages=1, max_font_size=13.0).groupBy("source_document").agg(F.count("*").alias("n_words"), F.max("page_number").cast("bigint").alias("last_page"))


def simple_sections(spark, sf_dir):
    """A section a document, each text line a page, without the first page."""
    lines = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source_document"), F.posexplode(F.split("text", "\n", -1)).alias("p", "text"))
    found = sections.simple_sections(lines.withColumn("page_number", F.col("p") + 1), skip_pages=1)
    return found.select("source_document", "start_page", "end_page", F.size("page_texts").cast("bigint").alias("n_pages"))


def paragraph_breaks(spark, sf_dir):
    """Breaks by the finer rule, with lines set twice as far apart."""
    apart = blocks(spark, sf_dir).where("text RLIKE '[^ ]'").withColumns({"top": F.col("top") * 2, "bottom": F.col("top") * 2 + 10.0})
    return sections.paragraph_breaks(apart).groupBy("source_document", "page_number").agg(F.sum(F.col("breaks").cast("bigint")).alias("n_breaks"))


def name_uuids(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", uuid5(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))).alias("point_id"))


def json_round_trip(spark, sf_dir):
    path = scratch(spark, "chunks")
    files.write_chunks_json(_items(spark, sf_dir), path)
    return files.read_chunks(spark, path, "jsonl").select("chunk_id", "chunk_index", F.sha1("text").alias("text_sha1"))


def stats_round_trip(spark, sf_dir):
    path = scratch(spark, "stats")
    files.write_stats(document_frequency(spark, sf_dir), sparse.corpus_totals(read(spark, sf_dir, "documents"), "text"), path)
    df, totals = files.read_stats(spark, path)
    return df.crossJoin(F.broadcast(totals.select("n", "total_length")))  # one row


def payload_round_trip(spark, sf_dir):
    """Documents with a vector as a vector service's points, and back."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("_v"))
    chunks = texts_as_chunks(spark, sf_dir, "documents", "doc_id", F.col("source")).join(vectors, "chunk_id", "left").withColumn("embedding", F.col("_v")).drop("_v")
    return from_payload(to_payload(chunks)).select("chunk_id", "source_document", "chunk_index", "chunk_total", F.sha1("text").alias("text_sha1"), F.size("embedding").alias("dimensions"))


def best_turn_rank(spark, sf_dir):
    """Each conversation's turns by length: the rank window that hits and lists use."""
    order = W.partitionBy("conv_id").orderBy(F.desc(F.length("text")), "turn")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(order).alias("rank"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tokenize_counts, term_frequency, document_frequency, corpus_stats, bm25_weights, bm25_topk, bm25_classic_topk, bm25_batch_topk, cosine_topk, cosine_batch_topk, l2_normalize_norms, centroid_by_label,
        tf_sparse_weights, idf_query_topk, prefetch_topk, rrf_fusion, hybrid_topk, fixed_stride_chunks, chunk_ids, embedding_text, greedy_chunks, adjacent_expand, fetch_by_indices, fetch_neighbours, upsert_latest, delete_document,
        rerank_scores_topk, rerank_min_relevance, llm_score_parse, context_string, html_heading_sections, font_statistics, line_breaks, format_sections, term_hashes, hashed_vectors, rag_search, best_turn_rank,
        store_upsert, store_append, store_clear, stored_bm25_topk, stored_tf_topk, rag_search_hybrid, llm_rerank_topk,
        readable_blocks, simple_sections, paragraph_breaks, name_uuids, json_round_trip, stats_round_trip, payload_round_trip,
    )
}


_POSTINGS = r"""
d AS (SELECT doc_id AS id, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+'), lambda x: lower(x)) AS t FROM documents),
tf AS (SELECT id, term, count(*)::BIGINT AS tf, any_value(n)::BIGINT AS length FROM (SELECT id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY id, term),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS n, coalesce(sum(length), 0)::BIGINT AS total, CASE WHEN count(*) > 0 THEN sum(length)::DOUBLE / count(*) ELSE 1.0::DOUBLE END AS avg FROM (SELECT id, any_value(length) AS length FROM tf GROUP BY id))"""
_IDF = "ln((greatest(1, n) - coalesce(df, 0) + 0.5::DOUBLE) / (coalesce(df, 0) + 0.5::DOUBLE) + 1)"


def _tf(average: str) -> str:
    return f"(tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / {average})))"


def _asked(text: str = QUERY) -> str:
    return f"q AS (SELECT term, count(*)::BIGINT AS tf, any_value(n)::BIGINT AS length FROM (SELECT len(t) AS n, unnest(t) AS term FROM (SELECT regexp_extract_all(lower('{text}'), '[a-z0-9_]+') AS t)) GROUP BY term)"


def _scores(document: str, query: str) -> str:
    """All scores of the one query; weights in terms of tf, length, df, n and avg."""
    return f"""s AS (SELECT id, round(sum(wd * wq), 6) AS score FROM (SELECT id, term, {document} AS wd FROM tf JOIN df USING (term), st) JOIN
     (SELECT term, {query} AS wq FROM q LEFT JOIN df USING (term), st) USING (term) GROUP BY id)"""


_BM25 = _scores(f"{_IDF} * {_tf('avg')}", f"{_IDF} * {_tf('avg')}")
_CLASSIC = _scores(f"{_IDF} * {_tf('avg')}", "1.0::DOUBLE")
_IDF_ONCE = _scores(f"{_IDF} * {_tf('512.0::DOUBLE')}", _tf("512.0::DOUBLE"))


def _best(k: int, name: str = "doc_id") -> str:
    return f"SELECT id AS {name}, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM s QUALIFY rank <= {k}"


_COSINE = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0),
o AS (SELECT e AS q FROM v ORDER BY id LIMIT 1),
c AS (SELECT id, round(coalesce(list_cosine_similarity(e, q), 0), 6) AS score FROM v, o)"""


def _near(k: int) -> str:
    return f"SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM c QUALIFY rank <= {k}"


def _fused(k: int, n_dense: int, n_sparse: int, rrf: str, scores: str) -> str:
    return f"""WITH {_POSTINGS}, {_asked()}, {scores}, {_COSINE}, a AS ({_near(n_dense)}), b AS ({_best(n_sparse, 'id')}),
f AS (SELECT id, round(sum(x), 6) AS score FROM (SELECT id, 1.0::DOUBLE / ({rrf} + rank - 1) AS x FROM a UNION ALL SELECT id, 1.0::DOUBLE / ({rrf} + rank - 1) FROM b) GROUP BY id)
SELECT id AS doc_id, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM f QUALIFY rank <= {k}"""


_CHATS = _POSTINGS.replace("doc_id AS id", "conv_id || '_' || turn AS id").replace("FROM documents", "FROM conversations")


def _chat_best(k: int) -> str:
    return f"""WITH {_CHATS}, {_asked()}, {_BM25}, b AS ({_best(k, 'id')}),
ch AS (SELECT conv_id || '_' || turn AS id, conv_id::VARCHAR AS source_document, turn::INTEGER AS chunk_index, (count(*) OVER (PARTITION BY conv_id))::INTEGER AS total, role, text FROM conversations),
h AS (SELECT ch.*, b.rank FROM ch JOIN b USING (id)),
e AS (SELECT source_document, i AS chunk_index, min(rank) AS parent FROM (SELECT source_document, total, rank, chunk_index, unnest([chunk_index - 1, chunk_index + 1]) AS i FROM h) WHERE i >= 0 AND i < total GROUP BY ALL),
x AS (SELECT e.* FROM e ANTI JOIN h USING (source_document, chunk_index)),
n AS (SELECT ch.*, parent FROM x JOIN ch USING (source_document, chunk_index)),
w AS (SELECT source_document, chunk_index, text, role, true AS is_hit, rank FROM h UNION ALL
      SELECT source_document, chunk_index, text, role, false, ((SELECT max(rank) FROM h) + row_number() OVER (ORDER BY parent, source_document, chunk_index))::INTEGER FROM n)"""


_WORDS = "regexp_extract_all(lower({}), '[a-z0-9_]+')"
_OVERLAP = f"len(list_intersect(list_distinct({_WORDS.format(repr(QUERY))}), list_distinct({{words}})))::DOUBLE / len(list_distinct({_WORDS.format(repr(QUERY))}))"
_RERANK = f"""WITH {_POSTINGS}, {_asked()}, {_BM25}, b AS ({_best(20)}),
r AS (SELECT doc_id, rank AS original_rank, 'Document: ' || source || chr(10) || 'Section: ' || lang || chr(10) || chr(10) || text AS p FROM b JOIN documents USING (doc_id)),
y AS (SELECT doc_id, original_rank, round({_OVERLAP.format(words="list_transform(regexp_extract_all(p, '[A-Za-z0-9_]+'), lambda x: lower(x))")} * 10, 6) AS relevance_score FROM r)"""

_BLOCKS = """w AS (SELECT doc_id, p, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) - 1 AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents)),
bl AS (SELECT 'doc_' || doc_id AS source_document, (p - 1) * 100000 + w AS seq, p::INTEGER AS page_number, word, w, CASE WHEN regexp_matches(word, '^[A-Z]') THEN 14.04::DOUBLE WHEN length(word) > 9 THEN 12.04::DOUBLE ELSE 10.04::DOUBLE END AS size FROM w WHERE regexp_matches(word, '[^\\s]'))"""

_HEADING = "(?is)<h([1-3])\\b[^>]*>(.*?)</h[1-3]\\s*>"

ORACLES: dict[str, str] = {
    "tokenize_counts": f"WITH {_POSTINGS} SELECT id AS doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM d",
    "term_frequency": f"WITH {_POSTINGS} SELECT id AS doc_id, term, tf, length FROM tf",
    "document_frequency": f"WITH {_POSTINGS} SELECT term, df FROM df",
    "corpus_stats": f"WITH {_POSTINGS} SELECT n::BIGINT AS n, total AS total_length, round(avg, 6) AS average_length, (SELECT count(*) FROM df)::BIGINT AS n_terms FROM st",
    "bm25_weights": f"WITH {_POSTINGS} SELECT id AS doc_id, term, round({_IDF} * {_tf('avg')}, 6) AS weight FROM tf JOIN df USING (term), st",
    "tf_sparse_weights": f"WITH {_POSTINGS} SELECT id AS doc_id, term, round({_tf('512.0::DOUBLE')}, 6) AS weight FROM tf",
    "bm25_topk": f"WITH {_POSTINGS}, {_asked()}, {_BM25} {_best(10)}",
    "bm25_classic_topk": f"WITH {_POSTINGS}, {_asked()}, {_CLASSIC} {_best(10)}",
    "idf_query_topk": f"WITH {_POSTINGS}, {_asked()}, {_IDF_ONCE} {_best(10)}",
    "bm25_batch_topk": f"""WITH {_POSTINGS},
q AS (SELECT query_id, term, count(*)::BIGINT AS tf, any_value(n)::BIGINT AS length FROM (SELECT query_id, len(t) AS n, unnest(t) AS term FROM (SELECT item_id AS query_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS t FROM benchmark)) GROUP BY query_id, term),
s AS (SELECT query_id, id AS doc_id, round(sum(wd * wq), 6) AS score FROM (SELECT id, term, {_IDF} * {_tf('avg')} AS wd FROM tf JOIN df USING (term), st) JOIN (SELECT query_id, term, {_IDF} * {_tf('avg')} AS wq FROM q LEFT JOIN df USING (term), st) USING (term) GROUP BY ALL)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s QUALIFY rank <= 5""",
    "cosine_topk": f"WITH {_COSINE} SELECT id AS vec_id, score, rank FROM ({_near(10)})",
    "cosine_batch_topk": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0),
c AS (SELECT q.vec_id AS query_id, v.vec_id, round(coalesce(list_cosine_similarity(q.e, v.e), 0), 6) AS score FROM v q, v WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM c QUALIFY rank <= 10""",
    "l2_normalize_norms": "SELECT vec_id, round(n, 6) AS norm, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS unit_norm, round(e[1] / greatest(n, 1e-12), 6) AS first FROM (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)",
    "centroid_by_label": "SELECT label, (pos - 1)::INTEGER AS pos, round(avg(x), 6) AS mean, count(*)::BIGINT AS n FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL",
    "prefetch_topk": f"WITH {_POSTINGS}, {_asked()}, {_BM25}, {_COSINE} SELECT 'dense' AS side, id, score, rank FROM ({_near(28)}) UNION ALL SELECT 'sparse', id, score, rank FROM ({_best(12, 'id')})",
    "hybrid_topk": _fused(10, 28, 12, "2.0::DOUBLE", _BM25),
    "rrf_fusion": _fused(20, 50, 50, "60.0::DOUBLE", _CLASSIC),
    "fixed_stride_chunks": f"""WITH {_POSTINGS}, n AS (SELECT id, t, greatest(1, ceil((len(t) - 16) / 112.0::DOUBLE))::BIGINT AS total FROM d WHERE len(t) > 0),
c AS (SELECT id, t, total, unnest(range(total)) AS i FROM n)
SELECT id AS doc_id, i::BIGINT AS chunk_index, total AS chunk_total, len(t[i * 112 + 1:i * 112 + 128])::BIGINT AS n_tokens, sha1(array_to_string(t[i * 112 + 1:i * 112 + 128], ' ')) AS text_sha1 FROM c""",
    "chunk_ids": "SELECT doc_id, 'doc_' || doc_id || '_bookmark_' || substr(sha1(lang || ' > ' || source), 1, 12) || '_chunk_0' AS chunk_id, 'doc_' || doc_id || '_bookmark_nosection_chunk_0' AS bare_id, substr(sha1(lang || ' > ' || source), 1, 10) AS short_hash FROM documents",
    "embedding_text": "SELECT doc_id, sha1(t) AS text_sha1, length(t)::BIGINT AS n_chars FROM (SELECT doc_id, 'Document: ' || source || chr(10) || 'Section: ' || CASE WHEN lang = 'en' THEN 'body' ELSE lang END || chr(10) || chr(10) || text AS t FROM documents)",
    "adjacent_expand": f"{_chat_best(20)} SELECT source_document, chunk_index, is_hit, rank FROM w",
    "fetch_by_indices": "SELECT conv_id::VARCHAR AS source_document, turn::INTEGER AS chunk_index, sha1(text) AS text_sha1 FROM conversations WHERE conv_id BETWEEN 0 AND 29 AND turn IN (0, 2)",
    "fetch_neighbours": "SELECT conv_id::VARCHAR AS source_document, turn::INTEGER AS chunk_index, sha1(text) AS text_sha1 FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations u WHERE u.role = 'user' AND u.conv_id = c.conv_id AND abs(u.turn - c.turn) = 1)",
    "upsert_latest": "SELECT chunk_id, sha1(text) AS text_sha1 FROM (SELECT item_id AS chunk_id, text FROM benchmark UNION ALL SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark))",
    "delete_document": "SELECT doc_id, source FROM documents WHERE source IS DISTINCT FROM 'src0'",
    "rerank_scores_topk": f"{_RERANK} SELECT doc_id, relevance_score, original_rank, row_number() OVER (ORDER BY relevance_score DESC, original_rank)::INTEGER AS new_rank FROM y QUALIFY new_rank <= 5",
    "rerank_min_relevance": f"{_RERANK} SELECT doc_id, relevance_score, original_rank, row_number() OVER (ORDER BY relevance_score DESC, original_rank)::INTEGER AS new_rank FROM y WHERE relevance_score >= 7 QUALIFY new_rank <= 5",
    "llm_score_parse": "SELECT doc_id, (i - 1)::BIGINT AS pos, CASE WHEN doc_id % 5 IN (2, 3) THEN 5.0::DOUBLE WHEN i = 1 THEN least(10, n_chars % 14)::DOUBLE WHEN i = 2 THEN 5.0::DOUBLE ELSE 2.5::DOUBLE END AS score FROM documents, (SELECT unnest([1, 2, 3]) AS i)",
    "context_string": f"""{_chat_best(5)} SELECT 0 AS query_id, 'Context from documents:' || chr(10) || chr(10) || string_agg('[Source: ' || source_document || ', Section: ' || role || ', Pages: ' || chunk_index || '-' || chunk_index || ']' || chr(10) || text || chr(10), chr(10) ORDER BY rank) AS context FROM w WHERE is_hit""",
    "html_heading_sections": f"""WITH l AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '{_HEADING}', 1) AS a, regexp_extract_all(coalesce(html, ''), '{_HEADING}', 2) AS b FROM pages),
r AS (SELECT page_id, unnest(a)::INTEGER AS level, unnest(b) AS h, generate_subscripts(a, 1) - 1 AS i FROM l),
x AS (SELECT page_id, level, i, trim(regexp_replace(regexp_replace(h, '(?s)<[^>]*>', ' ', 'g'), '[\\s\\x0B]+', ' ', 'g')) AS h FROM r),
y AS (SELECT *, last_value(CASE WHEN level = 1 THEN i END IGNORE NULLS) OVER o AS i1, last_value(CASE WHEN level = 1 THEN h END IGNORE NULLS) OVER o AS h1, last_value(CASE WHEN level = 2 THEN i END IGNORE NULLS) OVER o AS i2, last_value(CASE WHEN level = 2 THEN h END IGNORE NULLS) OVER o AS h2
      FROM x WINDOW o AS (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING))
SELECT page_id, i::BIGINT AS section_index, level, h AS heading, concat_ws(' > ', h1, CASE WHEN level >= 2 AND i2 > coalesce(i1, -1) THEN h2 END, CASE WHEN level = 3 THEN h END) AS heading_path FROM y""",
    "font_statistics": f"""WITH {_BLOCKS}, c AS (SELECT source_document, round(size, 1) AS r, count(*) AS n, min(seq) AS seen, sum(size) AS s, max(size) AS hi, min(size) AS lo FROM bl GROUP BY ALL),
b AS (SELECT source_document, sum(s) / sum(n) AS a, max(hi) AS hi, min(lo) AS lo, arg_max(r, n * 1000000000000 - seen) AS body FROM c GROUP BY 1)
SELECT source_document, round(a, 6) AS average_size, hi AS max_size, lo AS min_size, body AS body_size, coalesce((SELECT string_agg(r::VARCHAR, ',' ORDER BY r DESC) FROM c WHERE c.source_document = b.source_document AND r > body * 1.1::DOUBLE), '') AS heading_sizes FROM b""",
    "line_breaks": f"""WITH {_BLOCKS}, t AS (SELECT *, floor(w / 7) * 12.0 AS top FROM bl)
SELECT source_document, page_number, sum(b)::BIGINT AS n_breaks, count(*)::BIGINT AS n_words FROM (SELECT source_document, page_number, coalesce(top - lag(top) OVER (PARTITION BY source_document, page_number ORDER BY w) > 8, false)::INTEGER AS b FROM t) GROUP BY 1, 2""",
    "rag_search": f"""{_chat_best(10)}, z AS (SELECT source_document, chunk_index, is_hit, rank AS original_rank, round({_OVERLAP.format(words="list_transform(regexp_extract_all('Document: ' || source_document || chr(10) || 'Section: ' || role || chr(10) || chr(10) || text, '[A-Za-z0-9_]+'), lambda x: lower(x))")} * 10, 6) AS relevance_score FROM w)
SELECT source_document, chunk_index, is_hit, relevance_score, original_rank, row_number() OVER (ORDER BY relevance_score DESC, original_rank)::INTEGER AS new_rank FROM z QUALIFY new_rank <= 5""",
    "best_turn_rank": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn)::INTEGER AS rank FROM conversations",
}

_STORED = "SELECT doc_id::VARCHAR AS chunk_id, source AS source_document, sha1(text) AS text_sha1 FROM documents"
_ITEMS = "SELECT item_id::VARCHAR AS chunk_id, 'benchmark' AS source_document, sha1(text) AS text_sha1 FROM benchmark"
ORACLES |= {
    "store_upsert": f"{_STORED} WHERE doc_id::VARCHAR NOT IN (SELECT item_id::VARCHAR FROM benchmark) UNION ALL {_ITEMS}",
    "store_append": f"{_STORED} UNION ALL {_ITEMS}",
    "store_clear": _ITEMS,
    "stored_bm25_topk": ORACLES["bm25_topk"],
    "stored_tf_topk": ORACLES["idf_query_topk"],
    "rag_search_hybrid": f"""WITH {_POSTINGS}, {_asked()}, {_BM25}, {_COSINE.replace("FROM embeddings WHERE", "FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) AND")},
a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id::VARCHAR)::INTEGER AS rank FROM c QUALIFY rank <= 28), b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id::VARCHAR)::INTEGER AS rank FROM s QUALIFY rank <= 12),
f AS (SELECT id, round(sum(x), 6) AS score FROM (SELECT id, 1.0::DOUBLE / (1 + rank) AS x FROM a UNION ALL SELECT id, 1.0::DOUBLE / (1 + rank) FROM b) GROUP BY id),
h AS (SELECT id, row_number() OVER (ORDER BY score DESC, id::VARCHAR)::INTEGER AS rank FROM f QUALIFY rank <= 5),
n AS (SELECT i AS id, min(rank) AS parent FROM (SELECT rank, id // 10 AS g, unnest([id - 1, id + 1]) AS i FROM h) WHERE i // 10 = g AND i IN (SELECT doc_id FROM documents) AND i NOT IN (SELECT id FROM h) GROUP BY 1)
SELECT id AS doc_id, true AS is_hit, rank FROM h UNION ALL
SELECT id, false, ((SELECT max(rank) FROM h) + row_number() OVER (ORDER BY parent, 'd' || (id // 10), id))::INTEGER FROM n""",
    "llm_rerank_topk": f"""{_RERANK}, z AS (SELECT 0 AS query_id, doc_id, (doc_id % 11)::DOUBLE AS relevance_score, original_rank FROM y WHERE least(10, doc_id % 11) >= 5
      UNION ALL SELECT 1, doc_id, round(5.0::DOUBLE - 0.1::DOUBLE * (original_rank - 1), 6), original_rank FROM y)
SELECT query_id, doc_id, relevance_score, original_rank, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, original_rank)::INTEGER AS new_rank FROM z QUALIFY new_rank <= 5""",
    "readable_blocks": f"WITH {_BLOCKS} SELECT source_document, count(*) AS n_words, max(page_number)::BIGINT AS last_page FROM bl WHERE page_number > 1 AND size <= 13 GROUP BY 1",
    "simple_sections": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents)
SELECT 'doc_' || doc_id AS source_document, 2 AS start_page, max(p)::INTEGER AS end_page, count(*) FILTER (p > 1 AND regexp_matches(line, '[^\\s]')) AS n_pages FROM l GROUP BY doc_id HAVING count(*) FILTER (p > 1 AND regexp_matches(line, '[^\\s]')) > 0""",
    "paragraph_breaks": f"""WITH {_BLOCKS}, t AS (SELECT source_document, page_number, w // 7 AS line, lag(w // 7) OVER o AS before, lag(word) OVER o AS last FROM bl WINDOW o AS (PARTITION BY source_document, page_number ORDER BY w))
SELECT source_document, page_number, sum(CASE WHEN before IS NULL OR line = before THEN 0 WHEN line > before + 1 THEN 1 WHEN regexp_matches(last, '[.?!:;]$') OR regexp_matches(last, '^[0-9].*[.)]$') THEN 1 ELSE 0 END)::BIGINT AS n_breaks FROM t GROUP BY 1, 2""",
    "name_uuids": """WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(source || '/' || doc_id)) AS h FROM documents)
SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', h[17:17]) - 1) % 4, 1) || h[18:20] || '-' || h[21:32] AS point_id FROM h""",
    "json_round_trip": "SELECT item_id::VARCHAR AS chunk_id, (row_number() OVER (ORDER BY item_id) - 1)::INTEGER AS chunk_index, sha1(text) AS text_sha1 FROM benchmark",
    "stats_round_trip": f"WITH {_POSTINGS} SELECT term, df, n, total AS total_length FROM df, st",
    "payload_round_trip": """SELECT doc_id::VARCHAR AS chunk_id, source AS source_document, i AS chunk_index, t AS chunk_total, sha1(text) AS text_sha1, len(embedding)::INTEGER AS dimensions
FROM (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INTEGER AS i, (count(*) OVER (PARTITION BY source))::INTEGER AS t FROM documents) JOIN embeddings ON vec_id = doc_id WHERE len(embedding) > 0""",
}
