"""Indexing and searching as one service, its tool surface for a language model, and its settings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.operators import rerank
from lexivec.operators.adjacency import expand
from lexivec.operators.chunking import Chunker, chunk_sections, embedding_text
from lexivec.operators.dense import cosine_batch_top_k, embed, hashed_embedding
from lexivec.operators.fusion import fuse, prefetch_sizes
from lexivec.operators.sparse import counted_scores, top_k
from lexivec.sources.store import ChunkStore


@dataclass(frozen=True)
class Settings:
    """mode: "dense", "hybrid" (BM25 both sides), "hybrid_idf" (TF vectors, idf at query time) or "sparse".
    truncate_before_expand cuts hits to k before neighbours join them; else, without a reranker, neighbours only fill up
    what hits leave of k."""

    max_chunk_tokens: int = 512
    chunk_overlap_tokens: int = 50
    adjacent_chunk_count: int = 1
    mode: str = "hybrid"
    dense_weight: float = 0.7
    sparse_weight: float = 0.3
    rrf_k: float = 2.0
    truncate_before_expand: bool = False


@dataclass
class RagService:
    store: ChunkStore
    settings: Settings = field(default_factory=Settings)
    embedder: Callable[[pd.Series], pd.Series] = field(default_factory=hashed_embedding)
    scorer: Callable[[pd.Series, pd.Series], pd.Series] | None = None

    def index_sections(self, sections: DataFrame, replace: bool = False) -> int:
        """Sections to chunks to vectors to the store; the number of chunks that the documents then have. Older chunks of a
        document that the new ones do not name stay, unless replace is set."""
        chunks = chunk_sections(sections, Chunker(self.settings.max_chunk_tokens, self.settings.chunk_overlap_tokens))
        text = embedding_text(F.col("source_document"), F.col("section_path"), F.col("section"), F.col("text"))
        vectors = embed(chunks.withColumn("_e", text), "_e", self.embedder).drop("_e")
        names = vectors.select("source_document").distinct()
        self.store.upsert(vectors, replace_documents=replace)
        return self.store.read().join(names, "source_document", "left_semi").count()

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        """queries (query_id, query) to hits (query_id, chunk_id, score, rank)."""
        s, chunks = self.settings, self.store.read()
        vectors = embed(queries, "query", self.embedder, "vector").select("query_id", "vector")
        n_dense, n_sparse = prefetch_sizes(k, s.dense_weight, s.sparse_weight)
        dense = lambda n: cosine_batch_top_k(chunks, vectors, n, "chunk_id").withColumnRenamed("chunk_id", "id")
        if s.mode == "dense":
            return dense(k).withColumnRenamed("id", "chunk_id")
        found = top_k(counted_scores(self.store.counts(), queries, "idf" if s.mode == "hybrid_idf" else "bm25"), k if s.mode == "sparse" else n_sparse)
        return (found if s.mode == "sparse" else fuse([dense(n_dense), found], k, s.rrf_k)).withColumnRenamed("id", "chunk_id")

    def search(self, query: str, k: int = 5) -> DataFrame:
        """The best k chunks, with rank: twice as many are retrieved, neighbours added, and the whole reranked or cut."""
        spark, s = self.store.spark, self.settings
        queries = spark.createDataFrame([(0, query)], "query_id bigint, query string")
        hits = self.store.read().join(F.broadcast(self.retrieve(queries, 2 * k)), "chunk_id")  # 2k rows
        hits = hits.where(F.col("rank") <= k) if s.truncate_before_expand else hits
        base = hits.select(*self.store.read().columns, "rank")
        wide = expand(base, self.store.read(), s.adjacent_chunk_count)
        if self.scorer is None:
            return wide.where(F.col("rank") <= (k if not s.truncate_before_expand else k * (1 + 2 * s.adjacent_chunk_count)))
        pairs = wide.withColumns({"query_id": F.lit(0), "query": F.lit(query), "original_rank": F.col("rank")})
        return rerank.cross_encoder(pairs, self.scorer, k).withColumn("rank", F.col("new_rank"))

    def search_context(self, query: str, k: int = 5) -> str:
        rows = rerank.context(self.search(query, k).withColumn("query_id", F.lit(0))).collect()
        return rows[0]["context"] if rows else rerank.NO_CONTEXT


TOOLS = {
    "search_documents": {"query": "string", "top_k": "integer"},
    "index_pdf": {"pdf_file_name": "string"},
    "delete_document": {"document_name": "string"},
    "clear_index": {},
}


def tool_schemas() -> list[dict]:
    """Function-calling schemas of the four tools."""
    say = {"search_documents": "Search the documents; call it for any question about them.", "index_pdf": "Add a file to the index.", "delete_document": "Remove a document from the index.", "clear_index": "Remove all documents from the index."}
    needs = {"search_documents": ["query"], "index_pdf": ["pdf_file_name"], "delete_document": ["document_name"], "clear_index": []}
    return [{"type": "function", "function": {"name": n, "description": say[n], "parameters": {"type": "object", "properties": {p: {"type": t} | ({"default": 5} if p == "top_k" else {}) for p, t in ps.items()}, "required": needs[n]}}} for n, ps in TOOLS.items()]


def dispatch(service: RagService, read_sections: Callable[[str], DataFrame], tool: str, args: dict) -> str:
    """A tool call to its answer. Changes that fail answer with the reason; a search that fails raises."""
    if tool == "search_documents":
        return service.search_context(str(args.get("query", "")), int(args.get("top_k", 5)))
    name = str(args.get("pdf_file_name" if tool == "index_pdf" else "document_name", ""))
    deeds = {
        "index_pdf": lambda: f"Indexed {service.index_sections(read_sections(name))} chunks of {name}.",
        "delete_document": lambda: service.store.delete_document(name) or f"Deleted {name}.",
        "clear_index": lambda: service.store.clear() or "The index is empty.",
    }
    if tool not in deeds:
        raise ValueError(f"unknown tool: {tool}")
    try:
        return deeds[tool]()
    except Exception as e:  # the model is told, and the session goes on
        return f"Failed to {tool.replace('_', ' ')}: {e}"
