"""Neighbouring chunks of hits: exploded indices, an anti-join with the hits, an equi-join with the chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEY = ["source_document", "section_path", "chunk_index"]


def neighbours(hits: DataFrame, reach: int) -> DataFrame:
    """(source_document, section_path, chunk_index, parent_rank): indices within reach of a hit, inside [0, chunk_total - 1]
    (any index if the total is 0), that are not hits themselves, each under its best hit."""
    around = hits.select("source_document", "section_path", F.col("chunk_index").alias("_i"), "chunk_total", F.col("rank").alias("parent_rank"), F.explode(F.sequence(F.col("chunk_index") - reach, F.col("chunk_index") + reach)).alias("chunk_index"))
    inside = (F.col("chunk_index") != F.col("_i")) & (F.col("chunk_index") >= 0) & ((F.col("chunk_total") == 0) | (F.col("chunk_index") < F.col("chunk_total")))
    found = around.where(inside).groupBy(*KEY).agg(F.min("parent_rank").alias("parent_rank"))
    taken = hits.select(*[F.col(c).alias(f"_h_{c}") for c in KEY])
    same = (F.col("source_document") == F.col("_h_source_document")) & (F.col("chunk_index") == F.col("_h_chunk_index")) & F.col("section_path").eqNullSafe(F.col("_h_section_path"))
    return found.join(taken, same, "left_anti")


def expand(hits: DataFrame, chunks: DataFrame, reach: int) -> DataFrame:
    """hits (columns of chunks, and rank) followed by their neighbours: all columns of chunks, rank and is_hit. Neighbours
    come in the order of their best hit's rank, then document, section and index. Without reach the hits alone."""
    first = hits.withColumn("is_hit", F.lit(True))
    if reach <= 0:
        return first
    near = neighbours(hits, reach)
    wanted = near.select(*[F.col(c).alias(f"_n_{c}") for c in KEY], "parent_rank")
    same = (F.col("source_document") == F.col("_n_source_document")) & (F.col("chunk_index") == F.col("_n_chunk_index")) & F.col("section_path").eqNullSafe(F.col("_n_section_path"))
    own = chunks.join(wanted, same)
    once = own.withColumn("_once", F.row_number().over(W.partitionBy(*KEY).orderBy("chunk_id"))).where("_once = 1")
    n = hits.agg(F.coalesce(F.max("rank"), F.lit(0)).alias("_n"))
    # neighbours are at most 2 * reach a hit, so this order is of few rows
    ranked = once.crossJoin(F.broadcast(n)).withColumn("rank", F.col("_n") + F.row_number().over(W.orderBy("parent_rank", *KEY)))
    return first.unionByName(ranked.withColumn("is_hit", F.lit(False)).select(first.columns))


def fetch(chunks: DataFrame, source_document: str, indices: list[int], section_path: str | None = None) -> DataFrame:
    """Chunks of a document by index, in a section if one is given; one row a key; no index gives no row."""
    found = chunks.where((F.col("source_document") == source_document) & F.col("chunk_index").isin(*indices)) if indices else chunks.limit(0)
    found = found.where(F.col("section_path") == section_path) if section_path else found
    return found.withColumn("_once", F.row_number().over(W.partitionBy(*KEY).orderBy("chunk_id"))).where("_once = 1").drop("_once")


def fetch_many(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """Chunks of many keys (source_document, section_path or null for any, chunk_index) by one join."""
    wanted = keys.select(F.col("source_document").alias("_k_doc"), F.col("section_path").alias("_k_sec"), F.col("chunk_index").alias("_k_i")).distinct()
    same = (F.col("source_document") == F.col("_k_doc")) & (F.col("chunk_index") == F.col("_k_i")) & (F.col("_k_sec").isNull() | F.col("section_path").eqNullSafe(F.col("_k_sec")))
    return chunks.join(wanted, same, "left_semi")
