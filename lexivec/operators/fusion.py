"""Hybrid retrieval: weighted prefetch of a dense and a sparse list, and their reciprocal-rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.functions.scores import RRF_K, rrf
from lexivec.operators.sparse import top_k


def prefetch_sizes(k: int, dense_weight: float = 0.7, sparse_weight: float = 0.3) -> tuple[int, int]:
    """How many hits each list brings: its share of four times k, at least k."""
    total = max(1e-6, dense_weight + sparse_weight)
    return max(k, int(4 * k * dense_weight / total)), max(k, int(4 * k * sparse_weight / total))


def fuse(lists: list[DataFrame], k: int, rrf_k: float = RRF_K, digits: int = 6) -> DataFrame:
    """lists: (query_id, id, rank from 1) each. (query_id, id, score, rank): a hit's shares are summed, which a union and a
    partial sum do cheaper than a full outer join, and a side that lacks it adds nothing."""
    shares = None
    for hits in lists:
        part = hits.select("query_id", "id", rrf(F.col("rank") - 1, rrf_k).alias("score"))
        shares = part if shares is None else shares.unionAll(part)
    return top_k(shares.groupBy("query_id", "id").agg(F.sum("score").alias("score")), k, digits=digits)


def hybrid_top_k(dense: DataFrame, sparse: DataFrame, k: int, dense_weight: float = 0.7, sparse_weight: float = 0.3, rrf_k: float = RRF_K) -> DataFrame:
    """dense and sparse: (query_id, id, score) of all candidates."""
    n_dense, n_sparse = prefetch_sizes(k, dense_weight, sparse_weight)
    return fuse([top_k(dense, n_dense), top_k(sparse, n_sparse)], k, rrf_k)
