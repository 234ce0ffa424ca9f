"""Dense vectors: embedding texts, normalising, pooling, exact cosine search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexivec.functions.vectors import cosine, doubles, has_vector
from lexivec.session import importable

#: Texts in a call of an embedding model.
BATCH = 50
#: Numbers of query vectors that one pass over the corpus takes (16 MB of doubles).
QUERY_NUMBERS = 2 << 20


def cosine_top_k(corpus: DataFrame, vector: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """(id, score, rank) of one query vector; rows without a vector are skipped. Stays in the JVM and ends in a
    take-ordered, so k rows a task are sorted."""
    query = F.lit(None).cast("array<double>") if not vector else F.array(*[F.lit(float(x)) for x in vector])
    scored = corpus.where(has_vector(F.col(vector_col))).select(F.col(id_col), F.round(cosine(F.col(vector_col), query), digits).alias("score"))
    best = scored.orderBy(F.desc("score"), id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), id_col)))  # k rows


def cosine_batch_top_k(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank) of many queries (query_id, vector): blocks of queries, each at most QUERY_NUMBERS numbers,
    pass over the corpus as matrix products, and each task keeps k rows a query. The block is what is broadcast, so its
    size does not grow with the number of queries."""
    spark = importable(corpus.sparkSession)
    docs = corpus.where(has_vector(F.col(vector_col))).select(F.col(id_col).alias("id"), doubles(F.col(vector_col)).alias("v"))
    asked = queries.where(has_vector(F.col("vector"))).select("query_id", doubles(F.col("vector")).alias("vector"))
    width = asked.agg(F.max(F.size("vector")).alias("w"), F.count("*").alias("n")).first()
    blocks = max(1, -(-(width["n"] or 0) * (width["w"] or 0) // QUERY_NUMBERS))
    numbered = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {docs.schema['id'].dataType.simpleString()}, score double"
    parts = []
    for b in range(blocks):
        rows = numbered.where(F.col("_block") == b).select("query_id", "vector").toArrow() if blocks > 1 else asked.toArrow()
        if not rows.num_rows:
            continue
        if len({len(v) for v in rows.column("vector")}) > 1:
            raise ValueError("vectors have different lengths")
        shared = spark.sparkContext.broadcast((rows.column("query_id").combine_chunks(), np.array(rows.column("vector").to_pylist())))
        parts.append(docs.mapInArrow(_products(shared, k, digits), kinds))
    if not parts:
        return spark.createDataFrame([], kinds + ", rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumnRenamed("id", id_col)


def _products(shared, k: int, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = shared.value
        size = np.linalg.norm(queries, axis=1)
        queries = np.divide(queries, size[:, None], out=np.zeros_like(queries), where=size[:, None] > 0)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                vectors = part.column("v")
                if (np.diff(vectors.offsets.to_numpy()) != queries.shape[1]).any():
                    raise ValueError("vectors have different lengths")
                m = vectors.flatten().to_numpy().reshape(-1, queries.shape[1])
                size = np.linalg.norm(m, axis=1)
                m = np.divide(m, size[:, None], out=np.zeros_like(m), where=size[:, None] > 0)
                score = np.round(queries @ m.T, digits) + 0.0
                ids = part.column("id").to_numpy(zero_copy_only=False)
                best = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
                rows = np.repeat(np.arange(len(queries)), best.shape[1])
                flat = best.ravel()
                yield pa.RecordBatch.from_arrays([names.take(pa.array(rows)), part.column("id").take(pa.array(flat)), pa.array(score[rows, flat])], names=["query_id", "id", "score"])

    return run


def centroids(corpus: DataFrame, label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(label, pos, mean): the mean vector of each label, one row a dimension."""
    long = corpus.select(label_col, F.posexplode(doubles(F.col(vector_col))).alias("pos", "x"))
    return long.groupBy(label_col, "pos").agg(F.avg("x").alias("mean"), F.count("*").alias("n"))


def hashed_embedding(dimensions: int = 256) -> Callable[[pd.Series], pd.Series]:
    """The default embedder, for want of a model: signed counts of hashed words, to length one. Deterministic."""
    import re
    import zlib

    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            v = np.zeros(dimensions, np.float32)
            for w in re.findall(r"[a-z0-9_]+", (text or "").lower()):
                h = zlib.crc32(w.encode())
                v[h % dimensions] += 1 if h >> 31 else -1
            size = float(np.linalg.norm(v))
            out.append((v / size if size else v).tolist())
        return pd.Series(out)

    return embed


def embed(df: DataFrame, text_col: str, embedder: Callable[[pd.Series], pd.Series], out: str = "embedding") -> DataFrame:
    """A model's vector of each text, BATCH texts a call; the embedder is any function of a series of texts, shipped to the
    workers once a task."""
    importable(df.sparkSession)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.concat([embedder(texts.iloc[a : a + BATCH]) for a in range(0, len(texts), BATCH)], ignore_index=True) if len(texts) else pd.Series([], dtype=object)

    return df.withColumn(out, run(F.coalesce(F.col(text_col), F.lit(""))))


