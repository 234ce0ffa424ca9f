"""Operator 8, canonical exact digests.

Canonical form: Unicode compatibility normalisation (NFKC), case folding, NFKC again, white-space runs to one space, ends
stripped. The fingerprint is its 128-bit xxhash. Rows group by digest, and inside each bucket that two or more rows share
the canonical bytes are compared; rows of a bucket whose bytes differ (which no known text does) get a SHA-256 besides,
so equal fingerprints always mean equal canonical text.

A digest is exact: the likeness of two fingerprints is 1.0 if they are equal and 0.0 otherwise, and says nothing between.

Edge cases: a null or empty text has the digest of the empty text; texts of any length are taken whole; rows that repeat an
id stay and follow one another in the order of their text; null ids come last in descending order; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.llm import common

#: Buckets of unequal bytes that are looked up by name; more would mean that the hash is broken, and raises.
MOST_COLLISIONS = 100_000


def canonical(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


def digest(text: str, collided: frozenset[str] = frozenset()) -> str:
    whole = canonical(text).encode()
    found = xxhash.xxh3_128_hexdigest(whole)
    return f"{found}-{hashlib.sha256(whole).hexdigest()}" if found in collided else found


def likeness(a: str, b: str) -> float:
    return 1.0 if a == b else 0.0


def _digests(docs: DataFrame, shared: common.Sieve | None = None) -> DataFrame:
    """(digest, low), low being a part of the digest as a number; with a sieve only rows that it lets through, with their
    canonical bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            whole = [canonical(t).encode() for t in batch.column("text").to_pylist()]
            found = b"".join(map(xxhash.xxh3_128_digest, whole))
            low = np.frombuffer(found, np.int64)[::2]
            rows = np.flatnonzero(shared.may_hold(np.ascontiguousarray(low))) if shared else np.arange(len(whole))
            columns = [pa.array([found[16 * k : 16 * k + 16] for k in rows.tolist()], pa.binary()), pa.array(low[rows])]
            columns += [pa.array([whole[k] for k in rows.tolist()], pa.binary())] if shared else []
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "low", "whole"][: len(columns)])

    return docs.mapInArrow(run, "digest binary, low bigint" + ", whole binary" * bool(shared))


def collisions(docs: DataFrame) -> frozenset[str]:
    """Digests that texts of different canonical bytes share: inside each bucket of two rows or more, the least and the
    greatest bytes are compared. Both sums are partial before the shuffle, so a hot bucket sends one text a task; texts
    that share no digest are sieved out where they are read."""
    shared = common.materialise(_digests(docs).groupBy("digest", "low").agg(F.count("*").alias("n")).where("n > 1").select("digest", "low"), "shared", packed=True)
    inside = _digests(docs, common.Sieve(shared, "low")).groupBy("digest").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a <> b")
    found = [r["d"] for r in inside.select(F.lower(F.hex("digest")).alias("d")).limit(MOST_COLLISIONS + 1).collect()]
    if len(found) > MOST_COLLISIONS:
        raise RuntimeError("xxhash no longer tells texts apart")
    return frozenset(found)


def group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fingerprint, n_equal (rows of the same canonical text) and first_id (their smallest id)."""
    docs = common.texts_of(df, id_col, text_col)
    common.small_batches(df.sparkSession)
    collided = collisions(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([digest(t, collided) for t in batch.column("text").to_pylist()])], names=["id", "fingerprint"])

    rows = docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, fingerprint string")
    of_group = rows.groupBy("fingerprint").agg(F.count("*").alias("n_equal"), F.min("id").alias("first_id"))
    return rows.join(of_group, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "n_equal", "first_id")


def _in_order(docs: DataFrame) -> DataFrame:
    """Rows dealt to partitions by descending id, each sorted, with a copy (`ghost`) of the row that follows the
    partition's last one. Only as many ids as there are partitions come to the driver."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds: list = []
    if isinstance(docs.schema["id"].dataType, T.NumericType):
        bounds = sorted(set(docs.approxQuantile("id", [k / parts for k in range(1, parts)], 0.2 / parts)), reverse=True)
    kind = docs.schema["id"].dataType
    known = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast(T.ArrayType(T.DoubleType()))
    part = F.when(F.col("id").isNull(), F.lit(len(bounds))).otherwise(F.size(F.filter(known, lambda b: b > F.col("id").cast("double"))))
    dealt = docs.withColumn("part", part).withColumn("ghost", F.lit(0))
    heads = sorted((r["part"], r["head"], r["n"]) for r in docs.select("id").withColumn("part", part).groupBy("part").agg(F.max("id").alias("head"), F.count("*").alias("n")).collect())
    if heads:
        follows = [(heads[k - 1][0], heads[k][1]) for k in range(len(heads))]  # the first part follows the last one
        schema = T.StructType([T.StructField("to", T.IntegerType()), T.StructField("head", kind)])
        ghosts = dealt.join(F.broadcast(spark.createDataFrame(follows, schema)), F.col("id").eqNullSafe(F.col("head")))
        dealt = dealt.unionByName(ghosts.select("id", "text", F.col("to").alias("part"), F.lit(1).alias("ghost")))
    return dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("ghost", F.col("id").desc(), "text")


def compare_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited text ends
    in the first floor(n_chars / 3) code points of the next row's text, by descending id; the last row's next is the first.
    One shuffle of the texts, by ranges of the id."""
    common.small_batches(df.sparkSession)
    docs = common.texts_of(df, id_col, text_col)
    collided = collisions(docs)
    id_type = docs.schema["id"].dataType

    def edited(text: str, after: str) -> str:
        third = len(text) // 3
        return text[: len(text) - third] + after[:third] if third else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, whose next is still to come: (id array, text, fingerprint)
        for batch in common.slices(batches):
            ids, ghost = batch.column("id"), batch.column("ghost").to_pylist()
            texts = batch.column("text").to_pylist()
            prints = [digest(t, collided) for t in texts]
            if held is not None:
                ids, texts, prints, ghost = pa.concat_arrays([held[0], ids]), [held[1], *texts], [held[2], *prints], [0, *ghost]
            n = len(texts) - 1
            if 1 in ghost:
                n = ghost.index(1)  # only a partition's first ghost counts; rows that repeat its id follow it
                held = None
            else:
                held = (ids.slice(n, 1), texts[n], prints[n])
            if n:
                new = [edited(texts[k], texts[k + 1]) for k in range(n)]
                news = [prints[k] if new[k] is texts[k] else digest(new[k], collided) for k in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(0, n), pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]), pa.array(prints[:n]), pa.array(news), pa.array([likeness(*p) for p in zip(prints, news)], pa.float64()), pa.array([likeness(prints[k], prints[k + 1]) for k in range(n)], pa.float64())],
                    names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )
            if 1 in ghost:
                for _ in batches:  # nothing but ghosts is left
                    pass
                return

    schema = f"id {id_type.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _in_order(docs).mapInArrow(run, schema).withColumnRenamed("id", id_col)
