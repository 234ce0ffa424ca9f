"""Operator 4, near-duplicates by MinHash with sequential Bayesian verification.

A document's set holds its distinct 5-word shingles. Documents of equal sets are one class. Classes that agree in any band
of ROWS MinHash values share a bucket; a pair of similarity t misses all BANDS with probability (1 - t^5)^25, 4e-7 at 0.85.
Candidates compare their signatures BATCH values at a time: with a uniform prior, m agreements in n give the similarity a
Beta(m + 1, n - m + 1) posterior, and a pair is pruned once the chance of reaching the threshold is under MISS. What
survives is confirmed on the full sets. Buckets are linked by linking.link, which never emits all pairs of a bucket.

Edge cases: null or empty texts and texts without words have no set and stay alone; fewer than five words are one shingle;
null ids are never linked, have no component and are kept; rows that repeat an id count as one document, linked by any of
its rows' sets; a document of any length is taken whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm import common
from lexivec.llm.linking import by_key, join_components, link
from lexivec.llm.words import NOT_SPACE, Words, mix, split

SHINGLE, HASHES, BANDS, ROWS, BATCH = 5, 128, 25, 5, 16
#: The chance at which a pair at the threshold may be pruned by its signature.
MISS = 1e-9
MULTIPLY = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
ADD = mix(np.arange(HASHES + 1, 2 * HASHES + 1, dtype=np.uint64))


def shingle_sets(words: Words) -> list[np.ndarray]:
    """Of each text: its distinct shingles' hashes, sorted."""
    grams, _ = words.grams(SHINGLE)
    short = {m: words.grams(m)[0] for m in range(1, SHINGLE)} if (words.counts < SHINGLE).any() else {}
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        n = b - a
        if n >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif n:
            out.append(mix(short[n][a : a + 1] + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(hashes), 2048):
        values = MULTIPLY[:, None] * hashes[None, k : k + 2048]
        values += ADD[:, None]
        np.minimum(out, (values.min(axis=1) >> np.uint64(32)).astype(np.uint32), out=out)
    return out


def least_agreements(threshold: float, miss: float = MISS) -> list[int]:
    """For each number of batches seen: the fewest agreements with which a pair stays in."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        # P[similarity >= t | m of n] under a uniform prior is P[Binomial(n + 1, t) <= m]
        tail, m = 0.0, 0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
        out.append(m)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    data, _ = common.raw_bytes(column)
    return data.view(np.uint32).reshape(len(column), HASHES)


def _sketches(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            sets = shingle_sets(split(batch.column("text"), NOT_SPACE))
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            marks = [signature(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.binary())], names=["id", "n_shingles", "set_key", "mark"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n_shingles bigint, set_key binary, mark binary")


def _bands(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = _matrix(batch.column("mark"))[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
            keys = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(marks), 1), np.uint64)
            for r in range(ROWS):
                keys = mix(keys + marks[:, :, r])
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(marks)), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), ids], names=["key", "id"])

    return classes.select("id", "mark").mapInArrow(run, f"key bigint, id {classes.schema['id'].dataType.simpleString()}")


def _full_sets(docs: DataFrame, wanted: common.Sieve | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            if wanted:
                batch = batch.filter(pa.array(wanted.may_hold(batch.column("id").fill_null(0).to_numpy().astype(np.int64))))
            sets = shingle_sets(split(batch.column("text"), NOT_SPACE))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, shingles binary")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, miss: float = MISS) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable over links of 100 * |A and B| >= percent * |A or B|) and
    kept (the id is the component's)."""
    spark = df.sparkSession
    common.small_batches(spark)
    docs = common.texts_of(df, id_col, text_col)
    kind = docs.schema["id"].dataType.simpleString()
    rows = common.materialise(_sketches(docs), "sketches")
    classes = rows.where("set_key IS NOT NULL AND id IS NOT NULL").groupBy("set_key").agg(F.min("id").alias("id"), F.first("mark").alias("mark"))
    classes = common.materialise(classes, "classes")
    fewest = least_agreements(percent / 100, miss)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = _matrix(batch.column("mark_a")), _matrix(batch.column("mark_b"))
            alive, agreed = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for k, least in enumerate(fewest):
                part = slice(k * BATCH, (k + 1) * BATCH)
                agreed = agreed + (a[alive, part] == b[alive, part]).sum(axis=1)
                stay = agreed >= least
                alive, agreed = alive[stay], agreed[stay]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sure = []
            for x, y in zip(batch.column("shingles_a"), batch.column("shingles_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                least, most = min(len(x), len(y)), max(len(x), len(y))
                if not least or 100 * least < percent * most:
                    sure.append(False)
                    continue
                both = len(x) + len(y) - len(np.union1d(x, y))
                sure.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(sure, pa.bool_()))

    def solve(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        column = lambda c: rows.column(c).chunk(0)
        marks = _matrix(column("mark"))
        data, offsets = common.raw_bytes(column("shingles"))
        sizes = np.diff(offsets) // 8
        _, local = np.unique(np.frombuffer(data.tobytes(), np.uint64), return_inverse=True)  # shingles numbered in the bucket
        first = offsets[:-1] // 8
        present = np.zeros(int(local.max(initial=0)) + 1, bool)

        def linked(i: int, others: np.ndarray) -> np.ndarray:
            agreed = np.zeros(len(others), np.int64)
            for k, least in enumerate(fewest):
                part = slice(k * BATCH, (k + 1) * BATCH)
                agreed = agreed + (marks[others, part] == marks[i, part]).sum(axis=1)
                others, agreed = others[agreed >= least], agreed[agreed >= least]
            if not len(others):
                return others
            own = local[first[i] : first[i] + sizes[i]]
            present[own] = True
            n = sizes[others]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[others], n)
            both = np.add.reduceat(present[local[at]].astype(np.int64), np.cumsum(n) - n)
            present[own] = False
            return others[100 * both >= percent * (n + sizes[i] - both)]

        pairs = join_components(column("c").to_numpy(), linked)
        ids = column("id")
        return pa.RecordBatch.from_arrays([ids.take(pa.array([p[0] for p in pairs], pa.int64())), ids.take(pa.array([p[1] for p in pairs], pa.int64()))], names=["a", "b"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def prepare(ids: DataFrame):
        wanted = common.Sieve(ids, "id") if kind in ("bigint", "int") else None
        marks = common.materialise(classes.select("id", "mark").join(ids, "id", "left_semi"), "marks")
        sets = common.materialise(_full_sets(docs, wanted).join(ids, "id", "left_semi"), "sets")
        weights = sets.select("id", (F.octet_length("shingles") + 4 * HASHES).alias("bytes"))
        side = lambda t, c, s: t.select(F.col("id").alias(s), F.col(c).alias(f"{c}_{s}"))

        def verify(pairs: DataFrame) -> DataFrame:
            likely = pairs.join(side(marks, "mark", "a"), "a").join(side(marks, "mark", "b"), "b").select("a", "b", "mark_a", "mark_b").mapInArrow(compare, f"a {kind}, b {kind}")
            likely = common.materialise(likely, "likely")
            full = likely.join(side(sets, "shingles", "a"), "a").join(side(sets, "shingles", "b"), "b").select("a", "b", "shingles_a", "shingles_b")
            return full.mapInArrow(confirm, f"a {kind}, b {kind}")

        def resolve(placed: DataFrame) -> DataFrame:
            rows = placed.join(marks, "id").join(sets, "id").select("key", "id", "c", "mark", "shingles")
            return rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(by_key(solve), f"a {kind}, b {kind}")

        return verify, resolve, weights

    found = link(_bands(classes), prepare)
    of_class = classes.select("set_key", F.col("id").alias("first")).join(found.select(F.col("id").alias("first"), "component"), "first", "left")
    of_class = of_class.select("set_key", F.coalesce("component", "first").alias("c"))
    # a repeated id joins all its rows' classes
    out = rows.select("id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
