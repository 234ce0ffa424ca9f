"""Links inside candidate buckets and connected components, without ever emitting all pairs of a bucket.

A bucket holds rows that might be linked. Only connectivity matters, so a bucket is done once its rows are in one
component, and a set of rows that many keys hold is one bucket. First every row of a bucket is tested against the bucket's
smallest id: groups of copies close with one pair a row. Buckets that still hold several components are then resolved where
their rows meet: rows outside the largest component are compared with those of other components, and only what joins two
components is emitted. An open bucket over BUCKET_BYTES is cut into blocks of half that weight, and any two blocks meet in a
tile of their own, so that tasks stay bounded and the number of jobs does not depend on the bucket. The result has the
components that testing all pairs would give.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm import common

#: What the rows of an open bucket may weigh to be resolved in one task; a larger one is cut into tiles of about that weight.
BUCKET_BYTES = 48 << 20
#: Likely links of a row that are confirmed one by one.
TRIED = 8


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (id, component): the smallest id reachable. Alternates large stars and small stars until what is left are
    stars around their smallest id, cutting lineage by a written table each round; a hub's edges meet in partial minima
    and skew-split joins."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = common.materialise(e, "edges", packed=True)
    while not _stars(e):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).unionAll(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        before, e = e, common.materialise(small, "edges", packed=True)
        common.discard(before)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _stars(e: DataFrame) -> bool:
    """Does every u have one v, and is no v a u?"""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("n")).unionAll(e.select("v", F.lit(0)).distinct())
    return ends.groupBy("x").agg(F.sum("n").alias("n"), F.min("n").alias("least")).where("n > 1 OR (n = 1 AND least = 0)").isEmpty()


def link(members: DataFrame, prepare: Callable[[DataFrame], tuple[Callable, Callable, DataFrame]], batch_rows: int = common.BATCH_ROWS) -> DataFrame:
    """members: (key, id), distinct, made in batches of batch_rows. prepare gets the ids (a column `id`) that share a bucket with others, and returns
    verify: distinct pairs (a, b) to those that are linked; resolve: rows (key, id, c), c being the component so far, to
    links (a, b) that join all components of a key that have any link; and sizes: (id, bytes). Returns (id, component) of
    all ids that have a link."""
    common.small_batches(members.sparkSession, batch_rows)
    try:
        members = common.materialise(members, "members")
    finally:
        common.small_batches(members.sparkSession)
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("leader"), F.bit_xor(F.xxhash64("id")).alias("content")).where("n > 1")
    # rows that are alike meet under many keys: each set of rows goes on once
    sizes = sizes.groupBy("n", "leader", "content").agg(F.min("key").alias("key")).select("key", "n", "leader")
    sizes = common.materialise(sizes, "sizes", packed=True)  # a join of two plain shuffles can be split where a bucket is hot
    shared = common.materialise(members.join(sizes, "key"), "shared", packed=True)
    verify, resolve, weights = prepare(common.materialise(shared.select("id").distinct(), "ids", packed=True))
    follow = shared.where("id <> leader")
    known = components(verify(follow.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()))
    placed = follow.where("n > 2").select("key", "id").join(known, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    of_key = placed.join(weights, "id").groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("c1"), F.max("c").alias("c2"), F.sum("bytes").alias("bytes"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("content"))
    once = of_key.where("c1 <> c2").groupBy("n", "content").agg(F.min("key").alias("key"), F.min("bytes").alias("bytes"))
    placed = common.materialise(placed.join(once.select("key", "bytes"), "key"), "open", packed=True)
    if placed.isEmpty():
        return known
    return components(_and(resolve(_tiles(placed)), known))


def _tiles(placed: DataFrame) -> DataFrame:
    """(key, id, c): each bucket, or of a heavy one each two blocks of it, under a key; that of blocks is negative."""
    blocks = F.when(F.col("bytes") <= BUCKET_BYTES, 1).otherwise(F.ceil(2 * F.col("bytes") / BUCKET_BYTES)).cast("int")
    placed = placed.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    heavy = placed.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("own <> other")
    tile = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).bitwiseOR(F.lit(-(1 << 63)))
    return placed.where("blocks = 1").select("key", "id", "c").unionAll(heavy.select(tile.alias("key"), "id", "c"))


def _and(edges: DataFrame, known: DataFrame) -> DataFrame:
    return edges.unionAll(known.select(F.col("id").alias("a"), F.col("component").alias("b")))


def by_key(solve: Callable[[pa.Table], pa.RecordBatch], least: int = 1) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows sorted by `key`: hands the rows of one key at a time to solve, or of whole keys until they
    are `least` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            if rows >= least and held[-1].column("key")[-1].as_py() != keys[0]:
                yield solve(pa.Table.from_batches(held))
                held, rows = [], 0
            begin = 0
            for cut in cuts[1:]:
                if cut == len(keys) or rows + cut - begin >= least:
                    held.append(batch.slice(begin, cut - begin))
                    rows, begin = rows + cut - begin, cut
                    if cut < len(keys):
                        yield solve(pa.Table.from_batches(held))
                        held, rows = [], 0
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def join_components(component: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray], sure: Callable[[int, int], bool] | None = None, many: Callable[[int, np.ndarray], np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that join the components of rows: each row outside the largest one is tested, by linked(row, others), against
    the rows that are not in its component as yet. With sure(row, other) what linked() gives are only likely links, which are
    confirmed one by one, while they would still join something; after TRIED of them many(row, others) judges all that would."""
    label = np.unique(component, return_inverse=True)[1]
    out: list[tuple[int, int]] = []
    later = label == np.bincount(label).argmax()  # rows that are still to be compared: the largest component's always
    turns = np.flatnonzero(~later).tolist()
    later[turns] = True
    for i in turns:
        later[i] = False  # the row meets all that follow now, so they need not meet it
        near, tried, check = linked(i, np.flatnonzero(later & (label != label[i]))), 0, sure
        while len(near):
            j, near = near[0], near[1:]
            if label[i] != label[j]:
                if check is None or check(i, int(j)):
                    label[label == label[j]] = label[i]
                    out.append((i, int(j)))
                tried += 1
                if tried == TRIED and check is not None and many is not None:
                    near = near[label[near] != label[i]]
                    near, check = near[many(i, near)], None
    return out
