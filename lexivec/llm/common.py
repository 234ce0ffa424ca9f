"""Helpers shared by the training-data operators: shared storage, Arrow batches, column-clash-free input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec import session
from lexivec.session import importable

#: Rows in an Arrow batch handed to Python; long texts make a batch large, so it stays small.
BATCH_ROWS = 512
#: The same for rows of a few numbers.
NARROW_ROWS = 8192
#: Text bytes that the numpy kernels take at once; one longer text is taken alone.
SLICE_BYTES = 1 << 20


#: Tables written by this process that results may still read.
_WRITTEN: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    _WRITTEN.append(path := session.scratch(spark, name))
    return path


def sweep(spark: SparkSession) -> None:
    """Delete all intermediate tables of this process; call it once no result is needed any more."""
    while _WRITTEN:
        remove(spark, _WRITTEN.pop())


def settle(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What build() returns as a table of its own; the tables that build() wrote on the way, and its result read, go."""
    before = set(_WRITTEN)
    done = materialise(build(), name)
    for path in [w for w in _WRITTEN[:-1] if w not in before]:
        _WRITTEN.remove(path)
        remove(spark, path)
    return done


def materialise(df: DataFrame, name: str, packed: bool = False) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and survives the loss of any executor. packed: for narrow
    tables that take little work to compute; adaptive execution then fills partitions up to its advisory size instead of
    keeping every core busy, so that there are few files."""
    spark, conf = df.sparkSession, "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    path, before = scratch(spark, name), spark.conf.get(conf)
    if packed:
        spark.conf.set(conf, "false")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(conf, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete a table that materialise() wrote and nothing reads any more."""
    names = {f.rsplit("/", 2)[1] for f in df.inputFiles()}
    for path in [w for w in _WRITTEN if w.rsplit("/", 1)[1] in names]:
        _WRITTEN.remove(path)
        remove(df.sparkSession, path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (id, text), under fixed names, so that other columns can neither clash nor be read; a null text is empty."""
    return df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds `limit` bytes of text at most, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = byte_lengths(batch.column(column))
        ends, start = np.cumsum(sizes), 0
        while start < n:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def merged(batches: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """Batches of at least so many rows, for narrow rows that come in small ones."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def byte_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array without nulls, and the n + 1 offsets into them, from 0."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


#: 64-bit words of a sieve: 8 MB whatever the input.
SIEVE_WORDS = 1 << 20


class Sieve:
    """A bitmap of fixed size by the low bits of 64-bit keys. It lets through all keys that it was made of and few others
    while those are fewer than its 64 million bits; beyond that it lets more through, which costs speed, never rows: an
    exact join follows wherever it is used. Only the bitmap's filled words come to the driver, 8 MB at most."""

    def __init__(self, keys: DataFrame, column: str):
        spark = keys.sparkSession
        words = keys.where(F.col(column).isNotNull()).select(F.col(column).cast("bigint").alias(column)).select(F.expr(f"shiftrightunsigned(`{column}`, 6) & {SIEVE_WORDS - 1}L").alias("w"), F.expr(f"shiftleft(1L, cast(`{column}` & 63 AS int))").alias("bit"))
        found = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
        bits = np.zeros(SIEVE_WORDS, np.uint64)
        if found.num_rows:
            bits[found.column("w").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        self.shared = spark.sparkContext.broadcast(bits)

    def __getstate__(self):
        return {"shared": self.shared}

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.view(np.uint64)
        return (self.shared.value[(keys >> np.uint64(6)) & np.uint64(SIEVE_WORDS - 1)] >> (keys & np.uint64(63))) & np.uint64(1) == 1
