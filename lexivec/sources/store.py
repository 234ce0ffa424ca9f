"""The chunk store: Parquet folders by bucket of document, and versions that list the folders they are made of.

A change rewrites the buckets that it touches into new folders and then commits a manifest under the next number, which is
made only if no other writer has made it; the loser starts again from the winner's version. So readers see one version or
the other, no write is lost, and a writer that dies leaves the old version in place. (Commits are as safe as the file
system's exclusive create: HDFS and local disks have one, some object stores do not.) A document's chunks lie in one bucket,
so reads by document skip the rest.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexivec.functions.text import uuid5
from lexivec.functions.vectors import has_vector
from lexivec.operators.adjacency import fetch
from lexivec.operators.sparse import with_counts
from lexivec.sources.files import CHUNKS

#: A chunk and its sparse vector.
STORED = CHUNKS + ", sparse array<struct<idx:bigint,tf:bigint>>"
#: Commits that are tried before a change gives up.
TRIES = 8


def _names(schema: str) -> list[str]:
    return [f.split(" ")[0] for f in schema.split(", ")]


def latest(old: DataFrame, new: DataFrame, key: str = "chunk_id", order: str | None = None) -> DataFrame:
    """Upsert: rows of `new` replace rows of `old` of the same key; of rows of one batch with one key the last by `order`
    stays. One shuffle by key; a window keeps one row a key in each task first."""
    one = F.lit(0) if order is None else F.col(order)
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    w = W.partitionBy(key).orderBy(F.desc("_batch"), one.desc() if order else F.hash(*[c for c in new.columns if new.schema[c].dataType.typeName() != "map"]))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_batch")


class Conflict(RuntimeError):
    """Another writer committed first."""


class ChunkStore:
    """buckets: how many parts chunks are dealt to by document when a store is made; a change rewrites those it touches."""

    def __init__(self, spark: SparkSession, path: str, dimensions: int | None = None, buckets: int = 64):
        self.spark, self.path, self.dimensions, self.buckets = spark, path.rstrip("/"), dimensions, buckets

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _listed(self) -> list[tuple[int, int]]:
        """(number, bytes) of each version's manifest, the oldest first."""
        fs, path = self._fs()
        if not fs.exists(path(f"{self.path}/_versions")):
            return []
        return sorted((int(s.getPath().getName()), s.getLen()) for s in fs.listStatus(path(f"{self.path}/_versions")) if s.getPath().getName().isdigit())

    def versions(self) -> list[int]:
        """Numbers of committed versions, the oldest first."""
        return [n for n, size in self._listed() if size]

    def _manifest(self, version: int | None) -> dict:
        """buckets (how many there are) and files: the folders of each bucket, relative to the store."""
        if version is None:
            return {"buckets": self.buckets, "files": {}}
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/_versions/{version:020d}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _table(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).parquet(*[f"{self.path}/{f}" for f in folders])

    def _read(self, manifest: dict, buckets: set[int] | None = None) -> DataFrame:
        return self._table([f for b, fs in manifest["files"].items() if buckets is None or int(b) in buckets for f in fs])

    def _current(self) -> dict:
        found = self.versions()
        return self._manifest(found[-1] if found else None)

    def read(self) -> DataFrame:
        """The current chunks; an empty table before the first write."""
        return self._read(self._current()).select(_names(CHUNKS))

    def counts(self) -> DataFrame:
        """(id, sparse): the stored term counts of the current chunks. Weights are made of them at query time, since the
        statistics of BM25 change with every write; see sparse.counted_scores."""
        return self._read(self._current()).select(F.col("chunk_id").alias("id"), "sparse")

    def _bucket(self, manifest: dict):
        return F.pmod(F.xxhash64("source_document"), F.lit(manifest["buckets"])).cast("int")

    def _write(self, chunks: DataFrame, manifest: dict) -> dict[str, list[str]]:
        """The folders that the chunks were written to, by bucket. Adaptive execution splits a large bucket and joins small ones."""
        folder = f"data/{uuid.uuid4().hex}"
        dealt = chunks.withColumn("bucket", self._bucket(manifest)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "source_document", "section_path", "chunk_index")
        dealt.select("bucket", *_names(STORED)).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        fs, path = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(path(f"{self.path}/{folder}"))]
        return {n.removeprefix("bucket="): [f"{folder}/{n}"] for n in names if n.startswith("bucket=")}

    def _commit(self, after: int | None, manifest: dict) -> None:
        """The manifest becomes the version after the one that it was made from, unless another writer has made that one:
        a file of its number is created only if there is none."""
        fs, path = self._fs()
        fs.mkdirs(path(f"{self.path}/_versions"))
        try:
            stream = fs.create(path(f"{self.path}/_versions/{(after or 0) + 1:020d}"), False)
        except Exception as e:
            raise Conflict(f"version {(after or 0) + 1} of {self.path} was written by another writer") from e
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()

    def _change(self, change: Callable[[dict], dict]) -> None:
        """Make a manifest from the current one and commit it; once more from the start if another writer was first."""
        for turn in range(TRIES):
            found = self._listed()
            if found and not found[-1][1]:  # its writer is between making the file and filling it
                time.sleep(0.2 * (turn + 1))
                continue
            number = found[-1][0] if found else None
            try:
                return self._commit(number, change(self._manifest(number)))
            except Conflict:
                if turn == TRIES - 1:
                    raise
        raise Conflict(f"the last version of {self.path} has an empty manifest: its writer has died; delete that file")

    def _checked(self, chunks: DataFrame) -> DataFrame:
        """With the columns of a stored chunk."""
        if self.dimensions is not None:
            size = F.size("embedding")
            wrong = has_vector(F.col("embedding")) & (size != self.dimensions)
            chunks = chunks.withColumn("embedding", F.when(wrong, F.raise_error(F.concat(F.lit(f"a vector must have {self.dimensions} numbers, not "), size.cast("string"))).cast("array<float>")).otherwise(F.col("embedding")))
        return with_counts(chunks, "text")

    def _touched(self, manifest: dict, chunks: DataFrame) -> set[int]:
        return {r[0] for r in chunks.select(self._bucket(manifest)).distinct().collect()}

    def upsert(self, chunks: DataFrame, require_vector: bool = False, order: str | None = None, replace_documents: bool = False) -> None:
        """Insert or replace by chunk_id; with require_vector chunks without an embedding are left out. Only buckets that hold
        the new chunks' documents, or older chunks of their ids, are rewritten. replace_documents: of a document that the
        batch has, chunks that the batch lacks go."""
        new = self._checked(chunks.where(has_vector(F.col("embedding"))) if require_vector else chunks)

        def change(manifest: dict) -> dict:
            moved = self._read(manifest).select("chunk_id", "source_document").join(new.select("chunk_id").distinct(), "chunk_id", "left_semi")
            touched = self._touched(manifest, new) | self._touched(manifest, moved)
            old = self._read(manifest, touched)
            if replace_documents:
                names = chunks.select(F.col("source_document").alias("_d")).distinct()
                old = old.join(names, F.col("source_document").eqNullSafe(F.col("_d")), "left_anti")
            return self._rewritten(manifest, touched, latest(old, new, order=order))

        self._change(change)

    def _rewritten(self, manifest: dict, touched: set[int], chunks: DataFrame) -> dict:
        kept = {b: f for b, f in manifest["files"].items() if int(b) not in touched}
        return manifest | {"files": kept | self._write(chunks, manifest)}

    def append(self, chunks: DataFrame) -> None:
        """Chunks beside the old ones; nothing is rewritten."""
        new = self._checked(chunks)

        def change(manifest: dict) -> dict:
            files = dict(manifest["files"])
            for b, folders in self._write(new, manifest).items():
                files[b] = files.get(b, []) + folders
            return manifest | {"files": files}

        self._change(change)

    def delete_document(self, name: str | None) -> None:
        def change(manifest: dict) -> dict:
            touched = self._touched(manifest, self.spark.createDataFrame([(name,)], "source_document string"))
            return self._rewritten(manifest, touched, self._read(manifest, touched).where(~F.col("source_document").eqNullSafe(F.lit(name))))

        self._change(change)

    def compact(self) -> None:
        """Buckets of several folders, as appends leave them, become one folder each."""

        def change(manifest: dict) -> dict:
            touched = {int(b) for b, folders in manifest["files"].items() if len(folders) > 1}
            return self._rewritten(manifest, touched, self._read(manifest, touched))

        self._change(change)

    def clear(self) -> None:
        self._change(lambda manifest: manifest | {"files": {}})

    def document(self, name: str) -> DataFrame:
        """The chunks of a document, read from its bucket alone."""
        manifest = self._current()
        touched = self._touched(manifest, self.spark.createDataFrame([(name,)], "source_document string"))
        return self._read(manifest, touched).where(F.col("source_document") == name).select(_names(CHUNKS))

    def fetch(self, source_document: str, indices: list[int], section_path: str | None = None) -> DataFrame:
        return fetch(self.document(source_document), source_document, indices, section_path)

    def vacuum(self, keep: int = 1) -> None:
        """Delete all but the last `keep` versions and what only those hold; only when nobody reads or writes."""
        fs, path = self._fs()
        found = self.versions()
        used = {f for n in found[-keep:] for folders in self._manifest(n)["files"].values() for f in folders}
        for n in found[:-keep]:
            fs.delete(path(f"{self.path}/_versions/{n:020d}"), False)
        if fs.exists(path(f"{self.path}/data")):
            for s in fs.listStatus(path(f"{self.path}/data")):
                for b in fs.listStatus(s.getPath()):
                    if b.isDirectory() and f"data/{s.getPath().getName()}/{b.getPath().getName()}" not in used:
                        fs.delete(b.getPath(), True)


PAYLOAD = {"chunk_id": "chunkId", "text": "text", "source_document": "sourceDocument", "chunk_index": "chunkIndex", "chunk_total": "chunkTotal", "start_page": "startPage", "end_page": "endPage", "section": "section", "section_path": "sectionPath"}


def to_payload(chunks: DataFrame, namespace: uuid.UUID = uuid.NAMESPACE_DNS) -> DataFrame:
    """Points for a vector service: point_id (a name-based UUID of the chunk's id), vector and a JSON payload in camel case.
    Chunks without a vector have no point."""
    fields = [F.col(a).alias(b) for a, b in PAYLOAD.items()] + [F.col("metadata")]
    return chunks.where(has_vector(F.col("embedding"))).select(uuid5(F.col("chunk_id"), namespace).alias("point_id"), F.col("embedding").alias("vector"), F.to_json(F.struct(*fields)).alias("payload"))


def from_payload(points: DataFrame) -> DataFrame:
    """Chunks of JSON payloads; missing texts and numbers are empty and 0, metadata may be an object or its JSON text."""
    get = lambda k: F.get_json_object("payload", f"$.{k}")
    number = lambda k: get(k).try_cast("int")
    text = {c: F.coalesce(get(k), F.lit("")) for c, k in PAYLOAD.items() if c in ("chunk_id", "text", "source_document")}
    metadata = F.coalesce(F.from_json(get("metadata"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    return points.select(
        *[c.alias(k) for k, c in text.items()], F.coalesce(number("chunkIndex"), F.lit(0)).alias("chunk_index"), F.coalesce(number("chunkTotal"), F.lit(0)).alias("chunk_total"),
        number("startPage").alias("start_page"), number("endPage").alias("end_page"), get("section").alias("section"), get("sectionPath").alias("section_path"), F.col("vector").cast("array<float>").alias("embedding"), metadata.alias("metadata"),
    )
