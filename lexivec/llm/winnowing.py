"""Operator 6, benchmark decontamination by winnowing.

A fingerprint is the smallest hash of K words in each run of W such hashes, so whatever SPAN = K + W - 1 words two texts
share, they share a fingerprint. Fingerprints of the documents are joined with those of the benchmark, and each match is
extended word by word to the windows of SPAN words around it. An item of fewer words is one window, looked up whole.

The benchmark's index is broadcast only while its text is under `index_bytes`; beyond that fingerprints are joined by a
shuffle, and only documents that match any are read again. Both ways give the same rows.

Edge cases: null or empty texts have no words and no hits; an item without words has no window; items that repeat an id
count once, a null id counts under the empty name; repeated documents get the same row each; an empty benchmark or
document table gives no hits or no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm import common
from lexivec.llm.words import ALPHANUMERIC, Words, split

K, W = 5, 4
SPAN = K + W - 1
#: Bytes of benchmark text up to which its index is broadcast.
INDEX_BYTES = 32 << 20


def fingerprints(words: Words) -> np.ndarray:
    """Where, by word, the winnowed K-grams of each text stand: of each W in a row the smallest, the last one of equals."""
    grams, inside = words.grams(K)
    n = len(grams) - W + 1
    if n < 1:
        return np.empty(0, np.int64)
    least = grams[:n].copy()
    for t in range(1, W):
        np.minimum(least, grams[t : t + n], out=least)
    place = np.zeros(n, np.int64)
    for t in range(1, W):
        place[grams[t : t + n] == least] = t
    whole = inside[:n] & inside[W - 1 : W - 1 + n] & (words.row()[:n] == words.row()[W - 1 : W - 1 + n])
    chosen = np.zeros(len(grams), bool)
    chosen[(np.arange(n) + place)[whole]] = True
    return np.flatnonzero(chosen)


@dataclass
class Index:
    """Items' word hashes end to end; fingerprints of long items and whole short items, each sorted by hash."""

    names: list[str]
    words: Words
    long_hash: np.ndarray
    long_at: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(names: list[str], texts: list[str]) -> "Index":
        words = split(pa.array(texts, pa.string()), ALPHANUMERIC)
        at = fingerprints(words)
        grams, _ = words.grams(K)
        order = np.argsort(grams[at], kind="stable")
        short = {}
        for m in range(1, SPAN):
            of_m = np.flatnonzero(words.counts == m)
            if len(of_m):
                h = words.grams(m)[0][words.first[of_m]]
                o = np.argsort(h, kind="stable")
                short[m] = (h[o], of_m[o])
        return Index(names, words, grams[at][order], at[order], short)

    def sieve(self) -> np.ndarray:
        """By the top 16 bits of a hash: may it be a fingerprint here? Most of a document's are not."""
        found = np.zeros(1 << 16, bool)
        found[self.long_hash >> np.uint64(48)] = True
        return found


def pairs_of(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with keys[i] == sorted_keys[j]."""
    a, b = np.searchsorted(sorted_keys, keys, "left"), np.searchsorted(sorted_keys, keys, "right")
    n = b - a
    i = np.repeat(np.arange(len(keys)), n)
    return i, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)


def extend(doc: Words, at: np.ndarray, item: Words, item_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of matching K-grams: the windows of SPAN words around that agree word by word, as (first word, item's first word)."""
    row, item_row = doc.row()[at], item.row()[item_at]
    same = []
    for t in range(1 - W, SPAN):
        i, j = at + t, item_at + t
        ok = (i >= doc.first[row]) & (i < doc.first[row + 1]) & (j >= item.first[item_row]) & (j < item.first[item_row + 1])
        i, j = np.where(ok, i, 0), np.where(ok, j, 0)
        same.append(ok & (doc.hashes[i] == item.hashes[j]))
    starts, item_starts = [], []
    for s in range(W):
        ok = np.logical_and.reduce(same[s : s + SPAN])
        starts.append((at + s + 1 - W)[ok])
        item_starts.append((item_at + s + 1 - W)[ok])
    return np.concatenate(starts), np.concatenate(item_starts)


def report(words: Words, hits: list[tuple[np.ndarray, np.ndarray, int]], names: list[str], least_items: int) -> dict[str, pa.Array]:
    """hits: (first words, items, length) of windows found in the texts."""
    covered = np.zeros(len(words.hashes) + 1, np.int64)
    rows, items = [], []
    row = words.row()
    for starts, item, length in hits:
        for t in range(length):
            covered[starts + t] = 1
        rows.append(row[starts])
        items.append(item)
    total = np.concatenate([[0], np.cumsum(covered)])
    n_hit = total[words.first[1:]] - total[words.first[:-1]]
    of_row: list[list[str]] = [[] for _ in words.counts]
    if rows and sum(map(len, rows)):
        both = np.unique(np.stack([np.concatenate(rows), np.concatenate(items)]), axis=1)
        for r, i in both.T.tolist():
            of_row[r].append(names[i])
    of_row = [sorted(set(x)) for x in of_row]
    return {
        "n_words": pa.array(words.counts, pa.int64()),
        "n_hit": pa.array(n_hit, pa.int64()),
        "n_items": pa.array(list(map(len, of_row)), pa.int64()),
        "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in of_row]),
        "contaminated": pa.array([len(x) >= least_items for x in of_row]),
        "items": pa.array(of_row, pa.list_(pa.string())),
    }


def find(words: Words, index: Index, sieve: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    hits = []
    if len(index.long_hash):
        at = fingerprints(words)
        h = words.grams(K)[0][at]
        may = sieve[h >> np.uint64(48)]
        at, h = at[may], h[may]
        i, j = pairs_of(h, index.long_hash)
        starts, item_starts = extend(words, at[i], index.words, index.long_at[j])
        hits.append((starts, index.words.row()[item_starts], SPAN))
    for m, (keys, items) in index.short.items():
        grams, inside = words.grams(m)
        at = np.flatnonzero(inside)
        i, j = pairs_of(grams[at], keys)
        hits.append((at[i], items[j], m))
    return hits


KINDS = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>"


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_items: int = 2, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Per document row: id, n_words, n_hit (words inside any window of an item), n_items, items_sha256, contaminated
    (n_items >= least_items) and items (ids as strings, sorted)."""
    spark = documents.sparkSession
    common.small_batches(spark)
    docs = common.texts_of(documents, id_col, text_col)
    items = benchmark.select(F.coalesce(benchmark[item_col].cast("string"), F.lit("")).alias("name"), F.coalesce(benchmark[item_text_col], F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    kind = f"id {docs.schema['id'].dataType.simpleString()}, {KINDS}"
    found = _broadcast(docs, items, kind, least_items) if size <= index_bytes else _joined(docs, items, kind, least_items)
    return found.withColumnRenamed("id", id_col)


def keep_clean(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_items: int = 1, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """All columns of the documents that hold windows of fewer than `least_items` items. Maps while the index is small;
    beyond that rows whose id and text were found contaminated go by an anti-join."""
    spark = documents.sparkSession
    common.small_batches(spark)
    size = benchmark.agg(F.sum(F.octet_length(item_text_col)).alias("n")).first()["n"] or 0
    if size > index_bytes:
        marked = documents.withColumn("__lexivec_row", F.struct(F.col(id_col), F.xxhash64(F.coalesce(text_col, F.lit("")))))
        bad = decontaminate(marked, benchmark, "__lexivec_row", text_col, item_col, item_text_col, least_items, index_bytes).where("contaminated").select("__lexivec_row").distinct()
        return marked.join(bad, marked["__lexivec_row"].eqNullSafe(bad["__lexivec_row"]), "left_anti").select(documents.columns)
    rows = benchmark.select(F.coalesce(benchmark[item_col].cast("string"), F.lit("")).alias("name"), F.coalesce(benchmark[item_text_col], F.lit("")).alias("text")).collect()
    shared = spark.sparkContext.broadcast(Index.of([r["name"] for r in rows], [r["text"] for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        sieve = index.sieve()
        for batch in common.slices(batches, text_col):
            words = split(batch.column(text_col).fill_null(""), ALPHANUMERIC)
            found = report(words, find(words, index, sieve), index.names, least_items)
            yield batch.filter(pa.array([not c for c in found["contaminated"].to_pylist()], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def _broadcast(docs: DataFrame, items: DataFrame, kind: str, least_items: int) -> DataFrame:
    rows = items.collect()  # at most index_bytes of text
    shared = docs.sparkSession.sparkContext.broadcast(Index.of([r["name"] for r in rows], [r["text"] for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        sieve = index.sieve()
        for batch in common.slices(batches):
            words = split(batch.column("text"), ALPHANUMERIC)
            columns = {"id": batch.column("id")} | report(words, find(words, index, sieve), index.names, least_items)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, kind)


def _prints(df: DataFrame, key: str) -> DataFrame:
    """(key, hash, length, at): the winnowed fingerprints of long texts, and every short window that an item could be."""
    item = key == "name"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            words = split(batch.column("text"), ALPHANUMERIC)
            row, found = words.row(), [(fingerprints(words), words.grams(K)[0], SPAN)]
            for m in range(1, SPAN):
                grams, inside = words.grams(m)
                at = words.first[:-1][words.counts == m] if item else np.flatnonzero(inside)
                found.append((at, grams, m))
            at = np.concatenate([f[0] for f in found])
            h = np.concatenate([g[a] for a, g, _ in found]).view(np.int64)
            length = np.concatenate([np.full(len(a), m, np.int32) for a, _, m in found])
            rows = row[at]
            keys = batch.column(key).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([keys, pa.array(h), pa.array(length), pa.array(at - words.first[rows], pa.int64())], names=[key, "h", "length", "at"])

    return df.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, h bigint, length int, at bigint")


def _joined(docs: DataFrame, items: DataFrame, kind: str, least_items: int) -> DataFrame:
    """By a shuffle: which items' fingerprints a document has, then those items beside the document's text."""
    ours = _prints(items, "name").select("name", "h", "length").distinct()
    lengths = [r["length"] for r in ours.select("length").distinct().collect()]  # 8 at most
    theirs = _prints(docs, "id").where(F.col("length").isin(lengths or [0])).select("id", "h", "length").distinct()
    match = theirs.join(ours, ["h", "length"]).select("id", "name").distinct()
    item_texts = items.withColumnRenamed("text", "item_text")
    with_items = match.join(item_texts, "name").groupBy("id").agg(F.collect_list(F.struct("name", "item_text")).alias("found"))
    both = docs.join(with_items, docs["id"].eqNullSafe(with_items["id"]), "left").select(docs["id"], "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                words = split(one.column("text"), ALPHANUMERIC)
                found = one.column("found")[0].as_py() or []
                index = Index.of([f["name"] for f in found], [f["item_text"] for f in found])
                columns = {"id": one.column("id")} | report(words, find(words, index, index.sieve()), index.names, least_items)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return both.mapInArrow(run, kind)
