"""Operator 10, removal of repeated byte strings by suffix order and longest-previous-factor arrays.

Every string of `length` bytes holds one anchor: the K-gram with the smallest hash in it. Equal strings have the same anchor
at the same place, so strings are compared among those of equal anchor only. The starts that share an anchor form a run, and
the bytes of its strings a segment, so a text is cut into segments of a few hundred bytes.

Equal segments meet in partial sums. Where unequal segments share an anchor, one copy of each is brought together, and the
suffixes at their starts are put in order by prefix tripling. In that order the previous and the next smaller position of a
suffix are its best earlier matches: its longest previous factor (LPF) is the longer of both. Kept to `length`: the suffix
has an earlier match of that length if either stands in its block of equal strings. The mirror image (previous and next
larger position) gives later matches: a string has one if another of its block has an earlier match. keep="first" removes
what has an earlier match; keep="none" what has either. Only
starts whose string has the hash of another start of the anchor are put in order; the others have no match.
An anchor with more than MOST segments is resolved by 128-bit hashes of its strings instead, dealt out evenly.

`shared`, a length under `length`, asks besides how much of a text stands in repeated strings of that length, without
removing them: passages too short to be removed show there. Anchors are then those of the shorter strings, and segments
reach as far as the longer ones (equal long strings begin with equal short ones); the text's end cuts a segment short.

Edge cases: null and empty texts and those shorter than `length` lose nothing; rows that repeat id and text are copies of
each other; null ids take part (their texts come last); texts of any length are taken whole, matches never reach over two
texts; an empty table gives an empty result; other columns are not read. Cuts are made between bytes, so what is left of a
text need not be valid UTF-8 and is returned as bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm import common
from lexivec.llm.words import Rolling, mix

#: Segments of one anchor that are put in suffix order at once.
MOST = 8192
#: Segment bytes that are put in suffix order at once, but for a larger anchor.
BLOCK = 2 << 20
PLACE = (1 << 24) - 1


def gram_width(length: int) -> int:
    return max(1, min(48, length // 2))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, extent: int = 0) -> tuple[np.ndarray, ...]:
    """For texts end to end: row, low, high, stop, anchor, segment of each run: the strings that start in [low, high] of the
    row have this anchor (a hash), the segment ends at stop (`extent` bytes from the last start, or with the text), and the
    hash of the segment's bytes and of the anchor's place in it."""
    empty = np.empty(0, np.int64)
    sizes = np.diff(offsets) - length + 1
    rows = np.flatnonzero(sizes > 0)
    if not len(rows):
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    width = gram_width(length)
    rolling = Rolling(data)
    grams, span = rolling.windows(width), length - width + 1
    at = np.empty(len(data) - length + 1, np.int64)
    step = PLACE + 1 - 2 * span
    for base in range(0, len(at), step):  # one step but for a text of many MB
        keys = grams[base : base + step + span - 1] & ~np.uint64(PLACE) | np.arange(len(grams[base : base + step + span - 1]), dtype=np.uint64)
        reach, n = 1, len(keys) - span + 1
        while 2 * reach <= span:
            keys = np.minimum(keys[:-reach], keys[reach:])
            reach *= 2
        least = np.minimum(keys[:n], keys[span - reach : span - reach + n])
        at[base : base + n] = (least & np.uint64(PLACE)).astype(np.int64) + base
    n = sizes[rows]
    starts = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[rows], n)
    row = np.repeat(rows, n)
    at = at[starts]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    low, high, at, row = starts[first], starts[last], at[first], row[first]
    stop = np.minimum(high + max(extent, length), offsets[row + 1])
    segment = rolling.ranges(low, stop) ^ mix((at - low).astype(np.uint64) + np.uint64(1))
    return row, low - offsets[row], high - offsets[row], stop - offsets[row], grams[at], segment


def prefix_ranks(data: np.ndarray, lengths: list[int]) -> dict[int, tuple[np.ndarray, int]]:
    """For each length: the ranks of all strings of a width up to it, and that width, of which three cover the length. Eight
    bytes are a number as they are; then three ranks in a row make one of three times the width, while they fit a number
    (two of twice the width for very long data)."""
    n, width, found = len(data), min(8, *lengths), {}
    rank = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        rank = rank << np.uint64(8) | data[k : n - width + 1 + k]
    bits = int(n).bit_length()
    step = 3 if 3 * bits <= 64 else 2
    while True:
        found |= {k: (rank, width) for k in lengths if width <= k < step * width or k == width}
        if step * width > max(lengths):
            return found
        rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
        m = n - step * width + 1
        rank, width = sum((rank[k * width : k * width + m] << np.uint64((step - 1 - k) * bits) for k in range(1, step)), rank[:m] << np.uint64((step - 1) * bits)), step * width


def suffix_blocks(data: np.ndarray, starts: np.ndarray, length: int, ranks: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The starts in the order of the `length` bytes from each on, and of each the number of its block of equal strings."""
    rank, width = (ranks or prefix_ranks(data, [length]))[length]
    keys = [rank[starts + at] for at in dict.fromkeys((0, min(width, length - width), length - width))]
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(starts), bool)
    for key in keys:
        key = key[order]
        fresh[1:] |= key[1:] != key[:-1]
    return order, np.cumsum(fresh)


def nearest_smaller(position: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in suffix order: the index of the previous and of the next one in the block with a smaller position, or
    -1. Between a suffix and its candidate all positions are larger, so a candidate that is larger hands on its own."""
    n, found = len(position), []
    for backwards in (False, True):
        p, b = (position[::-1], block[::-1]) if backwards else (position, block)
        start = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        floor = np.repeat(start, np.diff(np.concatenate([start, [n]])))
        parent = np.arange(n) - 1
        parent[parent < floor] = -1
        todo = np.flatnonzero(parent >= 0)
        while len(todo):
            todo = todo[p[parent[todo]] > p[todo]]
            parent[todo] = parent[parent[todo]]
            todo = todo[parent[todo] >= 0]
        found.append(np.where(parent >= 0, n - 1 - parent, -1)[::-1] if backwards else parent)
    return found[0], found[1]


def matched(data: np.ndarray, starts: np.ndarray, position: np.ndarray, length: int, keep: str, ranks: dict | None = None) -> np.ndarray:
    """Whether the string at each start has an earlier match (or, with keep="none", an earlier or a later one)."""
    if not len(starts):
        return np.zeros(0, bool)
    order, block = suffix_blocks(data, starts, length, ranks)
    before, after = nearest_smaller(position[order], block)
    hit = (before >= 0) | (after >= 0)
    if keep == "none":  # where one has an earlier match, all in its block have an earlier or a later one
        hit = (np.bincount(block, hit) > 0)[block]
    out = np.zeros(len(starts), bool)
    out[order] = hit
    return out


def spans_of(hit: np.ndarray) -> np.ndarray:
    """The maximal runs of True as rows of (first, last)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return edge.reshape(-1, 2) - [0, 1]


def _segments(docs: DataFrame, length: int, extent: int, wanted: common.Sieve | None = None) -> DataFrame:
    """id, version, low, high, stop, anchor, segment of all runs; with a sieve anchor, segment and the bytes of those let
    through."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            data, offsets = common.raw_bytes(batch.column("text"))
            row, low, high, stop, anchor, segment = anchors(data, offsets, length, extent)
            anchor, segment = anchor.view(np.int64), segment.view(np.int64)
            if wanted:
                pick = np.flatnonzero(wanted.may_hold(anchor))
                pick = pick[np.unique(np.stack([anchor[pick], segment[pick]]), axis=1, return_index=True)[1]] if len(pick) else pick
                start, end = offsets[row[pick]] + low[pick], offsets[row[pick]] + stop[pick]
                whole = [data[s:e].tobytes() for s, e in zip(start.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[pick]), pa.array(segment[pick]), pa.array(whole, pa.binary())], names=["anchor", "segment", "whole"])
            else:
                versions = np.array([xxhash.xxh3_64_intdigest(t.as_buffer()) for t in batch.column("text")], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), pa.array(versions[row]), pa.array(low), pa.array(high), pa.array(stop), pa.array(anchor), pa.array(segment)], names=["id", "version", "low", "high", "stop", "anchor", "segment"])

    return docs.mapInArrow(run, "anchor bigint, segment bigint, whole binary" if wanted else f"id {kind}, version bigint, low bigint, high bigint, stop bigint, anchor bigint, segment bigint")


def _resolve(lengths: list[int], keep: str):
    """Rows (anchor, segment, place, version, low, starts, whole) sorted by anchor to (anchor, segment, spans, short): which
    starts of a segment are matched at the longest of the lengths, and at the shortest."""
    spans_type = pa.list_(pa.list_(pa.int32()))
    schema = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("spans", spans_type), ("short", spans_type)])

    def solve(anchor: np.ndarray, segment: np.ndarray, place: np.ndarray, version: np.ndarray, low: np.ndarray, n: np.ndarray, whole: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(w) for w in whole])
        data, offset = np.frombuffer(b"".join(whole), np.uint8), np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(n)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        # a start whose string has a hash of its own among the anchor's has no match: its segment need not be sorted
        h = mix(Rolling(data).windows(min(lengths))[inside + offset[of]] ^ mix(anchor.view(np.uint64)[of]))
        order = np.argsort(h)
        same = np.concatenate([[False], h[order][1:] == h[order][:-1]])
        likely = np.zeros(len(h), bool)
        likely[order] = same | np.append(same[1:], False)
        live = np.flatnonzero(np.bincount(of[likely], minlength=len(n)))
        where = np.full(len(n), -1)
        where[live] = np.cumsum(sizes[live]) - sizes[live]
        of, inside = of[likely], inside[likely]
        # positions in the order of the segments' first places, then inside them
        turn = np.empty(len(n), np.int64)
        turn[np.lexsort((low, version, place))] = np.arange(len(n))
        data = np.frombuffer(b"".join([whole[k] for k in live.tolist()]), np.uint8)
        ranks = prefix_ranks(data, lengths) if len(live) else {}
        found = []
        for length in (max(lengths), min(lengths)):
            fits = np.flatnonzero(inside + length <= sizes[of])
            hit = matched(data, where[of[fits]] + inside[fits], (turn[of[fits]] << 32) + inside[fits], length, keep, ranks)
            at, k = inside[fits][hit], of[fits][hit]
            first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (at[1:] != at[:-1] + 1)])) if len(k) else k
            last = np.append(first[1:], len(k))[: len(first)] - 1
            spans: dict[int, list] = {}
            for row, a, b in zip(k[first].tolist(), at[first].tolist(), at[last].tolist()):
                spans.setdefault(row, []).append([a, b])
            found.append(spans)
        some = sorted(found[1])
        return pa.RecordBatch.from_arrays([pa.array(anchor[some]), pa.array(segment[some]), *(pa.array([spans.get(k) for k in some], spans_type) for spans in found)], schema=schema)

    numbers = ("anchor", "segment", "place", "version", "low", "starts")

    def joined(held: list[pa.RecordBatch]) -> list:
        return [*(np.concatenate([h.column(c).to_numpy() for h in held]) for c in numbers), [w for h in held for w in h.column("whole").to_pylist()]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and size > BLOCK and held[-1].column("anchor")[-1] != batch.column("anchor")[0]:
                yield solve(*joined(held))
                held, size = [], 0
            keys = batch.column("anchor").to_numpy()
            cut = int(np.searchsorted(keys == keys[-1], True)) if size + batch.nbytes > BLOCK else 0
            if cut:  # all but the last anchor is complete
                yield solve(*joined([*held, batch.slice(0, cut)]))
                held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += common.byte_lengths(batch.column("whole")).sum()
        if held:
            yield solve(*joined(held))

    return run


def _by_hash(rows: DataFrame, lengths: list[int], keep: str) -> DataFrame:
    """The same for anchors with too many segments: equal strings by their 128-bit hash, with partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                whole, starts = batch.column("whole")[k].as_buffer(), batch.column("starts")[k].as_py()
                for length in lengths:
                    n = max(0, min(starts, len(whole) - length + 1))
                    view = memoryview(whole)
                    h = [xxhash.xxh3_128_digest(view[a : a + length]) for a in range(n)]
                    same = lambda c: pa.array(np.repeat(batch.column(c)[k].as_py(), n), pa.int64())
                    yield pa.RecordBatch.from_arrays([*(same(c) for c in names), pa.array(np.arange(n), pa.int32()), pa.array([length] * n, pa.int32()), pa.array(h, pa.binary())], names=[*names, "at", "length", "h"])

    names = ("anchor", "segment", "place", "version", "low")
    strings = rows.mapInArrow(run, "anchor bigint, segment bigint, place bigint, version bigint, low bigint, at int, length int, h binary")
    here = F.struct("place", "version", "low", "at")
    several = strings.groupBy("anchor", "length", "h").agg(F.count("*").alias("n"), F.min(here).alias("first")).where("n > 1")
    hits = strings.join(several, ["anchor", "length", "h"])
    hits = hits if keep == "none" else hits.where(here != F.col("first"))
    of = lambda length: F.array_sort(F.collect_set(F.when(F.col("length") == length, F.array("at", "at"))))
    return hits.groupBy("anchor", "segment").agg(of(max(lengths)).alias("spans"), of(min(lengths)).alias("short"))


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, keep: str = "none", shared: int | None = None) -> DataFrame:
    """Per distinct (id, text) that has any: id, version, spans and short (struct<first, last> of the starts, inclusive and
    unordered, of matched strings of `length` and of `shared` bytes; without `shared` both are the same)."""
    lengths = [length, shared or length]
    if keep not in ("none", "first") or not 2 <= lengths[1] <= length:
        raise ValueError("keep is none or first, shared and length 2 or more, shared not over length")
    spark = df.sparkSession
    common.small_batches(spark)
    docs = common.texts_of(df, id_col, text_col)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = common.materialise(_segments(docs, lengths[1], length), "runs")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "version", "low")
    # ids that are not numbers are ordered by a hash where unequal segments meet
    number = F.coalesce(F.col("id").cast("bigint"), F.lit((1 << 62))) if docs.schema["id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else F.xxhash64("id")
    classes = runs.groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.min(F.struct(number.alias("place"), "version", "low")).alias("at"), F.min(F.col("high") - F.col("low") + 1).alias("starts"))
    several = runs.groupBy("anchor").agg(F.count("*").alias("total")).where("total > 1").select("anchor")
    classes = common.materialise(classes.join(several, "anchor"), "classes", packed=True)
    contested = common.materialise(classes.groupBy("anchor").agg(F.count("*").alias("segments")).where("segments > 1"), "contested", packed=True)
    whole = _segments(docs, lengths[1], length, common.Sieve(contested, "anchor")).join(classes.join(contested, "anchor").select("anchor", "segment", "at.*", "starts", "segments"), ["anchor", "segment"])
    of_class = [F.min(c).alias(c) for c in ("place", "version", "low", "starts", "segments")]  # one value in a class
    whole = common.materialise(whole.groupBy("anchor", "segment").agg(F.first("whole").alias("whole"), *of_class), "segments")
    small = whole.where(F.col("segments") <= MOST).repartition(parts, "anchor").sortWithinPartitions("anchor", "segment")
    solved = small.mapInArrow(_resolve(sorted(set(lengths)), keep), "anchor bigint, segment bigint, spans array<array<int>>, short array<array<int>>")
    if not whole.where(F.col("segments") > MOST).isEmpty():
        solved = solved.unionByName(_by_hash(whole.where(F.col("segments") > MOST), sorted(set(lengths)), keep))
    solved = common.materialise(solved, "solved")
    # a segment that occurs several times is matched as a whole, but for its first place if that is kept
    judged = classes.select("anchor", "segment", "n", "first").join(solved, ["anchor", "segment"], "left").where("n > 1 OR short IS NOT NULL")
    judged = common.materialise(judged, "judged", packed=True)  # a join of two plain shuffles can be split where a segment is hot
    mine = runs.join(judged, ["anchor", "segment"])
    all_of_it = F.col("n") > 1 if keep == "none" else (F.col("n") > 1) & (place != F.col("first"))
    span = lambda a, b: F.struct(a.alias("first"), b.alias("last"))
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")

    def of(spans: str, last: Column) -> Column:
        parts_of_it = F.transform(spans, lambda s: span(F.col("low") + s[0], F.col("low") + s[1]))
        whole_run = F.when(last >= F.col("low"), F.array(span(F.col("low"), last))).otherwise(none)
        return F.when(all_of_it, whole_run).otherwise(F.coalesce(parts_of_it, none)).alias(spans)

    found = mine.select("id", "version", of("spans", F.least("high", F.col("stop") - length)), of("short", F.col("high"))).where(F.size("short") > 0)
    # a run's spans once for rows that repeat
    return found.groupBy("id", "version").agg(*(F.flatten(F.collect_set(c)).alias(c) for c in ("spans", "short")))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, keep: str = "none", with_bytes: bool = True, shared: int | None = None) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, n_shared (bytes that stand in matched strings
    of `shared` bytes, removed or not), removed (array<struct<start, end>>, end exclusive) and kept (the remaining bytes)."""
    spans = common.materialise(repeated_spans(df, id_col, text_col, length, keep, shared), "spans", packed=True)
    docs = common.texts_of(df, id_col, text_col)
    kind = docs.schema["id"].dataType.simpleString()
    losers = common.Sieve(spans, "version")
    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    fields = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["n_shared"] if shared else []), *(["removed", "kept"] if with_bytes else [])]

    def covered(offsets: np.ndarray, spans: pa.Array | None, width: int) -> np.ndarray:
        """Which bytes of all texts end to end stand in the strings of `width` bytes that the rows' spans name."""
        if spans is None:
            return np.zeros(offsets[-1], bool)
        sizes = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
        flat, at = pc.list_flatten(spans), np.repeat(offsets[:-1], sizes)
        edge = np.bincount(at + flat.field("first").to_numpy(), minlength=offsets[-1] + 1) - np.bincount(at + flat.field("last").to_numpy() + width, minlength=offsets[-1] + 1)
        return np.cumsum(edge[:-1]) > 0

    def cut(batch: pa.RecordBatch, spans: pa.Array | None = None, short: pa.Array | None = None) -> pa.RecordBatch:
        data, offsets = common.raw_bytes(batch.column("text"))
        count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
        gone = covered(offsets, spans, length)
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        begins[offsets[:-1][np.diff(offsets) > 0]] = gone[offsets[:-1][np.diff(offsets) > 0]]
        whole = [(data[a:b], gone[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        kept = [(text[~out] if out.any() else text).tobytes() for text, out in whole]
        columns = [batch.column("id"), pa.array(np.diff(offsets)), pa.array(count(gone)), pa.array(count(begins)), pa.array([hashlib.sha256(t).hexdigest() for t in kept])]
        columns += [pa.array(count(covered(offsets, short, shared)))] if shared else []
        if with_bytes:
            columns += [pa.array([[{"start": a, "end": b + 1} for a, b in spans_of(out).tolist()] for _, out in whole], pa.list_(pair)), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=fields)

    def versions(batch: pa.RecordBatch) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(t.as_buffer()) for t in batch.column("text")], np.uint64).view(np.int64)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            stay = batch.filter(pa.array(~losers.may_hold(versions(batch))))
            if stay.num_rows:
                yield cut(stay)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            version = versions(batch)
            may = pa.array(losers.may_hold(version))
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(may), batch.column("text").filter(may), pa.array(version).filter(may)], names=["id", "text", "version"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            yield cut(batch, batch.column("spans"), batch.column("short"))

    schema = f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", n_shared bigint" * bool(shared) + ", removed array<struct<start: bigint, end: bigint>>, kept binary" * with_bytes
    own = docs.mapInArrow(suspects, f"id {kind}, text string, version bigint")
    found = spans.select(F.col("id").alias("span_id"), F.col("version").alias("span_version"), "spans", "short")
    both = own.join(found, (F.col("version") == F.col("span_version")) & F.col("id").eqNullSafe(F.col("span_id")), "left").select("id", "text", "spans", "short")
    return docs.mapInArrow(whole, schema).unionByName(both.mapInArrow(apply, schema)).withColumnRenamed("id", id_col)
