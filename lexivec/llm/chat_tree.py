"""Operator 3, chat formatting over a prefix tree of conversations.

Template: each turn is <|im_start|>role, a line end, its text, <|im_end|> and a line end. Inside roles and texts every "<",
backslashes and "|" in a row gets one backslash more, so that no text can hold a control string and reading undoes it; a
role's own backslashes and line ends are escaped as well. The loss mask covers what assistants say.

Conversations that begin with the same turns share those nodes of a tree. Distinct conversations are sorted by the path of
their turns' hashes, which is the order of the tree's leaves in a depth-first walk, and written as packs: a pack is one
training sequence of `pack_chars` code points at most, or one longer conversation. In a pack every shared turn is emitted
once, before all that follows it; each node has its interval in the sequence, the position at which it starts (its depth in
code points, so siblings have equal positions) and the intervals of its ancestors, adjoining ones merged, which with the
node's own causal part are all that it attends to. A new pack repeats the shared turns it needs, as attention cannot leave
it. Tokens are code points; a tokenizer's offsets refine them.

Edge cases: null roles and texts are empty; turns are ordered by number (nulls first), then role and text; repeated rows
are turns of their own; a null conversation id is a conversation; equal conversations are one leaf with many owners, joined
back at the end with skew-split joins; a conversation must fit in memory, a group of equal ones need not; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm import common

START, END = "<|im_start|>", "<|im_end|>"
LEARNT = "assistant"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def turn_text(role: str, text: str) -> tuple[str, tuple[int, int]]:
    """A formatted turn, and where in it the loss mask lies."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", (len(head), len(head) + len(body)) if role == LEARNT else (0, 0)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END + "\n", line)
        turns.append((unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return turns


@dataclass
class Node:
    start: int
    end: int
    position: int
    ancestors: list[tuple[int, int]]
    loss: tuple[int, int]
    leaves: list[bytes] = field(default_factory=list)


class Pack:
    """A training sequence under construction: conversations come in depth-first order."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.nodes: list[Node] = []
        self.path: list[tuple[tuple[str, str], Node]] = []

    def add(self, turns: list[tuple[str, str]], leaf: bytes) -> None:
        shared = 0
        while shared < min(len(turns), len(self.path)) and self.path[shared][0] == turns[shared]:
            shared += 1
        del self.path[shared:]
        for turn in turns[shared:]:
            whole, (a, b) = turn_text(*turn)
            parent = self.path[-1][1] if self.path else None
            above: list[tuple[int, int]] = []
            if parent:
                above = [*parent.ancestors, (parent.start, parent.end)]
                if len(above) > 1 and above[-2][1] == above[-1][0]:
                    above[-2:] = [(above[-2][0], above[-1][1])]
            node = Node(self.size, self.size + len(whole), parent.position + parent.end - parent.start if parent else 0, above, (self.size + a, self.size + b) if b > a else (0, 0))
            self.parts.append(whole)
            self.size += len(whole)
            self.nodes.append(node)
            self.path.append((turn, node))
        self.path[-1][1].leaves.append(leaf)

    def row(self) -> dict:
        pair = lambda p: {"start": p[0], "end": p[1]}
        return {"text": "".join(self.parts), "nodes": [{"start": n.start, "end": n.end, "position": n.position, "ancestors": list(map(pair, n.ancestors)), "loss": pair(n.loss), "leaves": n.leaves} for n in self.nodes]}


INTERVAL = pa.struct([("start", pa.int64()), ("end", pa.int64())])
NODE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("position", pa.int64()), ("ancestors", pa.list_(INTERVAL)), ("loss", INTERVAL), ("leaves", pa.list_(pa.binary()))])
PACK_SCHEMA = "text string, nodes array<struct<start: bigint, end: bigint, position: bigint, ancestors: array<struct<start: bigint, end: bigint>>, loss: struct<start: bigint, end: bigint>, leaves: array<binary>>>"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: id, leaf (a digest of its turns), path (eight bytes a turn) and turns."""
    rows = turns.select(turns[id_col].alias("id"), turns[turn_col].alias("turn"), F.coalesce(turns[role_col], F.lit("")).alias("role"), F.coalesce(turns[text_col], F.lit("")).alias("text"))
    whole = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, paths = [], []
            for said in batch.column("turns").to_pylist():
                leaf, path = hashlib.sha256(), []
                for t in said:
                    one = b"%d:%b%d:%b" % (len(r := t["role"].encode()), r, len(x := t["text"].encode()), x)
                    leaf.update(one)
                    path.append(xxhash.xxh3_64_digest(one))
                leaves.append(leaf.digest())
                paths.append(b"".join(path))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(leaves, pa.binary()), pa.array(paths, pa.binary()), batch.column("turns")], names=["id", "leaf", "path", "turns"])

    kinds = dict(rows.dtypes)
    return whole.mapInArrow(run, f"id {kinds['id']}, leaf binary, path binary, turns array<struct<turn: {kinds['turn']}, role: string, text: string>>")


def pack(convs: DataFrame, pack_chars: int = 1 << 20) -> DataFrame:
    """Distinct conversations to packs: text and nodes."""
    parts = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = convs.groupBy("leaf").agg(F.first("path").alias("path"), F.first("turns").alias("turns"))
    leaves = common.materialise(leaves, "leaves")  # ranges are drawn from a sample, which must not compute this twice
    ordered = leaves.repartitionByRange(parts, "path", "leaf").sortWithinPartitions("path", "leaf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Pack()
        for batch in batches:
            for leaf, turns in zip(batch.column("leaf").to_pylist(), batch.column("turns").to_pylist()):
                turns = [(t["role"], t["text"]) for t in turns]
                if now.size and now.size + sum(len(r) + len(x) for r, x in turns) > pack_chars:
                    yield pa.RecordBatch.from_pylist([now.row()], schema=schema)
                    now = Pack()
                now.add(turns, leaf)
        if now.size:
            yield pa.RecordBatch.from_pylist([now.row()], schema=schema)

    schema = pa.schema([("text", pa.string()), ("nodes", pa.list_(NODE))])
    return ordered.select("leaf", "turns").mapInArrow(run, PACK_SCHEMA)


def unpack(packs: DataFrame) -> DataFrame:
    """Each leaf of packs, read back: leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. What a leaf's
    last node attends to, with the node itself, is the whole formatted conversation."""
    names = ["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text, rows = batch.column("text")[k].as_py(), []
                nodes = batch.column("nodes")[k].as_py()
                masks = sorted((n["loss"]["start"], n["loss"]["end"]) for n in nodes if n["loss"]["end"] > n["loss"]["start"])
                begins = [m[0] for m in masks]
                for n in nodes:
                    if not n["leaves"]:
                        continue
                    seen = [(a["start"], a["end"]) for a in n["ancestors"]] + [(n["start"], n["end"])]
                    formatted = "".join(text[a:b] for a, b in seen)
                    if len(formatted) != n["position"] + n["end"] - n["start"]:
                        raise ValueError("a node's position is not the length of what it attends to")
                    turns = parse(formatted)
                    learnt = "".join(unescape(text[a:b]) for i, j in seen for a, b in masks[bisect_left(begins, i) : bisect_left(begins, j)])
                    said = "".join(f"{r}\n{t}\n" for r, t in turns)
                    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                    rows += [(leaf, len(turns), sha(said), len(learnt), sha(learnt), len(formatted)) for leaf in n["leaves"]]
                columns = list(zip(*rows)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=names)

    return packs.mapInArrow(run, "leaf binary, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def format_chats(turns: DataFrame, path: str, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", pack_chars: int = 1 << 20) -> DataFrame:
    """Write the packs of all conversations to `path` (Parquet) and read every conversation back from them: id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    spark = turns.sparkSession
    common.small_batches(spark)
    convs = common.materialise(conversations(turns, id_col, turn_col, role_col, text_col), "conversations")
    pack(convs, pack_chars).write.parquet(path)
    found = common.materialise(unpack(spark.read.schema(PACK_SCHEMA).parquet(path)), "unpacked")
    owners = convs.select(F.col("id").alias(id_col), "leaf")
    return owners.join(found, "leaf").drop("leaf")
