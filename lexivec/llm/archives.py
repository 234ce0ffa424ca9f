"""Operator 9, a converter from legacy ARC archives to WARC.

An ARC file begins with a version block that names its fields; each record is a header line of those fields (five in
version 1, ten in version 2) and as many bytes as the line declares. Records are found by their declared lengths alone,
never by what payloads hold. The WARC record's identifier, date, type and digests are made from the ARC record: a
name-based UUID, the 14-digit date in ISO form, response for HTTP messages and resource for the rest, and base32 SHA-1.

Files are read as streams, plain or gzip-compressed in one member or in many (one a record, as archives usually are), so a
task holds a file's compressed bytes, one record and one piece. `convert` turns ARC files into WARC files, `read_arc` gives
their records, `read_warc` those of any WARC files: the digest is the declared one or, without one, that of the payload;
a revisit gets its page and length from the record that WARC-Refers-To names, and nulls if that is not in the files read.

Edge cases: a null or empty payload is 0 bytes with the digest of nothing; payloads may hold header lines, line ends and
archive markers; a blank, a control character or a null in a URL is percent-encoded; pages that repeat stay; a null page
id is carried as none; of equal payloads a page without an id is a revisit if any has one; an empty table writes no
record and reads none; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm import common

#: The field lines of both ARC versions.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
END = b"\r\n\r\n"
#: The date of pages that carry none.
DATE = "20200101000000"
#: What a WARC file holds at most, but for one larger record: bounds the memory of the task that reads it back.
FILE_BYTES, FILE_RECORDS = 16 << 20, 1024
#: Bytes that are decompressed at once.
PIECE = 1 << 20


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def quoted(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "-"


def http_message(payload: bytes, kind: str = "text/html; charset=utf-8") -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def write_arc(records: list[tuple[str, bytes]], version: int = 1, date: str = DATE, ip: str = "0.0.0.0") -> bytes:
    """An ARC file of (url, content) records."""
    head = f"{version} 0 lexivec\n{' '.join(FIELDS[version])}\n\n"

    def line(url: str, kind: str, content: bytes, offset: int) -> bytes:
        said = {"URL": url, "IP-address": ip, "Archive-date": date, "Content-type": kind, "Result-code": "200", "Checksum": hashlib.md5(content).hexdigest(), "Location": "-", "Offset": str(offset), "Filename": "lexivec.arc", "Archive-length": str(len(content))}
        return (" ".join(said[f] for f in FIELDS[version]) + "\n").encode()

    out = bytearray(line("filedesc://lexivec.arc", "text/plain", head.encode(), 0) + head.encode() + b"\n")
    for url, content in records:
        out += line(quoted(url), "text/html", content, len(out)) + content + b"\n"
    return bytes(out)


@dataclass
class ArcRecord:
    fields: dict[str, str]
    content: bytes


def pieces(content) -> Iterator[bytes]:
    """The bytes of a file: as they are, or out of all its gzip members."""
    content = memoryview(content)
    if bytes(content[:2]) != b"\x1f\x8b":
        for at in range(0, len(content), PIECE):
            yield bytes(content[at : at + PIECE])
        return
    at = 0
    while bytes(content[at : at + 2]) == b"\x1f\x8b":  # what follows the last member is padding
        member = zlib.decompressobj(wbits=31)
        while not member.eof:
            part = content[at : at + PIECE]
            if not len(part):
                raise ValueError("a gzip member is cut short")
            at += len(part)
            while not member.eof:
                if piece := member.decompress(part, PIECE):
                    yield piece
                part = member.unconsumed_tail
                if not part and len(piece) < PIECE:
                    break
        at -= len(member.unused_data)


class Stream:
    """Pieces of bytes, read by length or up to a mark."""

    def __init__(self, data: bytes | Iterator[bytes]):
        self.pieces, self.held, self.at = iter([data] if isinstance(data, bytes) else data), bytearray(), 0

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        self.held += piece or b""
        return piece is not None

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        return bytes(self.held[:n])

    def take(self, n: int) -> bytes:
        """The next n bytes, or fewer at the end."""
        out = self.peek(n)
        del self.held[:n]
        self.at += len(out)
        return out

    def until(self, mark: bytes) -> bytes:
        """What comes before the mark, which is passed over."""
        start = 0
        while (found := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                raise ValueError(f"the record at byte {self.at} is cut short: {mark!r} is not there")
        out = self.take(found)
        self.take(len(mark))
        return out


def parse_arc(data: bytes | Iterator[bytes]) -> Iterator[ArcRecord]:
    """The records of an ARC file. The version block's first number and field line say how later lines are read."""
    source = Stream(data)
    size = int(source.until(b"\n").decode().split(" ")[-1])
    lines = source.take(size).decode("utf-8", "replace").split("\n")
    version = int(lines[0].split(" ")[0])
    if version not in FIELDS:
        raise ValueError(f"ARC version {version} is not known")
    names = FIELDS[version]
    if lines[1].rstrip("\r").split(" ") != names:
        raise ValueError(f"the field line of ARC version {version} is {lines[1]!r}")
    while first := source.peek(1):
        if first in b"\n\r":  # one line end or more between records
            source.take(1)
            continue
        line = source.until(b"\n").decode("utf-8", "replace").rstrip("\r")
        values = line.split(" ")
        if len(values) != len(names):
            raise ValueError(f"an ARC header line has {len(values)} of {len(names)} fields: {line[:200]!r}")
        said = dict(zip(names, values))
        size = int(said["Archive-length"])
        content = source.take(max(size, 0))
        if len(content) != size:
            raise ValueError(f"an ARC record declares {size} bytes beyond the file's end")
        yield ArcRecord(said, content)


def iso(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, payload_digest: str, name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}|{payload_digest}|{url}')}>"


def to_warc(record: ArcRecord, name: str = "", revisits: tuple[str, str, str] | None = None, extra: dict[str, str] | None = None) -> bytes:
    """A WARC record without its closing line ends. revisits: (url, date, name) of the record with the same payload."""
    url, content = record.fields["URL"], record.content
    http = content.startswith(b"HTTP/")
    head, _, payload = content.partition(END) if http else (b"", b"", content)
    digest = sha1(payload)
    block = head + END if revisits and http else b"" if revisits else content
    said = {
        "WARC-Type": "revisit" if revisits else "response" if http else "resource",
        "WARC-Record-ID": record_id(url, digest, name),
        "WARC-Target-URI": url,
        "WARC-Date": iso(record.fields["Archive-date"]),
        "WARC-IP-Address": record.fields["IP-address"],
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{sha1(block)}",
        "Content-Type": "application/http; msgtype=response" if http else record.fields["Content-type"],
    }
    if revisits:
        said |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(revisits[0], digest, revisits[2]), "WARC-Refers-To-Target-URI": revisits[0], "WARC-Refers-To-Date": iso(revisits[1])}
    said |= extra or {}
    said["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in said.items()).encode() + b"\r\n" + block


@dataclass
class WarcRecord:
    """headers: by their names in lower case."""

    headers: dict[str, str]
    block: bytes = field(repr=False)

    @property
    def payload(self) -> bytes:
        return self.block.partition(END)[2] if self.headers.get("content-type", "").lower().startswith("application/http") else self.block


def parse_warc(data: bytes | Iterator[bytes]) -> Iterator[WarcRecord]:
    """The records of a WARC file, by their declared lengths."""
    source = Stream(data)
    while source.peek(1):
        at = source.at
        lines = re.sub(r"\r\n[ \t]+", " ", source.until(END).decode("utf-8", "replace")).split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record begins at byte {at}")
        named = (line.partition(":") for line in lines[1:])
        headers = {name.strip().lower(): value.strip() for name, _, value in named}
        size = int(headers["content-length"])
        block = source.take(size)
        if len(block) != size or source.take(4) != END:
            raise ValueError(f"the WARC record at byte {at} is cut short")
        yield WarcRecord(headers, block)


def _write(records: DataFrame, path: str) -> None:
    """(value binary), each some WARC records without the last one's closing line ends, to a gzip-compressed file each: a
    text line that ends in two line ends."""
    records.select(F.col("value").cast("string")).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def _filled(records: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """WARC records, as many in a row as a file may hold."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([END.join(held)], pa.binary())], names=["value"])

    for record in records:
        if held and (size + len(record) > FILE_BYTES or len(held) == FILE_RECORDS):
            yield out()
            held, size = [], 0
        held.append(record)
        size += len(record)
    if held:
        yield out()


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_arc(spark, path: str) -> DataFrame:
    """Per record of the ARC files under `path` (both versions, plain or gzip): file, url, ip, date, content_type, content."""
    common.small_batches(spark)
    names = ("file", "url", "ip", "date", "content_type", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                for r in parse_arc(pieces(content.as_buffer())):
                    yield pa.RecordBatch.from_pylist([dict(zip(names, (name, *(r.fields[f] for f in FIELDS[1][:4]), r.content)))], schema=schema)

    schema = pa.schema([*((c, pa.string()) for c in names[:-1]), ("content", pa.binary())])
    return _files(spark, path).mapInArrow(run, "file string, url string, ip string, date string, content_type string, content binary")


def convert(spark, arc_path: str, warc_path: str) -> None:
    """The ARC files under arc_path as WARC files; a record's identifier is made from its file, place, URL and payload."""
    common.small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _filled(to_warc(r, f"{name} {k}") for batch in batches for name, content in zip(batch.column("path").to_pylist(), batch.column("content")) for k, r in enumerate(parse_arc(pieces(content.as_buffer()))))

    _write(_files(spark, arc_path).mapInArrow(run, "value binary"), warc_path)


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int = 1) -> None:
    """Pages to ARC, and ARC to gzip-compressed WARC files under `path`. Of equal payloads the page with the largest id
    is the response, the others revisit it. The payloads' digests meet in partial sums, so that a payload that a third of
    all pages hold is one row a task; pages then join their digest's largest id, where only shared digests have one."""
    spark = pages.sparkSession
    common.small_batches(spark)
    rows = pages.select(pages[id_col].alias("id"), F.coalesce(pages[url_col], F.lit("")).alias("url"), F.coalesce(pages[html_col], F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.encode("html", "utf-8"))))
    shared = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("id", "url")).alias("owner")).where("n > 1")
    shared = common.materialise(shared, "shared", packed=True)  # a join of two plain shuffles can be split where a payload is hot
    both = rows.join(shared.select("digest", "owner"), "digest", "left")
    both = both.select("id", "url", "html", F.col("owner.id").alias("owner"), F.col("owner.url").alias("owner_url"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in common.slices(batches, "html"):
            got = batch.to_pylist()
            arc = write_arc([(r["url"], http_message(r["html"].encode())) for r in got], version)
            for r, record in zip(got, parse_arc(arc), strict=True):
                owner = r["owner"] if r["owner"] != r["id"] else None
                extra = {} if r["id"] is None else {"X-Page-Id": str(r["id"])}
                revisits = None if owner is None else (quoted(r["owner_url"]), DATE, str(owner))
                yield to_warc(record, str(r["id"]), revisits, extra)

    _write(both.mapInArrow(lambda batches: _filled(records(batches)), "value binary"), path)


def read_warc(spark, path: str, id_kind: str = "bigint", strict: bool = False) -> DataFrame:
    """Per record of the WARC files under `path`: page_id, payload_bytes, payload_digest, record_type, refers_to, url, date,
    record_id, verified (a declared SHA-1 is the payload's; null for revisits and where none is declared). strict: a payload
    without its digest is an error."""
    common.small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                out = []
                for r in parse_warc(pieces(content.as_buffer())):
                    h, revisit = r.headers, r.headers["warc-type"] == "revisit"
                    own = sha1(r.payload)
                    said = h.get("warc-payload-digest", "" if revisit else f"sha1:{own}").removeprefix("sha1:")
                    good = None if revisit or not h.get("warc-payload-digest", "").startswith("sha1:") else said == own
                    if strict and good is False:
                        raise ValueError(f"the payload of {h['warc-record-id']} does not have its digest")
                    out.append({"page_id": h.get("x-page-id"), "payload_bytes": None if revisit else len(r.payload), "payload_digest": said or None, "record_type": h["warc-type"], "names": h.get("warc-refers-to") if revisit else None, "url": h.get("warc-target-uri"), "date": h["warc-date"], "record_id": h["warc-record-id"], "verified": good})
                    if len(out) == common.BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    text = pa.string()
    schema = pa.schema([("page_id", text), ("payload_bytes", pa.int64()), ("payload_digest", text), ("record_type", text), ("names", text), ("url", text), ("date", text), ("record_id", text), ("verified", pa.bool_())])
    found = _files(spark, path).mapInArrow(run, "page_id string, payload_bytes bigint, payload_digest string, record_type string, names string, url string, date string, record_id string, verified boolean")
    found = common.materialise(found.withColumn("page_id", F.col("page_id").cast(id_kind)), "records")
    revisits, others = found.where("record_type = 'revisit'"), found.where("record_type <> 'revisit'")
    named = others.join(revisits.select(F.col("names").alias("record_id")).distinct(), "record_id", "left_semi").groupBy("record_id").agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("length"))
    # a join of two plain shuffles can be split where a record is hot; records that name none take no part in it
    named = common.materialise(named.withColumnRenamed("record_id", "names"), "named", packed=True)
    order = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "date", "record_id", "verified"]
    pointed = revisits.drop("payload_bytes").join(named.withColumnRenamed("length", "payload_bytes"), "names", "left").select(order)
    return others.withColumn("refers_to", F.lit(None).cast(id_kind)).select(order).unionAll(pointed)
