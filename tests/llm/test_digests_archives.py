import gzip
import hashlib
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from lexivec.llm import archives, digest


def test_compare_edited(docs, rows, empty):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    wanted = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        e = t[: len(t) - third] + after[:third] if third else t
        wanted.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), digest.digest(t), digest.digest(e), float(digest.digest(t) == digest.digest(e)), float(digest.digest(t) == digest.digest(after))))
    got = [tuple(str(v) if c == "doc_id" else v for c, v in r.asDict().items()) for r in digest.compare_edited(docs).collect()]
    assert sorted(got) == sorted(wanted)
    assert digest.compare_edited(empty).count() == 0


def test_one_document_follows_itself(spark):
    one = digest.compare_edited(spark.createDataFrame([(1, "abcdef")], "doc_id int, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0


def test_canonical():
    assert digest.canonical("  ﬁNE\tTea　ß ") == "fine tea ss"
    assert digest.digest("É x") == digest.digest("é  X") != digest.digest("e x")
    h = xxhash.xxh3_128_hexdigest(b"a")
    assert digest.digest("A", frozenset([h])).startswith(h + "-")


def test_groups(docs, rows):
    got = digest.group(docs).collect()
    same = {}
    for i, t in rows:
        same.setdefault(digest.canonical(t or ""), []).append(i)
    assert len(got) == len(rows) and len({r["fingerprint"] for r in got}) == len(same)
    assert sorted(r["n_equal"] for r in got) == sorted(len(v) for v in same.values() for _ in v)


def test_bytes_are_compared(spark, monkeypatch):
    """With a hash that is made to collide, unequal texts still get unequal fingerprints."""
    import lexivec.llm.digest as d

    df = spark.createDataFrame([(1, "a", b"x" * 16, 7), (2, "b", b"x" * 16, 7), (3, "a", b"y" * 16, 8), (4, "a", b"y" * 16, 8)], "id int, whole string, digest binary, low bigint")
    monkeypatch.setattr(d, "_digests", lambda docs, shared=None: df.select("digest", "low", F.encode("whole", "utf-8").alias("whole")))
    assert d.collisions(df) == frozenset([(b"x" * 16).hex()])


PAGES = [(1, "http://a/x y", "<p>é</p>"), (2, None, None), (3, "http://b", "<p>é</p>"), (4, "u", ""), (5, "http://c", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (6, "http://d", "http://e 0.0.0.0 20200101000000 text/html 5\nhello\n"), (None, "http://n", "only"), (None, "http://n", "<p>é</p>"), (7, "x", "é" * 5000), (7, "x", "é" * 5000)]


@pytest.mark.parametrize("version", [1, 2])
def test_archives(spark, tmp_path, version):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "1 AS digest", "2 AS owner", "3 AS n")
    archives.write_pages(df, str(tmp_path / "w"), version=version)
    got = archives.read_warc(spark, str(tmp_path / "w")).collect()
    owner = {}
    for i, _, h in PAGES:
        if i is not None:
            owner[h or ""] = max(owner.get(h or "", i), i)
    wanted = []
    for i, _, h in PAGES:
        p = (h or "").encode()
        to = owner.get(h or "")
        wanted.append((str(i), len(p), archives.sha1(p), "response" if to in (None, i) else "revisit", str(None if to == i else to)))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == sorted(wanted)
    assert len({r["record_id"] for r in got if r["page_id"] not in (7, None)}) == 6 and {r["date"] for r in got} == {"2020-01-01T00:00:00Z"}
    archives.write_pages(df.limit(0), str(tmp_path / "e"), version=version)
    assert archives.read_warc(spark, str(tmp_path / "e")).count() == 0


def test_files_are_warc(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a", "x")], "page_id bigint, url string, html string")
    archives.write_pages(df, str(tmp_path / "w"))
    data = b"".join(zlib.decompress(p.read_bytes(), wbits=47) for p in (tmp_path / "w").glob("part-*.gz"))
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"\r\n\r\nx\r\n\r\n")


def test_arc_lines_and_lengths():
    data = archives.write_arc([("http://a b", b"one\n\n"), ("http://c", b"")], 2, date="199912312359")
    a, b = archives.parse_arc(data)
    assert a.fields["URL"] == "http://a%20b" and a.content == b"one\n\n" and b.content == b"" and a.fields["Result-code"] == "200"
    assert b"WARC-Type: resource" in archives.to_warc(a) and b"1999-12-31T23:59:00Z" in archives.to_warc(a)
    with pytest.raises(ValueError, match="beyond"):
        list(archives.parse_arc(data[:-4] + b" 99\n"))
    with pytest.raises(ValueError, match="not known"):
        list(archives.parse_arc(data.replace(b"2 0 lexivec", b"9 0 lexivec")))
    with pytest.raises(ValueError, match="cut short"):
        list(archives.parse_warc(archives.to_warc(a) + b"\r\n"))


def members(path, parts):
    """One gzip member a part, as archives usually are."""
    path.parent.mkdir(exist_ok=True)
    path.write_bytes(b"".join(gzip.compress(p) for p in parts))


def test_archives_of_others_are_read(spark, tmp_path):
    """Many members, other header cases, records without digests, and a revisit of a record in another file."""
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n\xff\xfe" + b"x" * 3_000_000
    record = lambda kind, n, block, more="": f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: <urn:{n}>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nCONTENT-LENGTH:{len(block)}\r\n{more}\r\n".encode() + block + b"\r\n\r\n"
    http = "Content-Type: application/http;\r\n msgtype=response\r\n"
    members(tmp_path / "w/a.warc.gz", [record("warcinfo", 1, b"software: x\r\n"), record("response", 2, body, http + "X-Page-Id: 9\r\nWARC-Payload-Digest: sha1:WRONG\r\n"), record("metadata", 3, b"")])
    members(tmp_path / "w/b.warc.gz", [record("revisit", 4, b"", "WARC-Refers-To: <urn:2>\r\n"), record("revisit", 5, b"", "WARC-Refers-To: <urn:none>\r\n")])
    (tmp_path / "w/c.warc").write_bytes(record("resource", 6, b"plain", "WARC-Target-URI: u\r\n"))
    got = {r["record_id"]: r for r in archives.read_warc(spark, str(tmp_path / "w")).collect()}
    assert {k: (r["record_type"], r["payload_bytes"], r["refers_to"], r["verified"]) for k, r in got.items()} == {
        "<urn:1>": ("warcinfo", 13, None, None), "<urn:2>": ("response", 3_000_002, None, False), "<urn:3>": ("metadata", 0, None, None),
        "<urn:4>": ("revisit", 3_000_002, 9, None), "<urn:5>": ("revisit", None, None, None), "<urn:6>": ("resource", 5, None, None)}
    assert got["<urn:6>"]["payload_digest"] == archives.sha1(b"plain") and got["<urn:5>"]["payload_digest"] is None
    with pytest.raises(Exception, match="does not have its digest"):
        archives.read_warc(spark, str(tmp_path / "w"), strict=True).collect()


@pytest.mark.parametrize("version", [1, 2])
def test_arc_files_are_converted(spark, tmp_path, monkeypatch, version):
    monkeypatch.setattr(archives, "FILE_BYTES", 1000)
    records = [(f"http://h/{k}", archives.http_message(bytes([k, 255, 13, 10, 13, 10]) * (200 * k), "image/png")) for k in range(5)] + [("dns:h", b"1.2.3.4")]
    data = archives.write_arc(records, version)
    cuts = [0, *(data.index(u.encode()) for u, _ in records), len(data)]
    members(tmp_path / "a/x.arc.gz", [data[i:j] for i, j in zip(cuts, cuts[1:])])
    (tmp_path / "a/y.arc").write_bytes(archives.write_arc([("http://y", b"HTTP/1.0 404 No\r\n\r\n")], 3 - version))
    got = {(r["url"], bytes(r["content"])) for r in archives.read_arc(spark, str(tmp_path / "a")).collect()}
    assert got == {*records, ("http://y", b"HTTP/1.0 404 No\r\n\r\n")}
    archives.convert(spark, str(tmp_path / "a"), str(tmp_path / "w"))
    found = archives.read_warc(spark, str(tmp_path / "w")).collect()
    payloads = {u: c.partition(b"\r\n\r\n")[2] if c.startswith(b"HTTP/") else c for u, c in got}
    assert {r["url"]: (r["payload_bytes"], r["payload_digest"], r["record_type"]) for r in found} == {u: (len(p), archives.sha1(p), "resource" if u == "dns:h" else "response") for u, p in payloads.items()}
    assert len({r["record_id"] for r in found}) == 7 and all(r["verified"] for r in found) and len(list((tmp_path / "w").glob("part-*"))) > 3


@pytest.mark.parametrize("tail", [b"", b"\0\0"])
def test_pieces(tail):
    parts = [bytes([k]) * n for k, n in enumerate((0, 1, 3_000_000, 7, 1_048_576))]
    assert b"".join(archives.pieces(b"".join(gzip.compress(p) for p in parts) + tail)) == b"".join(parts)
    with pytest.raises(ValueError, match="cut short"):
        list(archives.pieces(gzip.compress(parts[2])[:-9]))
