import json

import pytest
from pyspark.sql import functions as F

from lexivec.operators import rerank, sparse
from lexivec.plans import service
from lexivec.sources import files, store
from lexivec.streaming.ingest import ingest


def chunks(spark, rows):
    full = [(i, t, d, k, 3, 1, 1, None, None, e, {}) for i, t, d, k, e in rows]
    return spark.createDataFrame(full, files.CHUNKS)


def ids(df):
    return sorted((r["chunk_id"], r["text"]) for r in df.collect())


def test_store(spark, tmp_path):
    s = store.ChunkStore(spark, str(tmp_path / "s"), dimensions=2)
    assert s.read().count() == 0
    s.upsert(chunks(spark, [("a", "1", "d", 0, [1.0, 0.0]), ("b", "2", "e", 0, [0.0, 1.0])]))
    s.upsert(chunks(spark, [("a", "new", "d", 0, [1.0, 0.0]), ("c", "3", "d", 1, None)]), require_vector=True)
    assert ids(s.read()) == [("a", "new"), ("b", "2")]
    before = ids(s.read())
    s.upsert(s.read())
    assert ids(s.read()) == before
    with pytest.raises(Exception, match="must have 2 numbers"):
        s.upsert(chunks(spark, [("z", "1", "d", 0, [1.0])]))
    assert ids(s.read()) == before
    s.delete_document("d")
    assert ids(s.read()) == [("b", "2")]
    s.append(chunks(spark, [("b", "2", "e", 0, [0.0, 1.0])]))
    assert s.read().count() == 2
    assert [r["chunk_id"] for r in s.fetch("e", [0]).collect()] == ["b"]
    s.clear()
    assert s.read().count() == 0
    s.vacuum()
    assert len(s.versions()) == 1


def test_no_write_is_lost(spark, tmp_path, monkeypatch):
    """A writer that reads, and another that commits before the first does."""
    a, b = store.ChunkStore(spark, str(tmp_path / "s")), store.ChunkStore(spark, str(tmp_path / "s"))
    a.upsert(chunks(spark, [("x", "1", "d", 0, None)]))
    write, done = a._write, []

    def slow(df, manifest):
        found = write(df, manifest)
        if not done:
            done.append(b.upsert(chunks(spark, [("y", "2", "d", 1, None)])))
        return found

    monkeypatch.setattr(a, "_write", slow)
    a.upsert(chunks(spark, [("z", "3", "d", 2, None)]))
    assert ids(a.read()) == [("x", "1"), ("y", "2"), ("z", "3")] and a.versions() == [1, 2, 3]
    (tmp_path / "s" / "_versions" / f"{4:020d}").touch()  # a writer that died while it committed
    assert ids(a.read()) == [("x", "1"), ("y", "2"), ("z", "3")]
    monkeypatch.setattr(store, "TRIES", 2)
    with pytest.raises(store.Conflict, match="has died"):
        a.clear()


def test_changes_rewrite_the_buckets_they_touch(spark, tmp_path):
    s = store.ChunkStore(spark, str(tmp_path / "s"), buckets=16)
    s.append(chunks(spark, [(f"{d}{k}", "t", d, k, None) for d in "abcdefgh" for k in range(3)]))
    before = s._current()["files"]
    s.upsert(chunks(spark, [("a0", "new", "a", 0, None)]))
    after = s._current()["files"]
    assert len(before) > 3 and sum(before[b] != after[b] for b in before) == 1
    assert dict(ids(s.read()))["a0"] == "new" and s.read().count() == 24
    s.upsert(chunks(spark, [("a1", "moved", "h", 9, None)]))  # the id stood under another document
    assert [(r["source_document"], r["text"]) for r in s.read().where("chunk_id = 'a1'").collect()] == [("h", "moved")]
    s.upsert(chunks(spark, [("b7", "only", "b", 0, None)]), replace_documents=True)
    assert ids(s.document("b")) == [("b7", "only")] and s.read().count() == 22
    s.append(chunks(spark, [("b8", "more", "b", 1, None)]))
    s.compact()
    assert ids(s.document("b")) == [("b7", "only"), ("b8", "more")] and all(len(f) == 1 for f in s._current()["files"].values())
    s.vacuum()
    assert s.read().count() == 23 and len(s.versions()) == 1


def test_stored_counts_score_like_texts(spark, tmp_path):
    rows = [("a", "x x y", "d", 0, None), ("b", "", "d", 1, None), ("c", None, "d", 2, None), ("e", "y z z z", "f", 0, None)]
    s = store.ChunkStore(spark, str(tmp_path / "s"))
    s.append(chunks(spark, rows))
    counts = {r["id"]: sorted(x["tf"] for x in r["sparse"]) for r in s.counts().collect()}
    assert counts == {"a": [1, 2], "b": [], "c": [], "e": [1, 3]}
    asked = spark.createDataFrame([(0, "y x"), (1, "z none")], "query_id int, query string")
    for mode, classic in (("bm25", False), ("bm25", True), ("idf", False)):
        found = [sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in df.collect()) for df in (sparse.counted_scores(s.counts(), asked, mode, classic), sparse.sparse_scores(chunks(spark, rows), "chunk_id", "text", asked, mode, classic))]
        assert found[0] == found[1] and len(found[0]) == 3


def test_payload_round_trip(spark):
    c = chunks(spark, [("a", "t", "d", 1, [1.0, 2.0]), ("b", "u", "d", 2, None)]).withColumn("metadata", F.create_map(F.lit("k"), F.lit("v")))
    points = store.to_payload(c)
    assert points.count() == 1 and json.loads(points.first()["payload"])["chunkId"] == "a"
    back = store.from_payload(points).first()
    assert back["chunk_id"] == "a" and back["chunk_index"] == 1 and back["metadata"] == {"k": "v"} and back["section"] is None
    bare = store.from_payload(spark.createDataFrame([('{"metadata":"{\\"k\\":\\"v\\"}"}', [1.0])], "payload string, vector array<float>")).first()
    assert bare["text"] == "" and bare["chunk_total"] == 0 and bare["metadata"] == {"k": "v"}


def test_json_and_stats(spark, tmp_path):
    files.write_chunks_json(chunks(spark, [("a", "t", "d", 1, [1.0])]), str(tmp_path / "j"))
    assert spark.read.schema(files.CHUNKS).json(str(tmp_path / "j")).count() == 1
    (tmp_path / "one.json").write_text('[{"chunk_id": "x", "text": "t"}]')
    assert files.read_chunks(spark, str(tmp_path / "one.json"), "json").first()["chunk_id"] == "x"
    docs = spark.createDataFrame([(1, "a b")], "id int, text string")
    files.write_stats(sparse.document_frequency(sparse.term_frequency(docs, "id", "text")), sparse.corpus_totals(docs, "text"), str(tmp_path / "st"))
    df, st = files.read_stats(spark, str(tmp_path / "st"))
    assert df.count() == 2 and st.first()["n"] == 1
    for keys in (("total_documents", "total_document_length", "frequencies"), ("TotalDocuments", "TotalDocumentLength", "Frequencies")):
        (tmp_path / "s.json").write_text(json.dumps(dict(zip(keys, (2, 10, {"12": 1, "99": 2})))))
        df, st = files.read_stats_json(spark, str(tmp_path / "s.json"))
        assert {(r["term"], r["df"]) for r in df.collect()} == {(12, 1), (99, 2)} and st.first()["average_length"] == 5.0


def test_parser_plug_in(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"x y")
    got = files.parsed_files(spark, str(tmp_path / "in"), lambda name, data: [{"source_document": name, "text": w} for w in data.decode().split()], "source_document string, text string")
    assert sorted(map(tuple, got.collect())) == [("a.txt", "x"), ("a.txt", "y")]


def test_service(spark, tmp_path):
    s = service.RagService(store.ChunkStore(spark, str(tmp_path / "s")), service.Settings(max_chunk_tokens=8, chunk_overlap_tokens=2))
    rows = [(d, d.upper(), d.upper(), 1, 1, 1, [(1, t)]) for d, t in (("cats", "Cats purr at night. Cats sleep all day long. Nobody minds."), ("dogs", "Dogs bark loudly. Dogs run fast and far away."))]
    sections = spark.createDataFrame(rows, service.chunk_sections.__globals__["SECTION"])
    assert "Indexed" in service.dispatch(s, lambda name: sections, "index_pdf", {"pdf_file_name": "x"})
    for mode in ("hybrid", "dense", "sparse", "hybrid_idf"):
        s.settings = service.Settings(mode=mode)
        best = s.search("dogs bark", 2).orderBy("rank").collect()
        assert best and best[0]["source_document"] == "dogs", mode
    s.scorer = rerank.lexical_scorer
    assert "[Source: dogs" in service.dispatch(s, None, "search_documents", {"query": "dogs bark", "top_k": 1})
    assert service.dispatch(s, None, "delete_document", {"document_name": "dogs"}) == "Deleted dogs."
    assert {r["source_document"] for r in s.search("dogs bark", 3).collect()} == {"cats"}
    assert service.dispatch(s, None, "clear_index", {}) == "The index is empty."
    assert service.dispatch(s, None, "search_documents", {"query": "x"}) == rerank.NO_CONTEXT
    assert service.dispatch(s, lambda n: 1 / 0, "index_pdf", {}).startswith("Failed to index pdf")
    with pytest.raises(ValueError):
        service.dispatch(s, None, "other", {})
    assert {t["function"]["name"] for t in service.tool_schemas()} == set(service.TOOLS)


def test_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    s = store.ChunkStore(spark, str(tmp_path / "s"))
    chunks(spark, [("a", "1", "d", 0, [1.0])]).write.parquet(src)
    stream = lambda: ingest(spark.readStream.schema(files.CHUNKS).parquet(src), s, str(tmp_path / "c")).awaitTermination()
    stream()
    chunks(spark, [("a", "2", "d", 0, [1.0]), ("b", "1", "d", 1, [1.0])]).write.mode("append").parquet(src)
    stream()
    stream()
    assert ids(s.read()) == [("a", "2"), ("b", "1")]
