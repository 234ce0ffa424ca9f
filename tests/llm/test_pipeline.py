"""The pipeline on a small corpus with planted cases, each stage against brute force on its own input."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lexivec.llm import line_dedup

from .conftest import base_text, edited
from .test_decontamination import words
from .test_near_copies import brute, brute_lines
from .test_toxicity import corpus

PLANTED = {"toxic": 5001, "exact": (5002, 5003), "near": (5004, 5005), "leak": 5006, "line": (5007, 5008)}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(21)
    texts, labels = corpus(400)
    a, n, item, line = base_text(r, 80), base_text(r, 200), base_text(r, 20), base_text(r, 15)
    texts += [(5001, "grumble " + base_text(r, 40) + " snarlish zorkmid, grumble"), (5002, a), (5003, a), (5004, n), (5005, edited(r, n, 3)), (5006, base_text(r, 30) + " " + item + " " + base_text(r, 30)), (5007, line + "\n" + base_text(r, 30)), (5008, base_text(r, 30) + "\n" + line)]
    texts += [(5100, None), (5101, ""), (None, base_text(r, 30))]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "cast(length(text) AS bigint) AS n_chars", "1 AS id", "2 AS key")
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ids(rows):
    return sorted(str(r[0]) for r in rows)


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = pairs(docs)
        out = stage(spark, docs, tables)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = before
        if name == "bpe":
            break
        assert docs.columns == columns
        after = pairs(docs)
        if name == "toxicity":
            gone = {i for i, _ in before} - {i for i, _ in after}
            assert PLANTED["toxic"] in gone and all(any(w in t for w in ("grumble", "snarlish", "zorkmid", "vexo")) for i, t in before if i in gone)
        elif name == "line_dedup":
            lines, _ = brute_lines(before, 0.9, 10)
            wanted = []
            for i, t in before:
                left = t if not lines[(t, i)] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lines[(t, i)])
                if not lines[(t, i)] or left.strip():
                    wanted.append((i, left))
            assert sorted(map(str, after)) == sorted(map(str, wanted))
            assert {5002, 5007, 5008} <= {i for i, _ in after} and 5003 not in {i for i, _ in after}
        elif name == "near_dedup":
            groups = brute(before, 80)
            assert ids(after) == ids(r for r in before if r[0] is None or groups[r[0]] == r[0])
            assert 5005 not in {i for i, _ in after}
        else:
            item = words(spark.read.parquet(f"{tables}/benchmark.parquet").first()["text"])
            windows = {tuple(item[k : k + 8]) for k in range(len(item) - 7)}
            clean = [r for r in before if not windows & {tuple(words(r[1])[k : k + 8]) for k in range(len(words(r[1])) - 7)}]
            assert ids(after) == ids(clean) and 5006 not in {i for i, _ in after}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {str(r["doc_id"]): list(r["ids"]) for r in docs.collect()} == {str(i): t.encode(x or "", add_special_tokens=False).ids for i, x in seen["bpe"]}
    whole = corpus_pipeline.run(spark, tables)
    assert ids(whole.select("doc_id").collect()) == ids(seen["bpe"])


def test_lines_keep_what_is_not_repeated():
    assert line_dedup.similar("abcdefghij", "abcdefghiX", 0.9) and not line_dedup.similar("abcdefghij", "abcdefghXY", 0.9)


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_sql_of_own_operators(spark):
    from lexivec.llm import queries

    from ..test_oracles import duck, shown

    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        columns, rows = duck("/root/testdata/sf0.001", sql)
        assert sorted(got.columns) == sorted(columns)
        mine = sorted(str([shown(r[c]) for c in sorted(columns)]) for r in got.collect())
        assert mine == sorted(str([shown(r[columns.index(c)]) for c in sorted(columns)]) for r in rows), name
