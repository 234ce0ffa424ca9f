import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lexivec.llm import suffix

from .conftest import base_text


def brute(rows, length, keep):
    texts = [(i, (t or "").encode()) for i, t in rows]
    order = sorted(range(len(texts)), key=lambda k: (texts[k][0] is None, texts[k][0] or 0))
    count = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    seen, out = set(), []
    for k in order:
        i, t = texts[k]
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            if count[s] > 1 if keep == "none" else s in seen:
                gone[p : p + length] = True
            seen.add(s)
        left = bytes(b for b, g in zip(t, gone) if not g)
        out.append((str(i), len(t), int(gone.sum()), len(suffix.spans_of(gone)), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def found(df, length, keep):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(df, length=length, keep=keep).collect())


@pytest.mark.parametrize("most", [suffix.MOST, 1])
@pytest.mark.parametrize("length", [400, 50])
def test_none_is_kept(docs, rows, empty, monkeypatch, length, most):
    """Both in suffix order and, where an anchor has too many segments, by hashes."""
    monkeypatch.setattr(suffix, "MOST", most)
    assert found(docs, length, "none") == brute(rows, length, "none")
    assert suffix.remove_repeats(empty, length=length).count() == 0


@pytest.mark.parametrize("most", [suffix.MOST, 1])
def test_the_first_is_kept(spark, rows, monkeypatch, most):
    monkeypatch.setattr(suffix, "MOST", most)
    once = [r for k, r in enumerate(rows) if r[0] is not None and r not in rows[:k]]
    assert found(spark.createDataFrame(once, "doc_id bigint, text string"), 60, "first") == brute(once, 60, "first")


def test_outputs(spark):
    df = spark.createDataFrame([(1, "abc" + "x1y2z3" * 10 + "é"), (2, "x1y2z3" * 10 + "q")], "doc_id int, text string")
    r = suffix.remove_repeats(df, length=20).orderBy("doc_id").collect()
    assert r[0]["kept"] == "abcé".encode() and [(s["start"], s["end"]) for s in r[0]["removed"]] == [(3, 63)] and r[1]["kept"] == b"q"
    with pytest.raises(ValueError):
        suffix.repeated_spans(df, keep="last")


def test_suffix_order_and_factors():
    rng = np.random.default_rng(0)
    for length in (2, 7, 8, 9, 33):
        data = rng.integers(0, 2, 400).astype(np.uint8) * 200
        starts = np.sort(rng.choice(len(data) - length + 1, 150, replace=False))
        order, block = suffix.suffix_blocks(data, starts, length)
        strings = [bytes(data[s : s + length]) for s in starts[order]]
        assert strings == sorted(strings)
        assert [a == b for a, b in zip(strings, strings[1:])] == [a == b for a, b in zip(block, block[1:])]
    position, block = rng.permutation(300), np.sort(rng.integers(0, 12, 300))
    before, after = suffix.nearest_smaller(position, block)
    for k in range(300):
        left = [j for j in range(k) if block[j] == block[k] and position[j] < position[k]]
        right = [j for j in range(k + 1, 300) if block[j] == block[k] and position[j] < position[k]]
        assert before[k] == (left[-1] if left else -1) and after[k] == (right[0] if right else -1)


@pytest.mark.parametrize("most", [suffix.MOST, 1])
@pytest.mark.parametrize("shared", [20, 300, 400])
def test_shared_passages_show_and_stay(spark, docs, rows, monkeypatch, shared, most):
    monkeypatch.setattr(suffix, "MOST", most)
    both = suffix.remove_repeats(docs, length=400, shared=shared).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in both) == brute(rows, 400, "none")
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_shared"]) for r in both) == [(i, n, gone) for i, n, gone, *_ in brute(rows, shared, "none")]


def test_planted_passages(spark):
    """Passages of 51 to 119 words, many too short to be removed, in documents that share nothing else."""
    r = random.Random(8)
    passages = [base_text(r, r.randint(51, 119)) for _ in range(12)]
    texts = {k: base_text(r, r.randint(60, 150)) for k in range(80)}
    planted = {k: passages[k // 2] for k in range(24)}
    rows = [(k, f"{t} {planted[k]} end" if k in planted else t) for k, t in texts.items()]
    got = {x["doc_id"]: x for x in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), length=400, shared=200).collect()}
    assert {k for k, x in got.items() if x["n_shared"]} == set(planted)
    removed = {k for k, x in got.items() if x["n_removed"]}
    assert {str(k) for k in removed} == {i for i, _, gone, *_ in brute(rows, 400, "none") if gone} and 0 < len(removed) < len(planted)
