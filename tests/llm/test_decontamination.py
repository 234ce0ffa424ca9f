import hashlib
import re

import pytest

from lexivec.llm import winnowing

from .test_near_copies import LOW

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(LOW))


def brute(rows, items):
    windows = set()
    for name, t in items:
        w = words(t)
        m = min(8, len(w))
        windows |= {(str(name) if name is not None else "", tuple(w[k : k + m])) for k in range(len(w) - m + 1)} if w else set()
    out = []
    for i, t in rows:
        w = words(t)
        hit, found = set(), set()
        for name, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found.add(name)
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out)


def items(rows):
    a = next(t for i, t in rows if i == 11)
    w = words(a)
    return [(1, " ".join(w[3:30])), (2, " ".join(w[100:108]).upper()), (3, "two words"), (4, "One!"), (5, ""), (6, None), (7, "漢字 漢字"), (7, " ".join(w[200:230])), (None, " ".join(w[40:60])), (8, "ha " * 9), (9, " ".join(w[60:64] + ["zzz"] + w[65:72]))]


@pytest.mark.parametrize("limit", [winnowing.INDEX_BYTES, -1])
def test_decontaminate(spark, docs, rows, empty, limit):
    tests = items(rows)
    bench = spark.createDataFrame(tests, "item_id bigint, text string").selectExpr("*", "0 AS name", "1 AS id")
    got = winnowing.decontaminate(docs, bench, index_bytes=limit).collect()
    mine = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got)
    assert mine == brute(rows, tests)
    assert winnowing.decontaminate(empty, bench, index_bytes=limit).count() == 0
    assert winnowing.decontaminate(docs, bench.limit(0), index_bytes=limit).where("n_hit > 0").count() == 0
    clean = winnowing.keep_clean(docs, bench, least_items=2, index_bytes=limit)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not r[-1] for r in mine)
