import random
import zlib

import numpy as np

from lexivec.llm import toxicity

from .conftest import base_text


def test_forward_backward_is_exact():
    r = np.random.default_rng(0)
    e, first, steps = r.normal(size=700) * 3, r.random(700) < 0.03, r.normal(size=(2, 2))
    first[0] = True
    p, _, _ = toxicity.forward_backward(e, first, steps)
    edges = [*np.flatnonzero(first), 700]
    for a, b in zip(edges, edges[1:]):
        w = np.stack([np.ones(b - a), np.exp(e[a:b])], axis=1)
        t = np.exp(steps)
        alpha, beta = [w[0]], [np.ones(2)]
        for k in range(1, b - a):
            v = alpha[-1] @ t * w[k]
            alpha.append(v / v.sum())
        for k in range(b - a - 1, 0, -1):
            v = t @ (w[k] * beta[-1])
            beta.append(v / v.sum())
        both = np.array(alpha) * np.array(beta[::-1])
        assert np.allclose(p[a:b], both[:, 1] / both.sum(axis=1), atol=1e-9)
    assert len(toxicity.scan(*[np.empty(0)] * 4)) == 0


def corpus(n=500):
    r = random.Random(8)
    bad = ["grumble", "snarlish", "zorkmid"]
    rows, labels = [], []
    for k in range(n):
        words = base_text(r, 60).split(" ")
        toxic = int(r.random() < 0.25)
        for _ in range(3 * toxic):
            words[r.randrange(60)] = r.choice(bad + ["vexo" + base_text(r, 1)]) + r.choice(["", ",", "###"])
        rows.append((k, " ".join(words)))
        labels.append((k, toxic))
    return rows, labels


def test_learns_and_holds_out(spark, docs, rows, empty):
    texts, labels = corpus()
    d, y = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(labels + [(3, None)], "doc_id bigint, toxic int")
    field = toxicity.learn(d, y)
    got = {r["doc_id"]: r for r in toxicity.score(d, field).collect()}
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    right = sum(got[k]["predicted"] == dict(labels)[k] for k in held)
    assert right >= 0.97 * len(held)
    flips = spark.createDataFrame([(k, 1 - t if zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, t in labels], "doc_id bigint, toxic int")
    assert {r["doc_id"]: r["score"] for r in toxicity.score(d, toxicity.learn(d, flips)).collect()} == {k: r["score"] for k, r in got.items()}
    hit = next(k for k, t in labels if t and got[k]["n_toxic"] and "grumble" in dict(texts)[k])
    spans = [dict(texts)[hit][s["start"] : s["end"]] for s in got[hit]["spans"]]
    assert any("grumble" in s for s in spans)
    hard = toxicity.score(docs, field).collect()
    assert len(hard) == len(rows) and all(0 <= r["score"] <= 1 for r in hard) and toxicity.score(empty, field).count() == 0
    kept = toxicity.keep_clean(docs, field)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in hard)


def test_nothing_to_learn(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.learn(docs, none)).collect()} == {0}
    one = spark.createDataFrame([(6, 0), (7, 0)], "doc_id bigint, toxic int")
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.learn(docs, one)).collect()} == {0}
