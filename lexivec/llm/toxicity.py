"""Operator 2, toxicity by a linear-chain conditional random field.

The field tags each word as toxic or not from its form (the word, its first four and five and its last four letters, hashed)
and its neighbours' tags. It is trained on labelled tokens: documents are labelled as wholes, so a word of a toxic document
counts as a toxic token if one of its forms occurs in toxic documents far more often than chance and the prior allow
(a likelihood-ratio test over all forms, and nine times in ten). Forward-backward gives each word's marginal; a document's
score is a logistic function of the sum and the maximum of its marginals, fitted on training documents that the field was not
trained on. Words with a marginal of 0.5 or more are offending spans, as code point offsets.

Training reads at most `most_docs` labelled documents of either label and `most_bytes` of their text, drawn by a hash of
the id; of near copies only one. Every text is scored whole. The score depends on the text alone.

Edge cases: null and empty texts have no words and the score of sums of 0; null or missing labels are no label, and of
labels that disagree 1 wins; with no document of either label to learn from, the field has no weights and the score is the
prior; rows that repeat get equal rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm import bpe, common

BITS = 18
MOST_DOCS = 3000
MOST_BYTES = 6 << 20
EDGES = ".,;:!?*$%&#|\"'()[]{}<>-_=+/\\~^`@«»„“”‘’…¡¿"


def bare(word: str) -> str:
    return word.lower().strip(EDGES)


def forms(word: str) -> tuple[str, ...]:
    return "w" + word, "4" + word[:4], "5" + word[:5], "e" + word[-4:]


def slots(word: str) -> list[int]:
    return [zlib.crc32(f.encode()) >> (32 - BITS) for f in forms(word)]


def scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """x[t] = (a x[t-1] + b) / (c x[t-1] + d) for all t, from x[-1] = 1: maps are composed in lanes side by side, then the
    lanes are chained, then all lanes run from their known starts."""
    n = len(a)
    if not n:
        return np.empty(0)
    length = max(1, math.isqrt(n))
    lanes = -(-n // length)
    fill = lanes * length - n
    a, b, c, d = (np.ascontiguousarray(np.concatenate([v, np.full(fill, e)]).reshape(lanes, length).T) for v, e in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0)))
    p, q, r, s = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    for t in range(length):
        p, q, r, s = a[t] * p + b[t] * r, a[t] * q + b[t] * s, c[t] * p + d[t] * r, c[t] * q + d[t] * s
        size = p + q + r + s
        p, q, r, s = p / size, q / size, r / size, s / size
    x, start = 1.0, np.empty(lanes)
    for k, (i, j, u, v) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist())):
        start[k] = x
        x = (i * x + j) / (u * x + v)
    out, now = np.empty((length, lanes)), start
    for t in range(length):
        now = (a[t] * now + b[t]) / (c[t] * now + d[t])
        out[t] = now
    return out.T.ravel()[:n]


def forward_backward(e: np.ndarray, first: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences end to end (first: is a token the first of its sequence?), with log weights e of tag 1 against 0 and
    log transition weights steps[from, to]: the marginal of tag 1, and for the transitions the forward ratio and the next
    token's weight with its backward ratio."""
    t = np.exp(steps)
    w = np.exp(np.clip(e, -30, 30))
    zero, one = np.zeros_like(w), np.ones_like(w)
    alpha = scan(np.where(first, zero, t[1, 1] * w), np.where(first, w, t[0, 1] * w), np.where(first, zero, t[1, 0]), np.where(first, one, t[0, 0]))
    # backwards: of a sequence's last token 1, else from the next token
    last = np.concatenate([first[1:], [True]]) if len(first) else first
    after = np.concatenate([w[1:], [1.0]]) if len(w) else w
    back = scan(*(v[::-1] for v in (np.where(last, zero, t[1, 1] * after), np.where(last, one, t[1, 0]), np.where(last, zero, t[0, 1] * after), np.where(last, one, t[0, 0]))))[::-1]
    both = alpha * back
    return both / (1 + both), alpha, after * np.concatenate([back[1:], [1.0]]) if len(back) else after


@dataclass
class Field:
    weights: np.ndarray
    bias: float
    steps: np.ndarray
    score: tuple[float, float, float]

    def word(self, word: str) -> float:
        return self.bias + float(self.weights[slots(word)].sum()) if (word := bare(word)) else self.bias

    def marginals(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        return forward_backward(e, first, self.steps)[0]

    def scores(self, total: np.ndarray, most: np.ndarray) -> np.ndarray:
        a, b, c = self.score
        return 1 / (1 + np.exp(-np.clip(a + b * np.log1p(total) + c * most, -30, 30)))


def firsts(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(int(counts.sum()), bool)
    out[(np.cumsum(counts) - counts)[counts > 0]] = True
    return out


def summed(p: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per sequence the sum and the maximum."""
    total, most = np.zeros(len(counts)), np.zeros(len(counts))
    full = counts > 0
    at = (np.cumsum(counts) - counts)[full]
    if len(at):
        total[full], most[full] = np.add.reduceat(p, at), np.maximum.reduceat(p, at)
    return total, most


def telling_forms(form_ids: np.ndarray, docs: list[np.ndarray], toxic: list[int], false: float = 0.05) -> np.ndarray:
    """Which forms mark toxic documents: a likelihood-ratio test of each form that three documents have, of which at most
    the share `false` of what is found is chance (Benjamini and Hochberg's step-up rule). form_ids: four of each word."""
    n_forms = int(form_ids.max(initial=-1)) + 1
    counts = np.zeros((2, n_forms), np.int64)
    for words, y in zip(docs, toxic):
        counts[y, np.unique(form_ids[np.unique(words)])] += 1
    rate = toxic.count(1) / max(1, len(toxic))
    a, b = counts[1].astype(float), counts[0].astype(float)
    seen = a + b
    telling = np.zeros(n_forms, bool)
    tried = int((seen >= 3).sum())
    maybe = np.flatnonzero((seen >= 3) & (a >= 0.9 * seen) & (a > rate * seen))
    if not len(maybe):
        return telling
    a, b, seen = a[maybe], b[maybe], seen[maybe]
    half = a * np.log(a / (rate * seen)) + np.where(b > 0, b * np.log(np.maximum(b, 1) / ((1 - rate) * seen)), 0)
    chance = np.exp(-half)  # bounds the chance of so many of `seen` in toxic documents
    order = np.argsort(chance, kind="stable")
    passed = np.flatnonzero(chance[order] <= false * np.arange(1, len(order) + 1) / tried)
    if len(passed):
        telling[maybe[order[: passed[-1] + 1]]] = True
    return telling


def train(texts: Iterator[str] | list[str], toxic: list[int], prior: float, rounds: int = 60) -> Field:
    base = math.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    types: dict[str, int] = {}
    seen: set[int] = set()
    ids: list[np.ndarray] = []
    labels: list[int] = []
    for text, y in zip(texts, toxic):
        words = [w for x in text.split() if (w := bare(x))]
        # of near copies, which share their least hash of five words in a row, the first
        least = min((zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))), default=0)
        if least not in seen:
            seen.add(least)
            ids.append(np.fromiter((types.setdefault(w, len(types)) for w in words), np.int32, len(words)))
            labels.append(y)
    toxic = labels
    nothing = Field(np.zeros(1 << BITS, np.float32), -6.0, np.zeros((2, 2)), (base, 0.0, 0.0))
    if not 0 < sum(toxic) < len(toxic):
        return nothing
    slot = np.array([slots(w) for w in types], np.int32).reshape(-1, 4)
    named: dict[str, int] = {}
    form_ids = np.array([named.setdefault(f, len(named)) for w in types for f in forms(w)], np.int32).reshape(-1, 4)
    del named, types

    def fit(chosen: list[int]) -> tuple[np.ndarray, float, np.ndarray]:
        telling = telling_forms(form_ids, [ids[k] for k in chosen], [toxic[k] for k in chosen])
        told = telling[form_ids].any(axis=1)
        flow = np.concatenate([ids[k] for k in chosen])
        counts = np.array([len(ids[k]) for k in chosen])
        first = firsts(counts)
        y = (told[flow] & np.repeat([toxic[k] == 1 for k in chosen], counts)).astype(float)
        return _fit_field(flow, first, y, slot, rounds)

    # the score is fitted on the fourth part of the documents by a field that has not seen them; the field itself on all
    rest = [k for k in range(len(ids)) if k % 4 == 0]
    weights, bias, steps = fit([k for k in range(len(ids)) if k % 4] or rest)
    rest = rest if 0 < sum(toxic[k] for k in rest) < len(rest) else list(range(len(ids)))
    counts = np.array([len(ids[k]) for k in rest])
    flow = np.concatenate([ids[k] for k in rest])
    p = forward_backward((bias + weights[slot].sum(axis=1))[flow], firsts(counts), steps)[0]
    beta = _fit_score(*summed(p, counts), np.array([toxic[k] for k in rest], float), prior, base)
    weights, bias, steps = fit(list(range(len(ids))))
    return Field(weights.astype(np.float32), float(bias), steps, beta)


def _fit_field(flow: np.ndarray, first: np.ndarray, y: np.ndarray, slot: np.ndarray, rounds: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Maximum likelihood of the tags y by the gradient that forward-backward gives, with Adam's steps."""
    types = len(slot)
    pair = ~first[1:]
    seen_steps = np.array([[((1 - y[:-1]) * (1 - y[1:]))[pair].sum(), ((1 - y[:-1]) * y[1:])[pair].sum()], [(y[:-1] * (1 - y[1:]))[pair].sum(), (y[:-1] * y[1:])[pair].sum()]])
    weights, bias, steps = np.zeros(1 << BITS), -3.0, np.zeros((2, 2))
    moments = [[np.zeros_like(weights), np.zeros_like(weights)], [0.0, 0.0], [np.zeros((2, 2)), np.zeros((2, 2))]]
    scale = 1 / max(1.0, y.sum())
    for k in range(1, rounds + 1):
        e = bias + weights[slot].sum(axis=1)
        p, alpha, ahead = forward_backward(e[flow], first, steps)
        t = np.exp(steps)
        joint = np.stack([np.full(max(0, len(alpha) - 1), t[0, 0]), t[0, 1] * ahead[:-1], t[1, 0] * alpha[:-1], t[1, 1] * alpha[:-1] * ahead[:-1]])[:, pair]
        joint = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
        off = np.bincount(flow, y - p, types)
        grads = [np.bincount(slot.ravel(), np.repeat(off, 4), 1 << BITS) * scale - 1e-4 * weights, off.sum() * scale, (seen_steps - joint) * scale - 1e-2 * steps]
        values = [weights, bias, steps]
        for i, g in enumerate(grads):
            moments[i][0] = 0.9 * moments[i][0] + 0.1 * g
            moments[i][1] = 0.99 * moments[i][1] + 0.01 * g * g
            values[i] = values[i] + 0.2 * (moments[i][0] / (1 - 0.9**k)) / (np.sqrt(moments[i][1] / (1 - 0.99**k)) + 1e-8)
        weights, bias, steps = values
    return weights, bias, steps


def _fit_score(total: np.ndarray, most: np.ndarray, target: np.ndarray, prior: float, base: float) -> tuple[float, float, float]:
    """A ridge-regularised logistic fit by Newton steps. Both labels were drawn apart: they weigh as the prior says."""
    weight = np.where(target == 1, prior / max(target.mean(), 1e-9), (1 - prior) / max(1 - target.mean(), 1e-9))
    x = np.stack([np.ones(len(total)), np.log1p(total), most], axis=1)
    beta = np.array([base, 0.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (target - q)) - 0.02 * beta
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.02 * np.eye(3)
        step = np.linalg.solve(hess, grad)
        beta = beta + step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
    return tuple(beta.tolist())


def learn(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_docs: int = MOST_DOCS, most_bytes: int = MOST_BYTES) -> Field:
    """Train on labelled rows whose crc32 of the id as text is not a multiple of 5."""
    spark = documents.sparkSession
    known = labels.where(labels[label_col].isin(0, 1)).groupBy(labels[id_col].alias("id")).agg(F.max(labels[label_col]).alias("y"))
    known = known.where(~held_out(F.col("id")))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    drawn: list = []
    for y in (0, 1):
        drawn += known.where(F.col("y") == y).select("id", "y").orderBy(F.xxhash64("id"), "id").limit(most_docs).collect()
    if not drawn:
        return train([], [], 0.0)
    sample = spark.createDataFrame(drawn, known.select("id", "y").schema)  # at most 2 * most_docs ids
    docs = common.texts_of(documents, id_col, text_col).join(F.broadcast(sample), "id")
    docs = docs.select("id", "y", "text", F.octet_length("text").alias("size"))
    budget, taken = most_bytes, []
    for r in sorted(docs.select("id", "size").collect(), key=lambda r: zlib.crc32(str(r["id"]).encode())):
        if r["size"] <= budget:
            budget -= r["size"]
            taken.append(r["id"])
    taken_rows = spark.createDataFrame([(i,) for i in taken], sample.select("id").schema) if taken else sample.select("id").limit(0)
    rows = docs.join(F.broadcast(taken_rows), "id").select("id", "text", "y").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["text"]))
    return train([r["text"] for r in rows], [r["y"] for r in rows], sizes.get(1, 0) / max(1, sum(sizes.values())))


def held_out(column):
    return F.crc32(column.cast("string").cast("binary")) % 5 == 0


def score(documents: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = True) -> DataFrame:
    """Per row: id, score, predicted (1 if score >= 0.5), n_toxic (words tagged) and spans (array<struct<start, end>>)."""
    spark = documents.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(field)
    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = bpe.Memory(model.word, 100_000)
        for batch in common.slices(batches):
            texts = batch.column("text").to_pylist()
            split = [t.split() for t in texts]
            counts = np.array([len(w) for w in split])
            e = np.fromiter((x for w in split for x in map(known.__getitem__, w)), np.float64, int(counts.sum()))
            p = model.marginals(e, firsts(counts))
            total, most = summed(p, counts)
            scores = model.scores(total, most)
            tagged = p >= 0.5
            n_toxic, _ = summed(tagged.astype(np.int64), counts)
            columns = [batch.column("id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(n_toxic.astype(np.int64))]
            if with_spans:
                spans, at = [], np.cumsum(counts) - counts
                for k, text in enumerate(texts):
                    spans.append(offsets(text, split[k], tagged[at[k] : at[k] + counts[k]]) if n_toxic[k] else [])
                columns.append(pa.array(spans, pa.list_(pair)))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "score", "predicted", "n_toxic", "spans"][: len(columns)])
            known.turn()

    docs = common.texts_of(documents, id_col, text_col)
    schema = f"id {docs.schema['id'].dataType.simpleString()}, score double, predicted int, n_toxic bigint" + ", spans array<struct<start: bigint, end: bigint>>" * with_spans
    return docs.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def keep_clean(documents: DataFrame, field: Field, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """All columns of the rows whose score is under `least`. Maps, never shuffles."""
    common.small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = bpe.Memory(model.word, 100_000)
        for batch in common.slices(batches, text_col):
            split = [(t or "").split() for t in batch.column(text_col).to_pylist()]
            counts = np.array([len(w) for w in split])
            e = np.fromiter((x for w in split for x in map(known.__getitem__, w)), np.float64, int(counts.sum()))
            scores = model.scores(*summed(model.marginals(e, firsts(counts)), counts))
            yield batch.filter(pa.array(scores < least))
            known.turn()

    return documents.mapInArrow(run, documents.schema)


def offsets(text: str, words: list[str], tagged: np.ndarray) -> list[dict]:
    """Where tagged words stand; words in a row are one span."""
    out, at = [], 0
    before = False
    for word, hit in zip(words, tagged.tolist()):
        at = text.index(word, at)
        if hit:
            if before:
                out[-1]["end"] = at + len(word)
            else:
                out.append({"start": at, "end": at + len(word)})
        before, at = hit, at + len(word)
    return out
