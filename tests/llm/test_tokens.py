import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lexivec.llm import bpe, bpe_codec, token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "B", " ", "  ", "\n", "'", "'s", "'re", "é", "1", "!", "?!", "the", " the", "ing", "<|endoftext|>", "Σ", "漢", "\t", "̀", "x1", "İ", " ", "ՙ", "\U0003fc3d"]


def samples(n):
    r = random.Random(3)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 12))) for _ in range(n)]


def test_counts_equal_the_library(spark, docs, rows, empty):
    t = Tokenizer.from_file(BYTES)
    got = token_counts.token_counts(docs, BYTES, limit=100).collect()
    wanted = sorted((str(i), len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 100) for i, x in rows)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == wanted
    assert token_counts.token_counts(empty, BYTES, limit=1).count() == 0


def test_every_prefix(spark):
    t = Tokenizer.from_file(BYTES)
    c = token_counts.Counter(BYTES)
    for x in samples(300):
        true = [len(t.encode(x[:p], add_special_tokens=False).ids) for p in range(len(x) + 1)]
        assert c.count(x) == true[-1], x
        assert c.prefix_counts(x) == true, x
        for limit in (0, 2, 5):
            assert c.fitting(x, limit) == max(p for p, n in enumerate(true) if n <= limit), x
    df = spark.createDataFrame([(1, "hello world")], "doc_id int, text string")
    r = token_counts.token_counts(df, BYTES, limit=1, store_prefixes=True).first()
    assert len(r["prefix_tokens"]) == 12 and r["prefix_tokens"][-1] == r["n_tokens"] and r["fit_chars"] == 5


def test_codec_equals_the_library(docs, rows, empty):
    t = Tokenizer.from_file(WORDS)
    got = {(str(r["doc_id"]), r["ids_sha256"], r["decoded_sha256"], r["n_tokens"]) for r in bpe_codec.encode(docs, WORDS, outputs=("ids_sha256", "decoded_sha256")).collect()}
    wanted = set()
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        wanted.add((str(i), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest(), len(ids)))
    assert got == wanted
    assert bpe_codec.encode(empty, WORDS).count() == 0
    c = bpe_codec.WordCodec(WORDS)
    for x in samples(500):
        ids = t.encode(x, add_special_tokens=False).ids
        mine = c.encode_batch([x])[0]
        assert np.frombuffer(mine, "<u4").tolist() == ids, x
        assert c.decode(mine) == t.decode(ids, skip_special_tokens=False)


def test_memories_may_be_forgotten():
    c = bpe_codec.WordCodec(WORDS)
    c.most = 3
    texts = samples(200)
    fresh = bpe_codec.WordCodec(WORDS).encode_batch(texts)
    assert [c.encode_batch([x])[0] for x in texts] == fresh
    m = bpe.Memory(len, most=2)
    for k in range(10):
        assert m["x" * k] == k
        m.turn()
    assert len(m) + len(m.old) <= 6


def test_a_word_is_learnt_once_whatever_stands_beside_it():
    c = bpe_codec.WordCodec(WORDS)
    learnt = []
    walk = c.states.encode_all
    c.states = type("States", (), {"encode_all": staticmethod(lambda words: learnt.extend(words) or walk(words))})
    for x in ("Word, word. (word)\nword!", "word\tword; WORD, a"):
        c.encode_batch([x])
    assert set(c.words) == {"word", ",", ".", "(", ")", "!", ";", "a"} and len(learnt) == len(c.words)
    for x in [chr(k) for k in range(0x530)]:
        for t in (x, f"a{x}b1{x}?{x}'s", f"'{x}{x}"):
            assert c.find_near(t) == c.find.findall(t), t


def test_pairs_are_judged_as_merging_does():
    states, vocab, _ = bpe.load(BYTES)
    r = random.Random(5)
    ids = list(vocab.values())
    for _ in range(3000):
        a, b = r.choice(ids), r.choice(ids)
        if states.spines(a)[2]:
            x, y = states.token[a], states.token[b]
            assert states.judge(a, b) == (states.spines(b)[2] and states.merge(x + y) == [x, y])
    assert states.ordered
