import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexivec.llm import line_dedup, linking, minhash

from .conftest import base_text, edited

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def groups(pairs, names):
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in names}


def brute(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    pairs = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[k + 1 :] if a and b and 100 * len(a & b) >= percent * len(a | b)]
    return groups(pairs, {i for i, _ in sets})


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, rows, empty, percent):
    wanted = brute(rows, percent)
    got = minhash.near_duplicates(docs, percent=percent).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(set)
    for i, t in rows:
        sizes[i].add(len(shingles(t)))
    for r in got:
        assert r["n_shingles"] in sizes[r["doc_id"]]
        assert r["component_id"] == (None if r["doc_id"] is None else wanted[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
    assert minhash.near_duplicates(empty).count() == 0


def loose(n=150):
    """A group whose members are all near one another, but only partly linked."""
    r = random.Random(11)
    a = base_text(r, 120)
    return [(k, edited(r, a, r.randint(1, 5))) for k in range(n)]


@pytest.mark.parametrize("limit", [linking.BUCKET_BYTES, 100_000])
def test_loose_group(spark, monkeypatch, limit):
    """Both where rows of an open bucket meet in a task, and in tiles of two blocks."""
    monkeypatch.setattr(linking, "BUCKET_BYTES", limit)
    rows = loose()
    wanted = brute(rows, 85)
    assert len(set(wanted.values())) > 3
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=85)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == wanted


def test_pruning_keeps_pairs_at_the_threshold():
    fewest = minhash.least_agreements(0.85)
    assert len(fewest) == minhash.HASHES // minhash.BATCH and fewest == sorted(fewest)
    r = np.random.default_rng(1)
    agree = r.random((20000, minhash.HASHES)) < 0.85
    seen = np.cumsum(agree, axis=1)[:, minhash.BATCH - 1 :: minhash.BATCH]
    assert (seen >= np.array(fewest)).all()
    unlike = np.cumsum(r.random((2000, minhash.HASHES)) < 0.3, axis=1)[:, minhash.BATCH - 1 :: minhash.BATCH]
    assert not (unlike >= np.array(fewest)).all(axis=1).any()


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(220)] + [(k, k + 1) for k in range(500, 600)] + [(700, k) for k in range(701, 760)]
    got = {x["id"]: x["component"] for x in linking.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    wanted = groups([p for p in pairs if p[0] != p[1]], {x for p in pairs for x in p})
    assert got == {x: c for x, c in wanted.items() if any(x in p and p[0] != p[1] for p in pairs)}


def test_a_set_of_rows_goes_on_once(spark, monkeypatch):
    sets = [(1, 2, 3), (1, 2, 4), (5, 6), (7, 8, 9, 10)]
    rows = [(100 * k + copy, i) for k, ids in enumerate(sets) for copy in range(6) for i in ids] + [(999, 11)]
    written = {}
    write = linking.common.materialise
    monkeypatch.setattr(linking.common, "materialise", lambda df, name, packed=False: written.setdefault(name, write(df, name, packed)))

    def prepare(ids):
        known = {r["id"] for r in ids.collect()}
        assert known == set(range(1, 11))
        return lambda pairs: pairs.where("b <> 10"), lambda placed: placed.select(F.col("id").alias("a"), F.lit(7).cast("bigint").alias("b")).where("a = 10"), ids.select("id", F.lit(1).alias("bytes"))

    monkeypatch.setattr(linking, "components", lambda edges, f=linking.components: (written.pop("edges", None), f(edges))[1])
    got = {(r["id"], r["component"]) for r in linking.link(spark.createDataFrame(rows, "key bigint, id bigint"), prepare).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5), (7, 7), (8, 7), (9, 7), (10, 7)}
    assert written["shared"].count() == sum(map(len, sets))


def test_a_bucket_of_unlinked_rows_is_resolved_in_tiles(spark, monkeypatch):
    """10,000 rows under one key, of which two far apart and a few neighbours are linked."""
    monkeypatch.setattr(linking, "BUCKET_BYTES", 400_000)
    n, links = 10_000, {(17, 9_000), (40, 41), (41, 9_999)}
    meetings = []

    def prepare(ids):
        def solve(rows):
            own = rows.column("id").to_numpy()
            at = {int(x): k for k, x in enumerate(own)}
            pairs = linking.join_components(rows.column("c").to_numpy(), lambda i, others: np.array([at[b] for a, b in links | {(b, a) for a, b in links} if a == own[i] and b in at], np.int64))
            return pa.RecordBatch.from_arrays([pa.array(own[[p[k] for p in pairs]], pa.int64()) for k in (0, 1)], names=["a", "b"])

        def resolve(placed):
            meetings.append([r["n"] for r in placed.groupBy("key").agg(F.count("*").alias("n")).collect()])
            return placed.repartition(4, "key").sortWithinPartitions("key").mapInArrow(linking.by_key(solve), "a bigint, b bigint")

        return lambda pairs: pairs.where("a < 0"), resolve, ids.select("id", F.lit(100).alias("bytes"))

    found = linking.link(spark.range(n).select(F.lit(1).cast("bigint").alias("key"), "id"), prepare)
    assert {r["id"]: r["component"] for r in found.collect()} == {17: 17, 9_000: 17, 40: 40, 41: 40, 9_999: 40}
    assert len(meetings) == 1 and max(meetings[0]) < 5_000


def brute_lines(rows, similarity, least):
    where = defaultdict(list)
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if len(w := line_dedup.normalised(line)) >= least:
                where[w].append(((i is None, i or 0, t), n, i))
    lines = list(where)
    sims = line_dedup.simhashes(lines)
    pairs = [(x, y) for x in range(len(lines)) for y in range(x + 1, len(lines)) if int(sims[x] ^ sims[y]).bit_count() <= 3 and line_dedup.similar(lines[x], lines[y], similarity)]
    root = groups(pairs, range(len(lines)))
    found = defaultdict(set)
    for k, w in enumerate(lines):
        found[root[k]].update((p, n) for p, n, _ in where[w])
    gone = defaultdict(set)
    for g in found.values():
        ids = sorted(g, key=lambda x: (x[0][0], x[0][1], x[1]))
        for (_, i, t), n in ids[1:]:
            gone[(t, i)].add(n)
    return gone, len(pairs)


def line_rows():
    r = random.Random(4)
    lines = [base_text(r, 40) for _ in range(20)]
    rows = [(k, "\n".join(r.choice(lines) if r.random() < 0.5 else edited(r, r.choice(lines), 1) for _ in range(4))) for k in range(60)]
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, lines[0].upper() + " \n" + lines[0]), (104, " | ".join("abcdefghij")), (105, " | ".join("klmnopqrst"))]


def test_fuzzy_lines(spark):
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS key", "2 AS sim", "3 AS line", "4 AS version")
    gone, links = brute_lines(rows, 0.9, 10)
    assert links > 20
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert {i: set(r["removed"]) for i, r in got.items()} == {i: gone[(t, i)] for i, t in rows}
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_text(df).collect()}
    for i, t in rows:
        assert kept[i] == (t if not gone[(t, i)] else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[(t, i)]))
    left = line_dedup.dedup_documents(df.selectExpr("*", "length(text) AS n_chars"))
    assert left.columns == [*df.columns, "n_chars"] and left.where("n_chars <> length(text)").count() == 0


def near_line_rows():
    """Lines of many lengths, each with copies a letter, a word or the most edits away that 0.9 allows."""
    r = random.Random(9)
    out = []
    for n in (10, 13, 19, 20, 27, 35, 44, 45, 60, 100, 200, 400):
        for _ in range(4):
            line = base_text(r, n)[:n].strip().ljust(n, "q")
            at = r.randrange(n)
            out += [line, line[:at] + "z" + line[at + 1 :], line[:at] + line[at + 1 :], edited(r, line, 1)]
            w = list(line)
            for k in r.sample(range(n), n // 10):
                w[k] = "z"
            out.append("".join(w))
    return [(k, line) for k, line in enumerate(out)]


def brute_edits(rows, similarity=0.9, least=10):
    lines = sorted({w for _, t in rows if len(w := line_dedup.normalised(t)) >= least})
    root = groups([(x, y) for k, x in enumerate(lines) for y in lines[k + 1 :] if line_dedup.similar(x, y, similarity)], lines)
    first, gone = {}, set()
    for i, t in rows:
        if len(w := line_dedup.normalised(t)) >= least and first.setdefault(root[w], i) != i:
            gone.add(i)
    return gone


def test_edit_similarity_alone_decides(spark, tmp_path):
    import corpus_pipeline
    from lexivec.llm import queries

    rows = near_line_rows()
    wanted = brute_edits(rows)
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"] for r in queries.op7_fuzzy_lines(spark, str(tmp_path)).collect() if r["n_removed"]}
    # only the fifth of each, with all the scattered edits that 0.9 allows, may be missed by chance, and only in long lines
    missed = wanted - got
    assert len(wanted) > 150 and got <= wanted and len(missed) <= 5
    assert all(i % 5 == 4 and len(rows[i][1]) >= line_dedup.SHORT for i in missed)
    kept = corpus_pipeline.drop_lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - got


@pytest.mark.parametrize("bits", [line_dedup.BITS, None])
def test_equal_short_lines_go(spark, bits):
    rows = [(1, "Menu\n\nfirst of the texts here"), (2, "another text altogether\nmenu \n\nmend"), (3, "你好世界\nMENU"), (4, "你好世界")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), bits=bits).collect()
    assert {r["doc_id"]: list(r["removed"]) for r in got} == {1: [], 2: [1], 3: [1], 4: [0]}


def test_segments_miss_no_short_line():
    r = random.Random(5)
    for _ in range(3000):
        n = r.randint(10, line_dedup.SHORT - 1)
        a = "".join(r.choice("abc ") for _ in range(n))
        b = list(a)
        for _ in range(n // 10):
            k = r.randrange(len(b))
            b[k : k + r.randint(0, 1)] = r.choice(["", "x", "y"])
        b = "".join(b)
        if line_dedup.similar(a, b, 0.9) and max(len(a), len(b)) < line_dedup.SHORT:
            assert line_dedup.segment_keys(a, 0.9) & line_dedup.segment_keys(b, 0.9)


def test_keys_of_many_short_lines_take_little_memory():
    r = random.Random(8)
    lines = ["".join(r.choices("abcdefghij ", k=40)) + str(k) for k in range(3000)]
    keys = line_dedup.line_keys(lines)[:, 0].copy()
    tracemalloc.start()
    buckets, counts, _ = line_dedup._buckets(lines, keys, 0.9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(buckets) == counts.sum() and peak < 80 * len(buckets)
    cuts = np.cumsum(counts)[:-1]
    for line, own in list(zip(lines, np.split(buckets, cuts)))[::100]:
        kinds = line_dedup.KINDS
        assert {int(b) >> 6 for b in own[own & kinds == line_dedup.SEGMENT]} == {k >> 6 for k in line_dedup.segment_keys(line, 0.9)}


def test_fuzzy_lines_hard_rows(docs, rows, empty):
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == len(rows)
    same = sorted(tuple(r["removed"]) for r in got if r["doc_id"] == 18)
    assert same == [(), ()] or same[0] == same[1]
    assert line_dedup.dedup_lines(empty).count() == 0 and line_dedup.dedup_documents(empty).count() == 0
    texts = line_dedup.dedup_text(docs).drop("__lexivec_n_removed")
    assert texts.columns == docs.columns and texts.where("text IS NULL").count() == 1


def test_large_buckets_flow():
    import pyarrow as pa

    n = line_dedup.COMPARED * 3
    batches = [pa.RecordBatch.from_arrays([pa.array([1] * 5 + [7] * n + [9] * 2, pa.int64()), pa.array([0, 1 << 40, 255, 3, 0x0FF000000000FF00] + list(range(n)) + [0, 0], pa.int64()), pa.array(range(n + 7), pa.int64())], names=["bucket", "sim", "key"])]
    small = [b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)]
    ids = [i for b in line_dedup._near(iter(small)) for i in b.column("id").to_pylist()]
    assert ids == [0, 1, 3, *range(5, n + 5), n + 5, n + 6]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distances():
    r = random.Random(1)
    tidy = lambda c: " ".join("".join(c).split())
    for _ in range(400):
        a = tidy(r.choice("ab c") for _ in range(r.randint(1, 90)))
        b = list(a)
        for _ in range(r.randint(0, len(a) // 2 + 1)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randint(0, 2)] = r.choice(["", "x", "ab", "c "])
        b = tidy(b)
        d = plain_distance(a, b)
        for most in (0, 1, 3, 8, 20, 100):
            assert line_dedup.distance(a, b, most) == min(d, most + 1)
            assert line_dedup.alignment(a, b, most) >= min(d, most + 1)
        found = np.abs(np.diff(line_dedup.profiles([a, b]), axis=0)).sum()
        assert found <= 4 * d
        code = lambda s: np.array([ord(c) - 32 for c in s], np.int64)
        assert line_dedup.distances(code(a), [code(b), code(""), code(a), code(b + a)], 100).tolist() == [d, len(a), 0, plain_distance(a, b + a)]


def test_likely_links_join_all_components():
    """One by one and many at once, against all links."""
    r = random.Random(3)
    for _ in range(60):
        n = r.randint(2, 40)
        component = np.array([r.randrange(n) for _ in range(n)])
        links = {tuple(sorted(r.sample(range(n), 2))) for _ in range(r.randint(0, n))}
        sure = lambda i, j: tuple(sorted((i, j))) in links  # noqa: E731, B023
        wanted = groups([*links, *((i, j) for i in range(n) for j in range(i) if component[i] == component[j])], range(n))
        for many in (None, lambda i, others: np.array([sure(i, j) for j in others.tolist()], bool)):  # noqa: B023
            pairs = linking.join_components(component, lambda i, others: others, sure, many)
            assert set(map(lambda p: tuple(sorted(p)), pairs)) <= links
            assert groups([*pairs, *((i, j) for i in range(n) for j in range(i) if component[i] == component[j])], range(n)) == wanted


@pytest.mark.parametrize("held, wide", [(1 << 14, 2), (16, 64), (4, 64)])
def test_pieces_of_buckets_lose_no_pair(monkeypatch, held, wide):
    """Buckets cut by length, and rows that go on under other lanes, against buckets taken whole."""
    r = random.Random(6)
    texts = [base_text(r, r.randint(12, 40)) for _ in range(12)]
    lines = sorted({edited(r, t, r.randint(0, 4)) for t in texts for _ in range(12)} | {f"{texts[0]} {base_text(r, 2)}" for _ in range(30)})
    keys = line_dedup.line_keys(lines)[:, 0].copy()
    buckets, counts, sides = line_dedup._buckets(lines, keys, 0.9)
    rows, n = np.repeat(np.arange(len(lines)), counts), np.array([len(x) for x in lines], np.int32)
    order = np.lexsort((keys.view(np.int64)[rows], n[rows], buckets.view(np.int64)))
    rows, buckets = rows[order], buckets[order]
    columns = [buckets.view(np.int64), n[rows], keys[rows].view(np.int64), *(s.view(np.int64) for s in sides[rows].T.copy())]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "n", "key", *line_dedup.SIDES])

    def together():
        groups = defaultdict(set)
        for found in line_dedup._alike(0.9)(batch.slice(k, 50) for k in range(0, batch.num_rows, 50)):
            for g, i in zip(found.column("key").to_pylist(), found.column("id").to_pylist()):
                groups[g].add(i)
        return {(a, b) for g in groups.values() for a in g for b in g if a < b}

    monkeypatch.setattr(line_dedup.common, "merged", lambda batches: batches)
    whole = together()
    monkeypatch.setattr(line_dedup, "HELD", held)
    monkeypatch.setattr(line_dedup, "WIDE", wide)
    own = keys.view(np.int64).tolist()
    linked = {tuple(sorted((own[i], own[j]))) for i in range(len(lines)) for j in range(i) if line_dedup.similar(lines[i], lines[j], 0.9)}
    assert len(linked) > 100 and linked <= whole and linked <= together()


def measured_lines():
    """Families of lines: copies with a few edits, lines that share half of themselves, and lengths around words of bits."""
    r = random.Random(8)
    out = ["", "a", "漢字" * 40, "漢字" * 39 + "x"]
    for n in (12, 44, 45, 63, 64, 65, 128, 129, 300):
        for _ in range(3):
            line = "".join(r.choice("abcd ") for _ in range(n))
            out += [line, line[: n // 2] + "".join(r.choice("efgh ") for _ in range(n - n // 2))]
            for edits in (1, 2, n // 12, n // 10, n // 10 + 1, n // 6):
                w = list(line)
                for _ in range(edits):
                    k = r.randrange(len(w))
                    w[k : k + r.randint(0, 2)] = r.choice(["", "x", "ab", "c"])
                out.append("".join(w))
    return sorted(set(out))


@pytest.mark.parametrize("together", [4096, 7])
def test_pairs_measured_together(monkeypatch, together):
    """Many pairs at once, with bands of blocks and early leave, against one by one; hardly any pair is left to be measured alone."""
    lines = measured_lines()
    alone = []
    one = line_dedup.distance
    size, r = np.array([len(x) for x in lines]), random.Random(2)
    a = np.repeat(np.arange(len(lines)), len(lines))
    b = np.tile(np.arange(len(lines)), len(lines))
    for share in (0.1, 0.3, 1):
        most = (share * np.maximum(size[a], size[b])).astype(np.int64)
        pick = np.array(r.sample(range(len(a)), 6000))
        wanted = [one(lines[i], lines[j], m) <= m for i, j, m in zip(a[pick].tolist(), b[pick].tolist(), most[pick].tolist())]
        monkeypatch.setattr(line_dedup, "TOGETHER", together)
        monkeypatch.setattr(line_dedup, "distance", lambda x, y, m: alone.append(1) or one(x, y, m))
        assert line_dedup.within(line_dedup._letters(lines), np.cumsum(size), a[pick], b[pick], most[pick]).tolist() == wanted and any(wanted)
    assert together == 7 or len(alone) < 1000


@pytest.mark.parametrize("together", [4096, 1])
def test_open_groups_are_joined_whole(monkeypatch, together):
    """The components that testing all pairs of each group would give, of groups that share rows."""
    monkeypatch.setattr(line_dedup, "TOGETHER", together)
    r = random.Random(11)
    own = [x for x in measured_lines() if len(x) >= 10]
    members = sorted((k, i) for k in range(5) for i in range(len(own)) if r.random() < 0.5)
    lines, keys = [own[i] for _, i in members], np.array([k for k, _ in members])
    known = np.array([i // 3 * 3 if i % 4 == 0 else i for _, i in members])
    sides = line_dedup.sides_of(line_dedup.least_hashes(own), line_dedup.line_keys(own)[:, 0])
    i, j = (x.ravel() for x in np.indices((len(own), len(own))))
    lanes = line_dedup.agreeing(sides, i, j).reshape(len(own), -1)
    plain = sides.view(np.uint8).reshape(len(own), -1)
    assert (lanes == (plain[:, None] == plain[None]).sum(axis=2)).all()
    like = lambda x, y: line_dedup.similar(own[x], own[y], 0.9) and (lanes[x, y] >= line_dedup.AGREE or min(len(own[x]), len(own[y])) < line_dedup.SHORT)
    links = [(m, n) for m, (k, x) in enumerate(members) for n, (h, y) in enumerate(members[:m]) if k == h and like(x, y)]
    same = [(m, n) for m in range(len(members)) for n in range(m) if known[m] == known[n]]
    pairs = line_dedup.joined(lines, keys, known, 0.9)
    rows = range(len(members))
    assert len(links) > 100 and groups([*pairs, *same], rows) == groups([*links, *same], rows) != groups(same, rows)


@pytest.mark.parametrize("least", [1, 4, 1000])
def test_whole_keys_are_handed_on(least):
    keys = [1, 1, 2, 3, 3, 3, 4, 5, 5, 5, 5, 5, 6]
    for cut in (1, 2, 5, 13):
        parts = []
        solve = lambda rows: parts.append(rows.column("key").to_pylist()) or rows.to_batches()[0]  # noqa: E731, B023
        list(linking.by_key(solve, least)(pa.RecordBatch.from_arrays([pa.array(keys[k : k + cut])], names=["key"]) for k in range(0, len(keys), cut)))
        assert [k for p in parts for k in p] == keys and all(len(p) >= least for p in parts[:-1])
        assert all(p[-1] != q[0] for p, q in zip(parts, parts[1:])) and (least > 1 or all(len(set(p)) == 1 for p in parts))


def test_wide_buckets_are_compared_many_rows_a_step(monkeypatch):
    """Rows of like length in one bucket take a comparison a step, not one a row."""
    calls = []
    one = line_dedup.agreeing
    monkeypatch.setattr(line_dedup, "agreeing", lambda *x: calls.append(1) or one(*x))
    r = np.random.default_rng(1)
    buckets, rows = 40, 2 * line_dedup.WIDE
    n = buckets * rows
    sides = r.integers(-(1 << 62), 1 << 62, (len(line_dedup.SIDES), n))
    sides[:, ::rows] = sides[:, rows - 1 :: rows]  # the first and the last row of a bucket are alike
    columns = [np.repeat(np.arange(buckets) * 64, rows), np.full(n, 100, np.int32), np.arange(n), *sides]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "n", "key", *line_dedup.SIDES])
    found = [i for b in line_dedup._alike(0.9)(iter([batch])) for i in b.column("id").to_pylist()]
    assert sorted(found) == sorted([*range(0, n, rows), *range(rows - 1, n, rows)]) and len(calls) < 3 * rows


def test_a_pair_is_measured_in_one_lane(monkeypatch):
    """Lines that agree in several lanes stand in a group of each, but are measured in that of the first; no link is lost by it."""
    r = random.Random(12)
    texts = [base_text(r, 30) for _ in range(10)]
    lines = sorted({edited(r, t, r.randint(0, 10)) for t in texts for _ in range(12)})
    keys = line_dedup.line_keys(lines)[:, 0].copy()
    buckets, counts, sides = line_dedup._buckets(lines, keys, 0.9)
    rows, n = np.repeat(np.arange(len(lines)), counts), np.array([len(x) for x in lines], np.int32)
    order = np.lexsort((keys.view(np.int64)[rows], n[rows], buckets.view(np.int64)))
    rows, buckets = rows[order], buckets[order]
    columns = [buckets.view(np.int64), n[rows], keys[rows].view(np.int64), *(s.view(np.int64) for s in sides[rows].T.copy())]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "n", "key", *line_dedup.SIDES])
    number = {k: i for i, k in enumerate(keys.view(np.int64).tolist())}
    members = sorted((g, number[i]) for b in line_dedup._alike(0.9)(iter([batch])) for g, i in zip(b.column("key").to_pylist(), b.column("id").to_pylist()))
    own, measured, one = np.array([i for _, i in members]), [], line_dedup.within
    monkeypatch.setattr(line_dedup, "within", lambda numbers, ends, a, b, most: measured.extend(zip(own[a].tolist(), own[b].tolist())) or one(numbers, ends, a, b, most))

    def found(names):
        measured.clear()
        pairs = line_dedup.joined([lines[i] for i in own], names, own, 0.9)
        times = defaultdict(int)
        for a, b in measured:
            times[min(a, b), max(a, b)] += 1
        return groups([(int(own[a]), int(own[b])) for a, b in pairs], range(len(lines))), max(times.values()), set(times)

    names = np.array([g for g, _ in members])
    once, often = found(names), found(-1 - names)  # a negative name has no lane
    linked = {(i, j) for j in range(len(lines)) for i in range(j) if line_dedup.similar(lines[i], lines[j], 0.9)}
    assert once[0] == often[0] == groups(sorted(linked), range(len(lines))) and len(linked) > 20
    assert once[1] == 1 < often[1] and once[2] == often[2]
