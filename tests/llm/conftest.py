import random

import pytest

#: Other columns, under names that operators use inside.
CLASHES = ["id", "key", "n", "version", "whole", "digest", "part", "ghost", "value", "c", "h", "mark", "spans", "first", "found", "low", "word", "_version", "_gone"]


def base_text(r, words=160):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(words))


def edited(r, text, edits):
    w = text.split(" ")
    for _ in range(edits):
        w[r.randrange(len(w))] = "".join(r.choice("xyz") for _ in range(4))
    return " ".join(w)


def hard_rows():
    """(doc_id, text): nulls, blanks, one word, a very long text, ties, repeated rows, near copies, shared passages."""
    r = random.Random(7)
    a, b, c = (base_text(r) for _ in range(3))
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "One"), (5, "one"), (6, a), (7, a), (8, edited(r, a, 1)), (9, edited(r, a, 2)), (10, edited(r, edited(r, a, 3), 3))]
    rows += [(11, b + "\n" + a[:500] + "\n" + c), (12, c + "\n" + b), (13, "Ünïcode ﬁne　" + c), (14, "漢字 " * 200), (15, "x" * 3000), (16, "ha ha " * 400), (17, base_text(r, 30000))]
    rows += [(18, "two words"), (18, "two words"), (19, "a,b.c d"), (None, "no id here at all"), (None, a), (20, "<|endoftext|> is <|startoftext|> text"), (21, "a\x00b \x1c c\x85d")]
    rows += [(100 + k, edited(r, b, 2)) for k in range(60)] + [(200 + k, c) for k in range(30)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return hard_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for name in CLASHES:
        df = df.selectExpr("*", f"'other' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
