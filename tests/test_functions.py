import uuid
import zlib

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lexivec.functions import scores, text, vectors


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("name", ["a", "", "é漢", "doc||x||1"])
def test_ids_are_pythons(spark, name):
    assert one(spark, text.uuid5(F.col("s"), uuid.NAMESPACE_DNS), s=name) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))
    assert one(spark, text.term_hash(F.col("s")), s=name) == zlib.crc32(name.encode())


def test_strings(spark):
    assert one(spark, text.squeeze(F.col("s")), s="  a \n　b ") == "a b"
    assert one(spark, text.tokens(F.col("s")), s="Héllo wOrld_1, 2") == ["h", "llo", "world_1", "2"]
    assert one(spark, text.is_bold(F.col("s")), s="Times-DEMIbold") and not one(spark, text.is_italic(F.col("s")), s="Times")
    assert one(spark, text.colour_key(F.col("c")), c=[0.5, 1.0, 0.0]) == "0.50_1.00_0.00"
    assert one(spark, text.colour_key(F.col("c")), c=[0.25]) == "gray_0.25"
    assert one(spark, text.basename(F.col("s")), s="/a/b/c.pdf") == "c.pdf"
    assert text.join_url("http://h/", "/embed") == "http://h/embed"
    rows = spark.createDataFrame([(10.25,), (10.35,), (10.45,), (0.15,)], ["v"]).select(text.round1(F.col("v")).alias("x")).collect()
    assert [r["x"] for r in rows] == [round(v, 1) for v in (10.25, 10.35, 10.45, 0.15)]


def test_cosine(spark):
    c = vectors.cosine(F.col("a"), F.col("b"))
    assert one(spark, c, a=[1.0, 0.0], b=[2.0, 0.0]) == pytest.approx(1)
    assert one(spark, c, a=[0.0, 0.0], b=[2.0, 1.0]) == 0
    with pytest.raises(Exception, match="different lengths"):
        one(spark, c, a=[1.0], b=[1.0, 2.0])
    assert one(spark, vectors.l2_normalised(F.col("a")), a=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, vectors.mean_pooled(F.col("v"), F.col("m")), v=[[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], m=[1, 1, 0]) == [2.0, 3.0]
    assert one(spark, vectors.yes_probability(F.col("n"), F.col("y")), n=0.0, y=0.0) == 0.5


REPLIES = [
    ('[{"id":0,"score":3},{"id":1,"score":42}]', [3.0, 10.0]),
    ('```json\n[{"score":-1},{"score":"7.5"}]\n```', [0.0, 7.5]),
    ('[{"score":3}]', [5.0, 5.0]),
    ("no idea", [5.0, 5.0]),
    ('[{"id":1},4]', [5.0, 5.0]),
    ("", [5.0, 5.0]),
]


@pytest.mark.parametrize("reply,wanted", REPLIES)
def test_scores_of_replies(spark, reply, wanted):
    assert one(spark, scores.parsed_scores(F.col("r"), F.lit(2)), r=reply) == wanted


def test_idf_and_rrf(spark):
    import math

    assert one(spark, scores.idf(F.col("d"), F.col("n")), d=2, n=10) == pytest.approx(math.log((10 - 2 + 0.5) / 2.5 + 1))
    assert one(spark, scores.idf(F.lit(None), F.col("n")), n=0) == pytest.approx(math.log(1.5 / 0.5 + 1))
    assert one(spark, scores.rrf(F.col("r")), r=0) == 0.5
