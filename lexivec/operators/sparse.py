"""Term statistics, BM25 and TF weights, and sparse retrieval over postings (id, term, tf, length).

Documents without tokens have no postings and are not counted. Statistics are functions of the corpus at hand; a frozen
snapshot can be passed instead. Queries are weighted like documents by default, so an inner product carries the square of
the idf; classic=True gives query terms the weight 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexivec.functions.scores import FIXED_LENGTH, idf, term_weight
from lexivec.functions.text import term_hash, tokens


def _exploded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, length, term), one row a token. The outer explode keeps the optimizer from tokenising twice, once to filter."""
    found = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("_t"))
    return found.select("id", F.size("_t").cast("bigint").alias("length"), F.explode_outer("_t").alias("term")).where("term IS NOT NULL")


def term_frequency(docs: DataFrame, id_col: str, text_col: str, hash_terms: bool = False) -> DataFrame:
    """(id, term, tf, length). With hash_terms terms are their CRC-32 numbers, and those that collide become one."""
    found = _exploded(docs, id_col, text_col)
    found = found.withColumn("term", term_hash(F.col("term"))) if hash_terms else found
    return found.groupBy("id", "term", "length").agg(F.count("*").alias("tf")).select("id", "term", "tf", "length")


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def corpus_totals(docs: DataFrame, text_col: str) -> DataFrame:
    """One row from one scan: n (documents with tokens), total_length, average_length (1.0 if n = 0)."""
    sizes = docs.select(F.size(tokens(F.col(text_col))).cast("bigint").alias("length"))
    one = sizes.agg(F.count_if(F.col("length") > 0).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_length"))
    return one.withColumn("average_length", F.when(F.col("n") > 0, F.try_divide(F.col("total_length").cast("double"), F.col("n"))).otherwise(1.0))


def corpus_stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """corpus_totals and n_terms, the number of distinct terms."""
    terms = _exploded(docs, id_col, text_col).agg(F.countDistinct("term").alias("n_terms"))
    return corpus_totals(docs, text_col).crossJoin(terms)  # one row each


def _with_stats(postings: DataFrame, df: DataFrame, totals: DataFrame) -> DataFrame:
    return postings.join(df, "term", "left").crossJoin(F.broadcast(totals.select("n", "average_length")))  # totals is one row


def bm25_weights(postings: DataFrame, df: DataFrame, totals: DataFrame) -> DataFrame:
    """(id, term, weight); df and totals may be of these postings or a frozen snapshot."""
    weight = idf(F.col("df"), F.col("n")) * term_weight(F.col("tf"), F.col("length"), F.col("average_length"))
    return _with_stats(postings, df, totals).select("id", "term", weight.alias("weight"))


def tf_weights(postings: DataFrame) -> DataFrame:
    """(id, term, weight) without any statistics of the corpus."""
    return postings.select("id", "term", term_weight(F.col("tf"), F.col("length"), FIXED_LENGTH).alias("weight"))


def packed(weights: DataFrame) -> DataFrame:
    """(id, vector): each row's terms as array<struct<idx, val>> by ascending CRC-32."""
    hashed = weights.groupBy("id", term_hash(F.col("term")).alias("idx")).agg(F.sum("weight").alias("val"))
    return hashed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("idx", "val"))).alias("vector"))


def unpacked(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", F.inline("vector")).withColumnRenamed("idx", "term").withColumnRenamed("val", "weight")


#: A document's own row among its postings is under one of so many marks, which no token can be.
MARKS = 1024


def _postings_of(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(id, term, tf, length): the postings of the wanted terms, and of every document with tokens a row under a mark. All
    that scores need comes from this one scan; tokens that nobody wants are dropped before anything is shuffled."""
    found = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("_t")).select("id", "_t", F.size("_t").cast("bigint").alias("length"))
    mark = F.concat(F.lit("\0"), F.pmod(F.xxhash64("id"), F.lit(MARKS)).cast("string"))
    rows = found.where("length > 0").select("id", "length", F.explode(F.array_append("_t", mark)).alias("term"))
    kept = rows.join(wanted.select("term", F.lit(True).alias("_w")), "term", "left").where(F.col("_w") | F.startswith("term", F.lit("\0")))
    return kept.groupBy("id", "term", "length").agg(F.count("*").alias("tf"))


def _scored(postings: DataFrame, asked: DataFrame, df: DataFrame, totals: DataFrame, mode: str, classic: bool) -> DataFrame:
    rarity = idf(F.col("df"), F.col("n"))
    average: Column | float = F.col("average_length") if mode == "bm25" else FIXED_LENGTH
    own = term_weight(F.col("tf"), F.col("length"), average)
    ours = _with_stats(postings, df, totals).select("id", "term", (rarity * own).alias("wd"))
    side = F.lit(1.0) if classic else (rarity if mode == "bm25" else F.lit(1.0)) * own
    theirs = _with_stats(asked, df, totals).select("query_id", "term", side.alias("wq"))
    return ours.join(theirs, "term").groupBy("query_id", "id").agg(F.sum(F.col("wd") * F.col("wq")).alias("score"))


def sparse_scores(docs: DataFrame, id_col: str, text_col: str, queries: DataFrame, mode: str = "bm25", classic: bool = False, stats: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query_id, id, score) of all rows that share a term with a query (query_id, query): an inverted-index join on terms.
    mode "bm25": BM25 on both sides; "idf": TF weights on both sides and the idf once. stats: (df, totals)."""
    asked = term_frequency(queries, "query_id", "query").withColumnRenamed("id", "query_id")
    found = _postings_of(docs, id_col, text_col, asked.select("term").distinct())
    # the conditions name tf, so that none moves below the shuffle and the branches read the same one
    marked = F.startswith("term", F.lit("\0"))
    postings = found.where(F.when(F.col("tf") > 0, ~marked))
    one = found.where(F.when(F.col("tf") > 0, marked)).agg(F.count_if(F.col("tf") > 0).alias("n"), F.sum(F.when(F.col("tf") > 0, F.col("length"))).alias("total"))
    totals = one.select("n", F.when(F.col("n") > 0, F.try_divide(F.col("total").cast("double"), F.col("n"))).otherwise(1.0).alias("average_length"))
    df, totals = stats or (postings.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df")), totals)
    return _scored(postings, asked, df, totals, mode, classic)


def with_counts(docs: DataFrame, text_col: str, out: str = "sparse") -> DataFrame:
    """With a column of term counts, array<struct<idx, tf>> by ascending CRC-32: a sparse vector before any statistics."""
    sorted_ = docs.withColumn("_h", F.array_sort(F.transform(tokens(F.col(text_col)), term_hash)))
    fresh = F.filter(F.sequence(F.lit(0), F.size("_h") - 1), lambda k: (k == 0) | (F.get("_h", k) != F.get("_h", k - 1)))
    first = sorted_.withColumn("_f", F.when(F.size("_h") > 0, fresh).otherwise(F.array().cast("array<int>")))
    count = F.transform("_f", lambda at, k: F.struct(F.get("_h", at).alias("idx"), (F.coalesce(F.get("_f", k + 1), F.size("_h")) - at).cast("bigint").alias("tf")))
    return first.withColumn(out, count).drop("_h", "_f")


def counted_scores(counts: DataFrame, queries: DataFrame, mode: str = "bm25", classic: bool = False, stats: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """sparse_scores over stored counts (id, sparse), in which colliding terms are one."""
    asked = term_frequency(queries, "query_id", "query", hash_terms=True).withColumnRenamed("id", "query_id")
    sized = counts.select("id", "sparse", F.aggregate("sparse", F.lit(0).cast("bigint"), lambda n, x: n + x["tf"]).alias("length"))
    postings = sized.select("id", "length", F.inline("sparse")).withColumnRenamed("idx", "term").join(asked.select("term").distinct(), "term", "left_semi")
    one = sized.agg(F.count_if(F.col("length") > 0).alias("n"), F.sum("length").alias("total"))
    totals = one.select("n", F.when(F.col("n") > 0, F.try_divide(F.col("total").cast("double"), F.col("n"))).otherwise(1.0).alias("average_length"))
    df, totals = stats or (document_frequency(postings), totals)
    return _scored(postings, asked, df, totals, mode, classic)


def top_k(scores: DataFrame, k: int, id_col: str = "id", digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank from 1): scores rounded, ties by id. The window keeps k rows a query in each task before
    the shuffle (WindowGroupLimit)."""
    rounded = scores.withColumn("score", F.round("score", digits))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", id_col, "score", "rank")
