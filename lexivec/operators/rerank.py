"""Reranking hits (query_id, query, chunk columns, original_rank) with an injected scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexivec.functions.scores import parsed_scores
from lexivec.operators.chunking import embedding_text
from lexivec.session import importable

MIN_RELEVANCE = 5.0


def passage() -> Column:
    return embedding_text(F.col("source_document"), F.col("section_path"), F.col("section"), F.col("text"))


def score_pairs(hits: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], out: str = "model_score") -> DataFrame:
    """A model's score of each (query, passage), an Arrow batch a call; whatever the scorer raises fails the job. A reply of
    the wrong length gives null."""
    importable(hits.sparkSession)

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for query, text in batches:
            found = pd.Series(scorer(query, text), dtype="float64")
            yield found.reset_index(drop=True) if len(found) == len(query) else pd.Series([float("nan")] * len(query))

    return hits.withColumn(out, F.nanvl(run(F.col("query"), passage()), F.lit(None).cast("double")))


def cross_encoder(hits: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], k: int) -> DataFrame:
    """relevance_score (ten times the model's 0 to 1) and new_rank, the best k of each query; equal scores keep their order.
    A query for which the model did not score every hit keeps the order given, from 5.0 down by 0.1."""
    scored = score_pairs(hits, scorer)
    whole = F.count("model_score").over(W.partitionBy("query_id")) == F.count("*").over(W.partitionBy("query_id"))
    relevance = F.when(whole, F.col("model_score") * 10).otherwise(fallback_score())
    return ranked(scored.withColumn("relevance_score", relevance).drop("model_score"), k)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("relevance_score"), "original_rank")
    return hits.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k)


def minimum_relevance(hits: DataFrame, k: int, least: float = MIN_RELEVANCE) -> DataFrame:
    """The best k of what scores at least `least`, ranked after the filter."""
    return ranked(hits.where(F.col("relevance_score") >= least), k)


def fallback_score() -> Column:
    """From 5.0 down by 0.1 in the order given."""
    return 5.0 - 0.1 * (F.col("original_rank") - 1)


def fallback(hits: DataFrame, k: int) -> DataFrame:
    return ranked(hits.withColumn("relevance_score", fallback_score()), k)


def with_reply_scores(hits: DataFrame, replies: DataFrame) -> DataFrame:
    """replies: (query_id, reply) of a language model that saw a query's hits in order; the first by text if a query has
    several. relevance_score by position; a query without a reply keeps the order given, as fallback() scores it."""
    one = replies.groupBy("query_id").agg(F.min("reply").alias("_reply"))
    n = F.count("*").over(W.partitionBy("query_id")).cast("int")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("original_rank"))
    placed = hits.withColumns({"_n": n, "_p": place}).join(one, "query_id", "left")
    score = F.when(F.col("_reply").isNull(), fallback_score()).otherwise(F.get(parsed_scores(F.col("_reply"), F.col("_n")), F.col("_p") - 1))
    return placed.withColumn("relevance_score", score).drop("_n", "_p", "_reply")


def language_model(hits: DataFrame, replies: DataFrame, k: int, least: float = MIN_RELEVANCE) -> DataFrame:
    """The best k of each query by its reply's scores, of those of at least `least`; of a query without a reply the first k."""
    told = with_reply_scores(hits, replies).join(replies.where("reply IS NOT NULL").select("query_id", F.lit(True).alias("_told")).distinct(), "query_id", "left")
    return ranked(told.where(F.col("_told").isNull() | (F.col("relevance_score") >= least)).drop("_told"), k)


#: What a language model is asked for; the form of the reply is the one that parsed_scores reads.
SCORING_PROMPT = (
    "You grade passages for a search engine. For every passage below give a number from 0 (has nothing to do with the query) to 10 "
    "(answers it in full); half the scale means that it helps somewhat. Go by what a passage says, not by words that it shares with the query. "
    'Write a JSON array and nothing else, in the order of the passages: [{"id": 0, "score": 7.5}, ...].'
)


def prompts(hits: DataFrame) -> DataFrame:
    """(query_id, prompt): the instructions, a query and all its passages, numbered from 0 in their order."""
    part = F.struct("original_rank", F.concat(F.lit("Chunk: "), (F.row_number().over(W.partitionBy("query_id").orderBy("original_rank")) - 1).cast("string"), F.lit("\n"), passage()).alias("t"))
    whole = hits.select("query_id", "query", part.alias("_s")).groupBy("query_id", "query").agg(F.array_sort(F.collect_list("_s")).alias("_p"))
    listed = F.array_join(F.transform("_p", lambda x: x["t"]), "\n\n")
    return whole.select("query_id", F.concat(F.lit(SCORING_PROMPT + "\n\nThe query is: "), F.col("query"), F.lit("\n\n"), listed, F.format_string("\n\nThe array has %d items.", F.size("_p"))).alias("prompt"))


def lexical_scorer(query: pd.Series, text: pd.Series) -> pd.Series:
    """The default scorer, for want of a model: the share of the query's words that the passage has."""
    import re

    find = re.compile(r"[A-Za-z0-9_]+").findall
    words = [({w.lower() for w in find(q or "")}, {w.lower() for w in find(t or "")}) for q, t in zip(query, text)]
    return pd.Series([len(q & t) / len(q) if q else 0.0 for q, t in words], dtype="float64")


def context(hits: DataFrame, order_col: str = "rank") -> DataFrame:
    """(query_id, context): the cited context of each query's chunks; see no_context for queries without hits. A query's hits
    are few, so they meet in one row."""
    named = lambda c: (F.coalesce(F.col(c), F.lit("")) != "") & (F.col(c) != F.col("source_document"))
    section = F.when(named("section_path"), F.concat(F.lit(", Section: "), "section_path")).when(named("section"), F.concat(F.lit(", Section: "), "section")).otherwise("")
    page = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    block = F.concat(F.lit("[Source: "), "source_document", section, F.lit(", Pages: "), page("start_page"), F.lit("-"), page("end_page"), F.lit("]\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    whole = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("r"), block.alias("b")))).alias("_b"))
    return whole.select("query_id", F.concat(F.lit("Context from documents:\n\n"), F.array_join(F.transform("_b", lambda x: x["b"]), "\n")).alias("context"))


#: Fixed text: the context of a query without hits.
NO_CONTEXT = "No relevant information found."
