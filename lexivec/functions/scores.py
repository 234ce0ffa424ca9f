"""Term weights, rank fusion and score parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexivec.functions.text import without_fence

K1, B, FIXED_LENGTH = 1.2, 0.75, 512.0
RRF_K = 2.0


def term_weight(tf: Column, length: Column, average: Column | float) -> Column:
    """A term's saturated frequency; TF-only vectors take FIXED_LENGTH as the average."""
    average = F.lit(average) if isinstance(average, float) else average
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def idf(df: Column, n: Column) -> Column:
    """At least one document; 0 for the frequency of an unseen term."""
    df, n = F.coalesce(df, F.lit(0)).cast("double"), F.greatest(F.lit(1), n).cast("double")
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def rrf(rank: Column, k: float = RRF_K) -> Column:
    """The share of a hit at a rank counted from 0."""
    return 1.0 / (F.lit(float(k)) + rank)


def parsed_scores(reply: Column, n: Column) -> Column:
    """The n scores of a model's reply, by position: a JSON array of exactly n items, each item's score as a number from 0
    to 10, 5.0 where an item has none or is no object. A reply of any other form, or with a score that is no number, gives
    5.0 throughout."""
    items = F.from_json(without_fence(reply), "array<string>")
    number = lambda x: F.get_json_object(x, "$.score").try_cast("double")
    wrong = F.exists(items, lambda x: F.coalesce(F.array_contains(F.json_object_keys(x), "score"), F.lit(False)) & number(x).isNull())
    scores = F.transform(items, lambda x: F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.coalesce(number(x), F.lit(5.0)))))
    good = (F.coalesce(F.size(items), F.lit(-1)) == n) & ~F.coalesce(wrong, F.lit(False))
    return F.when(good, scores).otherwise(F.array_repeat(F.lit(5.0), n))
