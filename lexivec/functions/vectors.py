"""Vector functions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def has_vector(v: Column) -> Column:
    return F.size(F.coalesce(v, F.array().cast("array<double>"))) > 0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is all zero; vectors of different lengths are an error."""
    size = norm(a) * norm(b)
    found = F.when(size == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), size))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors have different lengths")).cast("double")).otherwise(found)


def l2_normalised(v: Column) -> Column:
    """A vector of length one; an all-zero vector stays as it is."""
    size = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(doubles(v), lambda x: x / size)


def mean_pooled(vectors: Column, mask: Column) -> Column:
    """The mean of token vectors (array of arrays) that the mask (array of 0 and 1) keeps; nothing kept gives zeros."""
    width = F.size(F.element_at(vectors, 1))
    total = F.greatest(F.aggregate(mask.cast("array<double>"), F.lit(0.0), lambda s, m: s + m), F.lit(1e-9))
    zeros = F.array_repeat(F.lit(0.0), width)
    pairs = F.arrays_zip(vectors.alias("v"), mask.alias("m"))
    add = lambda s, p: F.zip_with(s, p["v"].cast("array<double>"), lambda x, y: x + y * p["m"].cast("double"))
    return F.transform(F.aggregate(pairs, zeros, add), lambda x: x / total)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def yes_probability(no: Column, yes: Column) -> Column:
    """The two-class softmax of an instruct reranker."""
    return sigmoid(yes - no)
