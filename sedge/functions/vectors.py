"""Vector similarity as column expressions. Arithmetic is in double precision; a zero or unequal vector has similarity 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Longer vectors use higher-order functions: an unrolled sum of more terms no longer fits one compiled method.
UNROLLED = 256


def _doubles(x: Column) -> Column:
    return F.transform(x, lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns; 0 when a norm is 0 or the lengths differ, null when either is null."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    same = F.when(F.size(a) == F.size(b), F.coalesce(dot(a, b) / F.nullif(norms, F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    return F.when(a.isNotNull() & b.isNotNull(), same)


def cosine_to(a: Column, query: list[float]) -> Column:
    """Cosine of an array column to a fixed vector. Up to UNROLLED dimensions it is one compiled expression."""
    norm = sum(float(q) * float(q) for q in query) ** 0.5
    if not query or norm == 0:
        return F.when(a.isNotNull(), 0.0)
    if len(query) > UNROLLED:
        return cosine(a, F.array(*[F.lit(float(q)) for q in query]))
    parts = [F.get(a, F.lit(i)).cast("double") for i in range(len(query))]
    top = reduce(lambda x, y: x + y, [p * F.lit(float(q)) for p, q in zip(parts, query)])
    own = F.sqrt(reduce(lambda x, y: x + y, [p * p for p in parts]))
    value = F.coalesce(top / F.nullif(own * F.lit(norm), F.lit(0.0)), F.lit(0.0))
    return F.when(a.isNotNull(), F.when(F.size(a) == len(query), value).otherwise(0.0))


def clamp(score: Column) -> Column:
    """A score held to 0..1; NaN counts as 1, as comparisons order it above all numbers."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
