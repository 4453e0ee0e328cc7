"""Functions on arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JSON_VECTOR = "array<double>"


def parse_json_vector(c: Column) -> Column:
    """``[1, 2.5]`` as an array of doubles; null where it isn't one."""
    return F.from_json(c, JSON_VECTOR)


def pack(columns: list[str]) -> Column:
    """One array from columns v0, v1, ..."""
    return F.array(*[F.col(c).cast("double") for c in columns])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, at least 0, to nine digits; null for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    d = F.lit(1.0) - F.try_divide(dot(a, b), norm)
    return F.round(F.when(d < 0, 0.0).otherwise(d), 9)


def mean_vector(vectors: Column, n: int) -> Column:
    """Element-wise mean of an array of vectors of length ``n``; zeros for none."""
    zero = F.array_repeat(F.lit(0.0), n)
    total = F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.greatest(F.size(vectors), F.lit(1)))
