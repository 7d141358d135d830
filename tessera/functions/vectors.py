"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; 0 for nulls, empty arrays, unequal lengths and zero vectors."""
    length = norm(a) * norm(b)
    able = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (length > 0)
    return F.coalesce(F.when(able, dot(a, b) / F.nullif(length, F.lit(0.0))), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets: 1 if both are empty, 0 if one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))
