"""Similarity of sets, records and vectors, and the tiers they fall in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; null if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def structural_similarity(type_a: Column, type_b: Column, country_a: Column, country_b: Column, axes_a: Column, axes_b: Column) -> Column:
    """0.4 equal type + 0.2 equal country + 0.4 Jaccard of the axes; two missing values are equal."""
    both = (F.size(axes_a) > 0) & (F.size(axes_b) > 0)
    return F.when(type_a.eqNullSafe(type_b), 0.4).otherwise(0.0) + F.when(country_a.eqNullSafe(country_b), 0.2).otherwise(0.0) + F.when(both, 0.4 * jaccard(axes_a, axes_b)).otherwise(0.0)


def similarity_tier(s: Column, high: float = 0.9, medium: float = 0.8, low: float = 0.7) -> Column:
    return F.when(s >= high, "high").when(s >= medium, "medium").when(s >= low, "low")


def tier_action(tier: Column) -> Column:
    return F.when(tier == "high", "merge").when(tier.isNotNull(), "review")
