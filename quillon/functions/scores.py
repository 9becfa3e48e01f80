"""Column expressions for distances, scores and throughput."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_DISTANCE = 0.5


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - inner_product(a, b) / F.sqrt(inner_product(a, a) * inner_product(b, b))


def similarity(distance: Column) -> Column:
    """1 / (1 + d) clamped to 0..1; a missing distance counts as 0.5, a distance of -1 gives 1."""
    d = F.coalesce(distance, F.lit(DEFAULT_DISTANCE))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(1.0), 1 + d), F.lit(1.0))))


def combined(llm_score: Column, distance: Column, weight: float = 0.7) -> Column:
    return F.round(F.lit(weight) * llm_score + F.lit(1 - weight) * similarity(distance), 4)


def throughput(tokens: Column, seconds: Column) -> Column:
    return F.when(seconds <= 0, 0.0).otherwise(F.round(tokens / seconds, 2))
