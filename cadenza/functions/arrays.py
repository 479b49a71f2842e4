"""Vector and array expressions (all native, no Python per row)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v))


def cosine_from(dot_product: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine from its parts; a zero vector has similarity 0 to everything."""
    size = norm_a * norm_b
    return F.when(size > 0, dot_product / size).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    return cosine_from(dot(a, b), norm(a), norm(b))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(
        F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)
    )


def angular(cos: Column) -> Column:
    """Distance between the unit vectors: sqrt(2(1 - cos))."""
    return F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - cos)))


def standardise(vector: Column, mean: Column, scale: Column) -> Column:
    """(x - mean) / scale per component; a scale of zero counts as one."""
    centred = F.zip_with(vector, mean, lambda x, m: x - m)
    return F.zip_with(centred, scale, lambda x, s: x / F.when(s == 0, F.lit(1.0)).otherwise(s))


def scaled(vector: Column, weight: float) -> Column:
    return F.transform(vector, lambda x: x * F.lit(float(weight)))


def map_cosine(a: Column, b: Column) -> Column:
    """Cosine over the keys two maps share; 0 when either is missing or none is shared."""
    keys = F.array_intersect(F.map_keys(a), F.map_keys(b))

    def on_keys(shared: Column) -> Column:
        left = F.transform(shared, lambda k: F.try_element_at(a, k))
        right = F.transform(shared, lambda k: F.try_element_at(b, k))
        return cosine(left, right)

    return F.coalesce(bind(keys, on_keys), F.lit(0.0))


def population_std(values: Column) -> Column:
    """Standard deviation (divisor n) of an array."""

    def around(vs: Column) -> Column:
        mean = F.aggregate(vs, F.lit(0.0), lambda acc, v: acc + v) / F.size(vs)
        return bind(
            mean,
            lambda m: F.sqrt(F.aggregate(vs, F.lit(0.0), lambda acc, v: acc + (v - m) * (v - m)) / F.size(vs)),
        )

    return bind(values, around)
