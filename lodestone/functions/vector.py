"""Distances of number arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["METRICS", "cosine_distance", "inner_product", "l2_distance"]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _d(x: Column) -> Column:
    return x.cast("double")


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (_d(x) - _d(y)) * (_d(x) - _d(y)))))


def inner_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector has no length."""
    size = F.sqrt(inner_product(a, a)) * F.sqrt(inner_product(b, b))
    return F.when(size > 0, 1 - inner_product(a, b) / size)


#: Smaller is nearer for all of them.
METRICS = {"l2": l2_distance, "cosine": cosine_distance, "ip": lambda a, b: -inner_product(a, b)}
