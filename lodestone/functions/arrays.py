"""Arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["array_has_all", "array_has_any", "array_pop_back", "array_pop_front", "array_positions", "array_remove_first", "array_remove_n", "array_replace_all", "array_replace_n", "array_resize"]


def array_has_all(a: Column, b: Column) -> Column:
    return F.forall(b, lambda x: F.array_contains(a, x))


def array_has_any(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def array_positions(a: Column, x: Column) -> Column:
    """All places (from 1) that hold x."""
    return F.filter(F.transform(a, lambda y, i: F.when(y.eqNullSafe(x), i + 1)), lambda i: i.isNotNull())


def array_remove_n(a: Column, x: Column, n: int) -> Column:
    """Without the first n elements equal to x."""
    gone = F.slice(array_positions(a, x), 1, n)
    return F.filter(a, lambda y, i: ~F.array_contains(gone, i + 1))


def array_remove_first(a: Column, x: Column) -> Column:
    return array_remove_n(a, x, 1)


def array_replace_n(a: Column, x: Column, to: Column, n: int) -> Column:
    hit = F.slice(array_positions(a, x), 1, n)
    return F.transform(a, lambda y, i: F.when(F.array_contains(hit, i + 1), to).otherwise(y))


def array_replace_all(a: Column, x: Column, to: Column) -> Column:
    return F.transform(a, lambda y: F.when(y.eqNullSafe(x), to).otherwise(y))


def array_pop_back(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def array_pop_front(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))


def array_resize(a: Column, n: int, fill: Column) -> Column:
    return F.slice(F.concat(a, F.array_repeat(fill, n)), 1, n)
