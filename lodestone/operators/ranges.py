"""Joins of points with intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, width: float, salts: int = 1) -> DataFrame:
    """Every point with every interval that holds it (low <= point < high): all columns of both, which must differ in name.

    An equi-join on buckets of `width`, a number in units of the point: an interval is repeated for each bucket it touches, so width should be about that of
    the intervals. salts > 1 deals the points of a crowded bucket over as many tasks and repeats intervals for each.
    """
    bucket = lambda c: F.floor(c / width).cast("long")
    spans = intervals.where(F.col(low) < F.col(high)).withColumn("__b", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    dealt = points.where(F.col(point).isNotNull()).withColumn("__b", bucket(F.col(point)))
    keys = ["__b"]
    if salts > 1:
        spans = spans.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        dealt, keys = dealt.withColumn("__s", F.pmod(F.xxhash64(*points.columns), F.lit(salts)).cast("int")), ["__b", "__s"]
    return dealt.join(spans, keys).where((F.col(low) <= F.col(point)) & (F.col(point) < F.col(high))).drop(*keys)
