"""Ranks, percentiles and running extremes over large groups, without a task that sorts a whole group.

Rows are dealt over ranges of the ordering value (cut points are approximate percentiles of the whole table: a bounded list on the driver). Each range
is ordered by itself, and what the ranges before it add up to is carried over from one small row a group and range. Rows of one value share a range.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64


def cut_points(df: DataFrame, value: str, parts: int = PARTS) -> list:
    """At most parts - 1 values that cut the table into ranges of about equal size."""
    found = df.agg(F.percentile_approx(value, [k / parts for k in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else None
    return sorted(set(found or []))


def range_of(value: str, cuts: list) -> Column:
    """The place of the value's range; nulls lie before all others. Plain comparisons: the optimiser loses sight of columns that a lambda function uses."""
    if not cuts:
        return F.lit(0)
    return F.coalesce(reduce(lambda a, b: a + b, [(F.col(value) > F.lit(c)).cast("int") for c in cuts]) + 1, F.lit(0))


def _carried(rows: DataFrame, keys: list[str], part: str, total: Column, carry: str) -> DataFrame:
    """keys, part, __before (the ranges before it) and __all (all ranges) of an aggregate; carry: sum or max."""
    sums = rows.groupBy(*keys, part).agg(total.alias("__own"))
    fold = getattr(F, carry)
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # a row a range
    before = fold("__own").over(by_key.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    return sums.select(*keys, part, before.alias("__before"), fold("__own").over(by_key).alias("__all"))


def row_numbers(df: DataFrame, keys: list[str], order: list[str], parts: int = PARTS) -> DataFrame:
    """df with rn (place in its group by `order`, which should tell all rows of a group apart) and total (rows of the group)."""
    rows = df.withColumn("__part", range_of(order[0], cut_points(df, order[0], parts)))
    carried = _carried(rows, keys, "__part", F.count(F.lit(1)), "sum")
    own = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))
    met = rows.withColumn("__rn", own).join(carried, [*keys, "__part"])
    return met.select(*df.columns, (F.col("__rn") + F.coalesce("__before", F.lit(0))).alias("rn"), F.col("__all").alias("total"))


def shares(rn: Column, total: Column, tiles: int) -> tuple[Column, Column, Column]:
    """percent_rank, cume_dist and ntile of rows whose order has no ties."""
    size, more = F.floor(total / tiles), total % tiles
    wide = more * (size + 1)
    tile = F.when(rn <= wide, F.ceil(rn / (size + 1))).otherwise(more + F.ceil((rn - wide) / F.greatest(size, F.lit(1))))
    return F.when(total > 1, (rn - 1) / (total - 1)).otherwise(F.lit(0.0)), rn / total, tile.cast("int")


def value_ranks(df: DataFrame, keys: list[str], value: str, weight: str | None = None, parts: int = PARTS) -> DataFrame:
    """keys, value, n (rows, or their weight, of that value), below (of smaller ones), total (of the group). Equal values are combined first."""
    rows = df.where(F.col(value).isNotNull())
    mass = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = rows.groupBy(*keys, value).agg(mass.alias("n")).withColumn("__part", range_of(value, cut_points(rows, value, parts)))
    carried = _carried(counts, keys, "__part", F.sum("n"), "sum")
    inside = F.sum("n").over(Window.partitionBy(*keys, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    met = counts.withColumn("__in", inside).join(carried, [*keys, "__part"])
    zero = F.lit(0)
    return met.select(*keys, value, "n", (F.coalesce("__in", zero) + F.coalesce("__before", zero)).alias("below"), F.col("__all").alias("total"))


def percentiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float], parts: int = PARTS) -> DataFrame:
    """Exact interpolated percentiles: keys and a column for each name of `at`. A group of nulls only has no row."""
    ranked = value_ranks(df, keys, value, None, parts)
    holds = lambda place: (F.col("below") <= place) & (place < F.col("below") + F.col("n"))
    aggs = []
    for name, q in at.items():
        place = F.lit(q) * (F.col("total") - 1)
        low, high = (F.max(F.when(holds(p), F.col(value).cast("double"))) for p in (F.floor(place), F.ceil(place)))
        share = F.max(place - F.floor(place))
        aggs.append((low + (high - low) * share).alias(name))
    return ranked.groupBy(*keys).agg(*aggs) if keys else ranked.agg(*aggs)


def weighted_percentiles(df: DataFrame, keys: list[str], value: str, weight: str, at: dict[str, float], parts: int = PARTS) -> DataFrame:
    """The least value at which the weight up to it reaches the share of the whole. Rows without a positive weight don't count."""
    if bad := [q for q in at.values() if not 0 <= q <= 1 or math.isnan(q)]:
        raise ValueError(f"{bad} are no shares")
    ranked = value_ranks(df.where(F.col(weight) > 0), keys, value, weight, parts)
    reached = lambda q: F.col("below") + F.col("n") >= F.lit(q) * F.col("total")
    aggs = [F.min(F.when(reached(q), F.col(value))).alias(name) for name, q in at.items()]
    return ranked.groupBy(*keys).agg(*aggs) if keys else ranked.agg(*aggs)


def running_max(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, parts: int = PARTS) -> DataFrame:
    """df with `name`: the largest value of the rows before it in its group, by `order` (which should tell all rows apart); null for the first."""
    rows = df.withColumn("__part", range_of(order[0], cut_points(df, order[0], parts)))
    carried = _carried(rows, keys, "__part", F.max(value), "max").drop("__all")
    inside = F.max(value).over(Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__in", inside).join(carried, [*keys, "__part"]).select(*df.columns, F.greatest("__in", "__before").alias(name))
