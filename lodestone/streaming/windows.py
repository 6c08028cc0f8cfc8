"""Event-time operators; each works on a batch and on a stream alike. Event times are cast to timestamp, as watermarks ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running_max


def event_time(df: DataFrame, column: str, delay: str | None = None) -> DataFrame:
    timed = df.withColumn(column, F.col(column).cast("timestamp"))
    return timed.withWatermark(column, delay) if delay else timed


def _bounds(rows: DataFrame) -> DataFrame:
    return rows.withColumn("window_start", F.col("window.start").cast("timestamp_ntz")).withColumn("window_end", F.col("window.end").cast("timestamp_ntz")).drop("window")


def tumbling(df: DataFrame, column: str, size: str, keys: list[str], aggs: list[Column], delay: str | None = None) -> DataFrame:
    return _bounds(event_time(df, column, delay).groupBy(F.window(column, size), *keys).agg(*aggs))


def sliding(df: DataFrame, column: str, size: str, step: str, keys: list[str], aggs: list[Column], delay: str | None = None) -> DataFrame:
    return _bounds(event_time(df, column, delay).groupBy(F.window(column, size, step), *keys).agg(*aggs))


def sessions(df: DataFrame, column: str, gap: str, keys: list[str], aggs: list[Column], delay: str | None = None) -> DataFrame:
    return _bounds(event_time(df, column, delay).groupBy(F.session_window(column, gap).alias("window"), *keys).agg(*aggs))


def deduplicate(df: DataFrame, column: str, keys: list[str], delay: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return event_time(df, column, delay).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def high_watermark(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(column).alias("high"))


def late(df: DataFrame, column: str, order: str, allowed: str) -> DataFrame:
    """Rows that are older than the largest time before them (by `order`) less the allowed lateness."""
    return running_max(df, [], [order], column, "__high").where(F.col(column) < F.col("__high") - F.expr(f"interval {allowed}")).drop("__high")
