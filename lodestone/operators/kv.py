"""Key-value reads and writes with expiry over DataFrames kv(key, value, expiry): expiry in epoch milliseconds, null for none.

Time is always a parameter. Writes return the new state; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alive(now: int) -> Column:
    return F.col("expiry").isNull() | (F.col("expiry") > now)


def get(kv: DataFrame, key: object, now: int) -> DataFrame:
    return kv.where((F.col("key") == key) & alive(now)).select("key", "value")


def mget(kv: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    """keys(ord, key) in request order, with value and found; a missing or expired key is not found."""
    own = kv.where(alive(now)).select("key", "value", F.lit(True).alias("found"))
    return keys.join(own, "key", "left").select("ord", "key", "value", F.coalesce("found", F.lit(False)).alias("found"))


def scan(kv: DataFrame, start: object = None, end: object = None, limit: int = 0) -> DataFrame:
    """Keys from start to end, both inclusive; None is unbounded and a limit of 0 is none. In key order."""
    rows = kv
    if start not in (None, ""):
        rows = rows.where(F.col("key") >= start)
    if end not in (None, ""):
        rows = rows.where(F.col("key") <= end)
    rows = rows.orderBy("key")
    return rows.limit(limit) if limit else rows


def ttl(kv: DataFrame, now: int, unit: str = "s") -> DataFrame:
    """Time to live of each key: -1 without expiry, -2 when it has expired."""
    left = F.col("expiry") - now
    scaled = left if unit == "ms" else F.floor(left / 1000)
    return kv.select("key", F.when(F.col("expiry").isNull(), F.lit(-1)).when(left <= 0, F.lit(-2)).otherwise(scaled).cast("long").alias("ttl"))


def exists(kv: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    """How many of keys(key) exist; a key asked for twice counts twice."""
    return keys.join(kv.where(alive(now)).select("key").distinct(), "key", "left_semi").agg(F.count(F.lit(1)).alias("n"))


def delete(kv: DataFrame, keys: DataFrame) -> DataFrame:
    return kv.join(keys.select("key"), "key", "left_anti")


def put(kv: DataFrame, rows: DataFrame, now: int, only_if: str | None = None, keep_ttl: bool = False) -> DataFrame:
    """The state after writing rows(key, value, expiry), one a key. only_if: 'nx' absent keys only, 'xx' present ones only."""
    live = kv.where(alive(now))
    if only_if:
        rows = rows.join(live.select("key"), "key", "left_anti" if only_if == "nx" else "left_semi")
    if keep_ttl:
        rows = rows.drop("expiry").join(live.select("key", "expiry"), "key", "left")
    return delete(kv, rows).unionByName(rows.select("key", "value", "expiry"))


def incr(kv: DataFrame, deltas: DataFrame, now: int) -> DataFrame:
    """key, value after adding deltas(key, delta), pre-aggregated; a missing key starts at 0, a value that is no integer gives null."""
    added = deltas.groupBy("key").agg(F.sum("delta").alias("delta"))
    live = kv.where(alive(now)).select("key", "value", F.lit(True).alias("there"))
    old = F.when(F.col("there").isNull(), F.lit(0)).otherwise(F.expr("try_cast(value as bigint)"))
    return added.join(live, "key", "left").select("key", (old + F.col("delta")).cast("long").alias("value"))


def append(kv: DataFrame, suffixes: DataFrame, now: int) -> DataFrame:
    """key, value, length in bytes after appending suffixes(key, suffix)."""
    live = kv.where(alive(now)).select("key", "value")
    joined = F.concat(F.coalesce("value", F.lit("")), F.col("suffix"))
    return suffixes.join(live, "key", "left").select("key", joined.alias("value"), F.octet_length(joined).cast("long").alias("length"))


def strlen(kv: DataFrame, now: int) -> DataFrame:
    return kv.where(alive(now)).select("key", F.octet_length("value").cast("long").alias("length"))


def expire(kv: DataFrame, at: DataFrame) -> DataFrame:
    """Sets the expiry of keys at(key, at); a null `at` makes them persist."""
    new = at.select("key", F.col("at").alias("new_expiry"), F.lit(True).alias("hit"))
    return kv.join(new, "key", "left").select("key", "value", F.when(F.col("hit"), F.col("new_expiry")).otherwise(F.col("expiry")).alias("expiry"))


def sweep(kv: DataFrame, now: int) -> DataFrame:
    return kv.where(alive(now))
