"""Statistics, row validation, secondary indexes, and shards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whole-number types by name with their least and largest value. Unsigned ones are kept in the next wider type.
RANGES = {"int8": (-(1 << 7), (1 << 7) - 1), "int16": (-(1 << 15), (1 << 15) - 1), "int32": (-(1 << 31), (1 << 31) - 1), "int64": (-(1 << 63), (1 << 63) - 1), "uint8": (0, (1 << 8) - 1), "uint16": (0, (1 << 16) - 1), "uint32": (0, (1 << 32) - 1), "uint64": (0, (1 << 64) - 1)}


def table_stats(df: DataFrame) -> DataFrame:
    """row_count and size_bytes: rows by a count that reads no column, the size as the planner knows it (for a table, that of its files)."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.agg(F.count(F.lit(1)).alias("row_count")).select("row_count", F.lit(size).cast("long").alias("size_bytes"))


def column_stats(df: DataFrame, columns: list[str] | None = None, exact: bool | None = None) -> DataFrame:
    """name, distinct_count, null_count, min_value, max_value (as text) of each column, in one pass.

    Exact distinct counts expand every row once a column, so for more than four columns they are approximate unless asked for.
    """
    names = columns or df.columns
    exact = len(names) <= 4 if exact is None else exact
    distinct = F.count_distinct if exact else F.approx_count_distinct
    aggs = []
    for i, c in enumerate(names):
        aggs += [distinct(F.col(c)).alias(f"d{i}"), F.count(F.when(F.col(c).isNull(), 1)).alias(f"n{i}"), F.min(c).cast("string").alias(f"l{i}"), F.max(c).cast("string").alias(f"h{i}")]
    row = df.agg(*aggs)
    parts = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"d{i}").alias("distinct_count"), F.col(f"n{i}").alias("null_count"), F.col(f"l{i}").alias("min_value"), F.col(f"h{i}").alias("max_value")) for i, c in enumerate(names)])
    return row.select(F.inline(parts))


def check(name: str, kind: str, nullable: bool = True, dim: int | None = None) -> Column:
    """The reason why a value of the column isn't allowed, or null."""
    own = F.col(name)
    reason = F.lit(None).cast("string")
    if kind in RANGES:
        low, high = (F.lit(str(x)).cast("decimal(20,0)") for x in RANGES[kind])
        reason = F.when(~own.cast("decimal(38,0)").between(low, high), f"out_of_range:{name}")
    elif kind == "vector":
        reason = F.when(F.size(own) != dim, f"wrong_dimension:{name}")
    missing = F.lit(None).cast("string") if nullable else F.lit(f"not_nullable:{name}")
    return F.when(own.isNull(), missing).otherwise(reason)


def validate(df: DataFrame, rules: list[Column]) -> DataFrame:
    """The rows that break a rule, with all reasons."""
    return df.withColumn("reasons", F.array_compact(F.array(*rules))).where(F.size("reasons") > 0)


def index_entries(df: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """The entries of a secondary index: indexed columns and key; a row whose indexed columns are all null has none."""
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])).select(*columns, *key)


def index_changes(before: DataFrame, after: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """op (add, remove) and entry: what brings the index of `before` to that of `after`."""
    old, new = index_entries(before, columns, key), index_entries(after, columns, key)
    return new.exceptAll(old).withColumn("op", F.lit("add")).unionByName(old.exceptAll(new).withColumn("op", F.lit("remove")))


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key by hash, from 1."""
    return (F.pmod(F.xxhash64(key), F.lit(shards)) + 1).cast("int")


def range_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Rows with their shard by ranges of the key of about equal size, from 1."""
    cuts = df.agg(F.percentile_approx(key, [k / shards for k in range(1, shards)], 10_000)).first()[0] if shards > 1 else []
    own = F.lit(1)
    for c in cuts or []:
        own = own + (F.col(key) > F.lit(c)).cast("int")
    return df.withColumn("shard", own)


def balance_moves(shards: DataFrame) -> DataFrame:
    """shards(shard, store): one move from the fullest store to the emptiest if they differ by more than two."""
    load = shards.groupBy("store").agg(F.count(F.lit(1)).alias("n"), F.min("shard").alias("shard"))
    ends = load.agg(F.max_by(F.struct("store", "shard"), F.struct("n", -F.col("store"))).alias("from"), F.min_by("store", F.struct("n", "store")).alias("to_store"), F.max("n").alias("most"), F.min("n").alias("least"))
    return ends.where("most - least > 2").select("from.shard", F.col("from.store").alias("from_store"), "to_store")


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)
