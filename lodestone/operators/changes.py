"""Change data: differences of snapshots, logs of changes, and what a log makes of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import row_numbers


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, op (insert, update, delete), before, after: one full join; unchanged rows are left out."""
    rest = [c for c in before.columns if c not in keys]
    old = before.select(*keys, F.struct(*rest).alias("before"))
    new = after.select(*keys, F.struct(*rest).alias("after"))
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").when(~F.col("before").eqNullSafe(F.col("after")), "update")
    return old.join(new, keys, "full").withColumn("op", op).where("op is not null").select(*keys, "op", "before", "after")


def get_changes(log: DataFrame, from_seq: int, limit: int = 1000, cf: str | None = None, ops: list[str] | None = None) -> DataFrame:
    """The first `limit` changes behind from_seq in order, of one column family and some operations if given."""
    rows = log.where(F.col("seq") > from_seq)
    if cf is not None:
        rows = rows.where(F.col("cf") == cf)
    if ops is not None:
        rows = rows.where(F.col("op").isin(ops))
    return rows.orderBy("seq").limit(limit)


def record(log: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """The log with new(op, cf, key, value, and the columns of `order`) behind its end: each gets the next seq, in order."""
    end = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("end")).first()["end"]
    numbered = row_numbers(new, [], order)
    return log.select("seq", "op", "cf", "key", "value").unionByName(numbered.select((F.col("rn") + end).cast("long").alias("seq"), "op", "cf", "key", "value"))


def subscribe(log: DataFrame, start: str | int = "latest", cf: str | None = None, ops: list[str] | None = None) -> tuple[DataFrame, int]:
    """What a subscription is given at once, and the seq that it goes on behind: nothing of the past from 'latest', all from 'earliest', else what is behind a seq."""
    end = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("end")).first()["end"]
    after = {"latest": end, "earliest": 0}.get(start, start)
    if not isinstance(after, int):
        raise ValueError(f"a subscription begins at latest, earliest or a seq, not at {start!r}")
    rows = log.where((F.col("seq") > after) & (F.col("seq") <= end))
    if cf is not None:
        rows = rows.where(F.col("cf") == cf)
    if ops is not None:
        rows = rows.where(F.col("op").isin(ops))
    return rows, max(after, end)


def last_seq(changes: DataFrame, from_seq: int) -> DataFrame:
    """Where to go on; from_seq itself if there was nothing."""
    return changes.agg(F.coalesce(F.max("seq"), F.lit(from_seq)).alias("last_seq"))


def replay(log: DataFrame, keys: list[str]) -> DataFrame:
    """The table that a log of (seq, op, keys, value columns) leaves: each key's last change, deletions dropped."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("last"))
    return last.select(*keys, "last.*").where("op <> 'delete'")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with rows put in place of those of equal keys."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def update_where(table: DataFrame, predicate: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(predicate, F.lit(False))
    return table.withColumns({c: F.when(hit, v.cast(table.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(table: DataFrame, predicate: Column) -> DataFrame:
    """Without the rows that the predicate holds for; it being null keeps a row."""
    return table.where(~F.coalesce(predicate, F.lit(False)))


def first_results(requests: DataFrame, key: str, order: list[str], ttl: int | None = None, time: str = "ts") -> DataFrame:
    """Idempotent processing: each key's first result stands for later requests, until `ttl` has passed since it."""
    first = requests.groupBy(key).agg(F.min_by("result", F.struct(*order)).alias("stored"), F.min(time).alias("first_time"))
    met = requests.join(first, key)
    late = F.lit(False) if ttl is None else F.col(time) - F.col("first_time") >= ttl
    return met.withColumn("answer", F.when(late, F.col("result")).otherwise(F.col("stored"))).drop("stored", "first_time")


def offsets(log: DataFrame, acks: DataFrame, consumers: list[str]) -> DataFrame:
    """consumer, offset: the last acknowledged seq, 0 without one; never above the log's end."""
    spark = log.sparkSession
    end = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("end"))
    asked = spark.createDataFrame([(c,) for c in consumers], "consumer string")
    own = acks.groupBy("consumer").agg(F.max("seq").alias("seq"))
    return asked.join(own, "consumer", "left").crossJoin(F.broadcast(end)).select("consumer", F.least(F.coalesce("seq", F.lit(0)), F.col("end")).alias("offset"))  # `end` is one row


def any_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates, F.lit(False))
