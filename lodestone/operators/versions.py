"""Reads of a version table: versions(key, value, start_ts, commit_ts, is_delete)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled
from .ordered import row_numbers, running_max


def snapshot(versions: DataFrame, at: int, own_writes: DataFrame | None = None) -> DataFrame:
    """key, value as of `at`: the newest version committed by then, deletions dropped. A transaction's own writes come first."""
    rows = versions.where(F.col("commit_ts") <= at).select("key", "value", "commit_ts", "is_delete", F.lit(0).alias("own"))
    if own_writes is not None:
        rows = rows.unionByName(own_writes.select("key", "value", F.lit(at).cast("long").alias("commit_ts"), "is_delete", F.lit(1).alias("own")))
    newest = rows.groupBy("key").agg(F.max_by(F.struct("value", "is_delete"), F.struct("own", "commit_ts")).alias("v"))
    return newest.where("not v.is_delete").select("key", "v.value")


def write_conflicts(transactions: DataFrame, versions: DataFrame) -> DataFrame:
    """txn, key that transactions(txn, start_ts, key) would write although another version was committed since they began."""
    newest = versions.groupBy("key").agg(F.max("commit_ts").alias("commit_ts"))
    return transactions.join(newest, "key").where("commit_ts > start_ts").select("txn", "key", "commit_ts")


def _two(rows: DataFrame, at: str, largest: bool) -> DataFrame:
    """key, top and other: a key's outermost (at, txn), and the outermost of any other transaction. Partial aggregates only: no key is one task's."""
    best = F.max if largest else F.min
    own = rows.groupBy("key", "txn").agg(best(at).alias("at"))
    top = own.groupBy("key").agg(best(F.struct("at", "txn")).alias("top"))
    other = own.join(top, "key").where("txn <> top.txn").groupBy("key").agg(best(F.struct("at", "txn")).alias("other"))
    return top.join(other, "key", "left")


def read_conflicts(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """reads(txn, start_ts, key) that another transaction of writes(txn, commit_ts, key) changed after the read began: txn, key, start_ts and the
    last_writer and last_commit of such a write. A row a read: no pairs of a key's reads and writes are made.
    """
    met = reads.select("txn", "key", "start_ts").distinct().join(_two(writes, "commit_ts", True), "key")
    last = F.when(F.col("txn") != F.col("top.txn"), F.col("top")).otherwise(F.col("other"))
    return met.withColumn("last", last).where("last.at > start_ts").select("txn", "key", "start_ts", F.col("last.txn").alias("last_writer"), F.col("last.at").alias("last_commit"))


def pivot_transactions(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Transactions that read what another one changed later, and changed what another one had read: the ones a serialisable run must stop."""
    met = writes.join(_two(reads, "start_ts", False), "key")
    first = F.when(F.col("txn") != F.col("top.txn"), F.col("top")).otherwise(F.col("other"))
    changed = met.withColumn("first", first).where("first.at < commit_ts").select("txn").distinct()
    return read_conflicts(reads, writes).select("txn").distinct().join(changed, "txn")


def rollback_to(writes: DataFrame, savepoint: int) -> DataFrame:
    """A transaction's own writes(n, key, value, is_delete), n in order, as they were at a savepoint: the newest of each key up to it."""
    newest = writes.where(F.col("n") <= savepoint).groupBy("key").agg(F.max_by(F.struct("value", "is_delete"), "n").alias("v"))
    return newest.select("key", "v.*")


def timestamps(requests: DataFrame, order: list[str], last: tuple[int, int] = (0, 0), bits: int = 18) -> DataFrame:
    """requests(ms) get ts: a clock's milliseconds above `bits` of a counter. Larger than `last` (ms, counter) and than any before it, also where the clock went back."""
    rows = running_max(requests, [], order, "ms", "__top")
    at = rows.withColumn("__ms", F.greatest("ms", F.coalesce("__top", F.lit(0)), F.lit(last[0]).cast("long")))
    numbered = row_numbers(at, ["__ms"], order)
    counter = F.col("rn") - 1 + F.when(F.col("__ms") == last[0], F.lit(last[1] + 1)).otherwise(F.lit(0))
    return numbered.select(*requests.columns, (F.col("__ms") * (1 << bits) + counter).cast("long").alias("ts"))


def deadlocked(waits: DataFrame, most_steps: int = 32) -> DataFrame:
    """Transactions on a cycle of waits(waiter, holder).

    Waits of transactions that nobody waits for, or that wait for nobody, are on no cycle: they are peeled off until nothing changes. Of what is left
    every step doubles the paths and keeps pairs distinct, until nothing changes.
    """
    left, size = settled(waits.select("waiter", "holder").distinct()), -1
    while (now := left.count()) not in (size, 0):
        size = now
        held = left.select(F.col("holder").alias("waiter")).distinct()
        waiting = left.select(F.col("waiter").alias("holder")).distinct()
        left = settled(left.join(held, "waiter", "left_semi").join(waiting, "holder", "left_semi").select("waiter", "holder"))
    reach, size = left, -1
    for _ in range(most_steps):
        reach = settled(reach.unionByName(reach.alias("a").join(reach.alias("b"), F.col("a.holder") == F.col("b.waiter")).select("a.waiter", "b.holder")).distinct())
        now = reach.count()
        if now == size:
            return reach.where("waiter = holder").select(F.col("waiter").alias("txn")).distinct()
        size = now
    raise RuntimeError(f"waits are not settled after {most_steps} steps")
