"""Ordered event logs as DataFrames: entries(stream, ms, seq, fields), groups, and pending entries.

An entry's id is the pair (ms, seq). Reads are filters in id order; changes return the new table. `now` is always a parameter.

    pel(stream, grp, ms, seq, consumer, delivered_at, delivery_count)
    groups(stream, grp, last_ms, last_seq, entries_read)
"""

from __future__ import annotations

import time as _time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled
from .ordered import row_numbers, running_max

ID = ["ms", "seq"]
MIN_ID, MAX_ID = (0, 0), (9999999999999999, 9999999999)


def after(ms: int, seq: int) -> Column:
    return (F.col("ms") > ms) | ((F.col("ms") == ms) & (F.col("seq") > seq))


def at_least(ms: int, seq: int) -> Column:
    return (F.col("ms") > ms) | ((F.col("ms") == ms) & (F.col("seq") >= seq))


def between(low: tuple[int, int], high: tuple[int, int]) -> Column:
    return at_least(*low) & ~after(*high)


def parse_id(text: str, missing_seq: int = 0) -> tuple[int, int]:
    """'-' and '+' are the ends; 'ms' alone has the given seq."""
    if text == "-":
        return MIN_ID
    if text == "+":
        return MAX_ID
    ms, _, seq = text.partition("-")
    return int(ms), int(seq) if seq else missing_seq


def format_id(ms: Column, seq: Column) -> Column:
    return F.concat_ws("-", ms.cast("string"), seq.cast("string"))


def assign_ids(arrivals: DataFrame, order: list[str]) -> DataFrame:
    """arrivals(stream, ms, ...) get seq: their place among those of the same stream and millisecond, in `order`."""
    return arrivals.withColumn("seq", F.row_number().over(Window.partitionBy("stream", "ms").orderBy(*order)).cast("long") - 1)


def append(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Adds new(stream, ms, seq, fields); those whose id isn't above the stream's last are left out."""
    last = entries.groupBy("stream").agg(F.max(F.struct(*ID)).alias("last"))
    fresh = new.join(last, "stream", "left").where(F.col("last").isNull() | (F.struct(*ID) > F.col("last"))).drop("last")
    return entries.unionByName(fresh)


def add(entries: DataFrame, arrivals: DataFrame, order: list[str], most: int | None = None, only_existing: bool = False) -> DataFrame:
    """Adds arrivals(stream, ms, fields, and the columns of `order`), ms being the clock; ids are given in order.

    Where the clock is behind the stream's last id, or behind an arrival before, the larger milliseconds stay and seq goes on, so ids always rise. `most`
    then keeps the newest entries of the streams that were added to; only_existing adds to no new stream. Runs jobs over the arrivals, whose ids are written once.
    """
    last = entries.groupBy("stream").agg(F.max(F.struct(*ID)).alias("last"))
    new = settled(arrivals.join(last, "stream", "inner" if only_existing else "left"))
    topped = running_max(new, ["stream"], order, "ms", "__top")
    timed = settled(topped.withColumn("__ms", F.greatest("ms", "__top", "last.ms")))
    seq = F.col("rn") - 1 + F.when(F.col("__ms") == F.col("last.ms"), F.col("last.seq") + 1).otherwise(F.lit(0))
    made = settled(row_numbers(timed, ["stream", "__ms"], order).select("stream", F.col("__ms").alias("ms"), seq.cast("long").alias("seq"), "fields"))
    both = entries.unionByName(made)
    if most is None:
        return both
    touched = made.select("stream").distinct()
    return trim_maxlen(both.join(touched, "stream", "left_semi"), most).unionByName(both.join(touched, "stream", "left_anti"))


def length(entries: DataFrame) -> DataFrame:
    return entries.groupBy("stream").agg(F.count(F.lit(1)).alias("length"))


def range_(entries: DataFrame, stream: str, low: tuple[int, int] = MIN_ID, high: tuple[int, int] = MAX_ID, count: int | None = 100, newest_first: bool = False) -> DataFrame:
    """Entries from low to high, both inclusive; newest first takes the newest `count`."""
    order = [F.col(c).desc() if newest_first else F.col(c).asc() for c in ID]
    rows = entries.where((F.col("stream") == stream) & between(low, high)).orderBy(*order)
    return rows if count is None else rows.limit(count)


def read(entries: DataFrame, after_ids: dict[str, tuple[int, int]], count: int = 100) -> DataFrame:
    """For each stream of after_ids the first `count` entries strictly behind its id."""
    wanted = F.lit(False)
    for stream, (ms, seq) in after_ids.items():
        wanted = wanted | ((F.col("stream") == stream) & after(ms, seq))
    order = Window.partitionBy("stream").orderBy(*ID)
    return entries.where(wanted).withColumn("n", F.row_number().over(order)).where(F.col("n") <= count).drop("n")


def read_waiting(load: Callable[[], DataFrame], after_ids: dict[str, tuple[int, int]], count: int = 100, block_ms: int = 0, step_ms: int = 100) -> DataFrame:
    """Reads as read() does; while there is nothing, looks again at what load() gives until block_ms have passed."""
    until = _time.monotonic() + block_ms / 1000
    while True:
        found = read(load(), after_ids, count)
        if _time.monotonic() >= until or not found.isEmpty():
            return found
        _time.sleep(min(step_ms / 1000, max(0.0, until - _time.monotonic())))


def last_ids(entries: DataFrame) -> DataFrame:
    """stream, ms, seq of the newest entry: where '$' begins."""
    return entries.groupBy("stream").agg(F.max(F.struct(*ID)).alias("m")).select("stream", "m.ms", "m.seq")


def info(entries: DataFrame) -> DataFrame:
    first, last = F.min(F.struct(*ID)), F.max(F.struct(*ID))
    rows = entries.groupBy("stream").agg(F.count(F.lit(1)).alias("length"), first.alias("f"), last.alias("l"))
    return rows.select("stream", "length", F.col("f.ms").alias("first_ms"), F.col("f.seq").alias("first_seq"), F.col("l.ms").alias("last_ms"), F.col("l.seq").alias("last_seq"))


def delete(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Without ids(stream, ms, seq)."""
    return entries.join(ids.select("stream", *ID), ["stream", *ID], "left_anti")


def trim_maxlen(entries: DataFrame, most: int) -> DataFrame:
    """The newest `most` entries of each stream. Places come from ranges of ids, so a long stream is not sorted by one task."""
    return row_numbers(entries, ["stream"], ID).where(F.col("rn") > F.col("total") - most).select(*entries.columns)


def trim_minid(entries: DataFrame, ms: int, seq: int = 0) -> DataFrame:
    return entries.where(at_least(ms, seq))


def trim_age(entries: DataFrame, now: int, retention_ms: int) -> DataFrame:
    return entries.where(F.col("ms") >= now - retention_ms)


def create_group(groups: DataFrame, stream: str, grp: str, start: tuple[int, int]) -> DataFrame:
    """Adds a group whose cursor is `start`; one that is there already is an error. Looks into the groups at once, which is a job over that small table."""
    if groups.where((F.col("stream") == stream) & (F.col("grp") == grp)).limit(1).count():
        raise ValueError(f"BUSYGROUP {grp} of {stream} is there already")
    return groups.unionByName(groups.sparkSession.createDataFrame([(stream, grp, *start, 0)], groups.schema))


def set_group_id(groups: DataFrame, stream: str, grp: str, to: tuple[int, int]) -> DataFrame:
    hit = (F.col("stream") == stream) & (F.col("grp") == grp)
    return groups.withColumns({"last_ms": F.when(hit, F.lit(to[0])).otherwise(F.col("last_ms")), "last_seq": F.when(hit, F.lit(to[1])).otherwise(F.col("last_seq"))})


def destroy_group(groups: DataFrame, pel: DataFrame, stream: str, grp: str) -> tuple[DataFrame, DataFrame]:
    other = ~((F.col("stream") == stream) & (F.col("grp") == grp))
    return groups.where(other), pel.where(other)


def delete_consumer(pel: DataFrame, stream: str, grp: str, consumer: str) -> tuple[DataFrame, int]:
    """The pending entries without the consumer's, and how many those were."""
    own = (F.col("stream") == stream) & (F.col("grp") == grp) & (F.col("consumer") == consumer)
    return pel.where(~own), pel.where(own).count()


def read_group(entries: DataFrame, groups: DataFrame, grp: str, consumer: str, now: int, count: int = 100, no_ack: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New entries of all streams of the group: what is delivered, the groups with moved cursors, the pending entries to add."""
    own = groups.where(F.col("grp") == grp)
    behind = entries.join(own.select("stream", "last_ms", "last_seq"), "stream").where(F.struct(*ID) > F.struct("last_ms", "last_seq"))
    order = Window.partitionBy("stream").orderBy(*ID)
    given = behind.withColumn("n", F.row_number().over(order)).where(F.col("n") <= count).drop("n", "last_ms", "last_seq")
    moved = given.groupBy("stream").agg(F.max(F.struct(*ID)).alias("m"), F.count(F.lit(1)).alias("got")).withColumn("grp", F.lit(grp))
    new_groups = groups.join(moved, ["stream", "grp"], "left").select(
        "stream", "grp", F.coalesce("m.ms", "last_ms").alias("last_ms"), F.coalesce("m.seq", "last_seq").alias("last_seq"), (F.col("entries_read") + F.coalesce("got", F.lit(0))).alias("entries_read")
    )
    pending = given.select("stream", F.lit(grp).alias("grp"), *ID, F.lit(consumer).alias("consumer"), F.lit(now).cast("long").alias("delivered_at"), F.lit(1).alias("delivery_count"))
    return given, new_groups, pending.limit(0) if no_ack else pending


def pending_of(pel: DataFrame, entries: DataFrame, stream: str, grp: str, consumer: str) -> DataFrame:
    """A consumer's own pending entries: what a group read from 0 gives."""
    own = pel.where((F.col("stream") == stream) & (F.col("grp") == grp) & (F.col("consumer") == consumer))
    return entries.join(own.select("stream", *ID), ["stream", *ID], "left_semi")


def ack(pel: DataFrame, acks: DataFrame) -> DataFrame:
    """Without acks(stream, grp, ms, seq)."""
    return pel.join(acks.select("stream", "grp", *ID), ["stream", "grp", *ID], "left_anti")


def pending_summary(pel: DataFrame) -> DataFrame:
    """stream, grp, consumer, n, least and largest id of each consumer's pending entries."""
    rows = pel.groupBy("stream", "grp", "consumer").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ID)).alias("lo"), F.max(F.struct(*ID)).alias("hi"))
    return rows.select("stream", "grp", "consumer", "n", F.col("lo.ms").alias("min_ms"), F.col("lo.seq").alias("min_seq"), F.col("hi.ms").alias("max_ms"), F.col("hi.seq").alias("max_seq"))


def pending_detail(pel: DataFrame, now: int, low: tuple[int, int] = MIN_ID, high: tuple[int, int] = MAX_ID, count: int = 100, consumer: str | None = None, min_idle: int = 0) -> DataFrame:
    rows = pel.where(between(low, high) & (now - F.col("delivered_at") >= min_idle))
    if consumer is not None:
        rows = rows.where(F.col("consumer") == consumer)
    detail = rows.select("stream", "grp", *ID, "consumer", (F.lit(now) - F.col("delivered_at")).alias("idle_ms"), "delivery_count")
    order = Window.partitionBy("stream", "grp").orderBy(*ID)
    return detail.withColumn("n", F.row_number().over(order)).where(F.col("n") <= count).drop("n")


def claim(pel: DataFrame, ids: DataFrame, consumer: str, now: int, min_idle: int, just_id: bool = False, idle: int | None = None, time: int | None = None, retry_count: int | None = None, force_from: DataFrame | None = None) -> DataFrame:
    """Pending entries after `consumer` claims those of ids(stream, grp, ms, seq) that are idle long enough.

    idle or time set when they count as delivered (now - idle, or time), retry_count how often. force_from: the entries; ids of those that are pending
    for nobody become pending, as delivered once.
    """
    at = now if idle is None and time is None else time if time is not None else now - idle
    if force_from is not None:
        absent = ids.select("stream", "grp", *ID).distinct().join(force_from.select("stream", *ID), ["stream", *ID], "left_semi").join(pel, ["stream", "grp", *ID], "left_anti")
        made = absent.select("stream", "grp", *ID, F.lit(consumer).alias("consumer"), F.lit(at).cast("long").alias("delivered_at"), F.lit(1 if retry_count is None else retry_count).alias("delivery_count"))
        return claim(pel, ids, consumer, now, min_idle, just_id, idle, time, retry_count).unionByName(made)
    again = F.lit(retry_count) if retry_count is not None else F.col("delivery_count") + (0 if just_id else 1)
    wanted = ids.select("stream", "grp", *ID).distinct().withColumn("asked", F.lit(True))
    rows = pel.join(wanted, ["stream", "grp", *ID], "left")
    hit = F.col("asked").isNotNull() & (now - F.col("delivered_at") >= min_idle)
    return rows.select(
        "stream",
        "grp",
        *ID,
        F.when(hit, F.lit(consumer)).otherwise(F.col("consumer")).alias("consumer"),
        F.when(hit, F.lit(at).cast("long")).otherwise(F.col("delivered_at")).alias("delivered_at"),
        F.when(hit, again).otherwise(F.col("delivery_count")).alias("delivery_count"),
    )


def autoclaim(pel: DataFrame, now: int, min_idle: int, start: tuple[int, int] = MIN_ID, count: int = 100) -> DataFrame:
    """Ids (stream, grp, ms, seq) that an autoclaim from `start` takes: the first `count` idle ones of each group."""
    idle = pel.where(at_least(*start) & (now - F.col("delivered_at") >= min_idle))
    order = Window.partitionBy("stream", "grp").orderBy(*ID)
    return idle.withColumn("n", F.row_number().over(order)).where(F.col("n") <= count).select("stream", "grp", *ID)


def autoclaim_state(pel: DataFrame, entries: DataFrame, consumer: str, now: int, min_idle: int, start: tuple[int, int] = MIN_ID, count: int = 100, just_id: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An autoclaim in full: the new pending entries, what was claimed (stream, grp, ms, seq; deleted: no longer among the entries, so no longer
    pending either), and for each group the id where the next one goes on (0-0 at the end).
    """
    idle = pel.where(at_least(*start) & (now - F.col("delivered_at") >= min_idle))
    order = Window.partitionBy("stream", "grp").orderBy(*ID)
    ranked = idle.withColumn("n", F.row_number().over(order)).where(F.col("n") <= count + 1)
    there = entries.select("stream", *ID, F.lit(False).alias("gone"))
    taken = ranked.where(F.col("n") <= count).join(there, ["stream", *ID], "left").select("stream", "grp", *ID, F.coalesce("gone", F.lit(True)).alias("deleted"))
    state = claim(ack(pel, taken.where("deleted")), taken.where("not deleted"), consumer, now, min_idle, just_id)
    behind = ranked.where(F.col("n") == count + 1).select("stream", "grp", F.col("ms").alias("next_ms"), F.col("seq").alias("next_seq"))
    zero = F.lit(0).cast("long")
    cursors = pel.select("stream", "grp").distinct().join(behind, ["stream", "grp"], "left").select("stream", "grp", F.coalesce("next_ms", zero).alias("next_ms"), F.coalesce("next_seq", zero).alias("next_seq"))
    return state, taken, cursors


def group_info(groups: DataFrame, pel: DataFrame) -> DataFrame:
    counts = pel.groupBy("stream", "grp").agg(F.count_distinct("consumer").alias("consumers"), F.count(F.lit(1)).alias("pending"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return groups.join(counts, ["stream", "grp"], "left").select("stream", "grp", zero("consumers"), zero("pending"), "last_ms", "last_seq", "entries_read")


def consumer_info(pel: DataFrame, now: int) -> DataFrame:
    return pel.groupBy("stream", "grp", "consumer").agg(F.count(F.lit(1)).alias("pending"), (F.lit(now) - F.max("delivered_at")).alias("idle_ms"))
