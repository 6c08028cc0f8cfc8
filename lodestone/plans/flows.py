"""Event time: windows, sessions, lateness and deduplication, over batches and as streams run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import interval_join
from ..registry import query
from ..session import table
from ..streaming import run, windows
from .stores import entries



def _aggs() -> list[F.Column]:
    return [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total")]


_DAY = "SELECT event_type, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2, 3"
_SESSION = """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, count(*) AS n, round(sum(value), 3) AS total FROM s GROUP BY user_id, k"""


@query(_DAY)
def time_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return windows.tumbling(table(spark, d, "events"), "ts", "1 day", ["event_type"], _aggs())


@query("SELECT event_type, w AS window_start, w + INTERVAL 2 DAY AS window_end, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT *, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS w FROM events) GROUP BY 1, 2, 3")
def time_sliding(spark: SparkSession, d: str) -> DataFrame:
    return windows.sliding(table(spark, d, "events"), "ts", "2 days", "1 day", ["event_type"], _aggs())


@query(_SESSION)
def time_sessions(spark: SparkSession, d: str) -> DataFrame:
    return windows.sessions(table(spark, d, "events"), "ts", "6 hours", ["user_id"], _aggs())


@query("SELECT max(ts) AS high FROM events")
def time_high_watermark(spark: SparkSession, d: str) -> DataFrame:
    return windows.high_watermark(table(spark, d, "events"), "ts")


@query("WITH a AS (SELECT event_id, ts, max(ts) OVER (ORDER BY (event_id * 7919) % 100003, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM events) SELECT event_id FROM a WHERE ts < high - INTERVAL 20 DAY")
def time_late_events(spark: SparkSession, d: str) -> DataFrame:
    arrived = table(spark, d, "events").withColumn("arrival", F.struct((F.col("event_id") * 7919 % 100003).alias("a"), "event_id"))
    shuffled = arrived.withColumn("arrival", F.col("arrival.a") * 1_000_000_000 + F.col("event_id"))
    return windows.late(shuffled, "ts", "arrival", "20 days").select("event_id")


@query("SELECT DISTINCT user_id, event_type FROM events")
def time_deduplicate(spark: SparkSession, d: str) -> DataFrame:
    return windows.deduplicate(table(spark, d, "events"), "ts", ["user_id", "event_type"], "40 days").select("user_id", "event_type")


@query("SELECT event_id, date_trunc('hour', ts) AS hour, r.n FROM events e JOIN (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1) r ON e.ts >= r.h AND e.ts < r.h + INTERVAL 1 HOUR")
def join_range(spark: SparkSession, d: str) -> DataFrame:
    """A range join by buckets: both sides are dealt by the hour, and the exact bounds hold within it."""
    own = table(spark, d, "events").withColumn("bucket", F.date_trunc("hour", "ts"))
    hours = own.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    inside = (F.col("ts") >= F.col("bucket")) & (F.col("ts") < F.col("bucket") + F.expr("interval 1 hour"))
    return own.join(hours, "bucket").where(inside).select("event_id", F.col("bucket").cast("timestamp_ntz").alias("hour"), "n")


@query("SELECT o_orderkey, n_name FROM orders JOIN (SELECT n_name, n_nationkey * 9000.0 AS low, n_nationkey * 9000.0 + 14000.0 AS high FROM nation) n ON o_totalprice >= low AND o_totalprice < high")
def join_interval(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping bands of prices: an equi-join on buckets as wide as the bands, salted."""
    bands = table(spark, d, "nation").select("n_name", (F.col("n_nationkey") * 9000.0).alias("low"), (F.col("n_nationkey") * 9000.0 + 14000.0).alias("high"))
    return interval_join(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), bands, "o_totalprice", "low", "high", 14000, salts=4).select("o_orderkey", "n_name")


@query("""SELECT p.event_id, v.event_id AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN LATERAL (SELECT event_id FROM events e WHERE e.event_type = 'view' AND e.user_id = p.user_id AND e.ts <= p.ts ORDER BY e.ts DESC, e.event_id DESC LIMIT 1) v ON true""")
def join_asof(spark: SparkSession, d: str) -> DataFrame:
    """As-of join by one sorted pass of both sides together: the last view that is not later than the purchase."""
    from pyspark.sql import Window

    own = table(spark, d, "events").where(F.col("event_type").isin("purchase", "view")).select("event_id", "user_id", "ts", "event_type")
    is_view = F.col("event_type") == "view"
    in_time = Window.partitionBy("user_id").orderBy("ts", F.when(is_view, 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = own.withColumn("last_view", F.last(F.when(is_view, F.col("event_id")), ignorenulls=True).over(in_time))
    return seen.where("event_type = 'purchase'").select("event_id", "last_view")


# The same as streams: read with availableNow, written by idempotent batches.


@query(_DAY)
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    source = run.stream_table(spark, f"{d}/events.parquet")
    return run.run_to_table(windows.tumbling(source, "ts", "1 day", ["event_type"], _aggs(), "1 day"), "complete")


@query("SELECT event_type, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, count(*) AS n, round(sum(value), 3) AS total FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2, 3")
def stream_tumbling_append(spark: SparkSession, d: str) -> DataFrame:
    """Append mode emits the windows that the last watermark has closed."""
    source = run.stream_table(spark, f"{d}/events.parquet")
    return run.run_to_table(windows.tumbling(source, "ts", "1 day", ["event_type"], _aggs(), "1 day"), "append")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_deduplicate(spark: SparkSession, d: str) -> DataFrame:
    source = run.stream_table(spark, f"{d}/events.parquet")
    return run.run_to_table(windows.deduplicate(source, "ts", ["user_id", "event_type"], "400 days").select("user_id", "event_type"), "append")


@query("SELECT e.event_id, u.n FROM events e JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) u USING (user_id) WHERE e.event_type = 'purchase'")
def stream_static_join(spark: SparkSession, d: str) -> DataFrame:
    source = run.stream_table(spark, f"{d}/events.parquet").where("event_type = 'purchase'")
    users = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return run.run_to_table(source.join(users, "user_id").select("event_id", "n"), "append")


@query("SELECT DISTINCT a.event_id AS purchase, b.event_id AS view FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts WHERE a.event_type = 'purchase' AND b.event_type = 'view'")
def stream_stream_join(spark: SparkSession, d: str) -> DataFrame:
    source = lambda: run.stream_table(spark, f"{d}/events.parquet")
    bought = windows.event_time(source().where("event_type = 'purchase'"), "ts", "40 days").select(F.col("event_id").alias("purchase"), F.col("user_id").alias("buyer"), F.col("ts").alias("bought"))
    seen = windows.event_time(source().where("event_type = 'view'"), "ts", "40 days").select(F.col("event_id").alias("view"), "user_id", F.col("ts").alias("seen"))
    near = F.expr("buyer = user_id and seen between bought - interval 1 hour and bought")
    return run.run_to_table(bought.join(seen, near).select("purchase", "view"), "append")


@query("WITH e AS (SELECT event_type AS stream, ms, CAST(row_number() OVER (PARTITION BY event_type, ms ORDER BY event_id) - 1 AS BIGINT) AS seq FROM (SELECT *, epoch_us(ts) // 1000 AS ms FROM events)), m AS (SELECT stream, max(row(ms, seq)) AS l, count(*) AS entries_read FROM e GROUP BY 1) SELECT stream, struct_extract(l, 1) AS last_ms, struct_extract(l, 2) AS last_seq, entries_read FROM m")
def stream_group_state(spark: SparkSession, d: str) -> DataFrame:
    """A consumer group's cursor as keyed state; of each stream's updates the last one counts."""
    folder = run.work_folder(spark)
    entries(spark, d).select("stream", "ms", "seq").write.parquet(f"{folder}/entries")
    updates = run.run_to_table(run.group_cursor(run.stream_table(spark, f"{folder}/entries")), "update")
    return updates.groupBy("stream").agg(F.max_by(F.struct("last_ms", "last_seq", "entries_read"), "batch").alias("u")).select("stream", "u.*")
