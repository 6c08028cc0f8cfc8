"""Key-value, stream, change, version, vector and metadata queries over the standard tables.

`events` stands for streams (stream = event_type, ms = epoch milliseconds of ts), for key-value pairs (key = user_id), and for versions;
`orders` for a change log. Times are literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, kv, meta, streams, vectors, versions
from ..registry import query
from ..session import table

NOW = 1_706_000_000_000
_E = "e AS (SELECT event_type AS stream, ms, CAST(row_number() OVER (PARTITION BY event_type, ms ORDER BY event_id) - 1 AS BIGINT) AS seq, event_id, user_id FROM (SELECT *, epoch_us(ts) // 1000 AS ms FROM events))"
_P = f"{_E}, pel AS (SELECT stream, 'g' AS grp, ms, seq, 'c' || (user_id % 4) AS consumer, ms AS delivered_at, CAST(1 + event_id % 3 AS INTEGER) AS delivery_count FROM e WHERE event_id % 3 <> 0)"
_K = "kv AS (SELECT user_id AS key, max_by(event_type, event_id) AS value, CASE WHEN user_id % 3 = 0 THEN NULL ELSE max(epoch_us(ts) // 1000) + 200000000 END AS expiry FROM events GROUP BY user_id)"
_V = "v AS (SELECT user_id AS key, CAST(value AS VARCHAR) AS value, event_id - 1 AS start_ts, event_id AS commit_ts, event_type = 'error' AS is_delete FROM events)"


def _ms() -> F.Column:
    return F.expr("unix_micros(cast(ts as timestamp)) div 1000")


def entries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_type").alias("stream"), _ms().alias("ms"), "event_id", "user_id")
    return streams.assign_ids(rows, ["event_id"])


def pel(spark: SparkSession, d: str) -> DataFrame:
    rows = entries(spark, d).where("event_id % 3 <> 0")
    return rows.select("stream", F.lit("g").alias("grp"), "ms", "seq", F.concat(F.lit("c"), F.col("user_id") % 4).alias("consumer"), F.col("ms").alias("delivered_at"), (1 + F.col("event_id") % 3).cast("int").alias("delivery_count"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.max_by("event_type", "event_id").alias("value"), F.max(_ms()).alias("last"))
    return rows.select("key", "value", F.when(F.col("key") % 3 != 0, F.col("last") + 200_000_000).alias("expiry"))


def version_table(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), (F.col("event_id") - 1).alias("start_ts"), F.col("event_id").alias("commit_ts"), (F.col("event_type") == "error").alias("is_delete"))


# Streams.


@query(f"WITH {_E} SELECT stream, ms, seq, event_id FROM e")
def stream_ids(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("stream", "ms", "seq", "event_id")


@query(f"WITH {_E} SELECT stream, count(*) AS length FROM e GROUP BY 1")
def stream_length(spark: SparkSession, d: str) -> DataFrame:
    return streams.length(entries(spark, d))


@query(f"WITH {_E} SELECT stream, ms, seq, event_id FROM e WHERE stream = 'click' AND ms BETWEEN 1705000000000 AND 1705500000000 ORDER BY ms, seq LIMIT 100")
def stream_range(spark: SparkSession, d: str) -> DataFrame:
    return streams.range_(entries(spark, d), "click", (1705000000000, 0), (1705500000000, 1 << 40)).select("stream", "ms", "seq", "event_id")


@query(f"WITH {_E} SELECT stream, ms, seq, event_id FROM e WHERE stream = 'view' ORDER BY ms DESC, seq DESC LIMIT 25")
def stream_reverse_range(spark: SparkSession, d: str) -> DataFrame:
    return streams.range_(entries(spark, d), "view", count=25, newest_first=True).select("stream", "ms", "seq", "event_id")


@query(f"WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ms, seq) AS n FROM e WHERE (stream = 'click' AND ms > 1705000000000) OR (stream = 'signup' AND ms > 1706000000000)) SELECT stream, ms, seq, event_id FROM r WHERE n <= 40")
def stream_read_many(spark: SparkSession, d: str) -> DataFrame:
    return streams.read(entries(spark, d), {"click": (1705000000000, 1 << 40), "signup": (1706000000000, 1 << 40)}, 40).select("stream", "ms", "seq", "event_id")


@query(f"WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ms DESC, seq DESC) AS n FROM e) SELECT stream, ms, seq FROM r WHERE n <= 30")
def stream_trim_maxlen(spark: SparkSession, d: str) -> DataFrame:
    return streams.trim_maxlen(entries(spark, d), 30).select("stream", "ms", "seq")


@query(f"WITH {_E} SELECT stream, ms, seq FROM e WHERE ms >= 1706300000000")
def stream_trim_minid(spark: SparkSession, d: str) -> DataFrame:
    return streams.trim_minid(entries(spark, d), 1706300000000).select("stream", "ms", "seq")


@query(f"WITH {_E} SELECT stream, ms, seq FROM e WHERE ms >= {NOW} - 86400000")
def stream_retention(spark: SparkSession, d: str) -> DataFrame:
    return streams.trim_age(entries(spark, d), NOW, 86_400_000).select("stream", "ms", "seq")


@query(f"WITH {_E} SELECT stream, ms, seq FROM e WHERE NOT (user_id % 5 = 0)")
def stream_delete(spark: SparkSession, d: str) -> DataFrame:
    own = entries(spark, d)
    return streams.delete(own, own.where("user_id % 5 = 0")).select("stream", "ms", "seq")


@query(f"WITH {_E}, m AS (SELECT stream, count(*) AS length, min(row(ms, seq)) AS f, max(row(ms, seq)) AS l FROM e GROUP BY 1) SELECT stream, length, f[1] AS first_ms, f[2] AS first_seq, l[1] AS last_ms, l[2] AS last_seq FROM m".replace("f[1]", "struct_extract(f, 1)").replace("f[2]", "struct_extract(f, 2)").replace("l[1]", "struct_extract(l, 1)").replace("l[2]", "struct_extract(l, 2)"))
def stream_info(spark: SparkSession, d: str) -> DataFrame:
    return streams.info(entries(spark, d))


@query(f"WITH {_P}, r AS (SELECT stream, grp, consumer, count(*) AS n, min(row(ms, seq)) AS lo, max(row(ms, seq)) AS hi FROM pel GROUP BY 1, 2, 3) SELECT stream, grp, consumer, n, struct_extract(lo, 1) AS min_ms, struct_extract(lo, 2) AS min_seq, struct_extract(hi, 1) AS max_ms, struct_extract(hi, 2) AS max_seq FROM r")
def group_pending_summary(spark: SparkSession, d: str) -> DataFrame:
    return streams.pending_summary(pel(spark, d))


@query(f"WITH {_P}, r AS (SELECT *, {NOW} - delivered_at AS idle_ms, row_number() OVER (PARTITION BY stream, grp ORDER BY ms, seq) AS k FROM pel WHERE ms >= 1704500000000 AND consumer = 'c1' AND {NOW} - delivered_at >= 1000) SELECT stream, grp, ms, seq, consumer, idle_ms, delivery_count FROM r WHERE k <= 20")
def group_pending_detail(spark: SparkSession, d: str) -> DataFrame:
    return streams.pending_detail(pel(spark, d), NOW, (1704500000000, 0), count=20, consumer="c1", min_idle=1000)


@query(f"WITH {_P} SELECT stream, ms, seq, consumer FROM pel WHERE NOT (ms % 2 = 0)")
def group_ack(spark: SparkSession, d: str) -> DataFrame:
    own = pel(spark, d)
    return streams.ack(own, own.where("ms % 2 = 0")).select("stream", "ms", "seq", "consumer")


@query(f"WITH {_P}, i AS (SELECT *, {NOW} - delivered_at >= 500000000 AND ms % 3 = 0 AS hit FROM pel) SELECT stream, grp, ms, seq, CASE WHEN hit THEN 'boss' ELSE consumer END AS consumer, CASE WHEN hit THEN {NOW} ELSE delivered_at END AS delivered_at, CAST(CASE WHEN hit THEN delivery_count + 1 ELSE delivery_count END AS INTEGER) AS delivery_count FROM i")
def group_claim(spark: SparkSession, d: str) -> DataFrame:
    own = pel(spark, d)
    return streams.claim(own, own.where("ms % 3 = 0"), "boss", NOW, 500_000_000)


@query(f"WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY stream, grp ORDER BY ms, seq) AS k FROM pel WHERE {NOW} - delivered_at >= 300000000) SELECT stream, grp, ms, seq FROM r WHERE k <= 15")
def group_autoclaim(spark: SparkSession, d: str) -> DataFrame:
    return streams.autoclaim(pel(spark, d), NOW, 300_000_000, count=15)


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).groupBy("stream").agg(F.count(F.lit(1)).alias("entries_read")).select("stream", F.lit("g").alias("grp"), F.lit(1705000000000).alias("last_ms"), F.lit(0).cast("long").alias("last_seq"), "entries_read")


@query(f"WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ms, seq) AS k FROM e WHERE row(ms, seq) > row(1705000000000, 0)) SELECT stream, ms, seq, event_id FROM r WHERE k <= 10")
def group_read(spark: SparkSession, d: str) -> DataFrame:
    return streams.read_group(entries(spark, d), _groups(spark, d), "g", "c9", NOW, 10)[0].select("stream", "ms", "seq", "event_id")


@query(f"WITH {_P}, c AS (SELECT stream, count(DISTINCT consumer) AS consumers, count(*) AS pending FROM pel GROUP BY 1), g AS (SELECT stream, count(*) AS entries_read FROM e GROUP BY 1) SELECT g.stream, 'g' AS grp, coalesce(consumers, 0) AS consumers, coalesce(pending, 0) AS pending, 1705000000000 AS last_ms, CAST(0 AS BIGINT) AS last_seq, entries_read FROM g LEFT JOIN c USING (stream)")
def group_info(spark: SparkSession, d: str) -> DataFrame:
    return streams.group_info(_groups(spark, d), pel(spark, d))


@query(f"WITH {_P} SELECT stream, grp, consumer, count(*) AS pending, {NOW} - max(delivered_at) AS idle_ms FROM pel GROUP BY 1, 2, 3")
def group_consumers(spark: SparkSession, d: str) -> DataFrame:
    return streams.consumer_info(pel(spark, d), NOW)


@query(f"WITH {_E}, l AS (SELECT stream, max(ms) AS last_ms, count(*) AS n FROM e WHERE ms < 1705000000000 GROUP BY 1), a AS (SELECT e.stream, event_id, greatest(max(CASE WHEN event_id % 3 = 0 THEN 0 ELSE ms END) OVER (PARTITION BY e.stream ORDER BY event_id), last_ms) AS t, last_ms FROM e JOIN l USING (stream) WHERE ms >= 1705000000000) SELECT stream, event_id, t AS ms, row_number() OVER (PARTITION BY stream, t ORDER BY event_id) - 1 + CASE WHEN t = last_ms THEN 1000 ELSE 0 END AS seq FROM a")
def stream_add(spark: SparkSession, d: str) -> DataFrame:
    """Every third arrival comes with a clock that is behind: it gets the id after the last one. The old entries end with a seq of 999."""
    rows = entries(spark, d)
    old = rows.where("ms < 1705000000000").select("stream", "ms", F.lit(999).cast("long").alias("seq"), F.lit(-1).cast("long").alias("fields"))
    new = rows.where("ms >= 1705000000000").select("stream", F.when(F.col("event_id") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("ms")).alias("ms"), F.col("event_id").alias("fields"), "event_id")
    return streams.add(old, new, ["event_id"]).where("fields >= 0").select("stream", F.col("fields").alias("event_id"), "ms", "seq")


@query(f"WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ms DESC, seq DESC) AS n FROM e) SELECT stream, max(ms) AS last_ms, count(*) AS length FROM r WHERE stream <> 'click' OR n <= 50 GROUP BY 1")
def stream_add_capped(spark: SparkSession, d: str) -> DataFrame:
    """Clicks go to a stream of at most fifty; other streams stay, and none is made."""
    rows = entries(spark, d).withColumn("fields", F.col("event_id"))
    first = rows.where("stream <> 'click'").select("stream", "ms", "seq", "fields").unionByName(spark.createDataFrame([("click", 0, 0, 0)], "stream string, ms long, seq long, fields long"))
    new = rows.where("stream = 'click'").select("stream", "ms", "fields", "event_id").unionByName(spark.createDataFrame([("none", 5, 0, 0)], "stream string, ms long, fields long, event_id long"))
    out = streams.add(first, new, ["ms", "event_id"], 50, only_existing=True)
    return out.groupBy("stream").agg(F.max("ms").alias("last_ms"), F.count(F.lit(1)).alias("length"))


@query(f"WITH {_E} SELECT stream, max(ms) AS ms, max_by(seq, row(ms, seq)) AS seq FROM e GROUP BY 1")
def stream_last_ids(spark: SparkSession, d: str) -> DataFrame:
    return streams.last_ids(entries(spark, d))


@query(f"WITH {_E} SELECT stream, ms, seq FROM e WHERE ms < 1706000000000 OR (stream = 'view' AND ms >= 1706000000000)")
def stream_append(spark: SparkSession, d: str) -> DataFrame:
    """Entries with ids of their own: those that aren't behind the stream's last are left out. Only views come anew."""
    own = entries(spark, d).select("stream", "ms", "seq")
    return streams.append(own.where("ms < 1706000000000"), own.where("stream = 'view'"))


@query("SELECT 'view' AS stream, 'g' AS grp, CAST(7 AS BIGINT) AS last_ms, CAST(1 AS BIGINT) AS last_seq, CAST(0 AS BIGINT) AS entries_read UNION ALL SELECT event_type, 'g', 1705000000000, 0, count(*) FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY event_type")
def group_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """A group goes, another comes and is set to an id."""
    own = _groups(spark, d)
    left, _ = streams.destroy_group(own.where("stream <> 'view'"), pel(spark, d), "click", "g")
    return streams.set_group_id(streams.create_group(left, "view", "g", (0, 0)), "view", "g", (7, 1))


@query(f"WITH {_P} SELECT stream, ms, seq FROM pel WHERE stream = 'click' AND consumer = 'c2'")
def group_pending_of(spark: SparkSession, d: str) -> DataFrame:
    return streams.pending_of(pel(spark, d), entries(spark, d), "click", "g", "c2").select("stream", "ms", "seq")


@query(f"WITH {_P} SELECT stream, consumer, count(*) AS n FROM pel WHERE NOT (stream = 'click' AND consumer = 'c2') GROUP BY ALL")
def group_delete_consumer(spark: SparkSession, d: str) -> DataFrame:
    left, _ = streams.delete_consumer(pel(spark, d), "click", "g", "c2")
    return left.groupBy("stream", "consumer").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_P} SELECT stream, ms, seq, CASE WHEN ms % 3 = 0 AND ms <= {NOW} THEN 'boss' ELSE consumer END AS consumer, CASE WHEN ms % 3 = 0 AND ms <= {NOW} THEN {NOW} - 250 ELSE delivered_at END AS delivered_at, CAST(CASE WHEN ms % 3 = 0 AND ms <= {NOW} THEN 9 ELSE delivery_count END AS INTEGER) AS delivery_count FROM pel UNION ALL SELECT stream, ms, seq, 'boss', {NOW} - 250, 9 FROM e WHERE event_id % 3 = 0 AND ms % 3 = 0")
def group_claim_forced(spark: SparkSession, d: str) -> DataFrame:
    """IDLE, RETRYCOUNT and FORCE: entries that were acknowledged become pending again."""
    own, rows = pel(spark, d), entries(spark, d)
    ids = rows.where("ms % 3 = 0").select("stream", F.lit("g").alias("grp"), "ms", "seq")
    return streams.claim(own, ids, "boss", NOW, 0, idle=250, retry_count=9, force_from=rows).drop("grp")


_AUTO = f"{_P}, r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ms, seq) AS k FROM pel WHERE ms >= 1704300000000 AND {NOW} - delivered_at >= 300000000)"


def _autoclaim(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return streams.autoclaim_state(pel(spark, d), entries(spark, d).where("user_id % 5 <> 0"), "boss", NOW, 300_000_000, (1704300000000, 0), 12)


@query(f"WITH {_AUTO}, t AS (SELECT r.stream, r.ms, r.seq, e.user_id % 5 = 0 AS deleted FROM r JOIN e USING (stream, ms, seq) WHERE k <= 12) SELECT pel.stream, pel.ms, pel.seq, CASE WHEN t.stream IS NULL THEN consumer ELSE 'boss' END AS consumer, CAST(CASE WHEN t.stream IS NULL THEN delivery_count ELSE delivery_count + 1 END AS INTEGER) AS delivery_count FROM pel LEFT JOIN t USING (stream, ms, seq) WHERE t.deleted IS NOT TRUE")
def group_autoclaim_state(spark: SparkSession, d: str) -> DataFrame:
    """What is pending after an autoclaim; entries that were deleted meanwhile are no longer."""
    return _autoclaim(spark, d)[0].select("stream", "ms", "seq", "consumer", "delivery_count")


@query(f"WITH {_AUTO} SELECT p.stream, coalesce(r.ms, 0) AS next_ms, coalesce(r.seq, 0) AS next_seq FROM (SELECT DISTINCT stream FROM pel) p LEFT JOIN (SELECT * FROM r WHERE k = 13) r USING (stream)")
def group_autoclaim_cursor(spark: SparkSession, d: str) -> DataFrame:
    return _autoclaim(spark, d)[2].drop("grp")


# Key-value pairs.


@query(f"WITH {_K} SELECT count(*) AS n FROM (VALUES (3), (4), (5), (99999999), (3)) k(key) JOIN kv USING (key) WHERE expiry IS NULL OR expiry > {NOW}")
def kv_exists(spark: SparkSession, d: str) -> DataFrame:
    return kv.exists(pairs(spark, d), spark.createDataFrame([(3,), (4,), (5,), (99999999,), (3,)], "key long"), NOW)


@query(f"WITH {_K} SELECT key, value FROM kv WHERE key % 4 <> 1")
def kv_delete(spark: SparkSession, d: str) -> DataFrame:
    own = pairs(spark, d)
    return kv.delete(own, own.where("key % 4 = 1")).select("key", "value")


@query(f"WITH {_K} SELECT key, CASE WHEN key % 4 = 0 THEN NULL WHEN key % 4 = 1 THEN {NOW} + 5000 ELSE expiry END AS expiry FROM kv")
def kv_expire(spark: SparkSession, d: str) -> DataFrame:
    """Some keys persist from now on, some get a new expiry."""
    own = pairs(spark, d)
    at = own.where("key % 4 < 2").select("key", F.when(F.col("key") % 4 == 1, F.lit(NOW + 5000)).alias("at"))
    return kv.expire(own, at).select("key", "expiry")


@query(f"WITH {_K} SELECT key, CAST(strlen(value) AS BIGINT) AS length FROM kv WHERE expiry IS NULL OR expiry > {NOW}")
def kv_strlen(spark: SparkSession, d: str) -> DataFrame:
    return kv.strlen(pairs(spark, d), NOW)


@query(f"WITH {_K}, k(ord, key) AS (VALUES (1, 3), (2, 4), (3, 99999999), (4, 3)), l AS (SELECT * FROM kv WHERE expiry IS NULL OR expiry > {NOW}) SELECT k.ord, CAST(k.key AS BIGINT) AS key, l.value, l.key IS NOT NULL AS found FROM k LEFT JOIN l ON l.key = k.key")
def kv_mget(spark: SparkSession, d: str) -> DataFrame:
    return kv.mget(pairs(spark, d), spark.createDataFrame([(1, 3), (2, 4), (3, 99999999), (4, 3)], "ord int, key long"), NOW)


@query(f"WITH {_K} SELECT key, value FROM kv WHERE key = 6 AND (expiry IS NULL OR expiry > {NOW})")
def kv_get(spark: SparkSession, d: str) -> DataFrame:
    return kv.get(pairs(spark, d), 6, NOW)


@query(f"WITH {_K} SELECT key, value FROM kv WHERE key BETWEEN 3 AND 12 ORDER BY key LIMIT 8")
def kv_scan(spark: SparkSession, d: str) -> DataFrame:
    return kv.scan(pairs(spark, d), 3, 12, 8).select("key", "value")


@query(f"WITH {_K} SELECT key, CAST(CASE WHEN expiry IS NULL THEN -1 WHEN expiry <= {NOW} THEN -2 ELSE floor((expiry - {NOW}) / 1000) END AS BIGINT) AS ttl FROM kv")
def kv_ttl(spark: SparkSession, d: str) -> DataFrame:
    return kv.ttl(pairs(spark, d), NOW)


@query(f"WITH {_K} SELECT key, value FROM kv WHERE expiry IS NULL OR expiry > {NOW}")
def kv_sweep(spark: SparkSession, d: str) -> DataFrame:
    return kv.sweep(pairs(spark, d), NOW).select("key", "value")


@query("SELECT user_id AS key, CAST(count(*) AS BIGINT) AS value FROM events GROUP BY 1")
def kv_incr(spark: SparkSession, d: str) -> DataFrame:
    empty = spark.createDataFrame([], "key long, value string, expiry long")
    return kv.incr(empty, table(spark, d, "events").select(F.col("user_id").alias("key"), F.lit(1).alias("delta")), NOW)


@query(f"WITH {_K}, l AS (SELECT * FROM kv WHERE expiry IS NULL OR expiry > {NOW}) SELECT kv.key, coalesce(l.value, '') || '-x' AS value, CAST(strlen(coalesce(l.value, '')) + 2 AS BIGINT) AS length FROM kv LEFT JOIN l USING (key)")
def kv_append(spark: SparkSession, d: str) -> DataFrame:
    own = pairs(spark, d)
    return kv.append(own, own.select("key", F.lit("-x").alias("suffix")), NOW)


@query(f"WITH {_K} SELECT key, CASE WHEN key % 2 = 0 AND (expiry IS NULL OR expiry > {NOW}) THEN 'new' ELSE value END AS value FROM kv WHERE expiry IS NULL OR expiry > {NOW} OR key % 2 <> 0 OR true")
def kv_set_if_present(spark: SparkSession, d: str) -> DataFrame:
    own = pairs(spark, d)
    rows = own.where("key % 2 = 0").select("key", F.lit("new").alias("value"), F.lit(None).cast("long").alias("expiry"))
    return kv.put(own, rows, NOW, "xx").select("key", "value")


# Changes.


@query("""WITH b AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0), a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 11 <> 0)
SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'insert' WHEN a.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS op, b.o_orderstatus AS was, a.o_orderstatus AS now_is
FROM b FULL JOIN a ON a.o_orderkey = b.o_orderkey WHERE b.o_orderkey IS NULL OR a.o_orderkey IS NULL OR a.o_orderstatus <> b.o_orderstatus OR a.o_totalprice <> b.o_totalprice""")
def cdc_snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    before = rows.where("o_orderkey % 10 <> 0")
    after = rows.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "Z").otherwise(F.col("o_orderstatus")))
    found = changes.snapshot_diff(before, after, ["o_orderkey"])
    return found.select("o_orderkey", "op", F.col("before.o_orderstatus").alias("was"), F.col("after.o_orderstatus").alias("now_is"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("o_orderstatus") == "F", "delete").otherwise("put")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), op.alias("op"), F.concat(F.lit("cf"), F.col("o_custkey") % 2).alias("cf"), F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"))


_L = "l AS (SELECT o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN 'delete' ELSE 'put' END AS op, 'cf' || (o_custkey % 2) AS cf, o_custkey AS key, o_totalprice AS value FROM orders)"


@query(f"WITH {_L} SELECT seq, op, key FROM l WHERE seq > 1000 AND cf = 'cf1' ORDER BY seq LIMIT 200")
def cdc_get_changes(spark: SparkSession, d: str) -> DataFrame:
    return changes.get_changes(_log(spark, d), 1000, 200, "cf1").select("seq", "op", "key")


@query(f"WITH {_L}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS k FROM l) SELECT key, seq, value FROM n WHERE k = 1 AND op <> 'delete'")
def cdc_replay(spark: SparkSession, d: str) -> DataFrame:
    return changes.replay(_log(spark, d), ["key"]).select("key", "seq", "value")


@query(f"WITH {_L} SELECT seq, op, cf, key FROM l UNION ALL SELECT (SELECT max(seq) FROM l) + row_number() OVER (ORDER BY c_custkey), 'put', 'tables', c_custkey FROM customer")
def cdc_record(spark: SparkSession, d: str) -> DataFrame:
    """New changes get the numbers behind the log's end."""
    log = _log(spark, d)
    new = table(spark, d, "customer").select(F.lit("put").alias("op"), F.lit("tables").alias("cf"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    return changes.record(log, new, ["key"]).select("seq", "op", "cf", "key")


@query(f"WITH {_L} SELECT seq, op, key, (SELECT max(seq) FROM l) AS next FROM l WHERE seq > 2000 AND cf = 'cf0' AND op = 'put'")
def cdc_subscribe(spark: SparkSession, d: str) -> DataFrame:
    rows, following = changes.subscribe(_log(spark, d), 2000, "cf0", ["put"])
    return rows.select("seq", "op", "key", F.lit(following).alias("next"))


@query("WITH f AS (SELECT user_id, min_by(event_type, event_id) AS answer FROM events GROUP BY 1) SELECT event_id, f.answer FROM events JOIN f USING (user_id)")
def idempotent_results(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("result"), F.col("event_id").alias("ts"))
    return changes.first_results(rows, "user_id", ["event_id"]).select("event_id", "answer")


# Versions.


@query("WITH n AS (SELECT user_id AS key, event_type AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_id <= 700) SELECT key, value FROM n WHERE k = 1 AND value <> 'error'")
def mvcc_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return versions.snapshot(version_table(spark, d), 700)


@query("WITH t AS (SELECT event_id AS txn, event_id - 40 AS start_ts, user_id AS key FROM events), m AS (SELECT user_id AS key, max(event_id) AS commit_ts FROM events GROUP BY 1) SELECT txn, key, commit_ts FROM t JOIN m USING (key) WHERE commit_ts > start_ts")
def mvcc_write_conflicts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_id").alias("txn"), (F.col("event_id") - 40).alias("start_ts"), F.col("user_id").alias("key"))
    return versions.write_conflicts(rows, version_table(spark, d))


def _reads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every event reads its user as of forty events ago, and purchases write it."""
    own = table(spark, d, "events").withColumnsRenamed({"event_id": "txn", "user_id": "key"})
    return own.select("txn", (F.col("txn") - 40).alias("start_ts"), "key"), own.where("event_type = 'purchase'").select("txn", F.col("txn").alias("commit_ts"), "key")


_RW = "r AS (SELECT event_id AS txn, event_id - 40 AS start_ts, user_id AS key FROM events), w AS (SELECT event_id AS writer, event_id AS commit_ts, user_id AS key FROM events WHERE event_type = 'purchase'), c AS (SELECT DISTINCT txn, start_ts, key, writer, commit_ts FROM r JOIN w USING (key) WHERE commit_ts > start_ts AND txn <> writer)"


@query(f"WITH {_RW} SELECT txn, key, start_ts, max_by(writer, commit_ts) AS last_writer, max(commit_ts) AS last_commit FROM c GROUP BY ALL")
def mvcc_read_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return versions.read_conflicts(*_reads(spark, d))


@query(f"WITH {_RW} SELECT DISTINCT txn FROM c WHERE txn IN (SELECT writer FROM c)")
def mvcc_pivots(spark: SparkSession, d: str) -> DataFrame:
    return versions.pivot_transactions(*_reads(spark, d))


@query("WITH n AS (SELECT user_id AS key, event_type AS value, event_type = 'error' AS is_delete, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_id <= 500) SELECT key, value, is_delete FROM n WHERE k = 1")
def mvcc_savepoint(spark: SparkSession, d: str) -> DataFrame:
    writes = table(spark, d, "events").select(F.col("event_id").alias("n"), F.col("user_id").alias("key"), F.col("event_type").alias("value"), (F.col("event_type") == "error").alias("is_delete"))
    return versions.rollback_to(writes, 500)


@query("WITH RECURSIVE w AS (SELECT DISTINCT s_suppkey AS waiter, CASE WHEN s_suppkey % 7 = 6 THEN s_suppkey - 6 ELSE s_suppkey + 1 END AS holder FROM supplier WHERE s_suppkey % 11 <> 1), p AS (SELECT waiter, holder FROM w UNION SELECT p.waiter, w.holder FROM p JOIN w ON p.holder = w.waiter) SELECT DISTINCT waiter AS txn FROM p WHERE waiter = holder")
def mvcc_deadlocked(spark: SparkSession, d: str) -> DataFrame:
    """Rings of seven waiting transactions, some of them broken."""
    key = F.col("s_suppkey")
    return versions.deadlocked(table(spark, d, "supplier").where(key % 11 != 1).select(key.alias("waiter"), F.when(key % 7 == 6, key - 6).otherwise(key + 1).alias("holder")))


@query("WITH c AS (SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events), m AS (SELECT event_id, max(ms) OVER (ORDER BY event_id) AS top FROM c) SELECT event_id, top * 262144 + row_number() OVER (PARTITION BY top ORDER BY event_id) - 1 AS ts FROM m")
def mvcc_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Timestamps rise with the order of requests, though the events' clocks go back."""
    return versions.timestamps(table(spark, d, "events").select("event_id", _ms().alias("ms")), ["event_id"]).select("event_id", "ts")


# Vectors.

_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 3)"


def _one(spark: SparkSession, d: str, vec_id: int = 3) -> list[float]:
    return list(table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_Q}::DOUBLE[]), 5) AS distance FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_Q}::DOUBLE[]), vec_id LIMIT 10")
def vector_knn(spark: SparkSession, d: str) -> DataFrame:
    return vectors.knn(table(spark, d, "embeddings"), _one(spark, d)).select("vec_id", F.round("distance", 5).alias("distance"))


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_Q}::DOUBLE[]), 5) AS distance FROM embeddings WHERE label = 2 ORDER BY list_distance(embedding::DOUBLE[], {_Q}::DOUBLE[]), vec_id LIMIT 10")
def vector_knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    return vectors.knn(table(spark, d, "embeddings"), _one(spark, d), where=F.col("label") == 2).select("vec_id", F.round("distance", 5).alias("distance"))


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_Q}::DOUBLE[]), 5) AS distance FROM embeddings WHERE list_distance(embedding::DOUBLE[], {_Q}::DOUBLE[]) <= 1.2")
def vector_radius(spark: SparkSession, d: str) -> DataFrame:
    return vectors.within(table(spark, d, "embeddings"), _one(spark, d), 1.2).select("vec_id", F.round("distance", 5).alias("distance"))


@query(f"SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], {_Q}::DOUBLE[]), 5) AS distance FROM embeddings ORDER BY list_cosine_distance(embedding::DOUBLE[], {_Q}::DOUBLE[]), vec_id LIMIT 10")
def vector_cosine(spark: SparkSession, d: str) -> DataFrame:
    return vectors.knn(table(spark, d, "embeddings"), _one(spark, d), metric="cosine").select("vec_id", (F.round("distance", 5) + 0.0).alias("distance"))


@query(f"SELECT vec_id, round(-list_inner_product(embedding::DOUBLE[], {_Q}::DOUBLE[]), 5) AS distance FROM embeddings ORDER BY -list_inner_product(embedding::DOUBLE[], {_Q}::DOUBLE[]), vec_id LIMIT 10")
def vector_inner_product(spark: SparkSession, d: str) -> DataFrame:
    return vectors.knn(table(spark, d, "embeddings"), _one(spark, d), metric="ip").select("vec_id", F.round("distance", 5).alias("distance"))


@query("""WITH p AS (SELECT q.vec_id AS qid, v.vec_id AS id, list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS dist FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS k FROM p)
SELECT qid, id, round(dist, 5) AS distance, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 5""")
def vector_batch_knn(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "embeddings")
    queries = own.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    return vectors.batch_knn(own, queries, 5).select("qid", "id", F.round("distance", 5).alias("distance"), "rank")


@query("SELECT vec_id, label, round(list_distance(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 3)::DOUBLE[]), 5) AS distance FROM (SELECT vec_id, CASE WHEN vec_id % 10 = 1 THEN -1 ELSE label END AS label, embedding FROM embeddings WHERE vec_id % 10 <> 4) ORDER BY 3, 1 LIMIT 12")
def vector_payload(spark: SparkSession, d: str) -> DataFrame:
    """Some rows are replaced and some deleted before the search; the payload comes along."""
    own = table(spark, d, "embeddings")
    changed = vectors.upsert(own, own.where("vec_id % 10 = 1").withColumn("label", F.lit(-1)), "vec_id")
    left = vectors.delete(changed, own.where("vec_id % 10 = 4"), "vec_id")
    return vectors.knn(left, _one(spark, d), 12).select("vec_id", "label", F.round("distance", 5).alias("distance"))


@query("SELECT doc_id, round(min(distance), 5) AS distance FROM (SELECT vec_id % 50 AS doc_id, list_distance(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 3)::DOUBLE[]) AS distance FROM embeddings) GROUP BY 1 ORDER BY min(distance), doc_id LIMIT 10")
def vector_merge_topk(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "embeddings").select((F.col("vec_id") % 50).alias("doc_id"), vectors.distance("embedding", _one(spark, d)).alias("distance"))
    return vectors.merge_topk(parts, 10).select("doc_id", F.round("distance", 5).alias("distance"))


# Metadata.


@query("SELECT count(*) AS row_count, true AS has_size FROM lineitem")
def table_stats(spark: SparkSession, d: str) -> DataFrame:
    return meta.table_stats(table(spark, d, "lineitem")).select("row_count", (F.col("size_bytes") > 8 * F.col("row_count")).alias("has_size"))


@query("SELECT 'o_custkey' AS name, count(DISTINCT o_custkey) AS distinct_count, count(*) - count(o_custkey) AS null_count, CAST(min(o_custkey) AS VARCHAR) AS min_value, CAST(max(o_custkey) AS VARCHAR) AS max_value FROM orders UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus), count(*) - count(o_orderstatus), min(o_orderstatus), max(o_orderstatus) FROM orders")
def column_stats(spark: SparkSession, d: str) -> DataFrame:
    return meta.column_stats(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"])


@query("SELECT p_partkey, CASE WHEN p_size NOT BETWEEN -128 AND 127 THEN 'out_of_range:p_size' ELSE 'out_of_range:p_partkey' END AS reason FROM part WHERE p_size NOT BETWEEN -128 AND 127 OR p_partkey > 127")
def validate_rows(spark: SparkSession, d: str) -> DataFrame:
    found = meta.validate(table(spark, d, "part"), [meta.check("p_size", "int8"), meta.check("p_partkey", "int8", nullable=False), meta.check("p_name", "string", nullable=False)])
    return found.select("p_partkey", F.col("reasons")[0].alias("reason"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def index_lookup(spark: SparkSession, d: str) -> DataFrame:
    return meta.index_entries(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey"]).where("o_custkey = 7").select("o_orderkey")


@query("SELECT quality, toxic, d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL OR toxic IS NOT NULL")
def index_entries(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels")
    return meta.index_entries(docs.join(labels, "doc_id", "left"), ["quality", "toxic"], ["doc_id"])


@query("WITH l AS (SELECT s_nationkey % 4 AS store, count(*) AS n, min(s_suppkey) AS shard FROM supplier WHERE s_nationkey % 4 <> 3 OR s_suppkey < 20 GROUP BY 1) SELECT (SELECT shard FROM l ORDER BY n DESC, store LIMIT 1) AS shard, (SELECT store FROM l ORDER BY n DESC, store LIMIT 1) AS from_store, (SELECT store FROM l ORDER BY n, store LIMIT 1) AS to_store WHERE (SELECT max(n) - min(n) FROM l) > 2")
def shard_balance(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("shard"), (F.col("s_nationkey") % 4).alias("store")).where("store <> 3 or shard < 20")
    return meta.balance_moves(rows)


@query("WITH o AS (SELECT o_orderkey, ntile(16) OVER (ORDER BY o_orderkey) AS shard FROM orders) SELECT CAST(shard AS INTEGER) AS shard, true AS fair, true AS in_order FROM o GROUP BY shard")
def range_shards(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen shards, each of a sixteenth of the rows but for a fifth of that, each behind the one before."""
    from pyspark.sql import Window

    own = table(spark, d, "orders")
    found = meta.range_shards(own, "o_orderkey", 16).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("least"), F.max("o_orderkey").alias("largest"))
    in_turn = Window.orderBy("shard")  # a row a shard
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    before = F.coalesce(F.max("largest").over(in_turn.rowsBetween(Window.unboundedPreceding, -1)), F.col("least") - 1)
    return found.select("shard", (F.abs(F.col("n") * 16 / total - 1) < 0.2).alias("fair"), (F.col("least") > before).alias("in_order"))
