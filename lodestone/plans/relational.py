"""Scans, filters, joins, aggregates, windows, sorts, sets and subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similar_to
from ..operators import ordered
from ..operators.predicate import key_bounds, parse_filter
from ..registry import both, query
from ..session import table


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    price = F.col("l_extendedprice")
    return line.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(price), 2).alias("sum_base"),
        F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count(F.lit(1)).alias("n"),
    )


# Scans and filters.

both("scan_project", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > 150000")
both("filter_comparisons", "SELECT p_partkey, p_size FROM {part} WHERE p_size <> 10 AND p_size >= 5 AND p_size < 40 AND p_retailprice > 950 AND p_partkey <= 1500")
both("filter_and_or_not", "SELECT p_partkey, p_brand FROM {part} WHERE (p_size < 5 OR p_size > 45) AND NOT (p_brand = 'Brand#11')")
both("filter_in", "SELECT c_custkey, c_mktsegment FROM {customer} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
both("filter_between", "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_quantity BETWEEN 10 AND 12")
both("filter_like", "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%wid_et'")
both("filter_ilike", "SELECT p_partkey, p_type FROM {part} WHERE p_type ILIKE '%eConO%'")
both("filter_regex", "SELECT c_custkey, c_name FROM {customer} WHERE regexp_like(c_name, '[05]$')", "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '[05]$')")
both("filter_is_null", "SELECT d.doc_id, l.quality FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id WHERE l.quality IS NULL OR l.toxic IS NOT NULL")
both("filter_is_distinct", "SELECT d.doc_id, l.quality FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id WHERE l.quality IS DISTINCT FROM 1")
both("filter_is_true", "SELECT d.doc_id, (l.quality = 1) IS NOT TRUE AS not_good, (l.quality = 1) IS UNKNOWN AS unknown FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id", "SELECT d.doc_id, coalesce(NOT (l.quality = 1), true) AS not_good, l.quality IS NULL AS unknown FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
both("point_lookup", "SELECT * FROM {orders} WHERE o_orderkey = 77", "SELECT * FROM orders WHERE o_orderkey = 77")
both("range_scan_limit", "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_orderkey >= 100 AND o_orderkey <= 5000 ORDER BY o_orderkey LIMIT 150")
both("values_rows", "SELECT * FROM VALUES (10, 'ida'), (20, 'olaf'), (30, CAST(NULL AS STRING)) AS t(id, name)", "SELECT * FROM (VALUES (10, 'ida'), (20, 'olaf'), (30, NULL)) t(id, name)")
both("series", "SELECT id AS n FROM range(3, 40, 4)", "SELECT range AS n FROM range(3, 40, 4)")



@query("SELECT c_custkey, c_name FROM customer WHERE c_name SIMILAR TO '.*[05](1|2)'")
def filter_similar(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where(similar_to(F.col("c_name"), "%[05](1|2)")).select("c_custkey", "c_name")


FILTER = {
    "op": "and",
    "args": [
        {"op": "or", "args": [{"op": "between", "col": "p_size", "low": 5, "high": 20}, {"op": "in", "col": "p_brand", "vals": ["Brand#11", "Brand#23"]}]},
        {"op": "not", "arg": {"op": "is_null", "col": "p_name"}},
        {"op": "ilike", "col": "p_type", "val": "%e%"},
        {"op": "ge", "col": "p_retailprice", "val": {"type": "float", "value": 901.5}},
    ],
}


@query("SELECT p_partkey, p_size, p_brand FROM part WHERE (p_size BETWEEN 5 AND 20 OR p_brand IN ('Brand#11', 'Brand#23')) AND p_name IS NOT NULL AND p_type ILIKE '%e%' AND p_retailprice >= 901.5")
def json_filter_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(parse_filter(FILTER)).select("p_partkey", "p_size", "p_brand")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 50 AND o_orderkey <= 4000 AND o_totalprice < 100000")
def key_bounds_prune(spark: SparkSession, d: str) -> DataFrame:
    tree = {"op": "and", "args": [{"op": "gt", "col": "o_orderkey", "val": 50}, {"op": "le", "col": "o_orderkey", "val": 4000}, {"op": "lt", "col": "o_totalprice", "val": 100000.0}]}
    return table(spark, d, "orders").where(key_bounds(tree, "o_orderkey").column("o_orderkey") & parse_filter(tree)).select("o_orderkey", "o_totalprice")


@query("WITH k(ord, o_orderkey) AS (VALUES (1, 5), (2, 999999999), (3, 1), (4, 5)) SELECT k.ord, k.o_orderkey, o.o_totalprice, o.o_orderkey IS NOT NULL AS found FROM k LEFT JOIN orders o ON o.o_orderkey = k.o_orderkey")
def batch_get(spark: SparkSession, d: str) -> DataFrame:
    keys = spark.createDataFrame([(1, 5), (2, 999999999), (3, 1), (4, 5)], "ord int, o_orderkey int")
    # The list of keys is the small side: it is broadcast, and the table is scanned with the keys pushed down.
    own = table(spark, d, "orders").where(F.col("o_orderkey").isin(5, 999999999, 1)).select("o_orderkey", "o_totalprice", F.lit(True).alias("hit"))
    return keys.join(own, "o_orderkey", "left").select("ord", "o_orderkey", "o_totalprice", F.coalesce("hit", F.lit(False)).alias("found"))


# Joins.

both("join_inner", "SELECT o.o_orderkey, c.c_name, c.c_mktsegment FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 100000")
both("join_left", "SELECT c.c_custkey, o.o_orderkey FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000")
both("join_right", "SELECT o.o_orderkey, c.c_custkey FROM {orders} o RIGHT JOIN {customer} c ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000")
both("join_full", "SELECT a.c_custkey AS low_key, b.c_custkey AS high_key FROM (SELECT * FROM {customer} WHERE c_acctbal < 5000) a FULL JOIN (SELECT * FROM {customer} WHERE c_mktsegment <> 'BUILDING') b ON a.c_custkey = b.c_custkey")
both("join_semi", "SELECT c_custkey, c_name FROM {customer} c LEFT SEMI JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 150000", "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE c.c_custkey = o.o_custkey AND o.o_totalprice > 150000)")
both("join_anti", "SELECT c_custkey, c_name FROM {customer} c LEFT ANTI JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000", "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE c.c_custkey = o.o_custkey AND o.o_totalprice > 200000)")
both("not_in_null_aware", "SELECT doc_id FROM {labels} WHERE toxic NOT IN (SELECT CASE WHEN n_regionkey > 2 THEN NULL ELSE 1 END FROM {nation} WHERE n_regionkey < 2)")
both("join_cross", "SELECT r.r_name, n.n_name FROM {region} r CROSS JOIN {nation} n WHERE n.n_nationkey < 3")
both("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
both("join_using", "SELECT doc_id, quality, n_chars FROM {documents} JOIN {labels} USING (doc_id) WHERE toxic = 1")
both("join_natural", "SELECT doc_id, quality, lang FROM {documents} NATURAL JOIN {labels}")
both("join_self", "SELECT a.s_suppkey AS left_key, b.s_suppkey AS right_key FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
both("join_multiway", """SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM {customer} c
JOIN {orders} o ON c.c_custkey = o.o_custkey JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey
JOIN {nation} n ON s.s_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name""")
both("join_lateral", "SELECT c.c_custkey, t.o_orderkey FROM {customer} c JOIN LATERAL (SELECT o_orderkey FROM {orders} o WHERE o.o_custkey = c.c_custkey ORDER BY o_orderkey LIMIT 2) t", "SELECT c.c_custkey, t.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_orderkey LIMIT 2) t")


@query("SELECT o.o_orderkey, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey")
def join_broadcast_hint(spark: SparkSession, d: str) -> DataFrame:
    """nation has 25 rows at every scale, so a hint is safe; customer grows, so its join is left to the planner."""
    orders, customer, nation = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("o_orderkey", "n_name")


@query("SELECT o.o_orderkey, count(*) AS n FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY 1")
def join_merge_hint(spark: SparkSession, d: str) -> DataFrame:
    orders, line = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select("l_orderkey")
    return orders.join(line.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


# Aggregates.

both("agg_hash", "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price, min(l_discount) AS lo, max(l_tax) AS hi FROM {lineitem} GROUP BY l_suppkey")
both("agg_global", "SELECT count(*) AS n, count(quality) AS labelled, sum(quality) AS good FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id", "SELECT count(*) AS n, count(quality) AS labelled, CAST(sum(quality) AS BIGINT) AS good FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
both("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM {lineitem} GROUP BY l_returnflag")
both("agg_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12")
both("agg_filter_clause", "SELECT l_linestatus, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, round(sum(l_quantity) FILTER (WHERE l_tax = 0), 2) AS untaxed FROM {lineitem} GROUP BY l_linestatus")
both("agg_by_expression", "SELECT p_size % 10 AS bucket, count(*) AS n FROM {part} GROUP BY p_size % 10")
both("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS TINYINT) AS g1, CAST(grouping(l_linestatus) AS TINYINT) AS g2, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
both("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
both("agg_rollup", "SELECT p_brand, p_size, count(*) AS n, round(sum(p_retailprice), 2) AS price FROM {part} WHERE p_size < 6 GROUP BY ROLLUP (p_brand, p_size)")
both("agg_moments", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_discount), 8) AS vs, round(var_pop(l_discount), 8) AS vp, round(covar_samp(l_quantity, l_extendedprice), 2) AS cs, round(covar_pop(l_quantity, l_extendedprice), 2) AS cp, round(corr(l_quantity, l_extendedprice), 6) AS r FROM {lineitem} GROUP BY l_returnflag")
both("agg_regression", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS cut, regr_count(l_extendedprice, l_quantity) AS n, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_avgx(l_extendedprice, l_quantity), 4) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 2) AS ay, round(regr_sxx(l_extendedprice, l_quantity), 0) AS sxx, round(regr_sxy(l_extendedprice, l_quantity) / 1000, 0) AS sxy FROM {lineitem} GROUP BY l_returnflag",
     "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS cut, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_avgx(l_extendedprice, l_quantity), 4) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 2) AS ay, round(regr_sxx(l_extendedprice, l_quantity), 0) AS sxx, round(regr_sxy(l_extendedprice, l_quantity) / 1000, 0) AS sxy FROM lineitem GROUP BY l_returnflag")
both("agg_regr_syy", "SELECT l_linestatus, round(regr_syy(l_quantity, l_discount), 2) AS syy FROM {lineitem} GROUP BY l_linestatus")
both("agg_bits_bools", "SELECT p_brand, bit_and(p_size) AS a, bit_or(p_size) AS o, bit_xor(p_size) AS x, bool_and(p_size > 1) AS every_one, bool_or(p_size > 49) AS any_one FROM {part} GROUP BY p_brand")

@query("SELECT l_returnflag, round(median(l_extendedprice), 4) AS med, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag")
def agg_median_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles by ranks over ranges of the value: no task holds all values of a group."""
    found = ordered.percentiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"med": 0.5, "p90": 0.9})
    return found.select("l_returnflag", F.round("med", 4).alias("med"), F.round("p90", 4).alias("p90"))


@query("WITH c AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS upto, sum(w) OVER (PARTITION BY l_returnflag) AS whole FROM c) SELECT l_returnflag, min(v) FILTER (WHERE upto >= 0.5 * whole) AS med, min(v) FILTER (WHERE upto >= 0.99 * whole) AS p99 FROM r GROUP BY 1")
def agg_weighted_percentile(spark: SparkSession, d: str) -> DataFrame:
    return ordered.weighted_percentiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", {"med": 0.5, "p99": 0.99})


both("agg_string", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
both("agg_array", "SELECT n_regionkey, array_join(sort_array(array_agg(n_name)), '|') AS names, size(collect_set(n_nationkey % 3)) AS kinds FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_name)), '|') AS names, CAST(len(list_distinct(array_agg(n_nationkey % 3))) AS INTEGER) AS kinds FROM nation GROUP BY n_regionkey")


@query("SELECT o_custkey, max_by(o_orderkey, o_totalprice) AS dearest, min_by(o_orderkey, o_totalprice) AS cheapest FROM orders GROUP BY o_custkey")
def agg_by_extreme(spark: SparkSession, d: str) -> DataFrame:
    """Of orders of one price the first by key, as they lie in the table: Spark's own max_by and min_by take whichever comes last. Rows with a null in either column don't count."""
    own = table(spark, d, "orders")
    price = F.when(F.col("o_orderkey").isNotNull() & F.col("o_totalprice").isNotNull(), F.struct("o_totalprice", "o_orderkey"))
    # ~key orders keys from the largest to the least, without the overflow of a minus.
    dear = F.when(price.isNotNull(), F.struct("o_totalprice", F.bitwise_not("o_orderkey")))
    return own.groupBy("o_custkey").agg(F.max_by("o_orderkey", dear).alias("dearest"), F.min_by("o_orderkey", price).alias("cheapest"))


both("agg_distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}")
both("agg_distinct_on", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM {orders}) WHERE n = 1", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
both("agg_pivot", "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM {lineitem}) PIVOT (count(l_quantity) FOR l_linestatus IN ('F' AS f, 'O' AS o))", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY 1")


@query("SELECT DISTINCT l_returnflag, true AS parts_close, true AS tenth_close, true AS median_close FROM lineitem")
def agg_approx(spark: SparkSession, d: str) -> DataFrame:
    """Sketches with bounded state, held against exact counts: distinct values within an eighth (five times the standard error), quantiles within a hundredth of the rows."""
    line = table(spark, d, "lineitem")
    parts, cuts = F.approx_count_distinct("l_partkey", 0.025), F.percentile_approx("l_extendedprice", [0.1, 0.5], 1000)
    sketch = line.groupBy("l_returnflag").agg(parts.alias("parts"), cuts.alias("cuts"))
    met = line.join(F.broadcast(sketch), "l_returnflag")  # a row a flag
    below = lambda k: F.avg((F.col("l_extendedprice") <= F.col("cuts")[k]).cast("int"))
    near = lambda k, q: (F.abs(below(k) - q) < 0.01)
    checked = met.groupBy("l_returnflag").agg((F.abs(F.max("parts") / F.count_distinct("l_partkey") - 1) < 0.125).alias("parts_close"), near(0, 0.1).alias("tenth_close"), near(1, 0.5).alias("median_close"))
    return checked


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted FROM lineitem GROUP BY 1")
def agg_weighted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity"), 4).alias("weighted"))


# Windows.

both("window_ranks", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr FROM {orders}", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INTEGER) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INTEGER) AS dr FROM orders")

@query("SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey), 6) AS pr, round(cume_dist() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey), 6) AS cd, CAST(ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS q FROM orders")
def window_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of three large groups by row numbers over ranges of the price."""
    rows = ordered.row_numbers(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderstatus"], ["o_totalprice", "o_orderkey"])
    pr, cd, q = ordered.shares(F.col("rn"), F.col("total"), 4)
    return rows.select("o_orderkey", F.round(pr, 6).alias("pr"), F.round(cd, 6).alias("cd"), q.alias("q"))


both("window_lag_lead", "SELECT event_id, lag(event_id, 1) OVER w AS before, lead(event_id, 2, -1) OVER w AS behind FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
both("window_first_last_nth", "SELECT event_id, first_value(event_type) OVER w AS f, last_value(event_type) OVER w AS l, nth_value(event_id, 3) OVER w AS third FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
both("window_ignore_nulls", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY event_id) AS last_purchase FROM {events}", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS last_purchase FROM events")
both("window_running_sum", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 3) AS total FROM {events}")
both("window_moving_avg", "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 4) AS near FROM {events}")
both("window_range_frame", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM {lineitem}")
both("window_groups_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM (SELECT o_orderkey, o_custkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS g FROM {orders})", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM orders")
both("window_topk_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM {orders}) WHERE n <= 3")
both("window_qualify", "SELECT o_orderkey, o_custkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM {orders}) WHERE n = 10", "SELECT o_orderkey, o_custkey FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) = 10")

# Sorts, limits and sets.

both("order_nulls", "SELECT doc_id, quality FROM (SELECT d.doc_id, l.quality FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id) ORDER BY quality DESC NULLS LAST, doc_id ASC NULLS FIRST")
both("limit_offset", "SELECT c_custkey FROM {customer} ORDER BY c_custkey LIMIT 20 OFFSET 33")
both("topk", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
both("set_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
both("set_union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}")
both("set_intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}")
both("set_except", "SELECT p_size AS k FROM {part} EXCEPT SELECT s_nationkey FROM {supplier}")
both("set_intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}")
both("set_except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}")

# Subqueries.

both("subquery_scalar", "SELECT p_partkey FROM {part} WHERE p_retailprice > (SELECT avg(p_retailprice) FROM {part})")
both("subquery_correlated", "SELECT o_orderkey FROM {orders} o WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")
both("subquery_exists", "SELECT s_suppkey FROM {supplier} s WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49)")
both("subquery_in", "SELECT c_custkey FROM {customer} WHERE c_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)")
both("subquery_all", "SELECT p_partkey FROM {part} WHERE p_size >= (SELECT max(p_size) FROM {part} WHERE p_brand = 'Brand#11')", "SELECT p_partkey FROM part WHERE p_size >= ALL (SELECT p_size FROM part WHERE p_brand = 'Brand#11')")
both("cte", "WITH big AS (SELECT * FROM {orders} WHERE o_totalprice > 100000), n AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c.c_custkey, n.n FROM {customer} c JOIN n ON c.c_custkey = n.o_custkey")
both("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
both("case_cast", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'few' WHEN l_quantity < 30 THEN 'some' ELSE 'many' END AS kind, CAST(l_quantity AS BIGINT) AS q, TRY_CAST(l_returnflag AS INT) AS nothing FROM {lineitem}")
both("unnest", "SELECT doc_id, w FROM (SELECT doc_id, explode(split(lang, '')) AS w FROM {documents})", "SELECT doc_id, unnest(string_split(lang, '')) AS w FROM documents")
