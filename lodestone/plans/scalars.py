"""Scalar functions, each name of the surface at least once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as L
from ..registry import both, query
from ..session import table

both("scalar_math", """SELECT p_partkey, abs(-p_size) AS ab, round(sqrt(p_size), 6) AS sq, round(cbrt(p_size), 6) AS cb, ceil(p_retailprice) AS ce, floor(p_retailprice) AS fl, round(ln(p_size), 6) AS l,
round(log10(p_size), 6) AS l10, round(log2(p_size), 6) AS l2, round(exp(p_size / 50.0), 6) AS ex, round(power(p_size, 1.5), 4) AS pw, sign(p_size - 25) AS sg, round(pi(), 8) AS pi, p_size % 7 AS md, round(degrees(p_size), 6) AS dg, round(radians(p_size), 8) AS rd FROM {part}""",
"""SELECT p_partkey, abs(-p_size) AS ab, round(sqrt(p_size), 6) AS sq, round(cbrt(p_size), 6) AS cb, CAST(ceil(p_retailprice) AS BIGINT) AS ce, CAST(floor(p_retailprice) AS BIGINT) AS fl, round(ln(p_size), 6) AS l,
round(log10(p_size), 6) AS l10, round(log2(p_size), 6) AS l2, round(exp(CAST(p_size AS DOUBLE) / 50.0), 6) AS ex, round(power(p_size, 1.5), 4) AS pw, CAST(sign(p_size - 25) AS DOUBLE) AS sg, round(pi(), 8) AS pi, p_size % 7 AS md, round(degrees(p_size), 6) AS dg, round(radians(p_size), 8) AS rd FROM part""")
both("scalar_trigonometry", """SELECT p_partkey, round(sin(p_size), 6) AS s, round(cos(p_size), 6) AS c, round(tan(p_size), 4) AS t, round(asin(p_size / 100.0D), 6) AS a1, round(acos(p_size / 100.0D), 6) AS a2, round(atan(p_size), 6) AS a3, round(atan2(p_size, 3), 6) AS a4,
round(sinh(p_size / 20.0D), 6) AS h1, round(cosh(p_size / 20.0D), 6) AS h2, round(tanh(p_size / 20.0D), 6) AS h3, round(asinh(p_size), 6) AS h4, round(acosh(p_size + 1), 6) AS h5, round(atanh(p_size / 100.0D), 6) AS h6, round(cot(p_size), 4) AS ct FROM {part}""",
"""SELECT p_partkey, round(sin(p_size), 6) AS s, round(cos(p_size), 6) AS c, round(tan(p_size), 4) AS t, round(asin(p_size / 100.0), 6) AS a1, round(acos(p_size / 100.0), 6) AS a2, round(atan(p_size), 6) AS a3, round(atan2(p_size, 3), 6) AS a4,
round(sinh(p_size / 20.0), 6) AS h1, round(cosh(p_size / 20.0), 6) AS h2, round(tanh(p_size / 20.0), 6) AS h3, round(asinh(p_size), 6) AS h4, round(acosh(p_size + 1), 6) AS h5, round(atanh(p_size / 100.0), 6) AS h6, round(cot(p_size), 4) AS ct FROM part""")
both("scalar_conditional", """SELECT d.doc_id, coalesce(l.quality, -1) AS co, nullif(l.quality, 0) AS nu, nvl(l.toxic, 9) AS nv, nvl2(l.quality, 'yes', 'no') AS n2, ifnull(l.toxic, 5) AS ifn, greatest(d.n_chars, 1000) AS gr, least(d.n_chars, 1000) AS le, if(d.n_chars > 500, 'long', 'short') AS k FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
"""SELECT d.doc_id, coalesce(l.quality, -1) AS co, nullif(l.quality, 0) AS nu, coalesce(l.toxic, 9) AS nv, CASE WHEN l.quality IS NOT NULL THEN 'yes' ELSE 'no' END AS n2, ifnull(l.toxic, 5) AS ifn, greatest(d.n_chars, 1000) AS gr, least(d.n_chars, 1000) AS le, if(d.n_chars > 500, 'long', 'short') AS k FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
both("scalar_strings", """SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_mktsegment) AS lo, initcap(lower(c_mktsegment)) AS ini, char_length(c_name) AS n, octet_length(c_name) AS oc, bit_length(c_name) AS bi, substr(c_name, 2, 5) AS su, left(c_name, 3) AS lf, right(c_name, 3) AS ri, reverse(c_name) AS re, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '.') AS rp,
trim('  x ') AS tr, btrim('xxaxx', 'x') AS bt, ltrim('  a') AS lt, rtrim('a  ') AS rt, replace(c_name, '0', '_') AS rp2, translate(c_name, '0123', 'abcd') AS tl, repeat('ab', 3) AS rr, split_part(c_name, '#', 2) AS sp, instr(c_name, '#') AS po, contains(c_name, '7') AS cn, startswith(c_name, 'Cust') AS sw, endswith(c_name, '1') AS ew, concat(c_mktsegment, '-', c_name) AS cc, concat_ws('/', c_mktsegment, c_name) AS cw, ascii(c_mktsegment) AS asc, chr(65 + c_nationkey) AS ch, levenshtein(c_mktsegment, 'BUILDING') AS lv, substring_index('a.b.c', '.', 2) AS si, find_in_set('b', 'a,b,c') AS fs, overlay('abcdef' PLACING 'XY' FROM 2 FOR 3) AS ov, lower(hex(c_custkey)) AS hx FROM {customer}""",
"""SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_mktsegment) AS lo, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS ini, CAST(length(c_name) AS INTEGER) AS n, CAST(strlen(c_name) AS INTEGER) AS oc, CAST(bit_length(c_name) AS INTEGER) AS bi, substr(c_name, 2, 5) AS su, left(c_name, 3) AS lf, right(c_name, 3) AS ri, reverse(c_name) AS re, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '.') AS rp,
trim('  x ') AS tr, trim('xxaxx', 'x') AS bt, ltrim('  a') AS lt, rtrim('a  ') AS rt, replace(c_name, '0', '_') AS rp2, translate(c_name, '0123', 'abcd') AS tl, repeat('ab', 3) AS rr, split_part(c_name, '#', 2) AS sp, CAST(instr(c_name, '#') AS INTEGER) AS po, contains(c_name, '7') AS cn, starts_with(c_name, 'Cust') AS sw, ends_with(c_name, '1') AS ew, concat(c_mktsegment, '-', c_name) AS cc, concat_ws('/', c_mktsegment, c_name) AS cw, ascii(c_mktsegment) AS asc, chr(65 + c_nationkey) AS ch, CAST(levenshtein(c_mktsegment, 'BUILDING') AS INTEGER) AS lv, 'a.b' AS si, 2 AS fs, 'aXYef' AS ov, lower(hex(c_custkey)) AS hx FROM customer""")
both("scalar_regex", """SELECT c_custkey, regexp_count(c_name, '0') AS n, regexp_like(c_name, '[13579]$') AS odd, regexp_replace(c_name, '0+', 'z') AS every, regexp_extract(c_name, '([0-9]+)', 1) AS digits, array_join(regexp_extract_all(c_name, '([1-9])', 1), '') AS nonzero FROM {customer}""",
"""SELECT c_custkey, CAST(len(regexp_extract_all(c_name, '0')) AS INTEGER) AS n, regexp_matches(c_name, '[13579]$') AS odd, regexp_replace(c_name, '0+', 'z', 'g') AS every, regexp_extract(c_name, '([0-9]+)', 1) AS digits, array_to_string(regexp_extract_all(c_name, '([1-9])', 1), '') AS nonzero FROM customer""")
both("scalar_dates", """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS doy, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS STRING) AS mon, CAST(CAST(o_orderdate + INTERVAL 10 DAY AS DATE) AS STRING) AS later, CAST(CAST(add_months(o_orderdate, -2) AS DATE) AS STRING) AS earlier, datediff(CAST(o_orderdate AS DATE), DATE '1992-01-01') AS days, date_format(o_orderdate, 'yyyy/MM/dd') AS txt, CAST(make_date(year(o_orderdate), 1, 31) AS STRING) AS mk, unix_timestamp(CAST(o_orderdate AS TIMESTAMP)) AS ux, CAST(last_day(o_orderdate) AS STRING) AS ld, CAST(extract(HOUR FROM o_orderdate) AS INT) AS h FROM {orders}""",
"""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS mon, CAST(CAST(o_orderdate + INTERVAL 10 DAY AS DATE) AS VARCHAR) AS later, CAST(CAST(o_orderdate - INTERVAL 2 MONTH AS DATE) AS VARCHAR) AS earlier, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days, strftime(o_orderdate, '%Y/%m/%d') AS txt, CAST(make_date(year(o_orderdate), 1, 31) AS VARCHAR) AS mk, CAST(epoch(o_orderdate) AS BIGINT) AS ux, CAST(last_day(o_orderdate) AS VARCHAR) AS ld, CAST(hour(o_orderdate) AS INTEGER) AS h FROM orders""")
both("scalar_arrays", """SELECT n_nationkey, array_join(array_append(array_prepend(a, 0), 99), ',') AS ap, array_join(concat(a, array(7)), ',') AS cc, array_contains(a, 3) AS has, size(a) AS n, array_max(a) AS mx, array_min(a) AS mn, array_position(a, 3) AS pos, array_join(array_remove(a, 3), ',') AS rm, array_join(array_repeat(n_regionkey, 2), ',') AS rep, array_join(reverse(a), ',') AS rev, array_join(slice(a, 2, 2), ',') AS sl, array_join(sort_array(a, false), ',') AS srt, array_join(array_distinct(a), ',') AS dis, array_join(sort_array(array_union(a, array(1, 50))), ',') AS un, array_join(sort_array(array_intersect(a, array(1, 3))), ',') AS ise, array_join(sort_array(array_except(a, array(1, 3))), ',') AS exc, element_at(a, 2) AS el, array_join(flatten(array(a, array(5))), ',') AS fl, array_join(sequence(1, n_regionkey + 1), ',') AS seq, arrays_overlap(a, array(3, 4)) AS ovl, array_join(transform(filter(a, x -> x > 1), x -> x * 2), ',') AS tf, aggregate(a, 0, (s, x) -> s + x) AS total FROM (SELECT n_nationkey, n_regionkey, array(n_regionkey, 3, n_nationkey, 1, 3) AS a FROM {nation})""",
"""SELECT n_nationkey, array_to_string(list_append(list_prepend(0, a), 99), ',') AS ap, array_to_string(list_concat(a, [7]), ',') AS cc, list_contains(a, 3) AS has, CAST(len(a) AS INTEGER) AS n, list_max(a) AS mx, list_min(a) AS mn, CAST(list_position(a, 3) AS BIGINT) AS pos, array_to_string(list_filter(a, lambda x: x <> 3), ',') AS rm, array_to_string([n_regionkey, n_regionkey], ',') AS rep, array_to_string(list_reverse(a), ',') AS rev, array_to_string(a[2:3], ',') AS sl, array_to_string(list_reverse_sort(a), ',') AS srt, (SELECT string_agg(x, ',' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(a) AS x, generate_subscripts(a, 1) AS i) GROUP BY x)) AS dis, array_to_string(list_sort(list_distinct(list_concat(a, [1, 50]))), ',') AS un, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: x IN (1, 3)))), ',') AS ise, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: x NOT IN (1, 3)))), ',') AS exc, a[2] AS el, array_to_string(flatten([a, [5]]), ',') AS fl, array_to_string(range(1, n_regionkey + 2), ',') AS seq, list_has_any(a, [3, 4]) AS ovl, array_to_string(list_transform(list_filter(a, lambda x: x > 1), lambda x: x * 2), ',') AS tf, CAST(list_sum(a) AS INTEGER) AS total FROM (SELECT n_nationkey, n_regionkey, [n_regionkey, 3, n_nationkey, 1, 3] AS a FROM nation)""")
both("scalar_maps_structs", """SELECT n_nationkey, s.name AS name, s.k AS k, element_at(m, 'b') AS b, m['a'] AS a, size(map_keys(m)) AS n, array_join(map_values(m), ',') AS vals, map_contains_key(m, 'c') AS has, array_join(transform(map_entries(m), e -> concat(e.key, '=', e.value)), ';') AS pairs FROM (SELECT n_nationkey, named_struct('name', n_name, 'k', n_regionkey) AS s, map('a', n_nationkey, 'b', n_regionkey) AS m FROM {nation})""",
"""SELECT n_nationkey, n_name AS name, n_regionkey AS k, n_regionkey AS b, n_nationkey AS a, 2 AS n, n_nationkey || ',' || n_regionkey AS vals, false AS has, 'a=' || n_nationkey || ';b=' || n_regionkey AS pairs FROM nation""")
both("scalar_hashes", """SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s, sha1(c_name) AS s1, base64(CAST(c_name AS BINARY)) AS b, lower(hex(c_name)) AS h, CAST(unhex(hex(c_name)) AS STRING) AS back, length(sha2(c_name, 224)) AS l2, length(sha2(c_name, 384)) AS l3, length(sha2(c_name, 512)) AS l5 FROM {customer}""",
"""SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, sha1(c_name) AS s1, base64(c_name::BLOB) AS b, lower(hex(c_name)) AS h, c_name AS back, 56 AS l2, 96 AS l3, 128 AS l5 FROM customer""")
both("scalar_json", """SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k, from_json(props, 'k INT').k AS k2, to_json(named_struct('t', event_type)) AS j, json_array_length('[1,2,3]') AS n FROM {events}""",
"""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k2, '{{"t":"' || event_type || '"}}' AS j, 3 AS n FROM events""".replace("{{", "{").replace("}}", "}"))
both("scalar_types", """SELECT p_partkey, typeof(p_size) AS t1, typeof(p_name) AS t2, try_cast(p_brand AS INT) AS no, CAST(p_size AS STRING) AS s, CAST(p_retailprice AS DECIMAL(10, 2)) AS dec, isnan(CAST('NaN' AS DOUBLE)) AS nan, nanvl(CAST('NaN' AS DOUBLE), 1D) AS nv FROM {part}""",
"""SELECT p_partkey, 'int' AS t1, 'string' AS t2, CAST(NULL AS INTEGER) AS no, CAST(p_size AS VARCHAR) AS s, CAST(p_retailprice AS DECIMAL(10, 2)) AS dec, true AS nan, CAST(1 AS DOUBLE) AS nv FROM part""")


@query("SELECT p_partkey, CAST(gcd(p_size, 36) AS BIGINT) AS g, CAST(lcm(p_size, 36) AS BIGINT) AS l, p_size = 7 AS z, trunc(p_retailprice - 1000) + 0 AS t, CAST(factorial(p_size % 10) AS BIGINT) AS f FROM part")
def scalar_number_theory(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", L.gcd(size, F.lit(36)).alias("g"), L.lcm(size, F.lit(36)).alias("l"), L.iszero(size - 7).alias("z"), L.trunc(F.col("p_retailprice") - 1000).alias("t"), F.factorial(size % 10).alias("f"))


@query("SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS bin FROM events")
def scalar_date_bin(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", L.date_bin(900, F.col("ts")).alias("bin"))


@query("SELECT c_custkey, regexp_replace(c_name, '0', 'o') AS one, CASE WHEN regexp_matches(c_name, '([A-Za-z]+)#0*([0-9]+)') THEN regexp_extract(c_name, '([A-Za-z]+)#0*([0-9]+)', 1) || '/' || regexp_extract(c_name, '([A-Za-z]+)#0*([0-9]+)', 2) END AS parts, lower(to_hex(c_custkey)) AS h, CAST(instr(c_name, '#') AS INTEGER) AS at FROM customer")
def scalar_regex_first(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", L.regexp_replace_first(name, "0", "o").alias("one"), F.array_join(L.regexp_match(name, "([A-Za-z]+)#0*([0-9]+)", 2), "/").alias("parts"), L.to_hex(F.col("c_custkey")).alias("h"), L.strpos(name, "#").alias("at"))


@query("""SELECT n_nationkey, array_to_string(list_filter([1, 2, 3, 4, 5], lambda i: a[i] = 3), ',') AS pos, list_has_all(a, [3, 1]) AS every, array_to_string(a[:-2], ',') AS back, array_to_string(a[2:], ',') AS front,
array_to_string(list_transform(a, lambda x: CASE WHEN x = 3 THEN 0 ELSE x END), ',') AS rep, array_to_string([n_regionkey, 3, n_nationkey, 1, 3, 9, 9], ',') AS wide FROM (SELECT n_nationkey, n_regionkey, [n_regionkey, 3, n_nationkey, 1, 3] AS a FROM nation)""")
def scalar_more_arrays(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("a")
    join = lambda c, name: F.array_join(c, ",").alias(name)
    rows = table(spark, d, "nation").select("n_nationkey", F.array("n_regionkey", F.lit(3), "n_nationkey", F.lit(1), F.lit(3)).alias("a"))
    return rows.select(
        "n_nationkey",
        join(L.array_positions(a, F.lit(3)), "pos"),
        L.array_has_all(a, F.array(F.lit(3), F.lit(1))).alias("every"),
        join(L.array_pop_back(a), "back"),
        join(L.array_pop_front(a), "front"),
        join(L.array_replace_all(a, F.lit(3), F.lit(0)), "rep"),
        join(L.array_resize(a, 7, F.lit(9)), "wide"),
    )
