"""Temporal list join: each capture is judged by the list entries that were active when it was fetched. DataFrame operations only.

List entries are dated: (suffix, category, day, seq, action), action add or remove. Of the entries of one suffix and category, the last of
a day (by seq) counts, and each day's state holds until the next dated entry: that makes validity intervals [from_day, until_day). A capture
meets the intervals of its host and of the host's parent domains. The as-of join is an equi-join on (suffix, month, salt): intervals are
repeated for each month they touch, so a pair is only looked at in its month, and captures of a hot host are dealt over months and
salts. Intervals grow with the list, not with the captures; nothing is broadcast by hand.

Edge cases: a null or malformed url has an empty host that no entry meets; a null day meets none; a null id stays; repeated captures are judged each;
entries with a null part are left out; a removal without an addition makes no interval; an empty list blocks nothing; no captures
give no row. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
SALTS = 8


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and its parent domains: a.b.c, b.c, c."""
    labels = F.split(host, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """suffix, category, from_day, until_day (null: still valid)."""
    whole = entries.where("suffix is not null and category is not null and day is not null and action in ('add', 'remove')")
    daily = whole.groupBy("suffix", "category", "day").agg(F.max_by("action", F.struct("seq", "action")).alias("action"))
    in_time = Window.partitionBy("suffix", "category").orderBy("day")
    dated = daily.withColumn("until_day", F.lead("day").over(in_time)).where("action = 'add'")
    return dated.select("suffix", "category", F.col("day").alias("from_day"), "until_day")


def judge_captures(captures: DataFrame, entries: DataFrame, salts: int = SALTS) -> DataFrame:
    """captures: id, url, day. Per capture: id, host, day, n_active (entries active for it), first_rule (least 'suffix category'), blocked."""
    own = captures.select("id", host_of(F.col("url")).alias("host"), "day")
    last = own.agg(F.max("day").alias("last")).first()["last"]
    month = lambda day: F.trunc(day, "month")
    spans = validity_intervals(entries).where(F.col("from_day") <= F.lit(last)).withColumn("month", F.explode(F.sequence(month("from_day"), month(F.least(F.coalesce("until_day", F.lit(last)), F.lit(last))), F.expr("interval 1 month"))))
    spans = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # Equal captures are one row of the join, so it is their number that the aggregate keeps.
    kinds = own.groupBy("id", "host", "day").agg(F.count(F.lit(1)).alias("times"))
    open_rows = kinds.select("id", "host", "day", F.explode(suffixes(F.col("host"))).alias("suffix"), month("day").alias("month"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    active = (F.col("from_day") <= F.col("day")) & (F.col("until_day").isNull() | (F.col("day") < F.col("until_day")))
    met = open_rows.join(spans, ["suffix", "month", "salt"]).where(active)
    found = met.groupBy("id", "host", "day").agg(F.count(F.lit(1)).alias("n_active"), F.min(F.concat_ws(" ", "suffix", "category")).alias("first_rule"))
    k, f = kinds.alias("k"), found.alias("f")
    same = F.col("k.id").eqNullSafe(F.col("f.id")) & (F.col("k.host") == F.col("f.host")) & F.col("k.day").eqNullSafe(F.col("f.day"))
    judged = k.join(f, same, "left").select("k.id", "k.host", "k.day", F.coalesce("f.n_active", F.lit(0)).alias("n_active"), "f.first_rule", F.col("f.n_active").isNotNull().alias("blocked"), "k.times")
    return judged.select("id", "host", "day", "n_active", "first_rule", "blocked", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).drop("col")


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("int")


def sample_captures(pages: DataFrame) -> DataFrame:
    """Captures of pages, which have no date: one is derived from page_id."""
    return pages.select(F.col("page_id").alias("id"), "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int")).alias("day"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """A dated list derived from the hosts themselves: some hosts come, go and come again, some parent domains come and go."""
    hosts = pages.select(host_of(F.col("url")).alias("suffix")).where("suffix <> ''").distinct().withColumn("k", _number(F.col("suffix")))
    parents = hosts.select(F.substring_index("suffix", ".", -3).alias("suffix")).distinct().withColumn("k", _number(F.concat(F.lit("p"), "suffix")))
    rows = lambda at, category, *days: at.select("suffix", F.lit(category).alias("category"), F.explode(F.array(*[F.struct(F.date_add(F.lit("2024-01-01").cast("date"), d).alias("day"), F.lit(s).alias("seq"), F.lit(a).alias("action")) for s, (d, a) in enumerate(days)])).alias("e")).select("suffix", "category", "e.day", "e.seq", "e.action")
    k = F.col("k")
    spam = rows(hosts.where(k % 5 < 2), "spam", (k % 300, "add"), (k % 300 + 20 + k % 40, "remove"), (k % 300 + 120, "add"))
    adult = rows(parents.where(k % 3 == 0), "adult", (k % 350, "add"), (k % 350 + 45, "remove"))
    return spam.unionByName(adult)


ORACLE = rf"""
WITH p AS (SELECT page_id AS id, coalesce(lower(regexp_extract(url, '{HOST}', 1)), '') AS host, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS day FROM pages),
h AS (SELECT suffix, CAST('0x' || substr(md5(suffix), 1, 7) AS INTEGER) AS k FROM (SELECT DISTINCT host AS suffix FROM p WHERE host <> '')),
q AS (SELECT suffix, CAST('0x' || substr(md5('p' || suffix), 1, 7) AS INTEGER) AS k FROM (SELECT DISTINCT array_to_string(list_slice(string_split(suffix, '.'), -3, -1), '.') AS suffix FROM h)),
e AS (
  SELECT suffix, 'spam' AS category, DATE '2024-01-01' + k % 300 AS day, 'add' AS action FROM h WHERE k % 5 < 2
  UNION ALL SELECT suffix, 'spam', DATE '2024-01-01' + (k % 300 + 20 + k % 40), 'remove' FROM h WHERE k % 5 < 2
  UNION ALL SELECT suffix, 'spam', DATE '2024-01-01' + (k % 300 + 120), 'add' FROM h WHERE k % 5 < 2
  UNION ALL SELECT suffix, 'adult', DATE '2024-01-01' + k % 350, 'add' FROM q WHERE k % 3 = 0
  UNION ALL SELECT suffix, 'adult', DATE '2024-01-01' + (k % 350 + 45), 'remove' FROM q WHERE k % 3 = 0),
v AS (SELECT *, lead(day) OVER (PARTITION BY suffix, category ORDER BY day) AS until_day FROM e),
a AS (SELECT p.id, p.host, p.day, count(*) AS n, min(v.suffix || ' ' || v.category) AS first_rule
  FROM p JOIN v ON v.action = 'add' AND (p.host = v.suffix OR ends_with(p.host, '.' || v.suffix)) AND v.day <= p.day AND (v.until_day IS NULL OR p.day < v.until_day) GROUP BY 1, 2, 3)
SELECT p.id AS page_id, p.host, p.day AS fetch_day, coalesce(a.n, 0) AS n_active, a.first_rule, a.n IS NOT NULL AS blocked
FROM p LEFT JOIN a ON a.id = p.id AND a.host = p.host AND a.day = p.day
"""
