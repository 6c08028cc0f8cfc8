"""User functions, files, and the declared-table front."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions.registry import FunctionRegistry
from ..registry import query
from ..session import table
from ..sources import files
from ..streaming.log import Consumer, Log, Producer, Record
from ..streaming.run import work_folder


@query("SELECT p_partkey, round(p_retailprice * 1.19, 4) AS gross FROM part")
def udf_pandas(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("double")
    def gross(price: pd.Series) -> pd.Series:
        return price * 1.19

    return table(spark, d, "part").select("p_partkey", F.round(gross("p_retailprice"), 4).alias("gross"))


@query("SELECT n_nationkey, reverse(n_name) AS back FROM nation")
def udf_scalar(spark: SparkSession, d: str) -> DataFrame:
    back = F.udf(lambda s: None if s is None else s[::-1], "string", useArrow=True)
    return table(spark, d, "nation").select("n_nationkey", back("n_name").alias("back"))


@query("SELECT l_returnflag, round(max(l_extendedprice) - min(l_extendedprice), 2) AS spread FROM lineitem GROUP BY 1")
def udf_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """A grouped-aggregate function sees a whole group, so groups are first brought to partial extremes per salt."""

    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    salted = table(spark, d, "lineitem").groupBy("l_returnflag", (F.col("l_orderkey") % 64).alias("salt")).agg(F.max("l_extendedprice").alias("hi"), F.min("l_extendedprice").alias("lo"))
    ends = salted.select("l_returnflag", F.explode(F.array("hi", "lo")).alias("x"))
    return ends.groupBy("l_returnflag").agg(F.round(spread("x"), 2).alias("spread"))


@query("SELECT o_orderkey, round(max(o_totalprice) OVER w - min(o_totalprice) OVER w, 2) AS spread FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def udf_window(spark: SparkSession, d: str) -> DataFrame:
    """A registered function over frames of three rows, called on all frames of a batch at once."""

    def spread(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(values, starts) - np.minimum.reduceat(values, starts)

    functions = FunctionRegistry(spark)
    functions.register("lodestone_spread", spread, "double", "frame")
    return spark.sql("SELECT o_orderkey, round(lodestone_spread(collect_list(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)), 2) AS spread FROM {orders}", orders=table(spark, d, "orders"))


@query("SELECT n_nationkey, unnest(range(0, n_regionkey + 1)) AS step FROM nation")
def udf_table(spark: SparkSession, d: str) -> DataFrame:
    @F.udtf(returnType="step bigint")
    class Steps:
        def eval(self, n: int):  # noqa: ANN202
            for i in range(n + 1):
                yield (i,)

    spark.udtf.register("lodestone_steps", Steps)
    return spark.sql("SELECT n_nationkey, step FROM {nation}, LATERAL lodestone_steps(n_regionkey)", nation=table(spark, d, "nation"))


@query("SELECT r_regionkey, r_name FROM region")
def files_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Through CSV, JSON and ORC with declared schemas."""
    folder, rows = work_folder(spark), table(spark, d, "region")
    schema = "r_regionkey int, r_name string"
    files.write(rows, f"{folder}/csv", "csv")
    files.write(files.read(spark, f"{folder}/csv", "csv", schema), f"{folder}/json", "json")
    files.write(files.read(spark, f"{folder}/json", "json", schema), f"{folder}/orc", "orc")
    return files.read(spark, f"{folder}/orc", "orc")


@query("SELECT * FROM (VALUES (10, 'ida', 31.5), (20, 'olaf', 40.0), (40, 'nils', NULL)) t(id, name, score)".replace("31.5", "CAST(31.5 AS DOUBLE)").replace("40.0", "CAST(40.0 AS DOUBLE)"))
def ddl_dml(spark: SparkSession, d: str) -> DataFrame:
    """Declares a table and changes it: inserts (the last of a key stands), an update, a deletion."""
    engine = Engine(spark, work_folder(spark))
    engine.sql("CREATE TABLE lodestone_users (id INT, name VARCHAR(100) NOT NULL, score DOUBLE PRECISION, PRIMARY KEY (id))")
    engine.sql("INSERT INTO lodestone_users (id, name, score) VALUES (10, 'ida', 30.0), (20, 'ole', 40.0), (30, 'eva', NULL); INSERT INTO lodestone_users (id, name) VALUES (40, 'nils'), (10, 'ida')")
    engine.sql("UPDATE lodestone_users SET name = 'olaf' WHERE id = 20; UPDATE lodestone_users SET score = 31.5 WHERE id = 10")
    engine.sql("DELETE FROM lodestone_users WHERE id = 30; CREATE INDEX ON lodestone_users (name)")
    return engine.sql("SELECT id, name, score FROM lodestone_users")


@query("SELECT * FROM (VALUES (1, 'x', 5, 'n,m'), (2, 'y', 5, 'm')) t(id, title, rank, columns)")
def ddl_alter(spark: SparkSession, d: str) -> DataFrame:
    """Columns are added with a default, dropped and renamed; indexes follow, and one on a dropped column goes."""
    engine = Engine(spark, work_folder(spark))
    engine.sql("CREATE TABLE lodestone_alter (id INT, name TEXT, age INT, PRIMARY KEY (id)); INSERT INTO lodestone_alter VALUES (1, 'x', 30), (2, 'y', 40)")
    engine.sql("CREATE INDEX n ON lodestone_alter (name); CREATE INDEX m ON lodestone_alter (name, id); CREATE INDEX o ON lodestone_alter (age)")
    engine.sql("ALTER TABLE lodestone_alter ADD COLUMN rank INT NOT NULL DEFAULT 5; ALTER TABLE lodestone_alter RENAME COLUMN name TO title; ALTER TABLE lodestone_alter DROP COLUMN age")
    own = engine.catalog.list_indexes("lodestone_alter").select("name", F.explode("columns").alias("c")).where("c in ('title', 'id')")
    first = own.where("c = 'title'").agg(F.array_join(F.reverse(F.sort_array(F.collect_list("name"))), ",").alias("a"))
    second = own.where("c = 'id'").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("b"))
    rows = engine.sql("SELECT id, title, rank FROM lodestone_alter").join(F.broadcast(first.crossJoin(second)))  # one row
    return rows.select("id", "title", "rank", F.when(F.col("id") == 1, F.col("a")).otherwise(F.col("b")).alias("columns"))


@query("SELECT * FROM (VALUES ('id', 'int', 'NO'), ('name', 'string', 'YES')) t(column_name, data_type, is_nullable)")
def sql_information_schema(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark, work_folder(spark))
    engine.sql("CREATE TABLE lodestone_info (id INT, name TEXT DEFAULT 'a', PRIMARY KEY (id))")
    return engine.sql("SELECT c.column_name, c.data_type, c.is_nullable FROM information_schema.columns c JOIN information_schema.tables t ON c.table_name = t.table_name WHERE t.table_name SIMILAR TO 'lodestone_(info|none)'")


@query("WITH s AS (SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey < 20), t AS (SELECT n_nationkey AS id, upper(n_name) AS name, n_regionkey AS region FROM nation WHERE n_nationkey >= 10) SELECT coalesce(t.id, s.id) AS id, CASE WHEN s.id IS NULL THEN t.name WHEN t.id IS NULL THEN s.name ELSE s.name || '!' END AS name, CASE WHEN t.id IS NULL THEN 9 ELSE region END AS region FROM t FULL JOIN s ON t.id = s.id WHERE NOT (t.id IS NOT NULL AND s.id IS NOT NULL AND region = 0)")
def sql_merge(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark, work_folder(spark))
    table(spark, d, "nation").createOrReplaceTempView("lodestone_nation")
    engine.sql("CREATE TABLE lodestone_merged (id INT, name TEXT, region INT DEFAULT 9, PRIMARY KEY (id)); INSERT INTO lodestone_merged SELECT n_nationkey, upper(n_name), n_regionkey FROM lodestone_nation WHERE n_nationkey >= 10")
    engine.sql("""MERGE INTO lodestone_merged t USING (SELECT n_nationkey AS id, n_name AS name FROM lodestone_nation WHERE n_nationkey < 20) s ON t.id = s.id
        WHEN MATCHED AND t.region = 0 THEN DELETE WHEN MATCHED THEN UPDATE SET name = s.name || '!' WHEN NOT MATCHED THEN INSERT (id, name) VALUES (s.id, s.name)""")
    return engine.sql("SELECT id, name, region FROM lodestone_merged")


@query("SELECT n_nationkey AS id, r_name || '/' || n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey <> 2")
def sql_update_from(spark: SparkSession, d: str) -> DataFrame:
    """CREATE TABLE AS, UPDATE ... FROM and RETURNING."""
    engine = Engine(spark, work_folder(spark))
    for t in ("nation", "region"):
        table(spark, d, t).createOrReplaceTempView(f"lodestone_{t}")
    engine.sql("CREATE TABLE lodestone_named AS SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM lodestone_nation; DELETE FROM lodestone_named WHERE region = 2")
    return engine.sql("UPDATE lodestone_named SET name = r.r_name || '/' || name FROM lodestone_region r WHERE region = r.r_regionkey RETURNING id, name")


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_size > 5 GROUP BY 1")
def sql_copy(spark: SparkSession, d: str) -> DataFrame:
    """COPY TO, and a table over what it wrote."""
    folder = work_folder(spark)
    engine = Engine(spark, f"{folder}/catalog")
    table(spark, d, "part").createOrReplaceTempView("lodestone_part")
    engine.sql(f"COPY (SELECT p_partkey, p_brand, p_size FROM lodestone_part) TO '{folder}/out' (FORMAT csv); DROP VIEW IF EXISTS lodestone_copied")
    engine.sql(f"CREATE EXTERNAL TABLE lodestone_copied (p_partkey BIGINT, p_brand TEXT, p_size INT) STORED AS CSV LOCATION '{folder}/out'")
    return engine.sql("SELECT p_brand, count(*) AS n FROM lodestone_copied WHERE p_size > 5 GROUP BY p_brand")


@query("SELECT vec_id, label, round(list_distance(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 3)::DOUBLE[]), 4) AS distance FROM embeddings WHERE label <> 1 ORDER BY list_distance(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 3)::DOUBLE[]), vec_id LIMIT 7")
def sql_vector_search(spark: SparkSession, d: str) -> DataFrame:
    """A vector index declared and asked through the SQL front, with a filter on the payload."""
    engine, own = Engine(spark, work_folder(spark)), table(spark, d, "embeddings")
    probe = list(own.where("vec_id = 3").first()["embedding"])
    own.createOrReplaceTempView("lodestone_vectors_in")
    engine.sql(f"CREATE TABLE lodestone_vectors (vec_id BIGINT, embedding VECTOR({len(probe)}), label INT, PRIMARY KEY (vec_id)); INSERT INTO lodestone_vectors SELECT vec_id, embedding, label FROM lodestone_vectors_in")
    engine.sql(f"CREATE INDEX near ON lodestone_vectors USING flat (embedding) WITH (dimension = {len(probe)}, metric = l2)")
    found = engine.sql(f"SEARCH INDEX near FOR [{','.join(map(repr, probe))}] LIMIT 7 WHERE label <> 1")
    return found.select("vec_id", "label", F.round("distance", 4).alias("distance"))


@query("SELECT * FROM (VALUES ('latest after one record', CAST(1 AS BIGINT)), ('seen of a transaction', 2), ('seen of an open one', 0), ('offset sent', 1), ('reset', 0)) t(what, n)")
def log_positions(spark: SparkSession, d: str) -> DataFrame:
    log = Log(spark, f"{work_folder(spark)}/log")
    log.create_topic("a")
    log.create_topic("b")
    producer = Producer(log)
    producer.send_sync(Record("a", "first"))
    late = Consumer(log, "late", "latest")
    late.subscribe("a")
    producer.begin()
    producer.send(Record("a", "x"))
    producer.send(Record("b", "y"))
    producer.send_offsets("late", {"a": 1})
    log.append("b", [Record("b", "left behind")], str.encode, "an open transaction")
    producer.commit()
    consumer = Consumer(log, "g")
    consumer.subscribe("a", "b")
    seen = consumer.poll().select(F.decode("value", "UTF-8").alias("v"))
    n = seen.agg(F.sum(F.col("v").isin("x", "y").cast("long")).alias("x"), F.sum((F.col("v") == "left behind").cast("long")).alias("o")).first()
    rows = [("latest after one record", late.position("a")), ("seen of a transaction", n["x"]), ("seen of an open one", n["o"]), ("offset sent", log.committed("late")["a"]), ("reset", log.reset_group("late", "a", "earliest"))]
    return spark.createDataFrame(rows, "what string, n long")
