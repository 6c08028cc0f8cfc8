"""Declared tables, the SQL front, logs, and plans."""

import io
from contextlib import redirect_stdout

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.engine import Engine, split_outside
from lodestone.functions.registry import FunctionRegistry
from lodestone.registry import QUERIES
from lodestone.session import table
from lodestone.sources import files
from lodestone.sources.catalog import Catalog, EngineError
from lodestone.sources.types import byte_size, parse_type
from lodestone.streaming.log import Consumer, Interceptor, Log, Producer, Record


def test_statements_are_split_outside_of_quotes():
    assert split_outside("a ';' b; c (1; 2); ", ";") == ["a ';' b", "c (1; 2)"]


def test_types():
    assert parse_type("decimal(10, 2)")[0].simpleString() == "decimal(10,2)" and parse_type("int[]")[0].simpleString() == "array<int>"
    kind, metadata = parse_type("VECTOR(3)")
    assert kind.simpleString() == "array<float>" and metadata == {"vector_dim": 3} and byte_size(kind, 3) == 12
    with pytest.raises(ValueError):
        parse_type("shape")


def test_engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}", slow_ms=0)
    e.sql("CREATE TABLE t_types (small TINYINT, big UINT64, price NUMERIC(8, 3), at DATETIME, raw BLOB, near VECTOR(4), tags TEXT[])")
    assert [f.dataType.simpleString() for f in e.catalog.table("t_types").schema] == ["tinyint", "decimal(20,0)", "decimal(8,3)", "timestamp_ntz", "binary", "array<float>", "array<string>"]
    e.sql("CREATE TABLE t_users (id INT, name VARCHAR(100) DEFAULT 'nobody', PRIMARY KEY (id))")
    for bad, state in (("CREATE TABLE t_users (id INT)", "42P07"), ("DROP TABLE t_none", "42P01"), ("DROP INDEX i_none", "42704"), ("SELECT * FROM t_none", "42P01"), ("SELEC 1", "42601"), ("INSERT INTO t_users (id) VALUES (1, 2)", "42601")):
        with pytest.raises(EngineError) as error:
            e.sql(bad)
        assert error.value.state == state
    assert e.sql("INSERT INTO t_users (id, name) VALUES (1, 'ida'), (2, NULL), (3, 'a;b')").first().tag == "INSERT 0 3"
    before = e.sql("SELECT count(*) AS n FROM t_users")
    assert before.first().n == 3 and e.sql("SELECT count(*) AS n FROM t_users") is before
    e.sql("INSERT INTO t_users (id) VALUES (4)")
    assert e.sql("SELECT name FROM t_users WHERE id = 4").first().name == "nobody"
    assert e.sql("UPDATE t_users SET name = 'olaf' WHERE id = 2").first().tag == "UPDATE 1"
    assert e.sql("DELETE FROM t_users WHERE id = 3").first().tag == "DELETE 1"
    assert e.sql("SELECT name FROM t_users WHERE id = ?", [2]).first().name == "olaf"
    e.sql("CREATE INDEX ON t_users (name); ALTER TABLE t_users ADD COLUMN age INT; ALTER TABLE t_users RENAME COLUMN name TO who")
    assert sorted(e.sql("SELECT * FROM t_users").columns) == ["age", "id", "who"] and e.slow[-1][0] == "SELECT * FROM t_users"
    with pytest.raises(EngineError):
        e.sql("ALTER TABLE t_users DROP COLUMN id")
    assert [r.extra for r in e.sql("DESCRIBE t_users").collect()][0] == "primary key"
    again = Catalog(spark, f"file://{tmp_path}")
    assert again.table("t_users").indexes["t_users_idx"]["columns"] == ["who"] and again.read("t_users").count() == 3
    e.sql("SET x = 1; TRUNCATE t_users; DROP TABLE t_users; DROP TABLE IF EXISTS t_users")


def test_alter_table(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    e.sql("CREATE TABLE a_items (k INT, what TEXT, PRIMARY KEY (k)); INSERT INTO a_items VALUES (7, 'lamp'), (8, NULL); CREATE INDEX by_what ON a_items (what)")
    e.sql("ALTER TABLE a_items ADD COLUMN price DECIMAL(6,2) DEFAULT 2.50")
    assert [str(r.price) for r in e.sql("SELECT price FROM a_items").collect()] == ["2.50", "2.50"]
    with pytest.raises(EngineError) as error:
        e.sql("ALTER TABLE a_items ADD COLUMN must INT NOT NULL")
    assert error.value.state == "23502" and e.catalog.table("a_items").schema.names == ["k", "what", "price"]
    e.sql("ALTER TABLE a_items RENAME COLUMN what TO label")
    assert e.catalog.index("by_what")[1]["columns"] == ["label"]
    for bad, state in (("DROP COLUMN none", "42703"), ("RENAME COLUMN none TO x", "42703"), ("RENAME COLUMN label TO price", "42701"), ("DROP COLUMN k", "42P16")):
        with pytest.raises(EngineError) as error:
            e.sql(f"ALTER TABLE a_items {bad}")
        assert error.value.state == state
    e.sql("ALTER TABLE a_items DROP COLUMN label")
    assert e.catalog.list_indexes().count() == 0
    # The registry of the highest number counts, and only the last two versions of data are kept.
    again = Catalog(spark, f"file://{tmp_path}")
    assert again.table("a_items").schema.names == ["k", "price"] and len(list((tmp_path / "registry").glob("*.json"))) == 2
    assert len(list((tmp_path / "a_items").iterdir())) == 2
    (tmp_path / "registry" / f"{again.number + 1}.tmp").write_text("half")
    assert Catalog(spark, f"file://{tmp_path}").number == again.number


def test_results_are_kept_only_while_they_hold(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}", cache_bytes=100_000)
    e.sql("CREATE OR REPLACE TEMP VIEW c_view AS SELECT 1 AS x")
    first = e.sql("SELECT x FROM c_view")
    assert e.sql("SELECT x FROM c_view") is first
    e.sql("CREATE OR REPLACE TEMP VIEW c_view AS SELECT 2 AS x")
    assert e.sql("SELECT x FROM c_view").first().x == 2
    for text in ("SELECT rand() AS r", "SELECT now() AS t", "SELECT uuid() AS u", "SELECT id FROM range(1000000)"):
        assert e.sql(text) is not e.sql(text)
    for k in range(40):
        e.sql(f"SELECT id + {k} AS x FROM range(1000)")
    assert sum(n for _, n in e._cache.values()) <= 100_000


def test_statements_beyond_the_basics(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/catalog")
    e.sql("CREATE TABLE b_stock (k INT, n INT DEFAULT 1, PRIMARY KEY (k))")
    assert [tuple(r) for r in e.sql("INSERT INTO b_stock (k) VALUES (1), (2), (3) RETURNING k * 10 AS t, n").orderBy("t").collect()] == [(10, 1), (20, 1), (30, 1)]
    assert [tuple(r) for r in e.sql("DELETE FROM b_stock WHERE k = 3 RETURNING k").collect()] == [(3,)]
    assert [tuple(r) for r in e.sql("UPDATE b_stock SET n = n + 4 WHERE k = 2 RETURNING *").collect()] == [(2, 5)]
    e.sql("UPDATE b_stock SET n = extract(YEAR FROM DATE '2020-05-05') WHERE k = 1")
    assert e.sql("SELECT n FROM b_stock WHERE k = ANY (SELECT 1)").first().n == 2020
    with pytest.raises(EngineError) as error:
        e.sql("MERGE INTO b_stock USING (SELECT * FROM VALUES (1, 1), (1, 2) AS v(k, n)) s ON b_stock.k = s.k WHEN MATCHED THEN UPDATE SET n = s.n")
    assert error.value.state == "21000"
    assert e.sql("MERGE INTO b_stock USING (SELECT * FROM VALUES (1, 7), (9, 8) AS v(k, n)) s ON b_stock.k = s.k WHEN MATCHED THEN UPDATE SET n = s.n WHEN NOT MATCHED AND s.n > 8 THEN INSERT (k, n) VALUES (s.k, s.n)").first().tag == "MERGE 1"
    assert e.sql("CREATE TABLE b_copy AS SELECT k, n FROM b_stock").first().tag == "SELECT 2"
    assert e.sql(f"COPY b_copy TO 'file://{tmp_path}/out' STORED AS JSON").first().tag == "COPY 2"
    e.sql("SET batch.rows = 50")
    assert e.sql("SHOW batch.rows").first().value == "50"
    seen = e.sql("EXPLAIN ANALYZE SELECT k FROM b_stock").first()
    assert seen.rows == 2 and "FileScan" in seen.plan and seen.milliseconds > 0
    assert "Scan" in e.sql("EXPLAIN SELECT k FROM b_stock").first()[0]
    assert e.sql("SELECT table_name FROM information_schema.tables ORDER BY 1").first().table_name == "b_copy"
    e.sql("CREATE VIEW b_view AS SELECT max(n) AS top FROM b_stock")
    with pytest.raises(EngineError):
        e.sql("CREATE VIEW b_view AS SELECT 1 AS x")
    assert e.sql("SELECT top FROM b_view").first().top == 7
    e.sql("DROP VIEW b_view; DROP VIEW IF EXISTS b_view; DROP TABLE b_copy; DROP TABLE b_stock")


def test_vector_indexes(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    e.sql("CREATE TABLE v_items (id INT, v VECTOR(2), tag TEXT, PRIMARY KEY (id)); INSERT INTO v_items VALUES (1, array(0.5F, 0F), 'a'), (2, array(3F, 4F), 'b'), (3, array(0F, 0.1F), 'b')")
    with pytest.raises(EngineError) as error:
        e.sql("CREATE INDEX v_bad ON v_items (v) WITH (dimension = 3)")
    assert error.value.state == "22023"
    e.sql("CREATE INDEX v_near ON v_items USING flat (v) WITH (dimension = 2, shards = 4)")
    assert [(r.id, r.tag) for r in e.sql("SEARCH INDEX v_near FOR [0, 0] LIMIT 2").collect()] == [(3, "b"), (1, "a")]
    assert [r.id for r in e.sql("SEARCH INDEX v_near FOR [0, 0] WITHIN 1 WHERE tag = 'a'").collect()] == [1]
    with pytest.raises(EngineError):
        e.sql("SEARCH INDEX v_near FOR [0, 0, 0]")
    e.catalog.delete_rows("v_items", spark.createDataFrame([(3,)], "id int"))
    assert [r.id for r in e.catalog.search("v_near", [0.0, 0.0], 1).collect()] == [1]
    assert '"shards": 4' in e.sql("SHOW INDEXES FROM v_items").first().params
    e.sql("DROP INDEX v_near; DROP TABLE v_items")


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    for kind in ("csv", "json", "orc", "parquet"):
        files.write(rows, f"{tmp_path}/{kind}", kind)
        assert sorted(files.read(spark, f"{tmp_path}/{kind}", kind, "id int, s string").collect()) == sorted(rows.collect())
    with pytest.raises(ValueError):
        files.read(spark, f"{tmp_path}/csv", "csv")
    own = pa.table({"s": ["a", None], "id": pa.array([1, 2], pa.int32()), "more": [0.5, 1.5]})
    (tmp_path / "arrow").mkdir()
    with pa.ipc.new_file(str(tmp_path / "arrow" / "a.arrow"), own.schema) as out:
        out.write_table(own)
    with pa.ipc.new_stream(str(tmp_path / "arrow" / "b.arrows"), own.schema) as out:
        out.write_table(own)
    assert sorted(files.read(spark, f"{tmp_path}/arrow", "arrow", "id int, s string").collect()) == sorted(rows.collect() * 2)


def test_functions_registry(spark):
    own = FunctionRegistry(spark)
    own.register("twice", lambda s: s * 2, "long")
    with pytest.raises(ValueError):
        own.register("twice", lambda s: s, "long")
    assert spark.sql("SELECT twice(id) AS x FROM range(3)").agg(F.sum("x")).first()[0] == 6
    own.unregister("twice")
    assert own.list() == []


def test_log(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log")
    log.create_topic("t")
    producer = Producer(log, "json", interceptors=[lambda r: None if r.value == "drop" else r])
    assert producer.send_sync(Record("t", {"a": 1}, "k")) == 0 and producer.send_sync(Record("t", "drop")) is None
    producer.begin()
    producer.send(Record("t", 2))
    producer.abort()
    producer.begin()
    producer.send(Record("t", 3))
    producer.send(Record("t", 4))
    producer.commit()
    consumer = Consumer(log, "g")
    consumer.subscribe("t")
    assert [bytes(r.value) for r in consumer.poll(2).collect()] == [b'{"a": 1}', b"3"]
    consumer.commit()
    other = Consumer(log, "g")
    other.subscribe("t")
    assert other.position("t") == 2 and [r.offset for r in other.poll().collect()] == [2]
    late = Consumer(log, "h", "latest")
    late.subscribe("t")
    assert late.poll().count() == 0
    late.seek("t", 0)
    late.pause("t")
    assert late.poll().count() == 0
    late.resume("t")
    assert late.poll().count() == 3
    with pytest.raises(ValueError):
        Consumer(log, "x", "none").subscribe("t")
    log.delete_topic("t")
    assert log.topics() == []


def test_log_transactions(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log")
    for t in ("one", "two"):
        log.create_topic(t)
    heard = []

    class Ear(Interceptor):
        def on_acknowledgement(self, record, offset, error):
            heard.append((record.topic, offset, error is None))
            raise RuntimeError("an observer's fault")

    producer = Producer(log, interceptors=[Ear()])
    assert producer.send_sync(Record("one", "a")) == 0
    latest = Consumer(log, "late", "latest")
    latest.subscribe("one")
    assert latest.position("one") == 1 and latest.poll().count() == 0
    producer.begin()
    with pytest.raises(RuntimeError):
        producer.send_sync(Record("one", "b"))
    producer.send_offsets("g", {"one": 1})
    producer.send(Record("one", "b"))
    producer.send(Record("none", "c"))  # no such topic: the commit fails after topic one was written
    with pytest.raises(Exception, match="none|exist"):
        producer.commit()
    assert log.read("one").count() == 1 and log.read("one", committed=False).count() == 2 and log.committed("g") == {}
    producer.begin()
    producer.send(Record("one", "d"))
    producer.send(Record("two", "e"))
    producer.send_offsets("g", {"one": 1})
    producer.commit()
    assert log.committed("g") == {"one": 1} and heard[-2:] == [("one", 2, True), ("two", 0, True)] and ("none", None, False) in heard
    reader = Consumer(log, "g")
    reader.subscribe("one")
    assert [bytes(r.value) for r in reader.poll(1).collect()] == [b"d"] and reader.position("one") == 3
    all_of = Consumer(log, "x", committed=False)
    all_of.subscribe("one")
    assert all_of.poll().count() == 3
    assert log.reset_group("g", "one", "earliest") == 0 and log.reset_group("g", "one", "latest") == 3 and log.reset_group("g", "one", 99) == 3
    assert [tuple(r) for r in log.groups().collect()] == [("g", "one", 3)]
    log.delete_group("g")
    assert log.groups().count() == 0
    assert log.expire("one", most=1) == 1 and log.end("one") == 3 and log.expire("two", before_ms=1 << 50) == 1


def test_filters_and_columns_reach_the_scan(spark, sf):
    from lodestone.registry import QUERIES

    out = io.StringIO()
    with redirect_stdout(out):
        QUERIES["scan_project"](spark, sf).explain("formatted")
    text = out.getvalue()
    assert "GreaterThan(o_totalprice,150000" in text and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text
    assert table(spark, sf, "orders").count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_frame_functions_see_whole_batches(spark):
    def spread(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        assert len(starts) > 1  # not called a row at a time
        return np.maximum.reduceat(values, starts) - np.minimum.reduceat(values, starts)

    own = FunctionRegistry(spark)
    own.register("frame_spread", spread, "double", "frame")
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("a", 3, 8.0), ("a", 4, 1.0), ("a", 5, 2.0), ("b", 1, None), ("b", 2, None), ("c", 1, 7.0)], "g string, i int, x double").coalesce(1)
    text = "SELECT g, i, frame_spread(collect_list(x) OVER w) AS got, max(x) OVER w - min(x) OVER w AS want FROM {rows} WINDOW w AS (PARTITION BY g ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
    found = spark.sql(text, rows=rows).collect()
    assert len(found) == 8 and all(r.got == r.want for r in found) and [r.got for r in found if r.g == "b"] == [None, None]
    own.unregister("frame_spread")


def test_window_query_calls_no_function_a_row(spark, sf, tmp_path):
    plan = QUERIES["udf_window"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "ArrowWindowPython" not in plan and "WindowInPandas" not in plan
    spark.createDataFrame([(1, 1, None), (2, 1, 4.0), (3, 1, 9.0)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(map(tuple, QUERIES["udf_window"](spark, str(tmp_path)).collect())) == [(1, None), (2, 0.0), (3, 5.0)]
