"""Operators on small literal tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import functions as L
from lodestone.operators import changes, kv, meta, ordered, streams, vectors, versions
from lodestone.operators.predicate import KeyRange, key_bounds, parse_filter
from lodestone.registry import QUERIES


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "Ann", 30, True), (2, "bob", None, False), (3, None, 50, None), (4, "A.n", 30, True)], "id int, name string, age int, ok boolean")


@pytest.mark.parametrize(
    ("tree", "ids"),
    [
        ({"op": "eq", "col": "age", "val": 30}, [1, 4]),
        ({"op": "ne", "col": "age", "val": 30}, [3]),
        ({"op": "not", "arg": {"op": "eq", "col": "age", "val": 30}}, [3]),
        ({"op": "in", "col": "id", "vals": [{"type": "int", "value": 2}, 3]}, [2, 3]),
        ({"op": "like", "col": "name", "val": "A.n"}, [4]),
        ({"op": "ilike", "col": "name", "val": "a%"}, [1, 4]),
        ({"op": "is_null", "col": "name"}, [3]),
        ({"op": "eq", "col": "ok", "val": False}, [2]),
        ({"op": "between", "col": "age", "low": 30, "high": 50}, [1, 3, 4]),
        ({"op": "or", "args": [{"op": "lt", "col": "id", "val": 2}, {"op": "gt", "col": "age", "val": 40}]}, [1, 3]),
        ({"op": "and", "args": []}, [1, 2, 3, 4]),
        ({"op": "in", "col": "id", "vals": [{"int": 2}, {"null": None}, 4]}, [2, 4]),
        ({"op": "eq", "col": "name", "val": {"str": "bob"}}, [2]),
        ({"op": "ge", "col": "age", "val": {"float": 49.5}}, [3]),
        ({"op": "like", "col": "name", "pattern": "%n"}, [1, 4]),
        ({"op": "eq", "col": "ok", "val": {"bool": True}}, [1, 4]),
        ({"op": "true"}, [1, 2, 3, 4]),
        (None, [1, 2, 3, 4]),
    ],
)
def test_predicates(people, tree, ids):
    assert sorted(r.id for r in people.where(parse_filter(json.dumps(tree) if tree else None)).collect()) == ids


def test_values_of_predicates(spark):
    rows = spark.createDataFrame([(bytearray(b"ab"),), (bytearray(b"c"),)], "b binary")
    assert rows.where(parse_filter({"op": "eq", "col": "b", "val": {"bytes": "YWI="}})).count() == 1
    assert rows.where(parse_filter({"op": "ne", "col": "b", "val": {"null": None}})).count() == 0
    with pytest.raises(ValueError):
        parse_filter({"op": "eq", "col": "b", "val": {"shape": 1}})
    assert key_bounds({"op": "in", "col": "k", "vals": [5, None, {"int": 2}]}, "k") == KeyRange(2, 5) and key_bounds({"op": "in", "col": "k", "vals": [None]}, "k") == KeyRange()


def test_key_bounds():
    both = {"op": "and", "args": [{"op": "ge", "col": "id", "val": 5}, {"op": "lt", "col": "id", "val": 9}, {"op": "eq", "col": "x", "val": 1}]}
    assert key_bounds(both, "id") == KeyRange(5, 9, False, True)
    assert key_bounds({"op": "or", "args": [both]}, "id") == KeyRange()
    assert key_bounds({"op": "eq", "col": "id", "val": "k"}, "id") == KeyRange("k", "k")
    assert key_bounds({"op": "and", "args": [{"op": "gt", "col": "id", "val": 5}, {"op": "le", "col": "id", "val": 5}]}, "id").empty
    assert KeyRange(5, 9, False, True).overlaps(9, None) is False and KeyRange(5, 9).overlaps(9, None) and not KeyRange(5, 9).overlaps(None, 5)


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame([("s", 7_000 + 30 * i, i % 2, {"w": "abcde"[i]}) for i in range(5)], "stream string, ms long, seq long, fields map<string,string>")


def test_stream_reads(spark, five):
    at = 7_060
    assert streams.range_(five, "s").count() == 5
    assert streams.range_(five, "s", (at, 0)).count() == 3 and streams.range_(five, "s", high=(at, 0)).count() == 3
    assert [r.ms for r in streams.range_(five, "s", count=2, newest_first=True).collect()] == [7_120, 7_090]
    assert streams.read(five, {"s": (0, 0)}).count() == 5 and streams.read(five, {"s": (7_120, 0), "none": (0, 0)}).count() == 0 and streams.read(five, {"s": (7_090, 0)}).count() == 2
    assert streams.parse_id("-") == (0, 0) and streams.parse_id("12-3") == (12, 3)
    new = spark.createDataFrame([("s", 7_120, 0, {}), ("s", 8_000, 5, None)], five.schema)
    more = streams.append(five, new)
    assert more.count() == 6 and streams.trim_maxlen(more, 3).count() == 3
    info = streams.info(more).first()
    assert (info.length, info.first_ms, info.last_seq) == (6, 7_000, 5)


def test_groups(spark, five):
    groups = spark.createDataFrame([], "stream string, grp string, last_ms long, last_seq long, entries_read long")
    groups = streams.create_group(groups, "s", "g", (0, 0))
    with pytest.raises(ValueError, match="BUSYGROUP"):
        streams.create_group(groups, "s", "g", (0, 0))
    given, groups, pel = streams.read_group(five, groups, "g", "ida", 100, 3)
    assert given.count() == 3 and groups.first().entries_read == 3
    again, _, _ = streams.read_group(five, groups, "g", "olaf", 100, 10)
    assert again.count() == 2
    ids = pel.where("ms <= 7030").select("stream", "grp", "ms", "seq")
    assert streams.ack(pel, ids.limit(1)).count() == 2
    claimed = streams.claim(pel, ids, "olaf", 500, 400)
    assert claimed.where("consumer = 'olaf' and delivery_count = 2").count() == 2
    assert streams.claim(pel, ids, "olaf", 500, 401).where("consumer = 'olaf'").count() == 0
    assert streams.autoclaim(pel, 500, 100, (7_001, 0), 1).first().ms == 7_030
    assert streams.pending_of(pel, five, "s", "g", "ida").count() == 3
    left, n = streams.delete_consumer(pel, "s", "g", "ida")
    assert n == 3 and left.count() == 0


def test_arrivals_whose_clock_is_behind(spark):
    old = spark.createDataFrame([("s", 50, 3, "o"), ("t", 9, 0, "o")], "stream string, ms long, seq long, fields string")
    new = spark.createDataFrame([("s", 40, "a", 1), ("s", 50, "b", 2), ("s", 60, "c", 3), ("s", 55, "d", 4), ("u", 7, "e", 5), ("u", 7, "f", 6)], "stream string, ms long, fields string, n int")
    got = {r.fields: (r.ms, r.seq) for r in streams.add(old, new, ["n"]).collect() if r.fields != "o"}
    assert got == {"a": (50, 4), "b": (50, 5), "c": (60, 0), "d": (60, 1), "e": (7, 0), "f": (7, 1)}
    capped = streams.add(old, new, ["n"], 2, only_existing=True)
    assert sorted((r.stream, r.fields) for r in capped.collect()) == [("s", "c"), ("s", "d"), ("t", "o")]


def test_waiting_reads(spark, five):
    looks = []
    found = streams.read_waiting(lambda: looks.append(1) or (five if len(looks) > 2 else five.limit(0)), {"s": (0, 0)}, 2, 20_000, 10)
    assert found.count() == 2 and len(looks) == 3
    assert streams.read_waiting(lambda: five, {"s": (1 << 50, 0)}, 2, 1, 1).count() == 0


def test_ordered(spark):
    import random

    rng = random.Random(3)
    rows = [(i, i % 3, rng.choice([None, *range(40)]), rng.random()) for i in range(500)] + [(1000, 9, 5, 0.5), (1001, 8, None, 0.0)]
    df = spark.createDataFrame(rows, "i int, g int, v int, w double").repartition(4)
    exact = {r.g: (r.a, r.b) for r in df.groupBy("g").agg(F.median("v").alias("a"), F.percentile("v", 0.9).alias("b")).collect()}
    got = {r.g: (r.a, r.b) for r in ordered.percentiles(df, ["g"], "v", {"a": 0.5, "b": 0.9}, 7).collect()}
    assert set(got) == set(exact) - {8} and all(abs(x - y) < 1e-9 for g in got for x, y in zip(got[g], exact[g], strict=True))
    for g, q in ((0, 0.3), (1, 1.0), (2, 0.0)):
        own = sorted((r[2], r[3]) for r in rows if r[1] == g and r[2] is not None)
        total, upto = sum(w for _, w in own), 0.0
        for v, w in own:
            upto += w
            if upto >= q * total - 1e-9:
                break
        assert {r.g: r.p for r in ordered.weighted_percentiles(df, ["g"], "v", "w", {"p": q}, 7).collect()}[g] == v
    numbered = {r.i: (r.rn, r.total) for r in ordered.row_numbers(df, ["g"], ["w", "i"], 5).collect()}
    for g in (0, 1, 2, 8, 9):
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[3], r[0]))
        assert [numbered[r[0]] for r in own] == [(k + 1, len(own)) for k in range(len(own))]
    best, top = {}, None
    for r in sorted(rows, key=lambda r: r[0]):
        best[r[0]] = top
        top = r[3] if top is None else max(top, r[3])
    assert {r.i: r.m for r in ordered.running_max(df, [], ["i"], "w", "m", 6).collect()} == best
    assert ordered.row_numbers(df.limit(0), ["g"], ["w"]).count() == 0
    with pytest.raises(ValueError):
        ordered.weighted_percentiles(df, ["g"], "v", "w", {"p": 1.5})


def test_kv(spark):
    own = spark.createDataFrame([("a", "1", None), ("b", "x", 50), ("c", "7", 500)], "key string, value string, expiry long")
    assert kv.get(own, "b", 50).count() == 0 and kv.get(own, "b", 49).first().value == "x"
    keys = spark.createDataFrame([(1, "a"), (2, "zz"), (3, "a")], "ord int, key string")
    assert [r.found for r in kv.mget(own, keys, 100).orderBy("ord").collect()] == [True, False, True]
    assert kv.exists(own, keys.select("key"), 100).first().n == 2
    rows = spark.createDataFrame([("a", "9", None), ("n", "0", None)], own.schema)
    assert {r.key: r.value for r in kv.put(own, rows, 100, "nx").collect()}["a"] == "1"
    assert "n" not in {r.key for r in kv.put(own, rows, 100, "xx").collect()}
    got = {r.key: r.value for r in kv.incr(own, spark.createDataFrame([("a", 2), ("a", 3), ("q", -1), ("b", 1), ("c", 1)], "key string, delta long"), 40).collect()}
    assert got == {"a": 6, "q": -1, "b": None, "c": 8}
    assert {r.key: r.ttl for r in kv.ttl(own, 100, "ms").collect()} == {"a": -1, "b": -2, "c": 400}
    assert kv.scan(own, "a", "b").count() == 2 and kv.scan(own, limit=0).count() == 3
    persisted = kv.expire(own, spark.createDataFrame([("b", None)], "key string, at long"))
    assert persisted.where("key = 'b'").first().expiry is None and kv.sweep(persisted, 600).count() == 2


def test_changes(spark):
    log = spark.createDataFrame([(1, "put", "d", "k1", "a"), (2, "put", "t", "k2", "b"), (3, "delete", "d", "k1", None)], "seq long, op string, cf string, key string, value string")
    assert [r.seq for r in changes.get_changes(log, 1).collect()] == [2, 3] and changes.get_changes(log, 0, cf="t").count() == 1
    assert changes.last_seq(log.limit(0), 7).first()[0] == 7
    assert [r.key for r in changes.replay(log, ["key"]).collect()] == ["k2"]
    acks = spark.createDataFrame([("c", 2), ("c", 9)], "consumer string, seq long")
    assert {r.consumer: r.offset for r in changes.offsets(log, acks, ["c", "d"]).collect()} == {"c": 3, "d": 0}
    asked = spark.createDataFrame([("k", "x", 0), ("k", "y", 5), ("k", "z", 100)], "key string, result string, ts long")
    assert sorted(r.answer for r in changes.first_results(asked, "key", ["ts"], ttl=50).collect()) == ["x", "x", "z"]


def test_versions(spark):
    rows = spark.createDataFrame([("a", "1", 0, 1, False), ("a", "2", 2, 3, False), ("a", None, 4, 5, True), ("b", "9", 0, 9, False)], "key string, value string, start_ts long, commit_ts long, is_delete boolean")
    at = lambda t: {r.key: r.value for r in versions.snapshot(rows, t).collect()}
    assert at(2) == {"a": "1"} and at(4) == {"a": "2"} and at(9) == {"b": "9"}
    mine = spark.createDataFrame([("a", "m", False)], "key string, value string, is_delete boolean")
    assert {r.key: r.value for r in versions.snapshot(rows, 2, mine).collect()} == {"a": "m"}
    waits = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "waiter long, holder long")
    assert sorted(r.txn for r in versions.deadlocked(waits).collect()) == [1, 2, 3]


def test_deadlocked_follows_long_cycles(spark):
    waits = spark.createDataFrame([(i, (i + 1) % 40) for i in range(40)] + [(50, 0), (0, 60)], "waiter long, holder long")
    assert sorted(r.txn for r in versions.deadlocked(waits).collect()) == [*range(40)]
    with pytest.raises(RuntimeError):
        versions.deadlocked(waits, most_steps=2)


def test_conflicts_against_all_pairs(spark):
    import random

    rng = random.Random(8)
    reads = [(rng.randrange(30), rng.randrange(50), f"k{rng.randrange(4)}") for _ in range(60)]
    writes = [(rng.randrange(30), rng.randrange(50), f"k{rng.randrange(5)}") for _ in range(40)]
    r, w = spark.createDataFrame(reads, "txn long, start_ts long, key string"), spark.createDataFrame(writes, "txn long, commit_ts long, key string")
    want = {}
    for txn, start, key in reads:
        if own := [(c, t) for t, c, k in writes if k == key and t != txn and c > start]:
            want[txn, start, key] = max(own)
    got = versions.read_conflicts(r, w).collect()
    assert {(x.txn, x.start_ts, x.key): (x.last_commit, x.last_writer) for x in got} == want and len(got) == len(want)
    changed = {t for t, c, k in writes if any(k == key and t != txn and start < c for txn, start, key in reads)}
    assert {x.txn for x in versions.pivot_transactions(r, w).collect()} == changed & {t for t, _, _ in want}


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [2.0, 0.5]), (2, [-1.0, 3.0]), (3, [0.0, -4.0]), (4, [2.5, 0.5]), (5, [1.0]), (6, None), (7, [2.5, 0.5]), (8, [2.0, None])], "vec_id long, embedding array<float>")
    found = vectors.knn(rows, [2.0, 0.5], 3).collect()
    assert [(r.vec_id, r.distance) for r in found] == [(1, 0.0), (4, 0.5), (7, 0.5)]  # ties by id
    assert vectors.knn(rows, [2.0, 0.5], 9, radius=0.6).count() == 3
    asked = spark.createDataFrame([(70, [2.4, 0.5]), (80, [0.0, -9.0]), (90, None), (95, [3.0])], "qid long, query array<double>")
    assert sorted((r.qid, r.id) for r in vectors.batch_knn(rows, asked, 1).collect()) == [(70, 4), (80, 3), (95, 5)]
    assert spark.range(1).select(L.l2_distance(F.array(F.lit(1), F.lit(-2)), F.array(F.lit(6), F.lit(10)))).first()[0] == 13.0
    parts = spark.createDataFrame([("p", 0.9), ("q", 0.2), ("p", 0.25), ("r", 0.25), ("s", 2.0)], "doc_id string, distance double")
    assert [r.doc_id for r in vectors.merge_topk(parts, 3).collect()] == ["q", "p", "r"]


def test_meta(spark):
    rows = spark.createDataFrame([(127, [1.0, 2.0, 3.0], "x"), (128, [1.0, 2.0], "y"), (-128, None, None)], "a int, v array<float>, s string")
    bad = meta.validate(rows, [meta.check("a", "int8"), meta.check("v", "vector", dim=3), meta.check("s", "string", nullable=False)])
    assert {r.a: r.reasons for r in bad.collect()} == {128: ["out_of_range:a", "wrong_dimension:v"], -128: ["not_nullable:s"]}
    stats = {r.name: r for r in meta.column_stats(rows, ["a", "s"]).collect()}
    assert (stats["a"].distinct_count, stats["s"].null_count, stats["a"].min_value) == (3, 1, "-128")
    assert meta.index_entries(rows, ["s"], ["a"]).count() == 2
    assert sorted(r.op for r in meta.index_changes(rows, rows.where("a <> 127"), ["s"], ["a"]).collect()) == ["remove"]


def test_functions(spark):
    one = spark.range(1).select(L.gcd(F.lit(12), F.lit(-18)), L.gcd(F.lit(0), F.lit(0)), L.lcm(F.lit(4), F.lit(6)), L.trunc(F.lit(-1.7)), L.regexp_replace_first(F.lit("abab"), "a", "x"), L.regexp_match(F.lit("a1b2"), "([0-9])", 1), L.array_remove_first(F.array(F.lit(1), F.lit(2), F.lit(1)), F.lit(1)), L.array_replace_n(F.array(F.lit(1), F.lit(1), F.lit(1)), F.lit(1), F.lit(5), 2)).first()
    assert [*one] == [6, 0, 12, -1.0, "xbab", ["1"], [2, 1], [5, 5, 1]]


def test_extremes_of_equal_prices_are_the_first_orders(spark, tmp_path):
    rows = [(4, 1, 9.0), (2, 1, 9.0), (3, 1, 9.0), (7, 1, 1.0), (6, 1, 1.0), (8, 1, None), (None, 1, 99.0), (None, 1, 0.5), (5, 2, None)]
    for order in (rows, rows[::-1]):
        folder = f"{tmp_path}/{order[0][0]}"
        spark.createDataFrame(order, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{folder}/orders.parquet")
        found = QUERIES["agg_by_extreme"](spark, folder)
        assert sorted(map(tuple, found.collect())) == [(1, 2, 6), (2, None, None)]


def brute_knn(rows, asked, k, metric):
    out = []
    for qid, q in asked:
        found = []
        for i, v in rows:
            if len(v) == len(q):
                a, b = np.array(q, float), np.array(v, float)
                size = np.sqrt(a @ a) * np.sqrt(b @ b)
                d = {"l2": np.sqrt(((a - b) ** 2).sum()), "ip": -float(a @ b), "cosine": 1 - a @ b / size if size else np.inf}[metric]
                found += [(round(float(d), 9) + 0.0, i)] if np.isfinite(d) else []
        out += [(qid, d if metric == "cosine" else i) for d, i in sorted(found)[:k]]  # by rounding, parallel vectors tie in no order
    return sorted(out)


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_batch_knn_deals_blocks_over_tasks(spark, monkeypatch, metric):
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(vectors, "BLOCK_VECTORS", 8)
    monkeypatch.setattr(vectors, "TASK_BLOCKS", 2)
    made = np.random.default_rng(3).integers(-3, 4, (120, 3)).astype(float).tolist()  # many ties, zeros and equal vectors
    rows = [*enumerate(made), (500, [1.0, 2.0]), (501, [float("nan"), 1.0, 1.0]), (502, [float("inf"), 1.0, 1.0])]
    own = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = [(i, v) for i, v in rows if i % 5 == 0]
    met = vectors.batch_knn(own, own.where("vec_id % 5 = 0").selectExpr("vec_id AS qid", "embedding AS query"), 4, metric=metric)
    with np.errstate(invalid="ignore"):
        want = brute_knn(rows, asked, 4, metric)
    assert sorted((r.qid, round(r.distance, 9) + 0.0 if metric == "cosine" else r.id) for r in met.collect()) == want
    # One dimension, yet no equal join on it: that would be one task for all pairs.
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
