"""Archives by exact round trips, the temporal list join by brute force, and the pipeline from end to end."""

import base64
import datetime
import gzip
import hashlib
import io
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import url_lists, warc

PAGES = [(5, "http://a.b/é x\r\nEvil: 1", "<p>same</p>"), (3, None, "<p>same</p>"), (9, "http://c/", "<p>same</p>"), (1, "http://d/", None), (2, "http://e/", ""), (4, "http://f/", "x" * 300_000), (None, "http://g/", "<p>same</p>"), (9, "http://c/", "<p>same</p>"), (4, "http://f2/", "other payload of the same id"), (11, "http://h/", "é日\r\n\r\nWARC/1.1\r\n")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, h, "x", 3) for i, u, h in PAGES], "page_id long, url string, html string, sha1 string, tag int").repartition(3)


def test_warc_round_trip(pages, tmp_path, spark):
    got = [tuple(r) for r in warc.warc_round_trip(pages).collect()]
    groups = defaultdict(list)
    for i, _, h in PAGES:
        if i is not None:
            groups[h or ""].append(i)
    want, written = [], set()
    for i, _, h in PAGES:
        data = (h or "").encode()
        last = max(groups[h or ""]) if i is not None else None
        again = (i, h) in written
        written.add((i, h))
        is_response = i is None or (i == last and not again)
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if is_response else "revisit", None if is_response else last))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert warc.warc_round_trip(pages.limit(0)).count() == 0
    assert {r.record_type for r in warc.warc_round_trip(pages, min_bytes=1000).collect()} == {"response"}
    assert all(r.record_type == "response" for r in warc.warc_round_trip(pages.where("page_id <> 9"), min_bytes=100).collect())


def test_files_roll_and_are_the_same_each_time(pages, tmp_path):
    found = []
    for k in range(2):
        manifest = warc.write_warc(pages, f"file://{tmp_path}/w{k}", file_bytes=600, parts=2)
        files = sorted((tmp_path / f"w{k}").glob("*.warc.gz"))
        assert len(files) == len(manifest) > 2 and not list((tmp_path / f"w{k}").glob("*.tmp"))
        found.append([f.read_bytes() for f in files])
        assert sum(m["n_records"] for m in manifest) == len(PAGES)
    assert found[0] == found[1]


def test_records_carry_right_digests():
    data = warc.record(7, "http://x/ y", b"body", None)
    (head, block), = warc.read_records(io.BytesIO(gzip.compress(data)))
    assert head["warc-target-uri"] == "http://x/%20y" and head["warc-block-digest"] == f"sha1:{warc.digest(block)}" and block.endswith(b"\r\n\r\nbody")
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(gzip.compress(data[:-20]))))


def test_temporal_list_join(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    entries = [("b.c", "spam", day(10), 1, "add"), ("b.c", "spam", day(40), 2, "remove"), ("b.c", "spam", day(40), 1, "add"), ("a.b.c", "adult", day(35), 1, "add"), ("c", "late", day(300), 1, "add"), ("q.c", "spam", day(5), 1, "remove"), (None, "x", day(1), 1, "add"), ("b.c", "none", None, 1, "add")]
    captures = [(k, f"https://{h}/p", day(n)) for k, (h, n) in enumerate([(h, n) for h in ("a.b.c", "b.c", "B.C:80", "u@q.c", "xb.c", "d") for n in (0, 9, 10, 34, 35, 39, 40, 41, 299, 300, 350)])]
    captures += [(900, None, day(12)), (901, "nonsense", day(12)), (902, "http://b.c", None), (None, "http://b.c/", day(12)), (1, captures[1][1], captures[1][2])]
    got = url_lists.judge_captures(spark.createDataFrame(captures, "id long, url string, day date"), spark.createDataFrame(entries, "suffix string, category string, day date, seq int, action string")).collect()
    state = defaultdict(dict)
    for s, c, d, q, a in sorted((e for e in entries if e[0] and e[2]), key=lambda e: (e[2], e[3])):
        state[s, c][d] = a
    want = []
    for i, u, d in captures:
        m = re.match(url_lists.HOST, u or "")
        host = m[1].lower() if m else ""
        hits = []
        for (s, c), dated in state.items():
            earlier = [x for x in dated if d is not None and x <= d]
            if (host == s or host.endswith("." + s)) and earlier and dated[max(earlier)] == "add":
                hits.append(f"{s} {c}")
        want.append((i, host, d, len(hits), min(hits, default=None), bool(hits)))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    empty = spark.createDataFrame([], "suffix string, category string, day date, seq int, action string")
    few = spark.createDataFrame(captures[:3], "id long, url string, day date")
    assert url_lists.judge_captures(few, empty).where("blocked").count() == 0 and url_lists.judge_captures(few.limit(0), empty).count() == 0


def test_pipeline(spark, docs, labels, made_docs, tmp_path):
    import corpus_pipeline

    folder = f"file://{tmp_path}/sf"
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    at = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, folder)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{k}")
        at = spark.read.parquet(f"{folder}/{k}")
    first = spark.read.parquet(f"{folder}/0")
    good = {i for i, t, q in made_docs if q and len(t.split()) >= 10}
    assert {r.doc_id for r in first.collect()} == good
    assert spark.read.parquet(f"{folder}/1").count() > 0.97 * len(good)
    assert {r.doc_id for r in at.collect()} == {r.doc_id for r in spark.read.parquet(f"{folder}/2").collect()}
    assert corpus_pipeline.run(spark, folder).agg(F.sum("length")).first()[0] == at.agg(F.sum("length")).first()[0]
