"""Every query of the subpackage on the smallest tables, op9 with its SQL, and the pipeline on rows that it must stand."""

import duckdb
import pytest
from llm_edges import EDGES
from pyspark.sql import functions as F

from lodestone.llm import piecebpe, quality_rules
from lodestone.llm.queries import ORACLE_SQL, QUERIES

#: What the contracts fix: the columns that come first, and the table of which every row has one.
COLUMNS = {
    "op1_sentencepiece": (["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "documents"),
    "op2_fingerprints": (["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"], "documents"),
    "op3_warc": (["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], "pages"),
    "op4_quality_rules": (["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"], "documents"),
    "op5_token_ids": (["doc_id", "start", "n_tokens", "ids_crc32"], "documents"),
    "op6_near_dedup": (["doc_id", "class_id", "class_size", "n_links", "is_first"], "documents"),
    "op7_line_quality": (["doc_id", "held_out", "score", "predicted"], "documents"),
    "op8_recurrent_lm": (["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], "documents"),
    "op9_url_lists": (["page_id", "host", "fetch_day", "n_active", "first_rule", "blocked"], "pages"),
    "op10_packing": (["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], None),
    "instruction_packing": (["conv_id", "start", "length", "loss_tokens", "sequence_id", "offset"], None),
}


def test_all_queries_are_known():
    assert set(QUERIES) == set(COLUMNS) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(name, spark, sf):
    columns, table = COLUMNS[name]
    rows = QUERIES[name](spark, sf)
    assert rows.columns == columns
    found = rows.collect()
    assert len(found) == spark.read.parquet(f"{sf}/{table}.parquet").count() if table else found
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "pages", "labels"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = con.execute(ORACLE_SQL[name])
        names = [c[0] for c in want.description]
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(([r[n] for n in names] for r in found), key=key) == sorted((list(r) for r in want.fetchall()), key=key)


def test_sequences_are_full(spark, sf):
    """All tokens in sequences of at most 4096, of which only the last of a task is not full."""
    own = QUERIES["op10_packing"](spark, sf).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= 4096 for r in own) and sum(r.n < 4096 for r in own) <= len({r.sequence_id >> 40 for r in own})


def test_encoded_column_takes_the_place_of_one_of_its_name(spark):
    docs = spark.createDataFrame([(1, "a b", "old"), (2, None, "old")], "doc_id long, text string, piece_ids string")
    out = piecebpe.encode_column(docs).orderBy("doc_id").collect()
    assert len(out[0].piece_ids) == 2 and out[1].piece_ids == [] and out[0].text == "a b"


@pytest.fixture(scope="module")
def odd(spark, edge_docs, docs, labels, tmp_path_factory):
    """The edge rows behind ordinary ones, with columns whose names the stages use themselves."""
    folder = f"file://{tmp_path_factory.mktemp('odd')}"
    plain = docs.select(F.col("doc_id") + 1000, "text", "lang", "source", F.lit(0).alias("n_chars"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in edge_docs.schema.fields[5:]])
    edge_docs.unionByName(plain.toDF(*edge_docs.columns)).write.parquet(f"{folder}/documents.parquet")
    labels.withColumn("doc_id", F.col("doc_id") + 1000).write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_stand_odd_rows(spark, odd):
    import corpus_pipeline

    source = spark.read.parquet(f"{odd}/documents.parquet")
    at, seen = source, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, odd)
        assert name == "packing" or out.columns == source.columns
        out.write.parquet(f"{odd}/{k}")
        at = spark.read.parquet(f"{odd}/{k}")
        seen[name] = at.select("doc_id").where("doc_id < 1000 or doc_id is null")
    base = sorted((i or -1, t) for i, t in EDGES if t and len(t.split()) >= 10)
    ruled = [r.doc_id or -1 for r in seen["quality_rules"].collect()]
    assert set(ruled) <= {i for i, _ in base} and {7, 8} <= set(ruled)  # null, empty and short texts go; repeated rows stay
    once = [r.doc_id for r in seen["near_dedup"].collect()]
    assert once.count(7) == 1 and len(once) == len(set(once))
    assert {r.doc_id for r in seen["packing"].collect()} == set(once)
    nothing = source.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, odd).count() == 0, name


def test_a_stage_learns_from_the_source_whatever_is_left(spark, odd):
    """The rules of a stage don't depend on the rows that reach it."""
    import corpus_pipeline

    source = spark.read.parquet(f"{odd}/documents.parquet")
    few = source.where("doc_id % 2 = 0")
    assert quality_rules.fit_rules(source, spark.read.parquet(f"{odd}/labels.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.reject_by_rules(spark, source, odd).collect()}
    assert {r.doc_id for r in corpus_pipeline.reject_by_rules(spark, few, odd).collect()} == {i for i in kept if i is not None and i % 2 == 0}
