"""One query for each operator of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import url_lists


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piecebpe import sentencepiece_round_trip

    return sentencepiece_round_trip(_table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprint_edits

    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_round_trip

    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_rules, fit_rules

    docs = _table(spark, sf_dir, "documents")
    return apply_rules(docs, fit_rules(docs, _table(spark, sf_dir, "labels")))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bitpack import packed_token_ids

    return packed_token_ids(_table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links", "is_first")


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_crf import fit_documents, score_documents

    docs = _table(spark, sf_dir, "documents")
    return score_documents(docs, fit_documents(docs, _table(spark, sf_dir, "labels")))


def op8_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .recurrent_lm import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op9_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    judged = url_lists.judge_captures(url_lists.sample_captures(pages), url_lists.sample_entries(pages))
    return judged.withColumnsRenamed({"id": "page_id", "day": "fetch_day"})


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over instruction data, where the limits on segments and loss-bearing tokens bind."""
    from .packing import pack_conversations

    return pack_conversations(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_fingerprints": op2_fingerprints,
    "op3_warc": op3_warc,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_ids": op5_token_ids,
    "op6_near_dedup": op6_near_dedup,
    "op7_line_quality": op7_line_quality,
    "op8_recurrent_lm": op8_recurrent_lm,
    "op9_url_lists": op9_url_lists,
    "op10_packing": op10_packing,
    "instruction_packing": instruction_packing,
}

#: Where SQL can express the whole result; tests/llm holds the others against brute force.
ORACLE_SQL: dict[str, str] = {"op9_url_lists": url_lists.ORACLE}
