"""The corpus pipeline: rules, classifier, near-duplicates, packing. Each stage reads the table that the one before wrote.

Edge cases, for every stage: rows with a null or empty text fail the base rules and go at the first stage; where a later stage is given one, the classifier
scores it as one empty line, equal ones are copies, and packing takes it as the end id alone. A null doc_id stays and is judged as any other; of
repeated rows, and of ties, one stays at the near-duplicates. Very long texts are taken whole. Other columns, whatever their names, pass through all
stages but the last. An empty table gives no row; without labels of both kinds the base rules and the classifier's default decide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import line_crf, near_dedup, packing, quality_rules
from lodestone.llm.shared import keep

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The source documents and their labels: what rules and classifier learn from, whatever earlier stages removed."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def reject_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    return quality_rules.keep_good(docs, quality_rules.fit_rules(*_labelled(spark, sf_dir)))


def reject_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores below one half go."""
    return line_crf.keep_good(docs, line_crf.fit_documents(*_labelled(spark, sf_dir)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_dedup.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left in training sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [("quality_rules", reject_by_rules), ("quality_classifier", reject_by_classifier), ("near_dedup", one_of_each), ("packing", pack)]

#: No SQL can express learned stages; tests/llm holds them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
