"""Every query of the engine with its check in SQL: name, builder (spark, folder) -> DataFrame, and DuckDB text where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .session import table

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Builder], Builder]:
    """Registers a builder under its own name; `oracle` is the same query for DuckDB."""

    def add(build: Builder) -> Builder:
        key = name or build.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = build
        if oracle:
            ORACLES[key] = oracle
        return build

    return add


def both(name: str, text: str, duck: str | None = None) -> None:
    """Registers a query given as SQL text; tables stand in braces. `duck` is its DuckDB text where the dialects differ."""
    used = sorted(set(re.findall(r"\{(\w+)\}", text)))

    def build(spark: SparkSession, folder: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, folder, t) for t in used})

    query(re.sub(r"\{(\w+)\}", r"\1", duck or text), name)(build)


def _load() -> None:
    from . import plans  # noqa: F401  its modules register


_load()
