"""Sessions and tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with UTC times, adaptive execution, and the given settings (dots as double underscores)."""
    builder = SparkSession.builder.master(master).appName("lodestone")
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def settled(df: DataFrame) -> DataFrame:
    """df, written below the session's checkpoint folder: it is computed once, and lost executors take nothing with it.

    Where that folder is not set, a local session gets a temporary one; a cluster needs one that its machines share.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is not set: driver and executors of a cluster need a folder that they share")
            folder = "file://" + tempfile.mkdtemp(prefix="lodestone-")
            atexit.register(shutil.rmtree, folder[7:], ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables; reads only what the plan above it asks for."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
