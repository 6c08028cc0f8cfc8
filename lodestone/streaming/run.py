"""Driving streams over what is there now to a table, and keyed state over micro-batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType


def work_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a temporary one of a local session where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors of a cluster need a folder that they share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-stream-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex[:12]}"


def stream_table(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A stream over a Parquet file or folder, with the schema that it has now."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", max_files)
    if own.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(own).isFile():  # a file source watches folders
        return reader.option("pathGlobFilter", own.getName()).parquet(own.getParent().toString())
    return reader.parquet(path)


def run_to_table(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Runs a stream over all input there is (availableNow), and returns what it wrote. complete: the last state; update: the last row of each batch id."""
    spark = stream.sparkSession
    out = folder or work_folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        # A batch that is run again overwrites its own folder: writing twice is writing once.
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={0 if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    written = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{out}/data")
    return written if mode == "update" else written.drop("batch")


def group_cursor(entries: DataFrame) -> DataFrame:
    """Keyed state of a consumer group: per stream the entries read so far and the cursor (ms, seq). entries: stream, ms, seq."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ms, seq, n = state.get if state.exists else (-1, -1, 0)
        for rows in batches:
            n += len(rows)
            if len(rows):
                top = rows.sort_values(["ms", "seq"]).iloc[-1]
                ms, seq = max((ms, seq), (int(top["ms"]), int(top["seq"])))
        state.update((ms, seq, n))
        yield pd.DataFrame({"stream": [key[0]], "last_ms": [ms], "last_seq": [seq], "entries_read": [n]})

    return entries.groupBy("stream").applyInPandasWithState(advance, "stream string, last_ms long, last_seq long, entries_read long", "ms long, seq long, n long", "update", GroupStateTimeout.NoTimeout)
