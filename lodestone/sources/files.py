"""Files in and out, with declared schemas where the format has none of its own."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "csv", "json", "text")


def _arrow(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Arrow files or streams. Spark reads the bytes, so any store will do; a task holds one file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = pa.py_buffer(content.as_py())
                opened = pa.ipc.open_file(data) if data.slice(0, 6).to_pybytes() == b"ARROW1" else pa.ipc.open_stream(data)
                rows = opened.read_all() if not isinstance(opened, pa.ipc.RecordBatchFileReader) else pa.Table.from_batches([opened.get_batch(i) for i in range(opened.num_record_batches)], opened.schema)
                yield from rows.select(names).to_batches()

    own = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = own.names
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, own)


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: StructType | str | None = None, **options: str) -> DataFrame:
    if kind not in (*FORMATS, "arrow"):
        raise ValueError(f"{kind!r} is none of {(*FORMATS, 'arrow')}")
    if kind == "arrow" and schema is not None:
        return _arrow(spark, path, schema)
    if kind in ("csv", "json", "arrow") and schema is None:
        raise ValueError(f"{kind} needs a schema: inferring one reads everything twice")
    reader = spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {}) | options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options: str) -> None:
    if kind not in FORMATS:
        raise ValueError(f"{kind!r} is none of {FORMATS}")
    writer = df.write.format(kind).mode(mode).options(**({"header": "true"} if kind == "csv" else {}) | options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, mode: str = "overwrite") -> None:
    """A managed table bucketed and sorted by its keys: later joins and aggregates on them need no exchange."""
    df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
