"""Folders that driver and executors share, and files and tables kept in them."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one vectorised step handles; a single longer text is a step of its own.
STEP_BYTES = 2 << 20
#: Bytes of an Arrow batch on its way to Python: the default of 64 MB is held once by the executor and twice by its worker.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset (tests on one machine), it is set to a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors of a cluster need a folder that they share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, base[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table of the shared folder and reads it back: lineage ends there, and lost executors take nothing with them."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that are needed only until a later one is written; they are deleted at the end of the block."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(path := shared_folder(self.spark, name))
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            drop_folder(self.spark, path)


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches of this session, unless they are bounded closer already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if now < 0 or now > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def drop_folder(spark: SparkSession, uri: str) -> None:
    """Deletes a folder of shared_folder() when its contents are no longer needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def make_folder(uri: str) -> None:
    store, path = store_of(uri)
    store.create_dir(path, recursive=True)


def write_whole(uri: str, data: bytes) -> None:
    """Writes under a temporary name and renames, so that a reader sees all of it or nothing."""
    store, path = store_of(uri)
    with store.open_output_stream(tmp := f"{path}.{uuid.uuid4().hex[:8]}.tmp", compression=None) as out:
        out.write(data)
    store.move(tmp, path)


def pieces_of(batches: Iterator[pa.RecordBatch], text: str, most: int = STEP_BYTES, row_bytes: int = 0, line_bytes: int = 0) -> Iterator[pa.RecordBatch]:
    """Cuts batches into row ranges whose column `text` holds about `most` bytes: memory is bounded by the longest text, not by the batch.

    row_bytes: what each row costs besides its text. line_bytes: what each of its lines does.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + row_bytes
        if line_bytes:
            sizes += line_bytes * pc.fill_null(pc.count_substring(batch.column(text), "\n"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield batch.slice(lo, hi - lo)
    give_back()


def give_back() -> None:
    """Hands memory that this worker has freed to the system: Spark keeps workers, beside an executor that then needs it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null is an empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return pc.fill_null(column.cast(kind), b"").to_pylist()


def flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after the other, and where each begins (with the end as last)."""
    ends = np.cumsum([0, *map(len, texts)], dtype=np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), ends


def vector_sum(rows: DataFrame) -> np.ndarray | None:
    """The sum of equally long vectors (v: bytes of 32-bit floats; pid: the task that made it), in a tree: no task or driver holds more than a few at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for v in batch.column("v"):
                own = np.frombuffer(v.as_py(), np.float32)
                total = own.astype(np.float64) if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([partition_id()], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["pid", "v"])

    n, last = spread(rows.sparkSession), False
    while not last:
        n = -(-n // 16)
        last = n <= 8
        rows = rows.repartition(n, "pid").mapInArrow(add, "pid int, v binary")
    found = [np.frombuffer(r["v"], np.float32).astype(np.float64) for r in rows.orderBy("pid").collect()]  # at most eight
    return np.sum(found, axis=0) if found else None


def partition_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def attempt_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().taskAttemptId()


def spread(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
