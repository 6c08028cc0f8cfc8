"""Token ids in fixed-width bit-packed shard files.

A shard file holds, little-endian throughout:

    header   magic "LDBP", version u16, bits u16, ids a block u32, 4 bytes of zeros
    blocks   each up to `block` ids in groups of 64; a group of 64 ids is `bits` 64-bit words, id j at bit j * bits
    index    offset of each block u64; then for each document doc_id i64, null flag u8, ids i64
    footer   offset of the index u64, blocks u64, documents u64, ids u64, magic

Blocks are of a known number of ids, so id i lies in block i // block: any range of ids is read by its blocks alone.

Edge cases: null and empty texts have only the end id; a null doc_id sorts first and is kept as null; repeated rows are written as
often as they come, ties of doc_id in the order of their texts' hashes; an empty table gives no shard and no row; columns other than
the two named are not read.
"""

from __future__ import annotations

import itertools
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import as_bytes, attempt_id, keep, make_folder, partition_id, pieces_of, shared_folder, spread, store_of, write_whole
from .wordbpe import default_path, word_bpe

MAGIC = b"LDBP"
HEADER, FOOTER = struct.Struct("<4sHHI4x"), struct.Struct("<QQQQ4s")
#: Ids a block; a multiple of 64.
BLOCK = 1 << 16


def bits_for(vocabulary: int) -> int:
    """The least width that holds the ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Groups of 64 ids in `bits` 64-bit words each; the last group is filled up with zeros."""
    groups = -(-len(ids) // 64)
    filled = np.zeros(groups * 64, np.uint64)
    filled[: len(ids)] = ids
    wide = np.ascontiguousarray(filled.reshape(groups, 64).T)
    words = np.zeros((bits, groups), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        words[word] |= wide[j] << np.uint64(shift)
        if shift + bits > 64:
            words[word + 1] |= wide[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8", copy=False).tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    words = np.ascontiguousarray(np.frombuffer(data, "<u8").reshape(-1, bits).T)
    wide = np.empty((64, words.shape[1]), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        value = words[word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[word + 1] << np.uint64(64 - shift))
        wide[j] = value & mask
    return np.ascontiguousarray(wide.T).reshape(-1)[:count]


class ShardWriter:
    """Writes one shard under a temporary name; close() gives it its own."""

    def __init__(self, uri: str, bits: int, tmp: str, block: int = BLOCK) -> None:
        self.store, self.path = store_of(uri)
        self.tmp, self.bits, self.block = f"{self.path}.{tmp}.tmp", bits, block
        self.out = self.store.open_output_stream(self.tmp, compression=None)
        self.out.write(HEADER.pack(MAGIC, 1, bits, block))
        self.at, self.offsets, self.docs, self.waiting, self.held, self.total = HEADER.size, [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.waiting.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.block:
            self._blocks(last=False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        stop = len(ids) if last else len(ids) // self.block * self.block
        for lo in range(0, stop, self.block):
            data = pack(ids[lo : min(lo + self.block, stop)], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.waiting, self.held = [ids[stop:]], len(ids) - stop

    def close(self) -> int:
        self._blocks(last=True)
        index = np.asarray(self.offsets, "<u8").tobytes()
        if self.docs:
            for k, kind in enumerate(("<i8", "u1", "<i8")):
                index += np.fromiter((d[k] for d in self.docs), kind, len(self.docs)).tobytes()
        self.out.write(index + FOOTER.pack(self.at, len(self.offsets), len(self.docs), self.total, MAGIC))
        self.out.close()
        self.store.move(self.tmp, self.path)
        return self.at + len(index) + FOOTER.size


class ShardReader:
    def __init__(self, uri: str) -> None:
        store, path = store_of(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        magic, version, self.bits, self.block = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        self.index_at, blocks, docs, self.total, tail = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if (magic, version, tail) != (MAGIC, 1, MAGIC):
            raise ValueError(f"{uri} is no shard file")
        index = self.file.read_at(size - FOOTER.size - self.index_at, self.index_at)
        self.offsets = np.frombuffer(index, "<u8", blocks)
        self.doc_ids = np.frombuffer(index, "<i8", docs, 8 * blocks)
        self.null_ids = np.frombuffer(index, "u1", docs, 8 * (blocks + docs)).astype(bool)
        self.lengths = np.frombuffer(index, "<i8", docs, 8 * (blocks + docs) + docs)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def block_ids(self, k: int) -> np.ndarray:
        at = int(self.offsets[k])
        count = min(self.block, self.total - k * self.block)
        return unpack(self.file.read_at(-(-count // 64) * 8 * self.bits, at), self.bits, count)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Random access: ids start .. stop - 1 of the shard, from the blocks that hold them."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        got = np.concatenate([self.block_ids(k) for k in range(first, last + 1)])
        return got[start - first * self.block : stop - first * self.block]

    def documents(self) -> Iterator[tuple[int, Iterator[np.ndarray]]]:
        """Each document's position and its ids in runs, read block by block in order."""
        held, at = -1, np.empty(0, np.uint32)

        def runs(start: int, stop: int) -> Iterator[np.ndarray]:
            nonlocal held, at
            while start < stop:
                if start // self.block != held:
                    held = start // self.block
                    at = self.block_ids(held)
                lo = start - held * self.block
                run = at[lo : lo + stop - start]
                yield run
                start += len(run)

        for i in range(len(self.doc_ids)):
            yield i, runs(int(self.starts[i]), int(self.starts[i] + self.lengths[i]))


def write_ids(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, shards: int | None = None) -> list[dict]:
    """Encodes `text`, appends end_id, and writes shards in ascending doc_id order. Returns the manifest, one entry a shard.

    Documents are dealt by ranges of (doc_id, hash of text), so that even one id with very many rows fills many shards. Each task
    streams its sorted rows into one file; a task that is run again writes the same file under a temporary name of its own.
    """
    spark = docs.sparkSession
    path = tokenizer or default_path()
    make_folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        end = end_id.to_bytes(4, "little")
        name = f"{folder}/shard-{partition_id():06d}.ids"
        writer, n_docs = None, 0
        for batch in pieces_of(bpe.hold(batches), "text"):
            writer = writer or ShardWriter(name, bits_for(max(bpe.tokenizer.get_vocab_size(), end_id + 1)), str(attempt_id()))
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                writer.add(doc_id, np.frombuffer(bpe.ids(text) + end, "<u4"))
                n_docs += 1
            bpe.rest()
        if writer:
            n_bytes = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([partition_id()], pa.int64()), "file": [name], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([writer.total], pa.int64()), "n_bytes": pa.array([n_bytes], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(shards or spread(spark), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    made = dealt.mapInArrow(write, "shard long, file string, n_docs long, n_ids long, n_bytes long")
    manifest = [r.asDict() for r in keep(made, "shards").orderBy("shard").collect()]  # a row a shard
    starts = itertools.accumulate((m["n_ids"] for m in manifest), initial=0)
    manifest = [m | {"start": s} for m, s in zip(manifest, starts, strict=False)]
    write_whole(f"{folder}/MANIFEST.json", json.dumps({"end_id": end_id, "shards": manifest}).encode())
    return manifest


def read_ids(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """Per document of the shards: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = ShardReader(file)
                sums = np.empty(len(shard.doc_ids), np.int64)
                for i, runs in shard.documents():
                    crc = 0
                    for run in runs:
                        crc = zlib.crc32(np.ascontiguousarray(run, "<u4"), crc)
                    sums[i] = crc
                table = pa.table({"doc_id": pa.array(shard.doc_ids, pa.int64(), mask=shard.null_ids), "start": pa.array(shard.starts + base), "n_tokens": pa.array(shard.lengths), "ids_crc32": pa.array(sums)})
                yield from table.to_batches(max_chunksize=10_000)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame([(i, m["file"], m["start"]) for i, m in enumerate(manifest)], "k int, file string, start long")
    return files.repartitionById(len(manifest), F.col("k")).select("file", "start").mapInArrow(read, schema)


def packed_token_ids(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes the ids of all documents and returns what the files say of each: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    own = folder or shared_folder(spark, "token-ids")
    return read_ids(spark, write_ids(docs, own, tokenizer, end_id))
