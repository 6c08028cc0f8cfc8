"""Deterministic sharded WARC archives of pages.

Pages are dealt by ranges of (page_id, hash of payload) and sorted; each task writes its range into gzip members, one a record, and rolls to a new file when
the compressed size passes a limit. Headers, digests and record ids are made anew from the page alone, so the same table gives the same
bytes. A task writes its files under temporary names and, once they are whole, gives them their own: side by side with the other tasks, and harmless if it
is run again, for another attempt puts the same bytes in their place. When all tasks are done the driver writes the manifest, which
alone says what belongs to the archive, and removes temporary files that lost attempts left.

Of records with equal payloads of at least `min_bytes` bytes, the one with the largest page_id is a response and the others are revisit
records without payload. Digests, not payloads, are grouped: a pre-aggregated maximum for each digest, which meets the pages' digests by
digest and salt, so that one page's many copies are no single task's, and a list of revisits that goes through the same range sort as the pages, in front of the page it concerns. So payloads are moved once.

Edge cases: a null html is an empty payload; a null url is an empty target; control characters and spaces of a url are percent-encoded;
a null page_id is a record of its own that is always a response and refers to nothing; of repeated equal rows (same id, same payload)
the first is written as the others' response; an id with several payloads keeps them as records of their own; an empty table gives no
file and no row. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import as_bytes, attempt_id, keep, make_folder, partition_id, pieces_of, shared_folder, spread, store_of, write_whole

#: Fixed values of the format.
CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Capture time of all records, as the pages have none.
DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 256 << 20
#: Tasks that the copies of one payload are dealt to.
SALTS = 32


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id} {payload_digest}'.encode()).digest()[:16], version=5)}>"


def _target(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """An uncompressed WARC record; with refers_to, a revisit of that page's response."""
    own = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, own)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_target(url)}",
        f"WARC-Payload-Digest: sha1:{own}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, own)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2


class RollingWriter:
    """Gzip members in files of about `file_bytes` each, under temporary names."""

    def __init__(self, folder: str, part: int, attempt: int, file_bytes: int) -> None:
        self.folder, self.part, self.attempt, self.most = folder, part, attempt, file_bytes
        self.out, self.files, self.count, self.at = None, [], 0, 0

    def add(self, data: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        if self.out and self.at + len(member) > self.most:
            self._close()
        if not self.out:
            name = f"{self.folder}/pages-{self.part:06d}-{len(self.files):05d}.warc.gz"
            self.now = (name, f"{name}.{self.attempt}.tmp")
            store, path = store_of(self.now[1])
            self.out = store.open_output_stream(path, compression=None)
        self.out.write(member)
        self.at += len(member)
        self.count += 1

    def _close(self) -> None:
        self.out.close()
        self.files.append((*self.now, self.count, self.at))
        self.out, self.count, self.at = None, 0, 0

    def close(self) -> list[tuple[str, str, int, int]]:
        if self.out:
            self._close()
        for name, tmp, _, _ in self.files:
            store, path = store_of(tmp)
            store.move(path, store_of(name)[1])
        return self.files


def read_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive, plain or gzipped; one record is in memory at a time."""
    with gzip.GzipFile(fileobj=stream) as plain:
        source = io.BufferedReader(plain, 1 << 16)
        while version := source.readline():
            if not version.strip():
                continue
            if not version.startswith(b"WARC/"):
                raise ValueError(f"no record begins with {version[:40]!r}")
            head = {}
            while (line := source.readline()).strip():
                name, _, value = line.decode().partition(":")
                head[name.strip().lower()] = value.strip()
            block = source.read(int(head["content-length"]))
            if len(block) != int(head["content-length"]):
                raise ValueError("a record is cut off")
            yield head, block


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES, parts: int | None = None) -> list[dict]:
    """Writes the archives and returns the manifest: one entry a file."""
    spark = pages.sparkSession
    make_folder(folder)
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("html"))
    digests = rows.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= min_bytes)).select("page_id", F.unhex(F.sha1(F.encode("html", "UTF-8"))).alias("sha1"))
    groups = digests.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    revisits = digests.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["sha1", "salt"]).where(F.col("page_id") < F.col("refers_to")).select("page_id", "sha1", "refers_to").distinct()
    nothing = {"url": F.lit(None).cast("string"), "html": F.lit(None).cast("string"), "refers_to": F.lit(None).cast("long")}
    tagged = rows.select("page_id", F.unhex(F.sha1(F.encode("html", "UTF-8"))).alias("sha1"), F.lit(1).alias("tag"), "url", "html", nothing["refers_to"].alias("refers_to")).unionByName(
        revisits.select("page_id", "sha1", F.lit(0).alias("tag"), nothing["url"].alias("url"), nothing["html"].alias("html"), "refers_to")
    )
    order = [F.col("page_id").asc_nulls_first(), F.col("sha1")]
    dealt = tagged.repartitionByRange(parts or spread(spark), *order).sortWithinPartitions(*order, "tag", "url").select("page_id", "sha1", "url", "html", "refers_to", "tag")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = RollingWriter(folder, partition_id(), attempt_id(), file_bytes)
        key, refers = None, None
        for batch in pieces_of(batches, "html"):
            columns = [batch.column(c).to_pylist() for c in ("page_id", "sha1", "refers_to", "tag")]
            for page_id, sha1, to, tag, url, html in zip(*columns, as_bytes(batch.column("url")), as_bytes(batch.column("html")), strict=True):
                if (page_id, sha1) != key:
                    key, refers = (page_id, sha1), None
                if not tag:
                    refers = to
                    continue
                out.add(record(page_id, url.decode(), html, refers))
                if refers is None and page_id is not None and len(html) >= min_bytes:
                    refers = page_id  # an equal row that follows revisits this one
        columns = [*zip(*out.close(), strict=True)] or [()] * 4
        kinds = {"file": pa.string(), "tmp": pa.string(), "n_records": pa.int64(), "n_bytes": pa.int64()}  # the temporary name was the attempt's own
        yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns, strict=True)})

    made = dealt.mapInArrow(write, "file string, tmp string, n_records long, n_bytes long")
    manifest = [r.asDict() for r in keep(made, "warc-files").orderBy("file").collect()]  # a row a file
    for entry in manifest:
        del entry["tmp"]
    write_whole(f"{folder}/MANIFEST.json", json.dumps(manifest).encode())
    store, at = store_of(folder)
    for left in store.get_file_info(fs.FileSelector(at)):
        if left.path.endswith(".tmp"):
            store.delete_file(left.path)
    return manifest


def read_warc(spark: SparkSession, files: list[str]) -> DataFrame:
    """Per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url. Payload digests are checked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            columns = [*zip(*rows, strict=True)] or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        rows: list[tuple] = []
        for batch in batches:
            for file in batch.column("file").to_pylist():
                store, path = store_of(file)
                with store.open_input_stream(path, compression=None) as stream:
                    for head, block in read_records(stream):
                        kind = head["warc-type"]
                        http, _, payload = block.partition(CRLF * 2)
                        sizes = [int(x.split(b":")[1]) for x in http.split(CRLF) if x.lower().startswith(b"content-length:")]
                        own = head["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (digest(payload) != own or len(payload) != sizes[0]):
                            raise ValueError(f"a payload of {file} isn't what its header says")
                        page, to = head.get("x-page-id"), head.get("x-refers-to-page-id")
                        rows.append((int(page) if page else None, sizes[0], own, kind, int(to) if to else None, head["warc-target-uri"]))
                        if len(rows) >= 5000:
                            yield out()
        yield out()

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    if not files:
        return spark.createDataFrame([], schema)
    names = spark.createDataFrame(list(enumerate(files)), "k int, file string")
    return names.repartitionById(len(files), F.col("k")).select("file").mapInArrow(read, schema)


def warc_round_trip(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes all pages and returns what the archives say of each."""
    spark = pages.sparkSession
    manifest = write_warc(pages, folder or shared_folder(spark, "warc"), min_bytes)
    return read_warc(spark, [m["file"] for m in manifest]).drop("url")
