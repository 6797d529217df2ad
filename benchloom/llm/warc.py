"""WARC archives as a PySpark data source, ``spark.read.format("warc")`` after ``register(spark)``.

Reading plans partitions from the list of files: small files share a partition, up to
``PARTITION_BYTES``.  In a file each record is a gzip member whose extra field ``sl`` (WARC
standard, annex D) holds its length.  The reader inflates a member only until its WARC and HTTP
headers are complete, tests the predicates pushed down, and goes on to the next member without
touching the payload if a predicate fails or payloads are not wanted (option ``payload=false``).
Members without ``sl`` are inflated to find their end, uncompressed files are read by length.

Writing gives each task files of its own, rolled at ``FILE_BYTES``; the names that committed are
listed in ``_warc_files.json``, so files of failed or repeated tasks are never read.  Paths are
opened with pyarrow's file systems, by any scheme it knows.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull,
    LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from benchloom.llm.common import pick
from benchloom.session import cut
from benchloom.sizing import broadcast_if_small

FILE_BYTES = 64 << 20
PARTITION_BYTES = 32 << 20
HEAD_BYTES = 2048
LIST = "_warc_files.json"
SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, "
    "content_length bigint, payload_length bigint, payload binary, file string, offset bigint"
)
WRITTEN = ("record_type", "record_id", "target_uri", "date", "payload_digest", "refers_to", "payload_length", "payload")
HEADERS = {  # column: header
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EARLIEST = "1970-01-01T00:00:00Z"


def _member(record: bytes, level: int = 1) -> bytes:
    """One gzip member with its own length and the record's in the extra field; 0 where they don't fit."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    size = 24 + len(body) + 8
    fits = size < 1 << 32 and len(record) < 1 << 32
    head = struct.pack("<4BIBBH2sHII", 31, 139, 8, 4, 0, 0, 255, 12, b"sl", 8, *((size, len(record)) if fits else (0, 0)))
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _clean(value: str | None) -> str | None:
    """A header value on one line."""
    return None if value is None else value.replace("\r", "%0D").replace("\n", "%0A")


def page_record(row: dict) -> bytes:
    """A response or revisit as an HTTP answer; a revisit carries the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    headers = [(HEADERS[c], _clean(row[c])) for c in HEADERS if c != "date"] + [("WARC-Date", row["date"] or EARLIEST)]
    headers += [("WARC-Profile", REVISIT if revisit else None), ("Content-Type", "application/http; msgtype=response")]
    return _record(headers, http if revisit else http + (row["payload"] or b""))


@dataclass
class Done(WriterCommitMessage):
    files: list[tuple[str, int]]


@dataclass
class Files(InputPartition):
    files: list[str]

    def __post_init__(self):
        super().__init__(None)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        stem = f"part-{task.partitionId():05d}-{uuid.uuid4().hex[:12]}"
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{stem}-{len(files):04d}.warc.gz"
                    out = store.open_output_stream(posixpath.join(root, name), compression=None)
                    info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", EARLIEST), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    files.append([name, 0])
                    size = out.write(_member(info))
                size += out.write(_member(page_record(row)))
                files[-1][1] = size
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Done([tuple(f) for f in files])

    def commit(self, messages: list[Done | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(posixpath.join(root, LIST)) as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list[Done | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for name, _ in (f for m in messages if m for f in m.files):
            store.delete_file(posixpath.join(root, name))


def _test(f) -> tuple | None:
    """(columns, predicate of a header dict) of a filter on one header column; None if it isn't one."""
    if isinstance(f, Not):
        inner = _test(f.child)
        # a comparison with null is neither true nor false
        return inner and (inner[0], lambda h: not inner[1](h) and (isinstance(f.child, (IsNull, IsNotNull, EqualNullSafe)) or h.get(inner[0]) is not None))
    if not hasattr(f, "attribute") or len(f.attribute) != 1 or f.attribute[0] not in (*HEADERS, "content_length"):
        return None
    c, v = f.attribute[0], getattr(f, "value", None)
    tests = {
        EqualTo: lambda x: x == v, EqualNullSafe: lambda x: x == v, In: lambda x: x in v, IsNull: lambda x: x is None, IsNotNull: lambda x: x is not None,
        GreaterThan: lambda x: x > v, GreaterThanOrEqual: lambda x: x >= v, LessThan: lambda x: x < v, LessThanOrEqual: lambda x: x <= v,
        StringStartsWith: lambda x: x.startswith(v), StringEndsWith: lambda x: x.endswith(v), StringContains: lambda x: v in x,
    }
    if type(f) not in tests:
        return None
    test, nulls = tests[type(f)], isinstance(f, (IsNull, EqualNullSafe))
    return c, lambda h: (h.get(c) is not None or nulls) and bool(test(h.get(c)))


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.filters = path, payload, []

    def pushFilters(self, filters):  # noqa: N802
        """Takes predicates on header columns; yields the others back to Spark."""
        for f in filters:
            if _test(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, root = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(posixpath.join(root, LIST)).type == fs.FileType.File:
            with store.open_input_stream(posixpath.join(root, LIST)) as listed:
                sized = [(posixpath.join(root, n), s) for n, s in json.loads(listed.read())]
        else:
            infos = [store.get_file_info(root)] if store.get_file_info(root).type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
            sized = [(i.path, i.size) for i in infos if i.is_file and i.path.endswith((".warc", ".warc.gz"))]
        out, room = [], 0
        for name, size in sorted(sized):
            if not out or size > room:
                out.append(Files([]))
                room = PARTITION_BYTES
            out[-1].files.append(name)
            room -= size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.path)
        tests = [_test(f)[1] for f in self.filters]
        wanted = lambda h: all(t(h) for t in tests)
        for name in partition.files:
            with store.open_input_file(name) as file:
                for offset, headers, payload in records(file, wanted, self.payload):
                    yield (*[headers.get(c) for c in HEADERS], headers.get("content_length"), headers.get("payload_length"), payload, name, offset)


def _parse(head: bytes) -> tuple[dict, int]:
    """WARC headers by column, and where the block begins."""
    end = head.index(b"\r\n\r\n") + 4
    named: dict[str, str] = {}
    for line in head[: end - 4].decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        named[key.strip().lower()] = value.strip()
    out: dict = {c: named.get(h.lower()) for c, h in HEADERS.items()}
    out["content_length"] = int(named.get("content-length", 0))
    out["http"] = named.get("content-type", "").startswith("application/http")
    return out, end


def _http(block: bytes) -> tuple[int | None, int]:
    """The HTTP Content-Length and where the payload begins."""
    end = block.find(b"\r\n\r\n")
    length = None
    for line in block[: max(end, 0)].split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == b"content-length" and value.strip().isdigit():
            length = int(value)
    return length, end + 4 if end >= 0 else 0


def _heads_end(data: bytes) -> bool:
    """True once the WARC headers, and the HTTP headers if there are some, are complete."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return False
    return b"application/http" not in data[:end] or data.find(b"\r\n\r\n", end + 4) >= 0


def records(file, wanted, payloads: bool) -> Iterator[tuple[int, dict, bytes | None]]:
    """(offset, headers, payload) of the records of an open .warc or .warc.gz file that ``wanted`` takes."""
    size, at = file.size(), 0
    while at < size:
        file.seek(at)
        first = file.read(HEAD_BYTES)
        if first[:2] == b"\x1f\x8b":
            length = 0
            if first[3] == 4 and first[12:14] == b"sl":
                length = struct.unpack_from("<I", first, 16)[0]
            if length:
                inflate, data, read = zlib.decompressobj(-15), b"", first[24:length]
                consumed = min(len(first), length)
                data = inflate.decompress(read)
                while not _heads_end(data) and consumed < length:
                    more = file.read(min(HEAD_BYTES, length - consumed))
                    consumed += len(more)
                    data += inflate.decompress(more)
            else:
                inflate, data, read = zlib.decompressobj(31), b"", first
                parts = []
                while read and not inflate.eof:
                    parts.append(inflate.decompress(read))
                    read = b"" if inflate.eof else file.read(1 << 16)
                data, length = b"".join(parts), file.tell() - at - len(inflate.unused_data)
                consumed = length
            headers, start = _parse(data)
            take = wanted(headers)
            if take and payloads and headers["record_type"] != "revisit" and consumed < length:
                data += inflate.decompress(file.read(length - consumed))
            block, whole = data[start : start + headers["content_length"]], len(data) >= start + headers["content_length"]
        else:
            data = first
            while b"\r\n\r\n" not in data and len(data) < size - at:
                data += file.read(HEAD_BYTES)
            headers, start = _parse(data)
            length, take = start + headers["content_length"] + 4, wanted(headers)
            if take:
                need = length if payloads else min(length, start + HEAD_BYTES)
                data += file.read(max(0, need - len(data)))
            block = data[start : start + headers["content_length"]]
            whole = len(block) == headers["content_length"]
        if take:
            declared, begin = _http(block) if headers.pop("http") else (headers["content_length"], 0)
            headers["payload_length"] = declared if declared is not None else headers["content_length"] - begin
            yield at, headers, block[begin:] if payloads and whole and headers["record_type"] != "revisit" else None
        at += length


class WarcSource(DataSource):
    """Options: ``path``; ``payload`` (true by default) to read payloads."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets Spark push predicates to Python sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


LEAST_REVISIT = 1000
RECORD_ID = "urn:x-page:"


def page_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """The records to write for (page_id, url, html): of equal payloads of ``least`` bytes or more, all but the largest id's are revisits.

    A null html is an empty payload, a null id sorts below all others and is written without a
    number; rows with the same largest id are all responses.  Only (digest, largest id) of
    payloads that occur more than once meets the pages again.
    """
    rows = pick(pages, page_id="bigint", url="string", html="string")
    rows = rows.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("bigint")).withColumn("digest", F.sha1("payload"))
    large = rows.filter(F.col("size") >= least).groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    top = broadcast_if_small(cut(large.filter("n > 1 and top is not null").select("d", "top"), "digests"))
    joined = rows.join(top, F.col("digest") == F.col("d"), "left")
    again = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    name = lambda c: F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    return joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), name(F.col("page_id")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(EARLIEST).alias("date"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"), F.when(again, name(F.col("top"))).alias("refers_to"), F.col("size").alias("payload_length"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, path: str) -> None:
    """A WARC record per row of ``pages``, repeated rows included; an empty table gives an empty list of files."""
    register(pages.sparkSession)
    page_records(pages).write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are those of the payload read back, of a revisit those its
    headers state.
    """
    register(spark)
    found = spark.read.format("warc").load(path).filter(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.regexp_extract(c, rf"{RECORD_ID}(-?\d+)>", 1)
    page = lambda c: F.when(number(c) != "", number(c).cast("bigint"))
    response = F.col("record_type") == "response"
    return found.select(
        page(F.col("record_id")).alias("page_id"), F.when(response, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"), "record_type", page(F.col("refers_to")).alias("refers_to"),
    )
