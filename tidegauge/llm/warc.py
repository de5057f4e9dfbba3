"""WARC archives: a writer, and a PySpark Python data source ("warc") that reads them.

Files are .warc.gz with one gzip member for each record. A member's header has an extra field 'sl' with its packed and
unpacked length, so a reader finds the next member without unpacking this one. The reader plans partitions of whole files
(small files together), takes equality and IN predicates on record_type and `header` columns, unpacks only the start of a
member until the header ends, and unpacks a payload only where the row is wanted and the payload is asked for.

read options: path (folder or file URI reachable by pyarrow.fs), payload (none, check, or bytes; default none: check unpacks and
compares the digest, bytes returns it too), partitionBytes (default 64 MB).

Files are named by task attempt, and a list of those of the attempts that counted is written last; a reader keeps to the list
where there is one, and passes over names that begin with "_".

Edge cases: a null html is an empty payload; equal payloads are kept once (smallest page_id; a null id sorts last), rows that repeat an id keep a
record each; an empty table writes no records; records of other writers without 'sl' are unpacked to find their end.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from . import common

SCHEMA = "record_id string, record_type string, target_uri string, page_id long, payload_bytes long, payload_digest string, refers_to long, payload_ok boolean, payload binary"
#: Columns that come from a header line, and that a predicate may be pushed on.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "page_id": "x-page-id", "payload_bytes": "x-payload-length", "payload_digest": "warc-payload-digest", "refers_to": "x-refers-to-page"}


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes, level: int = 1) -> bytes:
    """One gzip member with its packed and unpacked length in the extra field 'sl'."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    if len(data) >= 1 << 32 or len(body) + 32 >= 1 << 32:  # too long for the field: readers unpack such a member to find its end
        return b"\x1f\x8b\x08\x00" + b"\x00" * 4 + b"\x00\xff" + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    extra = b"sl" + struct.pack("<HII", 8, 10 + 2 + 12 + len(body) + 8, len(data))
    return b"\x1f\x8b\x08\x04" + b"\x00" * 4 + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    clean = lambda v: str(v).replace("\r", " ").replace("\n", " ")
    lines = ["WARC/1.1", *(f"{k}: {clean(v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


class Members:
    """Reads gzip members of one open file: the header first, the rest on demand."""

    def __init__(self, file):
        self.file, self.at = file, 0

    def __iter__(self) -> Iterator[tuple[dict[str, str], Members]]:
        size = self.file.size()
        while self.at < size:
            self.file.seek(self.at)
            self.buffer = self.file.read(4096)
            if self.buffer[:2] != b"\x1f\x8b":
                raise ValueError(f"no gzip member at byte {self.at}")
            self.length = 0
            if self.buffer[3] & 4 and self.buffer[12:14] == b"sl":
                self.length = struct.unpack("<I", self.buffer[16:20])[0]
            self.z, self.out, self.read_to = zlib.decompressobj(31), b"", len(self.buffer)
            pending = self.buffer
            while b"\r\n\r\n" not in self.out and pending:
                self.out += self.z.decompress(pending)
                pending = self.file.read(4096) if b"\r\n\r\n" not in self.out else b""
                self.read_to += len(pending)
            head, _, self.rest = self.out.partition(b"\r\n\r\n")
            lines = head.decode("utf-8", "replace").split("\r\n")[1:]
            self.headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            self.whole = False
            yield self.headers, self
            if self.length:
                self.at += self.length
            else:
                self.block()
                self.at += self.read_to - len(self.z.unused_data)

    def block(self) -> bytes:
        """The record's block; only this unpacks beyond the header."""
        if not self.whole:
            parts = [self.rest]
            while not self.z.eof:
                more = self.file.read(1 << 16)
                if not more:
                    break
                self.read_to += len(more)
                parts.append(self.z.decompress(more))
            self.rest, self.whole = b"".join(parts), True
        return self.rest[: int(self.headers.get("content-length", 0))]


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.wanted: list[tuple[str, set]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute[0] in HEADERS and len(f.attribute) == 1:
                self.wanted.append((f.attribute[0], {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = _fs(self.options["path"])
        info = system.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f for f in files if f.type == fs.FileType.File and f.base_name.endswith((".warc", ".warc.gz")) and not f.base_name.startswith("_")), key=lambda f: f.path)
        if info.type != fs.FileType.File and system.get_file_info(f"{path}/{LIST}").type == fs.FileType.File:
            with system.open_input_stream(f"{path}/{LIST}") as listed:
                names = set(listed.read().decode().split())
            files = [f for f in files if f.base_name in names]  # what lost or repeated tasks left behind is not in the list
        most, out, held, size = int(self.options.get("partitionbytes", 64 << 20)), [], [], 0
        for f in files:
            if held and size + f.size > most:
                out.append(Files(held))
                held, size = [], 0
            held.append(f.path)
            size += f.size
        if held or not out:
            out.append(Files(held))
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _fs(self.options["path"])
        mode, rows, size = self.options.get("payload", "none"), [], 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                for headers, at in Members(file):
                    row = {c: headers.get(h) for c, h in HEADERS.items()}
                    for c in ("page_id", "payload_bytes", "refers_to"):
                        row[c] = int(row[c]) if row[c] else None
                    if row["payload_digest"]:
                        row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
                    if any(row[c] not in values for c, values in self.wanted):
                        continue
                    row["payload_ok"] = row["payload"] = None
                    if mode != "none" and row["record_type"] == "response":
                        payload = at.block().partition(b"\r\n\r\n")[2]
                        row["payload_ok"] = digest(payload) == row["payload_digest"] and len(payload) == row["payload_bytes"]
                        if mode == "bytes":
                            row["payload"] = payload
                            size += len(payload)
                    rows.append(row)
                    if len(rows) >= 5000 or size >= 16 << 20:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload_ok": pa.bool_(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in COLUMNS], COLUMNS)


COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
#: The file that names a folder's archives, once all are written.
LIST = "_files"


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options)


def write(pages: DataFrame, path: str, file_bytes: int = 256 << 20, least: int = 0) -> DataFrame:
    """One record per row of pages (page_id, url, html), below path; payloads of at least `least` bytes are kept once.

    Returns the stored table (file, records, bytes) of what was written. Payload digests decide in a first pass over the pages; the second pass
    gets only (page_id, referred id) of copies joined to it, so payloads are shuffled only if these do not fit a broadcast.
    """
    spark = pages.sparkSession
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    sums = common.stored(source.select("page_id", F.octet_length("html").alias("size"), F.sha1(F.col("html").cast("binary")).alias("sum")), "warc-sums").where(F.col("size") >= least)
    first = sums.groupBy("sum", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    copies = common.spread_join(sums, common.stored(first, "warc-first"), {"sum": "sum", "size": "size"}, "n", ["first"], ["page_id"]).where("first is not null and (page_id is null or page_id <> first)")
    copies = copies.select(F.col("page_id").alias("copy"), F.col("sum").alias("copy_sum"), "first").distinct()
    copies = common.stored(copies, "warc-copies")
    joined = source.join(copies, F.col("page_id").eqNullSafe(F.col("copy")) & (F.sha1(F.col("html").cast("binary")) == F.col("copy_sum")), "left").select("page_id", "url", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = _fs(path)
        system.create_dir(root, recursive=True)
        context = TaskContext.get()
        out, name, done, files, n = None, "", [0, 0], [], 0

        def close():
            out.close()
            system.move(f"{root}/_{name}", f"{root}/{name}")  # names hold the attempt: two never write one file
            files.append((name, *done))

        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if out is None:
                    name = f"part-{context.partitionId():06d}-{len(files):04d}-{context.taskAttemptId()}.warc.gz"
                    out, done = system.open_output_stream(f"{root}/_{name}", compression=None), [0, 0]
                payload, n = html.encode(), n + 1
                kind = "response" if refers is None else "revisit"
                headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}|{url}|{context.partitionId()}|{n}')}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Payload-Length", str(len(payload)))]
                if page is not None:
                    headers.append(("X-Page-Id", str(page)))
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                if refers is not None:
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(refers))]
                headers.append(("Content-Type", "application/http; msgtype=response"))
                packed = member(record(headers, http + (payload if refers is None else b"")))
                out.write(packed)
                done = [done[0] + 1, done[1] + len(packed)]
                if done[1] >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in files], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"])

    written = common.stored(joined.mapInArrow(run, "file string, records long, bytes long"), "warc-files")
    system, root = _fs(path)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/{LIST}") as out:
        for r in written.select("file").toLocalIterator():
            out.write(f"{r[0]}\n".encode())
    return written


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # off, Spark refuses readers that take predicates
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).option("path", path).load()
