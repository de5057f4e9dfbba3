"""Python data sources: capture files in byte ranges, and a template for sources of flow rows."""

from __future__ import annotations

import datetime
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..schema import FLOW_DDL, flow

YEAR = 366 * 86400
CHAIN = 6  # headers that have to follow each other where a range begins inside a file


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__(None)
        self.path, self.start, self.end = path, start, end


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


class Capture:
    """Records of an open pcap file by offset."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        magic = file.read_at(24, 0)
        self.order = "<" if magic[:4] in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1") else ">"
        self.unit = 1e-9 if magic[:4] in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d") else 1e-6
        self.ok = len(magic) == 24 and magic[:4] in (b"\xd4\xc3\xb2\xa1", b"\xa1\xb2\xc3\xd4", b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d")
        self.snap = struct.unpack(self.order + "I", magic[16:20])[0] if self.ok else 0
        self.began = struct.unpack(self.order + "I", file.read_at(4, 24))[0] if self.ok and self.size >= 28 else 0

    def _plausible(self, head: bytes) -> bool:
        sec, frac, size, whole = struct.unpack(self.order + "IIII", head)
        return frac < 1 / self.unit and 0 < size <= min(whole, max(self.snap, 65535)) and whole <= 1 << 20 and abs(sec - self.began) < YEAR

    def _starts(self, data: bytes, at: int, begins: int) -> bool:
        """Whether a chain of records begins at data[at:]; begins: the file offset of data."""
        last = None
        for _ in range(CHAIN):
            if begins + at + 16 > self.size:  # the end, or a header that is cut off
                return last is not None
            if at + 16 > len(data) or not self._plausible(data[at : at + 16]):
                return False
            sec, size = struct.unpack(self.order + "I4xI", data[at : at + 12])
            if last is not None and abs(sec - last) > 86400:
                return False
            if begins + at + 16 + size > self.size:  # a record that is cut off
                return last is not None
            last, at = sec, at + 16 + size
        return True

    def first(self, start: int) -> int:
        """Offset of the first record at or after start."""
        if start <= 24:
            return 24
        window = (CHAIN + 1) * (16 + max(self.snap, 65535))
        while start < self.size:
            data = self.file.read_at(min(2 * window, self.size - start), start)
            for at in range(min(window, len(data))):
                if self._starts(data, at, start):
                    return start + at
            start += window
        return self.size

    def records(self, start: int, end: int, block: int = 1 << 20) -> Iterator[tuple[float, bytes]]:
        """(time, frame) of the records that begin in [start, end); a record that is cut off ends the file."""
        at, data, base = self.first(start), b"", 0
        while at < min(end, self.size):
            if at + 16 > base + len(data):
                base, data = at, self.file.read_at(min(block, self.size - at), at)
            head = data[at - base : at - base + 16]
            if len(head) < 16:
                return
            sec, frac, size, _ = struct.unpack(self.order + "IIII", head)
            if at + 16 + size > base + len(data):
                base, data = at, self.file.read_at(min(max(block, 16 + size), self.size - at), at)
                if 16 + size > len(data):
                    return
            yield sec + frac * self.unit, data[at - base + 16 : at - base + 16 + size]
            at += 16 + size


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = _fs(self.options["path"])
        info = system.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        step = int(self.options.get("rangebytes", 64 << 20))
        found = [Range(f.path, a, a + step) for f in sorted(files, key=lambda f: f.path) if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) for a in range(0, f.size, step)]
        return found or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = _fs(self.options["path"])
        with system.open_input_file(partition.path) as file:
            capture, times, frames, size = Capture(file), [], [], 0
            if not capture.ok:
                return
            for at, frame in capture.records(partition.start, partition.end):
                times.append(round(at * 1e6))
                frames.append(frame)
                size += len(frame)
                if size >= 4 << 20 or len(frames) >= 10_000:
                    yield self._batch(times, frames)
                    times, frames, size = [], [], 0
            if frames:
                yield self._batch(times, frames)

    @staticmethod
    def _batch(times: list[int], frames: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(times, pa.timestamp("us", "UTC")), pa.array(frames, pa.binary())], ["arrival_time", "frame"])


class CaptureSource(DataSource):
    """pcap files (option path: a file or folder) as (arrival_time, frame), `rangeBytes` of a file in a task."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return "arrival_time timestamp, frame binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return CaptureReader(self.options)


def read_pcap(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    spark.dataSource.register(CaptureSource)
    return spark.read.format("pcap").option("path", path).option("rangeBytes", range_bytes).load()


class Slice(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__(None)
        self.low, self.high = low, high


class ExampleReader(DataSourceReader):
    def __init__(self, rows: int, tasks: int):
        self.rows, self.tasks = rows, tasks

    def partitions(self) -> list[InputPartition]:
        return [Slice(self.rows * k // self.tasks, self.rows * (k + 1) // self.tasks) for k in range(self.tasks)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        for i in range(partition.low, partition.high):
            row = flow(arrival_time=datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i), src_ip=3405803776 + i % 200, dst_ip=167772160 + i % 512, source_port=1024 + i % 50000, destination_port=53, protocol=17, length=100, ip_length=100)
            yield tuple(row.values())


class ExampleSource(DataSource):
    """A template for sources of flow rows: derive the columns of schema.FLOW from whatever read() finds. Options rows, tasks."""

    @classmethod
    def name(cls) -> str:
        return "flows_example"

    def schema(self) -> str:
        return FLOW_DDL

    def reader(self, schema: StructType) -> DataSourceReader:
        return ExampleReader(int(self.options.get("rows", 1000)), int(self.options.get("tasks", 2)))
