"""Flow rows as Cap'n Proto messages, each after its length: files and blobs to rows and back.

The layout of the structure follows from the types in order of their numbers by Cap'n Proto's own rule: a field takes the
first hole of its size, else half of a larger hole, else a new word.
"""

from __future__ import annotations

import datetime
import struct
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession

from ..schema import FLOW, FLOW_DDL, flow
from .batches import ROWS

#: Fixed values of the format: the fields by number, with their types (bits, 0 for a data blob).
FIELDS = [
    ("source", 8), ("sample_ratio", 32), ("src_ip", 32), ("dst_ip", 32), ("src_ipv6", 0), ("dst_ipv6", 0), ("src_asn", 32), ("dst_asn", 32),
    ("input_interface", 32), ("output_interface", 32), ("ip_protocol_version", 8), ("ttl", 8), ("source_port", 16), ("destination_port", 16),
    ("protocol", 32), ("length", 64), ("number_of_packets", 64), ("flags", 8), ("ip_fragmented", 1), ("ip_dont_fragment", 1), ("seconds", 64),
    ("micros", 64), ("captured_length", 32), ("full_length", 32), ("direction", 8), ("agent_ipv4_address", 32), ("source_mac", 0),
    ("destination_mac", 0), ("ip_length", 64),
]
#: Fixed values of the format: the codes of sources and directions.
SOURCES = ("unknown", "mirror", "sflow", "netflow", "rows")
DIRECTIONS = ("incoming", "outgoing", "internal", "other")


def layout(fields: list[tuple[str, int]]) -> tuple[dict[str, tuple[int, int]], dict[str, int], int]:
    """(bit offset and size of each number, index of each blob, words of numbers)."""
    holes: dict[int, int] = {}  # size in bits -> offset of a free slot, in bits
    numbers, blobs, words = {}, {}, 0

    def take(size: int) -> int | None:
        if size >= 64:
            return None
        if size in holes:
            return holes.pop(size)
        at = take(2 * size)
        if at is not None:
            holes[size] = at + size
        return at

    for name, size in fields:
        if not size:
            blobs[name] = len(blobs)
            continue
        at = take(size)
        if at is None:
            at, words = 64 * words, words + 1
            free = size
            while free < 64:
                holes[free] = at + free
                free *= 2
        numbers[name] = (at, size)
    return numbers, blobs, words


NUMBERS, BLOBS, WORDS = layout(FIELDS)


def encode(row: dict) -> bytes:
    """One message of one segment: its table, the root pointer, numbers, blob pointers, blobs."""
    known = row | {"source": SOURCES.index(row["source"]) if row.get("source") in SOURCES else 0, "direction": DIRECTIONS.index(row["direction"]) if row.get("direction") in DIRECTIONS else 3}
    if (at := row.get("arrival_time")) is not None:
        micros = (at.replace(tzinfo=None) - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
        known |= {"seconds": micros // 1_000_000, "micros": micros % 1_000_000}
    bits = 0
    for name, (offset, size) in NUMBERS.items():
        bits |= (int(known.get(name) or 0) & ((1 << size) - 1)) << offset
    pointers, blobs = [], b""
    for name, k in BLOBS.items():
        value = bytes.fromhex((row.get(name) or "").replace(":", ""))
        if value:
            distance = len(BLOBS) - k - 1 + len(blobs) // 8
            pointers.append(1 | distance << 2 | 2 << 32 | len(value) << 35)
            blobs += value + bytes(-len(value) % 8)
        else:
            pointers.append(0)
    segment = struct.pack("<Q", WORDS << 32 | len(BLOBS) << 48) + bits.to_bytes(8 * WORDS, "little") + struct.pack(f"<{len(pointers)}Q", *pointers) + blobs
    return struct.pack("<II", 0, len(segment) // 8) + segment


def decode(message: bytes) -> dict:
    """The flow row of a message; fields that an older writer lacked read as zero. ValueError where it is malformed.

    Rows fit one segment; messages of more are refused."""
    if len(message) < 16:
        raise ValueError("the message is cut off")
    more, words = struct.unpack("<II", message[:8])
    if more or not words or len(message) < 8 + 8 * words:
        raise ValueError("the message is cut off or has several segments")
    segment = message[8 : 8 + 8 * words]
    root = struct.unpack("<Q", segment[:8])[0]
    start, data, pointers = 8 * (1 + (root >> 2 & 0x3FFFFFFF)), root >> 32 & 0xFFFF, root >> 48
    if root & 3 or start + 8 * (data + pointers) > len(segment):
        raise ValueError("the root is no structure")
    bits = int.from_bytes(segment[start : start + 8 * data], "little")
    known = {name: bits >> offset & ((1 << size) - 1) for name, (offset, size) in NUMBERS.items()}
    for name, k in BLOBS.items():
        at = start + 8 * (data + k)
        pointer = struct.unpack("<Q", segment[at : at + 8])[0] if k < pointers else 0
        begin, size = at + 8 + 8 * (pointer >> 2 & 0x3FFFFFFF), pointer >> 35
        if pointer and (pointer & 3 != 1 or pointer >> 32 & 7 != 2 or begin + size > len(segment)):
            raise ValueError("a blob's pointer is broken")
        known[name] = segment[begin : begin + size] if pointer else b""
    out = flow(**{n: known[n] for n, _, _ in FLOW if n in NUMBERS and n != "source"})
    six = known["ip_protocol_version"] == 6
    out |= {n: known[n].hex() if six and len(known[n]) == 16 else "" for n in ("src_ipv6", "dst_ipv6")}
    out |= {n: known[n].hex(":") for n in ("source_mac", "destination_mac")}
    out |= {n: bool(known[n]) for n in ("ip_fragmented", "ip_dont_fragment")}
    code = known["source"]
    out["source"] = SOURCES[code] if code < len(SOURCES) else "unknown"
    out["arrival_time"] = datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=known["seconds"], microseconds=known["micros"])
    return out


def messages(data: bytes) -> Iterator[bytes]:
    """The messages of a stream of (length as 64 bits, message); stops at one that is cut off."""
    at = 0
    while at + 8 <= len(data):
        size = struct.unpack("<Q", data[at : at + 8])[0]
        if at + 8 + size > len(data):
            return
        yield data[at + 8 : at + 8 + size]
        at += 8 + size


def read_blobs(blobs: DataFrame, column: str = "content") -> DataFrame:
    """Flow rows of a column of message streams; malformed messages are left out."""

    def rows(batches) -> Iterator[dict]:
        for batch in batches:
            for content in batch[column]:
                for m in messages(content or b""):
                    try:
                        yield decode(m)
                    except (ValueError, OverflowError):
                        continue

    def run(batches) -> Iterator:
        import pandas as pd

        found = rows(batches)
        while part := list(islice(found, ROWS)):
            yield pd.DataFrame({n: [r[n] for r in part] for n, _, _ in FLOW})

    return blobs.select(column).mapInPandas(run, FLOW_DDL)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return read_blobs(spark.read.format("binaryFile").load(path))


def write_blobs(flows: DataFrame) -> DataFrame:
    """content: one stream for each 4,096 rows at most, ready for any binary sink. Columns that flows lacks are zero."""
    kept = [c for c in [n for n, _, _ in FLOW] + ["direction"] if c in flows.columns]

    def run(batches) -> Iterator:
        import pandas as pd

        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at : at + ROWS].astype(object)
                rows = zip(*[c.where(c.notna(), None) for _, c in part.items()])
                out = [encode(dict(zip(kept, r))) for r in rows]
                yield pd.DataFrame({"content": [b"".join([x for m in out for x in (struct.pack("<Q", len(m)), m)])]})

    return flows.select(*kept).mapInPandas(run, "content binary")
