"""Ethernet, IPv4 and IPv6 headers of captured frames, and pcap files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FLOW_DDL, flow
from .batches import packed, tuples

OK, SHORT, UNKNOWN, BAD = "success", "memory_violation", "no_ipv4_or_ipv6", "malformed_ip_header_length"


def mac(b: bytes) -> str:
    return b.hex(":")


def _transport(row: dict, proto: int, data: bytes) -> str:
    if proto in (6, 17):
        if len(data) < 4:
            return SHORT
        row["source_port"], row["destination_port"] = struct.unpack(">HH", data[:4])
        if proto == 6 and len(data) >= 14:
            row["flags"] = data[13] & 63
            if len(data) >= 16:
                row["tcp_sequence_number"], row["tcp_ack_number"] = struct.unpack(">II", data[4:12])
                row["tcp_window_size"] = struct.unpack(">H", data[14:16])[0]
        elif proto == 6 or len(data) < 8:
            return SHORT
    elif proto in (1, 58):
        if len(data) < 2:
            return SHORT
        row["icmp_type"], row["icmp_code"] = data[0], data[1]
    return OK


def ipv4(data: bytes, row: dict, later_fragments: bool = True) -> str:
    """later_fragments: stop with success at a fragment that is not the first."""
    if len(data) < 20:
        return SHORT
    head = (data[0] & 15) * 4
    if head < 20:
        return BAD
    total, fragment = struct.unpack(">H", data[2:4])[0], struct.unpack(">H", data[6:8])[0]
    row |= {"ip_protocol_version": 4, "ip_length": total, "ttl": data[8], "protocol": data[9], "src_ip": struct.unpack(">I", data[12:16])[0], "dst_ip": struct.unpack(">I", data[16:20])[0], "ip_dont_fragment": bool(fragment & 0x4000), "ip_more_fragments": bool(fragment & 0x2000), "ip_fragment_offset": (fragment & 0x1FFF) * 8}
    row["ip_fragmented"] = row["ip_more_fragments"] or row["ip_fragment_offset"] != 0
    if len(data) < head:
        return SHORT
    if row["ip_fragment_offset"] and later_fragments:
        return OK
    return _transport(row, data[9], data[head:])


def ipv6(data: bytes, row: dict) -> str:
    if len(data) < 40:
        return SHORT
    row |= {"ip_protocol_version": 6, "ip_length": struct.unpack(">H", data[4:6])[0] + 40, "protocol": data[6], "ttl": data[7], "src_ipv6": data[8:24].hex(), "dst_ipv6": data[24:40].hex()}
    if data[6] == 44:
        row["ip_fragmented"] = True
        return OK
    if data[6] in (0, 43, 60, 51, 50, 135):
        return UNKNOWN
    return _transport(row, data[6], data[40:])


def ethernet(data: bytes, row: dict) -> str:
    if len(data) < 14:
        return SHORT
    row |= {"destination_mac": mac(data[:6]), "source_mac": mac(data[6:12]), "length": len(data)}
    kind, at, first = struct.unpack(">H", data[12:14])[0], 14, True
    while kind in (0x8100, 0x88A8):
        if len(data) < at + 4:
            return SHORT
        tag, kind = struct.unpack(">HH", data[at : at + 4])
        if first:
            row["vlan"], first = tag & 0xFFF, False
        at += 4
    if kind == 0x0800:
        return ipv4(data[at:], row)
    if kind == 0x86DD:
        return ipv6(data[at:], row)
    return "arp" if kind == 0x0806 else "mpls" if kind in (0x8847, 0x8848) else UNKNOWN


def pcap(data: bytes) -> Iterator[tuple[float, bytes]]:
    """(time, frame) of a classic pcap file in either byte order."""
    order = "<" if data[:4] in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1") else ">"
    unit = 1e-9 if data[:4] in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d") else 1e-6
    at = 24
    while at + 16 <= len(data):
        sec, frac, size, _ = struct.unpack(order + "IIII", data[at : at + 16])
        if at + 16 + size > len(data):
            return
        yield sec + frac * unit, data[at + 16 : at + 16 + size]
        at += 16 + size


def pcap_bytes(packets: list[tuple[float, bytes]], snap: int = 65535) -> bytes:
    """A classic pcap file of Ethernet frames (time, frame), each cut to `snap` bytes."""
    out = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, snap, 1)]
    for at, frame in packets:
        micros = round(at * 1_000_000)
        out.append(struct.pack("<IIII", micros // 1_000_000, micros % 1_000_000, min(len(frame), snap), len(frame)) + frame[:snap])
    return b"".join(out)


def frames_to_flows(frames: DataFrame, ratio: int = 1) -> DataFrame:
    """frames: arrival_time, frame. Flow columns and the parser's status, one row per frame."""

    def run(batches):
        def found():
            for at, data in tuples(batches, ["arrival_time", "frame"]):
                row = flow(arrival_time=at, source="mirror", sample_ratio=ratio)
                status = ethernet(bytes(data or b""), row)
                yield row | {"status": status}

        return packed(found(), FLOW_DDL + ", status string")

    return frames.select("arrival_time", "frame").mapInArrow(run, FLOW_DDL + ", status string")


def status_counts(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
