"""Flow rows to telemetry datagrams and frames: exporters for replays and tests of the decoders."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import columns, groups, schema, values

#: (information element, bytes, column) of the v9 and IPFIX templates below.
FIELDS = [(8, 4, "src_ip"), (12, 4, "dst_ip"), (7, 2, "source_port"), (11, 2, "destination_port"), (4, 1, "protocol"), (1, 4, "length"), (2, 4, "number_of_packets"), (6, 1, "flags"), (16, 4, "src_asn"), (17, 4, "dst_asn"), (10, 4, "input_interface"), (14, 4, "output_interface"), (22, 4, "flow_start"), (21, 4, "flow_end")]
STATUS = {"unknown": 0, "forwarded": 1, "dropped": 2, "consumed": 3}
#: Interface names in both encodings of their length: of an interface 0, of others.
_NAMES = (b"\xff" + struct.pack(">H", 300) + b"x" * 300, bytes([3]) + b"eth")


#: Layout of a v5 record: a column, or None for what stays zero, and its bytes.
FIVE = [("src_ip", 4), ("dst_ip", 4), (None, 4), ("input_interface", 2), ("output_interface", 2), ("number_of_packets", 4), ("length", 4), ("flow_start", 4), ("flow_end", 4), ("source_port", 2), ("destination_port", 2), (None, 1), ("flags", 1), ("protocol", 1), (None, 1), ("src_asn", 2), ("dst_asn", 2), (None, 4)]


def _head5(count: int, ratio: int) -> bytes:
    return struct.pack(">HHIIIIBBH", 5, count, 0, 0, 0, 0, 0, 0, 0x4000 | ratio)


def netflow5(rows: list[dict], ratio: int = 1) -> bytes:
    """Up to 30 rows."""
    out = [_head5(len(rows), ratio)]
    for r in rows:
        out.append(struct.pack(">IIIHHIIIIHHBBBBHHBBH", r["src_ip"], r["dst_ip"], 0, r["input_interface"], r["output_interface"], r["number_of_packets"], r["length"], r["flow_start"], r["flow_end"], r["source_port"], r["destination_port"], 0, r["flags"], r["protocol"], 0, r["src_asn"], r["dst_asn"], 0, 0, 0))
    return b"".join(out)


def _set(kind: int, body: bytes) -> bytes:
    return struct.pack(">HH", kind, len(body) + 4) + body


def _values(r: dict) -> bytes:
    return b"".join(int(r[c]).to_bytes(n, "big") for _, n, c in FIELDS)


def netflow9(rows: list[dict], template: bool = False, rate: int | None = None, source: int = 7) -> bytes:
    """Data of template 256, after the template if asked; rate: announced in an options record behind the data."""
    return _netflow9(b"".join(_values(r) + bytes([STATUS[r["forwarding_status"]] << 6]) for r in rows), template, rate, source)


def _netflow9(body: bytes, template: bool, rate: int | None, source: int = 7) -> bytes:
    parts = []
    if template:
        fields = [(k, n) for k, n, _ in FIELDS] + [(89, 1)]
        parts.append(_set(0, struct.pack(">HH", 256, len(fields)) + b"".join(struct.pack(">HH", *f) for f in fields)))
    parts.append(_set(256, body))
    if rate is not None:
        parts.append(_set(1, struct.pack(">HHH", 257, 4, 4) + struct.pack(">HHHH", 1, 4, 34, 4)))
        parts.append(_set(257, struct.pack(">II", 0, rate)))
    return struct.pack(">HHIIII", 9, len(parts), 0, 0, 0, source) + b"".join(parts)


def ipfix(rows: list[dict], template: bool = False, rate: int | None = None, source: int = 7) -> bytes:
    """As netflow9, with a name of variable length and the end reason (column end_reason) in each record; rate: as packet space."""
    return _ipfix(b"".join(_values(r) + _NAMES[bool(r["input_interface"])] + bytes([r["end_reason"]]) for r in rows), template, rate, source)


def _ipfix(body: bytes, template: bool, rate: int | None, source: int = 7) -> bytes:
    parts = []
    if template:
        fields = [(k, n) for k, n, _ in FIELDS] + [(82, 65535), (136, 1)]
        parts.append(_set(2, struct.pack(">HH", 300, len(fields)) + b"".join(struct.pack(">HH", *f) for f in fields)))
    parts.append(_set(300, body))
    if rate is not None:
        fields = [(304, 2), (305, 4), (306, 4)]
        parts.append(_set(3, struct.pack(">HHH", 301, 3, 1) + b"".join(struct.pack(">HH", *f) for f in fields)))
        parts.append(_set(301, struct.pack(">HII", 1, 1, rate - 1)))
    body = b"".join(parts)
    return struct.pack(">HHIII", 10, 16 + len(body), 0, 0, source) + body


def frame(r: dict) -> bytes:
    """Ethernet, a VLAN tag where the row has one, IPv4 and tcp, udp or icmp."""
    ports = struct.pack(">HH", r["source_port"], r["destination_port"])
    proto = r["protocol"]
    body = ports + struct.pack(">IIBBHHH", r["event_id"], 0, 80, r["flags"], 100, 0, 0) if proto == 6 else ports + struct.pack(">HH", 8, 0) if proto == 17 else bytes([8, 0, 0, 0])
    bits = (0x4000 if r["ip_dont_fragment"] else 0) | (0x2000 if r["ip_fragmented"] else 0)
    ip = struct.pack(">BBHHHBBHII", 0x45, 0, 20 + len(body), 0, bits, r["ttl"], r["protocol"], 0, r["src_ip"], r["dst_ip"])
    tag = struct.pack(">HH", 0x8100, r["vlan"]) if r["vlan"] else b""
    return b"\1" * 6 + b"\2" * 6 + tag + struct.pack(">H", 0x0800) + ip + body


def sflow(rows: list[dict], agent: int) -> bytes:
    """A flow sample with a raw header record for each row, and a counter sample behind them."""
    samples = []
    for r in rows:
        raw = frame(r)
        padded = raw + b"\0" * (-len(raw) % 4)
        record = struct.pack(">II", 1, 16 + len(padded)) + struct.pack(">IIII", 1, r["length"] % 2**32, 0, len(raw)) + padded
        out = 1 << 30 | 5 if r["forwarding_status"] == "dropped" else r["output_interface"]
        body = struct.pack(">IIIIIIII", r["event_id"] % 2**32, 0, r["sample_ratio"], 0, 0, r["input_interface"], out, 1) + record
        samples.append(struct.pack(">II", 1, len(body)) + body)
    counter = struct.pack(">III", 0, 0, 1) + struct.pack(">II", 1, 88) + b"\0" * 88
    samples.append(struct.pack(">II", 2, len(counter)) + counter)
    return struct.pack(">IIIIIII", 5, 1, agent, 0, 0, 0, len(samples)) + b"".join(samples)


#: What each kind of datagram is made of, besides event_id and arrival_time.
FRAME = ["source_port", "destination_port", "flags", "protocol", "ip_dont_fragment", "ip_fragmented", "ttl", "src_ip", "dst_ip", "vlan"]
_OF = {"netflow5": [c for c, _ in FIVE if c], "netflow9": [c for _, _, c in FIELDS] + ["forwarding_status"], "ipfix": [c for _, _, c in FIELDS] + ["input_interface", "end_reason"], "sflow": [*FRAME, "length", "forwarding_status", "output_interface", "sample_ratio", "input_interface"]}


def _fixed(table, layout: list[tuple[str | None, int]]) -> bytes:
    """Records of fixed layout, one after the other; ValueError where a value is null or does not fit."""
    import numpy as np

    out = np.zeros(table.num_rows, [(f"f{i}", f">u{n}") for i, (_, n) in enumerate(layout)])
    for i, (c, n) in enumerate(layout):
        if c is None:
            continue
        if table[c].null_count:
            raise ValueError(f"{c} is null")
        known = table[c].to_numpy().astype(np.int64)
        if known.size and (known.min() < 0 or known.max() >> 8 * n):
            raise ValueError(f"{c} does not fit {n} bytes")
        out[f"f{i}"] = known
    return out.tobytes()


def _payloads(table, kind: str, spans: list[tuple[int, int, int]], announce_at: int | None, rate: int) -> list[bytes]:
    """The datagrams of a table's row ranges (number, begin, end)."""
    if kind == "sflow":
        names = [c for c in table.column_names if c != "arrival_time"]
        rows = [dict(zip(names, r)) for r in zip(*(values(table[c]) for c in names))]
        return [sflow(rows[a:b], 3221225985) for _, a, b in spans]
    if kind == "netflow5":
        body = _fixed(table, FIVE)
        return [_head5(b - a, 100) + body[48 * a : 48 * b] for _, a, b in spans]
    layout = [(c, n) for _, n, c in FIELDS]
    size = sum(n for _, n in layout)
    body = _fixed(table, layout)
    ends = [bytes([STATUS[s] << 6]) for s in values(table["forwarding_status"])] if kind == "netflow9" else [_NAMES[bool(i)] + bytes([e]) for i, e in zip(values(table["input_interface"]), values(table["end_reason"]))]
    records = [body[size * i : size * (i + 1)] + end for i, end in enumerate(ends)]
    whole = _netflow9 if kind == "netflow9" else _ipfix
    return [whole(b"".join(records[a:b]), n == 0, rate if n == announce_at else None) for n, a, b in spans]


def datagrams(flows: DataFrame, kind: str, per: int = 30, announce_at: int | None = None, rate: int = 512) -> DataFrame:
    """exporter, seq, arrival_time, payload of flow rows with event_id, `per` of them in a datagram, in order of event_id.

    kind: netflow5, netflow9, ipfix, sflow. The first datagram brings the template; that with number announce_at a sampling rate.
    Rows come sorted by datagram, so a task holds a batch of rows and one unfinished datagram."""

    def build(batches):
        import numpy as np
        import pyarrow as pa

        names = schema("exporter long, seq long, arrival_time timestamp, payload binary")
        for t in groups(batches, "number"):
            keys = t["number"].to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist()]
            spans = [(int(keys[a]), a, b) for a, b in zip(starts, [*starts[1:], len(keys)])]
            (times,) = columns(t, ["arrival_time"])
            out = [pa.repeat(pa.scalar(3221225985, pa.int64()), len(spans)), pa.array([n for n, _, _ in spans], pa.int64()), times.take(pa.array(starts)).combine_chunks().cast(names.field("arrival_time").type), pa.array(_payloads(t, kind, spans, announce_at, rate), pa.binary())]
            yield pa.RecordBatch.from_arrays(out, schema=names)

    kept = list(dict.fromkeys(["event_id", "arrival_time", *_OF[kind]]))
    dealt = flows.select(*kept, F.floor(F.col("event_id") / per).alias("number")).repartition("number").sortWithinPartitions("number", "event_id")
    return dealt.mapInArrow(build, "exporter long, seq long, arrival_time timestamp, payload binary")
