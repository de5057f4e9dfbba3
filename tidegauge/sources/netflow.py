"""NetFlow v5, v9 and IPFIX datagrams to flow rows.

Datagrams are rows (exporter, seq, arrival_time, payload). v9 and IPFIX need templates that earlier datagrams brought: a first
pass takes templates and options out of all datagrams, a second joins each data set to the template as of its datagram.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import islice

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FLOW, FLOW_DDL, flow
from .batches import STEP, packed, schema, tuples
from .frames import OK, ethernet, ipv4, mac
from .templates import as_of, rate_as_of

_NAMES = [n for n, _, _ in FLOW]


def version(payload: bytes) -> int:
    """5, 9 or 10, else 0."""
    found = struct.unpack(">H", payload[:2])[0] if len(payload) >= 2 else 0
    return found if found in (5, 9, 10) else 0


def netflow5(payload: bytes, at, exporter: int = 0) -> Iterator[dict]:
    """Up to 30 records; a count of 0 or above 30 gives none, and reading ends where bytes do."""
    if len(payload) < 24:
        return
    count = struct.unpack(">H", payload[2:4])[0]
    if not 0 < count <= 30:
        return
    ratio = struct.unpack(">H", payload[22:24])[0] & 0x3FFF or 1
    for i in range(count):  # fixed values: the layout of a record
        r = payload[24 + 48 * i : 72 + 48 * i]
        if len(r) < 48:
            return
        src, dst, _, inp, out, packets, octets, first, last, sport, dport = struct.unpack(">IIIHHIIIIHH", r[:36])
        flags, proto = r[37], r[38]
        known = proto if proto in (1, 6, 17) else 0
        yield flow(arrival_time=at, source="netflow", src_ip=src, dst_ip=dst, input_interface=inp, output_interface=out, number_of_packets=packets, length=octets, ip_length=octets, flow_start=first, flow_end=last, source_port=sport, destination_port=dport, protocol=known, flags=flags if proto == 6 else 0, src_asn=struct.unpack(">H", r[40:42])[0], dst_asn=struct.unpack(">H", r[42:44])[0], sample_ratio=ratio, agent_ipv4_address=exporter)


#: Information elements (IANA numbers) with the row's column.
NUMBERS = {1: "length", 2: "number_of_packets", 4: "protocol", 6: "flags", 7: "source_port", 8: "src_ip", 10: "input_interface", 11: "destination_port", 12: "dst_ip", 14: "output_interface", 16: "src_asn", 17: "dst_asn", 21: "flow_end", 22: "flow_start", 34: "_interval", 50: "_interval", 85: "length", 86: "number_of_packets", 148: "_flow_id", 152: "flow_start", 153: "flow_end", 180: "source_port", 181: "destination_port", 182: "source_port", 183: "destination_port", 230: "_nat", 231: "_fwd_bytes", 232: "_rev_bytes", 298: "_fwd_packets", 299: "_rev_packets", 304: "_algorithm", 305: "_packet_interval", 306: "_packet_space", 318: "_observed", 319: "_selected", 312: "_frame_size", 136: "end_reason", 15: "_next_hop", 18: "_bgp_next_hop", 82: "_interface_name", 36: "_active", 37: "_inactive"}
STATUS = ("unknown", "forwarded", "dropped", "consumed")


def number(raw: bytes) -> int:
    return int.from_bytes(raw, "big")


def record(fields: list[tuple[int, int]], data: bytes, at: int, ipfix: bool) -> tuple[dict, int] | None:
    """Values of one record and where the next begins; None where bytes end."""
    out: dict = {}
    for kind, size in fields:
        if ipfix and size == 65535:
            if at >= len(data):
                return None
            size, at = data[at], at + 1
            if size == 255:
                size, at = number(data[at : at + 2]), at + 2
        raw = data[at : at + size]
        if len(raw) < size:
            return None
        at += size
        if kind in NUMBERS:
            out[NUMBERS[kind]] = number(raw)
        elif kind in (27, 28):
            out["src_ipv6" if kind == 27 else "dst_ipv6"] = raw.hex()
            out["ip_protocol_version"] = 6
        elif kind in (56, 80):
            out["source_mac" if kind == 56 else "destination_mac"] = mac(raw)
        elif kind in (156, 157):
            out["flow_start" if kind == 156 else "flow_end"] = number(raw) // 1_000_000
        elif kind in (62, 63):
            out["_next_hop6"] = number(raw)
        elif kind == 89:
            out["_status"] = True
            out["forwarding_status"] = STATUS[raw[-1] >> 6] if size == 1 else STATUS[number(raw) & 3]
        elif kind in (104, 315):
            out["_frame"] = raw
    return out, at


def options_rate(values: dict) -> int | None:
    if "_packet_space" in values and values.get("_algorithm") == 1 and values.get("_packet_interval"):
        return (values["_packet_space"] + values["_packet_interval"]) // values["_packet_interval"]
    return values.get("_interval") or values.get("_packet_interval")


def to_rows(values: dict, at, exporter: int, drop_without_next_hop: bool = False, notes: list | None = None) -> Iterator[dict]:
    """The rows of one data record: none for NAT events, two for bidirectional ones. A row's `own_ratio` is the ratio that the
    record itself tells, if it does. drop_without_next_hop: no status, no output interface and a next hop of zero mean dropped.
    notes: takes the names of what was met."""
    note = notes.append if notes is not None else lambda _: None
    if values.get("_nat"):
        note("nat_events")
        return
    row = flow(arrival_time=at, source="netflow", agent_ipv4_address=exporter)
    row |= {k: v for k, v in values.items() if not k.startswith("_")} | {"own_ratio": None}
    if "_frame" in values:
        note("lite_headers")
        if ethernet(values["_frame"], row) == OK:
            note("lite_header_parser_success")
            row["length"] = values.get("_frame_size") or row["length"]
            row["number_of_packets"] = 1
            if values.get("_selected"):
                row["own_ratio"] = row["sample_ratio"] = values["_observed"] // values["_selected"]
                note("flows_with_sampling_encoded_in_data_packet_number")
        else:
            note("lite_header_parser_error")
    zero = "0" * 32
    if row["ip_protocol_version"] == 6 and row["src_ipv6"] in ("", zero) and row["dst_ipv6"] in ("", zero) and (row["src_ip"] or row["dst_ip"]):
        row["ip_protocol_version"] = 4
        note("protocol_version_adjustments")
    if values.get("_status"):
        note("forwarding_status")
    elif drop_without_next_hop and not row["output_interface"] and 0 in (values.get("_next_hop"), values.get("_next_hop6")):
        row["forwarding_status"] = "dropped"
        note("marked_zero_next_hop_and_zero_output_as_dropped")
    row["flags"] &= 63
    row["ip_length"] = row["ip_length"] or row["length"]
    if row["protocol"] == 1:
        row["source_port"] = row["destination_port"] = 0
    note("total_flows")
    note(f"total_ipv{row['ip_protocol_version']}_flows")
    if not row["length"] and not row["number_of_packets"] - ("number_of_packets" not in values) and values.get("_flow_id"):
        yield row | {"length": values.get("_fwd_bytes", 0), "ip_length": values.get("_fwd_bytes", 0), "number_of_packets": values.get("_fwd_packets", 0)}
        swap = {"src_ip": "dst_ip", "src_ipv6": "dst_ipv6", "source_port": "destination_port", "input_interface": "output_interface", "src_asn": "dst_asn", "src_country": "dst_country"}
        back = {k: row[v] for k, v in swap.items()} | {v: row[k] for k, v in swap.items()}
        yield row | back | {"length": values.get("_rev_bytes", 0), "ip_length": values.get("_rev_bytes", 0), "number_of_packets": values.get("_rev_packets", 0)}
        return
    yield row


def sets(payload: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(source id, set id, body) of a v9 or IPFIX datagram; ends at the first set that does not fit."""
    ipfix = version(payload) == 10
    head = 16 if ipfix else 20
    if len(payload) < head:
        return
    source, at = number(payload[head - 4 : head]), head
    while at + 4 <= len(payload):
        kind, size = struct.unpack(">HH", payload[at : at + 4])
        if size < 4 or at + size > len(payload):
            return
        yield source, kind, payload[at + 4 : at + size]
        at += size


def templates(body: bytes, kind: int, ipfix: bool) -> Iterator[tuple[int, list[tuple[int, int]], bool]]:
    """(template id, fields, is options) of a template set: 0 and 1 in v9, 2 and 3 in IPFIX."""
    at, options = 0, kind in (1, 3)
    while at + 4 <= len(body):
        name = number(body[at : at + 2])
        if name < 256:
            return
        if options and not ipfix:
            count = (number(body[at + 2 : at + 4]) + number(body[at + 4 : at + 6])) // 4
            at += 6
        else:
            count = number(body[at + 2 : at + 4])
            at += 6 if options else 4
        fields = []
        for _ in range(count):
            if at + 4 > len(body):
                return
            element, size = struct.unpack(">HH", body[at : at + 4])
            at += 4
            if ipfix and element & 0x8000:
                element, at = -1, at + 4
            fields.append((element, size))
        yield name, fields, options


#: A v5 record; names with an underscore are passed over.
_V5 = [("src_ip", ">u4"), ("dst_ip", ">u4"), ("_next_hop", ">u4"), ("input_interface", ">u2"), ("output_interface", ">u2"), ("number_of_packets", ">u4"), ("length", ">u4"), ("flow_start", ">u4"), ("flow_end", ">u4"), ("source_port", ">u2"), ("destination_port", ">u2"), ("_pad", "u1"), ("flags", "u1"), ("protocol", "u1"), ("_tos", "u1"), ("src_asn", ">u2"), ("dst_asn", ">u2"), ("_rest", ">u4")]


def _rows5(part: list[tuple]):
    """The records of (payload, time, exporter) as netflow5() reads them, in one Arrow batch; None if there are none."""
    import numpy as np
    import pyarrow as pa

    bodies, counts, ratios, of = [], [], [], []
    for i, (p, _, _) in enumerate(part):
        p = bytes(p or b"")
        count = number(p[2:4]) if version(p) == 5 and len(p) >= 24 else 0
        fits = min(count, (len(p) - 24) // 48) if count <= 30 else 0
        if fits > 0:
            bodies.append(p[24 : 24 + 48 * fits])
            counts.append(fits)
            ratios.append(number(p[22:24]) & 0x3FFF or 1)
            of.append(i)
    if not of:
        return None
    got = np.frombuffer(b"".join(bodies), _V5)
    known = {n: got[n] for n, _ in _V5 if n[0] != "_"}
    known |= {"ip_length": got["length"], "sample_ratio": np.repeat(ratios, counts), "flags": np.where(got["protocol"] == 6, got["flags"], 0), "protocol": np.where(np.isin(got["protocol"], (1, 6, 17)), got["protocol"], 0)}
    each = pa.array(np.repeat(of, counts))
    fixed, kinds = {"source": "netflow"}, schema(FLOW_DDL)
    cols = []
    for n, _, absent in FLOW:
        kind = kinds.field(n).type
        if n in ("arrival_time", "agent_ipv4_address"):
            cols.append(pa.array([r[1 if n == "arrival_time" else 2] for r in part], kind).take(each))
        elif n in known:
            cols.append(pa.array(known[n].astype(kind.to_pandas_dtype())))
        else:
            cols.append(pa.repeat(pa.scalar(fixed.get(n, absent), kind), len(got)))
    return pa.RecordBatch.from_arrays(cols, schema=kinds)


def decode5(datagrams: DataFrame) -> DataFrame:
    """The rows of v5 datagrams, those of 256 datagrams at a time."""

    def run(batches):
        rows = tuples(batches, ["payload", "arrival_time", "exporter"])
        while part := list(islice(rows, STEP)):
            if (out := _rows5(part)) is not None:
                yield out

    return datagrams.select("payload", "arrival_time", "exporter").mapInArrow(run, FLOW_DDL)


_KEYS = ["exporter", "source_id", "template_id", "version"]
END_REASONS = {1: "idle_timeout", 2: "active_timeout", 3: "end_of_flow_timeout", 4: "force_end_timeout", 5: "lack_of_resource_timeout"}


def prefix_of(v: int) -> str:
    return "ipfix_" if v == 10 else "netflow_v9_"


@lru_cache(4096)
def _plain(fields: tuple[tuple[int, int], ...]) -> tuple[struct.Struct, list[str]] | None:
    """How to unpack a record of fixed length whose known elements are whole numbers; None if it has others."""
    layout, names = ">", []
    for kind, size in fields:
        if kind in NUMBERS and size in (1, 2, 4, 8) or kind == 89 and size == 1:
            layout += {1: "B", 2: "H", 4: "I", 8: "Q"}[size]
            names.append(NUMBERS.get(kind, "_status"))
        elif kind in NUMBERS or kind in (27, 28, 56, 80, 156, 157, 62, 63, 89, 104, 315) or size == 65535:
            return None
        else:
            layout += f"{size}x"
    return struct.Struct(layout), names


def records(fields: list[tuple[int, int]], body: bytes, ipfix: bool, notes: list) -> Iterator[dict]:
    """The records of a data set. IPFIX sets of fixed length hold up to 0x4000; what is left over is padding."""
    least = sum(n if n != 65535 or not ipfix else 1 for _, n in fields)
    varies = ipfix and any(n == 65535 for _, n in fields)
    if not fields or not least:
        return
    if ipfix and not varies:
        if len(body) // least > 0x4000:
            return
        if len(body) % least > 7:
            notes.append("sets_with_anomaly_padding")
    at = 0
    if (plain := _plain(tuple(fields))) is not None:
        at = len(body) // least * least
        for raw in plain[0].iter_unpack(body[:at]):
            values = dict(zip(plain[1], raw))
            if "_status" in values:
                values |= {"_status": True, "forwarding_status": STATUS[values["_status"] >> 6]}
            yield values
    while at + least <= len(body):
        found = record(fields, body, at, ipfix)
        if found is None:
            notes.append("broken_packets")
            return
        values, at = found
        yield values
    if ipfix and at < len(body):
        notes.append("packets_with_padding" if not any(body[at:]) else "broken_packets")


_SETS = "exporter long, seq long, arrival_time timestamp, source_id long, template_id int, version int, what string, fields string, body binary"


def framed(datagrams: DataFrame, bodies: bool = True) -> DataFrame:
    """The sets of v9 and IPFIX datagrams: exporter, seq, arrival_time, source_id, template_id, version, what, fields, body.

    what: packet (one for each datagram), unknown, template, options, data. seq orders sets: 65,536 for each datagram.
    bodies: with the data sets."""
    names = [c.split()[0] for c in _SETS.split(", ")]

    def run(batches):
        def found():
            for p, t, e, s in tuples(batches, ["payload", "arrival_time", "exporter", "seq"]):
                p = bytes(p)
                v, order = version(p), s * 65536
                yield (e, order, t, 0, 0, v, "packet" if v else "unknown", None, None)
                if v not in (9, 10):
                    continue
                for k, (source, kind, body) in enumerate(sets(p)):
                    if kind in ((2, 3) if v == 10 else (0, 1)):
                        for name, fields, opt in templates(body, kind, v == 10):
                            yield (e, order + k, t, source, name, v, "options" if opt else "template", ",".join(f"{a}:{n}" for a, n in fields), None)
                    elif kind >= 256 and bodies:
                        yield (e, order + k, t, source, kind, v, "data", None, body)

        return packed((dict(zip(names, r)) for r in found()), _SETS, 512)

    return datagrams.select("payload", "arrival_time", "exporter", "seq").mapInArrow(run, _SETS)


def history(sets: DataFrame) -> DataFrame:
    """Announced templates in order, each with the one that it replaces."""
    return sets.where("what in ('template', 'options')").select(*_KEYS, "seq", "what", "fields").withColumn("before", F.lag(F.concat("what", "fields")).over(Window.partitionBy(*_KEYS).orderBy("seq")))


def known_sets(sets: DataFrame, announced: DataFrame) -> DataFrame:
    """The data sets with the template as of their datagram, null where there was none yet. announced: of history(); only changes
    travel, to every task, as a template's name, fields and first datagram."""
    versions = announced.where("before is null or before <> concat(what, fields)").select(*_KEYS, F.col("seq").alias("since"), F.concat_ws(";", F.substring("what", 1, 1), "fields").alias("template"))
    return as_of(sets.where("what = 'data'").drop("fields", "what"), versions, _KEYS, F.col("seq"), "template")


_MORE = "seq long, version int, kind string, own_ratio long, announced long, active_timeout long, inactive_timeout long, interface long, interface_name string, notes string, record int"


def read_sets(data: DataFrame, drop_without_next_hop: bool = False) -> DataFrame:
    """What data sets with their templates hold: see events(). A column `rate` goes along."""
    rated = "rate" in data.columns
    names = ["seq", "version", "arrival_time", "exporter", "body", "template"] + ["rate"] * rated
    ddl = f"{FLOW_DDL}, {_MORE}" + ", rate long" * rated

    def read(batches):
        def found():
            for seq, v, at, exporter, body, template, *rate in tuples(batches, names):
                same = {"seq": seq, "version": v} | ({"rate": rate[0]} if rated else {})
                prefix = prefix_of(v)

                def add(notes, row=None, **known):
                    return (row or flow(arrival_time=at, agent_ipv4_address=exporter)) | same | {"notes": ",".join([prefix + n for n in notes])} | known

                if template is None:
                    yield add(["packets_with_unknown_templates"], kind="other")
                    continue
                kind, _, text = template.partition(";")
                fields, notes = _fields(text), ["options_packet_number" if kind == "o" else "data_packet_number"]
                for i, values in enumerate(records(fields, body, v == 10, notes)):
                    if kind == "o":
                        told = options_rate(values)
                        own = [n for n, c in (("custom_sampling_rate_received", told), ("active_flow_timeout_received", values.get("_active")), ("inactive_flow_timeout_received", values.get("_inactive"))) if c]
                        yield add(own, kind="option", record=i, announced=told, active_timeout=values.get("_active"), inactive_timeout=values.get("_inactive"), interface=values.get("input_interface"), interface_name=str(values["_interface_name"]) if "_interface_name" in values else None)
                        continue
                    own = []
                    for j, row in enumerate(to_rows(values, at, exporter, drop_without_next_hop, own)):
                        if j == 0 and v == 10 and row["end_reason"] in END_REASONS:
                            own.append(f"flows_end_reason_{END_REASONS[row['end_reason']]}")
                        yield add(own if j == 0 else [], row, kind="flow")
                    if values.get("_nat"):
                        yield add(own, kind="other")
                yield add(notes, kind="other")

        return packed(found(), ddl)

    return data.select(*names).mapInArrow(read, ddl)


@lru_cache(4096)
def _fields(text: str) -> list[tuple[int, int]]:
    return [tuple(map(int, x.split(":"))) for x in text.split(",") if x]


def events(sets: DataFrame, drop_without_next_hop: bool = False) -> DataFrame:
    """What the data sets of framed() hold: flow columns, seq, version, kind (flow, option, other), own_ratio, announced,
    active_timeout, inactive_timeout, interface, interface_name, notes, record (its place among the options of a set). Data before its
    template is left out; the latest template wins."""
    return read_sets(known_sets(sets, history(sets)), drop_without_next_hop)


def decode_templated(datagrams: DataFrame, default_ratio: int = 1, keep: str | None = None, drop_without_next_hop: bool = False) -> DataFrame:
    """Flow rows of v9 and IPFIX datagrams, with the ratio of the record or else the exporter's last announced one.

    Rates join the sets before these are read, so flow rows are neither sorted nor moved. Without keep datagrams are framed four times:
    for templates, options, ranges of seq and data.
    keep: a shared folder to store the sets in, so that datagrams are unpacked once."""
    sets = bare = framed(datagrams)
    if keep:
        sets.write.parquet(keep)
        sets = bare = datagrams.sparkSession.read.parquet(keep)
    else:
        bare = framed(datagrams, bodies=False)
    data = known_sets(sets, history(bare))
    said = read_sets(data.where("template like 'o;%'")).where("announced is not null").select(F.col("agent_ipv4_address").alias("exporter"), "seq", "record", "announced")
    data = rate_as_of(data.where("template like 't;%'"), said, bare.where("what = 'packet'").select("exporter", "seq"), "rate")
    rows = read_sets(data, drop_without_next_hop)
    return rows.where("kind = 'flow'").withColumn("sample_ratio", F.coalesce("own_ratio", "rate", F.lit(default_ratio).cast("long"))).select(*_NAMES)


def exporter_options(datagrams: DataFrame) -> DataFrame:
    """What exporters announced in options: exporter, seq, sampling rate, timeouts, interface names."""
    data = known_sets(framed(datagrams), history(framed(datagrams, bodies=False))).where("template like 'o;%'")
    return read_sets(data).where("kind = 'option'").select(F.col("agent_ipv4_address").alias("exporter"), "seq", F.col("announced").alias("sampling_rate"), "active_timeout", "inactive_timeout", "interface", "interface_name")


def decode_counters(datagrams: DataFrame) -> DataFrame:
    """name, value: what decoding v5, v9 and IPFIX datagrams met, by the names of the system counters."""
    from ..operators.counters import duration_bucket

    bare = framed(datagrams, bodies=False)
    announced = history(bare)
    v = F.col("version")
    own = F.when(v == 10, "ipfix_").when(v == 9, "netflow_v9_").otherwise("netflow_v5_")
    frames = bare.select(F.explode(F.when(F.col("what") == "packet", F.array(F.lit("netflow_ipfix_total_packets"), F.concat(own, F.lit("total_packets")))).when(F.col("what") == "unknown", F.array(F.lit("netflow_ipfix_total_packets"), F.lit("netflow_ipfix_unknown_protocol_version"))).when(F.col("what") == "template", F.array(F.concat(own, F.lit("data_templates_number")))).otherwise(F.array(F.concat(own, F.lit("options_templates_number"))))).alias("name"))
    changes = announced.where("before is not null")
    changes = changes.select(F.when(F.col("before") == F.concat("what", "fields"), "template_update_attempts_with_same_template_data").otherwise(F.concat(own, F.lit("template_updates_number_due_to_real_changes"))).alias("name"))
    seconds = ((F.col("flow_end") - F.col("flow_start")) / 1000).cast("long")
    bucket = lambda k: F.regexp_replace(duration_bucket(seconds, k), "^[0-9]+-", "")
    lasting = lambda head, k: F.concat(F.lit(f"{head}duration_"), F.when(bucket(k) == "0", "0_seconds").when(bucket(k) == "180+", "exceed_180_seconds").when(bucket(k) == "negative", "negative").otherwise(F.concat(F.lit("less_"), bucket(k), F.lit("_seconds"))))
    found = read_sets(known_sets(framed(datagrams), announced))
    notes = F.when(F.col("notes") == "", F.array().cast("array<string>")).otherwise(F.split("notes", ","))
    lasts = F.when(F.col("kind") == "flow", F.array(F.when(v == 10, lasting("ipfix_", "ipfix")).otherwise(lasting("netflow_v9_", "v9")))).otherwise(F.array().cast("array<string>"))
    met = found.select(F.explode(F.concat(notes, lasts)).alias("name"))
    five = decode5(datagrams)
    five = five.select(F.explode(F.array(F.lit("netflow_v5_total_flows"), lasting("netflow_v5_", "v5"))).alias("name"))
    return reduce(DataFrame.unionByName, [frames, changes, met, five]).groupBy("name").agg(F.count(F.lit(1)).alias("value"))


def sflow5(payload: bytes, at, notes: list | None = None) -> Iterator[dict]:
    """One row for each flow sample; other enterprises are passed over, counter samples only noted. notes: names of what was met."""
    note = notes.append if notes is not None else lambda _: None
    note("total_packets")
    if len(payload) < 8 or number(payload[:4]) != 5:
        note("bad_packets")
        return
    v6 = number(payload[4:8]) == 2
    agent = 0 if v6 else number(payload[8:12])
    pos = 8 + (16 if v6 else 4) + 12
    count = number(payload[pos : pos + 4])
    pos += 4
    if count > 256 or pos > len(payload):
        note("bad_packets")
        return
    for _ in range(count):
        if pos + 8 > len(payload):
            note("bad_packets")
            return
        kind, size = struct.unpack(">II", payload[pos : pos + 8])
        body, pos = payload[pos + 8 : pos + 8 + size], pos + 8 + size
        if len(body) < size:
            note("bad_packets")
            return
        if kind >> 12:
            continue
        if kind in (2, 4):
            note("counter_sample" if kind == 2 else "expanded_counter_sample")
            head = 8 if kind == 2 else 12
            for what, _ in _records(body, head, note):
                if what == 1:
                    note("generic_interface_counter_sample")
            continue
        if kind not in (1, 3):
            continue
        note("flow_samples")
        if size < (32 if kind == 1 else 44):
            note("bad_flow_samples")
            return
        if kind == 1:
            ratio, out_port, inp, head = number(body[8:12]), number(body[24:28]), number(body[20:24]), 28
            dropped, out_if = out_port >> 30 == 1, out_port & 0x3FFFFFFF
        else:
            ratio, inp, dropped, out_if, head = number(body[12:16]), number(body[28:32]), number(body[32:36]) == 1, number(body[36:40]), 40
        row = flow(arrival_time=at, source="sflow", sample_ratio=ratio, input_interface=inp & 0x3FFFFFFF, output_interface=out_if, agent_ipv4_address=agent)
        if dropped:
            note("packets_discarded")
            row["forwarding_status"] = "dropped"
        good, bad = True, []
        for what, content in _records(body, head, bad.append):
            if what == 1 and len(content) >= 16:
                note("raw_packet_headers_total")
                protocol, frame_length, _, captured = struct.unpack(">IIII", content[:16])
                raw = content[16 : 16 + captured]
                note({11: "ipv4_header_protocol", 12: "ipv6_header_protocol"}.get(protocol, "unknown_header_protocol") if protocol != 1 else "")
                status = ethernet(raw, row) if protocol == 1 else ipv4(raw, row, False) if protocol == 11 else "unsupported"
                if status != OK:
                    note("parse_error_nested_header")
                good &= status == OK
                row["length"], row["ip_length"] = frame_length, row["ip_length"] or frame_length
            elif what == 1:
                note("invalid_raw_packet_header")
            elif what in (1001, 1002):
                note("extended_switch_data_records" if what == 1001 else "extended_router_data_records")
            elif what == 1003 and len(content) >= 16:
                note("extended_gateway_data_records")
                skip = 4 + (16 if number(content[:4]) == 2 else 4)
                row["src_asn"], row["dst_asn"] = number(content[skip : skip + 4]), number(content[skip + 4 : skip + 8])
        if bad:
            note("bad_flow_samples")
        elif good:
            yield row
    if pos < len(payload):
        note("with_padding_at_the_end_of_packet")


def _records(body: bytes, at: int, note) -> Iterator[tuple[int, bytes]]:
    """(kind, content) of a sample's records, 256 at most; notes bad_records where they do not fit."""
    count, at = number(body[at : at + 4]), at + 4
    for _ in range(min(count, 256)):
        if at + 8 > len(body):
            note("bad_records")
            return
        what, length = struct.unpack(">II", body[at : at + 8])
        yield what, body[at + 8 : at + 8 + length]
        at += 8 + length


def decode_sflow(datagrams: DataFrame) -> DataFrame:
    def run(batches):
        return packed((r for p, t in tuples(batches, ["payload", "arrival_time"]) for r in sflow5(bytes(p), t)), FLOW_DDL)

    return datagrams.select("payload", "arrival_time").mapInArrow(run, FLOW_DDL)


def sflow_counters(datagrams: DataFrame) -> DataFrame:
    """name, value: what decoding sFlow datagrams met, by the names of the system counters. Each task sends one row a name."""

    def run(batches):
        met: Counter = Counter()
        for (p,) in tuples(batches, ["payload"]):
            notes: list[str] = []
            for _ in sflow5(bytes(p), None, notes):
                pass
            met.update(notes)
        return packed(({"name": f"sflow_{n}", "value": k} for n, k in met.items() if n), "name string, value long")

    return datagrams.select("payload").mapInArrow(run, "name string, value long").groupBy("name").agg(F.sum("value").alias("value"))
