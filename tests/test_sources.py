"""Decoders on hand-built bytes."""

import datetime
import random
import struct

from tidegauge.operators import rules
from tidegauge.sources import config, fixtures, frames, netflow, plugin

AT = datetime.datetime(2024, 1, 1)


def v5(n, count=None, sampling=0x4064):
    head = struct.pack(">HHIIIIBBH", 5, n if count is None else count, 0, 0, 0, 0, 0, 0, sampling)
    rec = b"".join(struct.pack(">IIIHHIIIIHHBBBBHHBBH", 0x0A000001 + i, 0xCB007101, 0, 1, 2, 10, 1000, 5, 9, 1234, 80, 0, 2, 6, 0, 64500, 64600, 24, 24, 0) for i in range(n))
    return head + rec


def test_netflow5():
    rows = list(netflow.netflow5(v5(2), AT))
    assert [r["src_ip"] for r in rows] == [0x0A000001, 0x0A000002]
    assert rows[0]["sample_ratio"] == 100 and rows[0]["flags"] == 2 and rows[0]["protocol"] == 6
    assert len(list(netflow.netflow5(v5(2, 3), AT))) == 2
    assert not list(netflow.netflow5(v5(0), AT)) and not list(netflow.netflow5(v5(0, 31), AT)) and not list(netflow.netflow5(b"\0\5", AT))


def v9(*parts):
    return struct.pack(">HHIIII", 9, len(parts), 0, 0, 0, 7) + b"".join(struct.pack(">HH", k, len(b) + 4) + b for k, b in parts)


FIELDS = [(8, 4), (12, 4), (7, 2), (11, 2), (4, 1), (1, 4), (2, 4)]
TEMPLATE = struct.pack(">HH", 256, len(FIELDS)) + b"".join(struct.pack(">HH", *f) for f in FIELDS)
DATA = struct.pack(">IIHHBII", 0x0A000001, 0xCB007101, 1000, 53, 17, 500, 5)
OPTIONS = struct.pack(">HHH", 257, 4, 4) + struct.pack(">HHHH", 1, 4, 34, 4)


def decode(spark, payloads):
    rows = [(1, i, AT, bytearray(p)) for i, p in enumerate(payloads)]
    return netflow.decode_templated(spark.createDataFrame(rows, "exporter long, seq long, arrival_time timestamp, payload binary"))


def test_templates_as_of(spark):
    got = decode(spark, [v9((256, DATA)), v9((0, TEMPLATE)), v9((256, DATA + DATA)), v9((1, OPTIONS)), v9((257, struct.pack(">II", 0, 512))), v9((256, DATA))]).collect()
    assert len(got) == 3 and {r["src_ip"] for r in got} == {0x0A000001}
    assert sorted(r["sample_ratio"] for r in got) == [1, 1, 512]


def test_bidirectional_and_ports():
    rows = list(netflow.to_rows({"src_ip": 1, "dst_ip": 2, "length": 0, "number_of_packets": 0, "_flow_id": 9, "_fwd_bytes": 10, "_rev_bytes": 20, "_fwd_packets": 1, "_rev_packets": 2}, AT, 0))
    assert [(r["src_ip"], r["length"], r["number_of_packets"]) for r in rows] == [(1, 10, 1), (2, 20, 2)]
    assert next(netflow.to_rows({"protocol": 1, "source_port": 5, "length": 1, "number_of_packets": 1}, AT, 0))["source_port"] == 0
    assert not list(netflow.to_rows({"_nat": 1}, AT, 0))


def test_ipfix_variable_length():
    fields = [(82, 65535), (8, 4)]
    for name in (b"abc", b"x" * 300):
        head = bytes([len(name)]) if len(name) < 255 else b"\xff" + struct.pack(">H", len(name))
        values, end = netflow.record(fields, head + name + struct.pack(">I", 7), 0, True)
        assert values["src_ip"] == 7 and end == len(head) + len(name) + 4
    assert netflow.record(fields, b"\x05ab", 0, True) is None
    assert netflow.options_rate({"_packet_space": 999, "_packet_interval": 1, "_algorithm": 1}) == 1000


def ether(kind, body, tags=()):
    return b"\1" * 6 + b"\2" * 6 + b"".join(struct.pack(">HH", 0x8100, t) for t in tags) + struct.pack(">H", kind) + body


def ip4(proto, body, fragment=0):
    return struct.pack(">BBHHHBBHII", 0x45, 0, 20 + len(body), 0, fragment, 64, proto, 0, 0x0A000001, 0xCB007101) + body


TCP = struct.pack(">HHIIBBHHH", 1000, 80, 1, 0, 80, 2, 100, 0, 0)


def parse(data):
    row = {}
    return frames.ethernet(data, row), row


def test_frames():
    status, row = parse(ether(0x0800, ip4(6, TCP), (100, 200)))
    assert status == "success" and row["flags"] == 2 and row["vlan"] == 100 and row["destination_port"] == 80
    assert parse(ether(0x0800, ip4(17, struct.pack(">HHHH", 1, 2, 8, 0))))[1]["source_port"] == 1
    assert parse(ether(0x0800, ip4(1, b"\x08\0")))[1]["icmp_type"] == 8
    status, row = parse(ether(0x0800, ip4(6, b"", 0x2001)))
    assert status == "success" and row["ip_fragmented"] and "source_port" not in row
    assert parse(ether(0x0806, b""))[0] == "arp" and parse(b"")[0] == "memory_violation"
    status, row = parse(ether(0x0800, ip4(6, TCP[:6])))
    assert status == "memory_violation" and row["source_port"] == 1000
    v6 = struct.pack(">IHBB", 6 << 28, 8, 44, 64) + b"\x20" * 32
    status, row = parse(ether(0x86DD, v6))
    assert status == "success" and row["ip_fragmented"] and row["ip_protocol_version"] == 6


def test_sflow():
    frame = ether(0x0800, ip4(6, TCP))
    raw = struct.pack(">IIII", 1, 1500, 0, len(frame)) + frame
    for port, status in ((3, "unknown"), (1 << 30, "dropped")):
        sample = struct.pack(">IIIIIII", 1, 0, 512, 0, 0, 5, port) + struct.pack(">I", 1) + struct.pack(">II", 1, len(raw)) + raw
        data = struct.pack(">III", 5, 1, 0x0A0A0A0A) + struct.pack(">III", 0, 0, 0) + struct.pack(">I", 1) + struct.pack(">II", 1, len(sample)) + sample
        (row,) = netflow.sflow5(data, AT)
        assert row["sample_ratio"] == 512 and row["length"] == 1500 and row["forwarding_status"] == status and row["destination_port"] == 80
    assert not list(netflow.sflow5(b"\0" * 40, AT))


def test_pcap(spark, tmp_path):
    frame = ether(0x0800, ip4(6, TCP))
    (tmp_path / "a.pcap").write_bytes(struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + 3 * (struct.pack("<IIII", 5, 0, len(frame), len(frame)) + frame))
    flows = frames.frames_to_flows(plugin.read_pcap(spark, str(tmp_path)))
    assert [(r["status"], r["n"]) for r in frames.status_counts(flows).collect()] == [("success", 3)]


def test_rules_and_config(spark, tmp_path):
    assert [rules.parse(r) is not None for r in fixtures.RULES] == [True] * 5 + [False, False]
    assert rules.parse("no json") is None and rules.parse('{"action_type": "redirect"}') is None
    assert config.settings("# a\nx = 1\nbad\n y=2 ") == {"x": "1", "y": "2"}
    (tmp_path / "nets").write_text("10.1.2.3/24\n# no\n2001:db8::/32\n10.0.0.0/33\n")
    assert [tuple(r) for r in config.prefixes(spark, str(tmp_path)).collect()] == [(0x0A010200, 24)]
    assert [r["len"] for r in config.prefixes6(spark, str(tmp_path)).collect()] == [32]


def test_pcap_ranges(tmp_path):
    """Each record is read in the range where it begins, wherever ranges are cut and whatever frames hold."""
    from pyarrow import fs

    rng = random.Random(5)
    packets = [(1_700_000_000 + i * 0.25, bytes(rng.choice((0, rng.randrange(256))) for _ in range(rng.randrange(14, 400)))) for i in range(600)]
    path = tmp_path / "a.pcap"
    for data, want in ((frames.pcap_bytes(packets), packets), (frames.pcap_bytes(packets)[:-5], packets[:-1])):
        path.write_bytes(data)
        with fs.LocalFileSystem().open_input_file(str(path)) as file:
            capture = plugin.Capture(file)
            for step in (997, 20_000, len(data) + 1):
                assert [r for a in range(0, len(data), step) for r in capture.records(a, a + step, 4096)] == want
    path.write_bytes(b"no capture at all, whatever its name says")
    with fs.LocalFileSystem().open_input_file(str(path)) as file:
        assert not plugin.Capture(file).ok


def test_other_findings():
    """Counter samples are noted; a ratio of one is a ratio; padding and too many records are anomalies."""
    counter = struct.pack(">III", 0, 0, 1) + struct.pack(">II", 1, 4) + b"abcd"
    body = struct.pack(">IIIIIII", 5, 1, 1, 0, 0, 0, 1) + struct.pack(">II", 2, len(counter)) + counter
    notes = []
    assert not list(netflow.sflow5(body + b"\0\0", AT, notes)) and notes == ["total_packets", "counter_sample", "generic_interface_counter_sample", "with_padding_at_the_end_of_packet"]
    frame = ether(0x0800, ip4(6, TCP))
    row = next(netflow.to_rows({"_frame": frame, "_observed": 5, "_selected": 5, "length": 1}, AT, 0))
    assert row["own_ratio"] == 1 and next(netflow.to_rows({"length": 1}, AT, 0))["own_ratio"] is None
    for body, ipfix, want, seen in ((b"\1\2\3\4" * 3 + b"\0" * 3, True, 3, ["packets_with_padding"]), (b"\1" * 4 * 0x4001, True, 0, []), (b"\1" * 4 * 0x4001, False, 0x4001, [])):
        notes = []
        assert len(list(netflow.records([(8, 4)], body, ipfix, notes))) == want and notes == seen
    notes = []
    assert len(list(netflow.records([(8, 16)], b"\1" * 31, True, notes))) == 1 and notes == ["sets_with_anomaly_padding", "broken_packets"]
    dropped = next(netflow.to_rows({"_next_hop": 0, "length": 1}, AT, 0, drop_without_next_hop=True))
    assert dropped["forwarding_status"] == "dropped" and next(netflow.to_rows({"_next_hop": 0, "length": 1}, AT, 0))["forwarding_status"] == "unknown"


def test_address_helpers():
    from tidegauge.functions import net

    assert net.whole_number(" 12 ") == 12 and net.whole_number("1.5") is None
    assert net.split_url("https://x.example/a?b") == ("https", "x.example", 443, "/a") and net.split_url("http://x:81") == ("http", "x", 81, "/")
    assert net.split_url("ftp://x") is None and net.split_url("http://x:99999") is None


def test_longest_v6_prefix(spark):
    """Lengths that cut words and digits, against the standard library."""
    import ipaddress

    from tidegauge.operators import enrich

    rng = random.Random(6)
    base = 0x20010DB8 << 96
    networks = {(ipaddress.IPv6Network((base | rng.getrandbits(96), n), strict=False)) for n in (0, 1, 31, 33, 47, 64, 65, 96, 97, 127, 128) for _ in range(3)}
    addresses = [base | rng.getrandbits(96) for _ in range(30)] + [int(n.network_address) | (rng.getrandbits(128 - n.prefixlen) if n.prefixlen < 128 else 0) for n in networks] + [2**128 - 1, 0]
    table = spark.createDataFrame([(f"{int(n.network_address):032x}", n.prefixlen) for n in networks], "net string, len int")
    got = enrich.lpm6(spark.createDataFrame([(f"{a:032x}",) for a in addresses], "ip string"), table, "ip", "net", "len").collect()
    for r in got:
        held = [n for n in networks if ipaddress.IPv6Address(int(r["ip"], 16)) in n]
        best = max(held, key=lambda n: n.prefixlen, default=None)
        assert (r["net"], r["len"]) == ((f"{int(best.network_address):032x}", best.prefixlen) if best else (None, None))
