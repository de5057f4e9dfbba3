"""BGP messages, Cap'n Proto rows, pcap files and attack texts: round trips and fixed bytes."""

import datetime
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.operators import report
from tidegauge.schema import FLOW_DDL, flow
from tidegauge.sources import bgp, capnp, frames

AT = datetime.datetime(2024, 1, 1, 12, 0, 1, 250000)


def test_update_of_ipv4():
    m = bgp.encode(["10.0.0.0/23", "203.0.113.7/32"], ["192.0.2.0/24"], "192.0.2.1", "incomplete", [64500, 4200000000], 5, 100, ["65001:666"])
    got = bgp.decode(m)
    assert got["announced"] == ["10.0.0.0/23", "203.0.113.7/32"] and got["withdrawn"] == ["192.0.2.0/24"]
    assert (got["next_hop"], got["origin"], got["as_path"], got["med"], got["local_pref"], got["communities"]) == ("192.0.2.1", "incomplete", [64500, 4200000000], 5, 100, ["65001:666"])
    assert bgp.encode(withdraw=["10.0.0.0/8"]) == b"\xff" * 16 + bytes.fromhex("0019" "02" "0002" "080a" "0000")
    with pytest.raises(ValueError):
        bgp.encode(["10.0.0.0/8", "2001:db8::/32"], next_hop="10.0.0.1")


def test_update_of_ipv6():
    got = bgp.decode(bgp.encode(["2001:db8::/33"], ["2001:db8:1::/48"], "2001:db8::1"))
    assert (got["announced"], got["withdrawn"], got["next_hop"]) == (["2001:db8::/33"], ["2001:db8:1::/48"], "2001:db8::1")


def test_prefix_bits_beyond_the_length_are_cleared():
    assert bgp.read_prefixes(bytes([9, 10, 255])) == ["10.128.0.0/9"] and bgp.read_prefixes(bytes([0])) == ["0.0.0.0/0"]
    for bad in (bytes([33, 1, 2, 3, 4, 5]), bytes([24, 1, 2])):
        with pytest.raises(ValueError):
            bgp.read_prefixes(bad)


def test_extended_communities():
    assert bgp.extended_community(struct.pack(">HHf", 0x8006, 0, 1024.0)) == "rate-limit 1024"
    assert bgp.extended_community(struct.pack(">HHI", 0x8008, 65001, 7)) == "redirect 65001:7"
    assert bgp.extended_community(bytes.fromhex("800900000000002e")) == "mark 46"


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60), st.integers(0, 80))
def test_broken_updates_raise_only_value_errors(noise, at):
    m = bytearray(bgp.encode(["10.0.0.0/23"], next_hop="192.0.2.1", communities=["1:2"]))
    m[at:at] = noise
    for data in (bytes(m), bytes(m[:at]), bgp.MARKER + struct.pack(">HB", 19 + len(noise), 2) + noise):
        try:
            bgp.decode(data)
        except ValueError:
            pass


def test_bgp_frames(spark):
    sent = bgp.updates(spark.createDataFrame([("10.0.0.5/32",), ("10.0.0.0/24",)], "prefix string"), "192.0.2.1", ["65001:666"])
    got = bgp.decoded(sent.unionByName(spark.createDataFrame([("-", b"x"), ("-", None)], "prefix string, message binary"))).collect()
    assert sorted(r["announced"][0] for r in got if r["error"] is None) == ["10.0.0.0/24", "10.0.0.5/32"]
    assert sum(r["error"] is not None for r in got) == 2


ROW = flow(arrival_time=AT, src_ip=0x0A000001, dst_ip=0xCB007101, source_port=1234, destination_port=80, protocol=6, flags=18, ip_fragmented=True, length=1500, ip_length=1480, number_of_packets=3, sample_ratio=1000, src_asn=64500, dst_asn=4200000000, ttl=64, source="netflow", source_mac="02:00:00:00:00:01")


def test_rows_layout():
    offsets = {n: at for n, (at, _) in capnp.NUMBERS.items()}
    assert (offsets["sample_ratio"], offsets["source_port"], offsets["ip_dont_fragment"], offsets["direction"], offsets["ip_length"]) == (32, 256, 449, 456, 704)
    assert capnp.WORDS == 12 and len(capnp.BLOBS) == 4


def test_rows_round_trip():
    assert capnp.decode(capnp.encode(ROW)) == ROW
    six = ROW | {"ip_protocol_version": 6, "src_ip": 0, "dst_ip": 0, "src_ipv6": "20010db8" + "0" * 23 + "1", "dst_ipv6": "f" * 32, "destination_mac": "02:00:00:00:00:02"}
    assert capnp.decode(capnp.encode(six)) == six
    stream = b"".join(struct.pack("<Q", len(m)) + m for m in map(capnp.encode, (ROW, six)))
    assert len(list(capnp.messages(stream))) == 2 and len(list(capnp.messages(stream[:-1]))) == 1 and not list(capnp.messages(b""))


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=200), st.integers(0, 200))
def test_broken_rows_raise_only_value_errors(noise, at):
    whole = bytearray(capnp.encode(ROW))
    whole[at : at + len(noise)] = noise
    for data in (bytes(whole), noise):
        try:
            capnp.decode(data)
        except (ValueError, OverflowError):
            pass


def test_rows_through_files(spark, tmp_path):
    flows = spark.createDataFrame([tuple(ROW.values()), tuple((ROW | {"src_ip": 5, "arrival_time": None}).values())], FLOW_DDL)
    content = b"".join(bytes(r[0]) for r in capnp.write_blobs(flows).collect())
    (tmp_path / "rows.bin").write_bytes(content + struct.pack("<Q", 16) + b"\xff" * 16)
    back = capnp.read_files(spark, str(tmp_path)).orderBy("src_ip").collect()
    assert [r["src_ip"] for r in back] == [5, ROW["src_ip"]] and back[1].asDict() == ROW
    assert capnp.read_blobs(spark.createDataFrame([], "content binary")).count() == 0


def test_pcap_round_trip():
    packets = [(1700000000.25, b"a" * 60), (1700000001.0, b"b" * 100)]
    assert list(frames.pcap(frames.pcap_bytes(packets))) == packets
    assert [len(f) for _, f in frames.pcap(frames.pcap_bytes(packets, 64))] == [60, 64]


def test_attack_text_and_files(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidegauge.plans import sinks

    one = spark.createDataFrame([(0x0A000001, "udp_flood", 9, "incoming", "udp", 2_000_000)], "host long, attack_type string, attack_power long, attack_direction string, attack_protocol string, total_in_bytes long")
    name, text = sinks.attack_files(one, F.lit(AT)).first()
    assert name == "10.0.0.1_01_01_24_12:00:01.txt"
    assert text == "Attack type: udp_flood\nInitial attack power: 9 packets per second\nAttack direction: incoming\nAttack protocol: udp\nTotal incoming traffic: 16 mbps\n"
    sinks.write_attacks(one, F.lit(AT), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).where("value = 'Attack type: udp_flood'").count() == 1
    assert len(report.attack_fields()) == 30
