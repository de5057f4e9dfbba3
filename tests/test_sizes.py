"""Decoders and encoders at size: batches that go out are bounded, flow rows are not gathered, and results are those of the row functions."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegauge.plans import wire
from tidegauge.plans.queries import QUERIES
from tidegauge.sources import capnp, encode, frames, netflow

SF = "/root/testdata/sf0.001"


class Caught:
    """Takes the function that a decoder hands to Spark."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.arrow = run
        return self

    def mapInPandas(self, run, _):
        self.pandas = run
        return self

    def largest(self, rows: dict) -> int:
        batch = pa.RecordBatch.from_pydict(rows)
        run, one = (self.arrow, batch) if hasattr(self, "arrow") else (self.pandas, batch.to_pandas())
        sizes = [len(b) for b in run(iter([one]))]
        assert sum(sizes)
        return max(sizes)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


FLOW = {"event_id": 1, "src_ip": 1, "dst_ip": 2, "source_port": 3, "destination_port": 4, "protocol": 6, "length": 5, "number_of_packets": 1, "flags": 2, "src_asn": 1, "dst_asn": 1, "input_interface": 1, "output_interface": 1, "flow_start": 0, "flow_end": 0, "ip_dont_fragment": False, "ip_fragmented": False, "ttl": 64, "vlan": 0, "forwarding_status": "unknown", "sample_ratio": 1}


def test_f1_sflow_rows_leave_in_bounded_batches():
    n = 2000
    caught = netflow.decode_sflow(Caught())
    assert caught.largest({"payload": [encode.sflow([FLOW] * 8, 1)] * n, "arrival_time": [0] * n}) <= 4096


def test_f2_counters_read_data_sets_once(spark):
    text = plan(QUERIES["end_reason_counts"](spark, SF))
    assert text.count("read#") + text.count("read(") == 1


def test_f3_options_need_no_call_for_each_datagram(spark):
    assert "FlatMapGroups" not in plan(QUERIES["exporter_options"](spark, SF))


def test_f4_templates_travel_to_the_data(spark):
    text = plan(QUERIES["netflow9_counters"](spark, SF))
    assert "rightHint=(strategy=broadcast)" in text


def test_f5_sflow_counters_are_counted_in_the_task():
    n = 2000
    assert netflow.sflow_counters.__doc__ and sflow_tally().largest({"payload": [encode.sflow([FLOW] * 8, 1)] * n}) < 10


def sflow_tally():
    caught = Caught()
    caught.groupBy = lambda *_: caught
    caught.agg = lambda *_: caught
    count, total, lit = F.count, F.sum, F.lit
    F.count = F.sum = F.lit = lambda *_: type("C", (), {"alias": lambda self, _: self})()
    try:
        return netflow.sflow_counters(caught)
    finally:
        F.count, F.sum, F.lit = count, total, lit


@pytest.mark.parametrize("kind, per", [("netflow5", 30), ("netflow9", 30), ("ipfix", 30), ("sflow", 8)])
def test_f6_datagrams_are_made_in_batches_and_equal_the_row_functions(spark, kind, per):
    rows = wire.shaped(spark, SF).where("event_id < 400 and event_id % 7 <> 3")
    made = encode.datagrams(rows, kind, per, 11, 512)
    assert "FlatMapGroups" not in plan(made)
    by: dict = {}
    for r in rows.orderBy("event_id").collect():
        by.setdefault(r["event_id"] // per, []).append(r.asDict())
    want = {n: (rs[0]["arrival_time"], encode.netflow5(rs, 100) if kind == "netflow5" else encode.sflow(rs, 3221225985) if kind == "sflow" else getattr(encode, kind)(rs, n == 0, 512 if n == 11 else None)) for n, rs in by.items()}
    assert {r["seq"]: (r["arrival_time"], bytes(r["payload"])) for r in made.collect()} == want


def test_f7_v5_rows_leave_in_bounded_batches():
    n = 2000
    caught = netflow.decode5(Caught())
    assert caught.largest({"payload": [encode.netflow5([FLOW] * 30)] * n, "arrival_time": [0] * n, "exporter": [1] * n}) <= 256 * 30


def test_f7_v5_rows_equal_the_row_function(spark):
    good = encode.netflow5([FLOW | {"protocol": p, "flags": 18} for p in (6, 17, 1, 47)], 7)
    made = [good, good[:100], good[:30], b"", b"\0\5", b"\0\x09" + good[2:], good[:2] + b"\0\x1f" + good[4:], good[:2] + b"\0\0" + good[4:]]
    got = netflow.decode5(spark.createDataFrame([(bytearray(p), None, 5) for p in made], "payload binary, arrival_time timestamp, exporter long"))
    want = [r for p in made if netflow.version(p) == 5 for r in netflow.netflow5(p, None, 5)]
    assert sorted(map(repr, (r.asDict() for r in got.collect()))) == sorted(map(repr, want))


def test_f8_flow_rows_are_not_gathered_by_exporter(spark):
    for name in ("decode_netflow9", "decode_ipfix"):
        df = QUERIES[name](spark, SF)
        windows = [line for line in plan(df).splitlines() if " Window " in line]
        assert windows and not any("src_ip" in line for line in windows)


def test_f8_rates_as_of_over_ranges(spark):
    from tidegauge.sources.templates import rate_as_of

    said = [(1, 15, 0, 7), (1, 25, 0, 7), (1, 41, 0, 8), (1, 41, 1, 9), (2, 1, 0, 3)]
    packets = spark.createDataFrame([(e, s) for e in (1, 2, 3) for s in range(60)], "exporter long, seq long")
    got = rate_as_of(packets, spark.createDataFrame(said, "exporter long, seq long, record int, announced long"), packets, "rate", 10)
    last = lambda e, s: next((v for x, at, _, v in reversed(said) if x == e and at <= s), None)
    assert sorted((r["exporter"], r["seq"], r["rate"] or -1) for r in got.collect()) == sorted((e, s, last(e, s) or -1) for e in (1, 2, 3) for s in range(60))


def test_f9_no_call_for_each_datagram(spark):
    assert "FlatMapGroups" not in plan(QUERIES["netflow5_counters"](spark, SF))


def test_f10_plain_templates_unpack_as_others_do():
    fields = [(8, 4), (7, 2), (89, 1), (999, 3), (1, 8), (85, 4)]
    body = bytes(range(22)) * 3 + b"\0\0"
    notes: list = []
    got = list(netflow.records(fields, body, False, notes))
    assert got == [netflow.record(fields, body, 22 * i, False)[0] for i in range(3)] and not notes
    assert netflow._plain(tuple(fields)) is not None and netflow._plain(((27, 16),)) is None


def test_f11_capnp_rows_and_blobs_are_bounded():
    n = 9000
    content = capnp.struct.pack("<Q", len(m := capnp.encode(FLOW))) + m
    assert capnp.read_blobs(Caught(), "content").largest({"content": [content * n]}) <= 4096


def test_f12_frames_leave_in_bounded_batches():
    n = 9000
    assert frames.frames_to_flows(Caught()).largest({"arrival_time": [0] * n, "frame": [encode.frame(FLOW)] * n}) <= 4096
