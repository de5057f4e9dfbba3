"""Queries of the decoders: flow rows go out as datagrams or frames and come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import net
from ..operators import counters
from ..sources import bgp, capnp, encode, frames, netflow
from ..sources import fixtures as fx
from ..sources.batches import packed, tuples
from .queries import _IP, query

_SHAPED = f"(SELECT event_id, src_ip, dst_ip, source_port, destination_port, protocol, CASE WHEN protocol = 6 THEN flags ELSE 0 END AS flags, number_of_packets, length, src_asn, dst_asn, input_interface, output_interface, flow_end, forwarding_status, ip_fragmented, ip_dont_fragment, vlan, ttl, sample_ratio, event_id % 5 + 1 AS end_reason FROM ({fx.FLOWS}))"
_AT, _RATE = 11, 512


def shaped(spark, sf_dir):
    """Flow rows whose flow_start carries event_id."""
    f = fx.flows(spark, sf_dir)
    return f.withColumns({"flow_start": F.col("event_id"), "end_reason": (F.col("event_id") % 5 + 1).cast("int"), "flags": F.when(F.col("protocol") == 6, F.col("flags")).otherwise(0)})


_BACK = ["src_ip", "dst_ip", "source_port", "destination_port", "protocol", "flags", "number_of_packets", "length", "src_asn", "dst_asn", "input_interface", "output_interface", "flow_end", "sample_ratio"]


@query(f"SELECT event_id, {', '.join(c for c in _BACK if c != 'sample_ratio')}, 100 AS sample_ratio FROM {_SHAPED}")
def decode_netflow5(spark, sf_dir):
    rows = netflow.decode5(encode.datagrams(shaped(spark, sf_dir), "netflow5"))
    return rows.select(F.col("flow_start").alias("event_id"), *_BACK)


# Ports of ICMP are zero; the rate is announced behind the data of datagram 11 and holds from the next on.
_PORTS = "CASE WHEN protocol = 1 THEN 0 ELSE {0} END AS {0}"
_TEMPLATED = [_PORTS.format(c) if c.endswith("_port") else f"CASE WHEN event_id // 30 > {_AT} THEN {_RATE} ELSE 7 END AS sample_ratio" if c == "sample_ratio" else c for c in _BACK]


@query(f"SELECT event_id, {', '.join(_TEMPLATED)}, forwarding_status FROM {_SHAPED}")
def decode_netflow9(spark, sf_dir):
    rows = netflow.decode_templated(encode.datagrams(shaped(spark, sf_dir), "netflow9", 30, _AT, _RATE), default_ratio=7)
    return rows.select(F.col("flow_start").alias("event_id"), *_BACK, "forwarding_status")


@query(f"SELECT event_id, {', '.join(_TEMPLATED)}, end_reason FROM {_SHAPED}")
def decode_ipfix(spark, sf_dir):
    rows = netflow.decode_templated(encode.datagrams(shaped(spark, sf_dir), "ipfix", 30, _AT, _RATE), default_ratio=7)
    return rows.select(F.col("flow_start").alias("event_id"), *_BACK, "end_reason")


_SIZES = "CASE protocol WHEN 6 THEN 40 WHEN 17 THEN 28 ELSE 24 END"


@query(f"SELECT event_id, src_ip, dst_ip, CASE WHEN protocol = 1 THEN 0 ELSE source_port END AS source_port, CASE WHEN protocol = 1 THEN 0 ELSE destination_port END AS destination_port, protocol, flags, length, {_SIZES} AS ip_length, CAST(sample_ratio AS BIGINT) AS sample_ratio, input_interface, CASE WHEN forwarding_status = 'dropped' THEN 'dropped' ELSE 'unknown' END AS forwarding_status FROM {_SHAPED} WHERE protocol = 6")
def decode_sflow(spark, sf_dir):
    """Rows of tcp, whose sequence number carries event_id."""
    rows = netflow.decode_sflow(encode.datagrams(shaped(spark, sf_dir), "sflow", 8)).where("protocol = 6")
    return rows.select(F.col("tcp_sequence_number").alias("event_id"), "src_ip", "dst_ip", "source_port", "destination_port", "protocol", "flags", "length", "ip_length", "sample_ratio", "input_interface", "forwarding_status")


@query(f"SELECT src_ip, dst_ip, protocol, vlan, ttl, ip_dont_fragment, ip_fragmented, {_SIZES} AS ip_length, 'success' AS status, CASE WHEN protocol = 1 THEN 0 ELSE source_port END AS source_port, count(*) AS n FROM {_SHAPED} GROUP BY ALL")
def decode_frames(spark, sf_dir):
    kept = ["event_id", "arrival_time", *encode.FRAME]

    def build(batches):
        rows = (dict(zip(kept, r)) for r in tuples(batches, kept))
        return packed(({"arrival_time": r["arrival_time"], "frame": encode.frame(r)} for r in rows), "arrival_time timestamp, frame binary")

    got = frames.frames_to_flows(shaped(spark, sf_dir).select(*kept).mapInArrow(build, "arrival_time timestamp, frame binary"))
    return got.groupBy("src_ip", "dst_ip", "protocol", "vlan", "ttl", "ip_dont_fragment", "ip_fragmented", "ip_length", "status", "source_port").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT src_ip, dst_ip, source_port, destination_port, protocol, number_of_packets, length, sample_ratio, count(*) AS n FROM {_SHAPED} GROUP BY ALL")
def decode_capnp(spark, sf_dir):
    from ..schema import FLOW

    f = fx.flows(spark, sf_dir)
    absent = {n: F.lit(v).cast(t) for n, t, v in FLOW if n not in f.columns}
    got = capnp.read_blobs(capnp.write_blobs(f.withColumns(absent)))
    return got.groupBy("src_ip", "dst_ip", "source_port", "destination_port", "protocol", "number_of_packets", "length", "sample_ratio").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT {_IP('dst_ip')} || '/32' AS prefix, '192.0.2.1' AS next_hop FROM ({fx.FLOWS})")
def decode_bgp(spark, sf_dir):
    """Every target announced in an UPDATE message and read back."""
    prefixes = fx.flows(spark, sf_dir).select(net.cidr_text(F.col("dst_ip"), F.lit(32)).alias("prefix")).distinct()
    got = bgp.decoded(bgp.updates(prefixes, "192.0.2.1"))
    return got.select(F.explode("announced").alias("prefix"), "next_hop")


@query("SELECT 'ipfix_flows_end_reason_' || CASE event_id % 5 WHEN 0 THEN 'idle_timeout' WHEN 1 THEN 'active_timeout' WHEN 2 THEN 'end_of_flow_timeout' WHEN 3 THEN 'force_end_timeout' ELSE 'lack_of_resource_timeout' END AS name, count(*) AS value FROM events GROUP BY 1")
def end_reason_counts(spark, sf_dir):
    return netflow.decode_counters(encode.datagrams(shaped(spark, sf_dir), "ipfix")).where("name like 'ipfix_flows_end_reason%'")


@query("SELECT src_ip, dst_ip, count(*) AS n FROM (SELECT 3405803776 + i % 200 AS src_ip, 167772160 + i % 512 AS dst_ip FROM (SELECT unnest(range(0, 5000)) AS i)) GROUP BY 1, 2")
def example_source(spark, sf_dir):
    from ..sources.plugin import ExampleSource

    spark.dataSource.register(ExampleSource)
    f = spark.read.format("flows_example").option("rows", 5000).option("tasks", 3).load()
    return f.groupBy("src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("n"))


_LAST = lambda head: f"'{head}duration_' || CASE WHEN d = 0 THEN '0_seconds' WHEN d <= 1 THEN 'less_1_seconds' WHEN d <= 2 THEN 'less_2_seconds' WHEN d <= 3 THEN 'less_3_seconds' WHEN d <= 5 THEN 'less_5_seconds' WHEN d <= 10 THEN 'less_10_seconds' WHEN d <= 15 THEN 'less_15_seconds' WHEN d <= 30 THEN 'less_30_seconds' WHEN d <= 60 THEN 'less_60_seconds' WHEN d <= 90 THEN 'less_90_seconds' WHEN d <= 180 THEN 'less_180_seconds' ELSE 'exceed_180_seconds' END"


@query(
    f"""WITH f AS (SELECT *, CAST(trunc((flow_end - event_id) / 1000.0::DOUBLE) AS BIGINT) AS d, event_id // 30 AS k FROM {_SHAPED}), n AS (SELECT count(DISTINCT k) AS n FROM f)
SELECT 'netflow_ipfix_total_packets' AS name, n AS value FROM n UNION ALL SELECT 'netflow_v9_total_packets', n FROM n UNION ALL SELECT 'netflow_v9_data_packet_number', n FROM n
UNION ALL SELECT 'netflow_v9_data_templates_number', 1 UNION ALL SELECT 'netflow_v9_options_templates_number', 1 UNION ALL SELECT 'netflow_v9_options_packet_number', 1 UNION ALL SELECT 'netflow_v9_custom_sampling_rate_received', 1
UNION ALL SELECT 'netflow_v9_total_flows', count(*) FROM f UNION ALL SELECT 'netflow_v9_total_ipv4_flows', count(*) FROM f UNION ALL SELECT 'netflow_v9_forwarding_status', count(*) FROM f
UNION ALL SELECT {_LAST('netflow_v9_')}, count(*) FROM f GROUP BY 1"""
)
def netflow9_counters(spark, sf_dir):
    return netflow.decode_counters(encode.datagrams(shaped(spark, sf_dir), "netflow9", 30, _AT, _RATE))


@query(f"WITH f AS (SELECT *, CAST(trunc((flow_end - event_id) / 1000.0::DOUBLE) AS BIGINT) AS d FROM {_SHAPED}) SELECT 'netflow_v5_total_flows' AS name, count(*) AS value FROM f UNION ALL SELECT name, count(DISTINCT event_id // 30) FROM f, (VALUES ('netflow_v5_total_packets'), ('netflow_ipfix_total_packets')) t(name) GROUP BY name UNION ALL SELECT 'netflow_v5_duration_' || CASE WHEN d <= 15 THEN 'less_15_seconds' WHEN d <= 30 THEN 'less_30_seconds' WHEN d <= 60 THEN 'less_60_seconds' WHEN d <= 90 THEN 'less_90_seconds' WHEN d <= 180 THEN 'less_180_seconds' ELSE 'exceed_180_seconds' END, count(*) FROM f GROUP BY 1")
def netflow5_counters(spark, sf_dir):
    return netflow.decode_counters(encode.datagrams(shaped(spark, sf_dir), "netflow5"))


@query(f"WITH f AS {_SHAPED}, k AS (SELECT count(DISTINCT event_id // 8) AS n FROM f) SELECT name, n AS value FROM k, (VALUES ('sflow_total_packets'), ('sflow_counter_sample'), ('sflow_generic_interface_counter_sample')) t(name) UNION ALL SELECT name, count(*) FROM f, (VALUES ('sflow_flow_samples'), ('sflow_raw_packet_headers_total')) t(name) GROUP BY name UNION ALL SELECT 'sflow_packets_discarded', count(*) FROM f WHERE forwarding_status = 'dropped'")
def sflow_counters(spark, sf_dir):
    return netflow.sflow_counters(encode.datagrams(shaped(spark, sf_dir), "sflow", 8))


@query(f"SELECT CAST(3221225985 AS BIGINT) AS exporter, CAST({_RATE} AS BIGINT) AS sampling_rate, CAST(max(event_id // 30) FILTER (event_id // 30 = {_AT}) AS BIGINT) AS datagram FROM events")
def exporter_options(spark, sf_dir):
    found = netflow.exporter_options(encode.datagrams(shaped(spark, sf_dir), "netflow9", 30, _AT, _RATE))
    return found.select("exporter", "sampling_rate", F.floor(F.col("seq") / 65536).alias("datagram"))


@query(f"SELECT source, protocol, count(*) AS n FROM (SELECT 'netflow' AS source, protocol FROM {_SHAPED} UNION ALL SELECT 'sflow', protocol FROM {_SHAPED}) GROUP BY ALL")
def union_sources(spark, sf_dir):
    """Rows of two kinds of exporters as one table."""
    rows = shaped(spark, sf_dir)
    both = netflow.decode5(encode.datagrams(rows, "netflow5")).unionByName(netflow.decode_sflow(encode.datagrams(rows, "sflow", 8)))
    return both.groupBy("source", "protocol").agg(F.count(F.lit(1)).alias("n"))
