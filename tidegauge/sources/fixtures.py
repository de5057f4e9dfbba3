"""Flow rows derived from the events table by integer arithmetic, and small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FLOWS = """SELECT event_id, ts AS arrival_time, 4 AS ip_protocol_version,
 CASE WHEN event_id % 10 = 9 THEN 3232235776 + user_id WHEN event_id % 10 = 8 THEN 167772160 + user_id % 256
  WHEN event_id % 5 IN (0, 1) THEN 3405803776 + user_id % 200 ELSE 167772160 + (user_id * 3) % 512 END AS src_ip,
 CASE WHEN event_id % 10 = 9 THEN 3405803776 + user_id % 200 WHEN event_id % 10 = 8 THEN 167772160 + (user_id * 5) % 512
  WHEN event_id % 5 IN (2, 3) THEN 3405803776 + user_id % 200 ELSE 167772160 + (user_id * 7) % 512 END AS dst_ip,
 CAST(1024 + event_id % 50000 AS INT) AS source_port,
 CASE WHEN user_id % 3 = 0 THEN 53 WHEN user_id % 3 = 1 THEN 123 ELSE 443 END AS destination_port,
 CASE event_type WHEN 'click' THEN 6 WHEN 'view' THEN 6 WHEN 'purchase' THEN 1 ELSE 17 END AS protocol,
 CAST(CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 16 + 2 * (user_id % 2) ELSE 0 END AS INT) AS flags,
 (event_type = 'error') AS ip_fragmented, (event_id % 7 = 0) AS ip_dont_fragment,
 CASE event_id % 11 WHEN 0 THEN 'dropped' WHEN 1 THEN 'forwarded' ELSE 'unknown' END AS forwarding_status,
 CAST(round(value * 100) AS BIGINT) AS number_of_packets,
 CAST(round(value * 100) AS BIGINT) * (64 + event_id % 1400) AS length,
 CAST(round(value * 100) AS BIGINT) * (50 + event_id % 1400) AS ip_length,
 CASE WHEN event_id % 4 = 0 THEN 1 ELSE 1000 END AS sample_ratio,
 64500 + user_id % 10 AS src_asn, 64600 + user_id % 7 AS dst_asn, user_id % 4 AS input_interface, event_id % 3 AS output_interface,
 CASE WHEN event_id % 6 = 0 THEN 100 ELSE 0 END AS vlan, 64 AS ttl, CAST(0 AS BIGINT) AS flow_start,
 (event_id * 37) % 200000 AS flow_end, 3221225985 + event_id % 3 AS agent_ipv4_address FROM events"""

NETWORKS = [(167772160, 23), (167772160, 24), (167772416, 25)]
HOSTGROUPS = [(167772160, 24, "servers", 0), (167772416, 26, "never", 1), (167772160, 23, "quiet", 2), (167772160, 24, "late", 3)]
WHITELIST = [(167772160, 29)]
#: group, enable_ban, thresholds (None: the check is off), enable_ban_ipv6
SETTINGS = [("global", True, 60, None, 1, None, 40, 50, None, None, 1, True), ("servers", True, 20, 2, 1, 25, None, 10, 1, None, None, False), ("quiet", False, 1, 1, 1, 1, 1, 1, 1, 1, 1, False)]
CHECK_COLUMNS = ["pps", "mbps", "flows", "tcp_pps", "udp_pps", "icmp_pps", "tcp_mbps", "udp_mbps", "icmp_mbps"]
LENGTHS = ", ".join(map(str, [*range(0, 100), *range(1000, 1501)]))
RULES = [
    '{"destination_ports": [53], "protocols": ["udp"], "action_type": "accept"}',
    '{"source_prefix": "203.0.113.0/26", "tcp_flags": ["syn"], "action_type": "accept"}',
    '{"fragmentation_flags": ["is-fragment"], "vlans": [100], "action_type": "discard"}',
    f'{{"packet_lengths": [{LENGTHS}], "action_type": "rate-limit", "action": {{"rate": 1024}}}}',
    '{"destination_prefix": "10.0.0.5/32", "action_type": "accept"}',
    '{"packet_lengths": [1501], "action_type": "accept"}',
    '{"source_ports": [1024]}',
]
TICK, CONSTANT, SAMPLE, BAN, TOP = 3600, 18000, 20, 7200, 7


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FLOWS.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def dimension(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = dict(c.split() for c in columns.split(", "))
    text = lambda v, k: "CAST(NULL AS " + k + ")" if v is None else f"CAST('{v}' AS {k})"
    body = " UNION ALL ".join("SELECT " + ", ".join(f"{text(v, kinds[n])} AS {n}" for v, n in zip(r, names)) for r in rows)
    return spark.sql(body)


def networks(spark: SparkSession) -> DataFrame:
    return dimension(spark, NETWORKS, "net BIGINT, len INT")


def whitelist(spark: SparkSession) -> DataFrame:
    return dimension(spark, WHITELIST, "net BIGINT, len INT")


def hostgroups(spark: SparkSession) -> DataFrame:
    return dimension(spark, HOSTGROUPS, "net BIGINT, len INT, group STRING, position INT")


def settings(spark: SparkSession) -> DataFrame:
    return dimension(spark, SETTINGS, "group STRING, enable_ban BOOLEAN, " + ", ".join(f"{c} BIGINT" for c in CHECK_COLUMNS) + ", enable_ban_ipv6 BOOLEAN")
