"""Flow rows, measure names and default settings."""

from __future__ import annotations

#: Flow columns with Spark types and the value of an absent column. IPv4 addresses are host-order longs.
FLOW = [
    ("arrival_time", "timestamp", None), ("ip_protocol_version", "int", 4), ("src_ip", "long", 0), ("dst_ip", "long", 0),
    ("src_ipv6", "string", ""), ("dst_ipv6", "string", ""), ("source_mac", "string", ""), ("destination_mac", "string", ""),
    ("source_port", "int", 0), ("destination_port", "int", 0), ("protocol", "int", 0), ("flags", "int", 0), ("ip_fragmented", "boolean", False),
    ("ip_more_fragments", "boolean", False), ("ip_dont_fragment", "boolean", False), ("ip_fragment_offset", "int", 0),
    ("forwarding_status", "string", "unknown"), ("number_of_packets", "long", 1), ("length", "long", 0), ("ip_length", "long", 0),
    ("sample_ratio", "long", 1), ("src_asn", "long", 0), ("dst_asn", "long", 0), ("input_interface", "long", 0), ("output_interface", "long", 0),
    ("vlan", "int", 0), ("ttl", "int", 0), ("icmp_type", "int", 0), ("icmp_code", "int", 0), ("flow_start", "long", 0), ("flow_end", "long", 0), ("agent_ipv4_address", "long", 0),
    ("source", "string", "unknown"), ("src_country", "string", ""), ("dst_country", "string", ""), ("end_reason", "int", 0),
    ("tcp_sequence_number", "long", 0), ("tcp_ack_number", "long", 0), ("tcp_window_size", "int", 0),
]
FLOW_DDL = ", ".join(f"{n} {t}" for n, t, _ in FLOW)
PROTOS = ("total", "tcp", "udp", "icmp", "fragmented", "tcp_syn", "dropped")
MEASURES = [f"{p}_{d}_{u}" for p in PROTOS for d in ("in", "out") for u in ("bytes", "packets")]


EMPTY = {n: v for n, _, v in FLOW}


def flow(**known) -> dict:
    return EMPTY | known if known.keys() <= EMPTY.keys() else {n: known.get(n, v) for n, _, v in FLOW}
