"""Traffic rules: one JSON document a line, compiled to one boolean Column."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = {"fin": 1, "syn": 2, "rst": 4, "push": 8, "ack": 16, "urgent": 32}
FRAGMENTS = ("dont-fragment", "is-fragment", "first-fragment", "last-fragment", "not-a-fragment")
ACTIONS = ("accept", "discard", "rate-limit", "redirect", "mark")
PROTOCOLS = {"icmp": 1, "igmp": 2, "tcp": 6, "udp": 17, "gre": 47, "esp": 50, "ah": 51, "icmpv6": 58, "ospf": 89, "sctp": 132}


@dataclass
class Rule:
    """action_type is mandatory; asns, interfaces, ttls, next hops and agents are kept but never matched."""

    action_type: str
    action: dict = field(default_factory=dict)
    source_ports: list = field(default_factory=list)
    destination_ports: list = field(default_factory=list)
    protocols: list = field(default_factory=list)
    source_prefix: str | None = None
    destination_prefix: str | None = None
    fragmentation_flags: list = field(default_factory=list)
    tcp_flags: list = field(default_factory=list)
    packet_lengths: list = field(default_factory=list)
    vlans: list = field(default_factory=list)
    kept: dict = field(default_factory=dict)


def _prefix(text: str) -> tuple[int, int] | str:
    host, _, length = text.partition("/")
    if ":" in host:
        import ipaddress

        return ipaddress.IPv6Address(host).exploded.replace(":", "") if int(length) == 128 else ""
    a, b, c, d = map(int, host.split("."))
    size = 1 << (32 - int(length))
    ip = (a << 24) + (b << 16) + (c << 8) + d
    return ip - ip % size, size


def parse(line: str) -> Rule | None:
    """The rule, or None where it is not valid."""
    try:
        doc = json.loads(line)
        rule = Rule(doc.pop("action_type"), doc.pop("action", {}))
        ok = rule.action_type in ACTIONS
        if rule.action_type == "rate-limit":
            ok &= rule.action.get("rate", -1) >= 0
        if rule.action_type == "redirect":
            ok &= {"redirect_target_as", "redirect_target_value"} <= set(rule.action)
        for key, value in doc.items():
            if key in Rule.__dataclass_fields__ and key not in ("kept", "action_type", "action"):
                setattr(rule, key, value)
            else:
                rule.kept[key] = value
        ok &= all(0 <= p <= 65535 for p in [*rule.source_ports, *rule.destination_ports])
        ok &= all(0 <= n <= 1500 for n in rule.packet_lengths)
        ok &= all(p.lower() in PROTOCOLS for p in rule.protocols)
        ok &= all(f in FRAGMENTS for f in rule.fragmentation_flags)
        ok &= all(set(f.split("|")) <= set(FLAGS) for f in rule.tcp_flags)
        for p in (rule.source_prefix, rule.destination_prefix):
            if p is not None:
                _prefix(p)
        return rule if ok else None
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


def _within(prefix: str, v4: str, v6: str) -> Column:
    found = _prefix(prefix)
    if isinstance(found, str):
        return F.col(v6) == found if found else F.lit(False)
    return (F.col(v4) >= found[0]) & (F.col(v4) < found[0] + found[1])


def predicate(rule: Rule, v6_columns: bool = False) -> Column:
    """True where a row matches every list that the rule has."""
    parts = [F.lit(True)]
    for name, values in (("source_port", rule.source_ports), ("destination_port", rule.destination_ports), ("vlan", rule.vlans)):
        if values:
            parts.append(F.col(name).isin(*values))
    if rule.protocols:
        parts.append(F.col("protocol").isin(*[PROTOCOLS[p.lower()] for p in rule.protocols]))
    if rule.source_prefix:
        parts.append(_within(rule.source_prefix, "src_ip", "src_ipv6") if v6_columns or ":" not in rule.source_prefix else F.lit(False))
    if rule.destination_prefix:
        parts.append(_within(rule.destination_prefix, "dst_ip", "dst_ipv6") if v6_columns or ":" not in rule.destination_prefix else F.lit(False))
    if rule.fragmentation_flags:
        have = {"dont-fragment": F.col("ip_dont_fragment"), "is-fragment": F.col("ip_fragmented")}
        parts.append(reduce(lambda a, b: a | b, [have.get(f, F.lit(False)) for f in rule.fragmentation_flags]))
    if rule.tcp_flags:
        masks = [sum(FLAGS[x] for x in set(f.split("|"))) for f in rule.tcp_flags]
        parts.append(F.col("flags").bitwiseAND(63).isin(*masks))
    if rule.packet_lengths:
        parts.append((F.col("length") <= 65635) & ((F.col("length") % 65536).isin(*rule.packet_lengths) | (F.col("ip_length") % 65536).isin(*rule.packet_lengths)))
    return reduce(lambda a, b: a & b, parts)


def any_of(lines: list[str]) -> Column:
    """True where any valid rule of the lines matches."""
    valid = [r for r in map(parse, lines) if r]
    return reduce(lambda a, b: a | b, [predicate(r) for r in valid], F.lit(False))
