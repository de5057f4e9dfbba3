"""BGP FlowSpec NLRI (RFC 8955): traffic rules to bytes and back, and announcements of rules as a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..operators.rules import FLAGS, PROTOCOLS, Rule

#: Component types of the RFC that rules use.
DESTINATION, SOURCE, PROTOCOL, DESTINATION_PORT, SOURCE_PORT, TCP_FLAGS, LENGTH, FRAGMENT = 1, 2, 3, 5, 6, 9, 10, 12
FRAGMENT_BITS = {"dont-fragment": 1, "is-fragment": 2, "first-fragment": 4, "last-fragment": 8}


def _prefix(text: str) -> bytes:
    host, _, length = text.partition("/")
    octets = bytes(map(int, host.split(".")))
    return bytes([int(length)]) + octets[: (int(length) + 7) // 8]


def _list(values: list[int], operator: int) -> bytes:
    out = b""
    for i, v in enumerate(values):
        size = 1 if v < 256 else 2
        out += bytes([operator | (0x10 if size == 2 else 0) | (0x80 if i == len(values) - 1 else 0)]) + v.to_bytes(size, "big")
    return out


def encode(rule: Rule) -> bytes:
    """Components in ascending type, with the length in front."""
    body = b""
    if rule.destination_prefix:
        body += bytes([DESTINATION]) + _prefix(rule.destination_prefix)
    if rule.source_prefix:
        body += bytes([SOURCE]) + _prefix(rule.source_prefix)
    lists = [(PROTOCOL, [PROTOCOLS[p.lower()] for p in rule.protocols], 1), (DESTINATION_PORT, rule.destination_ports, 1), (SOURCE_PORT, rule.source_ports, 1), (TCP_FLAGS, [sum(FLAGS[x] for x in set(f.split("|"))) for f in rule.tcp_flags], 1), (LENGTH, rule.packet_lengths, 1), (FRAGMENT, [FRAGMENT_BITS[f] for f in rule.fragmentation_flags if f in FRAGMENT_BITS], 1)]
    for kind, values, operator in lists:
        if values:
            body += bytes([kind]) + _list(values, operator)
    return (bytes([len(body)]) if len(body) < 240 else (0xF000 | len(body)).to_bytes(2, "big")) + body


def _read_list(data: bytes, at: int) -> tuple[list[int], int]:
    out = []
    while True:
        if at >= len(data):
            raise ValueError("a list has no end")
        operator = data[at]
        size = 1 << ((operator >> 4) & 3)
        if at + 1 + size > len(data):
            raise ValueError("a value is cut off")
        out.append(int.from_bytes(data[at + 1 : at + 1 + size], "big"))
        at += 1 + size
        if operator & 0x80:
            return out, at


def decode(data: bytes, action_type: str = "discard") -> Rule:
    """The rule of one NLRI; ValueError where it is cut off or has a component that rules lack."""
    at = 1 if data[0] < 240 else 2
    size = data[0] if at == 1 else int.from_bytes(data[:2], "big") & 0xFFF
    if len(data) < at + size:
        raise ValueError("the rule is cut off")
    data, at, rule = data[at : at + size], 0, Rule(action_type)
    protocols, flags, fragments = ({v: k for k, v in t.items()} for t in (PROTOCOLS, FLAGS, FRAGMENT_BITS))
    while at < len(data):
        kind, at = data[at], at + 1
        if kind in (DESTINATION, SOURCE):
            length = data[at]
            n = (length + 7) // 8
            text = ".".join(map(str, data[at + 1 : at + 1 + n].ljust(4, b"\0"))) + f"/{length}"
            setattr(rule, "destination_prefix" if kind == DESTINATION else "source_prefix", text)
            at += 1 + n
            continue
        values, at = _read_list(data, at)
        if kind == PROTOCOL:
            rule.protocols = [protocols[v] for v in values]
        elif kind == DESTINATION_PORT:
            rule.destination_ports = values
        elif kind == SOURCE_PORT:
            rule.source_ports = values
        elif kind == TCP_FLAGS:
            rule.tcp_flags = ["|".join(flags[b] for b in sorted(flags) if v & b) for v in values]
        elif kind == LENGTH:
            rule.packet_lengths = values
        elif kind == FRAGMENT:
            rule.fragmentation_flags = [fragments[v] for v in values]
        else:
            raise ValueError(f"component {kind}")
    return rule


def encoded(lines: DataFrame) -> DataFrame:
    """lines: rule (JSON). rule, nlri (null where the rule is not valid)."""
    from ..operators.rules import parse

    def run(batches) -> Iterator:
        for b in batches:
            yield b.assign(nlri=[encode(r) if (r := parse(x or "")) else None for x in b["rule"]])

    return lines.select("rule").mapInPandas(run, "rule string, nlri binary")
