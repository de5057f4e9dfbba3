"""FlowSpec bytes round trip."""

import pytest
from tidegauge.operators import rules
from tidegauge.sources import fixtures, flowspec


def test_round_trip():
    for line in fixtures.RULES[:5]:
        rule = rules.parse(line)
        back = flowspec.decode(flowspec.encode(rule), rule.action_type)
        for name in ("source_prefix", "destination_prefix", "protocols", "source_ports", "destination_ports", "tcp_flags", "packet_lengths", "fragmentation_flags"):
            assert getattr(back, name) == getattr(rule, name)


def test_known_bytes():
    rule = rules.parse('{"destination_prefix": "192.0.2.0/24", "protocols": ["tcp"], "destination_ports": [25, 8080], "action_type": "discard"}')
    assert flowspec.encode(rule).hex() == "0e" + "0118c00002" + "038106" + "050119911f90"
    assert flowspec.decode(flowspec.encode(rule)).destination_ports == [25, 8080]


def test_cut_off():
    data = flowspec.encode(rules.parse(fixtures.RULES[0]))
    for n in range(1, len(data)):
        with pytest.raises((ValueError, IndexError)):
            flowspec.decode(data[:n])


def test_frame(spark):
    got = flowspec.encoded(spark.createDataFrame([(r,) for r in fixtures.RULES], "rule string")).collect()
    assert [r["nlri"] is None for r in got] == [False] * 5 + [True, True]
