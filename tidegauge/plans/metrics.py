"""Queries of metric tables, their text forms, reports and everything about IPv6 hosts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net
from ..operators import counters, detect, enrich, report, rules
from ..schema import MEASURES, PROTOS
from ..sources import fixtures as fx
from . import sinks
from .queries import _BEST6, _IP, _V6, BASE, CLASSIFIED, DETECTED, EMA_COLUMNS, HOSTS, SESS, SETTINGS, SQL, TICKS, V6_NETS, VERDICT, ban_timeline, conditional, detections, ema_sql, enriched, last_tick, query, tick_table, v6_flows, v6_networks, values

# IPv6: the same rows with mapped addresses; ICMP is 58 there.
_C6 = lambda p: conditional(p).replace("protocol = 1", "protocol = 58") if p == "icmp" else conditional(p)
SUMS6 = ", ".join(f"CAST(sum(CASE WHEN {_C6(p)} AND direction = '{n}' THEN {u} ELSE 0 END) AS BIGINT) AS {p}_{d}_{u}" for p in PROTOS for d, n in (("in", "incoming"), ("out", "outgoing")) for u in ("bytes", "packets"))
BASE6 = f"""WITH flows AS ({fx.FLOWS}), nets AS {values(V6_NETS, "net, len")}, f6 AS (SELECT * REPLACE (CASE protocol WHEN 1 THEN 58 ELSE protocol END AS protocol), {_V6('src_ip')} AS s6, {_V6('dst_ip')} AS d6 FROM flows),
l6 AS (SELECT *, {_BEST6('s6')} AS sl, {_BEST6('d6')} AS dl FROM f6),
e0 AS (SELECT *, CASE WHEN sl IS NOT NULL AND dl IS NOT NULL THEN 'internal' WHEN sl IS NOT NULL THEN 'outgoing' WHEN dl IS NOT NULL THEN 'incoming' ELSE 'other' END AS direction FROM l6),
e1 AS (SELECT *, CASE direction WHEN 'outgoing' THEN s6 WHEN 'incoming' THEN d6 END AS host, CASE direction WHEN 'outgoing' THEN sl WHEN 'incoming' THEN dl END AS subnet_len,
 number_of_packets * sample_ratio AS packets, length * sample_ratio AS bytes, CAST(floor(epoch(arrival_time) / {fx.TICK}) AS BIGINT) AS tick FROM e0),
e AS (SELECT *, (SELECT any_value(net) FROM nets WHERE len = subnet_len AND left(host, len // 4) = left(net, len // 4)) AS subnet_net FROM e1)
"""
TICKS6 = f", ticks AS (SELECT host, tick, {SUMS6} FROM e WHERE host IS NOT NULL GROUP BY host, tick), bounds AS (SELECT min(tick) AS lo, max(tick) AS hi FROM e)"
#: A v6 address as printed: eight groups, the first run of two or more zero groups one colon.
_P6 = lambda c: f"regexp_replace(regexp_replace({c}, '(....)(....)(....)(....)(....)(....)(....)(....)', '\\1:\\2:\\3:\\4:\\5:\\6:\\7:\\8'), '(0000:){{2,}}', ':')"


def enriched6(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = v6_flows(spark, sf_dir).withColumn("protocol", F.when(F.col("protocol") == 1, 58).otherwise(F.col("protocol")))
    return enrich.with_direction(f, v6_networks(spark), v6=True).withColumn("tick", counters.tick_of(fx.TICK))


def ticks6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.by_host(enriched6(spark, sf_dir), ("host", "tick"), v6=True)


@query(BASE6 + TICKS6 + " SELECT * FROM ticks")
def v6_host_counters(spark, sf_dir):
    return ticks6(spark, sf_dir)


@query(BASE6 + "SELECT subnet_net, subnet_len, " + ", ".join(f"CAST(sum(CASE direction WHEN '{n}' THEN {u} ELSE 0 END) AS BIGINT) AS total_{d}_{u}" for d, n in (("in", "incoming"), ("out", "outgoing")) for u in ("bytes", "packets")) + " FROM e WHERE subnet_len IS NOT NULL GROUP BY 1, 2")
def v6_network_counters(spark, sf_dir):
    return counters.by_subnet(enriched6(spark, sf_dir), v6=True)


def v6_averages(spark, sf_dir):
    return counters.ema(ticks6(spark, sf_dir), "host", EMA_COLUMNS, fx.TICK, fx.CONSTANT, last_tick(spark, sf_dir))


@query(BASE6 + TICKS6 + ema_sql(EMA_COLUMNS) + " SELECT host, total_in_packets, total_out_packets, icmp_in_packets, tcp_syn_in_packets FROM ema")
def v6_host_ema(spark, sf_dir):
    return v6_averages(spark, sf_dir).select("host", "total_in_packets", "total_out_packets", "icmp_in_packets", "tcp_syn_in_packets")


_FOUND6 = BASE6 + TICKS6 + ema_sql(EMA_COLUMNS) + SETTINGS + f", hosts AS (SELECT *, 0 AS in_flows, 0 AS out_flows FROM ema), v AS (SELECT hosts.*, 'global' AS host_group, {VERDICT} AS threshold FROM hosts, s WHERE s.grp = 'global' AND s.enable_ban_ipv6), found AS (SELECT * FROM v WHERE threshold IS NOT NULL)"


def v6_detections(spark, sf_dir):
    hosts = v6_averages(spark, sf_dir).withColumns({"in_flows": F.lit(0).cast("long"), "out_flows": F.lit(0).cast("long")})
    return detect.detect_v6(hosts, fx.settings(spark))


@query(_FOUND6 + f" SELECT {_P6('host')} AS ip, host_group, threshold FROM found")
def detect_v6(spark, sf_dir):
    return v6_detections(spark, sf_dir).select(net.v6_text(F.col("host")).alias("ip"), "host_group", "threshold")


@query(_FOUND6 + CLASSIFIED + " SELECT host, attack_direction, x_total AS attack_power FROM c1")
def v6_attack_direction(spark, sf_dir):
    return detect.classified(v6_detections(spark, sf_dir)).select("host", "attack_direction", "attack_power")


_HIT6 = f", hit AS (SELECT host, tick FROM ticks WHERE trunc(total_in_packets / {float(fx.TICK)}) > 30 OR trunc(total_out_packets / {float(fx.TICK)}) > 30)"


@query(f"SELECT prefix, 4 AS version, banned_tick FROM ({SQL['banlist']}) UNION ALL (" + BASE6 + TICKS6 + _HIT6 + f" SELECT {_P6('host')} || '/128', 6, max(tick) FROM hit, bounds WHERE tick = hi GROUP BY host)")
def banlist_both(spark, sf_dir):
    """v4 bans that hold at the last tick, and the v6 hosts over the limit in it as bans of that tick."""
    over = counters.speed(ticks6(spark, sf_dir), ["total_in_packets", "total_out_packets"], fx.TICK).where("total_in_packets > 30 or total_out_packets > 30")
    now = over.where(F.col("tick") == last_tick(spark, sf_dir)).select("host", F.col("tick").alias("banned_tick"))
    return detect.banlist(detect.active_bans(ban_timeline(spark, sf_dir), last_tick(spark, sf_dir)), now)


_ADDRESSES = ["2001:db8::1", "::", "fe80::1:2", "no", "12345::1", "1:2::3::4", "1:2:3:4:5:6:7:8::", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "::ffff:1.2.3.256", ":1::", "1::", "1:2:3:4:5:6:7::", "FE80::A", "1:2:3:4:5:6:7:"]


@query(
    "SELECT * FROM (VALUES ('2001:db8::1', '20010db8000000000000000000000001', '2001:0db8::0001', true), ('::', '00000000000000000000000000000000', ':0000', true), ('fe80::1:2', 'fe800000000000000000000000010002', 'fe80::0001:0002', true), ('no', NULL, NULL, false), ('12345::1', NULL, NULL, false), ('1:2::3::4', NULL, NULL, false), ('1:2:3:4:5:6:7:8::', NULL, NULL, false), ('1:2:3:4:5:6:7:8', '00010002000300040005000600070008', '0001:0002:0003:0004:0005:0006:0007:0008', true), ('::ffff:1.2.3.4', '00000000000000000000ffff01020304', ':ffff:0102:0304', true), ('::ffff:1.2.3.256', NULL, NULL, false), (':1::', NULL, NULL, false), ('1::', '00010000000000000000000000000000', '0001::0000', true), ('1:2:3:4:5:6:7::', '00010002000300040005000600070000', '0001:0002:0003:0004:0005:0006:0007:0000', true), ('FE80::A', 'fe80000000000000000000000000000a', 'fe80::000a', true), ('1:2:3:4:5:6:7:', NULL, NULL, false)) t(text, hex, printed, valid)"
)
def fn_v6_text(spark, sf_dir):
    d = spark.createDataFrame([(a,) for a in _ADDRESSES], "text string")
    h = net.v6_hex(F.col("text"))
    return d.select("text", h.alias("hex"), net.v6_text(h).alias("printed"), net.is_v6_host(F.col("text")).alias("valid"))


@query("SELECT * FROM (VALUES ('2001:db8:ffff::1/34', '20010db8c00000000000000000000000', 34), ('::1/128', '00000000000000000000000000000001', 128), ('1::/0', '00000000000000000000000000000000', 0), ('1::/129', NULL, NULL), ('1::', NULL, NULL), ('x/12', NULL, NULL)) t(text, net, len)")
def fn_v6_prefix(spark, sf_dir):
    d = spark.createDataFrame([(a,) for a in ("2001:db8:ffff::1/34", "::1/128", "1::/0", "1::/129", "1::", "x/12")], "text string")
    return d.withColumn("p", net.v6_prefix(F.col("text"))).select("text", "p.net", "p.len")


@query("SELECT * FROM (VALUES ('10.0.0.1', true, false), ('10.0.0.256', false, false), ('10.1', false, false), ('10.0.0.0/24', false, true), ('10.0.0.0/33', false, false), ('1.2.3.4/0', false, true)) t(text, host, cidr)")
def fn_v4_checks(spark, sf_dir):
    d = spark.createDataFrame([(a,) for a in ("10.0.0.1", "10.0.0.256", "10.1", "10.0.0.0/24", "10.0.0.0/33", "1.2.3.4/0")], "text string")
    return d.select("text", net.is_v4_host(F.col("text")).alias("host"), net.is_cidr(F.col("text")).alias("cidr"))


@query("SELECT threshold, CASE threshold WHEN 'pps' THEN 'packets per second' WHEN 'mbps' THEN 'bytes per second' WHEN 'flows' THEN 'flows per second' WHEN 'udp_mbps' THEN 'udp bytes per second' ELSE 'unknown' END AS text FROM (VALUES ('pps'), ('mbps'), ('flows'), ('udp_mbps'), ('ip_fragments')) t(threshold)")
def fn_threshold_text(spark, sf_dir):
    d = spark.createDataFrame([(x,) for x in ("pps", "mbps", "flows", "udp_mbps", "ip_fragments")], "threshold string")
    return d.select("threshold", detect.threshold_text(F.col("threshold")).alias("text"))


_TARGET6 = "20010db8000000000000" + f"{167772165:012x}"
_RULES6 = [f'{{"destination_prefix": "2001:db8:0:0:0:0:a00:5/128", "action_type": "accept"}}', '{"source_prefix": "2001:db8::/64", "action_type": "accept"}']


@query(f"SELECT event_id FROM (SELECT event_id, {_V6('dst_ip')} AS d FROM ({fx.FLOWS})) WHERE d = '{_TARGET6}'")
def rule_v6_prefix(spark, sf_dir):
    """A /128 matches by equality; other v6 lengths never match."""
    found = [rules.predicate(rules.parse(r), v6_columns=True) for r in _RULES6]
    return v6_flows(spark, sf_dir).where(found[0] | found[1]).select("event_id")


@query(f"SELECT event_id FROM ({fx.FLOWS}) WHERE source_port IN (1024, 1030, 2000) AND src_ip >= 3405803776 AND src_ip < 3405804032")
def rule_source_ports(spark, sf_dir):
    line = '{"source_ports": [1024, 1030, 2000], "source_prefix": "203.0.113.0/24", "action_type": "discard"}'
    return fx.flows(spark, sf_dir).where(rules.any_of([line])).select("event_id")


@query("SELECT * FROM (VALUES (0, 'accept', true), (1, 'accept', true), (2, 'discard', true), (3, 'rate-limit', true), (4, 'accept', true), (5, NULL, false), (6, NULL, false), (7, 'redirect', true), (8, NULL, false), (9, NULL, false), (10, 'mark', true), (11, NULL, false)) t(line, action, valid)")
def rule_actions(spark, sf_dir):
    more = ['{"action_type": "redirect", "action": {"redirect_target_as": 65001, "redirect_target_value": 7}}', '{"action_type": "redirect", "action": {}}', '{"action_type": "rate-limit", "action": {"rate": -1}}', '{"action_type": "mark", "ttls": [3], "asns": [1]}', '{"action_type": "drop"}']
    found = [rules.parse(x) for x in [*fx.RULES, *more]]
    return spark.createDataFrame([(i, r.action_type if r else None, r is not None) for i, r in enumerate(found)], "line int, action string, valid boolean")


# Totals: v4, v6 and both.
def _total_sql(v6: bool) -> str:
    on = _C6 if v6 else conditional
    sums = ", ".join(f"CAST(sum(CASE WHEN {on(p)} THEN {u} ELSE 0 END) AS BIGINT) AS {u if p == 'total' else f'{p}_{u}'}" for p in PROTOS for u in ("packets", "bytes"))
    return f"SELECT tick, direction, {sums} FROM e GROUP BY tick, direction"


def total4(spark, sf_dir):
    e = enriched(spark, sf_dir)
    flows = counters.flow_counts(e).groupBy("tick").agg(F.sum("in_flows").alias("i"), F.sum("out_flows").alias("o"))
    t = counters.totals(e, ("tick",)).join(flows, "tick", "left")
    return t.withColumn("flows", F.coalesce(F.when(F.col("direction") == "incoming", F.col("i")).when(F.col("direction") == "outgoing", F.col("o")), F.lit(0)).cast("long")).drop("i", "o")


def total6(spark, sf_dir):
    return counters.totals(enriched6(spark, sf_dir), ("tick",), v6=True).withColumn("flows", F.lit(0).cast("long"))


_T4 = BASE + SESS + f", t0 AS ({_total_sql(False)}), fs AS (SELECT tick, CAST(sum(in_flows) AS BIGINT) AS i, CAST(sum(out_flows) AS BIGINT) AS o FROM fc GROUP BY tick), t AS (SELECT t0.*, coalesce(CASE direction WHEN 'incoming' THEN i WHEN 'outgoing' THEN o END, 0) AS flows FROM t0 LEFT JOIN fs ON fs.tick = t0.tick)"
_T6 = BASE6 + f", t AS (SELECT *, CAST(0 AS BIGINT) AS flows FROM ({_total_sql(True)}))"
_ALL = [u if p == "total" else f"{p}_{u}" for p in PROTOS for u in ("packets", "bytes")] + ["flows"]
_TB = f"WITH t AS (SELECT tick, direction, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _ALL)} FROM ({_T4} SELECT * FROM t UNION ALL BY NAME ({_T6} SELECT * FROM t)) GROUP BY tick, direction)"
_WHEN = f"CAST(to_timestamp(tick * {fx.TICK}) AT TIME ZONE 'UTC' AS DATE) AS \"metricDate\", to_timestamp(tick * {fx.TICK}) AT TIME ZONE 'UTC' AS \"metricDateTime\""


def _columns(pairs):
    return ", ".join(f"{e} AS {c}" for c, e in pairs)


_TABLE = f" SELECT {_WHEN}, direction, {_columns(sinks.total_columns())}, 1 AS schema_version FROM t"


@query(_T4 + _TABLE)
def total_metrics_ipv4(spark, sf_dir):
    return sinks.total_metrics(total4(spark, sf_dir), fx.TICK)


@query(_T6 + _TABLE)
def total_metrics_ipv6(spark, sf_dir):
    return sinks.total_metrics(total6(spark, sf_dir), fx.TICK)


@query(_TB + _TABLE)
def total_metrics(spark, sf_dir):
    """The sum of both IP versions."""
    return sinks.total_metrics(counters.both_versions(total4(spark, sf_dir), total6(spark, sf_dir)), fx.TICK)


def host_ticks(spark, sf_dir):
    return tick_table(spark, sf_dir).join(counters.flow_counts(enriched(spark, sf_dir)), ["host", "tick"], "left").fillna(0, ["in_flows", "out_flows"])


_H4 = BASE + TICKS + SESS + ", h AS (SELECT t.*, coalesce(in_flows, 0) AS in_flows, coalesce(out_flows, 0) AS out_flows FROM ticks t LEFT JOIN fc ON fc.host = t.host AND fc.tick = t.tick)"
_H6 = BASE6 + TICKS6 + ", h AS (SELECT *, CAST(0 AS BIGINT) AS in_flows, CAST(0 AS BIGINT) AS out_flows FROM ticks)"


@query(_H4 + f" SELECT {_WHEN}, {_IP('host')} AS host, {_columns(sinks.wide_columns())}, 1 AS schema_version FROM h")
def host_metrics(spark, sf_dir):
    return sinks.host_metrics(host_ticks(spark, sf_dir), fx.TICK)


def host_ticks6(spark, sf_dir):
    return ticks6(spark, sf_dir).withColumns({"in_flows": F.lit(0).cast("long"), "out_flows": F.lit(0).cast("long")})


@query(_H6 + f" SELECT {_WHEN}, {_P6('host')} AS host, {_columns(sinks.wide_columns())}, 1 AS schema_version FROM h")
def host_metrics_ipv6(spark, sf_dir):
    return sinks.host_metrics(host_ticks6(spark, sf_dir), fx.TICK, v6=True)


from .queries import SUMS  # noqa: E402

_N4 = BASE + f", n AS (SELECT subnet_net, subnet_len, tick, {SUMS} FROM e WHERE subnet_len IS NOT NULL GROUP BY ALL)"
_N6 = BASE6 + ", n AS (SELECT subnet_net, subnet_len, tick, " + ", ".join(f"CAST(sum(CASE direction WHEN '{n}' THEN {u} ELSE 0 END) AS BIGINT) AS total_{d}_{u}" for d, n in (("in", "incoming"), ("out", "outgoing")) for u in ("bytes", "packets")) + ", " + ", ".join(f"CAST(0 AS BIGINT) AS {m}" for m in MEASURES if not m.startswith("total_")) + " FROM e WHERE subnet_len IS NOT NULL GROUP BY subnet_net, subnet_len, tick)"


@query(_N4 + f" SELECT {_WHEN}, {_IP('subnet_net')} || '/' || subnet_len AS network, {_columns(sinks.wide_columns(False))}, 1 AS schema_version FROM n")
def network_metrics(spark, sf_dir):
    return sinks.network_metrics(counters.by_subnet(enriched(spark, sf_dir), ("tick",)), fx.TICK)


@query(_N6 + f" SELECT {_WHEN}, {_P6('subnet_net')} || '/' || subnet_len AS network, {_columns(sinks.wide_columns(False))}, 1 AS schema_version FROM n")
def network_metrics_ipv6(spark, sf_dir):
    return sinks.network_metrics(counters.by_subnet(enriched6(spark, sf_dir), ("tick",), v6=True), fx.TICK, v6=True)


# Text forms: one line for each row of a table, fields in order of name.
def _line_sql(name: str, tag: str, table: str, columns: list[str]) -> str:
    fields = " || ',' || ".join(f"'{c}=' || {c}" for c in sorted(columns))
    return f"SELECT '{name},{tag}=' || {tag} || ' ' || {fields} || ' ' || epoch_ns(\"metricDateTime\") AS line FROM ({table})"


_TOTAL = [c for c, _ in sinks.total_columns()]
for _name, _tag, _build, _cols, _skip in [
    ("total_traffic", "direction", total_metrics_ipv4, _TOTAL, ()),
    ("total_traffic_ipv6", "direction", total_metrics_ipv6, [c for c in _TOTAL if c != "flows"], ("flows",)),
    ("hosts_traffic", "host", host_metrics, [c for c, _ in sinks.wide_columns()], ()),
    ("hosts_ipv6_traffic", "host", host_metrics_ipv6, [c for c, _ in sinks.wide_columns(False)], ("flows_incoming", "flows_outgoing")),
    ("networks_traffic", "network", network_metrics, [c for c, _ in sinks.wide_columns(False)], ()),
    ("networks_ipv6_traffic", "network", network_metrics_ipv6, [c for c, _ in sinks.wide_columns(False)], ()),
]:

    def _lines(spark, sf_dir, build=_build, name=_name, tag=_tag, skip=_skip):
        return sinks.measurement(build(spark, sf_dir), name, tag, skip)

    _lines.__name__ = f"lines_{_name}"
    query(_line_sql(_name, _tag, SQL[_build.__name__], _cols))(_lines)


def _path_sql(kind: str, label: str, table: str, columns: dict[str, str], zeros: bool) -> str:
    return " UNION ALL ".join(f"SELECT 'tidegauge.{kind}.' || replace(replace({label}, '.', '_'), '/', '_') || '.{p} ' || {c} || ' ' || CAST(epoch(\"metricDateTime\") AS BIGINT) AS line FROM t" + ("" if zeros else f" WHERE {c} <> 0") for c, p in columns.items()).join((f"WITH t AS ({table}) ", ""))


_SIDES = {"packets_incoming": "incoming.pps", "bits_incoming": "incoming.bps", "packets_outgoing": "outgoing.pps", "bits_outgoing": "outgoing.bps"}
for _kind, _label, _build, _cols, _zeros in [
    ("hosts", "host", host_metrics, _SIDES | {"flows_incoming": "incoming.flows", "flows_outgoing": "outgoing.flows"}, False),
    ("networks", "network", network_metrics, _SIDES, True),
    ("total", "direction", total_metrics_ipv4, {"packets": "pps", "bits": "bps"}, True),
]:

    def _paths(spark, sf_dir, build=_build, kind=_kind, label=_label, columns=_cols, zeros=_zeros):
        return sinks.paths(build(spark, sf_dir), "tidegauge", kind, label, columns, zeros)

    _paths.__name__ = f"paths_{_kind}"
    query(_path_sql(_kind, _label, SQL[_build.__name__], _cols, _zeros))(_paths)


@query(f"WITH t AS ({SQL['total_metrics_ipv4']}) SELECT 'tidegauge.total.' || direction || '.flows ' || flows || ' ' || CAST(epoch(\"metricDateTime\") AS BIGINT) AS line FROM t WHERE direction IN ('incoming', 'outgoing')")
def paths_total_flows(spark, sf_dir):
    return sinks.paths(total_metrics_ipv4(spark, sf_dir).where("direction in ('incoming', 'outgoing')"), "tidegauge", "total", "direction", {"flows": "flows"}, zeros=True)


_SUM4 = f"WITH t AS (SELECT direction, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _ALL)} FROM ({_T4} SELECT * FROM t) GROUP BY direction)"


def _sum(frame: DataFrame) -> DataFrame:
    return frame.groupBy("direction").agg(*[F.sum(c).alias(c) for c in _ALL])


@query(_SUM4 + "".join(f"{u} SELECT 'tidegauge_total_traffic_{n}{{traffic_direction=\"' || direction || '\",protocol_version=\"ipv4\"}} ' || {e} AS line FROM t{w}" for u, n, e, w in (("", "packets", "packets", ""), (" UNION ALL", "bits", "bytes * 8", ""), (" UNION ALL", "flows", "flows", " WHERE direction IN ('incoming', 'outgoing')"))))
def prometheus_ipv4(spark, sf_dir):
    return report.prometheus(_sum(total4(spark, sf_dir)))


@query(f"WITH t AS (SELECT direction, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes FROM ({_T6} SELECT * FROM t) GROUP BY direction)" + "".join(f"{u} SELECT 'tidegauge_total_traffic_{n}{{traffic_direction=\"' || direction || '\",protocol_version=\"ipv6\"}} ' || {e} AS line FROM t" for u, n, e in (("", "packets", "packets"), (" UNION ALL", "bits", "bytes * 8"))))
def prometheus_ipv6(spark, sf_dir):
    return report.prometheus(_sum(total6(spark, sf_dir)), "ipv6")


_KINDS = [("packets", "packets", "pps", ""), ("bits", "bytes * 8", "bps", ""), ("flows", "flows", "flows", " WHERE direction IN ('incoming', 'outgoing')")] + [x for p in PROTOS[1:] for x in ((f"{p} packets", f"{p}_packets", "pps", ""), (f"{p} bits", f"{p}_bytes * 8", "bps", ""))]


@query(_SUM4 + " UNION ALL".join(f" SELECT direction || ' {n}' AS name, CAST({e} AS BIGINT) AS value, '{u}' AS unit FROM t{w}" for n, e, u, w in _KINDS))
def api_total_counters(spark, sf_dir):
    return report.long_counters(_sum(total4(spark, sf_dir)))


@query(f"WITH t AS (SELECT direction, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes FROM ({_T6} SELECT * FROM t) GROUP BY direction) SELECT direction || ' packets' AS name, packets AS value, 'pps' AS unit FROM t UNION ALL SELECT direction || ' bits', CAST(trunc(bytes / 1000.0::DOUBLE / 1000.0::DOUBLE * 8) AS BIGINT), 'mbps' FROM t")
def api_total_counters_v6(spark, sf_dir):
    return report.long_counters(_sum(total6(spark, sf_dir)).select("direction", "packets", "bytes"), "mbps")


# Documents.
def _pairs(keys: dict[str, str]) -> str:
    """The inside of a JSON object from SQL texts, keys in order."""
    return " || ',' || ".join(f"'\"{k}\":' || {keys[k]}" for k in sorted(keys))


_PROTO = "CASE protocol WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' ELSE 'unknown' END"
_FLAGS = "coalesce(nullif(concat_ws(',', CASE WHEN flags & 2 <> 0 THEN 'syn' END, CASE WHEN flags & 16 <> 0 THEN 'ack' END), ''), '-')"
_Q = lambda e: f"'\"' || {e} || '\"'"
_ROW = {"timestamp": "CAST(floor(epoch(arrival_time)) AS BIGINT)", "ip_version": _Q("'ipv4'"), "source_ip": _Q(_IP("src_ip")), "destination_ip": _Q(_IP("dst_ip")), "source_asn": "src_asn", "destination_asn": "dst_asn", "source_country": _Q("''"), "destination_country": _Q("''"), "input_interface": "input_interface", "output_interface": "output_interface", "agent_address": _Q(_IP("agent_ipv4_address")), "forwarding_status": _Q("forwarding_status"), "fragmentation": "ip_fragmented", "packets": "number_of_packets", "length": "length", "ip_length": "ip_length", "ttl": "ttl", "sample_ratio": "sample_ratio", "protocol": _Q(_PROTO)}
_PORTS = {"source_port": "source_port", "destination_port": "destination_port"}
_DOC = f"'{{' || CASE WHEN protocol = 6 THEN {_pairs(_ROW | _PORTS | {'tcp_flags': _Q(_FLAGS)})} WHEN protocol = 17 THEN {_pairs(_ROW | _PORTS)} ELSE {_pairs(_ROW)} END || '}}'"


@query(f"SELECT event_id, {_DOC} AS json FROM ({fx.FLOWS})")
def fn_row_json(spark, sf_dir):
    f = fx.flows(spark, sf_dir)
    return f.select("event_id", report.row_json(f.columns).alias("json"))


@query(f"WITH f AS (SELECT * FROM ({fx.FLOWS}) JOIN (SELECT host, event_id, position FROM ({SQL['attack_sample']})) USING (event_id)), d AS (SELECT host, position, {_DOC} AS json FROM f) SELECT host, '[' || string_agg(json, ',' ORDER BY position) || ']' AS rows FROM d GROUP BY host")
def attack_rows_json(spark, sf_dir):
    from .queries import attack_sample

    f = fx.flows(spark, sf_dir).join(attack_sample(spark, sf_dir), "event_id")
    return report.rows_json(f, "host", "position")


_COUNTERS = {}
for _side, _d in (("incoming", "in"), ("outgoing", "out")):
    for _p, _n in (("total", f"total_{_side}"), ("dropped", f"{_side}_dropped"), ("fragmented", f"{_side}_ip_fragmented"), ("tcp", f"{_side}_tcp"), ("tcp_syn", f"{_side}_syn_tcp"), ("udp", f"{_side}_udp"), ("icmp", f"{_side}_icmp")):
        _COUNTERS |= {f"{_n}_traffic": f"{_p}_{_d}_bytes", f"{_n}_traffic_bits": f"{_p}_{_d}_bytes * 8", f"{_n}_pps": f"{_p}_{_d}_packets"}
    _COUNTERS[f"total_{_side}_flows"] = f"{_d}_flows"


@query(_H4 + f" SELECT host, tick, '{{' || {_pairs(_COUNTERS)} || '}}' AS json FROM h")
def counters_json(spark, sf_dir):
    t = host_ticks(spark, sf_dir)
    return t.select("host", "tick", report.counters_json(t.columns).alias("json"))


_HAVE = {k: e if e.removesuffix(" * 8") in [*EMA_COLUMNS, "in_flows", "out_flows"] else "0" for k, e in _COUNTERS.items()}
_MD = "md5(host || '|' || hi)"
_UUID = " || '-' || ".join(f"substr({_MD}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
_DETAILS = _pairs({"attack_uuid": _Q(_UUID), "host_group": _Q("host_group"), "protocol_version": _Q("'IPv4'")} | _HAVE)


@query(BASE + TICKS + HOSTS + SETTINGS + DETECTED + f" SELECT host, '{{\"action\":\"ban\",\"alert_scope\":\"host\",\"attack_details\":{{' || {_DETAILS} || '}},\"ip\":\"' || {_IP('host')} || '\"}}' AS value FROM found, bounds")
def attack_json(spark, sf_dir):
    return sinks.attack_json(detections(spark, sf_dir).withColumn("detected_at", last_tick(spark, sf_dir)))


@query(BASE + TICKS + HOSTS + SETTINGS + DETECTED + CLASSIFIED + f" SELECT host, {_IP('host')} || ' ' || attack_direction || ' ' || x_total || ' ban' AS arguments FROM c1")
def notify_arguments(spark, sf_dir):
    return sinks.notify(detect.classified(detections(spark, sf_dir))).select("host", F.concat_ws(" ", "arguments").alias("arguments"))


@query(f"SELECT banned_tick AS tick, {_IP('host')} || '/32' AS prefix, 'announce' AS action FROM ({SQL['ban_timeline']}) UNION ALL SELECT unbanned_tick, {_IP('host')} || '/32', 'withdraw' FROM ({SQL['ban_timeline']})")
def route_events(spark, sf_dir):
    return sinks.route_events(ban_timeline(spark, sf_dir))


_BIG = "host IN (SELECT host FROM ({}) WHERE position <= 21)".format(SQL["flow_dump"])


@query(f"SELECT host, threshold FROM ({SQL['detect_hostgroups']}) WHERE host NOT IN (SELECT host FROM ({SQL['ban_timeline']}), (SELECT max(CAST(floor(epoch(ts) / {fx.TICK}) AS BIGINT)) AS hi FROM events) WHERE banned_tick <= hi AND unbanned_tick > hi)")
def detect_unbanned(spark, sf_dir):
    """Detected hosts that have no ban yet."""
    bans = detect.active_bans(ban_timeline(spark, sf_dir), last_tick(spark, sf_dir))
    return detect.free_to_ban(detections(spark, sf_dir), bans).select("host", "threshold")


_TOPS = " UNION ALL ".join(
    f"SELECT {section} AS section, CAST(row_number() OVER (ORDER BY total_{d}_packets DESC, host) AS INT) AS position, {_IP('host')} || ' ' || total_{d}_packets || ' pps ' || CAST(trunc(total_{d}_bytes / 1000.0::DOUBLE / 1000.0::DOUBLE * 8) AS BIGINT) || ' mbps ' || {d}_flows || ' flows' AS line FROM (SELECT * FROM hosts WHERE host <> 0 ORDER BY total_{d}_packets DESC, host LIMIT {fx.TOP})"
    for section, d in ((1, "in"), (2, "out"))
)


@query(
    BASE + TICKS + HOSTS + f""", tt AS ({SQL['total_metrics_ipv4']}), s AS (SELECT direction, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bits) AS BIGINT) // 8 AS bytes, CAST(sum(flows) AS BIGINT) AS flows FROM tt GROUP BY direction)
SELECT CASE direction WHEN 'incoming' THEN 1 WHEN 'outgoing' THEN 2 WHEN 'internal' THEN 3 ELSE 4 END AS section, 0 AS position, upper(left(direction, 1)) || substr(direction, 2) || ' traffic ' || packets || ' pps ' || CAST(trunc(bytes / 1000.0::DOUBLE / 1000.0::DOUBLE * 8) AS BIGINT) || ' mbps' || CASE WHEN direction IN ('incoming', 'outgoing') THEN ' ' || flows || ' flows' ELSE '' END AS line FROM s
UNION ALL {_TOPS} UNION ALL SELECT 5, 0, {_IP('host')} || ' banned at tick ' || banned_tick || ' until ' || unbanned_tick FROM ({SQL['ban_timeline']}), bounds WHERE banned_tick <= hi AND unbanned_tick > hi"""
)
def screen_report(spark, sf_dir):
    from .queries import averaged_hosts

    bans = detect.active_bans(ban_timeline(spark, sf_dir), last_tick(spark, sf_dir))
    return report.screen(_sum(total4(spark, sf_dir)), averaged_hosts(spark, sf_dir), bans, "packets", fx.TOP)


# What the engine counts about itself.
_SYSTEM = [("total_simple_packets_processed", "counter", "count(*)"), ("total_ipv4_packets", "counter", "count(*) FILTER (version = 4)"), ("total_ipv6_packets", "counter", "count(*) FILTER (version = 6)"), ("unknown_ip_version_packets", "counter", "count(*) FILTER (version NOT IN (4, 6))"), ("total_unparsed_packets", "counter", "count(*) FILTER (protocol NOT IN (1, 6, 17))"), ("total_unparsed_packets_speed", "gauge", f"CAST(trunc(count(*) FILTER (protocol NOT IN (1, 6, 17)) / {float(fx.TICK)}) AS BIGINT)")]


@query(f"WITH f AS (SELECT CAST(floor(epoch(arrival_time) / {fx.TICK}) AS BIGINT) AS tick, protocol, CASE event_id % 20 WHEN 7 THEN 6 WHEN 8 THEN 0 ELSE 4 END AS version FROM ({fx.FLOWS})) " + " UNION ALL ".join(f"SELECT {_WHEN}, '{n}' AS name, '{k}' AS type, {e} AS value, 1 AS schema_version FROM f GROUP BY tick" for n, k, e in _SYSTEM))
def system_metrics(spark, sf_dir):
    version = F.when(F.col("event_id") % 20 == 7, 6).when(F.col("event_id") % 20 == 8, 0).otherwise(4)
    f = fx.flows(spark, sf_dir).withColumns({"ip_protocol_version": version, "tick": counters.tick_of(fx.TICK)})
    return sinks.system_metrics(counters.system(f, fx.TICK), fx.TICK)


@query(_line_sql("system_counters", "metric", f"SELECT \"metricDateTime\", 'metric_value' AS metric, {', '.join(f'CAST(max(value) FILTER (name = {chr(39)}{n}{chr(39)}) AS BIGINT) AS {n}' for n, _, _ in _SYSTEM)} FROM ({SQL['system_metrics']}) GROUP BY 1", [n for n, _, _ in _SYSTEM]))
def lines_system_counters(spark, sf_dir):
    wide = system_metrics(spark, sf_dir).groupBy("metricDateTime").pivot("name", [n for n, _, _ in _SYSTEM]).agg(F.max("value")).withColumn("metric", F.lit("metric_value"))
    return sinks.measurement(wide, "system_counters", "metric")


@query(f"WITH t AS (SELECT name, type, CAST(sum(value) AS BIGINT) AS value FROM ({SQL['system_metrics']}) WHERE type = 'counter' GROUP BY 1, 2) SELECT '# TYPE tidegauge_' || name || ' ' || type AS line FROM t UNION ALL SELECT 'tidegauge_' || name || ' ' || value FROM t")
def prometheus_system(spark, sf_dir):
    return report.prometheus_counters(system_metrics(spark, sf_dir).where("type = 'counter'").groupBy("name", "type").agg(F.sum("value").alias("value")))


@query(BASE + SQL["direction_ema"][len(BASE) :].replace("sum(packets)", "sum(bytes)").replace("AS packets", "AS bytes").replace("t.packets", "t.bytes"))
def direction_ema_bytes(spark, sf_dir):
    t = counters.by_direction(enriched(spark, sf_dir), ("tick",))
    lo, hi = fx.flows(spark, sf_dir).agg(F.min(counters.tick_of(fx.TICK)), F.max(counters.tick_of(fx.TICK))).first()
    return counters.ema_series(t, "direction", "bytes", fx.TICK, fx.CONSTANT, lo, hi)


@query(f"SELECT CAST(event_id AS VARCHAR) AS key, {_DOC} AS value FROM ({fx.FLOWS})")
def topic_rows(spark, sf_dir):
    """Every classified row, before any filter, as key and value of a message."""
    f = fx.flows(spark, sf_dir)
    return sinks.topic_rows(f, F.col("event_id").cast("string"))
