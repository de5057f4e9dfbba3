"""Every registered flow query with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net
from ..operators import counters, detect, enrich, report, rules
from ..schema import MEASURES, PROTOS
from ..sources import fixtures as fx

KEEP = math.exp(-fx.TICK / fx.CONSTANT)
EMA_COLUMNS = ["total_in_bytes", "total_out_bytes", "total_in_packets", "total_out_packets", "tcp_in_packets", "tcp_out_packets", "udp_in_packets", "udp_out_packets", "icmp_in_packets", "icmp_out_packets", "tcp_in_bytes", "tcp_out_bytes", "udp_in_bytes", "udp_out_bytes", "icmp_in_bytes", "icmp_out_bytes", "tcp_syn_in_packets", "tcp_syn_out_packets", "fragmented_in_packets", "fragmented_out_packets"]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# SQL building blocks.
def values(rows: list[tuple], names: str) -> str:
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({names}))"


def best(ip: str, networks: str = "nets") -> str:
    return f"(SELECT max(len) FROM {networks} WHERE {ip} >= net AND {ip} < net + (CAST(1 AS BIGINT) << (32 - len)))"


def conditional(proto: str) -> str:
    return {"total": "true", "tcp": "protocol = 6", "udp": "protocol = 17", "icmp": "protocol = 1", "fragmented": "ip_fragmented", "tcp_syn": "protocol = 6 AND flags & 2 <> 0", "dropped": "forwarding_status = 'dropped'"}[proto]


_IP = lambda c: f"concat_ws('.', {c} >> 24, ({c} >> 16) & 255, ({c} >> 8) & 255, {c} & 255)"
SUMS = ", ".join(f"CAST(sum(CASE WHEN {conditional(p)} AND direction = '{n}' THEN {u} ELSE 0 END) AS BIGINT) AS {p}_{d}_{u}" for p in PROTOS for d, n in (("in", "incoming"), ("out", "outgoing")) for u in ("bytes", "packets"))
BASE = f"""WITH flows AS ({fx.FLOWS}), nets AS {values(fx.NETWORKS, "net, len")}, lpm AS (SELECT *, {best("src_ip")} AS sl, {best("dst_ip")} AS dl FROM flows),
e0 AS (SELECT *, CASE WHEN sl IS NOT NULL AND dl IS NOT NULL THEN 'internal' WHEN sl IS NOT NULL THEN 'outgoing' WHEN dl IS NOT NULL THEN 'incoming' ELSE 'other' END AS direction FROM lpm),
e1 AS (SELECT *, CASE direction WHEN 'outgoing' THEN src_ip WHEN 'incoming' THEN dst_ip END AS host, CASE direction WHEN 'outgoing' THEN sl WHEN 'incoming' THEN dl END AS subnet_len,
 number_of_packets * sample_ratio AS packets, length * sample_ratio AS bytes, CAST(floor(epoch(arrival_time) / {fx.TICK}) AS BIGINT) AS tick FROM e0),
e AS (SELECT *, host - host % (CAST(1 AS BIGINT) << (32 - subnet_len)) AS subnet_net FROM e1)
"""
TICKS = f", ticks AS (SELECT host, tick, {SUMS} FROM e WHERE host IS NOT NULL GROUP BY host, tick), bounds AS (SELECT min(tick) AS lo, max(tick) AS hi FROM e)"
_STEP = f"CAST(trunc(CAST(x AS DOUBLE) + {KEEP!r} * (CAST(acc AS DOUBLE) - CAST(x AS DOUBLE))) AS BIGINT)"


def ema_sql(columns: list[str]) -> str:
    """CTE ema: host and the averages at the last tick, over dense zero-filled ticks."""
    span = ", spans AS (SELECT host, min(tick) AS first FROM ticks GROUP BY host), dense AS (SELECT s.host, t.tick FROM spans s, bounds b, LATERAL (SELECT unnest(range(s.first, b.hi + 1)) AS tick) t)"
    lists = ", ".join(f"list(CAST(trunc(coalesce(k.{c}, 0) / {float(fx.TICK)}) AS BIGINT) ORDER BY d.tick) AS {c}" for c in columns)
    folded = ", ".join(f"list_reduce({c}, lambda acc, x: {_STEP}, CAST(0 AS BIGINT)) AS {c}" for c in columns)
    return f"{span}, series AS (SELECT d.host, {lists} FROM dense d LEFT JOIN ticks k ON k.host = d.host AND k.tick = d.tick GROUP BY d.host), ema AS (SELECT host, {folded} FROM series)"


# Spark building blocks.
def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.with_direction(fx.flows(spark, sf_dir), fx.networks(spark)).withColumn("tick", counters.tick_of(fx.TICK))


def tick_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.by_host(enriched(spark, sf_dir), ("host", "tick"))


def last_tick(spark: SparkSession, sf_dir: str):
    """A scalar subquery over the one column it needs."""
    return fx.flows(spark, sf_dir).agg(F.max(counters.tick_of(fx.TICK))).scalar()


def averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.ema(tick_table(spark, sf_dir), "host", EMA_COLUMNS, fx.TICK, fx.CONSTANT, last_tick(spark, sf_dir))


def averaged_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages at the last tick with flow rates, own subnet and group."""
    avg = averages(spark, sf_dir)
    flows = counters.flow_counts(enriched(spark, sf_dir).where(F.col("tick") == last_tick(spark, sf_dir))).select("host", *[(F.col(c) / float(fx.TICK)).cast("long").alias(c) for c in ("in_flows", "out_flows")])
    hosts = avg.join(flows, "host", "left").fillna(0, ["in_flows", "out_flows"])
    return detect.with_group(enrich.lpm(hosts, fx.networks(spark), "host", "subnet_net", "subnet_len"), fx.hostgroups(spark))


HOSTS = (
    ema_sql(EMA_COLUMNS)
    + f""", sess AS (SELECT DISTINCT host, direction, protocol, CASE direction WHEN 'outgoing' THEN dst_ip ELSE src_ip END AS remote, source_port, destination_port FROM e, bounds WHERE tick = hi AND host IS NOT NULL AND protocol IN (6, 17)),
fl AS (SELECT host, CAST(trunc(count(*) FILTER (direction = 'incoming') / {float(fx.TICK)}) AS BIGINT) AS in_flows, CAST(trunc(count(*) FILTER (direction = 'outgoing') / {float(fx.TICK)}) AS BIGINT) AS out_flows FROM sess GROUP BY host),
h0 AS (SELECT ema.*, coalesce(in_flows, 0) AS in_flows, coalesce(out_flows, 0) AS out_flows, {best("ema.host")} AS subnet_len FROM ema LEFT JOIN fl USING (host)),
h1 AS (SELECT *, host - host % (CAST(1 AS BIGINT) << (32 - subnet_len)) AS subnet_net FROM h0),
groups AS (SELECT net, len, arg_min(grp, position) AS grp FROM {values(fx.HOSTGROUPS, "net, len, grp, position")} GROUP BY net, len),
hosts AS (SELECT h1.*, coalesce(grp, 'global') AS host_group FROM h1 LEFT JOIN groups ON subnet_net = net AND subnet_len = len)"""
)
_PAIR = {"flows": ("in_flows", "out_flows")} | {n: tuple(f"{p}_{d}_{u}" if u == "packets" else f"CAST(trunc({p}_{d}_{u} / 1000.0::DOUBLE / 1000.0::DOUBLE * 8) AS BIGINT)" for d in ("in", "out")) for n, p, u in detect.CHECKS if p}
VERDICT = "CASE " + " ".join(f"WHEN {_PAIR[n][0]} > s.{n} OR {_PAIR[n][1]} > s.{n} THEN '{n}'" for n, _, _ in detect.CHECKS) + " END"
SETTINGS = f", s AS {values(fx.SETTINGS, 'grp, enable_ban, ' + ', '.join(fx.CHECK_COLUMNS) + ', enable_ban_ipv6')}"


@query(f"SELECT count(*) AS n, CAST(sum(number_of_packets) AS BIGINT) AS packets, CAST(sum(length) AS BIGINT) AS bytes, min(src_ip) AS min_src, max(dst_ip) AS max_dst, CAST(sum(flags) AS BIGINT) AS flags FROM ({fx.FLOWS})")
def flows_base(spark, sf_dir):
    return fx.flows(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.sum("number_of_packets").alias("packets"), F.sum("length").alias("bytes"), F.min("src_ip").alias("min_src"), F.max("dst_ip").alias("max_dst"), F.sum("flags").cast("long").alias("flags"))


@query(f"SELECT protocol, CAST(sum(number_of_packets * sample_ratio) AS BIGINT) AS packets, CAST(sum(length * sample_ratio) AS BIGINT) AS bytes FROM ({fx.FLOWS}) GROUP BY protocol")
def sampled_totals(spark, sf_dir):
    f = fx.flows(spark, sf_dir)
    return f.groupBy("protocol").agg(F.sum(F.col("number_of_packets") * F.col("sample_ratio")).alias("packets"), F.sum(F.col("length") * F.col("sample_ratio")).alias("bytes"))


@query(f"SELECT ip_protocol_version, count(*) AS n FROM ({fx.FLOWS}) WHERE ip_protocol_version IN (4, 6) GROUP BY 1")
def version_router(spark, sf_dir):
    return fx.flows(spark, sf_dir).where(F.col("ip_protocol_version").isin(4, 6)).groupBy("ip_protocol_version").agg(F.count(F.lit(1)).alias("n"))


@query(BASE + "SELECT event_id, sl AS src_len, src_ip - src_ip % (CAST(1 AS BIGINT) << (32 - sl)) AS src_net, dl AS dst_len FROM e")
def lpm_match(spark, sf_dir):
    f, n = fx.flows(spark, sf_dir), fx.networks(spark)
    return enrich.lpm(enrich.lpm(f, n, "src_ip", "src_net", "src_len"), n, "dst_ip", "dst_net", "dst_len").select("event_id", "src_len", "src_net", "dst_len")


@query(BASE + "SELECT event_id, direction, host, subnet_net, subnet_len FROM e")
def direction_rows(spark, sf_dir):
    return enriched(spark, sf_dir).select("event_id", "direction", "host", "subnet_net", "subnet_len")


@query(BASE + 'SELECT direction, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS "rows" FROM e GROUP BY direction')
def direction_totals(spark, sf_dir):
    return counters.by_direction(enriched(spark, sf_dir))


@query(BASE + "SELECT event_id FROM e WHERE sl IS NOT NULL")
def membership(spark, sf_dir):
    return enrich.inside(fx.flows(spark, sf_dir), fx.networks(spark), "src_ip").select("event_id")


@query(BASE + f", wl AS {values(fx.WHITELIST, 'net, len')} SELECT DISTINCT host FROM e WHERE host IS NOT NULL AND {best('host', 'wl')} IS NULL")
def whitelist_anti(spark, sf_dir):
    return enrich.inside(enriched(spark, sf_dir).where("host is not null").select("host").distinct(), fx.whitelist(spark), "host", "anti")


@query(f"WITH g AS {values(fx.HOSTGROUPS, 'net, len, grp, position')}, n AS {values(fx.NETWORKS, 'net, len')} SELECT n.net, n.len, coalesce(arg_min(grp, position), 'global') AS host_group FROM n LEFT JOIN g ON n.net = g.net AND n.len = g.len GROUP BY 1, 2")
def hostgroup_lookup(spark, sf_dir):
    n = fx.networks(spark).select(F.col("net").alias("subnet_net"), F.col("len").alias("subnet_len"))
    return detect.with_group(n, fx.hostgroups(spark)).select(F.col("subnet_net").alias("net"), F.col("subnet_len").alias("len"), "host_group")


@query(f"WITH n AS {values(fx.NETWORKS, 'net, len')}, asn AS {values([(167772160, 23, 64512), (167772160, 25, 64513), (3405803776, 24, 64514)], 'net, len, asn')}, flows AS ({fx.FLOWS}) SELECT event_id, (SELECT arg_max(asn, len) FROM asn WHERE src_ip >= net AND src_ip < net + (CAST(1 AS BIGINT) << (32 - len))) AS asn FROM flows")
def asn_lookup(spark, sf_dir):
    asn = fx.dimension(spark, [(167772160, 23, 64512), (167772160, 25, 64513), (3405803776, 24, 64514)], "net BIGINT, len INT, asn INT")
    return enrich.lpm(fx.flows(spark, sf_dir), asn, "src_ip", "n", "l", "asn").select("event_id", "asn")


@query(f"WITH a AS {values(fx.NETWORKS, 'net, len')}, b AS {values(fx.HOSTGROUPS, 'net, len, grp, position')} SELECT DISTINCT net, len FROM a SEMI JOIN b USING (net, len)")
def exact_prefix(spark, sf_dir):
    return fx.networks(spark).join(fx.hostgroups(spark), ["net", "len"], "left_semi")


@query(BASE + TICKS + " SELECT * FROM ticks")
def host_counters(spark, sf_dir):
    return tick_table(spark, sf_dir)


@query(BASE + f"SELECT subnet_net, subnet_len, {SUMS} FROM e WHERE subnet_len IS NOT NULL GROUP BY 1, 2")
def network_counters(spark, sf_dir):
    return counters.by_subnet(enriched(spark, sf_dir))


@query(BASE + "SELECT tick, direction, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS \"rows\" FROM e GROUP BY 1, 2")
def total_counters(spark, sf_dir):
    return counters.by_direction(enriched(spark, sf_dir), ("tick",))


SESS = ", sess AS (SELECT tick, host, direction, protocol, CASE direction WHEN 'outgoing' THEN dst_ip ELSE src_ip END AS remote, source_port, destination_port, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes FROM e WHERE host IS NOT NULL AND protocol IN (6, 17) GROUP BY ALL), fc AS (SELECT tick, host, count(*) FILTER (direction = 'incoming') AS in_flows, count(*) FILTER (direction = 'outgoing') AS out_flows FROM sess GROUP BY ALL)"


@query(BASE + SESS + " SELECT * FROM fc")
def flow_counts(spark, sf_dir):
    return counters.flow_counts(enriched(spark, sf_dir))


@query(BASE + SESS + " SELECT * FROM sess")
def flow_sessions(spark, sf_dir):
    return counters.sessions(enriched(spark, sf_dir), ("tick",))


@query(BASE + SESS + f" SELECT tick, CAST(trunc(sum(trunc(in_flows / {float(fx.TICK)}) ) / {float(fx.TICK)}) AS BIGINT) AS in_flows, CAST(sum(in_flows) AS BIGINT) AS raw_in, CAST(sum(out_flows) AS BIGINT) AS raw_out FROM fc GROUP BY tick")
def flow_totals(spark, sf_dir):
    f = counters.flow_counts(enriched(spark, sf_dir))
    per = (F.sum((F.col("in_flows") / float(fx.TICK)).cast("long")) / float(fx.TICK)).cast("long")
    return f.groupBy("tick").agg(per.alias("in_flows"), F.sum("in_flows").alias("raw_in"), F.sum("out_flows").alias("raw_out"))


@query(BASE + TICKS + f" SELECT host, tick, {', '.join(f'CAST(trunc({c} / {float(fx.TICK)}) AS BIGINT) AS {c}' for c in MEASURES)} FROM ticks")
def host_speed(spark, sf_dir):
    return counters.speed(tick_table(spark, sf_dir), MEASURES, fx.TICK)


@query(BASE + TICKS + ema_sql(EMA_COLUMNS) + " SELECT * FROM ema")
def host_ema(spark, sf_dir):
    return averages(spark, sf_dir)


@query(
    BASE
    + f""", bounds AS (SELECT min(tick) AS lo, max(tick) AS hi FROM e), t AS (SELECT direction, tick, CAST(sum(packets) AS BIGINT) AS packets FROM e GROUP BY 1, 2),
dense AS (SELECT d.direction, k.tick, CAST(trunc(coalesce(t.packets, 0) / {float(fx.TICK)}) AS BIGINT) AS speed FROM (SELECT DISTINCT direction FROM t) d, (SELECT unnest(range(lo, hi + 1)) AS tick FROM bounds) k LEFT JOIN t ON t.direction = d.direction AND t.tick = k.tick),
w AS (SELECT direction, list(speed ORDER BY tick) AS s, min(tick) AS lo FROM dense GROUP BY 1),
x AS (SELECT direction, lo, s, unnest(range(1, len(s) + 1)) AS i FROM w)
SELECT direction, lo + i - 1 AS tick, s[i] AS speed, list_reduce(s[1 : i], lambda acc, x: {_STEP}, CAST(0 AS BIGINT)) AS average FROM x"""
)
def direction_ema(spark, sf_dir):
    t = counters.by_direction(enriched(spark, sf_dir), ("tick",))
    lo, hi = fx.flows(spark, sf_dir).agg(F.min(counters.tick_of(fx.TICK)), F.max(counters.tick_of(fx.TICK))).first()
    return counters.ema_series(t, "direction", "packets", fx.TICK, fx.CONSTANT, lo, hi)


@query(BASE + ", t AS (SELECT direction, tick, CAST(sum(packets) AS BIGINT) AS packets FROM e GROUP BY 1, 2) SELECT direction, tick, packets - coalesce(lag(packets) OVER (PARTITION BY direction ORDER BY tick), 0) AS delta FROM t")
def counter_delta(spark, sf_dir):
    return counters.deltas(counters.by_direction(enriched(spark, sf_dir), ("tick",)), ("direction",), "packets").select("direction", "tick", "delta")


@query(BASE + TICKS + f" SELECT host, {', '.join(f'max({c}) AS {c}' for c in MEASURES)} FROM ticks GROUP BY host")
def host_peaks(spark, sf_dir):
    return counters.peaks(tick_table(spark, sf_dir), ("host",))


@query(BASE + TICKS + ema_sql(EMA_COLUMNS) + " SELECT host, total_in_packets, total_out_packets FROM ema WHERE total_in_bytes <> 0 OR total_out_bytes <> 0 OR total_in_packets <> 0 OR total_out_packets <> 0")
def busy_hosts(spark, sf_dir):
    return counters.busy(averages(spark, sf_dir)).select("host", "total_in_packets", "total_out_packets")


@query(BASE + TICKS + HOSTS + SETTINGS + f", v AS (SELECT hosts.host, {VERDICT} AS threshold FROM hosts, (SELECT * FROM s WHERE grp = 'global') s) SELECT * FROM v WHERE threshold IS NOT NULL")
def detect_global(spark, sf_dir):
    hosts = averaged_hosts(spark, sf_dir).withColumn("host_group", F.lit("global"))
    return detect.detect(hosts, fx.settings(spark)).select("host", "threshold")


DETECTED = f", v AS (SELECT hosts.*, {VERDICT} AS threshold FROM hosts JOIN s ON host_group = s.grp WHERE s.enable_ban AND (SELECT enable_ban FROM s WHERE grp = 'global')), wl AS {values(fx.WHITELIST, 'net, len')}, found AS (SELECT * FROM v WHERE threshold IS NOT NULL AND {best('host', 'wl')} IS NULL)"


def detections(spark, sf_dir):
    return enrich.inside(detect.detect(averaged_hosts(spark, sf_dir), fx.settings(spark)), fx.whitelist(spark), "host", "anti")


@query(BASE + TICKS + HOSTS + SETTINGS + DETECTED + " SELECT host, host_group, threshold FROM found")
def detect_hostgroups(spark, sf_dir):
    return detections(spark, sf_dir).select("host", "host_group", "threshold")


_DIR = "CASE WHEN abs(total_in_packets - total_out_packets) < 1000 THEN CASE WHEN total_in_bytes > total_out_bytes THEN 'incoming' ELSE 'outgoing' END WHEN total_in_packets > total_out_packets THEN 'incoming' ELSE 'outgoing' END"
_SIDE = lambda p: f"CASE attack_direction WHEN 'incoming' THEN {p}_in_packets ELSE {p}_out_packets END"
CLASSIFIED = f", c0 AS (SELECT *, {_DIR} AS attack_direction FROM found), c1 AS (SELECT *, {', '.join(f'{_SIDE(p)} AS x_{p}' for p in ('total', 'tcp', 'udp', 'icmp', 'tcp_syn', 'fragmented'))} FROM c0)"


@query(BASE + TICKS + HOSTS + SETTINGS + DETECTED + CLASSIFIED + " SELECT host, attack_direction, x_total AS attack_power FROM c1")
def attack_direction(spark, sf_dir):
    return detect.classified(detections(spark, sf_dir)).select("host", "attack_direction", "attack_power")


@query(BASE + TICKS + HOSTS + SETTINGS + DETECTED + CLASSIFIED + " SELECT host, CASE WHEN x_tcp >= x_udp AND x_tcp >= x_icmp THEN 'tcp' WHEN x_udp >= x_icmp THEN 'udp' ELSE 'icmp' END AS attack_protocol FROM c1")
def attack_protocol(spark, sf_dir):
    return detect.classified(detections(spark, sf_dir)).select("host", "attack_protocol")


_SHARE = lambda p: f"CAST(x_{p} AS DOUBLE) / CAST(x_total AS DOUBLE) > 0.9"


@query(BASE + TICKS + HOSTS + SETTINGS + DETECTED + CLASSIFIED + f" SELECT host, CASE WHEN x_total = 0 THEN 'unknown' WHEN {_SHARE('tcp_syn')} THEN 'syn_flood' WHEN {_SHARE('icmp')} THEN 'icmp_flood' WHEN {_SHARE('fragmented')} THEN 'ip_fragmentation' WHEN {_SHARE('udp')} THEN 'udp_flood' ELSE 'unknown' END AS attack_type FROM c1")
def attack_type(spark, sf_dir):
    return detect.classified(detections(spark, sf_dir)).select("host", "attack_type")


_KIND = f"CASE WHEN x_total = 0 THEN 'unknown' WHEN {_SHARE('tcp_syn')} THEN 'syn_flood' WHEN {_SHARE('icmp')} THEN 'icmp_flood' WHEN {_SHARE('fragmented')} THEN 'ip_fragmentation' WHEN {_SHARE('udp')} THEN 'udp_flood' ELSE 'unknown' END"
_MBPS = lambda c: f"CAST(trunc({c} / 1000.0::DOUBLE / 1000.0::DOUBLE * 8) AS BIGINT)"
_FACTS = " || ".join(f"'{label}: ' || {_MBPS(c) if unit == 'mbps' else c} || ' {unit}' || chr(10)" for label, c, unit in report.attack_fields() if c in [*EMA_COLUMNS, "in_flows", "out_flows"])


@query(
    BASE + TICKS + HOSTS + SETTINGS + DETECTED + CLASSIFIED + f""" SELECT host, 'Attack type: ' || {_KIND} || chr(10) || 'Initial attack power: ' || x_total || ' packets per second' || chr(10) || 'Attack direction: ' || attack_direction || chr(10) ||
'Attack protocol: ' || CASE WHEN x_tcp >= x_udp AND x_tcp >= x_icmp THEN 'tcp' WHEN x_udp >= x_icmp THEN 'udp' ELSE 'icmp' END || chr(10) || {_FACTS} AS text FROM c1"""
)
def attack_text(spark, sf_dir):
    found = detect.classified(detections(spark, sf_dir))
    return found.select("host", report.attack_text(found.columns).alias("text"))


# Samples and bans over instant speeds above 30 packets per second.
ATTACKED = f", hit AS (SELECT host, tick FROM ticks WHERE trunc(total_in_packets / {float(fx.TICK)}) > 30 OR trunc(total_out_packets / {float(fx.TICK)}) > 30)"


def attacked(spark, sf_dir):
    t = counters.speed(tick_table(spark, sf_dir), ["total_in_packets", "total_out_packets"], fx.TICK)
    return t.where("total_in_packets > 30 or total_out_packets > 30").select("host", "tick")


@query(BASE + TICKS + ATTACKED + f", d AS (SELECT host, to_timestamp((min(tick) + 1) * {fx.TICK}) AT TIME ZONE 'UTC' AS detected_at FROM hit GROUP BY host), r AS (SELECT e.host, event_id, row_number() OVER (PARTITION BY e.host ORDER BY arrival_time, event_id) AS position FROM e JOIN d ON e.host = d.host WHERE arrival_time > detected_at AND epoch(arrival_time) <= epoch(detected_at) + 864000), f AS (SELECT host FROM r WHERE position = {fx.SAMPLE}) SELECT host, event_id, position FROM r WHERE position <= {fx.SAMPLE} AND host IN (SELECT host FROM f)")
def attack_sample(spark, sf_dir):
    d = attacked(spark, sf_dir).groupBy("host").agg(F.timestamp_seconds((F.min("tick") + 1) * fx.TICK).alias("detected_at"))
    rows = enriched(spark, sf_dir).where("host is not null").select("host", "event_id", "arrival_time")
    return detect.sample(rows, d, fx.SAMPLE, 864000).select("host", "event_id", "position")


@query(
    "WITH RECURSIVE "
    + (BASE + TICKS + ATTACKED)[5:]
    + f""", r(host, tick, a, b) AS (SELECT host, min(tick), min(tick), min(tick) + {fx.BAN // fx.TICK + 1} FROM hit GROUP BY host
UNION ALL SELECT n.host, n.tick, CASE WHEN n.tick <= r.b THEN r.a ELSE n.tick END, CASE WHEN n.tick = r.b THEN n.tick + 1 WHEN n.tick < r.b THEN r.b ELSE n.tick + {fx.BAN // fx.TICK + 1} END
FROM r JOIN hit n ON n.host = r.host AND n.tick = (SELECT min(tick) FROM hit m WHERE m.host = r.host AND m.tick > r.tick))
SELECT host, a AS banned_tick, max(b) AS unbanned_tick FROM r GROUP BY host, a"""
)
def ban_timeline(spark, sf_dir):
    return detect.ban_timeline(attacked(spark, sf_dir), fx.TICK, fx.BAN)


@query(f"SELECT host, {_IP('host')} || '/32' AS prefix, banned_tick FROM ({SQL['ban_timeline']}), (SELECT max(CAST(floor(epoch(ts) / {fx.TICK}) AS BIGINT)) AS hi FROM events) WHERE banned_tick <= hi AND unbanned_tick > hi")
def banlist(spark, sf_dir):
    return detect.active_bans(ban_timeline(spark, sf_dir), last_tick(spark, sf_dir)).select("host", net.cidr_text(F.col("host"), F.lit(32)).alias("prefix"), "banned_tick")


def _top(order: str, direction: str):
    column = report.metric(order, direction)

    def run(spark, sf_dir):
        e = enriched(spark, sf_dir)
        hosts = counters.by_host(e)
        if order == "flows":
            hosts = counters.flow_counts(e, ()).join(hosts, "host", "right").fillna(0, ["in_flows", "out_flows"])
        return report.top_hosts(hosts, order, direction, fx.TOP)

    table = f"(SELECT host, {SUMS} FROM e WHERE host IS NOT NULL GROUP BY host)" if order != "flows" else "(SELECT h.host, coalesce(in_flows, 0) AS in_flows, coalesce(out_flows, 0) AS out_flows FROM (SELECT DISTINCT host FROM e WHERE host IS NOT NULL) h LEFT JOIN (SELECT host, count(DISTINCT (direction, protocol, remote, source_port, destination_port)) FILTER (direction = 'incoming') AS in_flows, count(DISTINCT (direction, protocol, remote, source_port, destination_port)) FILTER (direction = 'outgoing') AS out_flows FROM sess GROUP BY host) f ON f.host = h.host)"
    ip = "concat_ws('.', host >> 24, (host >> 16) & 255, (host >> 8) & 255, host & 255)"
    run.__name__ = f"top_hosts_{direction}_{order}"
    query(BASE + (SESS if order == "flows" else "") + f" SELECT host, {ip} AS ip, {column} AS value FROM {table} WHERE host <> 0 ORDER BY {column} DESC, host LIMIT {fx.TOP}")(run)


for _order in ("packets", "bytes", "flows", *(f"{p}_{u}" for p in ("tcp", "udp", "icmp", "tcp_syn", "fragmented") for u in ("packets", "bytes"))):
    for _direction in ("incoming", "outgoing"):
        _top(_order, _direction)



@query(BASE + f"SELECT {_IP('subnet_net')} || '/' || subnet_len AS network, total_in_packets, total_in_bytes, total_out_packets, total_out_bytes FROM (SELECT subnet_net, subnet_len, {SUMS} FROM e WHERE subnet_len IS NOT NULL GROUP BY 1, 2)")
def network_report(spark, sf_dir):
    return report.network_report(counters.by_subnet(enriched(spark, sf_dir)))


@query(BASE + f"SELECT total_in_packets, total_out_packets FROM (SELECT host, {SUMS} FROM e WHERE host = 167772165 GROUP BY host)")
def host_point(spark, sf_dir):
    return counters.by_host(enriched(spark, sf_dir).where("host = 167772165")).select("total_in_packets", "total_out_packets")


@query(BASE + f", s AS (SELECT host, direction, protocol, CASE direction WHEN 'outgoing' THEN dst_ip ELSE src_ip END AS remote, source_port, destination_port, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes FROM e WHERE host IS NOT NULL AND protocol IN (6, 17) GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY direction, protocol, remote, source_port, destination_port) AS position FROM s) SELECT * FROM n WHERE position <= {fx.SAMPLE + 1}")
def flow_dump(spark, sf_dir):
    return report.flow_dump(counters.sessions(enriched(spark, sf_dir)), fx.SAMPLE)


@query(BASE + "SELECT ports, count(*) AS n FROM (SELECT host, count(DISTINCT destination_port) AS ports FROM e WHERE direction = 'incoming' AND protocol = 6 GROUP BY host) GROUP BY 1")
def local_port_histogram(spark, sf_dir):
    once = enriched(spark, sf_dir).where("direction = 'incoming' and protocol = 6").select("host", "destination_port").distinct()
    return once.groupBy("host").agg(F.count(F.lit(1)).alias("ports")).groupBy("ports").agg(F.count(F.lit(1)).alias("n"))


@query(BASE + "SELECT remote_hosts, count(*) AS n FROM (SELECT host, count(DISTINCT src_ip) AS remote_hosts FROM e WHERE direction = 'incoming' AND protocol = 6 GROUP BY host) GROUP BY 1")
def remote_host_histogram(spark, sf_dir):
    once = enriched(spark, sf_dir).where("direction = 'incoming' and protocol = 6").select("host", "src_ip").distinct()
    return once.groupBy("host").agg(F.count(F.lit(1)).alias("remote_hosts")).groupBy("remote_hosts").agg(F.count(F.lit(1)).alias("n"))


# Rules.
_RULE_SQL = [
    "(destination_port IN (53) AND protocol = 17)",
    "(src_ip >= 3405803776 AND src_ip < 3405803840 AND flags & 63 = 2)",
    "(ip_fragmented AND vlan = 100)",
    f"(length <= 65635 AND (length % 65536 IN ({fx.LENGTHS}) OR ip_length % 65536 IN ({fx.LENGTHS})))",
    "(dst_ip = 167772165)",
]


def _rule(k: int):
    def run(spark, sf_dir):
        return fx.flows(spark, sf_dir).where(rules.any_of([fx.RULES[k]])).select("event_id")

    run.__name__ = f"rule_clause_{k + 1}"
    query(f"SELECT event_id FROM ({fx.FLOWS}) WHERE {_RULE_SQL[k]}")(run)


for _k in range(len(_RULE_SQL)):
    _rule(_k)


@query(BASE + f"SELECT direction, count(*) AS n FROM e WHERE NOT (direction IN ('incoming', 'outgoing') AND ({' OR '.join(_RULE_SQL)})) GROUP BY direction")
def rule_filter(spark, sf_dir):
    return enrich.accounted(enriched(spark, sf_dir), rules.any_of(fx.RULES)).groupBy("direction").agg(F.count(F.lit(1)).alias("n"))


@query(BASE + "SELECT direction, count(*) AS n FROM e WHERE direction <> 'outgoing' GROUP BY direction")
def direction_filter(spark, sf_dir):
    return enrich.accounted(enriched(spark, sf_dir), outgoing=False).groupBy("direction").agg(F.count(F.lit(1)).alias("n"))


@query(BASE + "SELECT event_id FROM e WHERE direction = 'other'")
def debug_other(spark, sf_dir):
    return enriched(spark, sf_dir).where("direction = 'other'").select("event_id")


@query(
    f"""WITH f AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN 0 ELSE number_of_packets END AS p, CASE WHEN event_id % 13 = 0 THEN event_id ELSE 0 END AS flow_id FROM ({fx.FLOWS}))
SELECT event_id, src_ip, dst_ip, source_port, destination_port, CASE WHEN p = 0 AND flow_id <> 0 THEN number_of_packets ELSE p END AS number_of_packets FROM f
UNION ALL SELECT event_id, dst_ip, src_ip, destination_port, source_port, number_of_packets * 2 FROM f WHERE p = 0 AND flow_id <> 0"""
)
def bidirectional_split(spark, sf_dir):
    f = fx.flows(spark, sf_dir)
    special = F.col("event_id") % 13 == 0
    f = f.withColumns({"flow_id": F.when(special, F.col("event_id")).otherwise(0), "fwd_bytes": F.col("length"), "fwd_packets": F.col("number_of_packets"), "rev_bytes": F.col("length") * 2, "rev_packets": F.col("number_of_packets") * 2})
    f = f.withColumns({"number_of_packets": F.when(special, 0).otherwise(F.col("number_of_packets")), "length": F.when(special, 0).otherwise(F.col("length"))})
    return enrich.split_bidirectional(f).select("event_id", "src_ip", "dst_ip", "source_port", "destination_port", "number_of_packets")


@query(
    f"""WITH f AS (SELECT *, CASE WHEN event_id % 17 = 0 THEN 100 + event_id % 9 END AS announced FROM ({fx.FLOWS}))
SELECT event_id, coalesce(last_value(announced IGNORE NULLS) OVER (PARTITION BY agent_ipv4_address ORDER BY event_id ROWS UNBOUNDED PRECEDING), sample_ratio) AS ratio FROM f"""
)
def learned_sampling(spark, sf_dir):
    from ..sources.templates import learned_rate

    f = fx.flows(spark, sf_dir).withColumn("announced", F.when(F.col("event_id") % 17 == 0, 100 + F.col("event_id") % 9))
    return learned_rate(f, "agent_ipv4_address", "event_id", "announced", "sample_ratio", "ratio", 97).select("event_id", "ratio")


# Scalar functions.
@query(f"SELECT DISTINCT src_ip, {_IP('src_ip')} AS ip, {_IP('src_ip')} || '/32' AS cidr, src_ip AS back FROM ({fx.FLOWS})")
def fn_ip_text(spark, sf_dir):
    ip = net.ip_text(F.col("src_ip"))
    return fx.flows(spark, sf_dir).select("src_ip").distinct().select("src_ip", ip.alias("ip"), F.concat(ip, F.lit("/32")).alias("cidr"), net.ip_number(ip).alias("back"))


@query("SELECT CAST(len AS INT) AS len, CASE WHEN len = 0 THEN 0 ELSE 4294967296 - (CAST(1 AS BIGINT) << (32 - len)) END AS mask FROM (SELECT unnest(range(0, 33)) AS len)")
def fn_netmask(spark, sf_dir):
    d = spark.range(33).select(F.col("id").cast("int").alias("len"))
    return d.select("len", net.netmask(F.col("len")).alias("mask"))


@query(f"SELECT DISTINCT flags, coalesce(nullif(concat_ws(',', CASE WHEN flags & 1 <> 0 THEN 'fin' END, CASE WHEN flags & 2 <> 0 THEN 'syn' END, CASE WHEN flags & 4 <> 0 THEN 'rst' END, CASE WHEN flags & 8 <> 0 THEN 'psh' END, CASE WHEN flags & 16 <> 0 THEN 'ack' END, CASE WHEN flags & 32 <> 0 THEN 'urg' END), ''), '-') AS text FROM ({fx.FLOWS})")
def fn_tcp_flags(spark, sf_dir):
    return fx.flows(spark, sf_dir).select("flags").distinct().select("flags", net.tcp_flags_text(F.col("flags")).alias("text"))


@query(f"SELECT event_id, CAST(trunc(length / 1000.0::DOUBLE / 1000.0::DOUBLE * 8) AS BIGINT) AS mbps FROM ({fx.FLOWS})")
def fn_mbps(spark, sf_dir):
    return fx.flows(spark, sf_dir).select("event_id", net.mbps(F.col("length")).alias("mbps"))


@query(f"SELECT protocol, CASE protocol WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' ELSE 'unknown' END AS name, count(*) AS n FROM ({fx.FLOWS}) GROUP BY protocol")
def fn_proto(spark, sf_dir):
    return fx.flows(spark, sf_dir).groupBy("protocol").agg(F.count(F.lit(1)).alias("n")).withColumn("name", net.protocol_text(F.col("protocol")))


@query("SELECT CAST(code AS INT) AS code, CASE code WHEN 1 THEN 'forwarded' WHEN 2 THEN 'dropped' WHEN 3 THEN 'consumed' ELSE 'unknown' END AS name FROM (SELECT unnest(range(0, 6)) AS code)")
def fn_fwd_status(spark, sf_dir):
    return spark.range(6).select(F.col("id").cast("int").alias("code")).withColumn("name", net.forwarding_text(F.col("code")))


@query(f"SELECT DISTINCT flags, (flags >> 1) & 1 AS syn, flags | 4 AS with_rst, flags & ~16 AS without_ack FROM ({fx.FLOWS})")
def fn_bits(spark, sf_dir):
    f = F.col("flags")
    return fx.flows(spark, sf_dir).select("flags").distinct().select("flags", net.bit(f, 2).alias("syn"), net.set_bit(f, 3).alias("with_rst"), net.clear_bit(f, 5).alias("without_ack"))


@query(f"SELECT event_id, {_IP('src_ip')} || ':' || source_port || ' > ' || {_IP('dst_ip')} || ':' || destination_port || ' protocol: ' || CASE protocol WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' ELSE 'unknown' END || ' flags: ' || coalesce(nullif(concat_ws(',', CASE WHEN flags & 2 <> 0 THEN 'syn' END, CASE WHEN flags & 16 <> 0 THEN 'ack' END), ''), '-') || ' packets: ' || number_of_packets || ' size: ' || length AS line FROM ({fx.FLOWS})")
def fn_row_text(spark, sf_dir):
    return fx.flows(spark, sf_dir).select("event_id", report.row_text().alias("line"))


@query(BASE + ", r AS (SELECT host, direction, bytes, packets, destination_port = 53 AS dns, ip_fragmented AS parts FROM e WHERE host IS NOT NULL) SELECT host, " + ", ".join(f"CAST(sum(CASE WHEN {r} AND direction = '{n}' THEN {u} ELSE 0 END) AS BIGINT) AS {r}_{d}_{u}" for r in ("dns", "parts") for d, n in (("in", "incoming"), ("out", "outgoing")) for u in ("bytes", "packets")) + " FROM r GROUP BY host")
def flexible_counters(spark, sf_dir):
    return counters.by_rule(enriched(spark, sf_dir), {"dns": F.col("destination_port") == 53, "parts": F.col("ip_fragmented")})


_NAMED = "(0, 'HOPOPT'), (1, 'ICMP'), (2, 'IGMP'), (4, 'IPV4'), (6, 'TCP'), (8, 'EGP'), (17, 'UDP'), (27, 'RDP'), (33, 'DCCP'), (41, 'IPV6'), (46, 'RSVP'), (47, 'GRE'), (50, 'ESP'), (51, 'AH'), (58, 'IPV6_ICMP'), (88, 'EIGRP'), (89, 'OSPFIGP'), (103, 'PIM'), (112, 'VRRP'), (115, 'L2TP'), (132, 'SCTP'), (136, 'UDPLITE'), (137, 'MPLS_IN_IP'), (143, 'ETHERNET')"


@query(f"SELECT * FROM (VALUES {_NAMED}) t(number, name) UNION ALL SELECT CAST(n AS INT), CASE WHEN n = 255 THEN 'RESERVED' WHEN n >= 253 THEN 'UNKNOWN_' || n ELSE 'UNASSIGNED_' || n END FROM (SELECT unnest(range(144, 256)) AS n)")
def fn_protocol_name(spark, sf_dir):
    numbers = [0, 1, 2, 4, 6, 8, 17, 27, 33, 41, 46, 47, 50, 51, 58, 88, 89, 103, 112, 115, 132, 136, 137, 143]
    d = spark.range(256).where(F.col("id").isin(*numbers) | (F.col("id") >= 144)).select(F.col("id").cast("int").alias("number"))
    return d.select("number", net.protocol_name(F.col("number")).alias("name"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS text, strftime(ts, '%d_%m_%y_%H:%M:%S') AS compact FROM events")
def fn_time_text(spark, sf_dir):
    at = F.col("arrival_time")
    return fx.flows(spark, sf_dir).select("event_id", net.time_text(at).alias("text"), net.compact_time(at).alias("compact"))


@query("SELECT printf('%x', src_ip) AS hex, src_ip AS number FROM (SELECT DISTINCT src_ip FROM (" + fx.FLOWS + "))")
def fn_hex_number(spark, sf_dir):
    h = F.lower(F.hex("src_ip"))
    return fx.flows(spark, sf_dir).select("src_ip").distinct().select(h.alias("hex"), net.hex_number(h).alias("number"))


@query("SELECT * FROM (VALUES ('65001:666', 65001, 666), ('0:0', 0, 0), ('65536:1', NULL, NULL), ('1', NULL, NULL), ('a:b', NULL, NULL)) t(text, asn, number)")
def fn_community(spark, sf_dir):
    d = spark.sql("SELECT explode(array('65001:666', '0:0', '65536:1', '1', 'a:b')) AS text").withColumn("c", net.parse_community(F.col("text")))
    return d.select("text", "c.asn", "c.number")


# Histograms and system counters.
def _buckets(kind: str) -> str:
    names = counters._V5 if kind == "v5" else [(0, "0"), *counters._V9]
    return "CASE " + " ".join(f"WHEN d <= {m} THEN '{n}'" for m, n in names) + " ELSE '180+' END"


for _kind in ("v5", "v9"):

    def _hist(spark, sf_dir, kind=_kind):
        d = ((F.col("flow_end") - F.col("flow_start")) / 1000).cast("long")
        return fx.flows(spark, sf_dir).groupBy(counters.duration_bucket(d, kind).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))

    _hist.__name__ = f"duration_hist_{_kind}"
    query(f"SELECT {_buckets(_kind)} AS bucket, count(*) AS n FROM (SELECT CAST(trunc((flow_end - flow_start) / 1000.0::DOUBLE) AS BIGINT) AS d FROM ({fx.FLOWS})) GROUP BY 1")(_hist)


@query(f"SELECT agent_ipv4_address, arg_max(sample_ratio, event_id) AS rate FROM ({fx.FLOWS}) GROUP BY 1")
def sampling_gauges(spark, sf_dir):
    return fx.flows(spark, sf_dir).groupBy("agent_ipv4_address").agg(F.max_by("sample_ratio", "event_id").alias("rate"))


@query(f"SELECT CAST(floor(epoch(arrival_time) / {fx.TICK}) AS BIGINT) AS tick, CAST(trunc(count(*) / {float(fx.TICK)}) AS BIGINT) AS speed, count(*) AS n FROM ({fx.FLOWS}) WHERE protocol NOT IN (6, 17) GROUP BY 1")
def unparsed_rate(spark, sf_dir):
    f = fx.flows(spark, sf_dir).where("protocol not in (6, 17)").groupBy(counters.tick_of(fx.TICK).alias("tick")).agg(F.count(F.lit(1)).alias("n"))
    return f.withColumn("speed", (F.col("n") / float(fx.TICK)).cast("long"))


# Sinks' payloads.
@query(BASE + TICKS + HOSTS + SETTINGS + DETECTED + f" SELECT {_IP('host')} || '/32' AS prefix, 'announce' AS action FROM found UNION ALL SELECT DISTINCT {_IP('subnet_net')} || '/' || subnet_len, 'announce' FROM found")
def announcements(spark, sf_dir):
    from .sinks import announcements as table

    return table(detections(spark, sf_dir))


# IPv6: the same rows with addresses mapped into 2001:db8::/32.
_V6 = lambda ip: f"CASE WHEN {ip} >= 167772160 AND {ip} < 167772672 THEN '20010db8000000000000' ELSE '20010db9000000000000' END || printf('%012x', {ip})"
V6 = f"v6 AS (SELECT event_id, number_of_packets * sample_ratio AS packets, {_V6('src_ip')} AS s, {_V6('dst_ip')} AS d FROM ({fx.FLOWS}))"
V6_NETS = [("20010db8000000000000000000000000", 32), ("20010db8000000000000000000000000", 64), ("20010db800000000000000000a000000", 120)]


def v6_flows(spark, sf_dir):
    hexed = lambda c: F.concat(F.when((F.col(c) >= 167772160) & (F.col(c) < 167772672), "20010db8000000000000").otherwise("20010db9000000000000"), F.lower(F.lpad(F.hex(c), 12, "0")))
    return fx.flows(spark, sf_dir).withColumns({"src_ipv6": hexed("src_ip"), "dst_ipv6": hexed("dst_ip"), "ip_protocol_version": F.lit(6)})


def v6_networks(spark):
    return fx.dimension(spark, V6_NETS, "net STRING, len INT")


_BEST6 = lambda c: f"(SELECT max(len) FROM nets WHERE left({c}, len // 4) = left(net, len // 4))"


@query(f"WITH {V6}, nets AS {values(V6_NETS, 'net, len')} SELECT event_id, {_BEST6('s')} AS len FROM v6")
def v6_lpm(spark, sf_dir):
    return enrich.lpm6(v6_flows(spark, sf_dir), v6_networks(spark), "src_ipv6", "net", "len").select("event_id", "len")


@query(f"WITH {V6}, nets AS {values(V6_NETS, 'net, len')}, x AS (SELECT *, {_BEST6('s')} AS sl, {_BEST6('d')} AS dl FROM v6) SELECT CASE WHEN sl IS NOT NULL AND dl IS NOT NULL THEN 'internal' WHEN sl IS NOT NULL THEN 'outgoing' WHEN dl IS NOT NULL THEN 'incoming' ELSE 'other' END AS direction, CAST(sum(packets) AS BIGINT) AS packets, count(*) AS n FROM x GROUP BY 1")
def v6_direction_totals(spark, sf_dir):
    e = enrich.with_direction(v6_flows(spark, sf_dir), v6_networks(spark), v6=True)
    return counters.by_direction(e).select("direction", "packets", F.col("rows").alias("n"))


@query(f"WITH {V6}, nets AS {values(V6_NETS, 'net, len')}, x AS (SELECT *, {_BEST6('s')} AS sl, {_BEST6('d')} AS dl FROM v6), y AS (SELECT CASE WHEN dl IS NULL THEN s ELSE d END AS host, CASE WHEN dl IS NULL THEN 0 ELSE packets END AS i, CASE WHEN dl IS NULL THEN packets ELSE 0 END AS o FROM x WHERE (sl IS NULL) <> (dl IS NULL)) SELECT host, CAST(sum(i) AS BIGINT) AS total_in_packets, CAST(sum(o) AS BIGINT) AS total_out_packets FROM y GROUP BY host ORDER BY total_in_packets DESC, host LIMIT 7")
def v6_top_hosts(spark, sf_dir):
    e = enrich.with_direction(v6_flows(spark, sf_dir), v6_networks(spark), v6=True)
    return counters.by_host(e, v6=True).orderBy(F.desc("total_in_packets"), "host").limit(7).select("host", "total_in_packets", "total_out_packets")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top incoming hosts by averaged packets, with the verdict of their group's thresholds."""
    hosts = averaged_hosts(spark, sf_dir)
    found = detect.detect(hosts, fx.settings(spark)).select("host", "threshold")
    top = report.top_hosts(hosts, "packets", "incoming", fx.TOP)
    return top.join(found, "host", "left").select("host", "ip", F.col("value").alias("average_pps"), F.coalesce("threshold", F.lit("-")).alias("threshold"))


QUERIES["top_hosts_verdict"] = flagship
SQL["top_hosts_verdict"] = BASE + TICKS + HOSTS + SETTINGS + f", v AS (SELECT hosts.host, {VERDICT} AS threshold FROM hosts JOIN s ON host_group = s.grp WHERE s.enable_ban) SELECT h.host, {_IP('h.host')} AS ip, total_in_packets AS average_pps, coalesce(threshold, '-') AS threshold FROM (SELECT * FROM hosts WHERE host <> 0 ORDER BY total_in_packets DESC, host LIMIT {fx.TOP}) h LEFT JOIN v USING (host)"

from . import metrics, wire  # noqa: E402, F401  (they register their queries here)
