"""Metric tables and sinks. Tables are written partitioned by date, so a retention job drops whole folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import net
from ..operators import report
from ..schema import MEASURES


PARTS = ("tcp", "udp", "icmp", "fragmented", "tcp_syn")


def _when(tick_seconds: int) -> list:
    at = F.timestamp_seconds(F.col("tick") * tick_seconds)
    return [at.cast("date").alias("metricDate"), at.alias("metricDateTime")]


def wide_columns(flows: bool = True) -> list[tuple[str, str]]:
    """(name, expression) of the columns of host and network tables, from the measures of a tick. The names."""
    sides = (("incoming", "in"), ("outgoing", "out"))
    out = [(f"{n}_{side}", f"{c}{m}") for n, u, m in (("packets", "packets", ""), ("bits", "bytes", " * 8")) for side, d in sides for c in (f"total_{d}_{u}",)]
    out += [(f"flows_{side}", f"{d}_flows") for side, d in sides] if flows else []
    return out + [(f"{p}_{n}_{side}", f"{p}_{d}_{u}{m}") for n, u, m in (("packets", "packets", ""), ("bits", "bytes", " * 8")) for p in PARTS for side, d in sides]


def total_columns() -> list[tuple[str, str]]:
    """(name, expression) of the columns of total tables. The names."""
    out = [("flows", "flows"), ("packets", "packets"), ("bits", "bytes * 8")]
    return out + [(f"{p}_{n}", f"{p}_{u}{m}") for n, u, m in (("packets", "packets", ""), ("bits", "bytes", " * 8")) for p in (*PARTS, "dropped")]


def metric_table(ticks: DataFrame, tick_seconds: int, name: str, label, columns: list[tuple[str, str]]) -> DataFrame:
    """metricDate, metricDateTime, the key's text under `name`, the columns, schema_version."""
    return ticks.select(*_when(tick_seconds), label.alias(name), *[F.expr(e).alias(c) for c, e in columns], F.lit(1).alias("schema_version"))


def host_metrics(ticks: DataFrame, tick_seconds: int, v6: bool = False) -> DataFrame:
    """ticks: host, tick, measures, in_flows, out_flows."""
    return metric_table(ticks, tick_seconds, "host", net.v6_text(F.col("host")) if v6 else net.ip_text(F.col("host")), wide_columns())


def network_metrics(ticks: DataFrame, tick_seconds: int, v6: bool = False) -> DataFrame:
    """ticks: subnet_net, subnet_len, tick, measures; absent measures (v6 counts totals only) are 0."""
    absent = {m: F.lit(0).cast("long") for m in MEASURES if m not in ticks.columns}
    net_text = F.concat(net.v6_text(F.col("subnet_net")), F.lit("/"), F.col("subnet_len").cast("string")) if v6 else net.cidr_text(F.col("subnet_net"), F.col("subnet_len"))
    return metric_table(ticks.withColumns(absent), tick_seconds, "network", net_text, wide_columns(flows=False))


def total_metrics(totals: DataFrame, tick_seconds: int) -> DataFrame:
    """totals: tick, direction, flows and the sums of counters.totals()."""
    return metric_table(totals, tick_seconds, "direction", F.col("direction"), total_columns())


def system_metrics(counters: DataFrame, tick_seconds: int) -> DataFrame:
    """counters: tick, name, type, value."""
    return counters.select(*_when(tick_seconds), "name", "type", "value", F.lit(1).alias("schema_version"))


def measurement(table: DataFrame, name: str, tag: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """Lines of a metric table: the tag, all its number columns in order of name, the time in nanoseconds."""
    fields = [c for c in table.columns if c not in ("metricDate", "metricDateTime", "schema_version", tag, *skip)]
    return table.select(report.line_protocol(name, {tag: F.col(tag)}, fields, F.col("metricDateTime")).alias("line"))


def paths(table: DataFrame, prefix: str, kind: str, label: str, columns: dict[str, str], zeros: bool = False) -> DataFrame:
    """Lines 'prefix.kind.label.path value seconds' of the columns (column -> path); zeros are left out unless wanted."""
    one = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.col(c).alias("value")) for c, p in columns.items()]))
    rows = table.select(F.col(label).alias("label"), "metricDateTime", one.alias("x"))
    rows = rows if zeros else rows.where("x.value <> 0")
    return rows.select(F.concat_ws(" ", F.concat_ws(".", F.lit(f"{prefix}.{kind}"), F.translate("label", "./", "__"), F.col("x.path")), F.col("x.value").cast("string"), F.unix_timestamp("metricDateTime").cast("string")).alias("line"))


def write_metrics(table: DataFrame, path: str) -> None:
    table.write.mode("append").partitionBy("metricDate").parquet(path)


def expired(table: DataFrame, today, days: int = 7) -> list[str]:
    """The metricDate folders that a retention job may delete."""
    return [str(r[0]) for r in table.where(F.col("metricDate") < F.date_sub(F.lit(today), days)).select("metricDate").distinct().collect()]


def topic_rows(flows: DataFrame, key) -> DataFrame:
    """key, value of each row for a message broker: ready for format('kafka') where its jar is there."""
    return flows.select(key.alias("key"), report.row_json(flows.columns).alias("value"))


def write_rows(flows: DataFrame, path: str) -> None:
    """Every classified row as JSON lines, before any filter."""
    flows.select(report.row_json(flows.columns).alias("value")).write.mode("append").text(path)


def announcements(detected: DataFrame, action: str = "announce") -> DataFrame:
    """Prefixes to announce (or withdraw) for detected hosts: each host, and each subnet once."""
    hosts = detected.select(net.cidr_text(F.col("host"), F.lit(32)).alias("prefix"))
    nets = detected.select(net.cidr_text(F.col("subnet_net"), F.col("subnet_len")).alias("prefix")).distinct()
    return hosts.unionByName(nets).withColumn("action", F.lit(action))


def route_events(bans: DataFrame) -> DataFrame:
    """tick, prefix, action of a ban timeline: an announcement at its start and a withdrawal at its end."""
    prefix = net.cidr_text(F.col("host"), F.lit(32))
    both = F.explode(F.array(*[F.struct(F.col(c).alias("tick"), F.lit(a).alias("action")) for c, a in (("banned_tick", "announce"), ("unbanned_tick", "withdraw"))]))
    return bans.select(prefix.alias("prefix"), both.alias("x")).select("x.tick", "prefix", "x.action")


def attack_json(attacks: DataFrame, action: str = "ban", rows: str | None = None) -> DataFrame:
    """host, value: one JSON document for each attack. attacks: host, host_group, detected_at (a tick or time), measures;
    rows: a column with an array of row documents as JSON text."""
    uuid = F.md5(F.concat_ws("|", F.col("host").cast("string"), F.col("detected_at").cast("string")))
    uuid = F.concat_ws("-", *[F.substring(uuid, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    facts = {"attack_uuid": uuid, "host_group": F.col("host_group"), "protocol_version": F.lit("IPv4")} | report.counters_fields(attacks.columns)
    details = F.to_json(F.struct(*[facts[k].alias(k) for k in sorted(facts)]))
    text = F.concat(F.lit(f'{{"action":"{action}","alert_scope":"host","attack_details":'), details, F.lit(',"ip":"'), net.ip_text(F.col("host")), F.lit('"'))
    dump = F.when(F.col(rows).isNotNull() & (F.col(rows) != "[]"), F.concat(F.lit(',"packet_dump_detailed":'), F.col(rows))).otherwise("") if rows else F.lit("")
    return attacks.select("host", F.concat(text, dump, F.lit("}")).alias("value"))


def notify(attacks: DataFrame, action: str = "ban") -> DataFrame:
    """host, arguments, stdin of the notification hook: address, direction, packets a second and action; the attack's text."""
    arguments = F.array(net.ip_text(F.col("host")), F.col("attack_direction"), F.col("attack_power").cast("string"), F.lit(action))
    return attacks.select("host", arguments.alias("arguments"), report.attack_text(attacks.columns).alias("stdin"))


def key_values(attacks: DataFrame, flows: DataFrame | None = None, prefix: str = "tidegauge") -> DataFrame:
    """key, value: each attack's document; with flows (flow_dump() rows), each host's session lines, too."""
    key = lambda kind: F.concat_ws("_", F.lit(prefix), net.ip_text(F.col("host")), F.lit(kind)).alias("key")
    out = attack_json(attacks).select(key("information"), "value")
    if flows is None:
        return out
    lines = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("position", F.concat_ws(" ", "direction", net.protocol_text(F.col("protocol")), net.ip_text(F.col("remote")), "source_port", "destination_port", "packets", "bytes").alias("line")))), lambda x: x["line"]))
    return out.unionByName(flows.groupBy("host").agg(lines.alias("value")).select(key("flow_dump"), "value"))


def attack_files(attacks: DataFrame, at) -> DataFrame:
    """name, value: the text of each classified attack, under the name of its host and time."""
    name = F.concat(net.ip_text(F.col("host")), F.lit("_"), net.compact_time(at), F.lit(".txt"))
    return attacks.select(name.alias("name"), report.attack_text(attacks.columns).alias("value"))


def write_attacks(attacks: DataFrame, at, path: str) -> None:
    """Each attack's text in a folder of its own name."""
    attack_files(attacks, at).write.mode("append").partitionBy("name").text(path)
