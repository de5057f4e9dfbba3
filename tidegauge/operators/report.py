"""Top talkers, reports and text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net


def metric(name: str, direction: str) -> str:
    """Column of a sort order: packets, bytes, flows, or a protocol with packets or bytes; unknown names mean packets."""
    side = "in" if direction == "incoming" else "out"
    if name == "flows":
        return f"{side}_flows"
    proto, _, unit = name.rpartition("_")
    if unit in ("packets", "bytes") and proto in ("", "tcp", "udp", "icmp", "fragmented", "tcp_syn", "dropped"):
        return f"{proto or 'total'}_{side}_{unit}"
    return f"total_{side}_packets"


def top_hosts(hosts: DataFrame, order: str = "packets", direction: str = "incoming", k: int = 7) -> DataFrame:
    by = metric(order, direction)
    return hosts.where("host <> 0").orderBy(F.desc(by), "host").limit(k).select("host", net.ip_text(F.col("host")).alias("ip"), F.col(by).alias("value"))


def network_report(subnets: DataFrame) -> DataFrame:
    return subnets.select(net.cidr_text(F.col("subnet_net"), F.col("subnet_len")).alias("network"), *[F.col(f"total_{d}_{u}") for d in ("in", "out") for u in ("packets", "bytes")]).orderBy(F.desc("total_in_packets"), "network")


def flow_dump(sessions: DataFrame, records: int = 20) -> DataFrame:
    w = Window.partitionBy("host").orderBy("direction", "protocol", "remote", "source_port", "destination_port")
    return sessions.withColumn("position", F.row_number().over(w)).where(F.col("position") <= records + 1)


def long_counters(totals: DataFrame, unit: str = "bps") -> DataFrame:
    """(name, value, unit) rows of direction totals (counters.totals() with or without flows); unit: bps, or mbps truncated.

    Flows belong to incoming and outgoing traffic only; protocols follow where the totals have them."""
    rate = lambda c: (F.col(c) * 8 if unit == "bps" else net.mbps(F.col(c))).cast("long")
    rows = [("packets", F.col("packets"), "pps"), ("bits", rate("bytes"), unit)]
    if "flows" in totals.columns:
        rows.append(("flows", F.when(F.col("direction").isin("incoming", "outgoing"), F.col("flows")), "flows"))
    for p in ("tcp", "udp", "icmp", "fragmented", "tcp_syn", "dropped"):
        if f"{p}_packets" in totals.columns:
            rows += [(f"{p} packets", F.col(f"{p}_packets"), "pps"), (f"{p} bits", rate(f"{p}_bytes"), unit)]
    one = F.explode(F.array(*[F.struct(F.lit(n).alias("counter"), v.cast("long").alias("value"), F.lit(u).alias("unit")) for n, v, u in rows]))
    return totals.select("direction", one.alias("x")).where("x.value is not null").select(F.concat_ws(" ", "direction", "x.counter").alias("name"), "x.value", "x.unit")


def screen(totals: DataFrame, hosts: DataFrame, bans: DataFrame, order: str = "packets", k: int = 7) -> DataFrame:
    """The report as (section, position, line): for each direction its total, and for in- and outgoing the top hosts; then the bans.

    totals: direction, packets, bytes, flows. hosts: measures and flows by host. bans: host, banned_tick, unbanned_tick."""
    order_of = {"incoming": 1, "outgoing": 2, "internal": 3, "other": 4}
    place = F.element_at(F.create_map(*[F.lit(x) for p in order_of.items() for x in p]), F.col("direction"))
    flows = F.when(F.col("direction").isin("incoming", "outgoing"), F.concat(F.lit(" "), F.col("flows").cast("string"), F.lit(" flows"))).otherwise("")
    out = totals.select(place.alias("section"), F.lit(0).alias("position"), F.concat(F.initcap("direction"), F.lit(" traffic "), F.col("packets").cast("string"), F.lit(" pps "), net.mbps(F.col("bytes")).cast("string"), F.lit(" mbps"), flows).alias("line"))
    for name, d in (("incoming", "in"), ("outgoing", "out")):
        by = metric(order, name)
        top = hosts.where("host <> 0").orderBy(F.desc(by), "host").limit(k).withColumn("position", F.row_number().over(Window.orderBy(F.desc(by), "host")))  # k rows
        line = F.concat_ws(" ", net.ip_text(F.col("host")), F.col(f"total_{d}_packets").cast("string"), F.lit("pps"), net.mbps(F.col(f"total_{d}_bytes")).cast("string"), F.lit("mbps"), F.col(f"{d}_flows").cast("string"), F.lit("flows"))
        out = out.unionByName(top.select(F.lit(order_of[name]).alias("section"), "position", line.alias("line")))
    text = F.concat_ws(" ", net.ip_text(F.col("host")), F.lit("banned at tick"), F.col("banned_tick").cast("string"), F.lit("until"), F.col("unbanned_tick").cast("string"))
    return out.unionByName(bans.select(F.lit(5).alias("section"), F.lit(0).alias("position"), text.alias("line")))


def row_text() -> Column:
    return F.concat_ws(" ", F.concat(net.ip_text(F.col("src_ip")), F.lit(":"), F.col("source_port").cast("string")), F.lit(">"), F.concat(net.ip_text(F.col("dst_ip")), F.lit(":"), F.col("destination_port").cast("string")), F.lit("protocol:"), net.protocol_text(F.col("protocol")), F.lit("flags:"), net.tcp_flags_text(F.col("flags")), F.lit("packets:"), F.col("number_of_packets").cast("string"), F.lit("size:"), F.col("length").cast("string"))


def row_json(have: list[str], v6: bool = False) -> Column:
    """A row as a JSON document, keys in order of name. Ports for tcp and udp only, flags for tcp only. The keys."""
    ported, tcp = F.col("protocol").isin(6, 17), F.col("protocol") == 6
    ip = lambda c: net.v6_text(F.col(f"{c}_ipv6")) if v6 else net.ip_text(F.col(f"{c}_ip"))
    country = lambda c: F.when(F.length(c) == 2, F.col(c)).otherwise("") if c in have else F.lit("")
    keys = {
        "timestamp": F.unix_timestamp("arrival_time"), "ip_version": F.lit("ipv6" if v6 else "ipv4"), "source_ip": ip("src"), "destination_ip": ip("dst"),
        "source_asn": F.col("src_asn"), "destination_asn": F.col("dst_asn"), "source_country": country("src_country"), "destination_country": country("dst_country"),
        "input_interface": F.col("input_interface"), "output_interface": F.col("output_interface"), "source_port": F.when(ported, F.col("source_port")),
        "destination_port": F.when(ported, F.col("destination_port")), "agent_address": net.ip_text(F.col("agent_ipv4_address")), "tcp_flags": F.when(tcp, net.tcp_flags_text(F.col("flags"))),
        "forwarding_status": F.col("forwarding_status"), "fragmentation": F.col("ip_fragmented"), "packets": F.col("number_of_packets"), "length": F.col("length"), "ip_length": F.col("ip_length"),
        "ttl": F.col("ttl"), "sample_ratio": F.col("sample_ratio"), "protocol": net.protocol_text(F.col("protocol")),
    }
    return F.to_json(F.struct(*[keys[k].alias(k) for k in sorted(keys)]))


def rows_json(rows: DataFrame, key: str, order: str) -> DataFrame:
    """key, rows: a JSON array of each key's rows in order; for samples and other bounded groups."""
    one = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row_json(rows.columns).alias("j")))), lambda x: x["j"])
    return rows.groupBy(key).agg(F.concat(F.lit("["), F.concat_ws(",", one), F.lit("]")).alias("rows"))


def counters_fields(have: list[str]) -> dict[str, Column]:
    """The counters of an attack or report document; measures that are not in `have` are 0. The keys."""
    of = lambda c: F.col(c) if c in have else F.lit(0).cast("long")
    out = {}
    for side, d in (("incoming", "in"), ("outgoing", "out")):
        for proto, name in (("total", None), ("dropped", "dropped"), ("fragmented", "ip_fragmented"), ("tcp", "tcp"), ("tcp_syn", "syn_tcp"), ("udp", "udp"), ("icmp", "icmp")):
            head = f"{side}_{name}" if name else f"total_{side}"
            out |= {f"{head}_traffic": of(f"{proto}_{d}_bytes"), f"{head}_traffic_bits": of(f"{proto}_{d}_bytes") * 8, f"{head}_pps": of(f"{proto}_{d}_packets")}
        out[f"total_{side}_flows"] = of(f"{d}_flows")
    return out


def counters_json(have: list[str]) -> Column:
    fields = counters_fields(have)
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def line_protocol(measurement: str, tags: dict[str, Column], fields: list[str], at: Column) -> Column:
    """measurement,tag=v field=1,... ns; keys in order."""
    head = F.concat_ws(",", F.lit(measurement), *[F.concat(F.lit(f"{k}="), tags[k]) for k in sorted(tags)])
    body = F.concat_ws(",", *[F.concat(F.lit(f"{f}="), F.col(f).cast("string")) for f in sorted(fields)])
    return F.concat_ws(" ", head, body, (F.unix_timestamp(at) * 1000000000).cast("string"))


def graphite(prefix: str, path: Column, name: str, value: Column, at: Column) -> Column:
    return F.concat_ws(" ", F.concat_ws(".", F.lit(prefix), F.translate(path, "./", "__"), F.lit(name)), value.cast("string"), F.unix_timestamp(at).cast("string"))


def prometheus(totals: DataFrame, version: str = "ipv4", prefix: str = "tidegauge") -> DataFrame:
    """Gauge lines of direction totals: packets, bits and, for incoming and outgoing v4 traffic, flows."""
    line = lambda n, c: F.concat(F.lit(f'{prefix}_total_traffic_{n}{{traffic_direction="'), F.col("direction"), F.lit(f'",protocol_version="{version}"}} '), c.cast("string"))
    lines = [line("packets", F.col("packets")), line("bits", F.col("bytes") * 8)]
    if version == "ipv4" and "flows" in totals.columns:
        lines.append(F.when(F.col("direction").isin("incoming", "outgoing"), line("flows", F.col("flows"))))
    return totals.select(F.explode(F.array_compact(F.array(*lines))).alias("line"))


def prometheus_counters(counters: DataFrame, prefix: str = "tidegauge") -> DataFrame:
    """A type line and a value line for each (name, type, value)."""
    name = F.concat(F.lit(f"{prefix}_"), "name")
    return counters.select(F.explode(F.array(F.concat_ws(" ", F.lit("# TYPE"), name, "type"), F.concat_ws(" ", name, F.col("value").cast("string")))).alias("line"))


def attack_fields() -> list[tuple[str, str, str]]:
    """(label, column, unit) of the speeds in an attack's text, in their order. The labels."""
    out = [(f"Total {n} traffic", f"total_{d}_bytes", "mbps") for d, n in (("in", "incoming"), ("out", "outgoing"))]
    out += [(f"Total {n} pps", f"total_{d}_packets", "packets per second") for d, n in (("in", "incoming"), ("out", "outgoing"))]
    out += [(f"Total {n} flows", f"{d}_flows", "flows per second") for d, n in (("in", "incoming"), ("out", "outgoing"))]
    for proto, label in (("fragmented", "ip fragmented"), ("dropped", "dropped"), ("tcp", "tcp"), ("tcp_syn", "syn tcp"), ("udp", "udp"), ("icmp", "icmp")):
        for word, unit, column in (("traffic", "mbps", "bytes"), ("pps", "packets per second", "packets")):
            out += [(f"{n} {label} {word}", f"{proto}_{d}_{column}", unit) for d, n in (("in", "Incoming"), ("out", "Outgoing"))]
    return out


def attack_text(have: list[str]) -> Column:
    """The description of a classified attack, one fact a line; speeds whose columns are not in `have` are left out."""
    lines = [F.concat(F.lit("Attack type: "), "attack_type"), F.concat(F.lit("Initial attack power: "), F.col("attack_power").cast("string"), F.lit(" packets per second"))]
    lines += [F.concat(F.lit("Attack direction: "), "attack_direction"), F.concat(F.lit("Attack protocol: "), "attack_protocol")]
    for label, column, unit in attack_fields():
        if column in have:
            value = net.mbps(F.col(column)) if unit == "mbps" else F.col(column)
            lines.append(F.concat(F.lit(f"{label}: "), value.cast("string"), F.lit(f" {unit}")))
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))
