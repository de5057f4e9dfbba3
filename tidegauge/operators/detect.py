"""Thresholds, attack classification, samples and bans: pure projections and joins over averaged speeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.net import mbps
from .counters import in_order

#: In the order in which they are tested; the first that is exceeded names the attack.
CHECKS = [("pps", "total", "packets"), ("mbps", "total", "bytes"), ("flows", None, None), ("tcp_pps", "tcp", "packets"), ("udp_pps", "udp", "packets"), ("icmp_pps", "icmp", "packets"), ("tcp_mbps", "tcp", "bytes"), ("udp_mbps", "udp", "bytes"), ("icmp_mbps", "icmp", "bytes")]
NAMES = {"pps": "packets per second", "mbps": "bytes per second", "flows": "flows per second", "tcp_pps": "tcp packets per second", "udp_pps": "udp packets per second", "icmp_pps": "icmp packets per second", "tcp_mbps": "tcp bytes per second", "udp_mbps": "udp bytes per second", "icmp_mbps": "icmp bytes per second"}


def exceeded(thresholds: dict[str, Column | int | None]) -> Column:
    """Name of the first check whose speed, in or out, is above its threshold (null threshold: check off)."""
    out = F.when(F.lit(False), "")
    for name, proto, unit in CHECKS:
        if thresholds.get(name) is None:
            continue
        most = thresholds[name] if isinstance(thresholds[name], Column) else F.lit(thresholds[name])
        pair = [F.col("in_flows"), F.col("out_flows")] if proto is None else [F.col(f"{proto}_{d}_{unit}") for d in ("in", "out")]
        if unit == "bytes":
            pair = [mbps(c) for c in pair]
        out = out.when((pair[0] > most) | (pair[1] > most), name)
    return out


def with_group(hosts: DataFrame, hostgroups: DataFrame) -> DataFrame:
    """The group of a host's own subnet, matched exactly on (net, len); 'global' otherwise. A subnet has one group, its first."""
    groups = hostgroups.groupBy("net", "len").agg(F.min(F.struct("position", "group")).alias("g")).select(F.col("net").alias("__n"), F.col("len").alias("__l"), F.col("g.group").alias("__g"))
    return hosts.join(groups, (F.col("subnet_net") == F.col("__n")) & (F.col("subnet_len") == F.col("__l")), "left").withColumn("host_group", F.coalesce("__g", F.lit("global"))).drop("__n", "__l", "__g")


def threshold_text(name: Column) -> Column:
    """What a threshold measures, in words; unknown for other names."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in NAMES.items() for x in p]), name), F.lit("unknown"))


def detect_v6(hosts: DataFrame, settings: DataFrame) -> DataFrame:
    """v6 hosts over a threshold of the global group, if that allows v6 bans (enable_ban_ipv6); host_group is always global."""
    own = settings.where("group = 'global' and enable_ban_ipv6").withColumn("enable_ban", F.lit(True))
    return detect(hosts.withColumn("host_group", F.lit("global")), own)


def detect(hosts: DataFrame, settings: DataFrame) -> DataFrame:
    """hosts (with host_group) whose group allows bans and a threshold is exceeded; groups without settings use 'global'.

    settings: group, enable_ban and a threshold column for each check (null: off)."""
    named = [c for c, _, _ in CHECKS if c in settings.columns]
    own = settings.select(F.col("group").alias("__g"), F.struct("enable_ban", *named).alias("__own"))
    fallback = settings.where("group = 'global'").select(F.struct("enable_ban", *named)).limit(1)
    joined = hosts.join(own, F.col("host_group") == F.col("__g"), "left").withColumn("__all", fallback.scalar())
    joined = joined.withColumn("__s", F.coalesce("__own", "__all"))
    verdict = exceeded({c: F.col(f"__s.{c}") for c in named})
    return joined.where("__all.enable_ban and __s.enable_ban").withColumn("threshold", verdict).where("threshold is not null").drop("__g", "__own", "__all", "__s")


def classified(hosts: DataFrame) -> DataFrame:
    """attack_direction, attack_power, attack_protocol, attack_type."""
    gap = F.abs(F.col("total_in_packets") - F.col("total_out_packets"))
    towards = F.when(gap < 1000, F.when(F.col("total_in_bytes") > F.col("total_out_bytes"), "incoming").otherwise("outgoing")).otherwise(F.when(F.col("total_in_packets") > F.col("total_out_packets"), "incoming").otherwise("outgoing"))
    df = hosts.withColumn("attack_direction", towards)
    side = lambda p: F.when(F.col("attack_direction") == "incoming", F.col(f"{p}_in_packets")).otherwise(F.col(f"{p}_out_packets"))
    most = F.greatest(side("tcp"), side("udp"), side("icmp"))
    protocol = F.when(side("tcp") == most, "tcp").when(side("udp") == most, "udp").otherwise("icmp")
    share = lambda p: side(p).cast("double") / side("total").cast("double") > 0.9
    kind = F.when(side("total") == 0, "unknown").when(share("tcp_syn"), "syn_flood").when(share("icmp"), "icmp_flood").when(share("fragmented"), "ip_fragmentation").when(share("udp"), "udp_flood").otherwise("unknown")
    return df.withColumns({"attack_power": side("total"), "attack_protocol": protocol, "attack_type": kind, "attack_detection_direction": F.lit("unknown")})


def free_to_ban(detected: DataFrame, *taken: DataFrame) -> DataFrame:
    """Detected hosts that no table of hosts (bans, captures under way) has already."""
    for hosts in taken:
        detected = detected.join(hosts.select("host").distinct(), "host", "left_anti")
    return detected


def sample(flows: DataFrame, detections: DataFrame, count: int = 20, patience: int = 120) -> DataFrame:
    """The next `count` rows of each detected host after its detection, where these came within `patience` seconds.

    flows: host, arrival_time, event_id. detections: host, detected_at."""
    rows = flows.join(detections, "host").where("arrival_time > detected_at and unix_timestamp(arrival_time) <= unix_timestamp(detected_at) + " + str(patience))
    numbered = rows.withColumn("position", F.row_number().over(Window.partitionBy("host").orderBy("arrival_time", "event_id"))).where(F.col("position") <= count)
    full = numbered.where(F.col("position") == count).select("host")
    return numbered.join(full, "host", "left_semi")


def ban_timeline(attacked: DataFrame, tick_seconds: int, ban_seconds: int) -> DataFrame:
    """Bans (host, banned_tick, unbanned_tick) from ticks in which a host exceeds a threshold.

    A ban ends at the first tick more than ban_seconds after its start in which the host no longer exceeds; ticks during a ban start none.
    attacked: host, tick. One pass over each host's own attacked ticks, in order."""
    hold = ban_seconds // tick_seconds + 1

    def walk(rows):
        now, start, end = None, 0, 0
        for host, tick in rows:
            if host == now and tick <= end:
                end = tick + 1 if tick == end else end
                continue
            if now is not None:
                yield now, start, end
            now, start, end = host, tick, tick + hold
        if now is not None:
            yield now, start, end

    return in_order(attacked.select(F.col("host").cast("long"), F.col("tick").cast("long")), "host", "tick", "host long, banned_tick long, unbanned_tick long", walk)


def banlist(v4: DataFrame, v6: DataFrame) -> DataFrame:
    """prefix, version, banned_tick of active bans: v4 hosts as /32, v6 hosts as /128."""
    from ..functions import net

    first = v4.select(net.cidr_text(F.col("host"), F.lit(32)).alias("prefix"), F.lit(4).alias("version"), "banned_tick")
    return first.unionByName(v6.select(F.concat(net.v6_text(F.col("host")), F.lit("/128")).alias("prefix"), F.lit(6).alias("version"), "banned_tick"))


def active_bans(bans: DataFrame, tick: int) -> DataFrame:
    """The bans of a timeline that hold at a tick."""
    return bans.where((F.col("banned_tick") <= tick) & (F.col("unbanned_tick") > tick))
