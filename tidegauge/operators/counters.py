"""Counters by host, subnet and direction, flow counts, speeds and their exponential averages."""

from __future__ import annotations

import math
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MEASURES, PROTOS


def tick_of(seconds: int) -> Column:
    return F.floor(F.unix_timestamp("arrival_time") / seconds).cast("long")


def _condition(proto: str, v6: bool) -> Column:
    p = F.col("protocol")
    return {"total": F.lit(True), "tcp": p == 6, "udp": p == 17, "icmp": p == (58 if v6 else 1), "fragmented": F.col("ip_fragmented"), "tcp_syn": (p == 6) & (F.col("flags").bitwiseAND(2) != 0), "dropped": F.col("forwarding_status") == "dropped"}[proto]


def sums(protos: tuple[str, ...] = PROTOS, v6: bool = False) -> list[Column]:
    """Conditional sums of sampled packets and bytes for both directions."""
    out = []
    for p in protos:
        for d, name in (("in", "incoming"), ("out", "outgoing")):
            on = _condition(p, v6) & (F.col("direction") == name)
            out += [F.sum(F.when(on, F.col(u)).otherwise(0)).alias(f"{p}_{d}_{u}") for u in ("bytes", "packets")]
    return out


def by_host(df: DataFrame, keys: tuple[str, ...] = ("host",), v6: bool = False) -> DataFrame:
    return df.where("host is not null").groupBy(*keys).agg(*sums(v6=v6))


def by_subnet(df: DataFrame, keys: tuple[str, ...] = (), v6: bool = False) -> DataFrame:
    """v6 counts totals only."""
    rows = df.where("subnet_len is not null")
    return rows.groupBy(*keys, "subnet_net", "subnet_len").agg(*sums(("total",) if v6 else PROTOS, v6))


def by_rule(df: DataFrame, rules: dict[str, Column], keys: tuple[str, ...] = ("host",)) -> DataFrame:
    """Sums of both directions for each named rule; a row counts towards every rule that it matches."""
    sums = [F.sum(F.when(on & (F.col("direction") == n), F.col(u)).otherwise(0)).alias(f"{name}_{d}_{u}") for name, on in rules.items() for d, n in (("in", "incoming"), ("out", "outgoing")) for u in ("bytes", "packets")]
    return df.where("host is not null").groupBy(*keys).agg(*sums)


def by_direction(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*keys, "direction").agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def totals(df: DataFrame, keys: tuple[str, ...] = (), v6: bool = False) -> DataFrame:
    """Packets and bytes of each direction, of all rows and by protocol."""
    sums = [F.sum(F.when(_condition(p, v6), F.col(u)).otherwise(0)).alias(u if p == "total" else f"{p}_{u}") for p in PROTOS for u in ("packets", "bytes")]
    return df.groupBy(*keys, "direction").agg(*sums)


def both_versions(*parts: DataFrame) -> DataFrame:
    """Totals of one shape (v4 and v6) added up."""
    keys = [c for c in parts[0].columns if c in ("tick", "direction")]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in every.columns if c not in keys])


def sessions(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums by session of tcp and udp: host, direction, protocol, the other address and both ports."""
    other = F.when(F.col("direction") == "outgoing", F.col("dst_ip")).otherwise(F.col("src_ip"))
    rows = df.where("host is not null and protocol in (6, 17)").withColumn("remote", other)
    return rows.groupBy(*keys, "host", "direction", "protocol", "remote", "source_port", "destination_port").agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))


def flow_counts(df: DataFrame, keys: tuple[str, ...] = ("tick",)) -> DataFrame:
    """Distinct sessions of a host in each tick: in_flows, out_flows. Sessions are made distinct before hosts are grouped,
    so a host with most sessions does not meet in one task until they are counts."""
    once = sessions(df, keys)
    one = lambda d: F.sum(F.when(F.col("direction") == d, 1).otherwise(0)).cast("long")
    return once.groupBy(*keys, "host").agg(one("incoming").alias("in_flows"), one("outgoing").alias("out_flows"))


def speed(df: DataFrame, columns: list[str], period: float) -> DataFrame:
    return df.withColumns({c: (F.col(c) / F.lit(float(period))).cast("long") for c in columns})


def step(new: Column, average: Column, keep: float) -> Column:
    """One exponential average step, truncated."""
    return (new.cast("double") + F.lit(keep) * (average.cast("double") - new.cast("double"))).cast("long")


def ema(ticks: DataFrame, key: str, columns: list[str], period: int, constant: int, last_tick: int | Column) -> DataFrame:
    """Averages of per-second speeds at last_tick, as if every tick from a key's first one had been counted (zeros between).

    ticks: key, tick and columns (sums in the tick). Each key folds over its own non-empty ticks, with the empty ones in
    between stepped inside the fold, so nothing is padded.
    """
    keep = math.exp(-period / constant)
    rows = speed(ticks, columns, period).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("tick", *columns))).alias("__s"))
    fade = lambda value, gaps: F.when((gaps > 0) & (value > 0), F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(gaps, F.lit(1).cast("long"))), value, lambda a, _: step(F.lit(0).cast("long"), a, keep))).otherwise(value)
    start = F.struct(F.element_at("__s", 1)["tick"].alias("tick"), *[F.lit(0).cast("long").alias(c) for c in columns])

    def merge(acc, x):
        return F.struct(x["tick"].alias("tick"), *[step(x[c], fade(acc[c], x["tick"] - acc["tick"] - 1), keep).alias(c) for c in columns])

    end = F.lit(last_tick) if isinstance(last_tick, int) else last_tick
    folded = rows.withColumn("__a", F.aggregate("__s", start, merge)).withColumn("__end", end)
    return folded.select(key, *[fade(F.col(f"__a.{c}"), F.col("__end") - F.col("__a.tick")).alias(c) for c in columns])


def in_order(df: DataFrame, key: str, order: str, schema: str, walk) -> DataFrame:
    """The rows that walk(rows) yields, over the rows of each task as tuples, all rows of a key together and in order.

    Rows stream through: a key may have any number, and only what walk carries is held."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        import pandas as pd

        rows = (r for b in batches for r in b.itertuples(index=False, name=None))
        found = walk(rows)
        while out := list(islice(found, 10_000)):
            yield pd.DataFrame(out, columns=names)

    return df.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def ema_series(ticks: DataFrame, key: str, column: str, period: int, constant: int, first: int, last: int) -> DataFrame:
    """key, tick, speed, average for every tick in [first, last], zeros where a key has none."""
    keep = math.exp(-period / constant)

    def walk(rows):
        now, at, average = None, first, 0

        def steps(until, value):
            nonlocal at, average
            while at < until:
                speed = int(value / period) if at == until - 1 else 0
                average = int(speed + keep * (average - speed))
                yield now, at, speed, average
                at += 1

        for k, tick, value in rows:
            if k != now:
                if now is not None:
                    yield from steps(last + 1, 0)
                now, at, average = k, first, 0
            yield from steps(tick + 1, value)
        if now is not None:
            yield from steps(last + 1, 0)

    kind = ticks.schema[key].dataType.simpleString().replace("bigint", "long")
    return in_order(ticks.select(key, F.col("tick").cast("long"), F.col(column).cast("long")), key, "tick", f"{key} {kind}, tick long, speed long, average long", walk)


def busy(df: DataFrame) -> DataFrame:
    """Rows with any total counter or flow."""
    cols = [c for c in ("total_in_bytes", "total_out_bytes", "total_in_packets", "total_out_packets", "in_flows", "out_flows") if c in df.columns]
    some = F.lit(False)
    for c in cols:
        some = some | (F.col(c) != 0)
    return df.where(some)


def peaks(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in MEASURES if c in df.columns])


def deltas(df: DataFrame, keys: tuple[str, ...], column: str) -> DataFrame:
    return df.withColumn("delta", F.col(column) - F.coalesce(F.lag(column).over(Window.partitionBy(*keys).orderBy("tick")), F.lit(0)))


_V5 = [(15, "0-15"), (30, "16-30"), (60, "31-60"), (90, "61-90"), (180, "91-180")]
_V9 = [(1, "0-1"), (2, "2"), (3, "3"), (5, "4-5"), (10, "6-10"), (15, "11-15"), (30, "16-30"), (60, "31-60"), (90, "61-90"), (180, "91-180")]


def duration_bucket(seconds: Column, kind: str = "v9") -> Column:
    """v5: <=15 .. >180; v9 and ipfix: 0, <=1 .. >180 (ipfix names negative ones)."""
    out = F.when((seconds < 0), "negative") if kind == "ipfix" else F.when(F.lit(False), "")
    if kind != "v5":
        out = out.when(seconds == 0, "0")
    for most, name in _V5 if kind == "v5" else _V9:
        out = out.when(seconds <= most, name)
    return out.otherwise("180+")


def system(rows: DataFrame, period: float, keys: tuple[str, ...] = ("tick",)) -> DataFrame:
    """keys, name, type, value of what was seen: rows by IP version, rows of other protocols and their rate."""
    version, other = F.col("ip_protocol_version"), ~F.col("protocol").isin(1, 6, 17, 58)
    n = lambda on: F.count_if(on)
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("a"), n(version == 4).alias("b"), n(version == 6).alias("c"), n(~version.isin(4, 6)).alias("d"), n(other).alias("e"))
    one = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), value.cast("long").alias("value")) for name, kind, value in (
        ("total_simple_packets_processed", "counter", F.col("a")), ("total_ipv4_packets", "counter", F.col("b")), ("total_ipv6_packets", "counter", F.col("c")), ("unknown_ip_version_packets", "counter", F.col("d")),
        ("total_unparsed_packets", "counter", F.col("e")), ("total_unparsed_packets_speed", "gauge", F.col("e") / float(period)),
    )]))
    return found.select(*keys, one.alias("x")).select(*keys, "x.name", "x.type", "x.value")
