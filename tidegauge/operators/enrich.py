"""Longest-prefix match, direction, filters, host keys."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net


def lengths_of(networks: DataFrame) -> list[int]:
    """The distinct prefix lengths, longest first: 33 at most."""
    return sorted((r[0] for r in networks.select("len").distinct().collect()), reverse=True)


def lpm(df: DataFrame, networks: DataFrame, ip: str, net_out: str, len_out: str, payload: str | None = None) -> DataFrame:
    """The longest network (net, len) that holds df[ip]; nulls where there is none. payload: a column to carry along.

    One equality join for each distinct length on the masked address: rows are neither multiplied nor, where the networks
    fit Spark's broadcast limit, shuffled.
    """
    found = []
    for length in lengths_of(networks):
        mine = networks.where(F.col("len") == length).groupBy("net").agg(F.first(payload or "len").alias(f"__p{length}")).withColumnRenamed("net", f"__n{length}")
        df = df.join(mine, net.network_of(F.col(ip), length) == F.col(f"__n{length}"), "left")
        found.append(length)
    if not found:
        return df.withColumns({net_out: F.lit(None).cast("long"), len_out: F.lit(None).cast("int")})
    has = lambda l: F.col(f"__p{l}").isNotNull() if payload is None else F.col(f"__n{l}").isNotNull()
    best_net = F.coalesce(*[F.when(has(l), F.col(f"__n{l}")) for l in found])
    best_len = F.coalesce(*[F.when(has(l), F.lit(l)) for l in found])
    out = df.withColumns({net_out: best_net, len_out: best_len} | ({payload: F.coalesce(*[F.when(has(l), F.struct(F.col(f"__p{l}").alias("v"))) for l in found])["v"]} if payload else {}))
    return out.drop(*[f"__{k}{l}" for l in found for k in "np"])


def lpm6(df: DataFrame, networks: DataFrame, ip: str, net_out: str, len_out: str) -> DataFrame:
    """As lpm, for 32 hex digit v6 addresses: joins on the masked 32-bit parts that a length reaches."""
    df = df.withColumns({f"__a{i}": p for i, p in enumerate(net.v6_parts(F.col(ip)))})
    found = []
    for length in lengths_of(networks):
        parts = range(max(1, -(-length // 32)))
        mine = networks.where(F.col("len") == length).select(*[net.masked_part(p, length, i).alias(f"__k{length}_{i}") for i, p in enumerate(net.v6_parts(F.col("net"))) if i in parts], F.col("net").alias(f"__n{length}"))
        keys = [f"__k{length}_{i}" for i in parts]
        same = reduce(and_, [net.masked_part(F.col(f"__a{i}"), length, i) == F.col(k) for i, k in zip(parts, keys)])
        df = df.join(mine.dropDuplicates(keys), same, "left").drop(*keys)
        found.append(length)
    none = F.lit(None).cast("string")
    out = df.withColumns({net_out: F.coalesce(*[F.col(f"__n{l}") for l in found], none), len_out: F.coalesce(*[F.when(F.col(f"__n{l}").isNotNull(), F.lit(l)) for l in found], F.lit(None).cast("int"))})
    return out.drop(*[f"__n{l}" for l in found], *[f"__a{i}" for i in range(4)])


def inside(df: DataFrame, networks: DataFrame, ip: str, how: str = "semi") -> DataFrame:
    """Rows whose address is (how='anti': is not) in a network."""
    cols = df.columns
    marked = lpm(df, networks, ip, "__net", "__len")
    return marked.where(F.col("__len").isNotNull() if how == "semi" else F.col("__len").isNull()).select(*cols)


def with_direction(flows: DataFrame, networks: DataFrame, v6: bool = False) -> DataFrame:
    """direction, host (own address), subnet_net, subnet_len, packets and bytes (sampled)."""
    match, src, dst = (lpm6, "src_ipv6", "dst_ipv6") if v6 else (lpm, "src_ip", "dst_ip")
    df = match(match(flows, networks, src, "__sn", "__sl"), networks, dst, "__dn", "__dl")
    s, d = F.col("__sl").isNotNull(), F.col("__dl").isNotNull()
    direction = F.when(s & d, "internal").when(s, "outgoing").when(d, "incoming").otherwise("other")
    df = df.withColumn("direction", direction)
    pick = lambda a, b: F.when(F.col("direction") == "outgoing", F.col(a)).when(F.col("direction") == "incoming", F.col(b))
    df = df.withColumns({"host": pick(src, dst), "subnet_net": pick("__sn", "__dn"), "subnet_len": pick("__sl", "__dl")})
    return df.withColumns({"packets": F.col("number_of_packets") * F.col("sample_ratio"), "bytes": F.col("length") * F.col("sample_ratio")}).drop("__sn", "__sl", "__dn", "__dl")


def accounted(df: DataFrame, rules: Column | None = None, incoming: bool = True, outgoing: bool = True) -> DataFrame:
    """What the counters see: rules drop in- and outgoing rows first, then directions that are switched off go."""
    ours = F.col("direction").isin("incoming", "outgoing")
    if rules is not None:
        df = df.where(~(ours & rules))
    off = [d for d, on in (("incoming", incoming), ("outgoing", outgoing)) if not on]
    return df.where(~F.col("direction").isin(*off)) if off else df


def split_bidirectional(df: DataFrame) -> DataFrame:
    """Rows with no packets and bytes but a flow id are two: forward counters, and swapped ends with reverse counters.

    Expects flow_id, fwd_bytes, fwd_packets, rev_bytes, rev_packets beside the flow columns.
    """
    two = (F.col("length") == 0) & (F.col("number_of_packets") == 0) & (F.col("flow_id") != 0)
    swap = {"src_ip": "dst_ip", "dst_ip": "src_ip", "source_port": "destination_port", "destination_port": "source_port", "src_asn": "dst_asn", "dst_asn": "src_asn", "input_interface": "output_interface", "output_interface": "input_interface"}
    counts = {"length": ("fwd_bytes", "rev_bytes"), "ip_length": ("fwd_bytes", "rev_bytes"), "number_of_packets": ("fwd_packets", "rev_packets")}

    def version(k: int) -> Column:
        return F.struct(*[F.col(counts[c][k] if c in counts else swap.get(c, c) if k else c).cast(df.schema[c].dataType).alias(c) for c in df.columns])

    same = F.struct(*[F.col(c) for c in df.columns])
    return df.select(F.explode(F.when(two, F.array(version(0), version(1))).otherwise(F.array(same))).alias("r")).select("r.*")
