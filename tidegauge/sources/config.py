"""Configuration files: key = value settings and prefix lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net


def settings(text: str) -> dict[str, str]:
    """Lines 'key = value'; comments, blank lines and lines that do not split in two are passed over."""
    out = {}
    for line in map(str.strip, text.splitlines()):
        parts = [] if line.startswith("#") else line.split("=")
        if len(parts) == 2:
            out[parts[0].strip()] = parts[1].strip()
    return out


def prefixes(spark: SparkSession, path: str) -> DataFrame:
    """(net, len) of the valid IPv4 prefixes in text files, host bits masked off."""
    lines = spark.read.text(path).select(F.trim("value").alias("p")).where(net.is_cidr(F.col("p")))
    length = F.substring_index("p", "/", -1).cast("int")
    return lines.select(net.network_of(net.ip_number(F.substring_index("p", "/", 1)), length).alias("net"), length.alias("len")).distinct()


def prefixes6(spark: SparkSession, path: str) -> DataFrame:
    """(net, len) of the valid IPv6 prefixes in text files, host bits masked off."""
    lines = spark.read.text(path).select(net.v6_prefix(F.trim("value")).alias("p"))
    return lines.where("p is not null").select("p.net", "p.len").distinct()


def rules(spark: SparkSession, path: str) -> list[str]:
    """The valid traffic rules in text files, one JSON document a line; rules are compiled into the plan, so they come to the driver."""
    from ..operators import rules as parser

    return [r[0] for r in spark.read.text(path).where(F.trim("value") != "").collect() if parser.parse(r[0])]
