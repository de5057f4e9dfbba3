"""Learned state of exporters in batch: the last announced sampling rate, and templates as of a data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def learned_rate(df: DataFrame, exporter: str, order: str, announced: str, fallback: str, out: str, width: int = 1_000_000) -> DataFrame:
    """The exporter's last non-null announced value up to each row, else the row's fallback.

    Rows of one exporter are ranged into buckets of `width` of the order column, so a hot exporter spreads: inside a bucket a
    window carries the value, and each bucket starts from the last value of the buckets before it.
    """
    dealt = df.withColumn("__b", F.floor(F.col(order) / F.lit(width)))
    last = dealt.where(F.col(announced).isNotNull()).groupBy(exporter, "__b").agg(F.max_by(announced, order).alias("__v"))
    w = Window.partitionBy("__e").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    keys = dealt.select(exporter, "__b").distinct().join(last, [exporter, "__b"], "left").withColumnsRenamed({exporter: "__e", "__b": "__p"})
    before = keys.withColumn("__before", F.last("__v", ignorenulls=True).over(w)).select("__e", "__p", "__before")
    inside = F.last(announced, ignorenulls=True).over(Window.partitionBy(exporter, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    joined = dealt.withColumn("__in", inside).join(before, (F.col(exporter).eqNullSafe(F.col("__e"))) & (F.col("__b") == F.col("__p")))
    return joined.withColumn(out, F.coalesce("__in", "__before", F.col(fallback))).drop("__b", "__e", "__p", "__before", "__in")


def as_of(data: DataFrame, versions: DataFrame, keys: list[str], order: Column, payload: str) -> DataFrame:
    """data with the payload of the latest version at or before its order; null where there was none yet.

    versions: keys, since, payload. A key has few versions (changes of one template), so these travel as one array, to every task:
    all data of one key would meet in one task otherwise."""
    arrays = versions.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("since", payload))).alias("__v"))
    fits = F.filter("__v", lambda v: v["since"] <= order)
    return data.join(F.broadcast(arrays), keys, "left").withColumn(payload, F.try_element_at(fits, F.lit(-1))[payload]).drop("__v")


def rate_as_of(data: DataFrame, said: DataFrame, packets: DataFrame, out: str, width: int = 65536 * 1024) -> DataFrame:
    """data (exporter, seq) with its exporter's last rate said at or before it; null where there was none yet.

    said: exporter, seq, record, announced; packets: exporter and seq of all datagrams. A row for each range of `width` of seq, with
    the rate before it and the changes in it, goes to every task; data stays where it is."""
    b = F.floor(F.col("seq") / width).alias("__b")
    w = Window.partitionBy("exporter", "__b").orderBy("seq", "record")
    changes = said.select("*", b).withColumn("__p", F.lag("announced").over(w)).where("__p is null or __p <> announced")
    inside = changes.groupBy("exporter", "__b").agg(F.array_sort(F.collect_list(F.struct("seq", "record", "announced"))).alias("__v"))
    ranges = packets.select("exporter", b).distinct().join(inside, ["exporter", "__b"], "left")
    earlier = Window.partitionBy("exporter").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("__before", F.last(F.element_at("__v", -1)["announced"], ignorenulls=True).over(earlier)).where("__v is not null or __before is not null")
    fits = F.filter("__v", lambda v: v["seq"] <= F.col("seq"))
    joined = data.select("*", b).join(F.broadcast(ranges), ["exporter", "__b"], "left")
    return joined.withColumn(out, F.coalesce(F.try_element_at(fits, F.lit(-1))["announced"], "__before")).drop("__b", "__v", "__before")
