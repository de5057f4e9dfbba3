"""Streams give what batches give."""

import datetime
import time

from pyspark.sql import functions as F
from tidegauge.operators import counters, detect, enrich
from tidegauge.sources import fixtures
from tidegauge.streaming import engine

SF = "/root/testdata/sf0.001"


def drain(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_windowed_counters(spark, tmp_path):
    flows = fixtures.flows(spark, SF)
    flows.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(flows.schema).parquet(str(tmp_path / "in"))
    got = drain(engine.windowed_hosts(stream, fixtures.networks(spark), 3600), "windows", tmp_path, "complete")
    want = counters.by_host(enrich.with_direction(flows, fixtures.networks(spark)).withColumn("tick", counters.tick_of(3600)), ("host", "tick"))
    cols = sorted(want.columns)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


LATER = datetime.datetime(2025, 1, 1)


def play(spark, tmp_path, name, rows, control=None, **how):
    """Events of hosts (sorted) of rows (host, seconds, packets); a row of another host, much later, moves the watermark on."""
    engine.use_rocksdb(spark)
    start = datetime.datetime(2024, 1, 1)
    flows = [(i, start + datetime.timedelta(seconds=s), 4, 3405803776, h, p, p, 1) for i, (h, s, p) in enumerate(rows)]
    flows.append((len(rows), LATER, 4, 3405803776, 167772415, 0, 0, 1))
    schema = "event_id long, arrival_time timestamp, ip_protocol_version int, src_ip long, dst_ip long, number_of_packets long, length long, sample_ratio long"
    for k, part in enumerate((flows[:-1], flows[-1:])):
        spark.createDataFrame(part, schema).repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    if control is not None:
        told = [(h, start + datetime.timedelta(seconds=s), kind) for h, s, kind in control] + [(167772415, LATER, "unban")]
        spark.createDataFrame(told, "host long, arrival_time timestamp, kind string").repartition(1).write.parquet(str(tmp_path / "control"))
        control = spark.readStream.schema("host long, arrival_time timestamp, kind string").parquet(str(tmp_path / "control"))
    base = int(start.replace(tzinfo=datetime.timezone.utc).timestamp())
    got = drain(engine.bans(stream, fixtures.networks(spark), fixtures.hostgroups(spark), how.pop("settings"), how.pop("whitelist", None), control, late="1 seconds", **how), name, tmp_path).collect()
    t = how["tick_seconds"]
    return sorted((r["host"], r["tick"] - base // t, r["event"], r["event_id"]) for r in got if r["host"] != 167772415)


def limits(spark, pps):
    return fixtures.settings(spark).withColumns({"enable_ban": F.lit(True), "pps": F.lit(pps).cast("long"), "mbps": F.lit(None).cast("long")})


def test_bans_equal_the_batch(spark, tmp_path):
    """Instant speeds over the limit, no sample: ban by ban what the batch timeline gives."""
    flows = fixtures.flows(spark, SF)
    far = flows.limit(1).withColumns({"arrival_time": F.lit(LATER), "event_id": F.lit(-1).cast("long"), "dst_ip": F.lit(3232235777).cast("long"), "src_ip": F.lit(3232235777).cast("long")})
    flows.repartition(1).write.parquet(str(tmp_path / "in"))
    time.sleep(1.1)
    home = far.withColumns({"dst_ip": F.lit(167772415).cast("long"), "src_ip": F.lit(3405803776).cast("long"), "number_of_packets": F.lit(0).cast("long")})
    home.select(*[F.col(c).cast(flows.schema[c].dataType).alias(c) for c in flows.columns]).repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    engine.use_rocksdb(spark)
    stream = spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(engine.bans(stream, fixtures.networks(spark), fixtures.hostgroups(spark), limits(spark, 30), None, None, 3600, 1, 7200, 0), "bans", tmp_path).collect()
    t = counters.speed(counters.by_host(enrich.with_direction(flows, fixtures.networks(spark)).withColumn("tick", counters.tick_of(3600)), ("host", "tick")), ["total_in_packets", "total_out_packets"], 3600)
    want = detect.ban_timeline(t.where("total_in_packets > 30 or total_out_packets > 30").select("host", "tick"), 3600, 7200).collect()
    for event, column in (("ban", "banned_tick"), ("unban", "unbanned_tick")):
        assert sorted((r["host"], r["tick"]) for r in got if r["event"] == event) == sorted((r["host"], r[column]) for r in want)
    assert want


A, B, C, D = 167772165, 167772300, 167772160 + 20, 167772160 + 1


def test_ban_of_a_silent_host(spark, tmp_path):
    """Ticks of 10 s: over the limit in tick 0, sample rows in 1, then nothing: unbanned by a timer. B never fills its sample."""
    rows = [(A, 1, 5000), (A, 11, 1), (A, 12, 1), (A, 13, 1), (B, 2, 5000), (B, 12, 1)]
    got = play(spark, tmp_path, "silent", rows, settings=limits(spark, 100), tick_seconds=10, constant=1, ban_seconds=60, sample=2, patience=40)
    assert got == [(A, 0, "detected", None), (A, 1, "ban", None), (A, 1, "sample", 1), (A, 1, "sample", 2), (A, 8, "unban", None), (B, 0, "detected", None), (B, 1, "sample", 5), (B, 5, "expired", None)]


def test_manual_bans_and_the_whitelist(spark, tmp_path):
    rows = [(A, 1, 1), (C, 1, 9000), (D, 1, 9000)]
    control = [(A, 5, "ban"), (A, 500, "unban"), (3232235777, 5, "ban"), (C, 2, "unban")]
    got = play(spark, tmp_path, "manual", rows, control, settings=limits(spark, 100), whitelist=fixtures.whitelist(spark), tick_seconds=10, constant=1, ban_seconds=60, sample=0)
    assert got == [(A, 0, "ban", None), (A, 50, "unban", None), (C, 0, "ban", None), (C, 0, "detected", None), (C, 0, "unban", None), (C, 7, "unban", None)]


def test_properties(spark):
    e = enrich.with_direction(fixtures.flows(spark, SF), fixtures.networks(spark))
    assert counters.by_direction(e).agg(F.sum("rows")).first()[0] == e.count()
    h = counters.by_host(e)
    assert h.where("tcp_in_packets > total_in_packets or udp_out_bytes > total_out_bytes").count() == 0
