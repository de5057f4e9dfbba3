"""The same transforms on streams: windowed host counters, and one state machine per host for averages and bans."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import counters, detect, enrich

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def windowed_hosts(flows: DataFrame, networks: DataFrame, tick_seconds: int, late: str = "10 seconds") -> DataFrame:
    """Counters of each host and tick. Networks are a static table; rows later than the watermark are dropped."""
    flows = flows.withColumn("arrival_time", F.col("arrival_time").cast("timestamp"))
    df = enrich.with_direction(flows.withWatermark("arrival_time", late), networks).where("host is not null")
    return df.groupBy(F.window("arrival_time", f"{tick_seconds} seconds"), "host").agg(*counters.sums()).withColumn("tick", (F.unix_timestamp("window.start") / tick_seconds).cast("long")).drop("window")


class BanMachine(StatefulProcessor):
    """Per host: averages tick by tick, detection, the sample rows after it, ban and its end. All of it in event time.

    Input rows of a host: tick, in_packets, out_packets, in_bytes, out_bytes, event_id, kind ('flow', 'ban', 'unban'), pps_limit and
    mbps_limit (null: the check is off). Sums wait by tick until the watermark passes the tick's end; a timer folds it then. Timers
    also end bans and captures of hosts that fell silent. Late rows count towards the next tick that is not folded yet. Manual
    bans never end by themselves; a capture that is not full after `patience` seconds is dropped without a ban. A host that is
    idle with averages of zero has no state.
    """

    SUMS = ("in_packets", "out_packets", "in_bytes", "out_bytes")
    STATE = "tick long, a long, b long, c long, d long, phase string, since long, seen int, pps_limit long, mbps_limit long"

    def __init__(self, tick_seconds: int, constant: float, ban_seconds: int, sample: int, patience: int = 120):
        self.seconds, self.keep = tick_seconds, math.exp(-tick_seconds / constant)
        self.ban_ticks, self.sample, self.patience = ban_seconds // tick_seconds, sample, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("host", self.STATE)
        self.waiting = handle.getMapState("waiting", "tick long", "a long, b long, c long, d long, ids array<long>")

    # One host's state while rows or a timer are handled.
    def _load(self) -> None:
        if self.state.exists():
            self.tick, *average, self.phase, self.since, self.seen, self.pps, self.mbps = self.state.get()
            self.average = list(average)
        else:
            self.tick, self.average, self.phase, self.since, self.seen, self.pps, self.mbps = None, [0] * 4, "idle", 0, 0, None, None
        self.out: list[tuple] = []

    def _emit(self, tick: int, event: str, event_id: int | None = None) -> None:
        self.out.append((tick, event, max(self.average[:2]), event_id))

    def _save(self, key, pending: list[int]):
        import pandas as pd

        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        due = pending[:1]
        if self.phase == "banned":
            due.append(max(self.tick, self.since + self.ban_ticks + 1))
        elif self.phase == "capturing":
            due.append(max(self.tick, self.since + self.patience // self.seconds + 1))
        if due:
            self.handle.registerTimer((min(due) + 1) * self.seconds * 1000)
        if self.phase == "idle" and not any(self.average) and not pending:
            self.state.clear()
        else:
            self.state.update((self.tick, *self.average, self.phase, self.since, self.seen, self.pps, self.mbps))
        cols = list(zip(*self.out)) or [[], [], [], []]
        return pd.DataFrame({"host": [key[0]] * len(self.out), "tick": cols[0], "event": pd.Series(list(cols[1]), dtype=object), "average": cols[2], "event_id": pd.Series(list(cols[3]), dtype=object)})

    def _step(self, sums: list[int], ids: list[int]) -> None:
        """Close the tick: averages, then at most one change of phase."""
        t, self.tick = self.tick, self.tick + 1
        for i, x in enumerate(sums):
            speed = int(x / self.seconds)
            self.average[i] = int(speed + self.keep * (self.average[i] - speed))
        over = self.pps is not None and max(self.average[:2]) > self.pps
        over |= self.mbps is not None and max(int(x / 1000 / 1000 * 8) for x in self.average[2:]) > self.mbps
        if self.phase == "capturing":
            for event_id in ids[: self.sample - self.seen]:
                self.seen += 1
                self._emit(t, "sample", event_id)
            if self.seen >= self.sample:
                self.phase, self.since = "banned", t
                self._emit(t, "ban")
            elif (t - self.since) * self.seconds > self.patience:
                self.phase = "idle"
                self._emit(t, "expired")
        elif self.phase == "banned":
            if t - self.since > self.ban_ticks and not over:
                self.phase = "idle"
                self._emit(t, "unban")
        elif self.phase == "idle" and over:
            self.phase, self.since, self.seen = "capturing", t, 0
            self._emit(t, "detected")
            if not self.sample:
                self.phase = "banned"
                self._emit(t, "ban")

    def _fold(self, until: int, pending: list[int]) -> list[int]:
        """Close the ticks before `until`; returns what is still waiting."""
        for t in [*[p for p in pending if p < until], until]:
            while self.tick < t:
                if self.phase in ("idle", "manual") and not any(self.average):
                    self.tick = t
                elif self.phase == "banned" and not any(self.average) and self.tick <= self.since + self.ban_ticks:
                    self.tick = min(t, self.since + self.ban_ticks + 1)
                else:
                    self._step([0] * 4, [])
            if t < until:
                *sums, ids = self.waiting.getValue((t,))
                self.waiting.removeKey((t,))
                self._step(sums, list(ids))
        return [p for p in pending if p >= until]

    def _pending(self) -> list[int]:
        return sorted(k[0] for k in self.waiting.keys())

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        self._load()
        table = pd.concat(list(rows)).sort_values(["arrival_ms", "event_id"], kind="stable")
        for r in table[table["kind"] != "flow"].itertuples():
            self.tick = int(r.tick) if self.tick is None else self.tick
            self.phase, self.since = ("manual", int(r.tick)) if r.kind == "ban" else ("idle", self.since)
            self._emit(int(r.tick), r.kind)
        flows = table[table["kind"] == "flow"]
        if len(flows):
            last = flows.iloc[-1]
            self.pps, self.mbps = (None if pd.isna(last[c]) else int(last[c]) for c in ("pps_limit", "mbps_limit"))
            ticks = flows["tick"] if self.tick is None else flows["tick"].clip(lower=self.tick)
            for t, part in flows.groupby(ticks):
                old = self.waiting.getValue((int(t),)) if self.waiting.containsKey((int(t),)) else (0, 0, 0, 0, [])
                sums = [int(old[i] + part[c].sum()) for i, c in enumerate(self.SUMS)]
                self.waiting.updateValue((int(t),), (*sums, (list(old[4]) + [int(x) for x in part["event_id"]])[: self.sample]))
            if self.tick is None:
                self.tick = int(ticks.min())
        yield self._save(key, self._pending())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self._load()
        if self.tick is None:
            return
        until = timerValues.getCurrentWatermarkInMs() // 1000 // self.seconds  # later timers do not fire in this batch
        yield self._save(key, self._fold(until, self._pending()))

    def close(self) -> None:
        pass


def bans(
    flows: DataFrame, networks: DataFrame, hostgroups: DataFrame, settings: DataFrame, whitelist: DataFrame | None = None, control: DataFrame | None = None,
    tick_seconds: int = 1, constant: float = 15, ban_seconds: int = 1800, sample: int = 20, patience: int = 120, late: str = "10 seconds",
) -> DataFrame:
    """host, tick, event (detected, sample, ban, unban, expired), average, event_id.

    settings: group, enable_ban, pps, mbps; hosts of groups that are off, or of the whitelist, are watched but not detected.
    control: host, arrival_time, kind ('ban' or 'unban'); a ban needs a host of our networks."""
    limits = settings.where("enable_ban").select(F.col("group").alias("__g"), F.col("pps").alias("pps_limit"), F.col("mbps").alias("mbps_limit"))
    at = F.col("arrival_time").cast("timestamp")
    df = enrich.with_direction(flows.withColumn("arrival_time", at).withWatermark("arrival_time", late), networks).where("host is not null")
    df = detect.with_group(df, hostgroups).join(F.broadcast(limits), F.col("host_group") == F.col("__g"), "left")  # a row for each group
    if whitelist is not None:
        df = enrich.lpm(df, whitelist, "host", "__wn", "__wl").withColumns({c: F.when(F.col("__wl").isNull(), F.col(c)) for c in ("pps_limit", "mbps_limit")})
    side = lambda d, u: F.when(F.col("direction") == d, F.col(u)).otherwise(0).cast("long")
    tick, ms = counters.tick_of(tick_seconds).alias("tick"), F.unix_millis("arrival_time").alias("arrival_ms")
    rows = df.select("host", "arrival_time", tick, ms, side("incoming", "packets").alias("in_packets"), side("outgoing", "packets").alias("out_packets"), side("incoming", "bytes").alias("in_bytes"), side("outgoing", "bytes").alias("out_bytes"), F.col("event_id").cast("long").alias("event_id"), F.lit("flow").alias("kind"), F.col("pps_limit").cast("long").alias("pps_limit"), F.col("mbps_limit").cast("long").alias("mbps_limit"))
    if control is not None:
        none = F.lit(0).cast("long")
        mine = enrich.lpm(control.withColumn("arrival_time", at).withWatermark("arrival_time", late), networks, "host", "__n", "__l").where("kind = 'unban' or __l is not null")
        rows = rows.unionByName(mine.select("host", "arrival_time", tick, ms, *[none.alias(c) for c in BanMachine.SUMS], none.alias("event_id"), "kind", F.lit(None).cast("long").alias("pps_limit"), F.lit(None).cast("long").alias("mbps_limit")))
    machine = BanMachine(tick_seconds, constant, ban_seconds, sample, patience)
    return rows.groupBy("host").transformWithStateInPandas(machine, "host long, tick long, event string, average long, event_id long", "Append", "EventTime")
