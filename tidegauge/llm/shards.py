"""Sharding by best-fit-decreasing bin packing of indivisible groups (equal texts).

Groups of one weight are interchangeable, so packing works on (weight, count) classes. Groups lighter than the total over
`heavy` are first put into `bundles` by hash, whole, and a bundle is packed as one item: at most `heavy` groups and all bundles
reach the driver, whatever the input. Sizes of shards then differ by about a bundle, total / bundles. Groups and documents stay
distributed.

Edge cases: null text counts as empty (size 1, crc32 0) and shares the group of empty texts; equal texts stay in one
shard even if a group outweighs the mean shard, whose shard then takes nothing else while others stay even; repeated rows
get a slot each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


class CapacityTree:
    """A treap of (remaining capacity, bin): least entry at or above a capacity in O(log bins)."""

    def __init__(self):
        self.root, self._seed = None, 88172645463325252

    def _priority(self) -> int:
        x = self._seed
        x ^= (x << 13) & (2**64 - 1)
        x ^= x >> 7
        x ^= (x << 17) & (2**64 - 1)
        self._seed = x
        return x

    def add(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, [key, self._priority(), None, None]), high)

    def remove(self, key: tuple[int, int]) -> None:
        low, rest = self._split(self.root, key)
        _, high = self._split(rest, (key[0], key[1] + 1))
        self.root = self._join(low, high)

    def tightest(self, room: int) -> tuple[int, int] | None:
        node, best = self.root, None
        while node:
            if node[0][0] >= room:
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            a, b = self._split(node[3], key)
            return [node[0], node[1], node[2], a], b
        a, b = self._split(node[2], key)
        return a, [node[0], node[1], b, node[3]]

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return [a[0], a[1], a[2], self._join(a[3], b)]
        return [b[0], b[1], self._join(a, b[2]), b[3]]


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int, most_bins: int | None = None) -> tuple[list[tuple[int, int, int, int]], int] | None:
    """Pack `count` items of each weight, heaviest first, each into the bin with the tightest sufficient room.

    classes: (weight, count). Returns runs (weight, rank from, rank to, bin) and the number of bins, or None where more
    than most_bins would be needed. While an item fits the tightest bin it stays the tightest for its equals, so one step
    places all copies that fit there. A weight above the capacity opens a bin of its own.
    """
    tree, runs, bins = CapacityTree(), [], 0
    for weight, count in sorted(classes, reverse=True):
        done = 0
        while done < count:
            found = tree.tightest(weight)
            if found is None:
                if most_bins is not None and bins == most_bins:
                    return None
                room, at = max(capacity, weight), bins
                bins += 1
            else:
                room, at = found
                tree.remove(found)
            k = min(count - done, room // weight)
            runs.append((weight, done, done + k, at))
            tree.add((room - k * weight, at))
            done += k
    return runs, bins


def even_bins(classes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """Best-fit-decreasing runs under the least capacity (by bisection) for which at most `bins` bins are needed.

    A group heavier than an even share of what is left takes a bin alone first, so the rest are spread over all others.
    """
    left, runs, base = dict(classes), [], 0
    while left and base < bins - 1:
        heaviest, total = max(left), sum(w * c for w, c in left.items())
        if heaviest * (bins - base) <= total:
            break
        used = sum(1 for r in runs if r[0] == heaviest)
        runs.append((heaviest, used, used + 1, base))
        base += 1
        left[heaviest] -= 1
        if not left[heaviest]:
            del left[heaviest]
    if not left:
        return runs
    shift = {r[0]: r[2] for r in runs}
    items, total = sorted(left.items()), sum(w * c for w, c in left.items())
    low = max(-(-total // (bins - base)), max(left))
    high = low
    while (found := best_fit_decreasing(items, high, bins - base)) is None:
        high += max(1, high // 1000)
    best, step = found, 0
    while low < high and step < 12:
        middle = (low + high) // 2
        if (found := best_fit_decreasing(items, middle, bins - base)) is None:
            low = middle + 1
        else:
            best, high = found, middle
        step += 1
    return runs + [(w, a + shift.get(w, 0), b + shift.get(w, 0), base + at) for w, a, b, at in best[0]]


def shard(docs: DataFrame, shards: int | None = 8, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text", heavy: int = 1 << 17, bundles: int = 1 << 15) -> DataFrame:
    """Give every row a shard and a slot: with `shards`, sizes as near equal as best fit makes them; with `capacity`, as
    few shards of that many bytes as best fit needs. Columns: doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("__h"))
    sized = common.stored(sized, "shard-rows")
    group = ["__h", "text_crc32", "size"]
    groups = sized.groupBy(*group).agg(F.count(F.lit(1)).alias("__copies")).withColumn("__w", F.col("__copies") * F.col("size"))
    groups = common.stored(groups, "shard-groups")
    total = groups.agg(F.sum("__w")).first()[0] or 0
    light = F.col("__w") * heavy < total
    bundle = F.pmod(F.xxhash64(*group, F.lit(1)), F.lit(bundles))
    # Items: a heavy group by its own key, a bundle by its number.
    keyed = groups.withColumns({"__bundle": F.when(light, bundle).otherwise(-1), **{f"__i{k}": F.when(~light, F.col(c)).otherwise(0) for k, c in enumerate(group)}})
    item = ["__bundle", *(f"__i{k}" for k in range(len(group)))]
    items = common.stored(keyed.groupBy(*item).agg(F.sum("__w").alias("__w")), "shard-items")
    classes = [(r["__w"], r["n"]) for r in items.groupBy("__w").agg(F.count(F.lit(1)).alias("n")).collect()]  # heavy + bundles at most
    runs = even_bins(classes, shards) if capacity is None else best_fit_decreasing(classes, capacity)[0]
    plan = common.rows(spark, runs, "rw long, r0 long, r1 long, shard int")
    ranked = common.rank_within(items, ["__w"], item, "__rank")
    placed = ranked.join(plan, (F.col("__w") == F.col("rw")) & (F.col("__rank") >= F.col("r0")) & (F.col("__rank") < F.col("r1"))).select(*item, "shard")
    placed = keyed.join(placed, item).select(*group, "__copies", "shard")
    of = common.spread_join(sized, common.stored(placed, "shard-plan"), {c: c for c in group}, "__copies", ["shard"], ["doc_id"])
    out = common.rank_within(of.select("doc_id", "size", "text_crc32", "shard"), ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")
