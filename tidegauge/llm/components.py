"""Connected components of an edge table by alternating large-star and small-star; nothing is collected.

A bounded edge table is joined up in one task instead: the star rounds are dozens of jobs, whose plans and task records all stay with the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, stored

#: Edges that one task takes: 16 MB.
ONE_TASK = 1 << 20


def least_connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node each is connected with) of the edges a, b.

    Every root with a neighbouring root is hooked or hooked to in each round, so a logarithmic number of rounds ends it."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[root]


def connected(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """components() of stored edges; up to `one_task` of them (null ends and loops aside) in one task, with the same result."""
    edges = edges.where("a <> b").select("a", "b")
    if edges.count() > one_task:
        return components(edges)

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if got:
            nodes, roots = least_connected(*map(np.concatenate, zip(*got)))
            for i in range(0, len(nodes), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 50_000]), pa.array(roots[i : i + 50_000])], ["node", "root"])

    return edges.coalesce(1).mapInArrow(giving_back(union), "node long, root long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a long, b long) -> (node, root): the least node each node is connected with. Nodes without edges are absent.

    Each star round links a node's larger neighbours (or smaller ones and itself) to the least; per-node minima are
    pre-aggregated, so a hub costs one row per map task. Rounds are logarithmic in the longest path; an error is raised where
    `most_rounds` of them do not end with two equal ones.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    before = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e1 = large.where("u <> v").distinct()
        low = e1.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        joined = e1.join(low, F.col("u") == F.col("k"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
        e = stored(small.where("u <> v").distinct(), "cc")
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == now:
            break
        before = now
    else:
        raise RuntimeError(f"components: not converged after {most_rounds} rounds")
    nodes = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    roots = e.select(F.col("v").alias("node")).distinct().join(nodes.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))
    return nodes.unionByName(roots)
