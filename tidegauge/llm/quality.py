"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The statistics come from the whole text alone (no label, language, source or id). Training rows are a bounded sample: the
`most_rows` labelled rows with the least hash of their id; a fifth of them is held back for the calibration. Each
partition sums its part of the normal equations, the driver solves a system of `features` unknowns, and the calibration
pools a histogram of scores with `bins` bins, so nothing on the driver grows with the corpus.

Edge cases: null text counts as empty and is scored from its statistics (all zero); repeated rows get equal scores; labels
of absent documents and rows with a null label are ignored; without labels every score is 0.5; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import LOWER, SPACE, distinct, texts

#: Byte classes: 0 lower, 1 upper, 2 digit, 3 blank, 4 newline, 5 sentence punctuation, 6 other ASCII symbols, 7 non-ASCII
_CLASS = np.full(256, 6, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 7
_CLASS[[32, 9]] = 3
_CLASS[[10, 13]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"-"]] = 5
STATS = 24


def statistics(batches: Iterator[pa.RecordBatch], ids: str) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """A row of STATS numbers for each text."""
    for chunk in texts(batches, "text", ids, 1 << 20):  # its arrays take 20 to 40 bytes a byte of text
        n, size = len(chunk), np.diff(chunk.offs)
        row = np.repeat(np.arange(n), size)
        by = np.bincount(row * 8 + _CLASS[chunk.buf], minlength=8 * n).reshape(n, 8).astype(float)
        starts, ends, first = chunk.words(SPACE)
        hashes, length = chunk.hashes(starts, ends), ends - starts
        out = np.zeros((n, STATS))
        total = np.maximum(size, 1)
        out[:, 0] = np.log1p(size)
        out[:, 1:9] = by / total[:, None]
        last = chunk.buf[ends - 1] if len(ends) else np.zeros(0, np.uint8)
        symbol, caps = _CLASS[last] == 6, _CLASS[chunk.buf[starts]] == 1 if len(starts) else np.zeros(0, bool)
        for i in range(n):
            a, b = first[i], first[i + 1]
            k = b - a
            if not k:
                continue
            w, l = hashes[a:b], length[a:b]
            _, counts = np.unique(w, return_counts=True)
            out[i, 9] = np.log1p(k)
            out[i, 10], out[i, 11] = l.mean() / 10, l.std() / 10
            out[i, 12], out[i, 13] = len(counts) / k, counts.max() / k
            out[i, 14] = (w[1:] == w[:-1]).mean() if k > 1 else 0
            out[i, 15] = len(distinct(w[1:] * np.uint64(3) + w[:-1])) / (k - 1) if k > 1 else 1
            out[i, 16], out[i, 17] = symbol[a:b].mean(), caps[a:b].mean()
            out[i, 18], out[i, 19] = (l <= 3).mean(), (l >= 12).mean()
            p = counts / k
            out[i, 20] = -(p * np.log(p)).sum() / np.log(k + 1)
            out[i, 21] = np.minimum(l.max(), 100) / 100
            out[i, 22] = (l == 1).mean()
            out[i, 23] = np.log1p(by[i, 4]) - np.log1p(k)
        yield chunk.ids, out


def measured(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, stats (packed doubles)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in statistics(batches, "doc_id"):
            yield pa.RecordBatch.from_arrays([ids, pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "stats"])

    return docs.select(F.col(id_col).alias("doc_id"), "text").mapInArrow(common.giving_back(run), f"doc_id {kind}, stats binary")


class Model:
    """Standardised statistics -> Fourier features -> ridge weights -> calibrated score."""

    def __init__(self, mean, std, features: int, width: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, std
        self.w = rng.normal(0, 1 / width, (STATS, features))
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.beta, self.edges, self.values = np.zeros(features + 1), np.array([-1.0, 2.0]), np.array([0.5, 0.5])

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.edges, self.values)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing fit by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def _unpack(col) -> np.ndarray:
    return np.array([np.frombuffer(b, "<f8") for b in col.to_pylist()]).reshape(-1, STATS)


def fit(stats: DataFrame, labels: DataFrame, features: int = 256, width: float = 4.0, ridge: float = 1e-3, bins: int = 400, most_rows: int = 200_000) -> Model:
    """labels: doc_id, label (0 or 1). stats: measured()."""
    spark = stats.sparkSession
    labels = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("double").alias("label"))
    labels = labels.withColumn("h", F.xxhash64("doc_id"))
    n = labels.count()
    if n > most_rows:
        labels = labels.where(F.col("h").cast("double") < -(2.0**63) + 2.0**64 * most_rows / n)
    data = stats.join(labels, "doc_id").select("stats", "label", F.pmod("h", F.lit(5)).cast("int").alias("fold"), "h").repartition(8, "h").drop("h")
    data = common.stored(data, "quality-train")

    def moments(batches):
        s = np.zeros((3, STATS))
        for batch in batches:
            x = _unpack(batch.column(0))
            s += np.array([np.full(STATS, len(x)), x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary())], ["m"])

    parts = [np.frombuffer(r[0], "<f8").reshape(3, STATS) for r in data.select("stats").mapInArrow(common.giving_back(moments), "m binary").collect()]
    total = np.sum(parts, axis=0) if parts else np.zeros((3, STATS))
    if not total[0, 0]:
        return Model(np.zeros(STATS), np.ones(STATS), features, width)
    mean = total[1] / total[0]
    model = Model(mean, np.sqrt(np.maximum(total[2] / total[0] - mean**2, 1e-8)), features, width)

    def normal(batches):
        d = features + 1
        a, y = np.zeros((d, d)), np.zeros(d)
        for batch in batches:
            x, t = model.map(_unpack(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False)
            a += x.T @ x
            y += x.T @ t
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["a", "y"])

    sums = data.where("fold <> 4").select("stats", "label").mapInArrow(common.giving_back(normal), "a binary, y binary").collect()  # 8 partitions
    d = features + 1
    a = np.sum([np.frombuffer(r["a"], "<f8").reshape(d, d) for r in sums], axis=0)
    y = np.sum([np.frombuffer(r["y"], "<f8") for r in sums], axis=0)
    model.beta = np.linalg.solve(a + ridge * max(1.0, a[-1, -1]) / 100 * np.eye(d), y)

    def histogram(batches):
        h = np.zeros((2, bins))
        for batch in batches:
            at = np.clip(((model.raw(_unpack(batch.column(0))) + 0.5) / 2 * bins).astype(int), 0, bins - 1)
            h[0] += np.bincount(at, minlength=bins)
            h[1] += np.bincount(at, batch.column(1).to_numpy(zero_copy_only=False), minlength=bins)
        yield pa.RecordBatch.from_arrays([pa.array([h.tobytes()], pa.binary())], ["h"])

    h = np.sum([np.frombuffer(r[0], "<f8").reshape(2, bins) for r in data.where("fold = 4").select("stats", "label").mapInArrow(common.giving_back(histogram), "h binary").collect()] or [np.zeros((2, bins))], axis=0)
    used = np.flatnonzero(h[0])
    if len(used):
        model.edges = (used + 0.5) / bins * 2 - 0.5
        model.values = np.clip(isotonic(h[1][used] / h[0][used], h[0][used]), 0, 1)
    return model


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""
    kind = stats.schema["doc_id"].dataType.simpleString()
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            x = _unpack(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(shared.value.score(x), 0, 1) if len(x) else [], pa.float64())], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(common.giving_back(run), f"doc_id {kind}, score double")


def scored_stats(stats: DataFrame, model: Model) -> DataFrame:
    """stats, score: the score of each distinct row of statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            x = _unpack(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(shared.value.score(x), 0, 1) if len(x) else [], pa.float64())], ["stats", "score"])

    return stats.select("stats").distinct().mapInArrow(common.giving_back(run), "stats binary, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """docs whose score reaches the threshold, with all their columns; the text is measured again while filtering.

    Null texts count as empty; repeated rows stay or go together; without labels all stay; an empty table gives no rows."""
    model = docs.sparkSession.sparkContext.broadcast(fit(common.stored(measured(docs), "quality-stats"), labels, **how))
    names, schema, at = docs.columns, docs.schema, docs.columns.index("text")

    def run(batches):
        for batch in batches:
            only = pa.RecordBatch.from_arrays([batch.column(at), pa.array(np.arange(batch.num_rows))], ["text", "row"])
            keep = np.concatenate([model.value.score(x) >= threshold for _, x in statistics(iter([only]), "row")] or [np.zeros(0, bool)])
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.select(*names).mapInArrow(common.giving_back(run), schema)
