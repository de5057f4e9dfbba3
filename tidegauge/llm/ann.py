"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of one codeword from each of several full-dimensional codebooks. Codebooks are fitted
level by level on residuals of a bounded sample (`sample` vectors of least hash), then encoding keeps a beam of partial sums per
vector. Every vector is indexed: its codes, the norm of its approximation and a bound of its error are stored beside it, in a
table.

A search takes the queries in blocks of bounded size. For each block, each partition of the index adds up lookup tables
(query times codeword) over the codes. Rows whose stored norm plus error cannot reach the k-th best found so far are not even
scored. The `rerank` best rows of a batch are reranked by exact products of the original vectors in double precision, then all
rows whose rough score plus error bound times the query's norm reaches the k-th best found so far: no row of the true k is
lost, however many have one code. Only the k best of each partition and query are shuffled, and a block's answer is stored
before the next begins, so plans, broadcasts and the driver hold one block. There are no coarse cells: where vectors fill the
space evenly, as in the tables here, nine tenths of the neighbours lie in no fewer than half of all cells (README).

Edge cases: vectors that are null, all zero, of another dimension than most or hold a null or non-finite component take no
part, as queries or candidates; equal vectors tie and go by id; fewer than k candidates are all returned; a row never
finds itself (rows that repeat an id count as the same row); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


class Codebooks:
    def __init__(self, books: np.ndarray):
        self.books = books  # levels x codewords x dimension

    @staticmethod
    def fit(x: np.ndarray, levels: int, words: int, rounds: int = 8, seed: int = 3) -> Codebooks:
        rng, books, rest = np.random.default_rng(seed), [], x.astype(np.float32).copy()
        for _ in range(levels):
            book = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
            for _ in range(rounds):
                near = np.argmax(rest @ book.T - 0.5 * (book * book).sum(1), axis=1)
                sums = np.zeros_like(book)
                np.add.at(sums, near, rest)
                n = np.bincount(near, minlength=words)
                book[n > 0] = sums[n > 0] / n[n > 0, None]
            near = np.argmax(rest @ book.T - 0.5 * (book * book).sum(1), axis=1)
            rest -= book[near]
            books.append(book)
        return Codebooks(np.array(books, np.float32))

    def encode(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, norms of the approximations, bounds of the error), by beam search over the levels.

        A score by lookup tables is off by no more than the bound times the query's norm, float32 rounding included.
        """
        levels, words, dim = self.books.shape
        all_codes, norms, errors = np.empty((len(x), levels), np.uint8), np.empty(len(x), np.float32), np.empty(len(x))
        rounding = (levels + dim + 8) * 2.0**-22 * np.linalg.norm(self.books.astype(np.float64), axis=2).max(1).sum()
        for a in range(0, len(x), 512):
            part = x[a : a + 512].astype(np.float32)
            n = len(part)
            rest, codes = part[:, None, :], np.zeros((n, 1, 0), np.uint8)
            for book in self.books:
                cost = (rest * rest).sum(2)[:, :, None] - 2 * (rest @ book.T) + (book * book).sum(1)
                flat = cost.reshape(n, -1)
                keep = min(beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                from_beam, word = best // words, best % words
                rest = np.take_along_axis(rest, from_beam[:, :, None], 1) - book[word]
                codes = np.concatenate([np.take_along_axis(codes, from_beam[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
            pick = (rest * rest).sum(2).argmin(1)
            all_codes[a : a + n] = codes[np.arange(n), pick]
            norms[a : a + n] = np.linalg.norm(part - rest[np.arange(n), pick], axis=1)
            approximation = self.books[np.arange(levels), all_codes[a : a + n]].astype(np.float64).sum(1)
            errors[a : a + n] = np.linalg.norm(x[a : a + n] - approximation, axis=1) * (1 + 1e-9) + rounding
        return all_codes, norms, errors


def _usable(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and vectors (doubles) of one binary-packed batch."""
    if batch.num_rows:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        yield ids, np.array([np.frombuffer(b, "<f8") for b in batch.column(1).to_pylist()])


def _packed(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (packed doubles), of rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, packed = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not v or any(c is None for c in v):
                    continue
                x = np.array(v, "<f8")
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    packed.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], ["vec_id", "v"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, v binary")


def index(vectors: DataFrame, levels: int = 16, words: int = 256, beam: int = 4, sample: int = 20_000, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, Codebooks | None]:
    """The stored table (vec_id, v, codes, norm, error) of all usable vectors, and the codebooks."""
    spark = vectors.sparkSession
    packed = common.stored(_packed(vectors, id_col, vec_col), "ann-vectors")
    sizes = packed.groupBy(F.length("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    if not sizes:
        return packed.select("vec_id", "v", F.lit(b"").alias("codes"), F.lit(0.0).cast("float").alias("norm"), F.lit(0.0).alias("error")), None
    bytes_, total = sizes[0]["n"], sizes[0]["c"]
    packed = packed.where(F.length("v") == bytes_)
    chosen = packed
    if total > sample:
        chosen = packed.where((F.xxhash64("vec_id").cast("double") + 2.0**63) / 2.0**64 < sample / total)
    x = np.array([np.frombuffer(r[0], "<f8") for r in chosen.select("v").collect()])  # about `sample` vectors
    if not len(x):
        x = np.array([np.frombuffer(r[0], "<f8") for r in packed.select("v").limit(sample).collect()])
    books = Codebooks.fit(np.unique(x, axis=0), levels, words)
    shared = spark.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, v in _usable(batch):
                codes, norms, errors = shared.value.encode(v, beam)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms, pa.float32()), pa.array(errors, pa.float64())], ["vec_id", "v", "codes", "norm", "error"])

    return common.stored(packed.repartition(F.xxhash64("vec_id")).mapInArrow(encode, "vec_id long, v binary, codes binary, norm float, error double"), "ann-index"), books


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to the smaller id, best first."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        over = np.flatnonzero(scores > least)
        tied = np.flatnonzero(scores == least)
        over = np.concatenate([over, tied[np.argsort(ids[tied], kind="stable")][: k - len(over)]])
    else:
        over = np.arange(len(scores))
    return over[np.lexsort((ids[over], -scores[over]))]


def search(indexed: DataFrame, books: Codebooks | None, queries: DataFrame, k: int = 20, rerank: int = 256, block: int = 4096) -> DataFrame:
    """queries: vec_id, v (rows of the index). Returns query_id, rank (from 1), vec_id, score (inner product)."""
    spark = indexed.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if books is None:
        return empty
    found, n = None, queries.count()
    for part in range(max(1, -(-n // block))):
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // block)))) == part).dropDuplicates(["vec_id"]).orderBy("vec_id").collect()  # about `block` vectors
        if not mine:
            continue
        shared = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in mine]), np.array([np.frombuffer(r["v"], "<f8") for r in mine]), books.books))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, q, words = shared.value
            luts = np.einsum("lwd,qd->lqw", words, q.astype(np.float32)).astype(np.float32)
            longest = np.linalg.norm(q, axis=1)
            held: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(q_ids)

            def add(j: int, near: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
                near = near[ids[near] != q_ids[j]]
                exact, who = (v[near] * q[j]).sum(1), ids[near]
                if held[j] is not None:
                    exact, who = np.concatenate([held[j][0], exact]), np.concatenate([held[j][1], who])
                top = _best(exact, who, k)
                held[j] = exact[top], who[top]

            for batch in batches:
                for ids, v in _usable(batch):
                    all_ids, all_v = ids, v
                    all_codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(ids), -1)
                    all_error, reach = batch.column(3).to_numpy(), batch.column(4).to_numpy() + batch.column(3).to_numpy()
                    size = np.linalg.norm(v, axis=1).max()
                    for a in range(0, len(q_ids), 64):
                        ids, v, codes, error = all_ids, all_v, all_codes, all_error
                        least = [h[0][-1] if h is not None and len(h[0]) == k else -np.inf for h in held[a : a + 64]]
                        near = reach * longest[a : a + 64].max() >= min(least)
                        if not near.all():
                            ids, v, codes, error = all_ids[near], all_v[near], all_codes[near], all_error[near]
                        if not len(ids):
                            continue
                        rough = luts[0][a : a + 64][:, codes[:, 0]]
                        for m in range(1, codes.shape[1]):
                            rough += luts[m][a : a + 64][:, codes[:, m]]
                        norm = np.linalg.norm(q[a : a + 64], axis=1)
                        open_ = np.empty(rough.shape, bool)
                        least = np.full(len(rough), -np.inf)
                        for r, row in enumerate(rough):
                            near = _best(row, ids, rerank + 1)
                            add(a + r, near, ids, v)
                            if len(held[a + r][0]) == k:
                                least[r] = held[a + r][0][-1]
                            open_[r] = ~(row + norm[r] * error < least[r])
                            open_[r, near] = False
                        some = np.flatnonzero(open_.any(0))
                        if len(some):
                            # Products of the whole block; their last bits vary, so add() makes those of the rows that reach again.
                            near_enough = v[some] @ q[a : a + 64].T >= least - 1e-9 * norm * size
                            for r in np.flatnonzero((open_[:, some].T & near_enough).any(0)):
                                add(a + r, some[open_[r, some] & near_enough[:, r]], ids, v)
            have = [j for j, h in enumerate(held) if h is not None and len(h[0])]
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[have], pa.int64()), pa.array([held[j][1].tolist() for j in have], pa.list_(pa.int64())), pa.array([held[j][0].tolist() for j in have], pa.list_(pa.float64()))], ["query_id", "ids", "scores"])

        some = indexed.select("vec_id", "v", "codes", "error", "norm").mapInArrow(scan, "query_id long, ids array<long>, scores array<double>")
        some = common.stored(_merged(some, k), "ann-found")
        shared.unpersist()
        found = some if found is None else found.unionByName(some)
    return empty if found is None else found


def _merged(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the best of all partitions."""
    pairs = F.arrays_zip(F.transform("scores", lambda x: -x).alias("s"), F.col("ids").alias("i"))
    top = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("all")))), 1, k)
    found = found.select("query_id", F.pmod(F.xxhash64("ids"), F.lit(64)).alias("part"), pairs.alias("all"))  # k from each partition
    merged = found.groupBy("query_id", "part").agg(top.alias("all")).groupBy("query_id").agg(top.alias("top"))
    return merged.select("query_id", F.posexplode("top").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))
