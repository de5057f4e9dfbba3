"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts become " word word ... " with A-Z in lower case and every separator run one blank, so a window of words is a byte
string and blanks at both ends keep matches on word borders. Patterns are grouped by length (powers of two), each group
with its own shift table over blocks of bytes: most positions are skipped by nearly the shortest pattern's length, blocks
with shift 0 select a bucket, and direct comparison confirms an occurrence.

The test strings are read in blocks of bounded bytes; each block is one pass over the rows and what it finds is carried
in the row, so neither side has a size limit and no shuffle is needed.

Edge cases: null text has no words (0 words, 0 hits); an item without words occurs nowhere; equal items each count;
repeated rows are answered alike; an empty benchmark leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import LOWER, NOT_ALNUM

_TABLE = bytes(32 if NOT_ALNUM[LOWER[b]] else int(LOWER[b]) for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def windows(text: str | None, size: int) -> set[bytes]:
    found = words(text)
    if not found:
        return set()
    return {b" " + b" ".join(found[i : i + size]) + b" " for i in range(max(1, len(found) - size + 1))}


class WuManber:
    """Finds every occurrence of byte patterns of at least `shortest` bytes each."""

    def __init__(self, patterns: list[bytes]):
        self.m = min(map(len, patterns))
        self.block = max(1, min(8, self.m // 2))
        self.default = self.m - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[bytes]] = {}
        for p in patterns:
            for end in range(self.block, self.m + 1):
                key = p[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.default), self.m - end)
            self.bucket.setdefault(p[self.m - self.block : self.m], []).append(p)

    def search(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        get, block, default, m = self.shift.get, self.block, self.default, self.m
        i, n = m, len(text)
        while i <= n:
            key = text[i - block : i]
            step = get(key, default)
            if step:
                i += step
                continue
            for p in self.bucket[key]:
                if text.startswith(p, i - m):
                    yield i - m, p
            i += 1


class Finder:
    """Windows of test items by length group, and the items of each window."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.items: dict[bytes, set[str]] = {}
        for item, text in items:
            for w in windows(text, size):
                self.items.setdefault(w, set()).add(item)
        groups: dict[int, list[bytes]] = {}
        for w in self.items:
            groups.setdefault(len(w).bit_length(), []).append(w)
        self.groups = [WuManber(g) for g in groups.values()]

    def find(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit word ranges [from, to) (merged, ascending), items found."""
        found = words(text)
        flat = b" " + b" ".join(found) + b" "
        hits, items, gaps = [], set(), None
        for group in self.groups:
            for at, p in group.search(flat):
                if gaps is None:
                    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
                first = int(np.searchsorted(gaps, at))
                hits.append((first, first + p.count(b" ") - 1))
                items |= self.items[p]
        return len(found), merge(hits), items


_kept: dict[str, Finder] = {}


def _finder(name: str, items: list[tuple[str, str]], size: int) -> Finder:
    """The Finder of a block of items, built once in each Python worker; the last two are kept."""
    if name not in _kept:
        while len(_kept) > 1:
            _kept.pop(next(iter(_kept)))
        _kept[name] = Finder(items, size)
    return _kept[name]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(items: DataFrame, item_col: str, item_text: str, most: int) -> Iterator[list[tuple[str, str]]]:
    """The test items in blocks of about `most` bytes; the driver holds one block at a time."""
    held, used = [], 0
    for r in items.select(F.col(item_col).cast("string"), F.col(item_text)).toLocalIterator():
        held.append((r[0] or "", r[1]))
        used += len(r[1] or "") + 16
        if used >= most:
            yield held
            held, used = [], 0
    yield held


def find_items(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, items (array of item ids as strings), spans (array of hit word ranges) for every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    spans = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))

    def scanner(block, name):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = _finder(name, block.value, size)
            for batch in batches:
                ids, body, was_items, was_spans = (batch.column(i) for i in range(4))
                n, out_items, out_spans = [], [], []
                for text, seen, ranges in zip(body, was_items, was_spans):
                    count, more, which = finder.find(text.as_py())
                    n.append(count)
                    out_items.append(sorted(which | set(seen.as_py() or ())))
                    out_spans.append([{"from": a, "to": b} for a, b in merge(more + [(x["from"], x["to"]) for x in ranges.as_py() or ()])])
                cols = [ids, body, pa.array(out_items, pa.list_(pa.string())), pa.array(out_spans, spans), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "items", "spans", "n_words"])

        return scan

    typed = f"doc_id {kind}, text string, items array<string>, spans array<struct<from:long,to:long>>, n_words long"
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("array<struct<from:long,to:long>>").alias("spans"))
    for part in item_blocks(items, item_col, item_text, block_bytes):
        block = docs.sparkSession.sparkContext.broadcast(part)  # at most block_bytes and one item
        out = out.select("doc_id", "text", "items", "spans").mapInArrow(common.giving_back(scanner(block, uuid.uuid4().hex)), typed)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["to"] - x["from"])
    return out.select("doc_id", "n_words", hit.alias("n_hit"), "items", "spans")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """docs without the rows that hold a window of a test item; all columns stay."""
    at, schema = docs.columns.index(text_col), docs.schema
    for part in item_blocks(items, "item_id", "text", block_bytes):
        block = docs.sparkSession.sparkContext.broadcast(part)

        def keep(batches: Iterator[pa.RecordBatch], block=block, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            finder = _finder(name, block.value, size)
            for batch in batches:
                yield batch.filter(pa.array([not finder.find(t.as_py())[1] for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(common.giving_back(keep), schema)
    return docs
