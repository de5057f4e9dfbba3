"""Vectorised word scanning over Arrow text columns: no Python loop over words or characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_INV = U64(pow(int(_BASE), -1, 2**64))
_MUL = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of words [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower case
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        grown[0] = 1
        have = _powers[key] = np.cumprod(grown, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values, by one sort."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


class Text:
    """Rows of UTF-8 text as one byte array with row offsets."""

    def __init__(self, ids: pa.Array, buf: np.ndarray, offs: np.ndarray):
        self.ids, self.buf, self.offs = ids, buf, offs

    def __len__(self) -> int:
        return len(self.offs) - 1

    def words(self, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, first word of each row and the end): separators by byte, A-Z taken as lower case."""
        if not len(self.buf):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self.offs), np.int64)
        inside = ~sep[LOWER[self.buf]]
        edge = np.zeros(len(inside) + 1, bool)
        cut = self.offs[:-1][self.offs[:-1] < self.offs[1:]]
        edge[cut] = True
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offs)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each word; polynomial over bytes, taken from prefix sums in blocks."""
        return span_hashes(lambda lo, hi: _BYTE[LOWER[self.buf[lo:hi]]], starts, ends)


def span_hashes(values, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span [start, end), spans ascending; values(lo, hi): 64-bit numbers of the places from lo to hi."""
    out = np.empty(len(starts), np.uint64)
    block, a = 1 << 19, 0
    while a < len(starts):
        lo = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, lo + block)))
        hi = ends[b - 1]
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values(lo, hi) * _power(_BASE, hi - lo), out=sums[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = (sums[e] - sums[s]) * _power(_INV, hi - lo + 1)[s] + (e - s).astype(np.uint64) * _MUL[0]
        a = b
    return mix(out)


def texts(batches: Iterator[pa.RecordBatch], text: str = "text", ids: str | None = None, most: int = 4 << 20) -> Iterator[Text]:
    """Slices of about `most` text bytes (one row at least); null text counts as empty. ids: the column kept beside."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        own = batch.column(batch.schema.get_field_index(ids)) if ids else None
        col = col.fill_null("").cast(pa.large_string())
        n = len(col)
        if not n:
            continue
        offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
            yield Text(own.slice(a, b - a) if own is not None else None, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            a = b


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words within each row, and the first gram of each row and the end.

    A row of fewer than n words, but not none, has one gram: all its words.
    """
    count = np.diff(first)
    total = len(hashes)
    if total == 0:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    padded = np.concatenate([hashes, np.zeros(n - 1, np.uint64)])
    acc = np.zeros(total, np.uint64)
    row_end = np.repeat(first[1:], count)
    at = np.arange(total)
    for j in range(n):
        part = padded[j : j + total] * _MUL[j + 1]
        acc += part if j == 0 else np.where(at + j < row_end, part, _MUL[40 + j])
    left = row_end - at
    keep = (left >= n) | (at == np.repeat(first[:-1], count))
    out = mix(acc[keep])
    firsts = np.concatenate([[0], np.cumsum(np.where(count == 0, 0, np.maximum(1, count - n + 1)))])
    return out, firsts
