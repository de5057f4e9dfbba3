"""Cost-balanced packing of tokenised documents into sequences of at most 1024 tokens.

A document of n tokens is cut into full pieces of the sequence length, which fill a sequence each, and one rest. A piece
of l tokens costs l + l*l/d (linear layers plus attention among its own tokens, d the width where both weigh the same).
Rests go in descending length to the open sequence of least cost that still has room; where none has, as many are opened
as the rests of that length need. Rests of one length, and sequences of one content, are interchangeable: the assignment
runs over at most 1023 lengths and ranges of sequence numbers, so the driver's work does not grow with the corpus, and its
plan is joined to the pieces by (length, rank).

Edge cases: null or empty text is its end token alone; repeated rows are pieces of their own; an empty table gives no
rows; very long texts are many full pieces; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import U64, mix, span_hashes

_loaded: dict = {}
_LETTER, _NUMBER, _OTHER, _SPACE, _UNSEEN = range(5)


class Encoder:
    """texts -> arrays of ids of a byte-level tokenizers file, without special tokens added.

    Pre-tokens do not touch each other in byte-level BPE, so the library encodes each distinct one once and its ids are kept,
    about `most` of them at a time. Pre-tokens are cut for whole arrays of code points and told apart by 64-bit hashes. A text with
    the string of a special token goes to the library whole.
    """

    def __init__(self, path: str | None = None, most: int = 400_000):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.kinds, self.most = np.full(0x110000, _UNSEEN, np.uint8), most
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def __call__(self, texts: list[str], group: int = 1 << 21) -> Iterator[np.ndarray]:
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= group:
                yield from self._encode(held)
                held, size = [], 0
        if held:
            yield from self._encode(held)

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        odd = [any(s in t for s in self.special) for t in texts]
        flat = "".join("" if o else t for o, t in zip(odd, texts))
        points = np.frombuffer(flat.encode("utf-32-le"), "<u4")
        offsets = np.cumsum([0] + [0 if o else len(t) for o, t in zip(odd, texts)])
        starts = self._cut(points, offsets)
        ends = np.append(starts[1:], len(points))
        keys, first, back = np.unique(span_hashes(lambda lo, hi: mix(points[lo:hi].astype(U64)), starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self._forget()
        near = np.searchsorted(self.keys, keys)
        fresh = np.flatnonzero(np.append(self.keys, U64(0))[near] != keys)
        if len(fresh):
            self._learn(keys[fresh], [flat[a:b] for a, b in zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist())])
        slot = np.searchsorted(self.keys, keys)[back]
        size = self.size[slot]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.at[slot] - upto[:-1], size) + np.arange(upto[-1])]
        bounds = upto[np.searchsorted(starts, offsets)]
        for text, o, a, b in zip(texts, odd, bounds, bounds[1:]):
            yield np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4") if o else ids[a:b]

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        one = self.whole.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        size = np.bincount(np.array(one.word_ids, np.int64), minlength=len(pieces))
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.array(one.ids, "<u4")])
        keys = np.concatenate([self.keys, keys])
        by = np.argsort(keys)
        self.keys, self.at, self.size = keys[by], np.concatenate([self.at, at])[by], np.concatenate([self.size, size])[by]

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        found = self.kinds[points]
        if (found == _UNSEEN).any():
            import regex

            for c in np.unique(points[found == _UNSEEN]).tolist():
                self.kinds[c] = next((k for k, p in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\p{White_Space}")) if regex.match(p, chr(c))), _OTHER)
            found = self.kinds[points]
        return found

    def _cut(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the file's pre-tokens start: a contraction, or a run of letters, numbers or others with the blank before it,
        or a run of white space less its last character where more text follows."""
        n = len(points)
        if not n:
            return np.zeros(0, np.int64)
        kind = self._kinds(points)
        row = np.zeros(n + 1, bool)
        row[offsets] = True
        new = row[:n].copy()
        new[1:] |= kind[1:] != kind[:-1]
        at = np.flatnonzero(new)
        end = np.append(at[1:], n)
        follows = ~row[end]  # more of the same text
        starts = new.copy()
        space = (kind[at] == _SPACE) & follows
        starts[end[space] - 1] = True
        starts[end[space & (points[end - 1] == 32)]] = False
        mark = np.flatnonzero((points[at] == 39) & (end - at == 1) & starts[at] & follows)
        mark = mark[kind[end[mark]] == _LETTER]
        if len(mark):
            a, z = end[mark], end[mark + 1]  # the letters after the apostrophe
            one, two = points[a], np.where(z - a > 1, points[np.minimum(a + 1, n - 1)], 0)
            is_ = lambda *cs: np.isin(one, [ord(c) for c in cs])
            size = np.where(is_("s", "t", "m", "d"), 1, np.where((is_("r", "v") & (two == ord("e"))) | (is_("l") & (two == ord("l"))), 2, 0))
            starts[a[size > 0]] = False
            rest = (size > 0) & (a + size < z)
            starts[(a + size)[rest]] = True
        return np.flatnonzero(starts)


def encoder(path: str | None = None) -> Encoder:
    """The process's Encoder of a file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def assign(counts: dict[int, int], length: int, width: int = 512) -> list[tuple[int, int, int, int, int]]:
    """Steps (piece length, rank from, rank to, sequence of the first, offset there) for `counts` pieces of each length.

    The more sequences are open from the start, the more even their costs, and the more room is left over: the largest
    share of the least number possible is taken that leaves at most 1 % more sequences than the best.
    """
    found = [_assign(counts, length, width, percent) for percent in (100, 95, 90, 80, 50, 0)]
    least = min(n for _, n in found)
    return next(steps for steps, n in found if 100 * n <= 101 * least)


def _assign(counts: dict[int, int], length: int, width: int, percent: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(steps, number of sequences), with `percent` of the sequences that the rests fill at least open from the start.

    Sequence types are ranges of sequence numbers with equal content, in a heap by cost; a step moves as many pieces of a
    length as a range has sequences, splitting it where pieces run out.
    """
    cost = lambda l: l + l * l / width
    steps, sequences = [], 0
    full = counts.get(length, 0)
    if full:
        steps.append((length, 0, full, 0, 0))
        sequences = full
    total = sum(l * c for l, c in counts.items() if l < length)
    opened = -(-total // length) * percent // 100
    heap = [(0.0, 0, sequences, opened)] if opened else []  # cost, fill, first sequence, how many
    sequences += opened
    for l in sorted((l for l in counts if l < length), reverse=True):
        left, rank, aside = counts[l], 0, []
        while left:
            while heap and heap[0][1] + l > length:
                aside.append(heapq.heappop(heap))
            if not heap:
                more = -(-left // (length // l))
                heap.append((0.0, 0, sequences, more))
                sequences += more
            c, fill, first, n = heapq.heappop(heap)
            k = min(n, left)
            steps.append((l, rank, rank + k, first, fill))
            heapq.heappush(heap, (c + cost(l), fill + l, first, k))
            if n > k:
                heapq.heappush(heap, (c, fill, first + k, n - k))
            rank, left = rank + k, left - k
        for x in aside:
            if x[1] < length:
                heapq.heappush(heap, x)
    return steps, sequences


def pieces(docs: DataFrame, length: int = 1024, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            ids, out = batch.column(0), ([], [], [], [], [])
            for row, tokens in enumerate(encode([t or "" for t in batch.column(1).to_pylist()])):
                tokens = np.append(tokens, np.zeros(1, "<u4"))
                for a in range(0, len(tokens), length):
                    part = tokens[a : a + length]
                    for x, v in zip(out, (row, a, len(part), zlib.crc32(part.tobytes()), len(tokens))):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(out[0], pa.int64())), *(pa.array(x, pa.int64()) for x in out[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(common.giving_back(cut), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, length: int = 1024, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pieces() with sequence_id and offset (gapless from 0 in each sequence)."""
    cut = common.stored(pieces(docs, length, tokenizer, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = common.rows(docs.sparkSession, assign(counts, length), "pl long, r0 long, r1 long, first long, offset long")
    ranked = common.rank_within(cut, ["length"], ["doc_id", "start", "ids_crc32"], "__rank")
    plan = F.broadcast(plan)  # its rows follow from the 1024 lengths alone, not from the corpus
    out = ranked.join(plan, (F.col("length") == F.col("pl")) & (F.col("__rank") >= F.col("r0")) & (F.col("__rank") < F.col("r1")))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("__rank") - F.col("r0")).alias("sequence_id"), "offset")
