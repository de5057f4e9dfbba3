"""A Katz backoff model of any order: Good-Turing discounted counts, exactly normalised backoff weights, whole-text scores.

p(w | h) = d(c) c(h, w) / c(h) where the n-gram was seen in training, else alpha(h) p(w | h') with h' one word shorter, and
p(w | h') where h was never a context; the shortest is p(w) = d(c) c(w) / N, and the unknown word has the mass that these
leave. d(c) is Good-Turing's up to `k` for each order, and 1 above. A context whose counts are all above k would leave no
mass, and unseen words would have probability 0: it counts one more event, unseen. With D(h) the mass that h gives up and
S(h) the sum of p(w | h') over the words seen after h, alpha(h) = D(h) / (1 - S(h)), so every p(. | h) sums to 1 over the known
words, the end and the unknown word. Texts begin with order - 1 start marks and close with an end.

Tables in the shared folder: `unigrams` (word, n), `ngrams` (for each bucket, its distinct n-grams with their training counts
and where they occur, packed), `shared` (n-grams of common contexts), `answers` (for each bucket, the lower-order counts that it
needs). N-grams are dealt to buckets by their nearest context word, so all orders of a context meet in one. A context that
is too common for that is dealt by its next word back, and by the whole n-gram if need be; counts of common contexts are in
`shared`, and their few sums go to all buckets by broadcast. Tokens travel once, packed. Buckets ask `unigrams` and `shared`
for the counts that they lack (the vocabulary's are known to all) in one join. Scoring reads the tables: each bucket evaluates the recursion for each distinct
n-gram and sums by row. Base scores and known tokens come from buckets for words outside the vocabulary only; the vocabulary's are
summed where the text is read. Words travel as ranks in a vocabulary of the `vocabulary` most frequent ones, others as 64-bit hashes.

Bounds: a bucket is `bucket_bytes` of text, so the number of buckets follows the input and memory does not. Buckets are scored in
`waves` parts, so that the shuffles of stored n-grams to their answers and of sums by bucket are that part only; a row has one
stored sum a wave. (A row meets up to as many buckets as it has tokens, so sums by bucket grow faster than the input until then.) At most 8 contexts a
bucket and order are common, and the vocabulary has a fixed size. Words and n-grams are told apart by 64-bit hashes.

Edge cases: null text counts as empty, its only token is the end; rows equal in doc_id and text count as often as they
occur and get equal scores; without training rows every token has probability 1 (the unknown word); an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import pack, unpack
from .words import SPACE, U64, distinct, mix, texts

END, BOS = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
_C1, _C2 = U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95)
#: Kind of the rows that name a chunk's documents.
ABOUT = 100


def discounts(n: list[float], k: int) -> np.ndarray:
    """d(0..k) of Good-Turing with counts of counts n[1..k+1]; half a count is taken where they give none in (0, 1)."""
    out = np.ones(k + 1)
    top = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if n[r] and top < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def kept(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) c of each count."""
    k = len(d) - 1
    return np.where(c <= k, d[np.minimum(c, k)], 1.0) * c


def weights(c: np.ndarray, given: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(denominators, backoff weights) of contexts with counts c that give up `given` of them, and lower sums s."""
    least = given <= 1e-9 * np.maximum(c, 1)
    total = c + least
    return total, np.where(least, 1.0, given) / np.maximum(total, 1) / np.maximum(1 - s, 1e-300)


def _tokens(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list]:
    """[keys, ids, held flags, word hashes, row of each token] of about `most` bytes of text; each row closes with END.

    Nothing of a yielded list is kept here, so that a reader who empties it can free its arrays."""
    held, size = [], 0

    def flush():
        base = np.cumsum([0] + [len(x[0]) for x in held], dtype=np.int32)[:-1]
        out = [np.concatenate([x[i] for x in held]) if i != 1 else pa.concat_arrays([x[1] for x in held]) for i in range(4)]
        out.append(np.concatenate([x[4] + b for x, b in zip(held, base)]))
        held.clear()
        return out

    for batch in batches:
        rows = pa.RecordBatch.from_arrays([batch.column(3), pa.array(np.arange(batch.num_rows))], ["text", "row"])
        for chunk in texts(iter([rows]), "text", "row"):
            starts, ends, first = chunk.words(SPACE)
            h = chunk.hashes(starts, ends)
            count = np.diff(first)
            w = np.empty(len(h) + len(count), np.uint64)
            is_end = np.zeros(len(w), bool)
            is_end[first[1:] + np.arange(len(count))] = True
            w[is_end], w[~is_end] = END, h
            take = lambda i: batch.column(i).take(chunk.ids)
            held.append((take(0).to_numpy(zero_copy_only=False), take(1), take(2).to_numpy(zero_copy_only=False).astype(bool), w, np.repeat(np.arange(len(count), dtype=np.int32), count + 1)))
            size += len(chunk.buf)
            del starts, ends, first, h, w, is_end, count, take
            if size >= most:
                yield flush()
                size = 0
                common.give_back()
    if held:
        yield flush()
    common.give_back()


def _words(w: np.ndarray, row: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(distinct words and BOS, [indexes of the words, of the words before, ...])."""
    names, at = np.unique(w, return_inverse=True)
    start = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    cols = [at.astype(np.int32)]
    for _ in range(order - 1):
        back = np.empty_like(cols[0])
        back[1:] = cols[-1][:-1]
        back[start] = len(names)
        cols.append(back)
    return np.append(names, BOS), cols


def _key(cols: list[np.ndarray], size: int) -> np.ndarray:
    """One integer for equal tuples of indexes below size, in their order of columns."""
    key, most = cols[0].astype(np.int64), size
    for c in cols[1:]:
        if most * size >= 2**62:
            found, key = np.unique(key, return_inverse=True)
            most = len(found)
        key *= size
        key += c
        most *= size
    return key


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def _lengths(starts: np.ndarray, n: int) -> np.ndarray:
    """How long the runs are that begin at starts and fill n places."""
    return np.diff(starts, append=n)


def _stable(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(np.argsort(key, kind="stable"), where its runs of equal keys begin), by two plain sorts, which are vectorised: of keys,
    then of places within equal keys."""
    by = np.argsort(key)
    start = _runs(key[by])
    run = np.repeat(np.arange(len(start)) * len(by), _lengths(start, len(by)))
    by += run
    by.sort()
    by -= run
    return by, start


def _chains(names: np.ndarray, cols: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashes of (word and m words before it) and of (these m words), for m = 0..; the latter are zeros for m = 0."""
    grams, contexts = [names[cols[0]]], [np.zeros(len(cols[0]), np.uint64)]
    for m, c in enumerate(cols[1:], 1):
        h = names[c] * _C2 + U64(m)
        grams.append(mix(grams[-1] * _C1 + h))
        contexts.append(mix(contexts[-1] * _C1 + h))
    return grams, contexts


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, whether found) of each key."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _split(at: np.ndarray) -> list[np.ndarray]:
    """The places of each value."""
    by = np.argsort(at.astype(np.uint16) if at.max(initial=0) < 1 << 16 else at, kind="stable")
    cut = _runs(at[by])
    return [by[a:b] for a, b in zip(cut, [*cut[1:], len(by)])]


def _depth(contexts: list[np.ndarray], common_ones: list[np.ndarray]) -> np.ndarray:
    """Words before that deal an n-gram: the least number that is no common context, or all (and the word itself)."""
    depth = np.ones(len(contexts[0]), np.int8)
    for m in range(1, len(contexts)):
        deeper = (depth == m) & _find(common_ones[m], contexts[m])[1]
        depth[deeper] = m + 1
    return depth


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((mix(h) >> U64(32)) % U64(n)).astype(np.int64)


def _dealt(grams: list[np.ndarray], contexts: list[np.ndarray], depth: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each n-gram."""
    h = grams[-1].copy()
    for m in range(1, len(contexts)):
        h = np.where(depth == m, contexts[m], h)
    return _bucket(h, n)


def _coded(names: np.ndarray, cols: list[np.ndarray], vocabulary: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(other names, columns): indexes are ranks in the vocabulary, and beyond its size places among the other names."""
    at, found = _find(vocabulary, names)
    code = np.where(found, ranks[at], 0).astype(np.int32)
    code[~found] = len(vocabulary) + np.arange(np.count_nonzero(~found))
    return names[~found], [code[c] for c in cols]


def _compact(others: np.ndarray, cols: list[np.ndarray], size: int) -> list[np.ndarray]:
    """[the other names that the columns use, the columns over these]."""
    rare = [c >= size for c in cols]
    used = distinct(np.concatenate([c[r] for c, r in zip(cols, rare)])) - size
    out = []
    for c, r in zip(cols, rare):
        c = c.astype(np.uint32)
        c[r] = size + np.searchsorted(used, c[r] - size)
        out.append(c)
    return [others[used], *out]


def _merged(messages: list[list[np.ndarray]], order: int, size: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct n-grams of several (other names, columns, counts), in order of (word before, word, further before): the other
    names, the columns, the sums of the counts, and the place of each n-gram of the messages."""
    others = distinct(np.concatenate([x[0] for x in messages]))
    moved = [size + np.searchsorted(others, x[0]) for x in messages]
    cols = []
    for i in range(order):
        parts = []
        for x, now in zip(messages, moved):
            c = x[1 + i].astype(np.int32)
            rare = c >= size
            c[rare] = now[c[rare] - size]
            parts.append(c)
        cols.append(np.concatenate(parts))
    n = np.concatenate([x[1 + order] for x in messages]).astype(np.int64)
    key = _key(_sorting(cols), size + len(others))
    by = np.argsort(key)
    key = key[by]
    first = _runs(key)
    place = np.empty(len(by), np.uint32)
    place[by] = np.repeat(np.arange(len(first), dtype=np.uint32), _lengths(first, len(by)))
    return others, [c[by[first]] for c in cols], np.add.reduceat(n[by], first), place


def _sorting(cols: list[np.ndarray]) -> list[np.ndarray]:
    return [*cols[1:2], cols[0], *cols[2:]]


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(bucket, its rows without it) of rows sorted by bucket, the first column."""
    now, held = None, []
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for bucket, *rest in zip(*cols):
            if held and bucket != now:
                yield now, held
                held = []
                common.give_back()
            now = bucket
            held.append(tuple(rest))
    if held:
        yield now, held
    held = None
    common.give_back()


def _added(messages: list[list[np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, base scores, known tokens) of n rows, from messages of (rows, their scores, rows with words outside the vocabulary,
    base scores and known tokens of these words)."""
    score, base, known = np.zeros(n), np.zeros(n), np.zeros(n)
    for at, s, rare, b, c in messages:
        score[at] += s
        base[rare] += b
        known[rare] += c
    return score, base, known


def _value(col: Column, d: np.ndarray) -> Column:
    """kept() as a Column of a count column."""
    factor = F.when(col <= len(d) - 1, F.element_at(F.array(*[F.lit(float(x)) for x in d]), (F.least(col, F.lit(len(d) - 1)) + 1).cast("int"))).otherwise(1.0)
    return factor * col


def score(docs: DataFrame, held_out, order: int = 3, k: int = 5, vocabulary: int = 1 << 19, chunk_bytes: int = 4 << 20, bucket_bytes: int = 6 << 20, waves: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row. held_out: Column over docs."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    id_kind = docs.schema[id_col].dataType.simpleString()
    id_list = pa.list_(to_arrow_type(docs.schema[id_col].dataType))
    body = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.xxhash64(F.col(id_col), body).alias("key"), F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), body.alias("text"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    share = 1 / (8 * buckets)  # of all tokens: more makes a context common

    # 1. Unigrams, and contexts that may be common: a context with that share of all tokens has it in some chunk.
    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, held, w, row in _tokens(batches, chunk_bytes):
            names, cols = _words(w, row, order)
            n = np.bincount(cols[0][~held[row]], minlength=len(names))[:-1]
            seen = np.flatnonzero(n)
            at = _bucket(names[seen], buckets)
            by = np.argsort(at, kind="stable")
            cut = _runs(at[by])
            out = [(0, int(at[by[a]]), pack(names[seen[by[a:b]]], n[seen[by[a:b]]].astype(np.uint32))) for a, b in zip(cut, [*cut[1:], len(by)])]
            some, level = np.arange(len(w)), 1
            counts = [np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)]
            while level < order and len(some):
                part = [c[some] for c in cols[: level + 1]]
                if level == 1:
                    same, times = part[1], np.bincount(part[1], minlength=len(names))
                else:
                    _, same, times = np.unique(_key(part[1:], len(names)), return_inverse=True, return_counts=True)
                some = some[(times >= max(1, share * len(w)))[same]]
                if len(some):
                    x = _chains(names, [c[some] for c in cols[: level + 1]])[1][level]
                    found, times = np.unique(x, return_counts=True)
                    counts = [np.concatenate(p) for p in zip(counts, (found, times.astype(np.uint32), np.full(len(found), level, np.uint32)))]
                level += 1
            out.append((1, -1, pack(*counts, np.array([len(w)], np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["kind", "bucket", "data"])

    def add_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            got = [unpack(r[0]) for r in rows]
            names, at = np.unique(np.concatenate([x[0] for x in got]), return_inverse=True)
            n = np.bincount(at, np.concatenate([x[1] for x in got])).round().astype(np.int64)
            for a in range(0, len(names), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(names[a : a + 100_000].view(np.int64)), pa.array(n[a : a + 100_000])], ["key", "n"])

    def open_reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                x, times, level, tokens = unpack(b)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(level, 0).astype(np.int32)), pa.array(np.append(x.view(np.int64), 0)), pa.array(np.append(times, tokens).astype(np.int64))], ["level", "x", "n"])

    first = common.stored(source.mapInArrow(count_words, "kind int, bucket int, data binary"), "katz-words", "kind")
    unigrams = first.where("kind = 0").select("bucket", "data").repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(add_words, "key long, n long")
    unigrams = common.stored(unigrams, "katz-unigrams")
    reports = first.where("kind = 1").select("data").mapInArrow(open_reports, "level int, x long, n long").groupBy("level", "x").agg(F.sum("n").alias("n"))
    reports = common.stored(reports, "katz-reports")
    tokens = reports.where("level = 0").agg(F.sum("n")).first()[0] or 0
    found = reports.where(f"level > 0 and n >= {share * tokens}").collect()  # at most 8 a bucket and level
    often = [np.sort(np.array([r["x"] for r in found if r["level"] == m], np.int64).view(np.uint64)) for m in range(order)]
    common.discard(first)
    common.free_shuffles(spark)
    classes = lambda col: [F.sum((F.col(col) == r).cast("long")).alias(f"c{r}") for r in range(1, k + 2)]
    sums = unigrams.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), *classes("n")).first()
    total, known_words = sums["n"] or 0, sums["v"]
    counts_of = {0: np.array([0] + [sums[f"c{r}"] or 0 for r in range(1, k + 2)], np.int64)}
    # The vocabulary: all words from some count on, the least such count (in steps of a 16th of a power of 2) that is not too many.
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = sorted(((r["l"], r["m"]) for r in unigrams.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("m")).collect()), reverse=True)
    least = next((l for (l, _), upto in zip(levels, np.cumsum([m for _, m in levels])) if upto > vocabulary), -1)
    table = unigrams.where(level > least).select("key", "n").toArrow()
    hashes, n = table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()
    by_rank = np.lexsort((hashes, -n))
    top, top_n = np.append(BOS, hashes[by_rank]), np.append(0, n[by_rank])
    by_hash = np.argsort(top)
    shared_words = spark.sparkContext.broadcast((often, top, top[by_hash], by_hash.astype(np.int32), top_n))

    # 2. N-grams of all texts with their training counts and rows, to their buckets; those of common contexts by themselves, too.
    TABLE = ["kind", "bucket", "key", "n", "ctx", "lower", "chunk", "data", "ids"]
    KINDS = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary(), id_list]
    schema = f"kind int, bucket int, key long, n long, ctx long, lower long, chunk long, data binary, ids array<{id_kind}>"

    def rows_of(kind: int, bucket: int, m: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), pa.array(np.full(m, bucket, np.int32)), *(pa.array(given[c], t) if c in given else pa.nulls(m, t) for c, t in zip(TABLE[2:], KINDS[2:]))], TABLE)

    def deal_chunk(got: list) -> Iterator[pa.RecordBatch]:
        ones, ranked, sorted_words, ranks, ranked_n = shared_words.value
        size = len(ranked)
        keys, ids, held, w, row = got
        got.clear()
        with np.errstate(over="ignore"):
            chunk = int(mix(np.array([np.add.reduce(mix(keys.view(np.uint64) + np.arange(1, len(keys) + 1, dtype=np.uint64) * _C1)) + U64(len(w))], np.uint64)).view(np.int64)[0])
        others, cols = _coded(*_words(w, row, order), sorted_words, ranks)
        # The vocabulary's counts are known here: its words' part of the base scores need not come back from the buckets.
        base = np.bincount(row, np.concatenate([np.log10(ranked_n + 0.5), np.zeros(len(others))])[cols[0]], len(keys))
        known = np.bincount(row, cols[0] < size, len(keys))
        yield rows_of(ABOUT, -1 - chunk % buckets, 1, chunk=[chunk], data=[pack(keys, held.astype(np.uint8), np.bincount(row, minlength=len(keys)).astype(np.uint32), known.astype(np.uint32), base)], ids=[ids.to_pylist()])
        names = np.concatenate([ranked, others])
        key = _key(_sorting(cols), len(names))
        by, start = _stable(key)  # rows ascend in each n-gram
        sorted_rows, cols = row[by], [c[by[start]] for c in cols]
        del w, row, key, by
        n = np.add.reduceat((~held[sorted_rows]).astype(np.int64), start) if len(start) else start
        times = _lengths(start, len(sorted_rows))
        grams, contexts = _chains(names, cols)
        depth = _depth(contexts, ones)
        at = _dealt(grams, contexts, depth, buckets)
        del contexts
        for g in _split(at):
            many = times[g]
            spots = np.repeat(start[g] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            gram, r = np.repeat(np.arange(len(g)), many), sorted_rows[spots]
            one = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (r[1:] != r[:-1])]))
            data = pack(*_compact(others, [c[g] for c in cols], size), n[g].astype(np.uint32), np.bincount(gram[one], minlength=len(g)).astype(np.uint32), r[one].astype(np.uint32), _lengths(one, len(r)).astype(np.uint32))
            yield rows_of(0, int(at[g[0]]), 1, chunk=[chunk], data=[data])
        for m in range(1, order):
            mine = np.flatnonzero((depth > m) & (n > 0))
            if len(mine):
                _, one, same = np.unique(grams[m][mine], return_index=True, return_inverse=True)
                sums = np.bincount(same, n[mine]).round().astype(np.uint32)
                one = mine[one]
                to = _bucket(grams[m][one], buckets)
                for g in _split(to):
                    yield rows_of(m, int(to[g[0]]), 1, data=[pack(*_compact(others, [c[one[g]] for c in cols[: m + 1]], size), sums[g])])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in _tokens(batches, chunk_bytes):
            yield from deal_chunk(got)  # its arrays are gone before the next chunk is read

    def merged(bucket: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        ones, ranked, *_ = shared_words.value
        size = len(ranked)
        signed = lambda x: x.view(np.int64)
        for level, chunk, data, ids in rows:
            if level == ABOUT:
                yield rows_of(ABOUT, bucket, 1, chunk=[chunk], data=[data], ids=[ids])
        for level in range(order):
            got = [(chunk, unpack(data)) for l, chunk, data, _ in rows if l == level]
            if not got:
                continue
            others, cols, n, place = _merged([x for _, x in got], level + 1 if level else order, size)
            names = np.concatenate([ranked, others])
            if level:  # n-grams of common contexts: all of each is here
                grams, contexts = _chains(names, cols)
                for a in range(0, len(n), 100_000):
                    s = slice(a, a + 100_000)
                    yield rows_of(1 + level, bucket, len(n[s]), key=signed(grams[level][s]), n=n[s], ctx=signed(contexts[level][s]), lower=signed(grams[level - 1][s]))
                continue
            grams_of, rows_in = [len(x[1]) for _, x in got], [len(x[-1]) for _, x in got]
            where = [np.concatenate([x[-i] for _, x in got]) for i in (3, 2, 1)]
            steps = np.diff(place, prepend=place[:1] * 0)  # modulo 2^32; small ones pack well
            yield rows_of(0, bucket, 1, data=[pack(others, *(c.astype(np.uint32) for c in cols), n.astype(np.uint32), np.array([c for c, _ in got], np.int64), np.array(grams_of, np.uint32), np.array(rows_in, np.uint32), steps, *where)])
            del got, where, steps, place
            grams, contexts = _chains(names, cols)
            depth = _depth(contexts, ones)
            asked = signed(distinct(np.concatenate([distinct(grams[0][cols[0] >= size]), *(grams[m][depth > m] for m in range(1, order))])))
            for a in range(0, len(asked), 100_000):
                yield rows_of(1, bucket, len(asked[a : a + 100_000]), key=asked[a : a + 100_000])
            for m in range(1, order):
                start = _runs(_key(_sorting(cols[: m + 1]), len(names)))
                c = np.add.reduceat(n, start)[depth[start] <= m]
                yield rows_of(1 + order, bucket, 1, key=[m], data=[pack(np.bincount(c[(c > 0) & (c <= k + 1)], minlength=k + 2).astype(np.int64))])

    def add_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            yield from merged(bucket, rows)  # its arrays are gone before the next bucket is read

    dealt = source.mapInArrow(deal, schema).select("bucket", "kind", "chunk", "data", "ids").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    tables = common.stored(dealt.mapInArrow(add_ngrams, schema), "katz-ngrams", "kind")
    del dealt
    common.free_shuffles(spark)
    shared = [unigrams] + [tables.where(F.col("kind") == 1 + m).select("key", "n", "ctx", "lower") for m in range(1, order)]

    def add_plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([m] * (k + 2), pa.int64()), pa.array(range(k + 2), pa.int32()), pa.array(unpack(data)[0])], ["m", "r", "n"])

    inside = tables.where(F.col("kind") == 1 + order).select("key", "data").mapInArrow(add_plain, "m long, r int, n long").groupBy("m", "r").agg(F.sum("n").alias("n")).collect()
    for m in range(1, order):
        outside = shared[m].agg(*classes("n")).first()
        counts_of[m] = np.array([0] + [outside[f"c{r}"] or 0 for r in range(1, k + 2)], np.int64)
        for r in inside:
            if r["m"] == m:
                counts_of[m][r["r"]] += r["n"]
    d = [discounts([float(x) for x in counts_of[m]], k) for m in range(order)]
    given = sum((1 - d[0][r]) * r * counts_of[0][r] for r in range(1, k + 1))
    denominator, left = (float(x[0]) for x in weights(np.array([total]), np.array([given]), np.zeros(1))) if total else (1.0, 1.0)

    # 3. Sums of common contexts, shortest first: each of their n-grams meets its lower order's count in one join.
    about: list[tuple] = [None]
    lower = unigrams.select(F.col("key").alias("lk"), (_value(F.col("n"), d[0]) / denominator).alias("p"))
    for m in range(1, order):
        per = shared[m].join(lower, F.col("lower") == F.col("lk")).groupBy("ctx").agg(F.sum("n").alias("c"), F.sum(F.col("n") - _value(F.col("n"), d[m])).alias("g"), F.sum("p").alias("s")).collect() if len(often[m]) else []
        per = sorted((int(np.array([r["ctx"]], np.int64).view(np.uint64)[0]), r["c"], r["g"], r["s"]) for r in per)  # common contexts only
        x, c, g, s = (np.array([r[i] for r in per], t) for i, t in enumerate((np.uint64, np.int64, float, float)))
        under, alpha = weights(c, g, s)
        about.append((x, under, alpha))
        known = common.rows(spark, list(zip(x.view(np.int64).tolist(), under.astype(float).tolist())), "x long, under double")
        lower = shared[m].join(F.broadcast(known), F.col("ctx") == F.col("x")).select(F.col("key").alias("lk"), (_value(F.col("n"), d[m]) / F.col("under")).alias("p"))  # 8 a bucket at most

    # 4. What buckets ask for: counts of their words, and of n-grams of common contexts.
    have = shared[0].select(F.col("key").alias("k2"), "n")
    for m in range(1, order):
        have = have.unionByName(shared[m].select(F.col("key").alias("k2"), "n"))

    def pack_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, key, n = (batch.column(i).to_numpy() for i in range(3))
            by = np.argsort(bucket, kind="stable")
            cut = _runs(bucket[by])
            parts = [by[a:b] for a, b in zip(cut, [*cut[1:], len(by)])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[by][cut]), pa.array([pack(key[p], n[p]) for p in parts], pa.binary())], ["bucket", "data"])

    asked = tables.where("kind = 1").select("bucket", "key").join(have, F.col("key") == F.col("k2")).select("bucket", "key", "n")
    answers = common.stored(asked.repartition(buckets, "bucket").mapInArrow(pack_answers, "bucket int, data binary"), "katz-answers")
    common.discard(tables, "kind=1")
    common.free_shuffles(spark)
    model = spark.sparkContext.broadcast((d, about, denominator, left))

    # 5. The recursion for each distinct n-gram of a bucket; sums by row.
    def evaluated(table: list[np.ndarray], answered: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(log10 p of a bucket's distinct n-grams, counts of its words outside the vocabulary)."""
        d, about, denominator, left = model.value
        ones, ranked, _, _, ranked_n = shared_words.value
        names, cols, n = np.concatenate([ranked, table[0]]), table[1 : 1 + order], table[1 + order].astype(np.int64)
        keys = np.concatenate([x[0] for x in answered]) if answered else np.zeros(0, np.int64)
        keys = keys.view(np.uint64)
        by = np.argsort(keys)
        keys, values = keys[by], (np.concatenate([x[1] for x in answered]) if answered else np.zeros(0, np.int64))[by]

        def counted(x: np.ndarray) -> np.ndarray:
            at, found = _find(keys, x)
            return np.where(found, values[at], 0) if len(values) else np.zeros(len(x), np.int64)

        grams, contexts = _chains(names, cols)
        depth = _depth(contexts, ones)
        others_n = counted(table[0])
        c = np.concatenate([ranked_n, others_n])[cols[0]]
        p = np.where(c > 0, kept(c, d[0]) / denominator, left)
        for m in range(1, order):
            start = _runs(_key(_sorting(cols[: m + 1]), len(names)))
            # One entry for each n-gram of m words before; these have one lower-order value.
            x, low, own = contexts[m][start], p[start], depth[start] <= m
            count = np.add.reduceat(n, start)
            if not own.all():
                count[~own] = counted(grams[m][start[~own]])
            under, alpha = np.zeros(len(start)), np.ones(len(start))
            hot_x, hot_under, hot_alpha = about[m]
            at, found = _find(hot_x, x)
            found &= ~own
            under[found], alpha[found] = hot_under[at[found]], hot_alpha[at[found]]
            mine = np.flatnonzero(own)
            ctx, back = np.unique(x[mine], return_inverse=True)
            total_of = np.bincount(back, count[mine], len(ctx))
            lost = np.bincount(back, count[mine] - kept(count[mine], d[m]), len(ctx))
            below = np.bincount(back, np.where(count[mine] > 0, low[mine], 0.0), len(ctx))
            u, a = weights(total_of, lost, below)
            trained = total_of > 0
            under[mine], alpha[mine] = np.where(trained, u, 0.0)[back], np.where(trained, a, 1.0)[back]
            value = np.where(count > 0, kept(count, d[m]) / np.maximum(under, 1.0), np.where(under > 0, alpha, 1.0) * low)
            p = np.repeat(value, _lengths(start, len(n)))
            grams[m] = contexts[m] = None
        return np.log10(p), others_n

    def scored(bucket: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        table = next((unpack(data) for kind, data in rows if kind == 0), None)
        if table is None:
            return
        size = len(shared_words.value[1])
        log_p, others_n = evaluated(table, [unpack(data) for kind, data in rows if kind == 1])
        word = table[1]
        chunks, grams_of, rows_in, steps, rows_of_gram, row, times = table[2 + order :]
        at = np.repeat(np.cumsum(steps, dtype=np.uint32), rows_of_gram)
        del table, steps
        a = 0
        for chunk, m in zip(chunks.tolist(), rows_in.tolist()):
            s = slice(a, a + m)
            r, t, w = row[s], times[s], word[at[s]]
            some, back = np.unique(r, return_inverse=True)
            outside = w >= size
            rare, again = np.unique(r[outside], return_inverse=True)
            n, t_rare = others_n[w[outside] - size], t[outside]
            yield rows_of(2, bucket, 1, chunk=[chunk], data=[pack(some, np.bincount(back, log_p[at[s]] * t), rare, np.bincount(again, np.log10(n + 0.5) * t_rare), np.bincount(again, (n > 0) * t_rare).astype(np.uint32))])
            a += m

    def in_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            yield from scored(bucket, rows)  # its arrays are gone before the next bucket is read

    def add_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in _by_bucket(batches):
            got = [unpack(data) for (data,) in rows]
            n = 1 + max(int(x[0][-1]) for x in got)
            sums, base, known = _added(got, n)
            rare = distinct(np.concatenate([x[2] for x in got]))
            yield rows_of(2, 0, 1, chunk=[chunk], data=[pack(np.arange(n, dtype=np.uint32), sums, rare, base[rare], known[rare].astype(np.uint32))])

    both = tables.where("kind = 0").select("bucket", "kind", "data").unionByName(answers.select("bucket", F.lit(1).alias("kind"), "data"))
    parts = []
    for wave in range(waves):
        mine = both.where(F.col("bucket") % waves == wave).repartition(buckets, "bucket").sortWithinPartitions("bucket")
        sums = mine.mapInArrow(in_bucket, schema).select("chunk", "data").repartition("chunk").sortWithinPartitions("chunk")
        parts.append(common.stored(sums.mapInArrow(add_sums, schema).select("kind", "chunk", "data", "ids"), "katz-sums"))
        del mine, sums
        common.free_shuffles(spark)

    # 6. One total for each row.
    def total_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in _by_bucket(batches):
            equal = [(*unpack(data), ids) for kind, data, ids in rows if kind == ABOUT]
            keys, held_flag, count, in_vocabulary, base_of, _ = equal[0]
            score, base, known = (x / len(equal) for x in _added([unpack(data) for kind, data, _ in rows if kind == 2], len(keys)))  # equal chunks share an id
            base, known = base + base_of, known + in_vocabulary
            base = base - count * np.log10(total + 0.5 * (known_words + 1))
            for *_, ids in equal:
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_list.value_type), pa.array(held_flag.astype(bool)), pa.array(count.astype(np.int64)), pa.array(known.round().astype(np.int64)), pa.array(np.full(len(keys), total, np.int64)), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    last = tables.where(F.col("kind") == ABOUT).select("chunk", "kind", "data", "ids")
    for x in parts:
        last = last.unionByName(x)
    last = last.repartition("chunk").sortWithinPartitions("chunk")
    return last.mapInArrow(total_up, f"doc_id {id_kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
