"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds 64-bit hashes of its distinct word n-grams, in one global order: rare first, by a count sketch of
fixed size, then by hash. Two sets of Jaccard similarity s or more share at least k of the first |x| - ceil(s|x|) + k
members of each, for every k. Each document picks the k (1 to `most_match`) of least estimated cost: members scanned plus
candidates to verify, where at most the sum of all but the k-1 largest posting lists of the prefix can share k members.
A pair is a candidate once it shares min(kx, ky) members within prefixes of that many matches and the positions of these
leave room for the overlap that the sizes call for; it is then verified on the whole sets.

Only distinct sets take part (equal sets are one class), and only members with two or more postings leave the bucket tasks.
Candidate pairs inside one component already found are never made: in a few rounds every class is compared with a pivot of
its posting lists and components are joined; then all candidates between different components that are left follow.
So a group of n near copies costs about n comparisons, and no link between different components is lost.

Sets and classes are told apart by 64-bit hashes (the chance of one false merge among 10^8 sets is about 3 in 10,000).

Edge cases: null or wordless text has no set, no links, and is its own component; fewer than n words are one member;
repeated rows and equal sets are one component; an empty table gives no rows; a null id never becomes a component id
unless its component has no other; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import connected
from .words import SPACE, Text, U64, distinct, grams, mix, texts

SKETCH = 1 << 20
SLICES = 64


def _sets(batches: Iterator[pa.RecordBatch], n: int, ids: str | None) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for chunk in texts(batches, "text", ids):
        starts, ends, first = chunk.words(SPACE)
        g, at = grams(chunk.hashes(starts, ends), first, n)
        yield chunk.ids, [distinct(g[a:b]) for a, b in zip(at[:-1], at[1:])]


def _unsqueezed(z: bytes, n: int) -> np.ndarray:
    """The set of a text packed by squeeze()."""
    text = pa.Codec("zstd").decompress(z[8:], int.from_bytes(z[:8], "little"), asbytes=True)
    one = Text(None, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    starts, ends, first = one.words(SPACE)
    return distinct(grams(one.hashes(starts, ends), first, n)[0])


def _class_of(s: np.ndarray) -> int:
    """A signed 64-bit key of a set."""
    with np.errstate(over="ignore"):
        x = np.array([np.add.reduce(mix(s ^ U64(0xA5A5A5A5A5A5A5A5))) + U64(len(s)) * U64(0x9E3779B97F4A7C15)], np.uint64)
        return int(mix(x).view(np.int64)[0])


def sketch(docs: DataFrame, n: int) -> np.ndarray:
    """Counts of n-grams by the low bits of their hashes: SKETCH counters, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for _, sets in _sets(batches, n, None):
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            total += np.bincount((flat & U64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        if total.any():
            width = SKETCH // SLICES
            wide = np.minimum(total, 2**31 - 1).astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([wide[i * width : (i + 1) * width].tobytes() for i in range(SLICES)], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(b, "<u4").astype(np.int64)
                sums[k] = sums[k] + part if k in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(v, 2**31 - 1).astype("<u4").tobytes() for v in sums.values()], pa.binary())], ["slice", "counts"])

    schema = "slice int, counts binary"
    parts = docs.select("text").mapInArrow(common.giving_back(count), schema).repartition(SLICES, "slice").mapInArrow(common.giving_back(add), schema)
    out = np.zeros(SKETCH, np.uint32)
    width = SKETCH // SLICES
    for r in parts.collect():  # 4 MB in all
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], "<u4")
    return out


def prefix(s: np.ndarray, counts: np.ndarray, noise: float, percent: int, most_match: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(members, position of each from 1, k): the adaptive prefix of a set in the global order."""
    df = counts[(s & U64(SKETCH - 1)).astype(np.int64)]
    order = np.lexsort((s, df))
    size = len(s)
    one = size - (-(-percent * size // 100)) + 1
    most = min(most_match, size - one + 1)
    lists = np.maximum(df[order[: one + most - 1]] - noise, 0.0)
    best, best_cost = 1, None
    for k in range(1, most + 1):
        part = lists[: one + k - 1]
        drop = np.partition(part, len(part) - (k - 1))[len(part) - (k - 1) :].sum() if k > 1 else 0.0
        cost = part.sum() * 0.05 + (part.sum() - drop) + 2.0 * k
        if best_cost is None or cost < best_cost:
            best, best_cost = k, cost
    members = s[order[: one + best - 1]]
    return members, np.arange(1, len(members) + 1), best


def links(docs: DataFrame, n: int = 5, percent: int = 80, most_match: int = 6, most_stars: int = 3) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, n_shingles, class; edges between classes a, b found up to components).

    The edges are all needed to join components: pairs of one component that another path already links are left out.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = spark.sparkContext.broadcast(sketch(docs, n))  # 4 MB
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = counts.value
        noise = float(np.median(have)) + 3 * float(np.sqrt(np.median(have)))
        names = ["kind", "doc_id", "h", "n_shingles", "class", "bucket", "postings"]
        for both, sets in _sets(batches, n, "key"):
            ids, hashes = both.field(0), both.field(1)
            keys, m = [_class_of(s) if len(s) else None for s in sets], len(sets)
            yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), ids, hashes, pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
            first = {k: i for i, k in reversed(list(enumerate(keys))) if k is not None}
            chosen = [(k, sets[i], *prefix(sets[i], have, noise, percent, most_match)) for k, i in first.items()]
            if not chosen:
                continue
            about = np.array([(k, len(s), best) for k, s, _, _, best in chosen], np.int64)
            member, pos = np.concatenate([x[2] for x in chosen]), np.concatenate([x[3] for x in chosen])
            own = np.repeat(np.arange(len(chosen)), [len(x[2]) for x in chosen])
            which = ((mix(member) >> U64(44)).astype(np.int64) * buckets) >> 20  # mixed: prefixes prefer small hashes
            order = np.argsort(which, kind="stable")
            cut = np.flatnonzero(np.diff(which[order])) + 1
            packed = []
            for at in np.split(order, cut):
                rows, back = np.unique(own[at], return_inverse=True)
                cls, size, match = about[rows].T
                packed.append(common.pack(cls, size.astype(np.int32), match.astype(np.uint8), back.astype(np.uint32), member[at], pos[at].astype(np.uint32)))
            m = len(packed)
            yield pa.RecordBatch.from_arrays([pa.array([1] * m, pa.int32()), pa.nulls(m, docs_type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(which[order][np.concatenate([[0], cut])].astype(np.int32)), pa.array(packed, pa.binary())], names)

    from pyspark.sql.pandas.types import to_arrow_type

    docs_type = to_arrow_type(docs.schema["doc_id"].dataType)
    raw = common.stored(docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "text").mapInArrow(common.giving_back(post), f"kind int, doc_id {kind}, h long, n_shingles long, class long, bucket int, postings binary"), "jaccard-postings", "kind")
    rows = raw.where("kind = 0").select("doc_id", "h", "n_shingles", "class")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Postings of members that two or more classes have, of all buckets of this task."""
        got = [common.unpack(b) for batch in batches for b in batch.column(0).to_pylist()]
        if not got:
            return
        member = np.concatenate([x[4] for x in got])
        pos = np.concatenate([x[5] for x in got])
        cls, size, match = (np.concatenate([x[i][x[3]] for x in got]) for i in range(3))
        del got
        order = np.lexsort((cls, member))
        member, cls = member[order], cls[order]
        new = np.ones(len(member), bool)
        new[1:] = (member[1:] != member[:-1]) | (cls[1:] != cls[:-1])
        order, member, cls = order[new], member[new], cls[new]
        start = np.ones(len(member), bool)
        start[1:] = member[1:] != member[:-1]
        group = np.cumsum(start) - 1
        twice = np.bincount(group)[group] > 1
        order, member, cls = order[twice], member[twice], cls[twice]
        for a in range(0, len(order), 50_000):
            at = order[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(member[a : a + 50_000].view(np.int64)), pa.array(cls[a : a + 50_000]), pa.array(size[at]), pa.array(pos[at].astype(np.int32)), pa.array(match[at].astype(np.int32))], ["member", "cls", "size", "pos", "match"])

    lists = raw.where("kind = 1").select("postings", "bucket").repartition(buckets, "bucket").select("postings").mapInArrow(common.giving_back(shared), "member long, cls long, size int, pos int, match int")
    lists = plain = common.stored(lists, "jaccard-lists")
    common.discard(raw, "kind=1")
    # Of a class's members only those with other postings can be common: `nth` of them have come at a position.
    own = Window.partitionBy("cls")
    lists = common.stored(lists.withColumns({"nth": F.row_number().over(own.orderBy("pos")), "degree": F.count(F.lit(1)).over(own)}), "jaccard-ranked")
    common.discard(plain)
    common.free_shuffles(spark)

    involved = lists.select("cls").distinct()
    reps = rows.where("class is not null").groupBy("class").agg(F.min(F.struct("doc_id", "h")).alias("rep")).join(involved, F.col("class") == F.col("cls"), "left_semi")
    reps = reps.select(F.col("class").alias("cls"), F.col("rep.doc_id").alias("r_id"), F.col("rep.h").alias("r_h"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in raw], pa.binary())], ["id", "h", "z"])

    held = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(common.giving_back(squeeze), f"id {kind}, h long, z binary")
    held = held.join(reps.hint("merge"), F.col("id").eqNullSafe(F.col("r_id")) & (F.col("h") == F.col("r_h"))).select("cls", "z")
    whole_texts = common.stored(held.dropDuplicates(["cls"]), "jaccard-texts")
    common.free_shuffles(spark)

    def verified(pairs: DataFrame) -> DataFrame:
        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            have: dict[int, np.ndarray] = {}

            def get(cls: int, z: pa.Scalar) -> np.ndarray:
                if cls not in have:
                    if len(have) >= 64:
                        have.clear()
                    have[cls] = _unsqueezed(z.as_py(), n)
                return have[cls]

            for batch in batches:
                ok = []
                for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                    p, q = get(a, x), get(b, y)
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    ok.append(100 * both >= percent * (len(p) + len(q) - both))
                keep = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

        one = pairs.join(whole_texts.select(F.col("cls").alias("a"), F.col("z").alias("x")), "a")
        two = one.join(whole_texts.select(F.col("cls").alias("b"), F.col("z").alias("y")), "b")
        return two.select("a", "b", "x", "y").mapInArrow(common.giving_back(check), "a long, b long")

    # A common member at positions i, j of two sets leaves room for min(nth) common ones up to there and the rests beyond.
    fits = f"100 * least(size, o_size) >= {percent} * greatest(size, o_size)"
    need = f"(({percent} * (size + o_size) + {99 + percent}) div {100 + percent})"
    level = lambda o: f"greatest(1, {o}pos - {o}size + ({percent} * {o}size + 99) div 100) <= least(match, o_match)"
    room = f"least(nth, o_nth) + least(size - pos, o_size - o_pos) >= {need}"

    def candidates(pairs: DataFrame) -> DataFrame:
        """(a, b, n) of the rows cls, o_cls of common members that pass every filter."""
        pairs = pairs.where(f"{fits} and {level('')} and {level('o_')} and {room}")
        sums = pairs.groupBy("cls", "o_cls").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("pos"), F.max("o_pos").alias("o_pos"), *[F.first(c).alias(c) for c in ("size", "o_size", "match", "o_match")])
        return sums.where(f"n >= least(match, o_match) and n + least(size - pos, o_size - o_pos) >= {need}").select(F.col("cls").alias("a"), F.col("o_cls").alias("b"), "n")

    # Stars: each class with one pivot, that of its lists with which it shares most members; a list's pivot is first the class
    # with most shared members and then changes with the round. Only classes of another component than the pivot's are compared.
    edges, marked, held = None, lists.withColumn("root", F.col("cls")), None
    sides = ("cls", "size", "pos", "match", "nth", "root")
    for turn in range(most_stars):
        by = F.xxhash64("cls", F.lit(turn)) if turn else -F.col("degree")
        pivots = marked.groupBy("member").agg(F.min(F.struct(by.alias("o"), *sides)).alias("p"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        pivots = pivots.select("member", *[F.col(f"p.{c}").alias(f"o_{c}") for c in sides])
        star = candidates(marked.join(pivots, "member").where("root <> o_root"))
        best = star.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
        fresh = common.stored(verified(best), "jaccard-edges")
        if fresh.isEmpty():
            common.free_shuffles(spark)
            break
        edges = fresh if edges is None else edges.unionByName(fresh)
        roots = common.stored(connected(edges), "jaccard-roots")
        marked = lists.join(roots, F.col("cls") == F.col("node"), "left").select("member", "cls", "size", "pos", "match", "nth", "degree", F.coalesce("root", "cls").alias("root"))
        before, marked = held, common.stored(marked, "jaccard-marked")
        held = marked
        if before is not None:
            common.discard(before)
        common.free_shuffles(spark)

    # All other candidates, between components only. A list within one component has none.
    mixed = marked.groupBy("member").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("member")
    left = common.stored(marked.join(mixed, "member", "left_semi"), "jaccard-mixed")
    other = left.select("member", *[F.col(c).alias(f"o_{c}") for c in sides])
    both = left.join(other, (left["member"] == other["member"]) & F.expr(f"cls < o_cls and root <> o_root and {fits} and {level('')} and {level('o_')} and {room}"))
    pairs = common.stored(candidates(both).select("a", "b"), "jaccard-pairs")
    common.discard(left)
    common.discard(lists)
    if held is not None:
        common.discard(held)
    common.free_shuffles(spark)
    more = common.stored(verified(pairs), "jaccard-links")
    common.discard(whole_texts)
    common.free_shuffles(spark)
    return rows, more if edges is None else edges.unionByName(more)


def join(docs: DataFrame, n: int = 5, percent: int = 80, most_match: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links, itself included) for every row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows, edges = links(docs, n, percent, most_match)
    roots = connected(edges)
    classes = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    of = classes.join(roots, F.col("class") == F.col("node"), "left").select("class", "least", "n", F.coalesce("root", "class").alias("root"))
    tops = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.stored(of.join(tops, "root").select("class", "n", "component_id"), "jaccard-named")
    found = common.spread_join(rows, named, {"class": "class"}, "n", ["component_id"], ["doc_id", "h"])
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that of least (doc_id, text hash), a null id last; of rows equal in both, any one.

    Rows without a set (null or wordless text) all stay.
    """
    rows, edges = links(docs.select("doc_id", "text"), n, percent)
    roots = connected(edges)
    keys = rows.where("class is not null").groupBy("doc_id", "h", "class").agg(F.count(F.lit(1)).alias("times"))
    classes = keys.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")).alias("least"), F.count(F.lit(1)).alias("n"))
    of = classes.join(roots, F.col("class") == F.col("node"), "left").select("class", "least", "n", F.coalesce("root", "class").alias("root"))
    tops = of.groupBy("root").agg(F.min("least").alias("kept"))
    named = common.stored(of.join(tops, "root").select("class", "n", "kept"), "jaccard-named")
    common.free_shuffles(docs.sparkSession)
    stays = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("h") == F.col("kept.h"))
    marks = common.spread_join(keys, named, {"class": "class"}, "n", ["kept"], ["doc_id", "h"]).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), stays.alias("__stays"), "times")
    marks = common.stored(marks.where("not __stays or times > 1").drop("times"), "jaccard-marks")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__h"))
    if marks.where("__stays").isEmpty():
        return docs.join(marks, same, "left_anti")
    marked = docs.join(marks, same, "left")
    repeated = marked.where("__stays").dropDuplicates(["__id", "__h"])
    return marked.where("__stays is null").unionByName(repeated).drop("__id", "__h", "__stays")
