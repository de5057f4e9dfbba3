"""Line deduplication by a suffix array over line ids, built by distributed prefix doubling. DataFrame functions only.

The lines of all texts (blank ones aside, blanks at their ends cut) are one long sequence of line ids with a border after each text. Suffixes that
share their first 2^k lines have one rank at level k: (id of the first line, number of suffixes with that first line
that come before). Level k+1 orders the suffixes of one rank by the rank 2^k lines further on, so sorting is local to a
rank, and inside it to ranges of the next rank. A suffix alone in its rank, or whose continuation is, shares no longer
run and leaves; so each level holds only repeated runs.

A repeated run counts from `min_words` words on. The least number of lines with which a run starting (or ending) at a
line gets there follows from those lines, so equal runs have equal windows, and the windows inside maximal repeated runs
of at least min_words words cover exactly these runs. A window is an interval of suffixes with a longest common prefix of
at least its lines: it is named by the ranks of its power-of-two parts. Where an equal window starts earlier, in order of
(doc_id, text hash, line), and ends before this one starts, this one is a later copy and its lines are deleted. With one
word a line at least, windows are at most min_words lines, so the number of levels is fixed.

Edge cases: null text stays null; a text left without any line by deletion is dropped with its row (rows that were blank
before stay); rows equal in doc_id and text are one document and get one answer; a null doc_id sorts first; an empty table
gives no rows; other columns are kept. Lines are told apart by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

RANGES = 64
BLANKS = " \t\r\x0b\x0c"
WORD = r"[^\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def lines(docs: DataFrame) -> DataFrame:
    """(d, h, at, seq, line, words): document key, line number, number among its non-blank lines, line id, words."""
    keyed = docs.where("text is not null").select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), F.filter(F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("at"), _trimmed(x).alias("s"))), lambda x: x["s"] != "").alias("all"))
    one = keyed.select("d", "h", F.posexplode("all").alias("seq", "l"))
    return one.select("d", "h", F.col("l.at").alias("at"), "seq", F.xxhash64("l.s").alias("line"), F.regexp_count("l.s", F.lit(WORD)).alias("words"))


def _levels(active: DataFrame, levels: int) -> list[DataFrame]:
    """For k = 0.. the positions whose run of 2^k lines is repeated: d, h, seq, first, below (the rank)."""
    out = [common.stored(active.select("d", "h", "seq", F.col("line").alias("first"), F.lit(0).cast("long").alias("below")), "suffix-0")]
    for k in range(levels - 1):
        here, step = out[-1], 1 << k
        after = here.select(F.col("d").alias("d2"), F.col("h").alias("h2"), (F.col("seq") - step).alias("seq2"), F.col("first").alias("nf"), F.col("below").alias("nb"))
        pairs = here.join(after, F.col("d").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")) & (F.col("seq") == F.col("seq2"))).drop("d2", "h2", "seq2")
        pairs = common.stored(pairs, "suffix-pairs")
        kinds = pairs.groupBy("first", "below", "nf", "nb").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        kinds = kinds.withColumn("part", F.floor((F.col("nf").cast("double") + 2.0**63) / 2.0**64 * RANGES).cast("int"))
        parts = kinds.groupBy("first", "below", "part").agg(F.sum("n").alias("pn"))
        parts = parts.select(F.col("first").alias("f"), F.col("below").alias("b"), F.col("part").alias("p"), F.coalesce(F.sum("pn").over(Window.partitionBy("first", "below").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        inside = F.coalesce(F.sum("n").over(Window.partitionBy("first", "below", "part").orderBy("nf", "nb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = kinds.withColumn("inside", inside).join(parts, (F.col("first") == F.col("f")) & (F.col("below") == F.col("b")) & (F.col("part") == F.col("p")))
        ranked = ranked.select(F.col("first").alias("f"), F.col("below").alias("b"), F.col("nf").alias("f2"), F.col("nb").alias("b2"), (F.col("below") + F.col("base") + F.col("inside")).alias("rank"))
        same = (F.col("first") == F.col("f")) & (F.col("below") == F.col("b")) & (F.col("nf") == F.col("f2")) & (F.col("nb") == F.col("b2"))
        level = common.stored(pairs.join(ranked, same).select("d", "h", "seq", "first", F.col("rank").alias("below")), f"suffix-{k + 1}")
        if level.isEmpty():
            break
        out.append(level)
    return out


def copied_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(d, h, at): the lines to delete."""
    every = lines(docs.select("doc_id", "text"))
    slim = common.stored(every, "lines")
    copies = common.stored(slim.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("line").alias("k"), "n"), "line-copies")
    # Lines with over a thousandth of all rows (so under a thousand lines) are told by a broadcast, and their rows spread by
    # position; the rows of all others meet their line in the join.
    hot = F.col("n") > slim.count() / 1000
    tagged = slim.join(F.broadcast(copies.where(hot).select(F.col("k").alias("hot"))), F.col("line") == F.col("hot"), "left")
    tagged = tagged.withColumn("key", F.when(F.col("hot").isNull(), F.col("line")).otherwise(F.xxhash64("d", "h", "seq"))).withColumn("hot", F.col("hot").isNotNull())
    active = tagged.join(copies.where(~hot).select("k"), F.col("key") == F.col("k"), "left").where("hot or k is not null").groupBy("d", "h", "seq").agg(F.first("at").alias("at"), F.first("line").alias("line"), F.first("words").alias("words"))
    active = common.stored(active, "repeated-lines")
    levels = _levels(active, max(1, (min_words).bit_length()))

    # Windows: stretches of repeated lines, then for each line the least run of lines with min_words words from it on (and
    # up to it). A document's repeated lines are one window partition; texts bound its size.
    doc = Window.partitionBy("d", "h").orderBy("seq")
    runs = active.withColumn("stretch", F.col("seq") - F.row_number().over(doc))
    run = Window.partitionBy("d", "h", "stretch").orderBy("seq")
    runs = runs.withColumn("upto", F.sum("words").over(run)).withColumn("before", F.col("upto") - F.col("words"))
    near = Window.partitionBy("d", "h", "stretch").orderBy("seq").rowsBetween(0, min_words - 1)
    back = Window.partitionBy("d", "h", "stretch").orderBy("seq").rowsBetween(-(min_words - 1), 0)
    runs = runs.withColumn("next", F.collect_list("upto").over(near)).withColumn("prev", F.collect_list("before").over(back))
    ahead = F.size(F.filter("next", lambda x: x - F.col("before") < min_words)) + 1
    behind = F.size(F.filter("prev", lambda x: F.col("upto") - x < min_words)) + 1
    runs = runs.select("d", "h", "seq", ahead.alias("ahead"), F.size("next").alias("room"), behind.alias("behind"), F.size("prev").alias("back"))
    first = runs.where("ahead <= room").select("d", "h", "seq", F.col("ahead").alias("m"))
    last = runs.where("behind <= back").select("d", "h", (F.col("seq") - F.col("behind") + 1).alias("seq"), F.col("behind").alias("m"))
    windows = common.stored(first.unionByName(last).distinct(), "windows").withColumn("name", F.lit(0).cast("long"))

    for k, level in enumerate(levels):  # the parts of a window's length, least power first
        has = F.col("m").bitwiseAND(1 << k) != 0
        at = F.col("seq") + F.col("m").bitwiseAND((1 << k) - 1)
        rank = level.select(F.col("d").alias("d2"), F.col("h").alias("h2"), F.col("seq").alias("at2"), "first", "below")
        found = windows.join(rank, has & F.col("d").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")) & (at == F.col("at2")), "left").where(~has | F.col("first").isNotNull())
        windows = found.select("d", "h", "seq", "m", F.when(has, F.xxhash64("name", F.lit(k), "first", "below")).otherwise(F.col("name")).alias("name"))
    windows = windows.where(F.col("m") < (1 << len(levels)))
    windows = common.stored(windows, "named-windows")
    heads = windows.groupBy("m", "name").agg(F.min(F.struct("d", "h", "seq")).alias("e"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = common.spread_join(windows, common.stored(heads, "window-heads"), {"m": "m", "name": "name"}, "n", ["e"], ["d", "h", "seq"]).where("e is not null")
    own = F.col("d").eqNullSafe(F.col("e.d")) & (F.col("h") == F.col("e.h"))
    later = later.where(~own | (F.col("seq") >= F.col("e.seq") + F.col("m")))
    gone = later.select("d", "h", F.explode(F.sequence("seq", F.col("seq") + F.col("m") - 1)).alias("seq")).distinct()
    where = active.select(F.col("d").alias("d2"), F.col("h").alias("h2"), F.col("seq").alias("seq2"), "at")
    return gone.join(where, F.col("d").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")) & (F.col("seq") == F.col("seq2"))).select("d", "h", "at")


def dedup(docs: DataFrame, min_words: int = 50, report: bool = False) -> DataFrame:
    """docs with the text less its copied lines, rows left without a line dropped; report: add lines_deleted, keep all rows."""
    gone = copied_lines(docs, min_words).groupBy("d", "h").agg(F.sort_array(F.collect_list("at")).alias("__gone"))
    gone = common.stored(gone, "deleted-lines").select(F.col("d").alias("__d"), F.col("h").alias("__h"), "__gone")
    gone = gone.hint("merge")  # the same join at every size; lines to delete have no size bound
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__h")), "left")
    # The lines are an own column of the rows that lose some, and the kept numbers a hash difference: linear in the lines.
    joined = joined.withColumn("__lines", F.when(F.col("__gone").isNotNull(), _lines(F.col("text"))))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone"), lambda i: F.get("__lines", i))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    if report:
        return joined.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns], F.coalesce(F.size("__gone"), F.lit(0)).alias("lines_deleted"))
    joined = joined.where(F.col("__gone").isNull() | F.exists(kept, lambda x: _trimmed(x) != ""))
    return joined.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns])
