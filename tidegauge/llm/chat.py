"""Chat formatting as a prefix tree: conversations that share initial turns share their tokens.

The template is <|im_start|>role, a line break, the text, <|im_end|> and a line break for each turn; inside roles and texts a backslash
is doubled and "<|" becomes "<\\|", so no text can end or open a turn, and both are undone exactly.

A conversation's path is the chain of hashes of its turns. Distinct paths in lexicographic order are a depth-first
walk of the tree: turns shared with the path before are there already, the others are emitted. A pack is the stream of one
range of paths. Where a range begins below turns that an earlier one emitted, these are carried, not emitted again: so every
shared turn is in the output once, however many packs its conversations fill. Which turns a pack carries, and from where, follows
from the first and last path of each range. Each segment (a turn) has its place in its pack, position ids that continue its
parent's, and the intervals (pack, from, to) that it may attend to: its ancestors and itself, neighbours merged. Tokens are
those of a byte-level `tokenizer` file; code points where it is None.

Edge cases: null text or role counts as empty; turns go by (turn, role, text), a null turn first; repeated rows are turns of
their own; rows with a null conv_id are one conversation; equal conversations are one path, whatever their number; an empty
table gives no rows; other columns are ignored. A conversation is one row (it is one training text), so it has to fit a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, packing

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
SEGMENT = "pack int, segment long, depth int, node string, role string, formatted string, tokens array<int>, start long, length long, position long, carried int, own array<struct<from:long,to:long>>, loss_from long, loss_to long, leaf string"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn in the template, and where the text lies in it."""
    head = f"{OPEN}{escape(role)}\n" if "\n" not in role else f"{OPEN}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, path (hex chain, 16 digits a turn), leaf, turns: one row per conversation."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    links = F.transform("turns", lambda t: F.sha2(F.concat(t["role"], F.lit("\n"), t["text"]), 256))
    chain = F.aggregate(links, F.struct(F.lit("").alias("p"), F.lit("").alias("last")), lambda acc, x: F.struct(F.concat(acc["p"], F.substring(F.sha2(F.concat(acc["last"], x), 256), 1, 16)).alias("p"), F.sha2(F.concat(acc["last"], x), 256).alias("last")))
    return rows.withColumn("c", chain).select("conv_id", F.col("c.p").alias("path"), F.col("c.last").alias("leaf"), "turns")


def _shared(a: str, b: str) -> int:
    """Turns that two paths share."""
    n = 0
    while 16 * n < min(len(a), len(b)) and a[16 * n : 16 * n + 16] == b[16 * n : 16 * n + 16]:
        n += 1
    return n


def carried(bounds: list[tuple[int, str, str]]) -> dict[int, tuple[str, list[int]]]:
    """pack -> (the path of the turns that it carries, the pack that emitted each), from (pack, first path, last path)."""
    out, before, last = {}, None, ""
    for pack, low, high in sorted(bounds, key=lambda x: x[1]):
        d = _shared(last, low)
        owners = []
        if before is not None:
            through = min(len(out[before][1]), _shared(*next((l, h) for p, l, h in bounds if p == before)))
            owners = [out[before][1][k] if k < through else before for k in range(d)]
        out[pack] = low[: 16 * d], owners
        before, last = pack, high
    return out


def tree(conversations: DataFrame, tokenizer: str | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, trunk, members): the stored stream with attends (pack, from, to); for each pack the segments that it carries;
    (conv_id, leaf). A segment's leaf names the path that ends with it."""
    spark = conversations.sparkSession
    each = common.stored(paths(conversations), "chat-paths")
    distinct = each.groupBy("leaf").agg(F.first("path").alias("path"), F.first("turns").alias("turns"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = common.stored(distinct.repartitionByRange(n, "path").withColumn("pack", F.spark_partition_id()), "chat-ranges")
    bounds = [tuple(r) for r in ranged.groupBy("pack").agg(F.min("path"), F.max("path")).collect()]  # a row a partition
    above = spark.sparkContext.broadcast(carried(bounds))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = packing.encoder(tokenizer) if tokenizer else None
        names = [x.split()[0] for x in SEGMENT.replace("struct<from:long,to:long>", "x").split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])), pa.int64(), pa.int64(), pa.string()]
        stack: list[dict] = []
        now, at, segment, out = None, 0, 0, []
        seen, have, last = None, 0, ""

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([s[c] for s in out], k) for c, k in zip(names, kinds)], names)

        for batch in batches:
            # What each path adds, then the tokens of all of it in one call.
            rows, texts = [], []
            for pack, leaf, path, turns in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if pack != seen:
                    seen, have, last = pack, 0, above.value[pack][0]
                shared = _shared(path, last)
                first = min(have, shared)  # below shared only where a pack begins: the turns that it carries
                shaped = [format_turn(t["role"], t["text"]) for t in turns[first:]]
                rows.append((pack, leaf, path, turns, shared, first, shaped))
                texts += [x[0] for x in shaped]
                have, last = len(turns), path
            tokens = encode(texts) if encode else repeat(None)
            for pack, leaf, path, turns, shared, first, shaped in rows:
                if pack != now:
                    now, at, segment, stack = pack, 0, 0, []
                del stack[first:]
                for depth, (text, a, b), ids in zip(range(first, len(turns)), shaped, tokens):
                    role, size = turns[depth]["role"], len(text) if ids is None else len(ids)
                    up = stack[-1] if stack else None
                    entry = {"pack": pack, "segment": segment, "depth": depth, "node": path[16 * depth : 16 * depth + 16], "role": role, "formatted": text, "tokens": ids, "start": at, "length": size, "position": up["position"] + up["length"] if up else 0, "carried": up["carried"] if up else 0, "own": up["own"] if up else [], "loss_from": a if role in loss_roles else None, "loss_to": b if role in loss_roles else None, "leaf": leaf if depth == len(turns) - 1 else None}
                    stack.append(entry)
                    if depth < shared:
                        entry["carried"] = depth + 1
                        continue
                    own = [*entry["own"]]
                    if own and own[-1]["to"] == at:
                        own[-1] = {"from": own[-1]["from"], "to": at + size}
                    else:
                        own.append({"from": at, "to": at + size})
                    entry["own"] = own
                    out.append(entry)
                    at, segment = at + size, segment + 1
                if len(out) > 2000:
                    yield done()
                    out = []
        if out:
            yield done()

    ordered = ranged.select("pack", "leaf", "path", "turns").repartition(n, "pack").sortWithinPartitions("pack", "path")
    segments = common.stored(ordered.mapInArrow(walk, SEGMENT), "chat-emitted")
    refs = [(pack, k, owner, path[16 * k : 16 * k + 16]) for pack, (path, owners) in carried(bounds).items() for k, owner in enumerate(owners)]
    refs = common.rows(spark, refs, "to int, at int, owner int, which string")
    trunk = segments.join(refs, (F.col("pack") == F.col("owner")) & (F.col("node") == F.col("which")))
    trunk = common.stored(trunk.select("to", "at", "owner", "start", "length", "position", "formatted", "loss_from", "loss_to"), "chat-trunk")
    spans = trunk.groupBy("to").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "owner", "start", "length"))), lambda x: F.struct(x["owner"].alias("pack"), x["start"].alias("from"), (x["start"] + x["length"]).alias("to"))).alias("above"))
    none = F.array().cast("array<struct<pack:int,from:long,to:long>>")
    own = F.transform("own", lambda x: F.struct(F.col("pack").alias("pack"), x["from"].alias("from"), x["to"].alias("to")))
    whole = segments.join(spans, F.col("pack") == F.col("to"), "left")
    whole = whole.withColumn("attends", F.concat(F.when(F.col("carried") > 0, F.slice("above", F.lit(1), F.col("carried"))).otherwise(none), own))
    return common.stored(whole.drop("to", "above", "own"), "chat-segments"), trunk, each.select("conv_id", "leaf")


def digests(segments: DataFrame, trunk: DataFrame) -> DataFrame:
    """Read the stream back: for each leaf, along its attention intervals, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []  # segments on the way to this one
        out, pack = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["pack"] != pack:
                    pack, held = row["pack"], []
                if row["segment"] < 0:
                    held.append(row)
                    continue
                held = [h for h in held if any(s["pack"] == h["home"] and s["from"] <= h["start"] and h["start"] + h["length"] <= s["to"] for s in row["attends"])]
                held.append(row)
                if sum(h["length"] for h in held[:-1]) != row["position"]:
                    raise ValueError(f"position ids of pack {pack} are broken at segment {row['segment']}")
                if row["leaf"] is None:
                    continue
                whole = "".join(h["formatted"] for h in held)
                turns = parse(whole)
                loss = "".join(unescape(h["formatted"][h["loss_from"] : h["loss_to"]]) for h in held if h["loss_from"] is not None)
                out.append((row["leaf"], len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], ["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out = []

    columns = ["pack", "home", "segment", "start", "length", "position", "formatted", "attends", "loss_from", "loss_to", "leaf"]
    stream = segments.withColumn("home", F.col("pack")).select(columns)
    kept = trunk.select(F.col("to").alias("pack"), F.col("owner").alias("home"), (F.col("at") - 2**31).cast("long").alias("segment"), "start", "length", "position", "formatted", F.lit(None).cast("array<struct<pack:int,from:long,to:long>>").alias("attends"), "loss_from", "loss_to", F.lit(None).cast("string").alias("leaf"))
    stream = stream.unionByName(kept).repartition(n, "pack").sortWithinPartitions("pack", "segment")
    return stream.mapInArrow(back, "leaf string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
