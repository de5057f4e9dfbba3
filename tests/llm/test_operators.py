"""Operators against brute force, on small corpora and on edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tidegauge.llm import ann, chat, common, components, decontam, jaccard, katz, line_dedup, packing, quality, queries, shards, warc, words

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, None), (2, ""), (3, "one two"), (4, "one two"), (4, "one two"), (None, "a b c d e f"), (5, " \n\t "), (6, "word " * 30000), (7, "Ünï cödé " * 40), (8, "a b c d e f g")]


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql("select " + ", ".join(cols) + f" from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(cols).collect()))) == sorted(map(repr, want))


def test_word_hashes():
    texts = ["Aa bb  cc", "", None, "x\ty\nz aa", "é É aa"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    for most in (1, 1 << 20):
        seen, counts = [], []
        for chunk in words.texts(iter([batch]), most=most):
            s, e, first = chunk.words(words.SPACE)
            seen += list(chunk.hashes(s, e))
            counts += list(np.diff(first))
        assert counts == [len(spaced(t)) for t in texts]
        assert len(set(seen)) == len({w for t in texts for w in spaced(t)})
        assert seen[0] == seen[6] == seen[-1]


def brute_components(rows):
    sets, parent = [], list(range(len(rows)))
    for _, t in rows:
        w = spaced(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        near = Counter(j for g in s for j in by[g])
        for j, n in near.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for g in s:
            by[g].append(i)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)].append(d)
    return [(d, len(s), min(ids[root(i)]) if ids[root(i)] else None) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def near_copies(seed, groups=6, size=12):
    rng, out = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(15)]
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 60, 150]))] + passage * (g % 2)
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append((len(out), " ".join(copy)))
    return out


@pytest.mark.parametrize("rows", [ODD, near_copies(1), near_copies(2, 3, 40)], ids=["odd", "near", "large"])
def test_jaccard(docs, rows):
    got = [tuple(r) for r in jaccard.join(docs(rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_components(rows)))


def test_jaccard_keeps_one(docs):
    rows = near_copies(3)
    want = {c for _, _, c in brute_components(rows)}
    assert {r["doc_id"] for r in jaccard.one_each(docs(rows)).collect()} == want


def test_jaccard_keeps_one_of_repeated_and_null_ids(docs):
    """A clean row stays whatever else has its id; of repeated rows and of copies without ids one stays."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    rows = [(0, a), (1, a), (1, b), (None, a), (2, c), (2, c), (3, c + " more"), (None, d), (None, d + " more"), (None, d), (None, e), (7, None), (7, None), (8, " "), (8, " ")]
    for part, want in ((rows, [(0, a), (1, b), (2, c), (None, e), (7, None), (7, None), (8, " "), (8, " ")]), (rows[:4], [(0, a), (1, b)])):
        got = [(r["doc_id"], r["text"]) for r in jaccard.one_each(docs(part)).collect()]
        group = [x for x in got if x[1] in (d, d + " more")]
        assert len(group) == (part is rows)
        assert sorted(map(repr, set(got) - set(group))) == sorted(map(repr, set(want)))
        assert len(got) == len(want) + len(group)


def test_components_converge_or_fail(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {tuple(r) for r in components.components(edges).collect()} == {(i, 0) for i in range(41)}
    with pytest.raises(RuntimeError, match="not converged"):
        components.components(edges, most_rounds=1)


def test_connected_in_one_task(spark):
    """Edges that fit a task and edges dealt out give the same roots; loops, repeated and null edges add none."""
    rng = np.random.default_rng(3)
    ids = rng.integers(-(2**63), 2**63 - 1, 300)
    pairs = [*map(tuple, ids[rng.integers(0, 300, (200, 2))].tolist()), (5, 5), (6, 7), (7, 6), (6, 7), (None, 8), (9, None)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    one, dealt = ({tuple(r) for r in components.connected(edges, most).collect()} for most in (1 << 20, 10))
    assert one == dealt and {(6, 6), (7, 6)} < one and not {5, 8, 9} & {n for n, _ in one}
    assert components.connected(edges.where("false")).collect() == []


def test_jaccard_leaves_few_task_records(spark, docs):
    """Every task leaves a record with the driver: joining up a few edges takes a task each time, not rounds of jobs."""
    merging, status = "spark.sql.adaptive.coalescePartitions.enabled", spark.sparkContext.statusTracker()
    spark.conf.set(merging, "false")
    spark.sparkContext.setJobGroup("few records", "")
    try:
        assert len(jaccard.one_each(docs(near_copies(3))).collect()) == len({c for _, _, c in brute_components(near_copies(3))})
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset(merging)
    stages = {s for j in status.getJobIdsForGroup("few records") for s in status.getJobInfo(j).stageIds}
    assert sum(i.numCompletedTasks for i in map(status.getStageInfo, stages) if i) < 700


def test_jaccard_empty(docs):
    assert jaccard.join(docs([]).where("false")).collect() == []


BLANKS = " \t\r\x0b\x0c"


def brute_lines(rows, least=50, texts=False):
    seqs = []
    for d, t in sorted((r for r in set(rows) if r[1] is not None), key=lambda r: (r[0] is not None, r[0])):
        seqs.append((d, [(i, s.strip(BLANKS)) for i, s in enumerate(t.split("\n")) if s.strip(BLANKS)]))
    windows, first = [], {}
    for k, (_, ls) in enumerate(seqs):
        count = [len(re.findall(r"[^\x20\x09-\x0D]+", s)) for _, s in ls]
        found = set()
        for a in range(len(ls)):
            for step in (1, -1):
                total, b = 0, a
                while 0 <= b < len(ls):
                    total += count[b]
                    if total >= least:
                        found.add((min(a, b), abs(a - b) + 1))
                        break
                    b += step
        for a, m in sorted(found):
            name = tuple(s for _, s in ls[a : a + m])
            windows.append((name, k, a, m))
            first.setdefault(name, (k, a))
            first[name] = min(first[name], (k, a))
    gone = defaultdict(set)
    for name, k, a, m in windows:
        k0, a0 = first[name]
        if k0 != k or a >= a0 + m:
            gone[k] |= {seqs[k][1][x][0] for x in range(a, a + m)}
    if texts:
        where = {(d, t): k for k, (d, t) in enumerate(sorted((r for r in set(rows) if r[1] is not None), key=lambda r: (r[0] is not None, r[0])))}
        left = [(d, t if (k := where.get((d, t))) is None or k not in gone else "\n".join(s for i, s in enumerate(t.split("\n")) if i not in gone[k]), (k in gone) if k is not None else False) for d, t in rows]
        return [(d, t) for d, t, cut in left if not cut or any(s.strip(BLANKS) for s in t.split("\n"))]
    return {seqs[k][0]: len(v) for k, v in gone.items()}


def test_line_dedup(docs, corpus):
    rng = random.Random(4)
    pool = [" ".join(f"p{rng.randrange(30)}" for _ in range(rng.choice([1, 8, 30, 60]))) for _ in range(25)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 30)))) for i in range(60)] + [(100, None), (101, ""), (102, " \n "), (None, "x y"), (103, pool[0])]
    got = {r["doc_id"]: r["lines_deleted"] for r in line_dedup.dedup(docs(rows), report=True).collect() if r["lines_deleted"]}
    assert got == brute_lines(rows)
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs(rows)).collect()}
    assert {100, 101, 102, None} <= set(kept) and kept[102] == " \n "
    real = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    assert {r["doc_id"]: r["lines_deleted"] for r in line_dedup.dedup(corpus, report=True).collect() if r["lines_deleted"]} == brute_lines(real)
    assert line_dedup.dedup(docs([]).where("false")).collect() == []


def test_line_dedup_of_blanks(docs):
    """Tabs part words, runs of blanks are no words, and line ends of both kinds make equal lines."""
    tabs, wide = "\t".join(f"t{i}" for i in range(60)), "a" + " " * 80 + "b"
    rows = [(1, f"{tabs}\r\nfirst\r\n\t\r"), (2, f"second\n{tabs}\n"), (3, f"third\n{wide}"), (4, f"fourth\n{wide}"), (5, f"\t\r\n{tabs}")]
    got = {r["doc_id"]: (r["lines_deleted"], r["text"]) for r in line_dedup.dedup(docs(rows), report=True).collect()}
    assert {d: n for d, (n, _) in got.items() if n} == brute_lines(rows) == {2: 1, 5: 1}
    assert got[2][1] == "second\n" and got[1][1] == rows[0][1] and got[4][1] == rows[3][1]
    assert 5 not in {r["doc_id"] for r in line_dedup.dedup(docs(rows)).collect()}


def test_line_dedup_of_a_long_text(docs):
    """A text of very many lines, half of them copies, takes time in proportion to its lines."""
    block = "\n".join(" ".join(f"b{i}w{j}" for j in range(12)) for i in range(2000))
    own = "\n".join(f"own {i}" for i in range(2000))
    rows = [(1, block), (2, "\n".join([own, block] * 2))]
    got = {r["doc_id"]: r["lines_deleted"] for r in line_dedup.dedup(docs(rows), report=True).collect()}
    assert got == {1: 0, 2: 6000}


def test_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(30):
        items = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 80))]
        capacity = rng.randrange(60, 120)
        bins = []
        for w in sorted(items, reverse=True):
            fits = [b for b in range(len(bins)) if bins[b] >= w]
            at = min(fits, key=lambda b: (bins[b], b)) if fits else len(bins)
            if not fits:
                bins.append(capacity)
            bins[at] -= w
        runs, n = shards.best_fit_decreasing(list(Counter(items).items()), capacity)
        left = [capacity] * n
        for w, a, b, at in runs:
            left[at] -= w * (b - a)
        assert sorted(left) == sorted(bins) and min(left) >= 0


def test_shards(docs, corpus):
    got = shards.shard(corpus).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 8 and max(sizes.values()) <= 1.02 * sum(sizes.values()) / 8
    rows = ODD + [(100 + i, "hot") for i in range(50)]
    got = shards.shard(docs(rows)).collect()
    assert len(got) == len(rows)
    where, slots = defaultdict(set), defaultdict(list)
    for r in got:
        where[(r["text_crc32"], r["size"])].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(v) == 1 for v in where.values()) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert shards.shard(docs([]).where("false")).collect() == []


def test_packing(docs, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for frame in (corpus, docs(ODD + [(9, "a <|endoftext|> b")])):
        rows = [tuple(r) for r in packing.pack(frame).collect()]
        fill, by = defaultdict(list), defaultdict(list)
        for d, start, length, crc, total, sequence, offset in rows:
            fill[sequence].append((offset, length))
            by[d].append((start, length, crc, total))
        for parts in fill.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024
        if frame is corpus:
            used = sum(length for parts in fill.values() for _, length in parts)
            assert used > 0.95 * 1024 * len(fill)
            for d, t in [(r["doc_id"], r["text"]) for r in corpus.limit(30).collect()]:
                ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4")
                for start, length, crc, total in by[d]:
                    assert total == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
        else:
            assert [x[3] for x in by[1]] == [1] and len(by[4]) == 2
    assert packing.pack(docs([]).where("false")).collect() == []


def test_packing_ids():
    """The ids of the library, on long runs of one class of characters, special strings and a table that outgrows what is kept."""
    import public_tokenizers
    from tokenizers import Tokenizer

    whole, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(2)
    some = [" ", "\t", "\n", "\r\n", "\x1c", "\x85", "\xa0", "a", "é", "1", "²", "'", "s", "'ll", "日本", "\u200b", "\u3000", "\u0301", "😀", "_", "<|", "|>", "\x00", "\U0001d4b3"]
    texts = [c * 1_000_000 for c in (" ", "\n", "a", "1", "'")] + [" " * 500_000 + "a", "a <|endoftext|> b", ""] + [t or "" for _, t in ODD]
    texts += ["".join(rng.choices(some, k=rng.randint(1, 14))) for _ in range(3000)]
    encode = packing.Encoder(most=500)
    for a in range(0, len(texts), 64):
        for t, ids in zip(texts[a : a + 64], encode(texts[a : a + 64]), strict=True):
            assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("percent", (100, 90, 50, 0))
def test_packing_takes_the_sequence_of_least_cost(percent):
    """Piece by piece: longest first, to the open sequence of least cost that has room."""
    rng = random.Random(percent)
    for hot in (0, 300):
        counts = Counter(rng.choice((rng.randrange(1, 1025), rng.randrange(1, 60), 1024)) for _ in range(700))
        if hot:
            counts[hot] += 400
        cost, fill, want = [], [], Counter()
        opened = -(-sum(l * c for l, c in counts.items() if l < 1024) // 1024) * percent // 100
        cost, fill = [0.0] * opened, [0] * opened
        for l in sorted((l for l in counts if l < 1024), reverse=True):
            for left in range(counts[l], 0, -1):
                room = [i for i in range(len(fill)) if fill[i] + l <= 1024]
                if not room:
                    more = -(-left // (1024 // l))
                    room = range(len(fill), len(fill) + more)
                    cost, fill = cost + [0.0] * more, fill + [0] * more
                at = min(room, key=lambda i: (cost[i], fill[i], i))
                want[counts[1024] + at, fill[at], l] += 1
                cost[at], fill[at] = cost[at] + (l + l * l / 512), fill[at] + l
        got = Counter((first + i, offset, l) for l, a, b, first, offset in packing._assign(counts, 1024, 512, percent)[0] if l < 1024 for i in range(b - a))
        assert got == want


def test_packing_padding():
    """Little padding where a third of the rests have one length, and where all texts are short."""
    rng = random.Random(8)
    skewed = Counter([rng.randrange(1, 1024) for _ in range(4000)] + [300] * 2000)
    for counts, most in ((skewed, 0.045), (Counter({300: 3000}), 0.125), (Counter([300] * 1000 + [rng.randrange(1, 400) for _ in range(2000)]), 0.025)):
        fill, at = Counter(), Counter()
        for l, a, b, first, offset in packing.assign(counts, 1024):
            assert a == at[l]
            at[l] = b
            for sequence in range(first, first + b - a):
                assert fill[sequence] == offset
                fill[sequence] += l
        assert at == counts and max(fill.values()) <= 1024 and sorted(fill) == list(range(len(fill)))
        assert sum(fill.values()) >= (1 - most) * 1024 * len(fill)


def test_warc_reads_what_is_listed(spark, tmp_path):
    """Files of lost attempts and unfinished ones stay unread; columns with inner names; equal rows have records of their own."""
    rows = [(1, "u", "a", 5, "x"), (1, "u", "a", 5, "x"), (2, "v", "b", 6, "y")]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string, size int, first string"), str(tmp_path))
    one = next(f for f in tmp_path.iterdir() if f.name.startswith("part"))
    (tmp_path / "part-000000-0000-99.warc.gz").write_bytes(one.read_bytes())
    (tmp_path / "_part-000000-0000-98.warc.gz").write_bytes(one.read_bytes()[:40])
    got = warc.read(spark, str(tmp_path)).collect()
    assert sorted(r["page_id"] for r in got) == [1, 1, 2] and len({r["record_id"] for r in got}) == 3
    (tmp_path / "_files").unlink()
    assert warc.read(spark, str(tmp_path)).count() > 3


def test_shards_by_bundles(docs):
    """Light groups packed in bundles: whole groups, nearly even shards, gapless slots."""
    rng = random.Random(4)
    rows = [(i, "x" * 5000 + str(i) if i % 40 == 0 else f"t{rng.randrange(900)} " * rng.randrange(1, 4)) for i in range(3000)]
    got = shards.shard(docs(rows), 8, heavy=256, bundles=128).collect()
    size, shard_of = Counter(), {}
    for r in got:
        size[r["shard"]] += r["size"]
        assert shard_of.setdefault((r["text_crc32"], r["size"]), r["shard"]) == r["shard"]
    assert len(got) == 3000 and max(size.values()) - min(size.values()) < 0.02 * sum(size.values()) / 8
    for k in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))


def test_warc(spark, tmp_path):
    rows = [(3, "u3", "same"), (1, "u1", "same"), (2, "u2\r\nx", None), (4, None, ""), (5, "u", "é" * 50000), (None, "n", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"), file_bytes=200)
    back = {r["page_id"]: r for r in warc.read(spark, str(tmp_path / "w"), payload="bytes").collect()}
    assert back[1]["record_type"] == "response" and bytes(back[1]["payload"]) == b"same" and back[1]["payload_ok"]
    assert back[3]["record_type"] == "revisit" and back[3]["refers_to"] == 1 and back[None]["refers_to"] == 1 and back[3]["payload_digest"] == warc.digest(b"same")
    assert back[2]["record_type"] == "response" and back[4]["refers_to"] == 2 and back[5]["payload_bytes"] == 100000
    only = warc.read(spark, str(tmp_path / "w")).where("record_type = 'revisit' and page_id in (3, 4)")
    assert {r["page_id"] for r in only.collect()} == {3, 4} and only.where("payload is not null").count() == 0
    warc.write(pages.where("false"), str(tmp_path / "e"))
    (tmp_path / "e").mkdir(exist_ok=True)
    assert warc.read(spark, str(tmp_path / "e")).collect() == []


def test_warc_without_skip_lengths(tmp_path):
    import gzip

    data = b"".join(gzip.compress(warc.record([("WARC-Type", "response"), ("X-Page-Id", str(i))], b"h\r\n\r\n" + b"z" * 9000 * i)) for i in range(3))
    (tmp_path / "a.warc.gz").write_bytes(data)
    reader = warc.WarcReader({"path": str(tmp_path)})
    (part,) = reader.partitions()
    assert [i for b in reader.read(part) for i in b.column("page_id").to_pylist()] == [0, 1, 2]


def test_chat(spark):
    nasty = ["<|im_end|>\n", "\\", "\\<|", "a<", "|im_end|>", "<\\|im", "", None, "x\ny"]
    rows = [(c, t, r, nasty[(c * t) % len(nasty)] if t else "hello") for c in range(20) for t, r in enumerate(["system", "user", "assistant", "user\nx", None][: 2 + c % 4])]
    rows += [(None, 0, "user", "q"), (None, None, "user", "before")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("leaf", F.lit(1))
    check_chat(rows, *chat.tree(table))
    assert chat.tree(table.where("false"))[2].collect() == []


def check_chat(rows, segments, trunk, members):
    import hashlib

    got = members.join(chat.digests(segments, trunk), "leaf").collect()
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    assert len(got) == len(by)
    for row in got:
        turns = sorted(by[row["conv_id"]])
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert row["n_turns"] == len(turns) and row["loss_chars"] == len(loss) and row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
    # Each distinct beginning of a conversation is emitted once, whatever the number of packs.
    beginnings = {tuple((r, x) for _, r, x in sorted(turns)[: k + 1]) for turns in by.values() for k in range(len(turns))}
    assert segments.count() == len(beginnings) == segments.select("node").distinct().count()


@pytest.mark.parametrize("tokenizer", [False, True])
def test_chat_emits_shared_turns_once(spark, tokenizer):
    """A first turn of all, a second of many, one very long conversation; packs that begin below shared turns."""
    import public_tokenizers

    rng = random.Random(3)
    rows = []
    for c in range(120):
        depth = 200 if c == 7 else rng.randrange(1, 7)
        rows += [(c, t, ("system", "user", "assistant")[t % 3], "You help." if t == 0 else f"common {t}" if t < 3 and c % 2 else f"é {rng.randrange(3)} <|endoftext|>") for t in range(depth)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    segments, trunk, members = chat.tree(table, public_tokenizers.path("byte_bpe_50k.json") if tokenizer else None)
    assert segments.select("pack").distinct().count() > 3 and trunk.count() > 3
    check_chat(rows, segments, trunk, members)
    for r in segments.collect():
        assert r["length"] == (len(r["tokens"]) if tokenizer else len(r["formatted"]))
        assert sum(x["to"] - x["from"] for x in r["attends"]) == r["position"] + r["length"] and r["attends"][-1]["to"] == r["start"] + r["length"]


def brute_katz(rows, held, order=3, k=5):
    """(n_tokens, n_known, train_tokens, base_score, score) of each row, by dictionaries of tuples."""
    texts = [["\1"] * (order - 1) + spaced(t) + ["\0"] for _, t in rows]
    grams = [Counter() for _ in range(order)]
    for w, h in zip(texts, held):
        if not h:
            for i in range(order - 1, len(w)):
                for m in range(order):
                    grams[m][tuple(w[i - m : i + 1])] += 1
    n, v = sum(grams[0].values()), len(grams[0])
    d = [katz.discounts([0.0] + [float(sum(1 for x in c.values() if x == r)) for r in range(1, k + 2)], k) for c in grams]
    star = lambda c, m: d[m][c] * c if c <= k else float(c)
    sums = [defaultdict(lambda: [0, 0.0, 0.0]) for _ in range(order)]

    def p(words):
        m = len(words) - 1
        low = p(words[1:]) if m else 1.0
        if words[:-1] not in sums[m]:
            return low
        c, given, s = sums[m][words[:-1]]
        if given < 1e-9 * c:
            c, given = c + 1, 1.0
        return star(grams[m][words], m) / c if grams[m][words] else given / c / (1 - s) * low

    for m in range(order):
        found = defaultdict(lambda: [0, 0.0, 0.0])
        for words, c in grams[m].items():
            x = found[words[:-1]]
            x[0] += c
            x[1] += c - star(c, m)
            x[2] += p(words[1:]) if m else 0.0
        sums[m] = found
    for m in range(1, order):
        for x in random.Random(1).sample(sorted(sums[m]), min(12, len(sums[m]))):
            assert abs(sum(p((*x, y)) for y, in grams[0]) + p((*x, "\2")) - 1) < 1e-9
    own = [w[order - 1 :] for w in texts]
    return [(len(w), sum(1 for x in w if grams[0][x,]), n, sum(math.log10((grams[0][x,] + 0.5) / (n + 0.5 * (v + 1))) for x in w), sum(math.log10(p(tuple(t[i - order + 1 : i + 1]))) for i in range(order - 1, len(t)))) for w, t in zip(own, texts)]


#: Contexts of every kind: one word with most tokens, one pair, one word over and over, counts that are all above k.
SKEWED = [(i, " ".join(["of the", f"w{i % 17} of the", "a a a a", f"x{i} y{i % 5}", "the"][(i * 7 + j) % 5] for j in range(20))) for i in range(90)]


@pytest.mark.parametrize("which,order,bucket_bytes", [("odd", 3, 16 << 20), ("none", 3, 1000), ("corpus", 3, 200_000), ("corpus", 2, 16 << 20), ("skewed", 3, 1500), ("skewed", 4, 700), ("skewed", 2, 700), ("odd", 1, 1000)])
def test_katz(docs, corpus, which, order, bucket_bytes):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()] if which == "corpus" else SKEWED if which == "skewed" else ODD
    frame = corpus if which == "corpus" else docs(rows)
    column = F.lit(True) if which == "none" else F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    held = [which == "none" or (d is not None and zlib.crc32(str(d).encode()) % 5 == 1) for d, _ in rows]
    got = katz.score(frame, column, order=order, vocabulary=60, chunk_bytes=100_000 if which == "corpus" else 1000, bucket_bytes=bucket_bytes).collect()
    want = brute_katz(rows, held, order)
    have = sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
    want = sorted((repr(d), *w) for (d, _), w in zip(rows, want))
    assert [x[:4] for x in have] == [x[:4] for x in want]
    for a, b in zip(have, want):
        assert a[4] == pytest.approx(b[4], rel=1e-9, abs=1e-9) and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)


def test_katz_runs():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 5000):
        key = rng.integers(0, 1 + n // 3, n)
        by, start = katz._stable(key)
        assert by.tolist() == np.argsort(key, kind="stable").tolist()
        assert start.tolist() == katz._runs(np.sort(key)).tolist()
        assert katz._lengths(start, n).tolist() == np.unique(key, return_counts=True)[1].tolist()


def test_katz_merged_bounded():
    """A bucket's n-grams are arrays throughout: no Python object for each, which cost more time and memory than sorting them."""
    import tracemalloc

    n, size = 200_000, 1 << 10
    rng = np.random.default_rng(6)
    message = [np.arange(10, 20, dtype=np.uint64), *(rng.integers(0, size, n).astype(np.uint32) for _ in range(3)), np.ones(n, np.uint32)]
    tracemalloc.start()
    others, cols, sums, place = katz._merged([message, message], 3, size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sums.sum() == 2 * n and all((cols[i][place[:n]] == message[1 + i]).all() for i in range(3))
    assert peak < 75 * 2 * n


def test_katz_sums_by_wave(docs, monkeypatch):
    """Stored sums are one message a chunk and wave however many buckets there are; equal chunks share an id and keep their rows."""
    kept, stored = [], common.stored

    def noted(df, name="cut", partition_by=None):
        out = stored(df, name, partition_by)
        kept.extend([out] if name == "katz-sums" else [])
        return out

    monkeypatch.setattr(katz.common, "stored", noted)
    once = [(i, f"w{i} w{i + 1} w{i % 7} some words that all have") for i in range(40)]
    rows = once + once + [(99, None)]
    frame = docs(once).coalesce(1).unionByName(docs(once).coalesce(1)).unionByName(docs(rows[-1:]).coalesce(1))
    got = katz.score(frame, F.col("doc_id") % 5 == 1, vocabulary=20, bucket_bytes=200).collect()
    assert 0 < sum(x.count() for x in kept) <= 2 * 4
    have = sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
    want = sorted((d, *w) for (d, _), w in zip(rows, brute_katz(rows, [d % 5 == 1 for d, _ in rows])))
    assert [x[:4] for x in have] == [x[:4] for x in want]
    for x, y in zip(have, want):
        assert x[4:] == pytest.approx(y[4:], rel=1e-9, abs=1e-9)


def test_katz_empty(docs):
    assert katz.score(docs([]).where("false"), F.lit(False)).collect() == []


def test_ann(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(800, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[300:420] = x[300]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [1.0]), (905, [])]
    indexed, books = ann.index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert indexed.count() == 800
    got = defaultdict(list)
    for r in ann.search(indexed, books, indexed.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    found = 0
    for q in range(0, 800, 20):
        s = (x * x[q]).sum(1)
        s[q] = -9
        want = np.lexsort((np.arange(800), -s))[:20]
        found += len({i for i, _ in got[q]} & set(want.tolist()))
        assert len(got[q]) == 20 and all(abs(score - s[i]) < 1e-12 for i, score in got[q])
        assert got[q] == sorted(got[q], key=lambda t: (-t[1], t[0]))
    assert found >= 0.9 * 20 * 40
    few, books = ann.index(spark.createDataFrame(rows[:5], "vec_id long, embedding array<double>"))
    assert ann.search(few, books, few).groupBy("query_id").count().where("count <> 4").count() == 0
    none, books = ann.index(spark.createDataFrame(rows[800:802], "vec_id long, embedding array<double>"))
    assert ann.search(none, books, none).collect() == []


def test_ann_of_odd_tables(spark):
    """Repeated ids, columns with inner names, short vectors against long ones, several blocks of queries, an empty table."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 8)) * rng.choice([0.01, 1.0, 30.0], 300)[:, None]
    rows = [(i % 290, v.tolist(), 1.0, b"x", 2, "k") for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, norm double, v binary, n int, codes string").repartition(7)
    indexed, books = ann.index(frame)
    got = defaultdict(list)
    for r in ann.search(indexed, books, indexed.where("vec_id >= 10 and vec_id % 3 = 0"), k=5, rerank=8, block=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["score"])
    for i in range(12, 290, 3):
        want = np.sort((x * x[i]).sum(1)[np.arange(300) % 290 != i])[::-1][:5]
        assert got[i] == pytest.approx(want.tolist(), rel=1e-12)
    nothing, books = ann.index(frame.where("false"))
    assert ann.search(nothing, books, nothing).collect() == []


@pytest.mark.parametrize("noise", [0.002, 0.02])
def test_ann_of_near_copies(spark, noise):
    """A third of all vectors are near copies of one: their codes tie, and the true 20 are found all the same."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(9000, 64))
    x[::3] = x[0] + noise * rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    indexed, books = ann.index(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    got = defaultdict(list)
    for r in ann.search(indexed, books, indexed.where("vec_id % 225 = 0 or vec_id % 900 = 1")).collect():
        got[r["query_id"]].append(r["score"])
    assert len(got) == 50
    for q, scores in got.items():
        s = np.delete(x @ x[q], q)
        assert len(scores) == 20 and min(scores) >= np.sort(s)[-20] - 1e-12


def test_isotonic():
    assert quality.isotonic(np.array([3.0, 1, 2, 5]), np.ones(4)).tolist() == [2, 2, 2, 5]


def test_quality(spark, docs):
    big = "/root/testdata/sf0.01"
    got = queries.op8_quality(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean() > 0.95
    stats = quality.measured(docs(ODD))
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r["score"] for r in quality.scored(stats, quality.fit(stats, none)).collect()} == {0.5}
    assert stats.count() == len(ODD)
    some = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, label int")
    assert all(0 <= r["score"] <= 1 for r in quality.scored(stats, quality.fit(stats, some)).collect())
    assert quality.keep_good(docs([]).where("false"), none).collect() == []


def test_quality_is_the_plain_fit(spark, docs):
    """Statistics by plain counting, ridge weights by one solve over all rows, calibration by sorted pooling."""
    rng = random.Random(5)
    words_ = ["alpha", "Beta", "of", "x", "éclair", "12", "end.", "wow!", "a#", "internationalisation"]
    rows = [(i, " ".join(rng.choice(words_[: 4 + 6 * (i % 2)]) for _ in range(rng.randrange(0, 40))) + "\n" * (i % 3)) for i in range(400)]
    label = {i: int((i % 2) ^ (rng.random() < 0.1)) for i in range(400)}
    stats = quality.measured(docs(rows))
    got = {r["doc_id"]: np.frombuffer(r["stats"], "<f8") for r in stats.collect()}
    for i, t in rows[:60]:
        b, w = t.encode(), spaced(t)
        own = re.findall(rb"[^\x20\x09-\x0d]+", b)
        want = [math.log1p(len(b))] + [sum(1 for c in b if quality._CLASS[c] == k) / max(1, len(b)) for k in range(8)]
        if w:
            n, length = Counter(w), [len(x) for x in own]
            pairs = list(zip(w, w[1:]))
            p = np.array(list(n.values())) / len(w)
            want += [math.log1p(len(w)), np.mean(length) / 10, np.std(length) / 10, len(n) / len(w), max(n.values()) / len(w), np.mean([a == b for a, b in pairs]) if pairs else 0, len(set(pairs)) / len(pairs) if pairs else 1]
            want += [np.mean([quality._CLASS[x[-1]] == 6 for x in own]), np.mean([quality._CLASS[x[0]] == 1 for x in own]), np.mean([l <= 3 for l in length]), np.mean([l >= 12 for l in length]), -(p * np.log(p)).sum() / math.log(len(w) + 1), min(max(length), 100) / 100, np.mean([l == 1 for l in length]), math.log1p(b.count(b"\n")) - math.log1p(len(w))]
        assert np.allclose(got[i], want + [0] * (quality.STATS - len(want)))
    model = quality.fit(stats, spark.createDataFrame(sorted(label.items()), "doc_id long, label int"), features=64)
    fold = {r[0]: r[1] for r in spark.range(400).select("id", F.pmod(F.xxhash64("id"), F.lit(5))).collect()}
    x, y = np.array([got[i] for i in range(400)]), np.array([label[i] for i in range(400)])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.std, np.sqrt(np.maximum(x.var(0), 1e-8)), atol=1e-9)
    train = np.array([fold[i] != 4 for i in range(400)])
    z = np.clip((x - model.mean) / model.std, -6, 6)
    phi = np.hstack([np.sqrt(2 / 64) * np.cos(z @ model.w + model.b), np.ones((400, 1))])
    a = phi[train].T @ phi[train]
    assert np.allclose(model.beta, np.linalg.solve(a + 1e-3 * a[-1, -1] / 100 * np.eye(65), phi[train].T @ y[train]))
    bins = np.clip(((phi @ model.beta + 0.5) / 2 * 400).astype(int), 0, 399)
    used = sorted(set(bins[~train]))
    mean, n = [y[~train][bins[~train] == u].mean() for u in used], [(bins[~train] == u).sum() for u in used]
    least = [max(min(np.average(mean[a : b + 1], weights=n[a : b + 1]) for b in range(i, len(used))) for a in range(i + 1)) for i in range(len(used))]
    assert np.allclose(model.values, np.clip(least, 0, 1))
    assert {r["doc_id"]: r["score"] for r in quality.scored(stats, model).collect()} == pytest.approx(dict(enumerate(np.interp(phi @ model.beta, model.edges, model.values).tolist())))


def test_decontamination_blocks(spark, docs):
    rng = random.Random(7)
    vocabulary = ["a", "bb", "ccc", "dd1"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([1, 2, 3, 9, 10, 11, 14, 30])] + [(98, None), (99, "...")]
    rows = [(i, " - ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(60)] + ODD
    for block in (1, 8 << 20):
        got = decontam.find_items(docs(rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block).collect()
        have = sorted(map(repr, [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got]))
        want = []
        for d, t in rows:
            w, hit, its = decontam.words(t), set(), set()
            for item, text in items:
                v = decontam.words(text)
                n = min(10, len(v))
                grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
                for i in range(len(w) - n + 1) if n else ():
                    if tuple(w[i : i + n]) in grams:
                        hit |= set(range(i, i + n))
                        its.add(str(item))
            want.append((d, len(w), len(hit), sorted(its)))
        assert have == sorted(map(repr, want))
    clean = decontam.decontaminate(docs(rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=1)
    assert sorted(map(repr, [r["doc_id"] for r in clean.collect()])) == sorted(repr(d) for d, _, n, _ in want if not n)
    assert decontam.find_items(docs(rows), spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").count() == 0


def test_spread_join(spark):
    """A key with most rows, null keys, keys without a partner and a payload that is null: as a plain left join."""
    rows = [(i, 7 if i % 3 else i % 11, None if i % 50 == 0 else "x", i) for i in range(5000)]
    big = spark.createDataFrame(rows, "id long, a long, b string, p long").repartition(5)
    n = Counter((a, b) for _, a, b, _ in rows if b)
    small = [(a, b, c, None if a == 3 else a * 10) for (a, b), c in n.items() if a != 5]
    got = common.spread_join(big, spark.createDataFrame(small, "x long, y string, n long, q long"), {"a": "x", "b": "y"}, "n", ["q"], ["id"])
    want = {(x, y): q for x, y, _, q in small}
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((*r, want.get((r[1], r[2])))) for r in rows)
    empty = common.spread_join(big, spark.createDataFrame([], "x long, y string, n long, q long"), {"a": "x", "b": "y"}, "n", ["q"], ["id"])
    assert empty.count() == 5000 and empty.where("q is not null").count() == 0
