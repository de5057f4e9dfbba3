"""The pipeline's stages, each held against a brute-force version on its own input."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import LOW, ODD, brute_components, brute_lines, near_copies
from tidegauge.llm import common, quality
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.01"  # enough labels for the quality stage
STAGES = dict(corpus_pipeline.STAGES)


def pairs(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=repr)


def brute_clean(rows, items, size=10):
    """Rows without any of the items' windows of words."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = defaultdict(set)
    for w in map(words, items):
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[min(size, len(w))].add(tuple(w[i : i + size]))
    return [(d, t) for d, t in rows if not any(tuple(w[i : i + n]) in found for w in [words(t)] for n, found in windows.items() for i in range(len(w) - n + 1))]


def check_packing(before, out):
    """Every id of every row once, in sequences of at most 1024 without gaps."""
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, t in before:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((d, a, min(1024, len(ids) - a), zlib.crc32(ids[a : a + 1024].tobytes()), len(ids)) for a in range(0, len(ids), 1024))
    got, fill = Counter(), defaultdict(list)
    for r in out.collect():
        got[r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for parts in fill.values():
        assert [a for a, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1]] and sum(n for _, n in parts) <= 1024


def check(name, docs, out, sf):
    before, after = pairs(docs), pairs(out) if name != "packing" else None
    if name != "packing":
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    if name == "quality":
        labels = docs.sparkSession.read.parquet(f"{sf}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
        stats = quality.measured(docs)
        bad = {r["stats"] for r in quality.scored_stats(stats, quality.fit(stats, labels.select("doc_id", F.col("quality").alias("label")))).where("score < 0.3").collect()}
        assert len(after) == len(before) - sum(1 for r in stats.collect() if r["stats"] in bad)
    if name == "line_dedup":
        assert after == sorted(brute_lines(before, texts=True), key=repr)
    if name == "near_duplicates":
        groups = defaultdict(set)
        for (d, t), (_, n, c) in zip(before, brute_components(before)):
            if n:
                groups[c].add((d, t))
        assert all(len(g & set(after)) >= 1 for g in groups.values())
        assert Counter(after) == Counter(x for x in after if any(x in g for g in groups.values())) + Counter(x for x in before if not any(x in g for g in groups.values()))
        assert sum(1 for x in after if any(x in g for g in groups.values())) == len(groups)
    if name == "decontamination":
        items = [r["text"] for r in docs.sparkSession.read.parquet(f"{sf}/benchmark.parquet").collect()]
        assert after == sorted(brute_clean(before, items), key=repr)
    if name == "packing":
        check_packing(before, out)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        check(name, docs, out, SF)
        if name == "quality":
            assert 0.6 * docs.count() < out.count() < docs.count()
        docs = out


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_tables(spark, docs, name):
    """Null ids and texts, empty and very long texts, repeated rows, clashing columns; then no rows at all."""
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    lines = "\n".join(" ".join(f"l{i}w{j}" for j in range(30)) for i in range(4))
    rows = ODD + [(None, None), (20, lines), (21, "own\n" + lines), (21, "own\n" + lines), (None, lines + "\nx"), (22, passage), (None, passage), (23, passage), (24, "y\n" * 5000)] + [(100 + d, t) for d, t in near_copies(9, 2, 4)]
    rows = [(d, t) for d, t in rows if name != "near_duplicates" or d is not None]  # components of null ids have no name to compare by
    frame = docs(rows)
    check(name, frame, STAGES[name](spark, frame, SF), SF)
    assert STAGES[name](spark, frame.where("false"), SF).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "decontamination", "packing"])
def test_workers_give_back(spark, docs, monkeypatch, name):
    """Every function that a stage sends to the Python workers, which live on, returns freed memory when a task's rows end."""
    sent, times = [], []
    frame = docs(near_copies(9, 2, 4))
    real = type(frame).mapInArrow
    monkeypatch.setattr(type(frame), "mapInArrow", lambda df, run, *how: (sent.append(run), real(df, run, *how))[1])
    assert STAGES[name](spark, frame, SF).count()
    monkeypatch.setattr(common, "give_back", lambda: times.append(1))
    for run in sent:
        list(run(iter([])))
    assert sent and len(times) == len(sent)


def test_statistics_bounded():
    """The arrays of 4 MB of texts, 21 bytes for each byte, are not made for all of them at once."""
    import tracemalloc

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["some words of a text " * 200] * 1000)], ["doc_id", "text"])
    tracemalloc.start()
    rows = sum(len(x) for _, x in quality.statistics(iter([batch]), "doc_id"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1000 and peak < 12 * batch.nbytes
