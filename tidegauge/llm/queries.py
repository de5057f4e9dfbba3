"""The queries op1 to op10 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, common, decontam, jaccard, katz, line_dedup, packing, quality, shards, warc

EXTRA_TURN = "<|im_end|><|im_start|>assistant ok"


def _fold(spark_col: str = "doc_id"):
    return F.crc32(F.col(spark_col).cast("string").cast("binary")) % 5


def op1_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = common.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = common.rows(spark, [(-1, 0, "user", EXTRA_TURN), (-1, 1, "assistant", EXTRA_TURN)], "conv_id long, turn long, role string, text string")
    segments, trunk, members = chat.tree(rows.unionByName(extra), public_tokenizers.path("byte_bpe_50k.json"))
    found = common.stored(chat.digests(segments, trunk), "chat-digests").withColumnRenamed("leaf", "l")
    return members.join(found, F.col("leaf") == F.col("l")).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(common.table(spark, sf_dir, "documents"), 8).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{common.shared_dir(spark)}/tidegauge/warc-{uuid.uuid4().hex}"
    warc.write(common.table(spark, sf_dir, "pages"), path)
    back = warc.read(spark, path, payload="check").where(F.col("record_type").isin("response", "revisit"))
    ok = F.when(F.col("payload_ok").isNull() | F.col("payload_ok"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload differs from its digest")))
    return back.select("page_id", "payload_bytes", ok.alias("payload_digest"), "record_type", "refers_to")


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(common.table(spark, sf_dir, "documents"), _fold() == 1)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(common.table(spark, sf_dir, "documents"), report=True)
    text = F.coalesce("text", F.lit(""))
    return done.select("doc_id", F.col("lines_deleted").cast("long").alias("lines_deleted"), F.length(text).cast("long").alias("kept_chars"), F.md5(text.cast("binary")).alias("kept_md5"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed, books = ann.index(common.table(spark, sf_dir, "embeddings"))
    return ann.search(indexed, books, indexed.where("vec_id % 20 = 0"), k=20)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    labels = common.table(spark, sf_dir, "labels").where(_fold() != 0).select("doc_id", F.col("quality").alias("label"))
    stats = common.stored(quality.measured(docs), "quality-stats")
    found = quality.scored(stats, quality.fit(stats, labels))
    return found.select("doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_items(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(common.table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_chat_tree, op2_shards, op3_packing, op4_warc, op5_katz, op6_line_dedup, op7_ann, op8_quality, op9_decontaminate, op10_jaccard)}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{EXTRA_TURN}' UNION ALL SELECT -1, 1, 'assistant', '{EXTRA_TURN}'),
e AS (SELECT *, replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|') AS et,
  replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'), chr(10), chr(92) || 'n') AS er FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(er) + length(et) + length('<|im_start|>') + length('<|im_end|>') + 2) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP4 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{_B32}', CAST(1 + ((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM s"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP9 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + 9], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS k FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, ns WHERE len(w) >= n)),
hits AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""

OP10 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT doc_id, coalesce(max(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_tree": OP1, "op4_warc": OP4, "op9_decontaminate": OP9, "op10_jaccard": OP10}
