"""A cleaning pipeline over documents: quality, line dedup, near duplicates, decontamination, packing.

Every stage takes documents and all but the last return their columns. Rows with null ids or texts, repeated rows, columns
with other names and empty tables pass through every stage; each stage says what it does with them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import common, decontam, jaccard, line_dedup, packing, quality


def _columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score reaches 0.3. A null text scores as an empty one; a null id only has no label; equal texts get equal
    scores; without labels every score is 0.5 and all rows stay."""
    labels = common.table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return quality.keep_good(docs, labels.select("doc_id", F.col("quality").alias("label")))


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of repeated line runs of 50 words or more; rows left without a line go. Null and blank texts stay as
    they are; rows equal in id and text are one document and keep or lose the same lines; a null id comes first."""
    return _columns(line_dedup.dedup(docs), docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (word 5-shingles, Jaccard similarity of 0.8 or more): that of least id, then text hash, a
    null id last. Rows without words all stay; ids may repeat with other texts."""
    return jaccard.one_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of 10 words of a benchmark item. Null texts have no words and stay; repeated rows are judged alike."""
    return decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of 1024 tokens. A null text is its end token alone; repeated rows are pieces of their own."""
    return packing.pack(docs)


STAGES = [("quality", good_quality), ("line_dedup", first_lines), ("near_duplicates", one_of_each), ("decontamination", without_benchmark), ("packing", packed)]

#: Fitted scores and tokenizer ids have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    at = f"{common.shared_dir(spark)}/tidegauge/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
