"""Shared plumbing: reading tables, cutting lineage, ranking without a single sorting task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir, which is set here only where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="tidegauge-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str = "cut", partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut and a lost executor costs one reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidegauge/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    back = spark.read.schema(schema).parquet(path)
    back.stored_at = path
    return back


def rows(spark: SparkSession, data: list, schema: str) -> DataFrame:
    """A DataFrame of bounded driver-side rows, held in one partition of the JVM (no Python on the executors)."""
    from pyspark.sql.types import _parse_datatype_string

    from pyspark.sql.pandas.types import to_arrow_schema

    typed = _parse_datatype_string(schema)
    cols = list(zip(*data)) if data else [[] for _ in typed.fields]
    arrow = to_arrow_schema(typed)
    return spark.createDataFrame(pa.table([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow), typed)


def chunks_of(spark: SparkSession) -> int:
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_join(big: DataFrame, small: DataFrame, keys: dict[str, str], count: str, payload: list[str], by: list[str]) -> DataFrame:
    """big with the payload columns of small's row of its keys (null where there is none), whatever share of big one key has.

    keys: big's column -> small's. small has one row a key, with the number of big's rows of that key in `count`. Keys with over
    a thousandth of all rows (so fewer than a thousand) come by broadcast, and their rows, like rows with a null key, are
    spread in the shuffle by the columns `by`.
    """
    total = small.agg(F.sum(count)).first()[0] or 0
    named = small.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys.values())], F.struct(*payload).alias("__p"), F.col(count).alias("__n"))
    hot = named.where(F.col("__n") > total / 1000).drop("__n").withColumnsRenamed({f"__k{i}": f"__h{i}" for i in range(len(keys))} | {"__p": "__hot"})
    cold = named.where(F.col("__n") <= total / 1000).drop("__n").withColumn("__s", F.lit(0))
    same = lambda side: reduce(and_, [F.col(k) == F.col(f"__{side}{i}") for i, k in enumerate(keys)])
    away = reduce(or_, [F.col(k).isNull() for k in keys], F.col("__hot").isNotNull())
    tagged = big.join(F.broadcast(hot), same("h"), "left").withColumn("__salt", F.when(away, 1 + F.pmod(F.xxhash64(*by), F.lit(4096))).otherwise(0))
    joined = tagged.join(cold, same("k") & (F.col("__salt") == F.col("__s")), "left")
    found = F.coalesce("__hot", "__p")
    return joined.select(*big.columns, *[found[c].alias(c) for c in payload])


def rank_within(df: DataFrame, keys: list[str], order: list[str], out: str, base: Column | None = None) -> DataFrame:
    """Gapless rank from 0 of each row among those with equal keys, however many rows one key has.

    Rows are dealt into hash chunks of the order columns; a row's rank is its row number in its chunk plus the sizes of
    the key's earlier chunks. Only the counts by (key, chunk) are summed over a whole key.
    """
    n = chunks_of(df.sparkSession)
    dealt = df.withColumn("__chunk", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    sizes = dealt.groupBy(*keys, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__chunk").alias("__c"), F.coalesce(before, F.lit(0)).alias("__before"))
    numbered = dealt.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys, "__chunk").orderBy(*order)))
    same = F.col("__chunk") == F.col("__c")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = numbered.join(sizes, same)
    return joined.withColumn(out, F.col("__before") + F.col("__rn") - 1).drop("__chunk", "__rn", "__c", "__before", *[f"__k_{k}" for k in keys])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstd value; numbers by byte planes, which compress better."""
    parts, head = [], [len(arrays)]
    for a in arrays:
        head += [ord(a.dtype.char), len(a)]
        raw = np.ascontiguousarray(a)
        parts.append(raw.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"")
    body = np.array(head, "<i8").tobytes() + b"".join(parts)
    return np.array([len(body)], "<i8").tobytes() + pa.Codec("zstd", compression_level=1).compress(body, asbytes=True)


def unpack(value: bytes) -> list[np.ndarray]:
    body = pa.Codec("zstd").decompress(value[8:], int(np.frombuffer(value[:8], "<i8")[0]), asbytes=True)
    n = int(np.frombuffer(body[:8], "<i8")[0])
    head = np.frombuffer(body[8 : 8 + 16 * n], "<i8")
    out, at = [], 8 + 16 * n
    for i in range(n):
        kind, length = np.dtype(chr(head[2 * i])), int(head[2 * i + 1])
        size = kind.itemsize * length
        planes = np.frombuffer(body[at : at + size], np.uint8).reshape(kind.itemsize, length)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(length))
        at += size
    return out


def discard(df: DataFrame, part: str = "") -> None:
    """Delete the files of a stored() table (part: of one folder of it) that nothing reads any more."""
    path = getattr(df, "stored_at", None)
    if path:
        path = f"{path}/{part}" if part else path
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def give_back() -> None:
    """Return freed memory of this process to the system; Python workers live on and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def giving_back(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """run, a function for mapInArrow, whose worker returns what it freed to the system at the end of each task."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return trimmed


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more (it acts on collected garbage).

    The last plan that wrote something is still held by Spark, so an empty one takes its place first; and the gateway lets go of
    Python's references a moment after they are collected here."""
    import gc
    import time

    gc.collect()
    spark.range(0).write.format("noop").mode("overwrite").save()
    time.sleep(0.2)
    spark._jvm.System.gc()
    time.sleep(0.2)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small where the session leaves the limit as it is: texts vary much in length."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
