"""Scratch tables in the cluster's shared folder, and word hashing used by several operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.sources.scratch import scratch

MASK = (1 << 64) - 1


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    schema = df.schema
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets the context cleaner drop shuffle files of finished steps
    return spark.read.schema(schema).parquet(path)


def join_hot(left: DataFrame, right: DataFrame, key: str, spread: str | Column, counts: DataFrame, how: str = "inner", share: int = 2000, least: int = 512) -> DataFrame:
    """Equi-join on ``key``, whose hot values are dealt over many tasks.

    counts (key, n): the rows of ``left`` with each key; it is read twice, so it should be a written
    table. Keys with more than 1/``share`` of these rows (and ``least``) are hot, so there are at most ``share`` of
    them, and only these come to the driver. Their rows of ``left`` are salted by a hash of
    ``spread``, and their rows of ``right`` are repeated for each salt. ``right`` should have few rows a key.
    """
    total, top = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    bar = max(least, total // share)
    if top <= bar:
        return left.join(right, key, how)
    found = counts.where(F.col("n") > bar).select(key, F.ceil(F.col("n") / bar).cast("int").alias("__salts"))
    hot = F.broadcast(counts.sparkSession.createDataFrame(found.collect(), found.schema))
    salt = F.coalesce(F.pmod(F.xxhash64(spread), F.col("__salts")), F.lit(0)).cast("int")
    a = left.join(hot, key, "left").withColumn("__salt", salt).drop("__salts")
    b = right.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return a.join(b, [key, "__salt"], how).drop("__salt")


def give_back() -> None:
    """What finished batches took goes back to the system; an idle Python worker would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def each_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` over a task's batches that hold rows; the task's memory is given back at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)
        batch = None
        give_back()

    return run


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    return df.mapInArrow(each_batch(fn), schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(hashes: np.ndarray, n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` word hashes (order matters); empty where there are fewer."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = (out + hashes[i : i + count]) * np.uint64(base)
        out ^= out >> np.uint64(29)
    return scramble(out)


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
