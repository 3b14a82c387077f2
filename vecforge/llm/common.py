"""Shared pieces of the training-data operators: words, scratch tables, Arrow batch bounds."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
find_words = re.compile(WORD).findall

#: Bounds of one Arrow batch handed to a Python worker.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 2000
#: A key is hot with more than a HOT_SHARE-th of the rows, and with HOT_ROWS at least.
HOT_SHARE, HOT_ROWS = 1000, 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and bound their Arrow batches by bytes as well as rows."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))
    return spark


def hot_keys(rows: DataFrame, keys: list[str], total: int) -> DataFrame:
    """(keys, times) of the keys with more than a HOT_SHARE-th of ``total`` rows: HOT_SHARE rows at most."""
    return rows.groupBy(*keys).agg(F.count("*").alias("times")).filter(F.col("times") > max(HOT_ROWS, total // HOT_SHARE))


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with a ``right`` that is unique in ``keys``, where a few keys may have most of left's rows.

    Those keys are at most HOT_SHARE, so what right has for them is broadcast and their rows stay where
    they are; the others are shuffled. ``left`` should be a written table: it is read three times. Null
    keys meet nothing.
    """
    hot = F.broadcast(hot_keys(left, keys, left.count()).select(*keys))
    spread = left.join(hot, keys, "left_semi").join(F.broadcast(right.join(hot, keys, "left_semi")), keys, how)
    return spread.unionByName(left.join(hot, keys, "left_anti").join(right, keys, how))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def normalised(text: Column) -> Column:
    """Words joined by single spaces; null is the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def raw(value: pa.StringScalar) -> bytes:
    """The UTF-8 bytes of an Arrow string; null is empty."""
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def pieces(values: pa.Array, size: int = 2 << 20):
    """(first row, UTF-8 texts) of runs of rows with about so many bytes; null is empty."""
    rows, begin, total = [], 0, 0
    for i, v in enumerate(values):
        rows.append(raw(v))
        total += len(rows[-1])
        if total >= size:
            yield begin, rows
            rows, begin, total = [], i + 1, 0
    if rows:
        yield begin, rows


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Vocabulary(dict):
    """Numbers words in the order they come; hashes() has the 64-bit hash of each."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n

    def hashes(self) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)


class Scratch:
    """Tables written to the cluster's shared checkpoint folder, to cut lineage.

    The folder is ``spark.checkpoint.dir``; where that is unset (tests), a folder of the driver's own.
    Tables are plain Parquet, so a lost executor loses none; they go when dropped or when the JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or os.path.join(tempfile.gettempdir(), "vecforge")
        self.path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self.root = jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.deleteOnExit(self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self.fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)
