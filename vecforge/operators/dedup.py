"""Deduplication of request keys: counts, offsets, inverse, run chunks, priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unique_counts(requests: DataFrame) -> DataFrame:
    """(key, count)."""
    return requests.groupBy("key").agg(F.count("*").alias("count"))


def unique_offsets(requests: DataFrame) -> DataFrame:
    """(rank, key, count, off): unique keys in order, off the exclusive running count.

    The running sum is over unique keys; ranges of keys are summed first, so no task sees all of them.
    """
    return running(unique_counts(requests), "key", "count")


def running(df: DataFrame, order: str, value: str, chunk: int = 1 << 16) -> DataFrame:
    """``df`` (order: unique long, value) with rank (from 0) and off (sum of the values before).

    Two levels: windows within chunks of the order's range, and one over the chunks' totals.
    """
    cut = df.withColumn("__chunk", F.floor(F.col(order) / chunk))
    w = Window.partitionBy("__chunk").orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("__chunk").agg(F.sum(value).alias("__sum"), F.count("*").alias("__n"))
    over = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("__chunk", F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__off"), F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__rank"))
    return cut.withColumn("rank", F.row_number().over(w) - 1).withColumn("off", F.coalesce(F.sum(value).over(before), F.lit(0))).join(bases, "__chunk").withColumn("rank", (F.col("rank") + F.col("__rank")).cast("long")).withColumn("off", (F.col("off") + F.col("__off")).cast("long")).drop("__chunk", "__off", "__rank")


def inverse(requests: DataFrame) -> DataFrame:
    """(pos, rank): the number of each request's key among the unique ones."""
    return requests.join(unique_offsets(requests).select("key", "rank"), "key").select("pos", "rank")


def chunks(requests: DataFrame, run: int) -> DataFrame:
    """(key, chunk, count): each key's requests in runs of at most ``run``."""
    if run < 1:
        raise ValueError("a run has at least one row")
    n = F.col("count")
    return unique_counts(requests).select("key", F.explode(F.sequence(F.lit(0), F.ceil(n / run).cast("int") - 1)).alias("chunk"), n).select("key", F.col("chunk").cast("long").alias("chunk"), F.least(F.lit(run), n - F.col("chunk") * run).cast("long").alias("count"))


def salted_sum(rows: DataFrame, key: str, value: str, salts: int = 32) -> DataFrame:
    """Sums by key in two steps, the first by (key, salt)."""
    first = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts))).groupBy(key, "__salt").agg(F.sum(value).alias("__part"))
    return first.groupBy(key).agg(F.sum("__part").alias(value))


def priorities(requests: DataFrame) -> DataFrame:
    """(key, count, priority): priority is the key's share of all requests."""
    return unique_counts(requests).withColumn("priority", F.col("count") / F.lit(max(1, requests.count())))


def top(requests: DataFrame, k: int) -> DataFrame:
    """The k most frequent keys, smaller keys first among equals."""
    return unique_counts(requests).orderBy(F.desc("count"), "key").limit(k)
