"""Lookups over one or several tables: default rows, hit masks, tiers and hit rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecforge.functions import keys, vectors
from vecforge.operators.table import Table


def fill_default(found: DataFrame, default: Column) -> DataFrame:
    """Misses get the default row."""
    return found.withColumn("vec", F.coalesce("vec", default))


def hit_mask(found: DataFrame, pos: str = "pos") -> DataFrame:
    """(word, bits): bit i of word w says whether request 64 w + i was found."""
    p = F.col(pos)
    return found.groupBy(keys.mask_word(p).alias("word")).agg(F.bit_or(F.when(F.col("hit"), keys.mask_bit(p)).otherwise(F.lit(0).cast("long"))).alias("bits"))


def lookup_dense(table: Table, rows: int, requests: DataFrame, default_row: int = -1) -> DataFrame:
    """Lookup in a table whose keys are 0 .. rows - 1, keys out of range sent to ``default_row``."""
    wanted = requests.withColumn("__asked", F.col("key")).withColumn("key", keys.sanitize(F.col("key"), rows, default_row))
    return table.find(wanted).withColumn("key", F.col("__asked")).drop("__asked")


def cascade(tables: Sequence[Table], requests: DataFrame) -> DataFrame:
    """``requests`` with vec and tier: the first table that has the key, null if none does.

    Each tier joins all requests by key, which keeps them dealt out, but only unresolved ones match.
    """
    out = requests.withColumn("vec", F.lit(None).cast(tables[0].df.schema["vec"].dataType)).withColumn("tier", F.lit(None).cast("int"))
    for i, t in enumerate(tables):
        side = t.df.select(F.col("key").alias("__key"), F.col("vec").alias("__vec"))
        out = out.join(side, (F.col("key") == F.col("__key")) & F.col("tier").isNull() & (F.col("key") != t.invalid_key), "left").withColumn("vec", F.coalesce("vec", "__vec")).withColumn("tier", F.coalesce("tier", F.when(F.col("__key").isNotNull(), F.lit(i)))).drop("__key", "__vec")
    return out


def hit_rates(found: DataFrame, tiers: int) -> DataFrame:
    """(tier, hits, rate, left_rate): hits over all requests, and over those that reached the tier (1 if none did)."""
    w = Window.partitionBy()  # over one row per tier
    counted = found.groupBy("tier").agg(F.count("*").alias("hits"))
    every = found.sparkSession.range(tiers).select(F.col("id").cast("int").alias("tier"))
    both = counted.join(every, "tier", "full").withColumn("hits", F.coalesce("hits", F.lit(0))).withColumn("n", F.sum("hits").over(w))
    before = F.coalesce(F.sum("hits").over(Window.partitionBy().orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.col("n") - F.col("before")
    return both.filter("tier IS NOT NULL").withColumn("before", before).select("tier", "hits", (F.col("hits") / F.col("n")).alias("rate"), F.when(left > 0, F.col("hits") / left).otherwise(1.0).alias("left_rate"))


def hot_cold(table: Table, requests: DataFrame, hot_keys: int = 1024, max_hot_rows: int = 1 << 16) -> DataFrame:
    """:meth:`Table.find` with the most requested keys joined by broadcast and the rest by shuffle.

    At most ``hot_keys`` rows of the table are broadcast, which bounds it; it takes the hot keys out of the
    shuffle, where each would land in one task.
    """
    if hot_keys > max_hot_rows:
        raise ValueError("too many hot keys to broadcast")
    hot = requests.groupBy("key").count().orderBy(F.desc("count"), "key").limit(hot_keys).select("key")
    hot_rows = F.broadcast(table.df.join(F.broadcast(hot), "key", "left_semi").select(F.col("key").alias("__key"), F.col("vec").alias("__hot")))
    marked = requests.join(hot_rows, F.col("key") == F.col("__key"), "left")
    warm = marked.filter("__key IS NOT NULL").select(*requests.columns, F.col("__hot").alias("vec"), F.lit(True).alias("hit"))
    cold = table.find(marked.filter("__key IS NULL").select(*requests.columns))
    return warm.unionByName(cold)


def digest(vec: Column | str = "vec") -> list[Column]:
    """Scalars that stand for a vector in results: its sum and three of its elements, rounded."""
    v = F.col(vec) if isinstance(vec, str) else vec
    return [F.round(vectors.total(v), 5).alias("total"), *[F.round(F.get(v, F.lit(i)).cast("double"), 5).alias(f"e{i}") for i in (0, 17, 63)]]
