"""A set-associative cache as a relation (set, way, key, counter, vec)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WAYS = 8
DECAY = 0.95


def set_of(key: Column, sets: int) -> Column:
    return F.pmod(key, F.lit(sets)).cast("long")


def tag_of(key: Column, sets: int) -> Column:
    return F.floor(key / sets).cast("long")


def decay(cache: DataFrame, touched: DataFrame, now: int, rate: float = DECAY) -> DataFrame:
    """Counters of touched sets times rate ** (now - ts); other sets stay as they are until touched."""
    hit = touched.select("set").distinct().withColumn("__hit", F.lit(True))
    aged = F.col("counter") * F.pow(F.lit(rate), F.lit(now) - F.col("ts"))
    return cache.join(hit, "set", "left").withColumn("counter", F.when(F.col("__hit"), aged).otherwise(F.col("counter"))).withColumn("ts", F.when(F.col("__hit"), F.lit(now)).otherwise(F.col("ts"))).drop("__hit")


def geometry(budget: int, row_bytes: int, ways: int = WAYS, tag_bytes: int = 8, counter_bytes: int = 4) -> int:
    """The number of sets that a budget of bytes holds: each way has a tag, a row and a counter."""
    sets = budget // (ways * (tag_bytes + row_bytes + counter_bytes))
    if sets < 1:
        raise ValueError("the budget holds no set")
    return sets


def resident(cache: DataFrame) -> DataFrame:
    """(key) of the keys stored in the cache."""
    return cache.filter("key IS NOT NULL").select("key")


def misses(cache: DataFrame, requests: DataFrame) -> DataFrame:
    """(requests, misses): how many requests there are, and how many of their keys the cache lacks."""
    found = requests.select("key").join(resident(cache).withColumn("__in", F.lit(True)), "key", "left")
    return found.agg(F.count("*").alias("requests"), F.count_if(F.col("__in").isNull()).alias("misses"))


def insert(cache: DataFrame, candidates: DataFrame, sets: int, ways: int = WAYS, ties: bool = False) -> DataFrame:
    """The cache (set, way, key, counter[, vec]) after candidates (key, priority[, vec]), unique keys.

    With vec in both, a candidate that gets a way brings its row. ``ties`` lets an equal priority
    replace, too, which is the host's rule; the device's needs a larger one.

    A resident key's counter grows by its priority. The best new keys of a set meet its ways by
    ascending counter, free ways (key null) first with counter 0; each replaces its way if its priority is strictly larger.
    """
    rows = "vec" in cache.columns and "vec" in candidates.columns
    cand = candidates.withColumn("set", set_of(F.col("key"), sets))
    grown = cache.join(cand.select("key", F.col("priority").alias("__more")), "key", "left").withColumn("counter", F.col("counter") + F.coalesce("__more", F.lit(0.0))).drop("__more")
    fresh = cand.join(cache.filter("key IS NOT NULL").select("key"), "key", "left_anti")
    best = fresh.withColumn("rn", F.row_number().over(Window.partitionBy("set").orderBy(F.desc("priority"), "key"))).filter(F.col("rn") <= ways).select("set", "rn", F.col("key").alias("__key"), F.col("priority").alias("__priority"), *([F.col("vec").alias("__vec")] if rows else []))
    slots = grown.withColumn("rn", F.row_number().over(Window.partitionBy("set").orderBy(F.when(F.col("key").isNull(), -1.0).otherwise(F.col("counter")), "way")))
    wins = F.col("__key").isNotNull() & (F.col("key").isNull() | (F.col("__priority") >= F.col("counter") if ties else F.col("__priority") > F.col("counter")))
    return slots.join(best, ["set", "rn"], "left").select("set", "way", F.when(wins, F.col("__key")).otherwise(F.col("key")).alias("key"), F.when(wins, F.col("__priority")).otherwise(F.col("counter")).alias("counter"), *([F.when(wins, F.col("__vec")).otherwise(F.col("vec")).alias("vec")] if rows else []))


def invalidate(cache: DataFrame, keys: DataFrame) -> DataFrame:
    gone = keys.select("key").distinct().withColumn("__gone", F.lit(True))
    out = cache.join(gone, "key", "left")
    return out.withColumn("key", F.when(F.col("__gone"), None).otherwise(F.col("key"))).withColumn("counter", F.when(F.col("__gone"), 0.0).otherwise(F.col("counter"))).drop("__gone").select(cache.columns)


def empty(spark, sets: int, ways: int = WAYS) -> DataFrame:
    return spark.range(sets * ways).select(F.floor(F.col("id") / ways).cast("long").alias("set"), F.pmod("id", F.lit(ways)).cast("long").alias("way"), F.lit(None).cast("long").alias("key"), F.lit(0.0).alias("counter"))
