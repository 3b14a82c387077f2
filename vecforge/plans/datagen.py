"""Key generators: sequential, uniform and power-law request streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def requests(spark: SparkSession, n: int, rows: int, kind: str = "uniform", alpha: float = 1.05, seed: int = 31337, batch: int = 1 << 16) -> DataFrame:
    """(step, pos, key): n requests over keys 0 .. rows - 1.

    Power law: u uniform gives (u (max^g - 1) + 1)^(1/g) with g = 1 - alpha, largest share at key 0.
    """
    u = F.rand(seed)
    if kind == "sequential":
        key = F.pmod("id", F.lit(rows))
    elif kind == "uniform":
        key = F.floor(u * rows)
    elif kind == "power_law":
        g = 1.0 - alpha
        key = (F.floor(F.pow(u * ((rows + 1.0) ** g - 1.0) + 1.0, F.lit(1.0 / g))) - 1) if g else F.floor(F.exp(u * F.log(F.lit(rows + 1.0)))) - 1
    else:
        raise ValueError(f"no generator {kind!r}")
    return spark.range(n).select(F.floor(F.col("id") / batch).alias("step"), F.col("id").alias("pos"), F.greatest(F.lit(0), F.least(F.lit(rows - 1), key)).cast("long").alias("key"))


def alpha_of_pareto(share: float, rows: int) -> float:
    """The power-law exponent at which the most frequent ``share`` of keys takes 1 - share of requests."""
    lo, hi = 0.0, 8.0
    for _ in range(80):
        mid = (lo + hi) / 2
        g = 1.0 - mid
        mass = (((share * rows) ** g - 1) / (rows**g - 1)) if abs(g) > 1e-9 else 1.0
        lo, hi = (mid, hi) if mass < 1 - share else (lo, mid)
    return (lo + hi) / 2


def initial_rows(spark: SparkSession, n: int, dim: int, value: float | None = None, seed: int = 31337) -> DataFrame:
    """(key, vec) of the keys 0 .. n - 1: all elements ``value``, or uniform in [0, 1) by a hash of seed, key and place."""
    draw = lambda i: F.pmod(F.xxhash64(F.lit(seed), "id", i), F.lit(1 << 24)) / F.lit(float(1 << 24))
    vec = F.array_repeat(F.lit(float(value)), dim) if value is not None else F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), draw)
    return spark.range(n).select(F.col("id").alias("key"), vec.cast("array<float>").alias("vec"))
