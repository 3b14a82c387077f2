"""Pooling of looked-up vectors over fixed or ragged bags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecforge.operators.table import sum_vectors

MODES = ("sum", "mean", "weighted_sum", "weighted_mean", "concat")


def check(mode: str, weighted: bool = False) -> None:
    if mode not in MODES:
        raise ValueError(f"pooling mode {mode!r} is not one of {', '.join(MODES)}")
    if mode.startswith("weighted") and not weighted:
        raise ValueError(f"{mode} needs weights")


def fixed_bag(pos: Column, hotness: int) -> Column:
    if hotness < 1:
        raise ValueError("hotness must be positive")
    return F.floor(pos / hotness).cast("long")


def csr_bags(offsets: DataFrame) -> DataFrame:
    """(bag, pos) of each position, from (bag, off_start, off_end); an equi-join on pos then assigns bags."""
    return offsets.filter("off_end > off_start").select("bag", F.explode(F.sequence(F.col("off_start"), F.col("off_end") - 1)).alias("pos"))


def check_offsets(offsets: DataFrame, n: int) -> None:
    """Raise ValueError unless offsets (bag: consecutive numbers) start at 0, never fall, join up and end at n."""
    before = offsets.select((F.col("bag") + 1).alias("bag"), F.col("off_end").alias("__prev"))
    joined = offsets.join(before, "bag", "left")
    row = joined.agg(F.min("off_start"), F.max("off_end"), F.count_if(F.col("off_end") < F.col("off_start")), F.count_if(F.col("__prev") != F.col("off_start")), F.count_if(F.col("__prev").isNull()), F.count_if(F.col("off_start").isNull() | F.col("off_end").isNull())).first()
    if row[0] != 0 or row[1] != n or row[2] or row[3] or row[4] != 1 or row[5]:
        raise ValueError("offsets must start at 0, not fall, and end at the number of keys")


def pool(rows: DataFrame, mode: str, dim: int, bags: DataFrame | None = None, weight: str = "weight", vec: str = "vec") -> DataFrame:
    """(bag, vec) from rows (bag, vec[, weight]).

    Sums are taken in double. Mean divides by the number of rows, weighted_mean by the sum of weights; where
    that is 0 the result is the zero row. With ``bags`` (bag) each gets a row, the empty ones zeros.
    Unweighted modes ignore weights. Partial sums are combined map-side.
    """
    check(mode, weight in rows.columns)
    if mode == "concat":
        return rows
    weighted = mode.startswith("weighted")
    w = F.col(weight).cast("double") if weighted else F.lit(1.0)
    x = lambda i: F.coalesce(F.get(F.col(vec), F.lit(i)).cast("double"), F.lit(0.0)) * w
    sums = rows.groupBy("bag").agg(*[F.sum(x(i)).alias(f"__{i}") for i in range(dim)], F.sum(w).alias("__w"))
    below = F.col("__w") if mode.endswith("mean") else F.lit(1.0)
    out = sums.select("bag", F.array(*[F.when(below == 0, 0.0).otherwise(F.col(f"__{i}") / below) for i in range(dim)]).alias("vec"))
    if bags is None:
        return out
    return bags.select("bag").join(out, "bag", "left").select("bag", F.coalesce("vec", F.array_repeat(F.lit(0.0), dim)).alias("vec"))


def pool_small(rows: DataFrame, mode: str, dim: int) -> DataFrame:
    """Sum or mean by collecting each bag's vectors: for many small bags of wide vectors only."""
    check(mode)
    zero = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate("__all", zero, lambda t, v: F.zip_with(t, v, lambda a, b: a + b))
    out = rows.groupBy("bag").agg(F.collect_list("vec").alias("__all"), F.count("*").alias("__n")).withColumn("vec", total)
    return out.select("bag", F.transform("vec", lambda x: x / F.col("__n")).alias("vec") if mode == "mean" else "vec")


def backward(rows: DataFrame, gradients: DataFrame, mode: str, dim: int) -> DataFrame:
    """(key, vec): the gradient of each key, from rows (bag, key[, weight]) and gradients (bag, grad).

    A row gets its bag's gradient times 1, 1 / count, w or w / sum of w (0 where that sum is 0).
    """
    check(mode, "weight" in rows.columns)
    if mode == "concat":
        return sum_vectors(gradients, ["key"], dim, "grad")
    weighted = mode.startswith("weighted")
    w = F.col("weight").cast("double") if weighted else F.lit(1.0)
    if mode.endswith("mean"):
        below = rows.groupBy("bag").agg(F.sum(w).alias("__below"))
        rows = rows.join(below, "bag").withColumn("__w", F.when(F.col("__below") == 0, 0.0).otherwise(w / F.col("__below")))
    else:
        rows = rows.withColumn("__w", w)
    return sum_vectors(rows.join(gradients, "bag"), ["key"], dim, "grad", "__w")
