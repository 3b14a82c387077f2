"""Tables of (key, vec[, meta]) and their verbs. A table is immutable; each change gives a new version."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecforge.functions import vectors


@dataclass(frozen=True)
class Table:
    """A relation with one row per key: key long, vec array, meta (long, of eviction policies).

    ``df`` is a lazy plan; callers write versions out between many changes to cut its lineage.
    """

    df: DataFrame
    dim: int
    invalid_key: int = -1
    capacity: int | None = None  # per partition; None: no bound
    partitions: int = 1
    keep_share: float = 0.8
    policy: str = "random"

    @staticmethod
    def of(df: DataFrame, key: str, vec: str, dim: int, **options) -> Table:
        meta = F.col("meta").cast("long") if "meta" in df.columns else F.lit(0).cast("long")
        return Table(df.select(F.col(key).cast("long").alias("key"), F.col(vec).alias("vec"), meta.alias("meta")), dim, **options)

    def _with(self, df: DataFrame) -> Table:
        return replace(self, df=df.select("key", "vec", "meta"))

    def find(self, requests: DataFrame, resolved: str | None = None) -> DataFrame:
        """``requests`` (key, ...) with vec and hit. Rows that ``resolved`` marks are not looked up.

        The invalid key is a miss. The join is left to the planner: it broadcasts a small side and merges two large ones.
        """
        skip = F.col("key") == self.invalid_key
        if resolved:
            skip |= F.coalesce(F.col(resolved), F.lit(False))
        side = self.df.select(F.col("key").alias("__key"), "vec")
        # rows to skip keep their keys, so they are dealt out as the others and don't meet in one task
        return requests.join(side, (F.col("key") == F.col("__key")) & ~skip, "left").withColumn("hit", F.col("__key").isNotNull()).drop("__key")

    def exists(self, requests: DataFrame) -> DataFrame:
        return requests.join(self.df.select("key"), "key", "left_semi")

    def missing(self, requests: DataFrame) -> DataFrame:
        return requests.join(self.df.select("key"), "key", "left_anti")

    def insert(self, rows: DataFrame, on_existing: str = "overwrite", clock: int = 0) -> Table:
        """Upsert ``rows`` (pos, key, vec): of equal keys the last by pos counts. Then the capacity holds."""
        if on_existing not in ("overwrite", "keep"):
            raise ValueError("on_existing is 'overwrite' or 'keep'")
        new = last_writer(rows.filter(F.col("key") != self.invalid_key)).withColumn("__new", F.lit(True))
        old = self.df.select("key", F.col("vec").alias("__old"), "meta")
        both = old.join(new, "key", "full")
        first, second = ("vec", "__old") if on_existing == "overwrite" else ("__old", "vec")
        out = both.select("key", F.coalesce(first, second).alias("vec"), F.coalesce("meta", F.lit(clock)).cast("long").alias("meta"))
        return self._with(out)._evict()

    def update(self, rows: DataFrame) -> Table:
        """Overwrite resident keys only; of equal keys the last by pos counts."""
        new = last_writer(rows).withColumnRenamed("vec", "__new")
        return self._with(self.df.join(new, "key", "left").withColumn("vec", F.coalesce("__new", "vec")))

    def accumulate(self, rows: DataFrame) -> Table:
        """Add to resident keys only, in double, kept in the table's type; equal keys add up. A shorter row adds to the first elements."""
        added = sum_vectors(rows, ["key"], self.dim).withColumnRenamed("vec", "__add")
        return self._with(self.df.join(added, "key", "left").withColumn("vec", F.when(F.col("__add").isNull(), F.col("vec")).otherwise(vectors.add(F.col("vec"), F.col("__add")).cast(self.df.schema["vec"].dataType))))

    def accumulate_quantized(self, rows: DataFrame, affine: bool = False) -> Table:
        """:meth:`accumulate` of rows (key, q, scale[, offset]) of narrow integers."""
        return self.accumulate(rows.select("key", vectors.dequantize(F.struct("q", "scale", *(["offset"] if affine else [])), affine).alias("vec")))

    def erase(self, keys: DataFrame) -> Table:
        return self._with(self.df.join(keys.select("key"), "key", "left_anti"))

    def clear(self) -> Table:
        return self._with(self.df.limit(0))

    def size(self, exact: bool = True) -> int:
        return self.df.count() if exact else self.df.agg(F.approx_count_distinct("key")).first()[0]

    def touch(self, requests: DataFrame, clock: str | None = None) -> Table:
        """The version after a lookup: LRU metas become the latest clock, LFU metas grow by the hits."""
        if self.policy == "lru":
            seen = requests.groupBy("key").agg(F.max(clock).cast("long").alias("__seen"))
            meta = F.greatest("meta", "__seen")
        else:
            seen = requests.groupBy("key").agg(F.count("*").alias("__seen"))
            meta = F.col("meta") + F.coalesce("__seen", F.lit(0))
        return self._with(self.df.join(seen, "key", "left").withColumn("meta", meta))

    def _evict(self) -> Table:
        return self if self.capacity is None else self._with(evict(self.df, self.capacity, self.keep_share, self.policy, self.partitions))


def last_writer(rows: DataFrame) -> DataFrame:
    """(key, vec) with the last vec by pos; combined map-side."""
    return rows.groupBy("key").agg(F.max_by("vec", "pos").alias("vec"))


def sum_vectors(rows: DataFrame, by: list[str], dim: int, value: str = "vec", weight: str | None = None) -> DataFrame:
    """(by..., vec): sums by element. One scalar sum per element keeps the state fixed and combines map-side,
    so a hot key costs a task no more than its partial rows."""
    x = lambda i: F.coalesce(F.get(F.col(value), F.lit(i)).cast("double"), F.lit(0.0)) * (F.col(weight) if weight else F.lit(1.0))
    return rows.groupBy(*by).agg(*[F.sum(x(i)).alias(f"__{i}") for i in range(dim)]).select(*by, F.array(*[F.col(f"__{i}") for i in range(dim)]).alias("vec"))


def evict(df: DataFrame, margin: int, keep_share: float, policy: str, partitions: int = 1, seed: int = 2654435761) -> DataFrame:
    """In partitions (key modulo) of more than ``margin`` rows, keep the best floor(margin * keep_share).

    LRU and LFU keep the largest metas, smaller keys first among equals; random keeps the smallest of a key
    hash. LFU halves the metas of survivors of a partition that evicted. lfu_store is the rule of the
    key-value store: the smallest (meta, key) go first, and survivors lose half their meta, rounded down.
    """
    order = {"lru": F.col("meta").desc(), "lfu": F.col("meta").desc(), "lfu_store": F.col("meta").desc(), "random": F.pmod(F.col("key") * F.lit(seed), F.lit(1 << 32))}
    if policy not in order:
        raise ValueError(f"no eviction policy {policy!r}")
    part = F.pmod("key", F.lit(partitions))
    w = Window.partitionBy("__part")
    ranked = df.withColumn("__part", part).withColumn("__n", F.count("*").over(w)).withColumn("__rank", F.row_number().over(w.orderBy(order[policy], F.col("key").desc() if policy == "lfu_store" else F.col("key"))))
    over = F.col("__n") > margin
    kept = ranked.filter(~over | (F.col("__rank") <= int(margin * keep_share)))
    if policy == "lfu":
        kept = kept.withColumn("meta", F.when(over, F.shiftright("meta", 1)).otherwise(F.col("meta")))
    if policy == "lfu_store":
        kept = kept.withColumn("meta", F.when(over, F.col("meta") - F.shiftright(F.greatest("meta", F.lit(0)), 1)).otherwise(F.col("meta")))
    return kept.drop("__part", "__n", "__rank")
