"""Table backends by name, and stored tables: Parquet directories with a manifest of versions."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecforge.functions import keys
from vecforge.operators.table import Table

MANIFEST_VERSION = 2
#: Version (major, minor) of what a backend has to offer.
API_VERSION = (1, 0)


class TableBackend(ABC):
    """Where tables of one kind live. Subclasses are registered under a name."""

    unsupported: tuple[str, ...] = ()

    def __init__(self, spark: SparkSession, **options):
        self.spark, self.options = spark, options

    @abstractmethod
    def load(self, name: str) -> Table: ...

    @abstractmethod
    def save(self, name: str, table: Table) -> None: ...

    def apply(self, verb: str, table: Table, *args, **kwargs):
        """Call a verb of :class:`Table`, NotImplementedError for those that the backend lacks."""
        if verb in self.unsupported:
            raise NotImplementedError(f"{type(self).__name__} has no {verb}")
        return getattr(table, verb)(*args, **kwargs)


_BACKENDS: dict[str, Callable[..., TableBackend]] = {}


def register(name: str, api: tuple[int, int] = API_VERSION):
    """Class decorator. ``api`` is the version a backend was written for: the same major, no newer minor."""
    if api[0] != API_VERSION[0] or api[1] > API_VERSION[1]:
        raise ValueError(f"backend {name!r} is for version {api}, this is {API_VERSION}")

    def keep(cls):
        _BACKENDS[name] = cls
        return cls

    return keep


def create(name: str, spark: SparkSession, **options) -> TableBackend:
    if name not in _BACKENDS:
        raise ValueError(f"no table backend {name!r}; there are {', '.join(sorted(_BACKENDS))}")
    return _BACKENDS[name](spark, **options)


@register("map")
class MapBackend(TableBackend):
    """Tables held by the session."""

    def __init__(self, spark, **options):
        super().__init__(spark, **options)
        self.tables: dict[str, Table] = {}

    def load(self, name: str) -> Table:
        if name not in self.tables:
            raise ValueError(f"no table {name!r}")
        return self.tables[name]

    def save(self, name: str, table: Table) -> None:
        self.tables[name] = table


@register("parquet")
class ParquetBackend(TableBackend):
    """A directory per namespace and table; each save is a new version, and readers keep theirs.

    Keys are hash-dealt on writing, so a version's files are of like size. The manifest is written last: a
    version without one is a save that failed, which readers pass over and later saves number past.
    Option ``read_only`` refuses saves.
    """

    def _at(self, name: str) -> str:
        return "/".join([self.options["path"].rstrip("/"), self.options.get("namespace", "default"), name])

    def _versions(self, name: str, whole: bool = True) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        at = path(self._at(name))
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and (not whole or fs.exists(path(f"{self._at(name)}/{n}/manifest/_SUCCESS"))))

    def load(self, name: str) -> Table:
        versions = self._versions(name)
        if not versions:
            raise ValueError(f"no table {name!r}")
        at = f"{self._at(name)}/v{versions[-1]}"
        meta = json.loads(self.spark.read.text(f"{at}/manifest").first()[0])
        if meta["version"] > MANIFEST_VERSION:
            raise ValueError(f"manifest version {meta['version']} is newer than {MANIFEST_VERSION}")
        return Table(self._read(f"{at}/data", meta), **meta["table"])

    def _read(self, at: str, meta: dict) -> DataFrame:
        return self.spark.read.parquet(at)

    def _write(self, df: DataFrame, at: str) -> None:
        df.repartition("key").write.parquet(at)

    def _layout(self) -> dict:
        """What a version's manifest says beside the table's own settings."""
        return {}

    def save(self, name: str, table: Table) -> None:
        if self.options.get("read_only"):
            raise NotImplementedError("the store is read-only")
        at = f"{self._at(name)}/v{max(self._versions(name, whole=False), default=0) + 1}"
        meta = {k: getattr(table, k) for k in ("dim", "invalid_key", "capacity", "partitions", "keep_share", "policy")}
        self._write(table.df.select("key", "vec", "meta"), f"{at}/data")
        self.spark.createDataFrame([(json.dumps({"version": MANIFEST_VERSION, "table": meta, "schema": table.df.select("key", "vec", "meta").schema.jsonValue()} | self._layout()),)], "value string").coalesce(1).write.text(f"{at}/manifest")


@register("partitioned")
class PartitionedBackend(ParquetBackend):
    """A store dealt over key partitions, with a folder for each one in every version.

    Options: ``partitions`` (a power of two, 8 unless given) and ``hash`` (of ``keys.HASHES``). A version's
    manifest keeps both, so another setting re-deals the keys of later saves and misplaces none of earlier
    ones. Large partitions are split over several tasks and files on writing. Null keys are not stored.
    """

    def _layout(self) -> dict:
        return {"layout": {"partitions": self.options.get("partitions", 8), "hash": self.options.get("hash", "fowler_noll_vo")}}

    def _write(self, df: DataFrame, at: str) -> None:
        df.filter("key IS NOT NULL").withColumn("part", part_of(F.col("key"), self._layout())).hint("rebalance", F.col("part")).write.partitionBy("part").parquet(at)

    def _read(self, at: str, meta: dict) -> DataFrame:
        self.layout = meta
        return self.spark.read.schema(T.StructType.fromJson(meta["schema"]).add("part", "long")).parquet(at)

    def load(self, name: str) -> Table:
        table = super().load(name)
        return replace(table, df=table.df.drop("part"))

    def find(self, name: str, requests: DataFrame) -> DataFrame:
        """Like ``Table.find``, by partition and key: folders of partitions that no request needs can be pruned."""
        table = super().load(name)
        side = table.df.select("part", F.col("key").alias("__key"), "vec")
        asked = requests.withColumn("__part", part_of(F.col("key"), self.layout))
        met = (F.col("__part") == F.col("part")) & (F.col("key") == F.col("__key")) & (F.col("key") != table.invalid_key)
        return asked.join(side, met, "left").withColumn("hit", F.col("__key").isNotNull()).drop("__key", "__part", "part")

    def sizes(self, name: str) -> DataFrame:
        """(part, size) of the partitions that have rows; reads no column but the folders' names."""
        return super().load(name).df.groupBy("part").agg(F.count("*").alias("size"))


def part_of(key: Column, meta: dict) -> Column:
    return keys.partition_hash(key, meta["layout"]["partitions"], meta["layout"]["hash"])


@register("perfect_hash")
class PerfectHashBackend(MapBackend):
    """Insert, update and find only."""

    unsupported = ("erase", "accumulate")


def export_layers(layers: dict[str, tuple[str, Table]], path: str, spark: SparkSession) -> None:
    """Save layers (name -> (resource, table)); layers of one resource share its weights."""
    store = ParquetBackend(spark, path=path, namespace="resources")
    for resource, table in {r: t for r, t in layers.values()}.items():
        store.save(resource, table)
    meta = {"version": MANIFEST_VERSION, "layers": {n: {"storage_ref": r, "dim": t.dim} for n, (r, t) in layers.items()}}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_layers(path: str, spark: SparkSession) -> dict[str, Table]:
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    if meta["version"] > MANIFEST_VERSION:
        raise ValueError(f"export version {meta['version']} is newer than {MANIFEST_VERSION}")
    store, out = ParquetBackend(spark, path=path, namespace="resources"), {}
    for name, layer in meta["layers"].items():
        out[name] = store.load(layer["storage_ref"])
        if out[name].dim != layer["dim"]:
            raise ValueError(f"layer {name}: {layer['dim']} columns, but its weights have {out[name].dim}")
    return out


def scan(df: DataFrame, dim: int) -> DataFrame:
    """Rows that break a table's geometry: vectors of another length, null or repeated keys."""
    bad = df.filter(F.col("key").isNull() | F.col("vec").isNull() | (F.size("vec") != dim)).select("key", F.lit("row").alias("problem"))
    return bad.unionByName(df.groupBy("key").count().filter("count > 1").select("key", F.lit("repeated").alias("problem")))
