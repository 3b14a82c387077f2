import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecforge.functions import keys, vectors
from vecforge.operators import setcache
from vecforge.operators.table import Table
from vecforge.plans import datagen, layers
from vecforge.sources import backends, files
from vecforge.streaming import stream
from vecforge.streaming.heuristics import Chance, Change, Never, Statistical, Window, chebyshev, default_thresholds


def test_tensor_files(spark, tmp_path):
    files.register(spark)
    a = np.arange(30, dtype=np.float32).reshape(10, 3)
    np.save(tmp_path / "a.npy", a)
    a.tofile(tmp_path / "a.dyn")
    files.write_tensors(str(tmp_path / "a.tensors"), {7: a * 2, 9: a})
    for df in (spark.read.format("npy").load(str(tmp_path / "a.npy")), spark.read.format("dyn").option("width", 3).load(str(tmp_path / "a.dyn")), spark.read.format("tensorfile").option("tensor", 9).load(str(tmp_path / "a.tensors"))):
        assert [list(r["vec"]) for r in df.orderBy("row").collect()] == a.tolist()
    with pytest.raises(ValueError):
        files.npy_layout(str(tmp_path / "a.dyn"))


def test_stored_tables(spark, tmp_path):
    df = spark.range(5).selectExpr("id AS key", "array(1.0D, 2.0D) AS vec")
    table = Table.of(df, "key", "vec", 2)
    store = backends.create("parquet", spark, path=str(tmp_path))
    store.save("t", table)
    store.save("t", table.erase(df.filter("key < 2")))
    assert store.load("t").size() == 3
    with pytest.raises(ValueError):
        backends.create("none", spark)
    with pytest.raises(NotImplementedError):
        backends.create("perfect_hash", spark).apply("erase", table, df)


def test_a_failed_save_is_passed_over(spark, tmp_path):
    table = Table.of(spark.range(5).selectExpr("id AS key", "array(1.0D, 2.0D) AS vec"), "key", "vec", 2)
    store = backends.create("parquet", spark, path=str(tmp_path))
    store.save("t", table)
    (tmp_path / "default" / "t" / "v2" / "data").mkdir(parents=True)
    store.save("t", table.erase(spark.range(1).selectExpr("id AS key")))
    assert store.load("t").size() == 4 and (tmp_path / "default" / "t" / "v3").is_dir()
    with pytest.raises(NotImplementedError):
        backends.create("parquet", spark, path=str(tmp_path), read_only=True).save("t", table)


def test_partitioned_store(spark, tmp_path):
    rows = spark.range(100).selectExpr("id AS key", "array(CAST(id AS DOUBLE), 2.0D) AS vec")
    table = Table.of(rows, "key", "vec", 2)
    store = backends.create("partitioned", spark, path=str(tmp_path), namespace="one", partitions=4)
    store.save("t", table)
    assert {p.name for p in (tmp_path / "one" / "t" / "v1" / "data").glob("part=*")} == {f"part={i}" for i in range(4)}
    part = keys.fnv1a(np.arange(100, dtype=np.uint64)) & np.uint64(3)
    assert {r["part"]: r["size"] for r in store.sizes("t").collect()} == dict(enumerate(np.bincount(part.astype(int)).tolist()))
    requests = spark.createDataFrame([(0, 7), (1, 200), (2, 7), (3, None), (4, -1)], "pos long, key long")
    other = backends.create("partitioned", spark, path=str(tmp_path), namespace="one", partitions=16)  # the manifest's count holds
    got = {r["pos"]: (r["vec"], r["hit"]) for r in other.find("t", requests).collect()}
    assert got == {0: ([7.0, 2.0], True), 1: (None, False), 2: ([7.0, 2.0], True), 3: (None, False), 4: (None, False)}
    other.save("t", store.load("t").erase(rows.filter("key < 90")))
    assert store.load("t").size() == 10 and {r["key"] for r in store.find("t", rows.select("key")).filter("hit").collect()} == set(range(90, 100))
    store.save("t", table.clear())
    assert store.load("t").df.columns == ["key", "vec", "meta"]
    assert store.load("t").size() == 0 and store.find("t", requests).filter("hit").count() == 0
    with pytest.raises(ValueError):
        backends.create("partitioned", spark, path=str(tmp_path), namespace="two").load("t")


def test_backends_state_their_version(spark):
    @backends.register("own", api=(1, 0))
    class Own(backends.MapBackend):
        pass

    assert isinstance(backends.create("own", spark), Own)
    for api in ((2, 0), (1, 1)):
        with pytest.raises(ValueError):
            backends.register("newer", api=api)


def test_layers_are_exported_and_loaded(spark, tmp_path):
    table = Table.of(spark.range(5).selectExpr("id AS key", "array(1.0D, 2.0D) AS vec"), "key", "vec", 2)
    backends.export_layers({"a": ("one", table), "b": ("one", table), "c": ("two", table.erase(spark.range(3).selectExpr("id AS key")))}, str(tmp_path), spark)
    assert {n: t.size() for n, t in backends.load_layers(str(tmp_path), spark).items()} == {"a": 5, "b": 5, "c": 2}
    bad = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], "key long, vec array<double>")
    assert sorted((str(r["key"]), r["problem"]) for r in backends.scan(bad, 2).collect()) == [("1", "row"), ("2", "repeated"), ("None", "row")]


def test_imports(spark):
    rows = lambda n, x: spark.range(n).select(F.col("id").alias("row"), F.array(x).alias("vec"))
    got = files.import_pairs(rows(9, F.col("id") * 2), rows(9, F.lit(0.5))).orderBy("pos").collect()
    assert [(r["pos"], r["key"], r["vec"]) for r in got] == [(i, 2 * i, [0.5]) for i in range(9)]
    for a, b in ((9, 8), (8, 9)):
        with pytest.raises(Exception, match="differ in length"):
            files.import_pairs(rows(a, F.col("id")), rows(b, F.lit(0.5))).collect()
    batches = [(np.array([5, 6]), np.arange(6.0).reshape(2, 3)), (np.array([7]), np.ones((1, 3)))]
    found = [r for df in files.from_batches(spark, iter(batches)) for r in df.collect()]
    assert [(r["pos"], r["key"], r["vec"]) for r in found] == [(0, 5, [0.0, 1.0, 2.0]), (1, 6, [3.0, 4.0, 5.0]), (2, 7, [1.0] * 3)]
    with pytest.raises(ValueError):
        list(files.from_batches(spark, iter([(np.array([1]), np.ones((2, 2)))])))


def test_nulls_and_codecs(spark):
    df = spark.createDataFrame([(1, [1.0, None, 1e9]), (None, None), (-1, [])], "key long, vec array<double>")
    got = df.select(keys.partition_hash(F.col("key"), 8, "murmur3").alias("p"), *[vectors.through(F.col("vec"), k).alias(k) for k in ("float16", "bfloat16", "e4m3", "e5m2")]).collect()
    assert [r["p"] is None for r in got] == [False, True, False]
    assert [r["float16"] for r in got] == [[1.0, None, float("inf")], None, []]
    assert [r["e4m3"] for r in got] == [[1.0, None, 448.0], None, []]
    assert got[0]["e5m2"] == [1.0, None, float("inf")] and abs(got[0]["bfloat16"][2] / 1e9 - 1) < 1 / 256


def test_offsets_and_modes_are_checked(spark):
    rows = spark.range(6).selectExpr("id AS pos", "id % 3 AS key")
    table = Table.of(spark.range(3).selectExpr("id AS key", "array(id + 1.0D) AS vec"), "key", "vec", 1)
    layer = layers.HostLayer(table)
    offsets = lambda *x: spark.createDataFrame([(i, *p) for i, p in enumerate(x)], "bag long, off_start long, off_end long")
    got = layer.lookup(rows, "sum", offsets=offsets((0, 2), (2, 2), (2, 6))).orderBy("bag").collect()
    assert [r["vec"] for r in got] == [[3.0], [0.0], [9.0]]
    for bad in (((0, 2), (3, 6)), ((1, 6),), ((0, 5),), ((0, 4), (4, 2), (2, 6)), ()):
        with pytest.raises(ValueError):
            layer.lookup(rows, "sum", offsets=offsets(*bad))
    for mode in ("max", "weighted_sum"):
        with pytest.raises(ValueError):
            layer.lookup(rows, mode)


def test_request_streams_and_first_rows(spark):
    for kind in ("sequential", "uniform", "power_law"):
        got = datagen.requests(spark, 5000, 100, kind, batch=1000).collect()
        counts = np.bincount([r["key"] for r in got], minlength=100)
        assert len(counts) == 100 and {r["step"] for r in got} == set(range(5)) and (kind != "power_law" or counts.argmax() == 0)
    with pytest.raises(ValueError):
        datagen.requests(spark, 1, 1, "none")
    assert 0.5 < datagen.alpha_of_pareto(0.2, 100_000) < 1.2
    rows = datagen.initial_rows(spark, 50, 4)
    assert rows.collect() == rows.repartition(7).orderBy("key").collect()
    values = np.array([r["vec"] for r in rows.collect()])
    assert values.shape == (50, 4) and 0 <= values.min() < values.max() < 1


def test_automatic_inserts(spark, tmp_path):
    """A stream whose table is filled from the backing table by what it asks for; retried batches insert once."""
    backing = Table.of(spark.range(50).selectExpr("id AS key", "array(id * 1.0D) AS vec"), "key", "vec", 1)
    auto = stream.AutoInsert(backing.clear(), backing, Change([0.1]), max_insert=10)
    batch = spark.range(400).selectExpr("CAST(id % 20 + (id % 7) * 0 AS long) AS key").unionByName(spark.range(3).selectExpr("id + 90 AS key"))
    auto(batch, 0)
    assert auto.table.size() == 10 and auto.rates == [0.0]
    auto(batch, 0)
    assert auto.table.size() == 10 and len(auto.rates) == 1
    auto(batch, 1)
    assert auto.table.size() == 20 and abs(auto.rates[1] - 200 / 403) < 1e-9
    assert set(r["key"] for r in auto.table.df.collect()) == set(range(20))
    chance = Chance([0.8], seed=3)
    rate = sum(chance.insert_needed(0.5, 0) for _ in range(4000)) / 4000
    high = sum(chance.insert_needed(0.9, 0) for _ in range(40_000)) / 40_000
    assert abs(rate - 0.5) < 0.04 and abs(high - 0.001) < 0.001


def trace(warm, top, steady, spread, seed):
    rng = np.random.default_rng(seed)
    return [max(0.0, i * top / warm) for i in range(warm + 1 if warm else 0)] + list(top + rng.normal(0, spread, steady))


def test_statistical_heuristic_follows_traces():
    for seed in range(10):
        flat = Statistical([3.0], n_keys=1000)
        yes = [flat.insert_needed(h) for h in trace(0, 0.8, 300, 0.002, seed)]
        assert not any(yes[:14]) and all(yes[14:64]) and not any(yes[64:])  # a window, then the rounds, then steady
        h = Statistical([3.0], n_keys=1000)
        yes = [h.insert_needed(x) for x in trace(0, 0.5, 100, 0.002, seed) + [0.95] * 60]
        assert sum(yes) == 100 and not any(yes[64:103]) and all(yes[103:153])  # a jump up, seen three times in a row
    two = Statistical([3.0, 3.0])
    for i in range(14):
        assert not two.insert_needed(0.5 + 0.01 * (i % 2), 0)
    assert two.insert_needed(0.5, 0) and not two.insert_needed(0.5, 1)
    moved = Statistical([3.0], rounds=2, n_keys=1000, seed=5)
    yes = [moved.insert_needed(x) for x in [0.2] * 16 + [0.9] + [0.9] * 13 + [0.9] * 2 + [0.9] * 9]
    assert yes[14:16] == [True, True] and not any(yes[16:30]) and yes[30:32] == [True, True] and not any(yes[32:])
    for bad in ([], [0.0]):
        with pytest.raises(ValueError):
            Statistical(bad)
    with pytest.raises(ValueError):
        Statistical().insert_needed(0.5, 1)
    assert chebyshev(3.0, 14) == pytest.approx(math.floor(15 / 14 * (13 / 9 + 1)) / 15)
    assert default_thresholds([True, False, False]) == [0.75, 0.75, 0.0] and default_thresholds([True]) == [0.75]
    assert setcache.geometry(1 << 20, 64 * 4) == (1 << 20) // (8 * (8 + 256 + 4))


def test_heuristics():
    change = Change([0.1])
    assert [change.insert_needed(h, 0) for h in (0.5, 0.55, 0.61, 0.6)] == [True, False, True, False]
    assert not Never().insert_needed(0.0, 0)
    w = Window()
    w.add(0.7)
    assert abs(w.mean() - 0.05) < 1e-12
