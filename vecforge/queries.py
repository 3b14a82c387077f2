"""The registered queries of the engine and the same results in SQL.

Vectors appear in results as scalars: the sum of the elements and three of them. Positional cases take
events (event_id is the position, user_id the key), others lineitem (l_partkey is the key, l_orderkey
the bag); embeddings is the table.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecforge.functions import keys, vectors
from vecforge.operators import dedup, lookup, pooling, setcache
from vecforge.operators.lookup import digest
from vecforge.operators.table import Table, evict
from vecforge.operators.counters import LookupCounter
from vecforge.plans import datagen, layers
from vecforge.sources.files import import_pairs

DIM = 64
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that gives the same rows."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def embeddings(spark: SparkSession, sf: str, **options) -> Table:
    return Table.of(read(spark, sf, "embeddings"), "vec_id", "embedding", DIM, **options)


def doubles(spark: SparkSession, sf: str) -> Table:
    """The table with rows of doubles."""
    return Table.of(read(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), "vec_id", "embedding", DIM)


def events(spark: SparkSession, sf: str, times: int = 1) -> DataFrame:
    return read(spark, sf, "events").select(F.col("event_id").alias("pos"), (F.col("user_id") * times).alias("key"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("bag"), F.col("l_partkey").alias("key"), F.col("l_quantity").alias("weight"))


T = "(SELECT vec_id AS key, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
ITEMS = "(SELECT l_orderkey AS bag, l_partkey AS key, l_quantity AS weight FROM lineitem)"
EVENTS = "(SELECT event_id AS pos, user_id AS key FROM events)"
PLACES = ((1, "e0"), (18, "e17"), (64, "e63"))


def dig(v: str = "v", none: float | None = None) -> str:
    """The digest of a vector, or of the constant vector where it is null."""
    fill = lambda x, d: x if none is None else f"coalesce({x}, {none * d})"
    return ", ".join([f"round({fill(f'list_sum({v})', DIM)}, 5) AS total", *[f"round({fill(f'{v}[{i}]', 1)}, 5) AS {n}" for i, n in PLACES]])


def agg(w: str = "1", below: str = "1") -> str:
    """The digest of a weighted sum of vectors v, divided by an aggregate (0 where that is 0)."""
    one = lambda x: f"round(coalesce(CASE WHEN {below} = 0 THEN 0 ELSE sum({w} * {x}) / {below} END, 0), 5)"
    return ", ".join([f"{one('list_sum(v)')} AS total", *[f"{one(f'v[{i}]')} AS {n}" for i, n in PLACES]])


# --- lookups


@query("lookup_concat", f"SELECT pos, e.key, {dig()} FROM {EVENTS} e JOIN {T} t ON e.key = t.key")
def _(s, d):
    return embeddings(s, d).find(events(s, d)).filter("hit").select("pos", "key", *digest())


@query("lookup_left_miss_null", f"SELECT bag, e.key, t.key IS NOT NULL AS hit, {dig()} FROM {ITEMS} e LEFT JOIN {T} t ON e.key = t.key")
def _(s, d):
    return embeddings(s, d).find(items(s, d)).select("bag", "key", "hit", *digest())


@query("lookup_hot_cold", ORACLES["lookup_left_miss_null"])
def _(s, d):
    return lookup.hot_cold(embeddings(s, d), items(s, d), 64).select("bag", "key", "hit", *digest())


@query("lookup_default_zero", f"SELECT pos, e.key, {dig(none=0.0)} FROM (SELECT pos, key * 5 AS key FROM {EVENTS}) e LEFT JOIN {T} t ON e.key = t.key")
def _(s, d):
    return lookup.fill_default(embeddings(s, d).find(events(s, d, 5)), vectors.constant(0, DIM)).select("pos", "key", *digest())


@query("lookup_default_row", f"SELECT pos, e.key, {dig(none=0.5)} FROM (SELECT pos, key * 5 AS key FROM {EVENTS}) e LEFT JOIN {T} t ON e.key = t.key")
def _(s, d):
    return lookup.fill_default(embeddings(s, d).find(events(s, d, 5)), vectors.constant(0.5, DIM)).select("pos", "key", *digest())


@query("lookup_exists", f"SELECT bag, key FROM {ITEMS} WHERE key IN (SELECT vec_id FROM embeddings)")
def _(s, d):
    return embeddings(s, d).exists(items(s, d)).select("bag", "key")


@query("lookup_missing_keys", f"SELECT pos, key * 7 AS key FROM {EVENTS} WHERE key * 7 NOT IN (SELECT vec_id FROM embeddings)")
def _(s, d):
    return embeddings(s, d).missing(events(s, d, 7)).select("pos", "key")


BIT = "CASE WHEN pos % 64 = 63 THEN -9223372036854775808 ELSE CAST(1 AS BIGINT) << CAST(pos % 64 AS INTEGER) END"


@query("lookup_hit_mask_words", f"SELECT pos // 64 AS word, bit_or(CASE WHEN key * 5 IN (SELECT vec_id FROM embeddings) THEN {BIT} ELSE CAST(0 AS BIGINT) END) AS bits FROM {EVENTS} GROUP BY 1")
def _(s, d):
    return lookup.hit_mask(embeddings(s, d).find(events(s, d, 5)))


@query("lookup_resolved_skipped", f"SELECT pos, e.key, coalesce(pos % 3 <> 0 AND t.key IS NOT NULL, false) AS hit FROM {EVENTS} e LEFT JOIN {T} t ON e.key = t.key")
def _(s, d):
    return embeddings(s, d).find(events(s, d).withColumn("done", F.col("pos") % 3 == 0), "done").select("pos", "key", "hit")


@query("lookup_invalid_key", f"SELECT pos, e.key, t.key IS NOT NULL AS hit FROM {EVENTS} e LEFT JOIN {T} t ON e.key = t.key AND e.key <> 7")
def _(s, d):
    return embeddings(s, d, invalid_key=7).find(events(s, d)).select("pos", "key", "hit")


@query("lookup_sanitized", f"SELECT pos, e.key, {dig()} FROM (SELECT pos, key * 5 - 20 AS key FROM {EVENTS}) e JOIN {T} t ON CASE WHEN e.key BETWEEN 0 AND 299 THEN e.key ELSE 3 END = t.key")
def _(s, d):
    return lookup.lookup_dense(embeddings(s, d), 300, events(s, d, 5).withColumn("key", F.col("key") - 20), 3).select("pos", "key", *digest())


# --- pooling


def _fixed(s: SparkSession, d: str, weighted: bool) -> DataFrame:
    rows = embeddings(s, d).find(events(s, d)).filter("hit").withColumn("bag", pooling.fixed_bag(F.col("pos"), 8))
    return rows.withColumn("weight", (F.col("key") % 5).cast("double")) if weighted else rows


CSR = f"(SELECT b AS bag, b * (b - 1) // 2 AS off_start, least(b * (b + 1) // 2, n) AS off_end FROM (SELECT max(event_id) + 1 AS n FROM events) m, range(0, 100000) r(b) WHERE b * (b - 1) // 2 < n)"


def _offsets(s: SparkSession, d: str) -> DataFrame:
    """Ragged bags of 0, 1, 2, ... positions that cover all events."""
    n = (read(s, d, "events").agg(F.max("event_id")).first()[0] or 0) + 1
    b = F.col("id")
    start = F.floor(b * (b - 1) / 2).cast("long")
    return s.range(int((2 * n) ** 0.5) + 2).select(b.alias("bag"), start.alias("off_start"), F.least(start + b, F.lit(n)).alias("off_end")).filter(F.col("off_start") < n)


def _ragged(s: SparkSession, d: str, weighted: bool) -> DataFrame:
    rows = embeddings(s, d).find(events(s, d)).filter("hit").join(pooling.csr_bags(_offsets(s, d)), "pos")
    return rows.withColumn("weight", (F.col("key") % 5).cast("double")) if weighted else rows


for _mode in pooling.MODES[:-1]:
    _w = "(e.key % 5)" if _mode.startswith("weighted") else "1"
    _b = "1" if _mode.endswith("sum") else f"sum({_w})"

    @query(f"pool_{_mode}_fixed", f"SELECT pos // 8 AS bag, {agg(_w, _b)} FROM {EVENTS} e JOIN {T} t ON e.key = t.key GROUP BY 1")
    def _(s, d, mode=_mode):
        return pooling.pool(_fixed(s, d, mode.startswith("weighted")), mode, DIM).select("bag", *digest())

    @query(f"pool_{_mode}_csr", f"SELECT o.bag, {agg(_w.replace('e.key', 'x.key'), _b.replace('e.key', 'x.key'))} FROM {CSR} o LEFT JOIN (SELECT pos, e.key, v FROM {EVENTS} e JOIN {T} t ON e.key = t.key) x ON x.pos >= off_start AND x.pos < off_end GROUP BY 1")
    def _(s, d, mode=_mode):
        return pooling.pool(_ragged(s, d, mode.startswith("weighted")), mode, DIM, _offsets(s, d)).select("bag", *digest())

    @query(f"grad_pool_{_mode}", f"WITH r AS (SELECT bag, key, {'weight' if _w != '1' else '1'} AS w FROM {ITEMS}), b AS (SELECT bag, sum(w) AS below FROM r GROUP BY 1) SELECT key, " + ", ".join(f"round(sum(w{' / below' if _mode.endswith('mean') else ''} * (bag % 13) * {x}), 5) AS {n}" for x, n in (("2080 / 7.0", "total"), ("1 / 7.0", "e0"), ("18 / 7.0", "e17"), ("64 / 7.0", "e63"))) + " FROM r JOIN b USING (bag) GROUP BY key")
    def _(s, d, mode=_mode):
        rows = items(s, d)
        return pooling.backward(rows, gradients(rows, "bag"), mode, DIM).select("key", *digest())


def gradients(rows: DataFrame, by: str) -> DataFrame:
    """A deterministic gradient per bag: element i is (bag % 13) * (i + 1) / 7."""
    return rows.select(by).distinct().withColumn("grad", F.transform(F.sequence(F.lit(1), F.lit(DIM)), lambda i: i * (F.col(by) % 13) / 7.0))


@query("grad_concat", "SELECT user_id AS key, round(sum((event_id % 13) * 32.5), 5) AS total, round(sum((event_id % 13) / 64.0), 5) AS e0, round(sum((event_id % 13) * 18 / 64.0), 5) AS e17, round(sum((event_id % 13) * 1.0), 5) AS e63 FROM events GROUP BY 1")
def _(s, d):
    rows = events(s, d).withColumn("grad", F.transform(F.sequence(F.lit(1), F.lit(DIM)), lambda i: i * (F.col("pos") % 13) / 64.0))
    return pooling.backward(rows.withColumn("bag", F.col("pos")), rows.select("key", "grad"), "concat", DIM).select("key", *digest())


@query("sgd_step", f"WITH g AS (SELECT key, 0.01 / 7 * sum((bag % 13) * 1.0) AS g FROM {ITEMS} GROUP BY 1) SELECT t.key, round(list_sum(v) - 2080 * coalesce(g, 0), 5) AS total, round(v[1] - coalesce(g, 0), 5) AS e0, round(v[18] - 18 * coalesce(g, 0), 5) AS e17, round(v[64] - 64 * coalesce(g, 0), 5) AS e63 FROM {T} t LEFT JOIN g ON t.key = g.key")
def _(s, d):
    rows = items(s, d)
    return layers.sgd(doubles(s, d), rows, gradients(rows, "bag"), "sum", 0.01).df.select("key", *digest())


@query("pool_sum_bags", f"SELECT bag, {agg()} FROM {ITEMS} e JOIN {T} t ON e.key = t.key GROUP BY 1")
def _(s, d):
    return pooling.pool(embeddings(s, d).find(items(s, d)).filter("hit"), "sum", DIM).select("bag", *digest())


@query("pool_weighted_mean_bags", f"SELECT bag, {agg('weight', 'sum(weight)')} FROM {ITEMS} e JOIN {T} t ON e.key = t.key GROUP BY 1")
def _(s, d):
    return pooling.pool(embeddings(s, d).find(items(s, d)).filter("hit"), "weighted_mean", DIM).select("bag", *digest())


@query("pool_small_bags", ORACLES["pool_sum_bags"])
def _(s, d):
    return pooling.pool_small(embeddings(s, d).find(items(s, d)).filter("hit"), "sum", DIM).select("bag", *digest())


@query("pool_default_then_mean", f"SELECT bag, {agg(below='count(*)').replace('list_sum(v)', 'coalesce(list_sum(v), 32)').replace('v[1]', 'coalesce(v[1], 0.5)').replace('v[18]', 'coalesce(v[18], 0.5)').replace('v[64]', 'coalesce(v[64], 0.5)')} FROM {ITEMS} e LEFT JOIN {T} t ON e.key = t.key GROUP BY 1")
def _(s, d):
    return layers.HostLayer(embeddings(s, d), vectors.constant(0.5, DIM)).lookup(items(s, d).withColumn("pos", F.lit(0)), "mean").select("bag", *digest())


@query("pool_empty_bags", f"SELECT o_orderkey AS bag, {agg()} FROM (SELECT DISTINCT o_orderkey FROM orders) o LEFT JOIN (SELECT bag, v FROM {ITEMS} e JOIN {T} t ON e.key = t.key) x ON bag = o_orderkey GROUP BY 1")
def _(s, d):
    bags = read(s, d, "orders").select(F.col("o_orderkey").alias("bag")).distinct()
    return pooling.pool(embeddings(s, d).find(items(s, d)).filter("hit"), "sum", DIM, bags).select("bag", *digest())


ZERO = "CASE WHEN bag % 3 = 0 THEN 0 ELSE weight END"


@query("pool_zero_weight", f"SELECT bag, {agg(ZERO, f'sum({ZERO})')} FROM {ITEMS} e JOIN {T} t ON e.key = t.key GROUP BY 1")
def _(s, d):
    rows = embeddings(s, d).find(items(s, d)).filter("hit").withColumn("weight", F.when(F.col("bag") % 3 == 0, 0.0).otherwise(F.col("weight")))
    return pooling.pool(rows, "weighted_mean", DIM).select("bag", *digest())


# --- tiers


def tiers(s: SparkSession, d: str) -> list[Table]:
    """Three tables that overlap; a key's row differs from tier to tier."""
    t = read(s, d, "embeddings")
    scaled = lambda df, k: Table.of(df.withColumn("embedding", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * k)), "vec_id", "embedding", DIM)
    return [scaled(t.filter("vec_id % 4 = 0"), 1.0), scaled(t.filter("vec_id % 2 = 0"), 2.0), scaled(t.filter("vec_id < 400"), 4.0)]


TIER = "CASE WHEN t.key IS NULL THEN NULL WHEN t.key % 4 = 0 THEN 0 WHEN t.key % 2 = 0 THEN 1 WHEN t.key < 400 THEN 2 END"
TIERED = f"(SELECT bag, e.key, v, CAST({TIER} AS INTEGER) AS tier FROM {ITEMS} e LEFT JOIN {T} t ON e.key = t.key)"
FACTOR = "CASE tier WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 END"


@query("hier_lookup_tiers", f"SELECT bag, key, tier, round({FACTOR} * list_sum(v), 5) AS total, round({FACTOR} * v[1], 5) AS e0, round({FACTOR} * v[18], 5) AS e17, round({FACTOR} * v[64], 5) AS e63 FROM {TIERED}")
def _(s, d):
    return lookup.cascade(tiers(s, d), items(s, d)).select("bag", "key", "tier", *digest())


@query("hier_hitrates", f"WITH c AS (SELECT t.tier, count(x.tier) AS hits FROM (VALUES (0), (1), (2)) t(tier) LEFT JOIN {TIERED} x ON x.tier = t.tier GROUP BY 1), n AS (SELECT count(*) AS n FROM {ITEMS}), l AS (SELECT c.*, n, n - coalesce(sum(hits) OVER (ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM c, n) SELECT tier, hits, round(hits / n, 9) AS rate, round(CASE WHEN rest > 0 THEN hits / rest ELSE 1.0 END, 9) AS left_rate FROM l")
def _(s, d):
    return layers.EmbeddingLayer(tiers(s, d)).hit_rates(items(s, d)).select("tier", "hits", F.round("rate", 9).alias("rate"), F.round("left_rate", 9).alias("left_rate"))


@query("hier_pool_sum", f"SELECT bag, {agg(f'coalesce({FACTOR}, 0)')} FROM {TIERED} GROUP BY 1")
def _(s, d):
    return layers.EmbeddingLayer(tiers(s, d), vectors.constant(0, DIM)).lookup(items(s, d), "sum").select("bag", *digest())


# --- changes


def changes(s: SparkSession, d: str) -> DataFrame:
    """(pos, key, vec): constant rows, keys repeated and partly unknown."""
    return events(s, d, 7).withColumn("vec", F.array_repeat((F.col("pos") % 97).cast("double"), DIM))


LAST = "(SELECT key * 7 AS key, arg_max(pos % 97, pos) * 1.0 AS x, sum(pos % 97) * 1.0 AS added FROM (SELECT event_id AS pos, user_id AS key FROM events) GROUP BY 1)"


def changed(total: str, one: str, join: str) -> str:
    cols = ", ".join([f"round({total}, 5) AS total", *[f"round({one.replace('v[]', f'v[{i}]')}, 5) AS {n}" for i, n in PLACES]])
    return f"SELECT coalesce(t.key, u.key) AS key, {cols} FROM {T} t {join} JOIN {LAST} u ON t.key = u.key"


@query("table_insert_overwrite", changed("coalesce(x * 64, list_sum(v))", "coalesce(x, v[])", "FULL"))
def _(s, d):
    return embeddings(s, d).insert(changes(s, d)).df.select("key", *digest())


@query("table_insert_keep", changed("coalesce(list_sum(v), x * 64)", "coalesce(v[], x)", "FULL"))
def _(s, d):
    return embeddings(s, d).insert(changes(s, d), "keep").df.select("key", *digest())


@query("table_update", changed("coalesce(x * 64, list_sum(v))", "coalesce(x, v[])", "LEFT"))
def _(s, d):
    return embeddings(s, d).update(changes(s, d)).df.select("key", *digest())


@query("table_accumulate", changed("list_sum(v) + coalesce(added, 0) * 64", "v[] + coalesce(added, 0)", "LEFT"))
def _(s, d):
    return doubles(s, d).accumulate(changes(s, d)).df.select("key", *digest())


@query("table_accumulate_quantized", f"WITH u AS (SELECT user_id * 7 AS key, sum((event_id % 97 - 48) * 0.5) AS added FROM events GROUP BY 1) SELECT t.key, " + ", ".join([f"round(list_sum(v) + {DIM} * coalesce(added, 0), 5) AS total", *[f"round(v[{i}] + coalesce(added, 0), 5) AS {n}" for i, n in PLACES]]) + f" FROM {T} t LEFT JOIN u ON t.key = u.key")
def _(s, d):
    rows = events(s, d, 7).select("key", F.array_repeat((F.col("pos") % 97 - 48).cast("short"), DIM).alias("q"), F.lit(0.5).alias("scale"))
    return doubles(s, d).accumulate_quantized(rows).df.select("key", *digest())


@query("table_insert_capacity", f"WITH a AS (SELECT coalesce(t.key, u.key) AS key, coalesce(u.x * 64, list_sum(v)) AS total FROM {T} t FULL JOIN {LAST} u ON t.key = u.key), r AS (SELECT *, count(*) OVER (PARTITION BY key % 8) AS n, row_number() OVER (PARTITION BY key % 8 ORDER BY key) AS rn FROM a) SELECT key, round(total, 5) AS total FROM r WHERE n <= 40 OR rn <= 32")
def _(s, d):
    """Beyond 40 rows a partition keeps 32; all metas are equal, so smaller keys stay."""
    table = embeddings(s, d, capacity=40, partitions=8, policy="lru").insert(changes(s, d))
    return table.df.select("key", digest()[0])


@query("table_erase", f"SELECT key, {dig()} FROM {T} WHERE key NOT IN (SELECT user_id * 7 FROM events)")
def _(s, d):
    return embeddings(s, d).erase(events(s, d, 7)).df.select("key", *digest())


@query("table_size", "SELECT count(*) AS size FROM embeddings")
def _(s, d):
    return s.createDataFrame([(embeddings(s, d).size(),)], "size long")


@query("lookup_counters", f"SELECT 2 * count(*) AS requests, 2 * count_if(key * 5 IN (SELECT vec_id FROM embeddings)) AS hits FROM {EVENTS}")
def _(s, d):
    """Two lookups counted as they run."""
    counter = LookupCounter(embeddings(s, d))
    for _ in range(2):
        counter.find(events(s, d, 5)).write.format("noop").mode("overwrite").save()
    return s.createDataFrame([counter.get()], "requests long, hits long")


@query("initial_rows", "SELECT r.k AS key, 16.0 AS total, 0.25 AS e0, 0.25 AS e17, 0.25 AS e63 FROM (SELECT max(event_id) + 1 AS n FROM events) m, range(0, 10000000) r(k) WHERE k < n")
def _(s, d):
    n = read(s, d, "events").agg(F.max("event_id")).first()[0] + 1
    return datagen.initial_rows(s, n, DIM, 0.25).select("key", *digest())


@query("import_pairs", "SELECT vec_id AS pos, vec_id * 3 AS key, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total FROM embeddings")
def _(s, d):
    """Keys and rows as two row-numbered files give them, joined by row."""
    t = read(s, d, "embeddings").withColumnRenamed("vec_id", "row")
    keys_, rows = t.select("row", F.array(F.col("row") * 3).alias("vec")), t.select("row", F.col("embedding").alias("vec"))
    return import_pairs(keys_, rows).select("pos", "key", digest()[0])


@query("layer_dense", f"SELECT bag, {agg()} FROM (SELECT l_orderkey AS bag, l_partkey AS key FROM lineitem) e JOIN {T} t ON CASE WHEN e.key < 300 THEN e.key ELSE 3 END = t.key GROUP BY 1")
def _(s, d):
    layer = layers.DenseLayer(embeddings(s, d), 300, 3)
    return layer.insert(changes(s, d)).erase(events(s, d)).clear().lookup(items(s, d), "sum").select("bag", *digest())


@query("layer_promote", f"SELECT event_id AS pos, user_id AS key, CASE WHEN t.key IS NULL THEN NULL WHEN user_id % 3 = 0 OR user_id < 100 THEN 0 ELSE 1 END AS tier FROM events LEFT JOIN {T} t ON t.key = user_id")
def _(s, d):
    """A cache of every third row, to which the keys under 100 that were asked for are promoted."""
    t = read(s, d, "embeddings")
    layer = layers.CachedLayer(Table.of(t.filter("vec_id % 3 = 0"), "vec_id", "embedding", DIM), Table.of(t, "vec_id", "embedding", DIM))
    return layer.promote(events(s, d).filter("key < 100")).find(events(s, d)).select("pos", "key", "tier")


@query("layer_csr_lookup", f"SELECT o.bag, {agg()} FROM {CSR} o LEFT JOIN (SELECT pos, e.key, v FROM {EVENTS} e JOIN {T} t ON e.key = t.key) x ON x.pos >= off_start AND x.pos < off_end GROUP BY 1")
def _(s, d):
    """A layer's lookup with offsets, which are checked first."""
    return layers.HostLayer(embeddings(s, d), vectors.constant(0, DIM)).lookup(events(s, d), "sum", offsets=_offsets(s, d)).select("bag", *digest())


@query("table_clear", "SELECT vec_id AS key FROM embeddings WHERE false")
def _(s, d):
    return embeddings(s, d).clear().df.select("key")


@query("layer_write_through", f"SELECT e.key, {dig('w')} FROM {EVENTS} e JOIN (SELECT t.key, CASE WHEN u.key IS NULL THEN v ELSE [x FOR i IN range(64)] END AS w FROM {T} t LEFT JOIN {LAST} u ON t.key = u.key) y ON e.key = y.key".replace("[x FOR i IN range(64)]", "list_resize([x], 64, x)"))
def _(s, d):
    t = read(s, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    layer = layers.CachedLayer(Table.of(t.filter("vec_id % 3 = 0"), "vec_id", "embedding", DIM), Table.of(t, "vec_id", "embedding", DIM))
    return layer.update(changes(s, d)).find(events(s, d)).filter("tier IS NOT NULL").select("key", *digest())


# --- dedup and priorities


@query("dedup_unique_counts", "SELECT l_partkey AS key, count(*) AS count FROM lineitem GROUP BY 1")
def _(s, d):
    return dedup.unique_counts(items(s, d))


OFFSETS = "(SELECT user_id AS key, count(*) AS count, row_number() OVER (ORDER BY user_id) - 1 AS rank, CAST(coalesce(sum(count(*)) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM events GROUP BY 1)"


@query("dedup_offsets", f"SELECT rank, key, count, off FROM {OFFSETS}")
def _(s, d):
    return dedup.unique_offsets(events(s, d)).select("rank", "key", "count", "off")


@query("dedup_inverse", f"SELECT event_id AS pos, rank FROM events JOIN {OFFSETS} ON key = user_id")
def _(s, d):
    return dedup.inverse(events(s, d))


@query("dedup_chunks", "SELECT key, c AS chunk, least(8, n - c * 8) AS count FROM (SELECT user_id AS key, count(*) AS n FROM events GROUP BY 1), range(0, 1000000) r(c) WHERE c * 8 < n")
def _(s, d):
    return dedup.chunks(events(s, d), 8)


@query("dedup_salted_sum", "SELECT l_partkey AS key, sum(l_quantity) AS weight FROM lineitem GROUP BY 1")
def _(s, d):
    return dedup.salted_sum(items(s, d), "key", "weight")


@query("histogram_priority", "SELECT l_partkey AS key, count(*) AS count, round(count(*) / (SELECT count(*) FROM lineitem), 12) AS priority FROM lineitem GROUP BY 1")
def _(s, d):
    return dedup.priorities(items(s, d)).withColumn("priority", F.round("priority", 12))


@query("histogram_topk", "SELECT l_partkey AS key, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def _(s, d):
    return dedup.top(items(s, d), 25)


# --- narrow types


INT8 = "(SELECT key, v, list_max([abs(x) FOR x IN v]) / 127 AS s FROM {T})".replace("{T}", T)
QINT8 = f"(SELECT key, s, CASE WHEN s = 0 THEN [0 FOR x IN v] ELSE [CAST(greatest(-127, least(127, round(x / s))) AS INTEGER) FOR x IN v] END AS q FROM {INT8})"
UINT8 = f"(SELECT key, v, (list_max(v) - list_min(v)) / 255 AS s, list_min(v) AS o FROM {T})"
QUINT8 = f"(SELECT key, s, o, CASE WHEN s = 0 THEN [0 FOR x IN v] ELSE [CAST(greatest(0, least(255, round((x - o) / s))) AS INTEGER) FOR x IN v] END AS q FROM {UINT8})"
CODES = "CAST(list_sum(q) AS BIGINT) AS q_sum, CAST(q[1] AS INTEGER) AS q0, CAST(q[64] AS INTEGER) AS q63"


def codes(row: str) -> list[Column]:
    q = F.col(row)["q"]
    return [F.aggregate(q, F.lit(0).cast("long"), lambda t, x: t + x).alias("q_sum"), q[0].cast("int").alias("q0"), q[63].cast("int").alias("q63")]


@query("quant_int8_symmetric", f"SELECT key, round(s, 9) AS scale, {CODES} FROM {QINT8}")
def _(s, d):
    return embeddings(s, d).df.withColumn("r", vectors.quantize_int8(F.col("vec"))).select("key", F.round("r.scale", 9).alias("scale"), *codes("r"))


@query("quant_uint8_affine", f'SELECT key, round(s, 9) AS scale, round(o, 9) AS "offset", {CODES} FROM {QUINT8}')
def _(s, d):
    return embeddings(s, d).df.withColumn("r", vectors.quantize_uint8(F.col("vec"))).select("key", F.round("r.scale", 9).alias("scale"), F.round("r.offset", 9).alias("offset"), *codes("r"))


@query("dequant_int8", f"SELECT key, {dig()} FROM (SELECT key, [x * s FOR x IN q] AS v FROM {QINT8})")
def _(s, d):
    return embeddings(s, d).df.withColumn("r", vectors.quantize_int8(F.col("vec"))).select("key", *digest(vectors.dequantize(F.col("r"), False)))


@query("dequant_uint8", f"SELECT key, {dig()} FROM (SELECT key, [x * s + o FOR x IN q] AS v FROM {QUINT8})")
def _(s, d):
    return embeddings(s, d).df.withColumn("r", vectors.quantize_uint8(F.col("vec"))).select("key", *digest(vectors.dequantize(F.col("r"), True)))


@query("pool_quant_sum", f"SELECT bag, {agg()} FROM {ITEMS} e JOIN (SELECT key, [x * s + o FOR x IN q] AS v FROM {QUINT8}) t ON e.key = t.key GROUP BY 1")
def _(s, d):
    t = embeddings(s, d).df.withColumn("r", vectors.quantize_uint8(F.col("vec"))).withColumn("vec", vectors.dequantize(F.col("r"), True)).drop("r")
    return pooling.pool(Table.of(t, "key", "vec", DIM).find(items(s, d)).filter("hit"), "sum", DIM).select("bag", *digest())


@query("codec_float16_decode", "SELECT b AS bits, (b >> 10) & 31 = 31 AND b & 1023 <> 0 AS is_nan, CASE WHEN (b >> 10) & 31 = 0 THEN (b & 1023) * pow(2.0, -24) ELSE (1 + (b & 1023) / 1024.0) * pow(2.0, ((b >> 10) & 31) - 15) END * CASE WHEN b >= 32768 THEN -1 ELSE 1 END AS value FROM range(0, 65536) r(b) ".replace("CASE WHEN (b >> 10) & 31 = 0", "CASE WHEN (b >> 10) & 31 = 31 THEN CASE WHEN b & 1023 = 0 THEN CAST('inf' AS DOUBLE) END WHEN (b >> 10) & 31 = 0"))
def _(s, d):
    value = vectors.decode_float16(F.col("bits"))
    return s.range(65536).select(F.col("id").alias("bits")).select("bits", F.when(~F.isnan(value), value).alias("value"), F.isnan(value).alias("is_nan"))


# --- eviction and the set-associative cache


def _metas(s: SparkSession, d: str, meta: Column) -> DataFrame:
    return events(s, d).groupBy("key").agg(meta.cast("long").alias("meta"))


def evicted(meta: str, order: str, out: str = "meta") -> str:
    return f"WITH m AS (SELECT user_id AS key, {meta} AS meta FROM events GROUP BY 1), r AS (SELECT *, count(*) OVER (PARTITION BY key % 2) AS n, row_number() OVER (PARTITION BY key % 2 ORDER BY {order}, key) AS rn FROM m) SELECT key, CASE WHEN n > 5 THEN {out} ELSE meta END AS meta FROM r WHERE n <= 5 OR rn <= 4"


@query("evict_lru", evicted("max(event_id)", "meta DESC"))
def _(s, d):
    return evict(_metas(s, d, F.max("pos")), 5, 0.8, "lru", 2).select("key", "meta")


@query("evict_lfu", evicted("count(*)", "meta DESC", "meta >> 1"))
def _(s, d):
    return evict(_metas(s, d, F.count("*")), 5, 0.8, "lfu", 2).select("key", "meta")


@query("evict_lfu_store", evicted("count(*)", "meta DESC, key DESC", "meta - (meta >> 1)"))
def _(s, d):
    return evict(_metas(s, d, F.count("*")), 5, 0.8, "lfu_store", 2).select("key", "meta")


@query("evict_hash_random", evicted("count(*)", "(key * 2654435761) % 4294967296"))
def _(s, d):
    return evict(_metas(s, d, F.count("*")), 5, 0.8, "random", 2).select("key", "meta")


@query("cache_set_index", "SELECT l_partkey AS key, l_partkey % 61 AS set, l_partkey // 61 AS tag FROM lineitem")
def _(s, d):
    return items(s, d).select("key", setcache.set_of(F.col("key"), 61).alias("set"), setcache.tag_of(F.col("key"), 61).alias("tag"))


def _cache(s: SparkSession, d: str, sets: int = 4) -> DataFrame:
    """Sets of 8 ways; way w of set s holds key 4 w + s, but every third way is free."""
    key = F.col("way") * 4 + F.col("set")
    return setcache.empty(s, sets).withColumn("key", F.when(F.col("way") % 3 != 0, key)).withColumn("counter", F.when(F.col("way") % 3 != 0, F.col("way") / 64.0).otherwise(0.0))


CACHE = "(SELECT set, way, CASE WHEN way % 3 <> 0 THEN way * 4 + set END AS key, CASE WHEN way % 3 <> 0 THEN way / 64.0 ELSE 0.0 END AS counter FROM range(0, 4) a(set), range(0, 8) b(way))"


@query(
    "cache_device_insert",
    f"""WITH c AS (SELECT user_id AS key, round(count(*) / 512.0, 9) AS priority FROM events GROUP BY 1),
    g AS (SELECT s.set, way, s.key, counter + coalesce(priority, 0) AS counter FROM {CACHE} s LEFT JOIN c ON s.key = c.key),
    b AS (SELECT key % 4 AS set, key, priority, row_number() OVER (PARTITION BY key % 4 ORDER BY priority DESC, key) AS rn FROM c WHERE key NOT IN (SELECT key FROM {CACHE} WHERE key IS NOT NULL)),
    w AS (SELECT *, row_number() OVER (PARTITION BY set ORDER BY CASE WHEN key IS NULL THEN -1 ELSE counter END, way) AS rn FROM g)
    SELECT w.set, way, CASE WHEN b.key IS NOT NULL AND (w.key IS NULL OR priority > counter) THEN b.key ELSE w.key END AS key,
    round(CASE WHEN b.key IS NOT NULL AND (w.key IS NULL OR priority > counter) THEN priority ELSE counter END, 6) AS counter FROM w LEFT JOIN b ON w.set = b.set AND w.rn = b.rn""",
)
def _(s, d):
    cand = dedup.unique_counts(events(s, d)).select("key", F.round(F.col("count") / 512.0, 9).alias("priority"))
    return setcache.insert(_cache(s, d), cand, 4).withColumn("counter", F.round("counter", 6))


@query("cache_host_insert", ORACLES["cache_device_insert"].replace("512.0", "64.0").replace("priority > counter", "priority >= counter"))
def _(s, d):
    cand = dedup.unique_counts(events(s, d)).select("key", F.round(F.col("count") / 64.0, 9).alias("priority"))
    return setcache.insert(_cache(s, d), cand, 4, ties=True).withColumn("counter", F.round("counter", 6))


@query("cache_decay", f"SELECT set, way, round(CASE WHEN set IN (SELECT user_id % 2048 FROM events) THEN counter * pow(0.95, 3) ELSE counter END, 9) AS counter FROM {CACHE}".replace("range(0, 4)", "range(0, 2048)"))
def _(s, d):
    touched = events(s, d).select(setcache.set_of(F.col("key"), 2048).alias("set"))
    return setcache.decay(_cache(s, d, 2048).withColumn("ts", F.lit(0)), touched, 3).select("set", "way", F.round("counter", 9).alias("counter"))


@query("cache_invalidate", f"SELECT set, way, CASE WHEN key IN (SELECT user_id * 3 FROM events) THEN NULL ELSE key END AS key FROM {CACHE}")
def _(s, d):
    return setcache.invalidate(_cache(s, d), events(s, d, 3)).select("set", "way", "key")


@query("cache_resident", f"SELECT key FROM {CACHE} WHERE key IS NOT NULL")
def _(s, d):
    return setcache.resident(_cache(s, d))


@query("cache_misses", f"SELECT count(*) AS requests, count_if(user_id NOT IN (SELECT key FROM {CACHE} WHERE key IS NOT NULL)) AS misses FROM events")
def _(s, d):
    return setcache.misses(_cache(s, d), events(s, d))


# --- partitioners


def wrap(x: str, m: int) -> str:
    return f"CAST((CAST({x} AS UHUGEINT) * {m}) % 18446744073709551616 AS UBIGINT)"


def _murmur_sql() -> str:
    x, steps = "key", []
    for m in keys.MURMUR:
        steps.append(wrap("xor(x, x >> 33)", m))
    q = "(SELECT DISTINCT l_partkey AS key, CAST(l_partkey AS UBIGINT) AS x FROM lineitem)"
    for step in steps:
        q = f"(SELECT {x}, {step} AS x FROM {q})"
    return f"SELECT key, CAST(xor(x, x >> 33) & 63 AS BIGINT) AS part FROM {q}"


def _fnv_sql() -> str:
    q = f"(SELECT DISTINCT l_partkey AS key, CAST(l_partkey AS UBIGINT) AS k, CAST({keys.FNV_OFFSET} AS UBIGINT) AS x FROM lineitem)"
    for shift in range(0, 64, 8):
        q = f"(SELECT key, k, {wrap(f'xor(x, (k >> {shift}) & 255)', keys.FNV_PRIME)} AS x FROM {q})"
    return f"SELECT key, CAST(x & 63 AS BIGINT) AS part FROM {q}"


@query("partition_murmur3", _murmur_sql())
def _(s, d):
    return items(s, d).select("key").distinct().select("key", keys.partition_hash(F.col("key"), 64, "murmur3").alias("part"))


@query("partition_fnv", _fnv_sql())
def _(s, d):
    return items(s, d).select("key").distinct().select("key", keys.partition_hash(F.col("key"), 64).alias("part"))


def _rrx_sql() -> str:
    turn = lambda n: f"((x >> {n}) | {wrap('x', 1 << (64 - n))})"
    q = "(SELECT DISTINCT l_partkey AS key, CAST(l_partkey AS UBIGINT) AS x FROM lineitem)"
    for (a, b), m in zip(((25, 50), (24, 49)), keys.RRX, strict=True):
        q = f"(SELECT key, {wrap(f'xor(xor(x, {turn(a)}), {turn(b)})', m)} AS x FROM {q})"
    return f"SELECT key, CAST(xor(x, x >> 28) & 63 AS BIGINT) AS part FROM {q}"


@query("partition_rrxmrrxmsx0", _rrx_sql())
def _(s, d):
    return items(s, d).select("key").distinct().select("key", keys.partition_hash(F.col("key"), 64, "rrxmrrxmsx0").alias("part"))


@query("partition_zero", "SELECT DISTINCT l_partkey AS key, CAST(0 AS BIGINT) AS part FROM lineitem")
def _(s, d):
    return items(s, d).select("key").distinct().select("key", keys.partition_zero(F.col("key"), 64).alias("part"))


@query("codec_bfloat16", "SELECT b AS bits, CASE WHEN e = 0 THEN m * pow(2.0, -133) ELSE (1 + m / 128.0) * pow(2.0, e - 127) END * CASE WHEN b >= 32768 THEN -1 ELSE 1 END AS value FROM (SELECT b, (b >> 7) & 255 AS e, b & 127 AS m FROM range(0, 65536) r(b)) WHERE e BETWEEN 27 AND 227")
def _(s, d):
    """Values that bfloat16 has pass through it unchanged (exponents of 1e-30 to 1e30)."""
    e, m = F.shiftright("bits", 7).bitwiseAND(255), F.col("bits").bitwiseAND(127)
    value = (1 + m / 128.0) * F.pow(F.lit(2.0), e - 127) * F.when(F.col("bits") >= 32768, -1.0).otherwise(1.0)
    held = s.range(65536).select(F.col("id").alias("bits")).filter(e.between(27, 227)).withColumn("value", value)
    return held.select("bits", vectors.through(F.array("value"), "bfloat16")[0].cast("double").alias("value"))


@query("partition_identity", "SELECT DISTINCT l_partkey AS key, l_partkey & 63 AS part FROM lineitem")
def _(s, d):
    return items(s, d).select("key").distinct().select("key", keys.partition_identity(F.col("key"), 64).alias("part"))


# --- hit-rate windows and streams


@query("heuristic_window_stats", f"WITH h AS (SELECT pos // 64 AS step, avg(CASE WHEN key * 5 IN (SELECT vec_id FROM embeddings) THEN 1.0 ELSE 0.0 END) AS rate FROM {EVENTS} GROUP BY 1), w AS (SELECT step, sum(rate) OVER (ORDER BY step ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) / 14 AS p FROM h) SELECT step, round(p, 9) AS mean, round(p * (1 - p) / 64, 9) AS variance FROM w")
def _(s, d):
    from pyspark.sql import Window

    found = embeddings(s, d).find(events(s, d, 5))
    rates = found.groupBy(F.floor(F.col("pos") / 64).alias("step")).agg(F.avg(F.col("hit").cast("double")).alias("rate"))
    mean = F.sum("rate").over(Window.orderBy("step").rowsBetween(-13, 0)) / 14  # a row per batch of lookups
    return rates.withColumn("p", mean).select("step", F.round("p", 9).alias("mean"), F.round(F.col("p") * (1 - F.col("p")) / 64, 9).alias("variance"))


@query("stream_lookup", f"SELECT pos, e.key, t.key IS NOT NULL AS hit FROM (SELECT pos, key * 5 AS key FROM {EVENTS}) e LEFT JOIN {T} t ON e.key = t.key")
def _(s, d):
    """The events as a stream, looked up against the table, until all that is there is done."""
    from vecforge.streaming.stream import lookup_stream

    base = s.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.gettempdir()
    at = os.path.join(base, f"stream-{uuid.uuid4().hex}")
    schema = read(s, d, "events").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d) if "events.parquet" in _names(s, d) else s.readStream.schema(schema).parquet(f"{d}/events.parquet")
    found = lookup_stream(stream.select(F.col("event_id").alias("pos"), (F.col("user_id") * 5).alias("key")), embeddings(s, d)).select("pos", "key", "hit")
    found.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/rows").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(found.schema).parquet(f"{at}/rows")


def _names(s: SparkSession, d: str) -> list[str]:
    """Plain files of a folder, by the session's file system."""
    path = s.sparkContext._jvm.org.apache.hadoop.fs.Path(d)
    return [f.getPath().getName() for f in path.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).listStatus(path) if f.isFile()]
