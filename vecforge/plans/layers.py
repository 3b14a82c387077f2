"""Layers: what users query. A layer is an ordered list of tables and how lookups and changes reach them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame

from vecforge.operators import lookup, pooling
from vecforge.operators.table import Table


class EmbeddingLayer:
    """Tiered lookup: the first table that has a key answers; changes go to one table or to all.

    Requests are (pos, key[, bag, weight]). Misses get ``default`` before pooling, so they count in a mean.
    """

    def __init__(self, tables: Sequence[Table], default: Column | None = None):
        if not tables or len({t.dim for t in tables}) != 1:
            raise ValueError("a layer needs tables of one row size")
        self.tables, self.default = list(tables), default
        self.dim = tables[0].dim

    def find(self, requests: DataFrame) -> DataFrame:
        found = lookup.cascade(self.tables, requests)
        return found if self.default is None else lookup.fill_default(found, self.default)

    def lookup(self, requests: DataFrame, mode: str = "concat", bags: DataFrame | None = None, offsets: DataFrame | None = None) -> DataFrame:
        """Pooled rows of requests (pos, key, bag[, weight]); with ``offsets`` (bag, off_start, off_end) the bags come from pos.

        Offsets are checked against the number of requests, and empty bags get the zero row.
        """
        pooling.check(mode, "weight" in requests.columns)
        if offsets is not None:
            pooling.check_offsets(offsets, requests.count())
            requests, bags = requests.drop("bag").join(pooling.csr_bags(offsets), "pos"), offsets.select("bag") if bags is None else bags
        return pooling.pool(self.find(requests), mode, self.dim, bags)

    def hit_rates(self, requests: DataFrame) -> DataFrame:
        return lookup.hit_rates(lookup.cascade(self.tables, requests), len(self.tables))

    def _on(self, table_id: int, verb: str, *args, **kwargs) -> EmbeddingLayer:
        if table_id >= len(self.tables):
            raise ValueError(f"no table {table_id}")
        out = type(self).__new__(type(self))
        out.__dict__.update(self.__dict__)
        out.tables = [getattr(t, verb)(*args, **kwargs) if table_id in (-1, i) or table_id < 0 else t for i, t in enumerate(self.tables)]
        return out

    def insert(self, rows: DataFrame, table_id: int = -1, **options) -> EmbeddingLayer:
        return self._on(table_id, "insert", rows, **options)

    def update(self, rows: DataFrame, table_id: int = -1) -> EmbeddingLayer:
        return self._on(table_id, "update", rows)

    def accumulate(self, rows: DataFrame, table_id: int = -1) -> EmbeddingLayer:
        return self._on(table_id, "accumulate", rows)

    def erase(self, keys: DataFrame, table_id: int = -1) -> EmbeddingLayer:
        return self._on(table_id, "erase", keys)

    def clear(self) -> EmbeddingLayer:
        return self._on(-1, "clear")

    def get_num_tables(self) -> int:
        return len(self.tables)


class HostLayer(EmbeddingLayer):
    """One table."""

    def __init__(self, table: Table, default: Column | None = None):
        super().__init__([table], default)


class DenseLayer(HostLayer):
    """One table with the keys 0 .. rows - 1; inserts, erases and clears do nothing, keys out of range are ignored or defaulted."""

    def __init__(self, table: Table, rows: int, default_row: int = -1, default: Column | None = None):
        super().__init__(table, default)
        self.rows, self.default_row = rows, default_row

    def find(self, requests: DataFrame) -> DataFrame:
        found = lookup.lookup_dense(self.tables[0], self.rows, requests, self.default_row)
        return found if self.default is None else lookup.fill_default(found, self.default)

    def insert(self, rows: DataFrame, table_id: int = -1, **options) -> DenseLayer:
        return self

    def erase(self, keys: DataFrame, table_id: int = -1) -> DenseLayer:
        return self

    def clear(self) -> DenseLayer:
        return self


class CachedLayer(EmbeddingLayer):
    """A cache over a backing table: updates reach both, inserts and erases the cache only."""

    def __init__(self, cache: Table, backing: Table, default: Column | None = None, write_through: bool = True):
        super().__init__([cache, backing], default)
        self.write_through = write_through

    def insert(self, rows: DataFrame, table_id: int = 0, **options) -> EmbeddingLayer:
        return self._on(0, "insert", rows, **{"on_existing": "keep"} | options)

    def update(self, rows: DataFrame, table_id: int = -1) -> EmbeddingLayer:
        return self._on(-1 if self.write_through else 0, "update", rows)

    def accumulate(self, rows: DataFrame, table_id: int = -1) -> EmbeddingLayer:
        return self._on(-1 if self.write_through else 0, "accumulate", rows)

    def erase(self, keys: DataFrame, table_id: int = 0) -> EmbeddingLayer:
        return self._on(0, "erase", keys)

    def clear(self) -> EmbeddingLayer:
        return self._on(0, "clear")

    def promote(self, keys: DataFrame) -> EmbeddingLayer:
        """Insert keys into the cache with the backing table's rows."""
        rows = keys.select("pos", "key").join(self.tables[1].df.select("key", "vec"), "key")
        return self.insert(rows)


def sgd(table: Table, rows: DataFrame, gradients: DataFrame, mode: str, rate: float) -> Table:
    """One descent step on the resident keys of pooled rows."""
    from pyspark.sql import functions as F

    step = pooling.backward(rows, gradients, mode, table.dim)
    return replace(table).accumulate(step.select("key", F.transform("vec", lambda x: x * F.lit(-rate)).alias("vec")))
