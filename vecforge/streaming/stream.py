"""Continuous request streams: lookups against a table, and automatic inserts of what they miss."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecforge.operators.lookup import fill_default
from vecforge.operators.table import Table


def lookup_stream(requests: DataFrame, table: Table, default=None) -> DataFrame:
    """A stream-static left join: each micro-batch sees the table's version at the start of the query."""
    found = table.find(requests)
    return fill_default(found, default) if default is not None else found


def windowed_hits(found: DataFrame, time: str = "ts", every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests and hits per event-time window, with a watermark for late ones."""
    return found.withWatermark(time, late).groupBy(F.window(time, every)).agg(F.count("*").alias("requests"), F.count_if("hit").alias("hits"))


class AutoInsert:
    """Inserts of missed keys across micro-batches, for ``writeStream.foreachBatch``.

    ``table`` is the current version, ``backing`` the table that has the rows. After a batch that the
    heuristic picks, the batch's keys are collected (as a plan) until there are ``min_insert``; then the best
    ``max_insert`` by frequency that the backing table has, and the table doesn't, are inserted. Batches that were handled already
    are skipped, so a retried batch inserts once. ``save`` writes a version and returns it reread, which cuts its lineage.
    """

    def __init__(self, table: Table, backing: Table, heuristic, min_insert: int = 0, max_insert: int = 1 << 20, save: Callable[[Table, int], Table] | None = None):
        self.table, self.backing, self.heuristic, self.min_insert, self.max_insert, self.save = table, backing, heuristic, min_insert, max_insert, save
        self.done, self.waiting, self.held, self.rates = -1, None, 0, []

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.done:
            return
        n, hits = self.table.find(batch.select("key")).agg(F.count("*"), F.count_if("hit")).first()
        rate = hits / n if n else 1.0
        self.rates.append(rate)
        if n and (self.waiting is not None or self.heuristic.insert_needed(rate, 0)):
            counts = batch.groupBy("key").agg(F.count("*").alias("n"))
            self.waiting = counts if self.waiting is None else self.waiting.unionByName(counts).groupBy("key").agg(F.sum("n").alias("n"))
            self.held += n
            if self.held >= self.min_insert:
                self.flush(batch_id)
        self.done = batch_id

    def flush(self, batch_id: int = 0) -> None:
        """Insert what has been collected; modifying verbs call this first."""
        if self.waiting is None:
            return
        best = self.waiting.join(self.table.df.select("key"), "key", "left_anti").join(self.backing.df.select("key", "vec"), "key").orderBy(F.desc("n"), "key").limit(self.max_insert)
        new = self.table.insert(best.select(F.col("n").alias("pos"), "key", "vec"), on_existing="keep")
        self.table = self.save(new, batch_id) if self.save else new
        self.waiting, self.held = None, 0
