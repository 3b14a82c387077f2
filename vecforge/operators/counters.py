"""Running counts of lookups and hits, gathered while the lookups run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vecforge.operators.table import Table


class LookupCounter:
    """Counts the requests and hits of lookups through it.

    Counts are taken along with the lookup's own job, without another pass; :meth:`get` waits for
    lookups that are yet to run.
    """

    def __init__(self, table: Table):
        self.table = table
        self.reset()

    def reset(self) -> None:
        self.seen: list[Observation] = []

    def find(self, requests: DataFrame, resolved: str | None = None) -> DataFrame:
        seen = Observation()
        self.seen.append(seen)
        return self.table.find(requests, resolved).observe(seen, F.count(F.lit(1)).alias("requests"), F.count_if("hit").alias("hits"))

    def get(self) -> tuple[int, int]:
        """(requests, hits) of all lookups since the last reset."""
        counts = [s.get for s in self.seen]
        return sum(c["requests"] for c in counts), sum(c["hits"] for c in counts)
