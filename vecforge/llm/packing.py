"""Best-fit packing of documents into fixed-size bins under conflicts of source and duplicate cluster."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecforge.llm.common import Scratch, normalised, prepare, word_count

#: Words a bin holds.
CAPACITY = 2048
#: Pieces of one source that a bin takes.
PER_SOURCE = 4
#: Mean number of pieces packed together; more pieces make more groups, not larger ones.
GROUP_ROWS = 8192
#: Bins of one group are numbered from group * STRIDE.
STRIDE = 1 << 24


class Bins:
    """Open bins ordered by (residual, number), each with bitmaps of what it can't take any more."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.open: list[tuple[int, int]] = []
        self.full_sources: list[int] = []  # bit s: the bin has per_source pieces of source s
        self.clusters: list[int] = []  # bit c: the bin has a piece of cluster c
        self.held: list[dict[int, int]] = []

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset): the tightest bin with room that neither bitmap rules out, or a new one."""
        s, c = 1 << source, 1 << cluster
        for at in range(bisect_left(self.open, (length, -1)), len(self.open)):
            room, b = self.open[at]
            if not (self.full_sources[b] & s or self.clusters[b] & c):
                del self.open[at]
                break
        else:
            room, b = self.capacity, len(self.held)
            self.full_sources.append(0)
            self.clusters.append(0)
            self.held.append({})
        self.clusters[b] |= c
        n = self.held[b][source] = self.held[b].get(source, 0) + 1
        if n >= self.per_source:
            self.full_sources[b] |= s
        if room - length > 0:
            insort(self.open, (room - length, b))
        return b, self.capacity - room


def pack_rows(rows: pa.Table, capacity: int, per_source: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing over one group: (row, bin, offset) of each piece in the order they are placed."""
    cols = {c: rows.column(c).to_pylist() for c in ("doc_id", "piece", "length", "source", "cluster", "copy")}
    rank = lambda i: (-cols["length"][i], cols["cluster"][i], cols["doc_id"][i] is None, cols["doc_id"][i] or 0, cols["source"][i] is None, cols["source"][i] or "", cols["copy"][i], cols["piece"][i])
    order = sorted(range(rows.num_rows), key=rank)
    sources: dict[str | None, int] = {}
    clusters: dict[int, int] = {}
    bins = Bins(capacity, per_source)
    put = [bins.place(cols["length"][i], sources.setdefault(cols["source"][i], len(sources)), clusters.setdefault(cols["cluster"][i], len(clusters))) for i in order]
    return order, [b for b, _ in put], [o for _, o in put]


def pack(docs: DataFrame, spark: SparkSession, capacity: int = CAPACITY, per_source: int = PER_SOURCE, group_rows: int = GROUP_ROWS, cluster: Column | None = None, length: Column | None = None) -> DataFrame:
    """(bin_id, offset, doc_id, piece, start, length, source): where each piece of each document lies.

    A document longer than a bin is cut into pieces of ``capacity`` words and a rest; start is the
    piece's first word in its document, offset its first in the bin. A bin takes at most one piece of a
    duplicate cluster (by default: of equal words; pieces of one document count, too) and at most
    ``per_source`` of a source. Bins are packed by best fit, longest piece first, within groups that a
    hash of (cluster, piece, doc_id, source, copy number) deals out evenly; the number of groups follows
    the number of pieces, so no source, cluster or long document makes a group large, and no text is
    shuffled. The bins depend on the rows only, not on their order or partitions.

    A null text is empty; an empty document is one piece of length 0. Null sources are one source.
    Repeated rows are counted first and then packed each. An empty table gives an empty one. Other
    columns are ignored.
    """
    prepare(spark)
    size = word_count(F.col("text")) if length is None else length.cast("long")
    same = F.xxhash64(normalised(F.col("text"))) if cluster is None else cluster.cast("long")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), same.alias("cluster"))
    counted = Scratch(spark, "pack").write(sized.groupBy("doc_id", "source", "size", "cluster").agg(F.count("*").alias("copies")), "sized")
    pieces = F.greatest(F.ceil(F.col("size") / capacity), F.lit(1))
    total = counted.agg(F.sum(F.col("copies") * pieces)).first()[0] or 0
    groups = max(1, -(-total // group_rows))
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).withColumn("piece", F.explode(F.sequence(F.lit(0), (pieces - 1).cast("int"))))
    spread = F.pmod(F.xxhash64("cluster", "piece", "doc_id", "source", "copy"), F.lit(groups)).cast("long")
    dealt = each.select("doc_id", "source", "cluster", "copy", "piece", F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("int").alias("length"), spread.alias("group"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        order, bins, offsets = pack_rows(rows, capacity, per_source)
        rows = rows.take(order)
        base = key[0].as_py() * STRIDE
        starts = [p * capacity for p in rows.column("piece").to_pylist()]
        return pa.table({"bin_id": pa.array([base + b for b in bins], pa.int64()), "offset": pa.array(offsets, pa.int32()), "doc_id": rows.column("doc_id"), "piece": rows.column("piece"), "start": pa.array(starts, pa.int64()), "length": rows.column("length"), "source": rows.column("source")})

    return dealt.groupBy("group").applyInArrow(run, "bin_id long, offset int, doc_id long, piece int, start long, length int, source string")
