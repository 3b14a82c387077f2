"""Mixing sources to target weights, by repetition rates and one hash-seeded Bernoulli copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecforge.llm.common import WORD, word_count

#: Default source weights, dealt to the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix takes this share of all words ...
SHARE = 1.5
#: ... and at most so many times a source.
CAP = 2.0
SEED = "mix-1"


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: source, source_size, target.

    ``sized`` has source and size. Weights go to the sources in code-point order, null last, and
    repeat. A target stops at ``cap`` times its source's size; the excess is shared out again by weight
    until no target is above. That fixed point is min(cap * size, level * weight) for one level: with the
    sources ordered by cap * size / weight, those that stop are a prefix, so running sums find it.
    A source without words gets target 0. The table has a row per source, so the windows are small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("fill", "place")
    everything = Window.partitionBy()
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        sized.groupBy("source")
        .agg(F.sum("size").cast("long").alias("source_size"))
        .withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("fill", F.col("most") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("stops", F.col("level") * F.col("weight") >= F.col("most"))
        .withColumn("rest", F.col("budget") - F.sum(F.when(F.col("stops"), F.col("most")).otherwise(0.0)).over(everything))
        .withColumn("open_weight", F.sum(F.when(~F.col("stops"), F.col("weight"))).over(everything))
        .select("source", "source_size", F.when(F.col("stops"), F.col("most")).otherwise(F.col("rest") * F.col("weight") / F.col("open_weight")).alias("target"))
    )


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target and copies (how often the mix takes the document).

    copies is floor(rate) plus a Bernoulli copy with the fraction as its probability, where rate is
    target / source_size. The draw is a hash of seed and doc_id, so reruns, other partitionings and
    repeated rows agree; rows without a doc_id draw by their text. A null text has size 0, and a
    source of size 0 copies nothing. An empty table gives an empty one. Columns of these names that
    ``docs`` already has are replaced.

    Only (source, size) is aggregated, with map-side sums; the per-source table joins back on source,
    which adaptive execution broadcasts if it is small in fact and else splits where a source is hot.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("size", "source_size", "target", "copies", "__source", "__draw")]
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")))))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    sized = docs.select(*kept, word_count(F.col("text")).alias("size"), draw.alias("__draw"))  # so no text need pass the join
    plan = source_targets(sized.select("source", "size"), weights, share, cap).withColumnRenamed("source", "__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (
        sized.join(plan, F.col("source").eqNullSafe(F.col("__source")))
        .drop("__source")
        .withColumn("copies", (F.floor(rate) + (F.col("__draw") < rate - F.floor(rate)).cast("int")).cast("int"))
        .drop("__draw")
    )


def emit(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each row of :func:`mix` as many times as it has copies."""
    return mixed.filter("copies > 0").select(*[F.col(f"`{c}`") for c in columns], F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy")).drop("__copy")


def digest(mixed: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, size, source_size, target, taken."""
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents
), named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST(CASE place % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS DOUBLE) AS weight,
    source_size * CAST({CAP} AS DOUBLE) AS most, sum(source_size) OVER () * CAST({SHARE} AS DOUBLE) AS budget FROM named
), levels AS (
  SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), stopped AS (SELECT *, level * weight >= most AS stops FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN stops THEN most ELSE
    (budget - sum(CASE WHEN stops THEN most ELSE 0 END) OVER ()) * weight / sum(CASE WHEN NOT stops THEN weight END) OVER () END AS target
  FROM stopped
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST(CAST('0x' || substr(md5(concat_ws(':', '{SEED}', CAST(doc_id AS VARCHAR), CASE WHEN doc_id IS NULL THEN md5(coalesce(text, '')) END)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
"""
