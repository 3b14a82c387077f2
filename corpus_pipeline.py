"""A training corpus from documents: quality rules, near-duplicate removal, secrets, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecforge.llm import mixing, near_dedup, packing, quality_rules, secret_scan
from vecforge.llm.common import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, their columns as they are.

    The ratio is fitted on ``docs`` and the labels of sf_dir. Null and empty texts go, as texts under
    10 words do; of repeated rows all stay or all go; a null doc_id is never trusted. Columns of docs named
    like the rules' own are kept as docs has them. An empty table gives an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    renamed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", "text")
    return quality_rules.quality_rules(renamed, labels).filter("kept").select("__row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of smallest doc_id.

    Repeated rows are one document; texts that share a doc_id are apart unless similar; null doc_ids come
    last; texts without words are one text. Columns pass as they are. An empty table gives an empty one.
    """
    return near_dedup.drop_near_duplicates(docs, spark)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark, and n_chars of what is left.

    A null text stays null, with null n_chars; equal texts change alike. Other columns pass as they are.
    An empty table gives an empty one.
    """
    others = {c: f"__{c}" for c in docs.columns if c != "text"}  # apart from the scan's own columns
    clean = secret_scan.redact(secret_scan.scan(docs.withColumnsRenamed(others), spark))
    named = clean.withColumnsRenamed({v: k for k, v in others.items()})
    return named.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, or not at all.

    Null sources are one source. Repeated rows draw alike; null doc_ids draw by their text. A source
    without words gives nothing. An empty table gives an empty one.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", "text", "source")
    return mixing.emit(mixing.mix(whole), ["__row"]).select("__row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the bins: bin_id, offset, doc_id, piece, start, length, source.

    Copies that the mix repeats go to different bins, as they are one duplicate cluster. Null texts are
    pieces of length 0. Other columns are ignored. An empty table gives an empty one.
    """
    return packing.pack(docs, spark)


STAGES = [("quality rules", quality), ("near dedup", near_dedup_stage), ("secret scans", secrets), ("mixing", mix), ("packing", pack)]

#: The models and the packing order are beyond SQL; tests/llm/test_pipeline.py holds each stage to a plain-Python version on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are a table in the shared scratch folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            scratch.drop(f"stage-{i - 1}")
    return docs
