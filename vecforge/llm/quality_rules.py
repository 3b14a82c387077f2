"""Quality rules: simple text statistics, and a hashed n-gram log-likelihood ratio between a trusted
target and the raw corpus. DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecforge.llm.common import SPACE, SPACE_CHARS, WORD

#: Hash buckets of the two multinomials; the fitted table has this many rows at any corpus size.
BUCKETS = 1 << 18
#: The target is counted over at most this many labelled documents (those with the smallest hashed ids).
MAX_TRUSTED = 1 << 16
#: Counts that each bucket gets beforehand on both sides; rare buckets stay near a ratio of 1.
PRIOR = 5.0
#: Decimals of a bucket's log ratio; the table is part of the plan, so its length counts.
DECIMALS = 3
#: Mean log ratio per n-gram under which a document goes.
THRESHOLD = -0.1
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def bound(value: Column, body) -> Column:
    """``body(value)`` with value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(windows: Column) -> Column:
    """Words covered by 5-word windows that occur more than once, from the windows' hashes in order.

    Sorting (hash, place) puts equal windows side by side; the covered words are then the sum over the
    places in order of the distance to the next one, 5 at most. Windows are compared by 64-bit hashes
    within one text.
    """

    def places(s: Column) -> Column:
        pairs = F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))

    def covered(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(b - a, F.lit(5)))
        return F.aggregate(steps, F.lit(0), lambda t, x: t + x)

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = bound(bound(ordered, places), covered)
    return F.when(F.size(windows) == F.size(F.array_distinct(windows)), F.lit(0)).otherwise(some).cast("long")


def base(text: Column, words: Column) -> Column:
    """A struct of the base columns of a text (not null) with these words."""
    n = F.size(words)
    windows = F.when(n >= 5, F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice(words, i, 5)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bound(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        bound(windows, repeat_words).alias("n_repeat_words"),
    )


def grams(words: Column, buckets: int) -> Column:
    """Buckets of a text's n-grams: each word and each two neighbours."""
    modulus = F.lit(buckets).cast("long")
    one = F.transform(words, lambda a: F.pmod(F.xxhash64(a), modulus).cast("int"))
    most = F.greatest(F.size(words) - 1, F.lit(0))
    two = F.transform(F.arrays_zip(F.slice(words, 1, most).alias("a"), F.slice(words, 2, most).alias("b")), lambda p: F.pmod(F.xxhash64(p["a"], p["b"]), modulus).cast("int"))
    return F.concat(one, two)


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED, prior: float = PRIOR) -> list[float]:
    """The log ratio of each bucket, to DECIMALS decimals.

    One pass over all documents counts the n-grams of the corpus and, among them, those of the trusted
    target: documents that the labels rate 1 in quality. Counts are summed map-side, so each task sends
    one row per bucket at most. The ratios are computed in Spark and come to the driver as one string of
    ``buckets`` numbers. The target's ids are at most ``max_trusted`` longs, which is what bounds their
    broadcast. Without any trusted document every ratio is 0.
    """
    trusted = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(max_trusted).withColumn("__trusted", F.lit(1))
    counted = (
        docs.select("doc_id", words_of(F.col("text")).alias("__words"))
        .join(F.broadcast(trusted), F.col("doc_id") == F.col("__id"), "left")
        .select(F.explode(grams(F.col("__words"), buckets)).alias("bucket"), F.coalesce("__trusted", F.lit(0)).cast("long").alias("t"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    )
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counted, "bucket", "left")
    table = every.agg(F.sum("raw").alias("raws"), F.sum("target").alias("targets"), F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")))).alias("rows"))
    ratio = lambda r: F.ln((r["target"] + F.lit(prior)) / (r["raw"] * (F.col("targets") / F.col("raws")) + F.lit(prior)))
    text = table.select(F.when(F.col("targets") > 0, F.array_join(F.transform("rows", lambda r: F.round(ratio(r), DECIMALS).cast("string")), ",")).alias("text")).first()["text"]
    return list(map(float, text.split(","))) if text else [0.0] * buckets


def judge(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the base columns, llr (mean log ratio per n-gram; 0 without any) and kept.

    All of it is one expression that binds the words, so that no rewrite (a filter pushed below, a
    projection merged) repeats the splitting for each word.
    """
    table = F.split(F.lit(",".join(f"{x:g}" for x in ratios)), ",").cast("array<double>")
    total = lambda g: F.aggregate(g, F.lit(0.0), lambda t, b: t + F.get(table, b)) / F.greatest(F.size(g), F.lit(1))
    text = F.coalesce(F.col("text"), F.lit(""))

    def verdict(x: Column) -> Column:
        failed = (x["b"]["n_words"] < MIN_WORDS) | (100 * x["b"]["n_repeat_words"] > MAX_REPEAT_PERCENT * x["b"]["n_words"])
        return F.struct(*[x["b"][c].alias(c) for c in BASE], failed.alias("base_failed"), x["llr"].alias("llr"), (~failed & (x["llr"] >= F.lit(threshold))).alias("kept"))

    judged = bound(words_of(F.col("text")), lambda w: bound(F.struct(base(text, w).alias("b"), bound(grams(w, len(ratios)), total).alias("llr")), verdict))
    names = [*BASE, "base_failed", "llr", "kept"]
    return docs.withColumn("__verdict", judged).select(*[F.col(f"`{c}`") for c in docs.columns if c not in names], *[F.col("__verdict")[c].alias(c) for c in names])


def quality_rules(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    A null text has no words and fails the base rules, as an empty one does. Repeated rows are each
    judged and counted; rows without a doc_id are never trusted. An empty table gives an empty one.
    Columns of these names that ``docs`` already has are replaced. Nothing but bucket counts is shuffled.
    """
    threshold = params.pop("threshold", THRESHOLD)
    return judge(docs, fit(docs, labels, **params), threshold)
