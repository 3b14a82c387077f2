"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecforge.llm.common import Vocabulary, pieces, prepare

#: Hash buckets of the shared weights.
BUCKETS = 1 << 20
#: The regression is fitted on at most so many labelled documents, those with the smallest hashed ids.
MAX_LABELLED = 12_000
#: Entries of the fitted sample that are worked on at once.
RUN = 1 << 20
#: Grades run from 0 to GRADES - 1.
GRADES = 3
#: A document is kept if it has at least grade KEEP_GRADE with this probability.
KEEP_GRADE, KEEP_PROBABILITY = 2, 0.5
_ENDS = b".,;:!?\"'()#*$%&|"


def word_features(word: bytes) -> tuple[bytes, ...]:
    """What a word counts as: itself in lower case without signs, its beginnings, and its last signs."""
    core = word.strip(_ENDS).lower()
    tail = word[-2:]
    return b"w" + core, b"4" + core[:4], b"6" + core[:6], b"s" + (tail if not tail[-1:].isalnum() and tail[-1] < 128 else b"") + (b"U" if word.isupper() and len(core) > 3 else b"")


class Hasher:
    """Distinct feature buckets of texts; each text's own features, present or not."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        known = Vocabulary()
        ids = [np.array([known[w] for w in t.split()], np.int64) for t in texts]
        features = Vocabulary()
        pairs = np.array([[features[f] for f in word_features(w)] for w in known.words], np.int64).reshape(-1, 4)
        again = features[b"again"]
        bucket = (features.hashes() % np.uint64(self.buckets)).astype(np.int64)
        out = []
        for x in ids:
            own = np.unique(x)
            found = bucket[pairs[own].ravel()]
            if len(x) > 9 and (x[1:] == x[:-1]).mean() > 0.2:
                found = np.append(found, bucket[again])
            out.append(np.unique(found))
        return out


@dataclass
class Ordinal:
    """P(grade <= k) = sigmoid(thresholds[k] - z), z the sum of the weights of the features present."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, z: np.ndarray) -> np.ndarray:
        """(rows, grades - 1): the probability of at least grade 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -50, 50)))

    def score(self, features: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[f].sum() for f in features])


def fit(features: list[np.ndarray], grades: np.ndarray, n_grades: int = GRADES, buckets: int = BUCKETS, rounds: int = 200, rate: float = 0.2, noise: float = 1.2, decay: float = 2e-5) -> Ordinal:
    """Maximum likelihood by full-batch adaptive steps, in two passes; deterministic.

    The first pass has an L1 penalty: for each feature ``noise`` times the standard error that its
    gradient would have by chance, so words that say nothing get weight 0 however common they are.
    The second pass refits the features that are left, with a slight L2 penalty only. Features of one document
    are out. Thresholds are a first one and positive gaps, so they stay in order. Without rows, or with
    one grade only, the model is flat: tail probabilities say the grades' shares.
    """
    n = len(features)
    shares = np.array([(grades > k).mean() if n else 0.5 for k in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    shares = np.minimum.accumulate(shares - np.arange(n_grades - 1) * 1e-4)
    thresholds = -np.log(shares / (1 - shares))
    model = Ordinal(np.zeros(buckets), thresholds)
    if not n or len(set(grades.tolist())) < 2:
        return model
    at, row = np.concatenate(features).astype(np.int32, copy=False), np.repeat(np.arange(n, dtype=np.int32), [len(f) for f in features])
    times = sum(np.bincount(at[c], minlength=buckets) for c in _runs(at))
    names = np.flatnonzero(times)
    seen, place = times[names], np.zeros(buckets, np.int32)
    place[names] = np.arange(len(names))
    at = np.concatenate([place[at[c]] for c in _runs(at)])
    y = grades.astype(np.int64)
    left = seen > 1
    for penalty, shrink in ((noise * np.sqrt(seen) / n, 0.0), (np.zeros(len(names)), decay)):
        use = np.concatenate([left[at[c]] for c in _runs(at)])
        at, row = at[use], row[use]
        w, thresholds = _climb(at, row, y, model.thresholds, len(names), rounds, rate, penalty, shrink)
        left = w != 0
    model.weights[names] = w
    model.thresholds = thresholds
    return model


def _runs(values: np.ndarray) -> list[slice]:
    """Slices of RUN entries: what is computed from narrow numbers is widened a slice at a time."""
    return [slice(i, i + RUN) for i in range(0, max(len(values), 1), RUN)]


def _climb(at: np.ndarray, row: np.ndarray, y: np.ndarray, start: np.ndarray, size: int, rounds: int, rate: float, penalty: np.ndarray, shrink: float) -> tuple[np.ndarray, np.ndarray]:
    n, last = len(y), len(start) - 1
    w, base, gaps = np.zeros(size), float(start[0]), np.log(np.maximum(np.diff(start), 1e-3))
    sums = [np.full(size, 1e-8), 1e-8, np.full(last, 1e-8)]
    for _ in range(rounds):
        th = np.concatenate([[base], base + np.cumsum(np.exp(gaps))])
        z = sum(np.bincount(row[c], w[at[c]], n) for c in _runs(at))
        below = 1 / (1 + np.exp(np.clip(z[:, None] - th[None, :], -50, 50)))  # P(grade <= k)
        cdf = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], 1)
        dense = np.concatenate([np.zeros((n, 1)), below * (1 - below), np.zeros((n, 1))], 1)
        pick = lambda a, k: np.take_along_axis(a, k[:, None], 1)[:, 0]
        p = np.maximum(pick(cdf, y + 1) - pick(cdf, y), 1e-12)
        hi, lo = pick(dense, y + 1) / p, pick(dense, y) / p
        g_th = np.array([(hi * (y == k)).sum() - (lo * (y == k + 1)).sum() for k in range(last + 1)]) / n
        pull = lo - hi
        g_w = sum(np.bincount(at[c], pull[row[c]], size) for c in _runs(at)) / n - shrink * w
        g_base, g_gaps = g_th.sum(), np.array([g_th[k + 1 :].sum() for k in range(last)]) * np.exp(gaps)
        sums = [s + g * g for s, g in zip(sums, (g_w, g_base, g_gaps), strict=True)]
        step = rate / np.sqrt(sums[0])
        w += step * g_w
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        base += rate * g_base / np.sqrt(sums[1])
        gaps += rate * g_gaps / np.sqrt(sums[2])
    return w, np.concatenate([[base], base + np.cumsum(np.exp(gaps))])


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        out = []
        for _, texts in pieces(batch.column("text")):
            out += [f.tolist() for f in hasher(texts)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "grade", "features"])


def train(docs: DataFrame, graded: DataFrame, spark: SparkSession, max_labelled: int = MAX_LABELLED) -> Ordinal:
    """Fit on documents that ``graded`` (doc_id, grade) rates; the sample is bounded and deterministic.

    At most ``max_labelled`` ids are broadcast, and as many rows of distinct feature numbers come to the
    driver: of rows that share an id, the text of smallest hash counts. Of several grades of an id, the
    lowest counts. Rows without id, grade or document are left out.
    """
    prepare(spark)
    some = graded.filter("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.min("grade").cast("int").alias("grade")).orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    rated = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("__id"))
    one = rated.groupBy("doc_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = one.mapInArrow(_hash_rows, "doc_id long, grade int, features array<int>").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    rated_as, lists = rows.column("grade").to_numpy()[order], rows.column("features").combine_chunks()
    del rows
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    return fit([values[offsets[i] : offsets[i + 1]] for i in order], rated_as)


def _score(model: Ordinal):
    used, buckets = np.flatnonzero(model.weights), len(model.weights)
    weights, thresholds = model.weights[used], model.thresholds  # few weights are not 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hasher = Ordinal(np.zeros(buckets), thresholds), Hasher(buckets)
        own.weights[used] = weights
        for batch in batches:
            z = [own.score(hasher(texts)) for _, texts in pieces(batch.column("text"))]
            tails = own.tails(np.concatenate(z) if z else np.zeros(0))
            tail = tails[:, KEEP_GRADE - 1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tails.sum(1)), pa.array(tail), pa.array(tail >= KEEP_PROBABILITY)], ["doc_id", "expected_grade", "tail_probability", "kept"])

    return run


def classify(docs: DataFrame, model: Ordinal, spark: SparkSession) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept) of every row of ``docs``.

    expected_grade is the sum of the tail probabilities, tail_probability that of at least KEEP_GRADE.
    A null or empty text has no features, so the thresholds alone judge it; repeated rows get equal
    values; extra columns are ignored; an empty table gives an empty one. Nothing is shuffled.
    """
    prepare(spark)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(model), "doc_id long, expected_grade double, tail_probability double, kept boolean")


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 for toxic documents, 1 for poor ones, 2 for good ones; null where a rating is.

    Toxic words may be many in one text, so they take the open end of the scale.
    """
    quality, toxic = F.col("quality").cast("int"), F.col("toxic").cast("int")
    return labels.select("doc_id", F.when(toxic == 1, 0).when(toxic == 0, quality + 1).alias("grade"))
