"""MinHash near-duplicate detection with dart signatures and a banded join.

Every unit of an element's weight is a region in which darts land by a Poisson process in rank order:
the times between darts come from hashes of the element, the cell of weight and the dart's number, and
so do a dart's height in the cell and its coordinate. A document keeps, for each coordinate, the
earliest dart that lands below the weights of its elements. Two documents agree on a coordinate with
probability equal to their weighted Jaccard similarity. Only darts under a rank that fills all
coordinates with good odds are thrown; where one stays empty, the rank doubles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecforge.llm.common import HOT_SHARE, WORD, Scratch, Vocabulary, mix64, pieces, prepare, skew_join
from vecforge.llm.components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
#: Bands and coordinates per band: a pair at similarity 0.8 shares none with probability 3e-5.
BANDS, ROWS = 20, 4
#: Pairs of one centre that a part of it takes, at least.
PART_ROWS = 64
#: 64-bit words of a document's parity, by which most pairs that meet are told apart before any text is read.
PARITY = 8
POST = "u long, v long, posts array<struct<token: long, role: long>>, label long, size long, " + ", ".join(f"p{k} long" for k in range(PARITY))
#: Roles of a post: found by others, seeks others, or a link of the centre.
FOUND, SEEKS, LINKED = 0, 1, 2
_STEP, _SALT, _MASK = 0x9E3779B97F4A7C15, np.uint64(0xA0761D6478BD642F), (1 << 64) - 1


def shingles(texts: list[bytes], n: int = SHINGLE, weighted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(48-bit element, weight, row) of the word n-grams of each text; a shorter text is one element."""
    known, ids = Vocabulary(), []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.split()  # of bytes: at space and U+0009..U+000D only
        counts[i] = len(words)
        ids += map(known.__getitem__, words)
    h = known.hashes()[np.array(ids, np.int32)]
    row = np.repeat(np.arange(len(texts)), counts)
    ends = np.cumsum(counts)
    left = ends[row] - np.arange(len(h))  # words from here to the text's end
    total = np.zeros(len(h), np.uint64)
    for k in range(n):
        part = np.zeros(len(h), np.uint64)
        part[: max(0, len(h) - k)] = h[k:]
        part[left <= k] = 0
        total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + part
    total = mix64(total)
    first = np.arange(len(h)) == (ends - counts)[row]
    use = (left >= n) | (first & (counts[row] < n))
    key = (row[use].astype(np.uint64) << np.uint64(48)) | (total[use] >> np.uint64(16))
    key, times = np.unique(key, return_counts=True)
    weight = times.astype(np.float64) if weighted else np.ones(len(key))
    return key & np.uint64((1 << 48) - 1), weight, (key >> np.uint64(48)).astype(np.int64)


def _throw(cell: np.ndarray, height: np.ndarray, row: np.ndarray, reach: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    best = np.full(n_rows * k, np.inf)
    mark = np.zeros(n_rows * k, np.uint64)
    rank, found, turn = np.zeros(len(cell)), [], 0
    while len(cell):
        turn += 1
        h = mix64(cell + np.uint64(turn * _STEP & _MASK))
        rank = rank - np.log1p(-(h >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        near = rank <= reach[row]
        cell, height, row, rank, h = cell[near], height[near], row[near], rank[near], h[near]
        g = mix64(h ^ _SALT)
        lands = (g >> np.uint64(40)).astype(np.float64) * 2.0**-24 < height
        slot = row * k + ((g & np.uint64(0xFFFFFFFF)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        found.append((slot[lands], rank[lands], h[lands]))
    if found:
        slot, rank, h = (np.concatenate(x) for x in zip(*found, strict=True))
        np.minimum.at(best, slot, rank)
        wins = rank == best[slot]
        mark[slot[wins]] = h[wins]
    return best.reshape(n_rows, k), mark.reshape(n_rows, k)


def signatures(element: np.ndarray, weight: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """One signature of k marks per row; rows without elements get zeros."""
    cells = np.ceil(weight).astype(np.int64)
    at = np.repeat(np.arange(len(element)), cells)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
    cell = mix64(element[at] + mix64(nth.astype(np.uint64) + np.uint64(1)))
    height = np.minimum(1.0, weight[at] - nth)
    row = row[at]
    mass = np.bincount(row, height, n_rows)
    out = np.zeros((n_rows, k), np.uint64)
    todo, times = mass > 0, 1.0
    while todo.any():
        reach = np.where(todo, times * k * (math.log(k) + 2) / np.maximum(mass, 1e-9), -1.0)
        own = todo[row]
        best, mark = _throw(cell[own], height[own], row[own], reach, n_rows, k)
        full = todo & np.isfinite(best).all(axis=1)
        out[full] = mark[full]
        todo, times = todo & ~full, times * 2
    return out


def band_keys(texts: list[bytes], bands: int = BANDS, rows: int = ROWS, n: int = SHINGLE, weighted: bool = False) -> list[list[int] | None]:
    """A signed 64-bit key per band for each UTF-8 text; None for a text without words."""
    out: list[list[int] | None] = []
    for start in range(0, len(texts), 4096):  # row numbers share 64 bits with the elements
        part = texts[start : start + 4096]
        element, weight, row = shingles(part, n, weighted)
        marks = signatures(element, weight, row, len(part), bands * rows).reshape(len(part), bands, rows)
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(part), bands)).copy()
        for j in range(rows):
            key = mix64(key * np.uint64(31) + marks[:, :, j])
        has = np.bincount(row, minlength=len(part)) > 0
        out += [k if ok else None for k, ok in zip(key.view(np.int64).tolist(), has.tolist(), strict=True)]
    return out


def cells(texts: list[bytes], n: int = SHINGLE, weighted: bool = False) -> list[np.ndarray]:
    """Each text's set of n-grams as sorted distinct 64-bit numbers; weighted, the k-th of equal ones is another number.

    So the Jaccard similarity of two such sets is that of the texts, weighted by counts if asked for.
    """
    element, weight, row = shingles(texts, n, weighted)
    times = weight.astype(np.int64)
    at = np.repeat(np.arange(len(element)), times)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    cell = mix64(element[at] + mix64(nth.astype(np.uint64) + np.uint64(1))).view(np.int64)
    ends = np.cumsum(np.bincount(row[at], minlength=len(texts)))
    return [np.sort(x) for x in np.split(cell, ends[:-1])]


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a's elements the sorted set b has."""
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a if len(b) else np.zeros(len(a), bool)


def similar(a: int, b: int, common: int, similarity: float) -> bool:
    """Whether sets of a and b elements with so many in common reach the similarity."""
    return common >= similarity * (a + b - common) - 1e-9


def _sign(bands: int, rows: int, n: int, weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[list[int] | None] = []
            for _, texts in pieces(batch.column("text")):
                keys += band_keys(texts, bands, rows, n, weighted)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("nid"), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "nid", "bands"])

    return run


def _cells(n: int, weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch.column("text")):
                found = cells(texts, n, weighted)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([batch.column("nid").slice(first, len(texts)), lists], ["nid", "cells"])

    return run


def cell_sets(nodes: DataFrame, docs: DataFrame, n: int, weighted: bool) -> DataFrame:
    """(nid, cells) of each of ``nodes`` (nid, rep), from the row of ``docs`` that bears both."""
    key = lambda c: [F.col(c).isNull().alias("none"), F.coalesce(c, F.lit(0)).alias("id")]
    texts = docs.select("nid", *key("doc_id"), "text").join(nodes.select("nid", *key("rep")), ["nid", "none", "id"], "left_semi")
    return texts.dropDuplicates(["nid", "none", "id"]).select("nid", "text").mapInArrow(_cells(n, weighted), "nid long, cells array<long>")


def beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(v, part, kind, u, label, cells): in each partition a set v (kind 0) stands before its sets u (kind 1).

    ``pairs`` (u, v, label) is a written table. A v with many pairs is dealt to several parts, each with
    a copy of v's set, so it fills no task; v's set is not attached to each pair.
    """
    part_rows = max(PART_ROWS, pairs.count() // HOT_SHARE)
    hot = pairs.groupBy("v").agg(F.count("*").alias("c")).filter(F.col("c") > part_rows).select("v", F.ceil(F.col("c") / part_rows).alias("parts"))  # HOT_SHARE rows at most
    dealt = pairs.join(F.broadcast(hot), "v", "left").select("u", "v", "label", F.coalesce(F.pmod(F.xxhash64("u"), F.col("parts")), F.lit(0)).alias("part"))
    members = dealt.join(sets.withColumnRenamed("nid", "u"), "u").select("v", "part", F.lit(1).alias("kind"), "u", "label", "cells")
    none = F.lit(None).cast("long")
    centres = dealt.select("v", "part").distinct().join(sets.withColumnRenamed("nid", "v"), "v").select("v", "part", F.lit(0).alias("kind"), none.alias("u"), none.alias("label"), "cells")
    return members.unionByName(centres).repartition("v", "part").sortWithinPartitions("v", "part", "kind")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, np.ndarray, np.ndarray]]]]:
    """For each batch of :func:`beside`, the row, v, set of u and set of v of each pair."""
    v, centre = None, np.zeros(0, np.int64)
    for batch in batches:
        lists = batch.column("cells")
        ends = lists.offsets.to_numpy()
        values = lists.values.to_numpy()
        found = []
        for i, (node, kind) in enumerate(zip(batch.column("v").to_pylist(), batch.column("kind").to_pylist(), strict=True)):
            own = values[ends[i] : ends[i + 1]]
            if kind == 0:
                v, centre = node, own.copy()
            elif node == v:
                found.append((i, v, own, centre))
            else:
                raise ValueError("a pair came without the set of its v")
        yield batch, found


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _met(batches):
            keep = []
            for i, _, own, centre in found:
                if min(len(own), len(centre)) >= similarity * max(len(own), len(centre)) - 1e-9 and similar(len(own), len(centre), int(overlap(own, centre).sum()), similarity):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("u", "v")], ["u", "v"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (u, v) of texts, those whose sets are similar enough."""
    rows = beside(pairs.select("u", "v", F.lit(None).cast("long").alias("label")), sets)
    return rows.mapInArrow(_verify(similarity), "u long, v long")


def posts(own: np.ndarray, centre: np.ndarray, seed: int, similarity: float) -> list[tuple[int, int]]:
    """The (token, role) under which a text meets others of its centre that it may be similar to.

    With t the similarity, a link of u and v needs |u & v| >= t / (1 + t) * (|u| + |v|). Either they
    share shingles outside the centre c: then, as |u & v & c| <= |u & c|, at least that less |u & c| of
    them, so it is enough to compare prefixes of what each has outside c, in hash order. Or they share
    none outside, so both |u & c| and |v & c| reach the bound; if u is no link of c, that needs
    |v| < |c|, and u meets v by v's size, in steps of a sixteenth of |c|. Role 1 seeks, role 0 is only
    found: links of c need not seek each other, since c connects them; for each of them one row of
    LINKED says so.
    """
    mine = overlap(own, centre)
    inside = int(mine.sum())
    seeks = int(not similar(len(own), len(centre), inside, similarity))
    salt = mix64(np.array([seed & _MASK], np.uint64) + _SALT)
    mark = lambda x: mix64(x ^ salt).view(np.int64)
    outside = np.sort(mark(own[~mine].view(np.uint64)))
    need = math.ceil(similarity * len(own) - 1e-9) - inside
    out = [(x, seeks) for x in outside[: max(0, len(outside) - max(1, need) + 1)].tolist()]
    width = max(1, len(centre) // 16)
    by_size = lambda k: int(mark(mix64(np.array([k // width], np.uint64) + np.uint64(1)))[0])
    if len(own) < len(centre) and inside >= similarity * len(own) - 1e-9:
        out.append((by_size(len(own)), 0))
    if seeks:
        share = similarity / (1 + similarity)
        least = math.ceil(similarity * len(own) - 1e-9)
        most = min(len(centre) - 1, math.floor(len(own) / similarity + 1e-9), math.floor((inside + 1e-9) / share - len(own)))
        if least <= most:
            out += [(by_size(k * width), 1) for k in range(least // width, most // width + 1)]
    else:
        out.append((0, LINKED))
    return out


def parity(own: np.ndarray) -> list[int]:
    """PARITY words of 64 bits; a bit is the parity of the number of shingles that hash to it.

    A shingle of both documents changes the same bit in both, so the bits in which two documents differ
    are no more than the shingles that only one of them has, whatever collides.
    """
    odd = np.bincount((own.view(np.uint64) % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def may_be_similar(a: str, b: str, similarity: float) -> Column:
    """Whether sizes and parities leave it open that two posts' documents are similar; loses no link.

    At similarity t or more, at most (1 - t) / (1 + t) of |u| + |v| are in one document only.
    """
    size = lambda f: f(F.col(f"{a}.size"), F.col(f"{b}.size"))
    differ = sum((F.bit_count(F.col(f"{a}.p{k}").bitwiseXOR(F.col(f"{b}.p{k}"))) for k in range(1, PARITY)), F.bit_count(F.col(f"{a}.p0").bitwiseXOR(F.col(f"{b}.p0"))))
    alone = (1 - similarity) / (1 + similarity) * (F.col(f"{a}.size") + F.col(f"{b}.size"))
    return (size(F.least) >= similarity * size(F.greatest) - 1e-9) & (differ <= alone + 1e-9)


def _post(similarity: float):
    kinds = [pa.int64()] * 2 + [pa.list_(pa.struct([("token", pa.int64()), ("role", pa.int64())])), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _met(batches):
            label = batch.column("label").to_pylist()
            u = batch.column("u").to_pylist()
            rows = [(u[i], v, [{"token": t, "role": r} for t, r in posts(own, centre, v, similarity)], label[i], len(own), *parity(own)) for i, v, own, centre in found]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * (5 + PARITY)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds + [pa.int64()] * PARITY, strict=True)], ["u", "v", "posts", "label", "size", *(f"p{k}" for k in range(PARITY))])

    return run


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def text_id(text: Column) -> Column:
    """A 64-bit hash of a text; 0 for all texts without words."""
    return F.when(text.rlike(WORD), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))


def texts(docs: DataFrame, spark: SparkSession, scratch: Scratch, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, n: int = SHINGLE, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, nid) of every row of ``docs``, and (nid, rep, label) of every distinct text.

    rep is the text's smallest doc_id, and label the smallest nid of its class, see :func:`near_duplicates`.
    """
    prepare(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("nid", text_id(F.col("text")))
    signed = scratch.write(slim.select("doc_id", "nid", "text").mapInArrow(_sign(bands, rows, n, weighted), "doc_id long, nid long, bands array<long>"), "signed")
    reps = scratch.write(signed.groupBy("nid").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "reps")
    buckets = reps.filter("bands IS NOT NULL").select(F.col("nid").alias("node"), F.explode("bands").alias("key"))
    multi = buckets.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    met = scratch.write(buckets.join(multi, "key"), "met")
    famed = met.join(met.groupBy("node").agg(F.sum("size").alias("fame")), "node")
    centres = famed.groupBy("key").agg(F.max(F.struct("fame", "node")).alias("m")).select("key", F.col("m.node").alias("centre"))
    members = scratch.write(famed.join(centres, "key"), "members")
    scratch.drop("met")
    sets = scratch.write(cell_sets(members.select(F.col("node").alias("nid")).distinct().join(reps.select("nid", "rep"), "nid"), slim, n, weighted), "sets")
    stars = scratch.write(members.filter("node <> centre").select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct(), "stars")
    links = scratch.write(verified(stars, sets, similarity), "links")
    labels = connected_components(links, scratch, "cc1")

    # buckets that still hold several components: all members meet by what they have besides one centre,
    # the most met of the component that the bucket's own centre is in
    tagged = scratch.write(members.filter("size > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "tagged")
    split = tagged.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
    leads = tagged.groupBy("label").agg(F.max(F.struct("fame", "node")).alias("m")).select("label", F.col("m.node").alias("v"))
    lead = tagged.filter("node = centre").select("key", "label").join(split, "key").join(leads, "label").select("key", "v")
    many = scratch.write(tagged.join(lead, "key").filter("node <> v").select(F.col("node").alias("u"), "v", "label").distinct(), "many")
    post = scratch.write(beside(many, sets).mapInArrow(_post(similarity), POST), "posts")
    each = post.select("u", "label", "size", *(f"p{k}" for k in range(PARITY)), "v", F.explode("posts").alias("p")).withColumns({"token": F.col("p.token"), "role": F.col("p.role")}).drop("p")
    seek, found = each.filter(f"role = {SEEKS}").alias("a"), each.filter(f"role <> {LINKED}").alias("b")
    meets = (F.col("a.v") == F.col("b.v")) & (F.col("a.token") == F.col("b.token")) & (F.col("a.label") != F.col("b.label")) & may_be_similar("a", "b", similarity)
    far = seek.join(found, meets).select(F.col("a.u").alias("u"), F.col("b.u").alias("v"))
    rest = scratch.write(ordered(far).join(ordered(stars), ["u", "v"], "left_anti"), "rest")
    linked = post.filter(F.exists("posts", lambda p: p["role"] == LINKED)).select("u", "v")
    more = scratch.write(verified(rest, sets, similarity).unionByName(linked), "more")
    # a component's label is one of its nodes, so the new links need connecting between labels only
    label_of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    between = more.join(label_of("u"), "u", "left").join(label_of("v"), "v", "left").select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v")).filter("u <> v").distinct()
    joined = connected_components(between, scratch, "cc2").select(F.col("node").alias("label"), F.col("label").alias("joined"))
    scratch.drop("members", "stars", "tagged", "many", "posts", "rest", "sets")
    own = scratch.write(reps.join(labels, F.col("nid") == F.col("node"), "left").select("nid", "rep", F.coalesce("label", "nid").alias("label")), "own")
    return signed.select("doc_id", "nid"), skew_join(own, joined, ["label"], "left").select("nid", "rep", F.coalesce("joined", "label").alias("label"))


def near_duplicates(docs: DataFrame, spark: SparkSession, **params) -> DataFrame:
    """(doc_id, class_id, kept) for every row of ``docs`` (doc_id long, text); kept marks one text of each class.

    A class is a connected component of the texts under exact Jaccard similarity of their sets of word
    n-grams (``weighted``: multisets) of at least ``similarity``, among pairs that share a band; class_id
    is its smallest doc_id. Steps:

    - equal texts are one node, whatever their doc_ids, so copies are never paired;
    - a node's band keys are dealt out, and in each bucket all members are paired with one centre, the
      member that meets most others over all buckets, verified on the sets, and connected;
    - in buckets that still hold several components, members meet by what they have besides one
      centre (:func:`posts`), and of those that meet, the join lets pass those whose parities are near
      enough (:func:`may_be_similar`); neither loses a link.

    So every similar pair that shares a band is verified or already connected, and no step emits the
    pairs of a group. Sets are compared by 48-bit hashes of n-grams, texts by 64-bit hashes.

    Null texts count as empty, and all texts without words are one text. A text of fewer than n words
    is one n-gram. Repeated rows are copies. Rows that repeat a doc_id with another text are texts of
    their own, in a class only if similar. Rows without a doc_id are matched as others are; a class of
    only such rows has a null class_id. kept is true on the rows with the class's smallest doc_id and,
    of several texts with that id, on the one of smallest hash. Other columns are ignored. An empty
    table gives an empty one.
    """
    scratch = Scratch(spark, "near")
    rows, nodes = texts(docs, spark, scratch, **params)
    nodes = scratch.write(nodes, "nodes")
    heads = scratch.write(first_of(nodes).select("label", F.col("rep").alias("class_id"), F.col("nid").alias("head")), "heads")
    of_text = scratch.write(skew_join(nodes, heads, ["label"]).select("nid", "class_id", "head"), "of-text")
    scratch.drop("nodes", "heads", "own", "reps", "links", "more")
    return skew_join(rows, of_text, ["nid"]).select("doc_id", "class_id", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("nid") == F.col("head"))).alias("kept"))


def first_of(nodes: DataFrame) -> DataFrame:
    """(label, rep, nid) of the text of smallest doc_id of each class, null last."""
    best = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "nid")).alias("m")
    return nodes.groupBy("label").agg(best).select("label", "m.rep", "m.nid")


def drop_near_duplicates(docs: DataFrame, spark: SparkSession, **params) -> DataFrame:
    """The rows of ``docs`` with one row left of each class, the one that :func:`near_duplicates` marks.

    Of repeated rows that differ in other columns only, any one stays. A class without any doc_id
    leaves one row, too. All columns stay as they are.
    """
    scratch = Scratch(spark, "classes")
    _, nodes = texts(docs, spark, scratch, **params)
    heads = scratch.write(first_of(nodes), "heads")
    scratch.drop("signed", "own", "reps", "links", "more")
    key = lambda c: {"__none": F.col(c).isNull(), "__id": F.coalesce(F.col(c).cast("long"), F.lit(0))}
    keys = ["__nid", "__none", "__id"]
    wanted = heads.select(F.col("nid").alias("__nid"), "rep").withColumns(key("rep")).select(*keys)
    marked = docs.withColumn("__nid", text_id(F.col("text").cast("string"))).withColumns(key("doc_id"))
    return marked.join(wanted, keys, "left_semi").dropDuplicates(keys).select(*[F.col(f"`{c}`") for c in docs.columns])
