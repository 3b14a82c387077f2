import random

import numpy as np
import pytest

from vecforge.llm import common
from vecforge.llm import near_dedup as nd

SCHEMA = "doc_id long, text string, kept string"


def shingle_set(text, n=5):
    words = text.split()
    return set(zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else {tuple(words)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def classes_by_brute_force(rows, similarity=0.8):
    """The smallest doc_id of each document's component over all pairs."""
    sets = {i: shingle_set((t or "").encode()) for i, t in rows}
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and jaccard(sets[a], sets[b]) >= similarity:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def corpus(rng, groups=6, size=14, words=60):
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(groups):
        base = rng.choices(vocabulary, k=words)
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                del t[rng.randrange(len(t)) :][:2]
            rows.append(" ".join(t))
        rows += [rows[-1]] * 3
    rows += [" ".join(rng.choices(vocabulary, k=40)) for _ in range(20)] + ["", None, " \n", "one two", "one  two", "one three"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [2, 1000])
def test_classes_match_brute_force(spark, seed):
    """The shipped bands and rows, against all pairs."""
    rows = corpus(random.Random(seed))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(df, spark).collect()}
    assert got == classes_by_brute_force(rows)


def test_large_buckets_with_hot_centres_match_brute_force(spark, monkeypatch):
    """Parts of a few pairs and hot keys of a few rows, as large data would have."""
    monkeypatch.setattr(nd, "PART_ROWS", 3)
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    monkeypatch.setattr(common, "HOT_SHARE", 20)
    rows = corpus(random.Random(3), groups=3, size=40)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(df, spark).collect()}
    assert got == classes_by_brute_force(rows)


def test_posts_lose_no_link():
    """Of unconnected members of a bucket, each similar pair meets under a token that one of them seeks."""
    rng = random.Random(5)
    vocabulary = [f"w{i}".encode() for i in range(60)]
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.randint(10, 60))
        texts = []
        for _ in range(12):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(t))
                t[k : k + rng.randint(0, 2)] = rng.choices(vocabulary, k=rng.randint(0, 2))
            texts.append(b" ".join(t))
        sets, plain = nd.cells(texts), [shingle_set(t) for t in texts]
        roles = [nd.posts(s, sets[0], 7, 0.8) for s in sets]
        linked = [any(r == nd.LINKED for _, r in x) for x in roles]
        assert linked == [jaccard(s, plain[0]) >= 0.8 for s in plain]
        found = [{x for x, r in y if r != nd.LINKED} for y in roles]
        seeks = [{x for x, r in y if r == nd.SEEKS} for y in roles]
        for a in range(12):
            for b in range(a):
                if jaccard(plain[a], plain[b]) >= 0.8 and not (linked[a] and linked[b]):
                    assert seeks[a] & found[b] | seeks[b] & found[a]


def test_weighted_sets_count_repeats():
    a, b = nd.cells([b"a b c d e a b c d e", b"a b c d e"], n=1, weighted=True)
    assert (len(a), len(b), int(nd.overlap(b, a).sum())) == (10, 5, 5)
    a, b = nd.cells([b"a b c d e a b c d e", b"a b c d e"], n=1)
    assert (len(a), len(b), int(nd.overlap(a, b).sum())) == (5, 5, 5)


def test_parities_bound_what_only_one_document_has(spark):
    rng = random.Random(9)
    numbers = lambda k: {rng.getrandbits(62) for _ in range(k)}
    row = lambda x: np.array(sorted(x), np.int64)
    for size in (0, 1, 40, 700, 2500):
        a = numbers(size)
        b = set(list(a)[size // 9 :]) | numbers(size // 9)
        differ = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(nd.parity(row(a)), nd.parity(row(b)), strict=True))
        assert differ <= len(a ^ b) and differ % 2 == len(a ^ b) % 2
    pool = list(numbers(160))
    sets = [row(pool[k : k + 100]) for k in (0, 11, 60)]
    df = spark.createDataFrame([(i, len(s), *nd.parity(s)) for i, s in enumerate(sets)], ["u", "size", *(f"p{k}" for k in range(nd.PARITY))])
    got = df.alias("a").join(df.alias("b"), nd.may_be_similar("a", "b", 0.8)).filter("a.u < b.u").selectExpr("a.u", "b.u AS v").collect()
    assert [tuple(r) for r in got] == [(0, 1)]


def test_signatures_estimate_weighted_similarity():
    a = np.arange(300, dtype=np.uint64)
    element, row = np.concatenate([a, a]), np.repeat([0, 1], 300)
    weight = np.concatenate([np.full(300, 2.5), np.where(a < 150, 2.5, 1.0)])
    marks = nd.signatures(element, weight, row, 2, 3000)
    assert abs((marks[0] == marks[1]).mean() - 0.7) < 0.04


def test_special_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y z", "a"), (5, "x y z", None), (5, "x y z", None), (None, "q", "a"), (None, "q", "b"), (9, "word " * 30000, "a"), (10, "word " * 30001, "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(r["doc_id"]), str(r["class_id"])) for r in nd.near_duplicates(df, spark).collect())
    assert got == sorted([("1", "1"), ("2", "1"), ("None", "5"), ("5", "5"), ("5", "5"), ("None", "None"), ("None", "None"), ("9", "9"), ("10", "9")])
    left = nd.drop_near_duplicates(df, spark)
    assert left.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "5", "9", "None"]
    assert nd.near_duplicates(df.limit(0), spark).count() == 0
    assert nd.drop_near_duplicates(df.limit(0), spark).count() == 0


def test_a_repeated_doc_id_with_another_text_loses_no_text(spark):
    rows = [(1, "a b c d e f", "x"), (1, "q r s t u v", "x"), (2, "a b c d e f", "x"), (3, "q r s t u v", "x"), (4, "m n o p", "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [(r["doc_id"], r["class_id"]) for r in nd.near_duplicates(df, spark).collect()]
    assert sorted(got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    assert sorted(r["text"] for r in nd.drop_near_duplicates(df, spark).collect()) == ["a b c d e f", "m n o p", "q r s t u v"]
    assert sum(r["kept"] for r in nd.near_duplicates(df, spark).collect()) == 3
