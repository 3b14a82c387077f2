"""The corpus pipeline, stage by stage on its own input, against plain Python."""

import collections
import hashlib
import math

import corpus_pipeline
from tests.llm.test_near_dedup import classes_by_brute_force
from tests.llm.test_records import plain_spans
from tests.llm.test_text_operators import WORD, base, plain_packing, spark_hash
from vecforge.llm import mixing, packing, quality_rules
from vecforge.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def plain_quality(rows, trusted):
    """The doc_ids that stay."""
    grams = {}
    for r in rows:
        w = WORD.findall(r["text"] or "")
        grams[r["doc_id"]] = [spark_hash(x) % quality_rules.BUCKETS for x in w] + [spark_hash(*x) % quality_rules.BUCKETS for x in zip(w, w[1:])]
    raw, target = collections.Counter(), collections.Counter()
    for i, g in grams.items():
        raw.update(g)
        if i in trusted:
            target.update(g)
    share = sum(target.values()) / sum(raw.values())
    ratio = lambda b: round(math.log((target[b] + quality_rules.PRIOR) / (raw[b] * share + quality_rules.PRIOR)), 3)
    mean = {i: sum(map(ratio, g)) / max(1, len(g)) for i, g in grams.items()}
    return {r["doc_id"] for r in rows if not base(r["text"])[5] and mean[r["doc_id"]] >= quality_rules.THRESHOLD}


def plain_targets(size):
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in size if s is None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    stopped = set()
    while True:
        rest = mixing.SHARE * sum(size.values()) - sum(mixing.CAP * size[s] for s in stopped)
        total = sum(weight[s] for s in names if s not in stopped)
        over = {s for s in names if s not in stopped and rest / total * weight[s] >= mixing.CAP * size[s]}
        if not over:
            return {s: mixing.CAP * size[s] if s in stopped else rest * weight[s] / total for s in names}
        stopped |= over


def test_each_stage_matches_plain_python(spark):
    scratch = Scratch(spark, "test")
    docs, inputs = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(docs.collect())
        docs = scratch.write(stage(spark, docs, SF), name.replace(" ", "-"))
        assert name == "packing" or docs.columns == columns
    first, judged, apart, clean, mixed = inputs
    trusted = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    assert {r["doc_id"] for r in judged} == plain_quality(first, trusted)
    groups = classes_by_brute_force([(r["doc_id"], r["text"]) for r in judged])
    assert sorted(r["doc_id"] for r in apart) == sorted(set(groups.values())) and len(apart) < len(judged)
    assert {r["doc_id"]: tuple(r) for r in apart}.items() <= {r["doc_id"]: tuple(r) for r in judged}.items()
    before = {r["doc_id"]: r for r in apart}
    assert sorted(r["doc_id"] for r in clean) == sorted(before)
    changed = 0
    for r in clean:
        was = before[r["doc_id"]]
        spans = plain_spans(was["text"])
        changed += r["text"] != was["text"]
        assert r["n_chars"] == len(r["text"]) and (r["source"], r["lang"]) == (was["source"], was["lang"])
        for a, b in (map(int, x.split(":")[1:]) for x in spans):
            assert was["text"][a:b] not in r["text"]
    assert 0 < changed < len(clean) / 2  # the tagger may add spans, but most documents have no secret
    size = collections.Counter()
    words = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in clean}
    for r in clean:
        size[r["source"]] += words[r["doc_id"]]
    target = plain_targets(size)
    want = collections.Counter()
    for r in clean:
        rate = target[r["source"]] / size[r["source"]] if size[r["source"]] else 0.0
        draw = int(hashlib.md5(f"{mixing.SEED}:{r['doc_id']}".encode()).hexdigest()[:13], 16) / (1 << 52)
        want[tuple(r)] += math.floor(rate) + (draw < rate - math.floor(rate))
    assert collections.Counter(tuple(r) for r in mixed) == +want
    copies = collections.Counter((r["doc_id"], r["text"], r["source"]) for r in mixed)
    packed = plain_packing([(*k, c) for k, n in copies.items() for c in range(n)], packing.CAPACITY, packing.PER_SOURCE)
    assert sorted((r["bin_id"], r["offset"], r["doc_id"], r["piece"], r["length"]) for r in docs.collect()) == packed
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, docs.collect()))


def test_stages_take_special_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names, and no rows."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, "some words " * 30, "en", "a", 9), (1, "some words " * 30, "en", "a", 9), (None, long, None, None, None), (2, None, None, None, None), (3, "", "en", "b", 0), (4, long, "en", "b", 1)]
    rows += [(10 + i, " ".join(f"{'abcdefgh'[(i + k) % 8]}{k}" for k in range(40)), "en", "b", 3) for i in range(8)]
    docs = spark.createDataFrame([(*r, "clash", 1, True, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size string, llr int, kept boolean, spans string")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        kept = got.collect()
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name == "packing":
            assert {r["doc_id"] for r in kept} == {r[0] for r in rows}
        else:
            assert got.columns == docs.columns and {(r["size"], r["llr"], r["kept"], r["spans"]) for r in kept} <= {("clash", 1, True, "x")}
        if name == "secret scans":
            assert len(kept) == len(rows) and [r["n_chars"] for r in kept if r["text"] is None] == [None]
        if name == "near dedup":
            assert len(kept) == 8 + 3 and sorted(str(r["doc_id"]) for r in kept if r["doc_id"] not in range(10, 18)) == ["1", "2", "4"]
