"""Quality rules, mixing, packing and substring dedup against plain Python."""

import collections
import random
import re
import tempfile

import pytest
import xxhash
from pyspark.sql import functions as F

from vecforge.llm import common, mixing, packing, quality_rules, queries, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, kept string, size string"
TEXTS = [None, "", " \n ", "a b c d e a b c d e", "one two three four five six\none two three four five six\n\nx", "# $ & | < > % * words here and there are many of them today ok", "déjà vu " * 40, "w" * 50_000, "the same line again and again here\n" * 3, " ".join(f"w{i}" for i in range(3000)), "x\x0by\x0cz\x1cq r"]


def frame(spark, texts, sources=("a", "b", None)):
    rows = [(i, t, sources[i % len(sources)], None, 7, "clash", "clash") for i, t in enumerate(texts)] + [(None, "no id", None, None, None, None, None)] * 2
    return spark.createDataFrame(rows, SCHEMA)


def base(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    n, r = len(w), len(covered)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n


def spark_hash(*parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), h)
    return (h - (1 << 64) if h >> 63 else h)


def grams(text):
    ends = WORD.findall(text or "")
    return [spark_hash(a) % quality_rules.BUCKETS for a in ends] + [spark_hash(a, b) % quality_rules.BUCKETS for a, b in zip(ends, ends[1:])]


def test_quality_rules_match_plain_python(spark):
    import math

    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choices(["alpha", "beta", "gamma", "delta%%%", "x"], k=rng.randint(0, 60))) for _ in range(30)]
    df = frame(spark, texts)
    trusted = {12, 14, 20, 21}
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted] + [(13, 0, 0), (None, 1, 0), (15, None, None)], "doc_id long, quality int, toxic int")
    got = quality_rules.quality_rules(df, labels)
    assert sorted(got.columns) == sorted([c for c in df.columns if c != "kept"] + [*quality_rules.BASE, "base_failed", "llr", "kept"])
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    raw, target = collections.Counter(), collections.Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in trusted:
            target.update(grams(t))
    part = sum(target.values()) / sum(raw.values())
    ratio = {b: round(math.log((target[b] + quality_rules.PRIOR) / (raw[b] * part + quality_rules.PRIOR)), 3) for b in raw}
    by_text = {t: (base(t), sum(ratio[b] for b in grams(t)) / max(1, len(grams(t)))) for _, t in rows}
    for r in got.collect():
        want, llr = by_text[r["text"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert abs(r["llr"] - llr) < 1e-9
        assert r["kept"] == (not want[-1] and r["llr"] >= quality_rules.THRESHOLD)
    assert quality_rules.quality_rules(df.limit(0), labels).count() == 0
    assert quality_rules.fit(df, labels.limit(0)) == [0.0] * quality_rules.BUCKETS


def test_quality_rules_read_whole_words(spark):
    from vecforge.llm import queries

    rng = random.Random(8)
    words = [f"{a}{b}ing" for a in "bcdfghklmnprst" for b in "aeiou"]
    good = [" ".join(rng.choices(words, k=60)) for _ in range(60)]
    poor = [" ".join(rng.choice(["%%%", "***", "X!!"]) + w for w in rng.choices(words, k=60)) for _ in range(30)]
    texts = good + poor
    with tempfile.TemporaryDirectory() as d:
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(i, 0, 0) for i in range(60, 70)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        kept = {r["doc_id"]: r["kept"] for r in queries.op8_quality_rules(spark, d).collect()}
    assert [i for i in range(len(texts)) if kept[i]] == list(range(len(good)))


def test_mix_targets_and_copies(spark):
    rng = random.Random(2)
    texts = [" ".join(["w"] * rng.randint(0, 30)) for _ in range(3000)]
    df = frame(spark, texts, ("a", "b", None, "é", "z", "a", "a", "a"))
    rows = mixing.digest(mixing.mix(df)).collect()
    assert len(rows) == df.count()
    size, target, taken = collections.Counter(), {}, collections.Counter()
    source = {r["doc_id"]: r["source"] for r in df.collect()}
    for r in rows:
        s = source[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    names = ["a", "b", "z", "é", None]
    weight = dict(zip(names, (5, 2, 1, 5, 2)))
    want, open_ = {}, set(names)
    while True:
        rest = 1.5 * sum(size.values()) - sum(2 * size[s] for s in names if s not in open_)
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * size[s]}
        want |= {s: level * weight[s] for s in open_}
        want |= {s: 2.0 * size[s] for s in names if s not in open_ or s in over}
        if not over:
            break
        open_ -= over
    for s in names:
        assert abs(target[s] - want[s]) < 1e-6
        assert abs(taken[s] - want[s]) <= 0.1 * want[s]
    again = mixing.digest(mixing.mix(df.repartition(7))).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    emitted = mixing.emit(mixing.mix(df), ["doc_id", "text", "source"])
    assert emitted.count() == sum(r["taken"] // r["size"] if r["size"] else 0 for r in rows) + mixing.mix(df).filter("size = 0").selectExpr("sum(copies)").first()[0]
    assert mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("capacity", [7, 64])
def test_packing_is_whole_and_tight(spark, capacity):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 90))) for _ in range(200)] + ["same words here"] * 40
    df = frame(spark, texts)
    rows = packing.pack(df, spark, capacity=capacity, per_source=3, group_rows=60).collect()
    held, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        held[r["doc_id"]].append((r["start"], r["length"]))
        by_bin[r["bin_id"]].append(r)
    for r in df.collect():
        n = len(WORD.findall(r["text"] or ""))
        spans = sorted(held[r["doc_id"]])
        if r["doc_id"] is not None:
            assert [s for s, _ in spans] == list(range(0, max(n, 1), capacity)) and sum(x for _, x in spans) == n
    words = {r["doc_id"]: " ".join(WORD.findall(r["text"] or "")) for r in df.collect()}
    for rs in by_bin.values():
        at = 0
        for r in sorted(rs, key=lambda r: (r["offset"], r["length"])):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        assert len({words[r["doc_id"]] for r in rs}) == len(rs)
        assert max(collections.Counter(r["source"] for r in rs).values()) <= 3
    assert packing.pack(df.limit(0), spark).count() == 0


def plain_packing(rows, capacity, per_source):
    """One group in plain Python: of all bins with room that hold no such cluster, the tightest, else a new one."""
    pieces = []
    for i, t, s, copy in rows:
        n = len(WORD.findall(t or ""))
        h = spark_hash(" ".join(WORD.findall(t or "")))
        pieces += [(-min(capacity, n - k * capacity), h, i, s is None, s or "", copy, k) for k in range(max(1, -(-n // capacity)))]
    bins, out = [], []
    for length, h, i, none, s, _, k in sorted(pieces):
        length = -length
        fits = [b for b, x in enumerate(bins) if x["room"] >= max(length, 1) and h not in x["held"] and x["sources"].count((none, s)) < per_source]
        at = min(fits, key=lambda b: (bins[b]["room"], b), default=None)
        if at is None:
            at = len(bins)
            bins.append({"room": capacity, "held": set(), "sources": []})
        out.append((at, capacity - bins[at]["room"], i, k, length))
        bins[at]["room"] -= length
        bins[at]["held"].add(h)
        bins[at]["sources"].append((none, s))
    return sorted(out)


def test_packing_matches_plain_python_whatever_the_partitions(spark):
    rng = random.Random(9)
    texts = [t for t in TEXTS if t is None or "\x0b" not in t] + [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 90))) for _ in range(150)] + ["same words here"] * 9
    rows = [(i, t, ["a", "b", None][i % 3]) for i, t in enumerate(texts)]
    repeats = collections.Counter(rows + rows[:6] * 2)
    df = spark.createDataFrame(list(repeats.elements()), "doc_id long, text string, source string")
    want = plain_packing([(*r, k) for r, n in repeats.items() for k in range(n)], 40, 3)
    for parts in (1, 7):
        got = packing.pack(df.repartition(parts, F.rand(parts)), spark, capacity=40, per_source=3).collect()
        assert sorted((r["bin_id"], r["offset"], r["doc_id"], r["piece"], r["length"]) for r in got) == want
    some = [sorted(map(str, packing.pack(df.repartition(n, F.rand(n)), spark, capacity=40, group_rows=20).collect())) for n in (1, 5)]
    assert some[0] == some[1]


def test_packing_keeps_bins_of_many_groups_apart(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 60))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t, "abc"[i % 3]) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    rows = packing.pack(df, spark, capacity=64, per_source=2, group_rows=4).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    by_bin = collections.defaultdict(list)
    for r in rows:
        by_bin[r["bin_id"]].append(r)
    assert min(by_bin) >= 0 and max(by_bin) // packing.STRIDE > 256
    for rs in by_bin.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
        assert len({texts[r["doc_id"]] for r in rs}) == len(rs)
        assert max(collections.Counter(r["source"] for r in rs).values()) <= 2


def test_best_fit_takes_the_tightest_compatible_bin():
    bins = packing.Bins(10, 1)
    assert [bins.place(*x) for x in ((7, 0, 0), (6, 1, 1), (3, 2, 2), (3, 3, 1), (4, 0, 9), (4, 1, 8))] == [(0, 0), (1, 0), (0, 7), (2, 0), (1, 6), (2, 3)]


def plain_word(word):
    return re.sub(r"^[\W_]+|[\W_]+$", "", word.casefold())


def plain_units(text, least=8):
    """The chunk rule in plain Python: (start, end, words) of each chunk."""
    mask = (1 << 64) - 1

    def mix(x):
        for _ in range(2):
            x ^= x >> 32
            x = x * 0xD6E8FEB86659FD93 & mask
        return x ^ x >> 32

    lines, at = [], 0
    for line in text.split("\n"):
        end = min(at + len(line) + 1, len(text))
        found = [(at + m.start(), plain_word(m.group())) for m in WORD.finditer(line)]
        lines.append((at, end, [(p, w) for p, w in found if w]))
        at = end
    blocks = []
    for a, b, words in lines:
        if len(words) < least and blocks and not blocks[-1][3]:
            blocks[-1] = (blocks[-1][0], b, blocks[-1][2] + words, False)
        else:
            blocks.append((a, b, words, len(words) >= least))
    out = []
    for a, b, words, _ in blocks:
        if len(words) < least:
            continue
        h = [xxhash.xxh64_intdigest(w.encode()) for _, w in words]
        h = [mix((x * 3 + y) & mask) for x, y in zip(h, h[1:])]
        cuts = []
        for i in range(least, len(words) - least + 1):
            before, after = [h[j] for j in range(max(0, i - least + 1), i)], h[i + 1 : i + least]
            if i < len(h) and all(h[i] < x for x in before) and all(h[i] <= x for x in after):
                cuts.append(i)
        edges = [0, *cuts, len(words)]
        starts = [a, *(words[i][0] for i in cuts), b]
        out += [(starts[k], starts[k + 1], tuple(w for _, w in words[edges[k] : edges[k + 1]])) for k in range(len(cuts) + 1)]
    return out


def chunk_lists(texts):
    u = substring_dedup.units([t.encode() for t in texts])
    out = [[] for _ in texts]
    for row, a, b, n, x, y in zip(u.row, u.start, u.end, u.words, *u.digest, strict=True):
        out[row].append((int(a), int(b), int(n), (int(x), int(y))))
    return out


def passages(rng):
    shared = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=rng.randint(5, 90))) for _ in range(14)]
    line = lambda: rng.choice(shared) + rng.choice(["", ".", "!", " -"]) if rng.random() < 0.5 else " ".join(rng.choices([f"ü{i}" for i in range(500)], k=rng.randint(1, 40)))
    return [rng.choice(["\n", "\n", " ", "\n\n"]).join(line() for _ in range(rng.randint(1, 9))) for _ in range(70)]


def test_chunks_follow_the_plain_rule():
    texts = [t or "" for t in TEXTS] + passages(random.Random(8)) + ["", "Ä ö, ß. _x_ İ ... a b c d e f g h\n\n", "x\n" * 30]
    digests = {}
    for t, found in zip(texts, chunk_lists(texts), strict=True):
        want = plain_units(t)
        assert [(a, b, n) for a, b, n, _ in found] == [(a, b, len(w)) for a, b, w in want]
        for (_, _, w), (_, _, _, d) in zip(want, found, strict=True):
            assert digests.setdefault(w, d) == d
    assert len(set(digests.values())) == len(digests)


@pytest.mark.parametrize("hot", [False, True])
def test_substring_dedup_matches_plain_python(spark, monkeypatch, hot):
    if hot:  # keys of a few rows count as hot
        monkeypatch.setattr(common, "HOT_ROWS", 2)
    texts = TEXTS + passages(random.Random(4))
    df = frame(spark, texts).unionByName(frame(spark, texts).filter("doc_id = 20"))  # a repeated row
    seen, want = set(), {}
    for i, t in enumerate(texts):
        found, run = [], []
        for a, b, w in [*plain_units(t or ""), (0, 0, None)]:
            if w in seen:
                run.append((a, b, len(w)))
                continue
            if sum(n for _, _, n in run) >= substring_dedup.MIN_RUN:
                found.append((run[0][0], run[-1][1]))
            run = []
            seen |= {w} - {None}
        left = t
        for a, b in reversed(found):
            left = left[:a] + left[b:]
        want[i] = (len(found), ",".join(f"{a}:{b}" for a, b in found), left)
    got = substring_dedup.substring_dedup(df, spark).collect()
    assert len(got) == df.count()
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_removed"], r["removed"], r["text"]) == want[r["doc_id"]]
    assert sum(n for n, _, _ in want.values()) > 20
    assert substring_dedup.substring_dedup(df.limit(0), spark).count() == 0


def test_a_repeated_doc_id_with_another_text_is_another_document(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage), (1, passage + "\nand more"), (1, passage), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in substring_dedup.substring_dedup(df, spark).collect())
    assert got[0] in (("1", 0), ("1", 1)) and got[-1] == ("None", 1)
    assert sorted(n for i, n in got if i == "1") in ([0, 0, 1], [0, 1, 1])  # the one of smaller hash comes first


def test_substring_dedup_finds_passages_inside_lines(spark):
    rng = random.Random(6)
    prose = lambda n: [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 9999)) + rng.choice(["", "", "", ",", " -", "."]) for _ in range(n)]
    inside, across, short = prose(60), prose(70), prose(60)
    across[20] += "\n" + across[21] + " "
    stock = " ".join(prose(14))
    texts = []
    for _ in range(3):
        texts.append(" ".join([*prose(25), *inside, *prose(31)]))
        texts.append(" ".join([*prose(rng.randint(9, 30)), *across, *prose(12)]).upper())
        texts.append("\n".join([*[" ".join(prose(4)) for _ in range(3)], *[" ".join(short[i : i + 5]) for i in range(0, 60, 5)], " ".join(prose(20))]))
        texts.append("\n".join([" ".join(prose(30)), stock, " ".join(prose(30))]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(df, spark).collect()}
    for i, t in enumerate(texts):
        assert (got[i]["n_removed"] > 0) == (i >= 4 and i % 4 < 3)  # stock lines of 14 words stay
        at, left = 0, ""
        for a, b in (map(int, x.split(":")) for x in got[i]["removed"].split(",") if x):
            assert at <= a < b
            left, at = left + t[at:a], b
        assert got[i]["text"] == left + t[at:]


def test_the_query_finds_every_shared_passage_and_no_other_document(spark, tmp_path):
    rng = random.Random(11)
    prose = lambda n: [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 99999)) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(n)]
    passage = [prose(50) for _ in range(60)]
    over = [["was"] * 70, ["is", "and", "is", "not"] * 20, ["x|", "...", "y"] * 40]
    texts = [" ".join([*prose(rng.randint(0, 40)), *p, *prose(rng.randint(0, 40))]) for p in passage + over]
    later = [" ".join([*prose(rng.randint(0, 40)), *p, *prose(rng.randint(0, 40))]).upper() for p in passage + [x + x[: rng.randint(1, 50)] for x in over]]
    inner = [" ".join([*p, *prose(5), *p, *prose(60), *p]) for p in (prose(60) for _ in range(20))]  # repeat themselves only
    alone = ["so so " * 99, *(" ".join([*prose(40), *rng.choice(passage)[10:17], *prose(40)]) for _ in range(20))]
    copies = [inner[0], inner[1].lower() + "\nand more"]
    rows = list(enumerate([*texts, *later, *inner, *alone, *copies, None, ""]))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_substring_dedup"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    plain = lambda t: [w for w in (x.strip(",.|").lower() for x in t.split()) if w]
    seen = {n: set() for n in (8, 50)}  # windows of earlier documents
    for i, t in rows:
        w = {n: {tuple(plain(t or "")[j : j + n]) for j in range(len(plain(t or "")) - n + 1)} for n in seen}
        if w[50] & seen[50]:
            assert got[i]["n_removed"] > 0, i
        if not w[8] & seen[8]:
            assert got[i]["n_removed"] == 0, i
        spans = [tuple(map(int, x.split(":"))) for x in got[i]["removed"].split(",") if x]
        assert got[i]["n_removed"] == len(spans) and got[i]["removed_chars"] == sum(b - a for a, b in spans)
        left, at = "", 0
        for a, b in spans:
            gone = plain(t[a:b])
            assert at <= a < b and len(gone) >= substring_dedup.MIN_RUN and tuple(gone[:8]) in seen[8]
            left, at = left + t[at:a], b
        assert got[i]["text"] == (None if t is None else left + t[at:])
        for n in seen:
            seen[n] |= w[n]
    assert sum(r["n_removed"] > 0 for r in got.values()) == len(later) + len(copies)
    assert got[len(rows) - 4]["text"] == ""  # a copy goes whole, what it repeats inside too


def test_windows_follow_the_plain_rule():
    rng = random.Random(12)
    words = lambda n, kinds: " ".join(rng.choices([f"w{i}" for i in range(kinds)], k=n))
    texts = ["", "a b", words(24, 99), words(49, 99), words(50, 99), words(400, 999), words(300, 2), "z " * 300, "p q r " * 90, *(words(rng.randint(0, 120), 50) for _ in range(30))]
    known = substring_dedup.Known()
    u = substring_dedup.windows_of(substring_dedup.read_words([t.encode() for t in texts], known), 24, 50)
    found = [[] for _ in texts]
    for row, a, b, x in zip(u.row, u.start, u.end, u.digest[0], strict=True):
        assert len(texts[row][a:b].split()) == 24
        found[row].append((len(texts[row][:a].split()), tuple(texts[row][a:b].split()), int(x)))
    kinds = {}
    for t, have in zip(texts, found, strict=True):
        n = len(t.split())
        assert bool(have) == (n >= 24)
        at = {j for j, _, _ in have}
        for j in range(max(0, n - 49)):  # of any 50 words, a window or one that equals it is there
            inside = {tuple(t.split()[k : k + 24]) for k in range(j, j + 27)}
            assert inside & {w for _, w, _ in have}
        for _, w, x in have:
            assert kinds.setdefault(w, x) == x
        assert len(at) == len(have) < max(3, n / 4) and (not have or {0, n - 24} <= at)
    assert len(set(kinds.values())) == len(kinds)
    assert all(0 < b[0] - a[0] <= 24 for a, b in zip(found[7][:-1], found[7][1:-1])) and len(found[7]) < 30  # one word over and over: thinned, still covered


def test_equal_lines_go_whole():
    rng = random.Random(7)
    line = " ".join(rng.choices([f"w{i}" for i in range(99)], k=200)) + " ...  - end"
    text = f"one line before it that nothing else repeats here\n{line}\n{line}"
    found = chunk_lists([text])[0]
    begin = text.index("\n") + 1
    for number, at in ((0, begin), (1, begin + len(line) + 1)):
        spans = [(a, b) for a, b, _, _ in found if at <= a < at + len(line) + 1]
        assert spans[0][0] == at and spans[-1][1] == at + len(line) + 1 - number
        assert len(spans) > 5 and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    half = (len(found) - 1) // 2
    assert [x[3] for x in found[1 : 1 + half]] == [x[3] for x in found[1 + half :]]
