"""Secret scans: base patterns, and a linear-chain CRF that tags tokens as secret begin, inside or outside."""

from __future__ import annotations

import base64
import functools
import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecforge.llm import crf
from vecforge.llm.common import WORD, Vocabulary, prepare, raw

#: The base kinds in their order; the method's own spans come after them.
KINDS = ("assign", "access", "hex", "crf")
_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_access = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run too short for this has no later match either
_hex = re.compile(r"[0-9a-f]{16,}")
_word = re.compile(WORD)

BUCKETS = 1 << 14
OUT, BEGIN, INSIDE = 0, 1, 2
#: Words of names that secrets are given (fixed values).
NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "credential", "auth", "bearer", "private", "access", "key", "passphrase")
#: Beginnings that issuers give their secrets (fixed values).
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_live_", "pk_live_", "xoxb-", "xoxp-", "eyJ", "AIza", "glpat-", "SG.")
_plain = re.compile(rb"[A-Za-z\x80-\xff]{1,15}[.,;:!?]{0,2}").fullmatch
_runs = re.compile(r"([a-z]+)|([A-Z]+)|([0-9]+)|([^\W\d_]+)|(.)", re.S)
_edges = re.compile(r"^[^A-Za-z0-9+/_-]+|[^A-Za-z0-9+/_=-]+$")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start and then kind; offsets are code points."""
    found = [("assign", *m.span()) for m in _assign.finditer(text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in _access.finditer(text)] if "AKIA" in text else []
    found += [("hex", *m.span()) for m in _hex.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def word_features(word: bytes) -> tuple[list[str], list[str]]:
    """(features of a token itself, those it has as a neighbour)."""
    if _plain(word):
        core = word.rstrip(b".,;:!?").lower().decode("utf-8", "replace")
        kind = f"name={core}" if core in NAMES else "plain"
        return [kind, "ends:" + str(word[-1:] in b".:")], [kind]
    text = word.decode("utf-8", "replace")
    low = text.lower()
    core = _edges.sub("", text)
    runs = [m.lastindex for m in _runs.finditer(core[:200])]
    digits, n = sum(c.isdigit() for c in core), len(core)
    size = min(6, n.bit_length())
    if not n:
        kind = "sign=" + text[:2]
    elif digits == n:
        kind = "digits"
    elif "@" in core or "://" in core:
        kind = "address"
    elif re.fullmatch(r"[0-9.,:/+-]+", core):
        kind = "number"
    elif re.fullmatch(r"[0-9a-fA-F]+", core) and n >= 12:
        kind = "hex"
    elif re.fullmatch(r"[A-Za-z0-9+/_.=-]+", core) and digits and len(runs) * 4 >= min(n, 200):
        kind = "mixed"
    elif "=" in text[:-1] or ":" in text[:-1]:
        kind = "pair"
    elif any(x in low for x in NAMES):
        kind = "name"
    elif text.isupper():
        kind = "upper"
    else:
        kind = "other"
    own = [f"{kind}:{size}", f"runs:{min(9, len(runs))}:{size}", "shape:" + "".join("aA9u."[r - 1] for r in runs[:6]), f"digits:{digits * 4 // max(1, n)}:{size}", f"kind={kind}"]
    own += [f"prefix:{p}" for p in PREFIXES if core.startswith(p)]
    if "=" in text[1:-1]:
        name, _, value = low.partition("=")
        own += ["named"] if any(x in name for x in NAMES) and len(value) >= 8 else ["unnamed"]
    if text[0] in "\"'" and n >= 8:
        own.append(f"quoted:{kind}:{size}")
    if "-----" in text:
        own.append("fence")
    near = [f"kind={kind}"] + ["name~"] * any(x in low for x in NAMES) + ["fence"] * ("-----" in text) + ["gives"] * (text[-1] in ":=")
    return own, near


def file_features(kinds: dict[str, int], n: int) -> list[str]:
    """Features that all tokens of a file share, from how many of its tokens are what."""
    share = lambda k: int(10 * kinds.get(k, 0) / max(1, n))
    return [f"file:code:{min(3, share('code'))}", f"file:digits:{min(3, share('digit'))}", f"file:short:{n < 20}"]


def word_kind(word: bytes) -> str:
    if _plain(word):
        return "plain"
    if word[-1:] in b"{}()=;<>":
        return "code"
    return "digit" if any(48 <= b < 58 for b in word) else "other"


def token_features(words: list[bytes]) -> list[list[int]]:
    """The hashed features of each token of a file."""
    own, near = zip(*map(word_features, words), strict=True) if words else ((), ())
    kinds: dict[str, int] = {}
    for w in words:
        k = word_kind(w)
        kinds[k] = kinds.get(k, 0) + 1
    file = [crf.feature_id(f, BUCKETS) for f in file_features(kinds, len(words))]
    side = lambda tag, i: [crf.feature_id(f"{tag}:{f}", BUCKETS) for f in (near[i] if 0 <= i < len(words) else ["none"])]
    return [[crf.feature_id(f"o:{f}", BUCKETS) for f in own[i]] + side("p", i - 1) + side("q", i - 2) + side("n", i + 1) + file for i in range(len(words))]


def _sample(rng: random.Random) -> tuple[list[bytes], list[int]]:
    """An invented file: words with harmless oddities and planted secrets, and its labels."""
    letters = lambda a, n: "".join(rng.choices(a, k=n))
    alnum = string.ascii_letters + string.digits
    value = lambda: rng.choice([lambda: letters("0123456789abcdef", rng.choice([24, 32, 40, 64])), lambda: letters(alnum, rng.randint(14, 48)), lambda: letters(alnum + "+/", rng.randint(20, 60)) + "==", lambda: letters(alnum + "_-", rng.randint(16, 40)), lambda: rng.choice(["ghp_", "sk-", "sk_live_", "xoxb-", "glpat-", "AIza"]) + letters(alnum, rng.randint(20, 36)), lambda: "eyJ" + letters(alnum, 20) + "." + letters(alnum, 30) + "." + letters(alnum, 20), lambda: letters(string.ascii_letters, 6) + letters(string.digits, 5) + letters(string.ascii_lowercase, 6)])()
    quote = lambda v: rng.choice([f'"{v}"', f"'{v}'", v, f'"{v}",', f'"{v}";'])
    plain = lambda: letters("aeioustrnlhéèñüö", rng.randint(1, 13)) + rng.choice([""] * 8 + [".", ",", ";"])
    name = lambda: rng.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "API_KEY", "Token", "access_token", "client_secret", "AWS_SECRET_ACCESS_KEY", "db_password", "auth"])
    number = lambda: rng.choice([letters(string.digits, rng.choice([1, 2, 4, 10, 16])), ".".join(str(rng.randint(1, 255)) for _ in range(4)), f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.", f"20{rng.randint(10, 29)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", f"(5{rng.randint(10, 99)})", f"555-{rng.randint(1000, 9999)}", "+1"])
    odd = lambda: rng.choice([lambda: letters(string.ascii_lowercase, rng.randint(2, 8)) + rng.choice(["%%%", "***", "###", "$$$", "&&&", ",&&&", ".%%%"]), lambda: letters(string.ascii_uppercase, rng.randint(1, 14)) + rng.choice(["!!", ".!!", ""]), lambda: "|", lambda: f"{letters(string.ascii_lowercase, 6)}.{rng.randint(0, 99)}@mail{rng.randint(0, 9)}.example.com", lambda: f"https://{letters(string.ascii_lowercase, 8)}.example.org/{letters(string.ascii_lowercase, 6)}?{letters(string.ascii_lowercase, 3)}={rng.randint(0, 999)}", number, number, lambda: letters(string.ascii_lowercase, rng.randint(16, 40)), lambda: letters(string.ascii_lowercase, 5) + "-" + letters(string.ascii_lowercase, 5), lambda: rng.choice(["=", ":", "-", "=="]), lambda: f"{letters(string.ascii_lowercase, 4)}={rng.randint(0, 99)}", lambda: letters(string.ascii_lowercase, 4) + "_" + letters(string.ascii_lowercase, 5) + "();", name, lambda: name() + rng.choice([".", ",", ":"]), lambda: "#" + letters(string.ascii_lowercase, 5), lambda: letters(string.ascii_lowercase, 4).title() + letters(string.ascii_lowercase, 4).title()])()
    words, tags = [], []

    def put(*parts: tuple[str, int]) -> None:
        for w, t in parts:
            words.append(w.encode())
            tags.append(t)

    for _ in range(rng.randint(3, 16)):
        put(*((plain(), OUT) for _ in range(rng.randint(0, 5))))
        put(*((odd(), OUT) for _ in range(rng.choice([0, 0, 1, 1, 3]))))
        what = rng.random()
        noise = rng.choice(["", "", "", "###", "***", "%%%"])
        if what < 0.12:
            put((name(), OUT), (rng.choice(["=", ":", ":="]), OUT), (quote(value()) + noise, BEGIN))
        elif what < 0.18:
            put((name() + ":", OUT), (quote(value()), BEGIN))
        elif what < 0.24:
            put((rng.choice(["", "export_", "--"]) + name() + "=" + quote(value()), BEGIN))
        elif what < 0.28:
            put(("Authorization:", OUT), ("Bearer", OUT), (value(), BEGIN))
        elif what < 0.33:
            put((rng.choice(["AKIA", "ASIA"]) + letters(string.ascii_uppercase + string.digits, 16), BEGIN))
        elif what < 0.36:
            put((rng.choice(["ghp_", "sk_live_", "xoxb-", "glpat-"]) + letters(alnum, rng.randint(20, 36)), BEGIN))
        elif what < 0.39:
            put(("-----BEGIN", OUT), ("RSA", OUT), ("PRIVATE", OUT), ("KEY-----", OUT))
            put(*((base64.b64encode(rng.randbytes(36)).decode(), INSIDE if i else BEGIN) for i in range(rng.randint(2, 5))))
            put(("-----END", OUT), ("RSA", OUT), ("PRIVATE", OUT), ("KEY-----", OUT))
    if not words:
        put((plain(), OUT))
    return words, tags


@functools.lru_cache(maxsize=1)
def model(files: int = 400, seed: int = 7) -> crf.Crf:
    """The tagger, trained on invented files with planted secrets; the same at every call."""
    rng = random.Random(seed)
    made = [_sample(rng) for _ in range(files)]
    return crf.train([(token_features(w), t) for w, t in made], 3, BUCKETS, rounds=60)


class Tagger:
    """Exact Viterbi decoding that skips what can't matter.

    A token must be outside in the best path if, whatever its neighbours are, no gain in transitions
    makes up for how much its features favour outside. Only the runs between such tokens are decoded.
    """

    def __init__(self, m: crf.Crf):
        self.m = m
        gain_in = np.maximum((m.move - m.move[:, [OUT]]).max(0), m.start - m.start[OUT])
        gain_out = np.maximum((m.move - m.move[[OUT], :]).max(1), 0)
        self.slack = gain_in + gain_out
        weigh = lambda tag, f: m.emit[crf.feature_id(f"{tag}:{f}", BUCKETS)]
        self.weigh = functools.lru_cache(maxsize=50_000)(weigh)
        self.none = {t: weigh(t, "none") for t in "pqn"}
        self.file = functools.lru_cache(maxsize=1000)(lambda fs: sum(m.emit[crf.feature_id(f, BUCKETS)] for f in fs))
        own, near = word_features(b"plain")
        self.plain: dict[tuple, np.ndarray] = {}

    def rows(self, word: bytes) -> np.ndarray:
        """(4, 3): the word's scores for itself, and for the word after, the second after, and the one before."""
        own, near = word_features(word)
        key = (tuple(own), tuple(near))
        got = self.plain.get(key)
        if got is None:
            got = np.stack([sum((self.weigh("o", f) for f in own), np.zeros(3)), *(sum((self.weigh(t, f) for f in near), np.zeros(3)) for t in "pqn")])
            if len(self.plain) < 50_000:
                self.plain[key] = got
        return got

    def __call__(self, texts: list[bytes]) -> list[list[tuple[int, int]]]:
        """For each text, (first, last) token of each secret."""
        known = Vocabulary()
        ids = [np.array([known[w] for w in t.split()], np.int64) for t in texts]
        if not known.words:
            return [[] for _ in texts]
        table = np.stack([self.rows(w) for w in known.words])
        kind = np.array([("plain", "code", "digit", "other").index(word_kind(w)) for w in known.words])
        out: list[list[tuple[int, int]]] = []
        for x in ids:
            if not len(x):
                out.append([])
                continue
            counts = np.bincount(kind[x], minlength=4)
            s = table[x, 0] + self.file(tuple(file_features({"code": int(counts[1]), "digit": int(counts[2])}, len(x))))
            s[1:] += table[x[:-1], 1]
            s[0] += self.none["p"]
            s[2:] += table[x[:-2], 2]
            s[:2] += self.none["q"]
            s[:-1] += table[x[1:], 3]
            s[-1] += self.none["n"]
            open_ = np.flatnonzero((s[:, [OUT]] - s[:, 1:] <= self.slack[1:]).any(1))
            out.append(self.spans(s, open_))
        return out

    def spans(self, s: np.ndarray, open_: np.ndarray) -> list[tuple[int, int]]:
        found: list[tuple[int, int]] = []
        if not len(open_):
            return found
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            a, b = int(run[0]), int(run[-1])
            tags = self.m.viterbi(s[a : b + 1], self.m.start if a == 0 else self.m.move[OUT], self.m.move[:, OUT] if b + 1 < len(s) else None)
            for i, t in enumerate(tags, a):
                if t == BEGIN or t == INSIDE and not (found and found[-1][1] == i - 1):
                    found.append((i, i))
                elif t == INSIDE:
                    found[-1] = (found[-1][0], i)
        return found


def token_spans(text: str, tokens: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Offsets of runs of tokens, without the quotes and signs around them."""
    if not tokens:
        return []
    at = [m.span() for m in _word.finditer(text)]
    out = []
    for a, b in tokens:
        lo, hi = at[a][0], at[b][1]
        cut = _edges.sub("", text[lo:hi])
        lo = text.index(cut, lo) if cut else lo
        if cut:
            out.append(("crf", lo, lo + len(cut)))
    return out


def _scan(m: crf.Crf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(m)
        for batch in batches:
            spans: list[list[dict]] = []
            texts: list[bytes] = []
            size = 0

            def flush() -> None:
                for t, tokens in zip(texts, tagger(texts), strict=True):  # noqa: B023
                    s = t.decode("utf-8", "replace")
                    found = sorted(base_spans(s) + token_spans(s, tokens), key=lambda x: (x[1], KINDS.index(x[0])))
                    spans.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in found])  # noqa: B023
                texts.clear()  # noqa: B023

            for v in batch.column("text"):
                texts.append(raw(v))
                size += len(texts[-1])
                if size >= 4 << 20:
                    flush()
                    size = 0
            flush()
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], [*batch.schema.names, "spans"])

    return run


def scan(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """``docs`` with spans: an array of (kind, start, end) of every secret in its text (replaced if there already).

    Offsets are code points, ends exclusive; kinds are assign, access, hex (patterns) and crf. A null or
    empty text has none. Each row is scanned by itself and whole, so repeated rows agree; nothing is
    shuffled. An empty table gives an empty one.
    """
    prepare(spark)
    docs = docs.drop("spans")
    from pyspark.sql import types as T

    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    return docs.mapInArrow(_scan(model()), T.StructType([*docs.schema.fields, T.StructField("spans", span)]))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    line = lambda spans: ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in spans)
    for batch in batches:
        found = batch.column("spans").to_pylist()
        base = [[x for x in s if x["kind"] != "crf"] for s in found]
        counts = [pa.array([sum(x["kind"] == k for x in s) for s in base], pa.int64()) for k in KINDS[:3]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array([hashlib.sha256(line(s).encode()).hexdigest() for s in base]), pa.array([line(s) for s in found], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from :func:`scan`'s."""
    return scanned.select(F.col("doc_id").cast("long").alias("doc_id"), "spans").mapInArrow(_digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _redact(mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                t, at, parts = text.as_py(), 0, []
                for x in spans.as_py() or []:
                    if x["end"] > at:
                        if x["start"] >= at:
                            parts += [t[at : x["start"]], mark]
                        at = x["end"]
                out.append(t if not parts else "".join([*parts, t[at:]]))
            names = [n for n in batch.schema.names if n != "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in names], names)

    return run


def redact(scanned: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The scanned rows with each secret's characters replaced by ``mark``, without spans."""
    return scanned.mapInArrow(_redact(mark), scanned.drop("spans").schema)
