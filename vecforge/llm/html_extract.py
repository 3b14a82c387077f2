"""HTML extraction: a linear-chain CRF over the leaf blocks of the DOM, decoded by Viterbi."""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecforge.llm import crf
from vecforge.llm.common import prepare

BUCKETS = 1 << 14
OTHER, CONTENT = 0, 1
#: Fixed values of HTML: elements that begin a block, have no end tag, whose content is no text, and
#: which open elements a start tag ends.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
SCOPE = frozenset("ul ol dl table select article section div main body html".split())

_markup = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_attr = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_token = re.compile(r"[a-z]+")


class Node:
    """An open element: what its leaves need to know of it and of its ancestors, carried down from its parent.

    ``inherited`` holds the ancestor features; elements that add none share their parent's set, so deep
    nesting costs no more than its distinct tags and names. ``key`` stands for the whole path.
    """

    __slots__ = ("tag", "names", "parent", "depth", "block", "main", "inherited", "key")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Node | None):
        self.tag, self.names, self.parent = tag, names, parent
        self.depth = 1 + (parent.depth if parent else 0)
        self.block = tag if tag in BLOCK else parent.block if parent else ""
        self.main = tag in ("article", "main") or bool(parent and parent.main)
        above = parent.inherited if parent else frozenset()
        own = {f"name:{x}" for x in names} | ({f"in:{tag}"} if tag not in ("html", "body") else set())
        self.inherited = above if own <= above else above | own
        self.key = hash((parent.key if parent else 0, tag, names))


@dataclass
class Leaf:
    """A run of text between block boundaries: its text, innermost open element and characters in links."""

    text: str
    node: Node | None
    linked: int


def _names(attrs: str) -> tuple[str, ...]:
    found: list[str] = []
    for m in _attr.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            found.append("hidden!")
        elif key != "style" and key != "aria-hidden":
            found += _token.findall(value)
    return tuple(found)


def leaves(page: str) -> list[Leaf]:
    """The leaf blocks of a page in order, with character references decoded and white space made one space."""
    out: list[Leaf] = []
    stack: list[Node] = []
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    links, at, raw, n = 0, 0, "", len(page)

    def flush() -> None:
        nonlocal links
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append(Leaf(text, stack[-1] if stack else None, links))
        parts.clear()
        links = 0

    def close(k: int) -> None:
        if any(e.tag in BLOCK for e in stack[k:]):
            flush()
        open_tags.subtract(e.tag for e in stack[k:])
        del stack[k:]

    while at < n:
        if raw:
            end = re.compile(rf"</{re.escape(raw)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else n
            raw = ""
            continue
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            text = page[at:lt]
            parts.append(text)
            if open_tags["a"]:
                links += len(text.strip())
        if lt == n:
            break
        m = _markup.match(page, lt)
        if not m:
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        ending, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if ending and not open_tags[tag]:
            if tag in BLOCK:
                flush()
            continue
        if ending:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in ("td", "th", "li") and tag not in BLOCK:
                    break
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCK:
            for k in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCK:
                    break
            for k in range(len(stack) - 1, -1, -1) if tag in ENDS else ():
                if stack[k].tag in ENDS[tag]:
                    close(k)
                    break
                if stack[k].tag in SCOPE and stack[k].tag != "table" or tag in ("li", "dt", "dd") and stack[k].tag == "table":
                    break
            flush()
        if tag in RAW and not attrs.rstrip().endswith("/"):
            raw = tag
        elif tag not in VOID and not attrs.endswith("/"):
            stack.append(Node(tag, _names(attrs), stack[-1] if stack else None))
            open_tags[tag] += 1
    flush()
    return out


def features(blocks: list[Leaf]) -> list[list[int]]:
    """Hashed ancestor and text features of each leaf."""
    out = []
    n = len(blocks)
    ident = functools.lru_cache(maxsize=None)(lambda s: crf.feature_id(s, BUCKETS))
    above = lambda x: x.node.parent.key if x.node and x.node.parent else 0
    for i, leaf in enumerate(blocks):
        words = leaf.text.split(" ")
        size = min(7, len(words).bit_length())
        link = int(4 * min(1.0, leaf.linked / max(1, len(leaf.text))))
        node = leaf.node
        own, block, parent = (node.tag, node.block, node.parent) if node else ("", "", None)
        f = {"bias", f"size:{size}", f"link:{link}", f"link:{link}:{size}", f"tag:{block}", f"own:{own}"}
        f |= node.inherited if node else set()
        f |= {f"near:{x}" for e in (node, parent) if e for x in e.names}
        f.add("ends:" + (leaf.text[-1] if not leaf.text[-1].isalnum() else "a"))
        f.add(f"depth:{min(6, node.depth if node else 0)}")
        if i == 0:
            f.add("first")
        if i == n - 1:
            f.add("last")
        if "©" in leaf.text or "copyright" in leaf.text[:200].lower():
            f.add("copyright")
        if i and above(blocks[i - 1]) == above(leaf):
            f.add("same")
        if not (node and node.main):
            f |= {f"out:{block}:{size}", f"out:link:{link}"}
        out.append([ident(x) for x in sorted(f)])
    return out


def _page(rng: random.Random) -> tuple[str, list[int]]:
    """An invented page with leaf labels in order."""
    vocabulary = ["".join(rng.choices("aeioustrnlhmdé", k=rng.randint(1, 9))) for _ in range(60)]
    labels: list[int] = []
    words = lambda a, b: " ".join(rng.choices(vocabulary, k=rng.randint(a, b))).capitalize()
    prose = lambda: words(*rng.choice([(1, 3), (3, 12), (10, 40), (30, 120)])) + rng.choice([".", ".", ".", "?", "!", ""])
    inline = lambda t: rng.choice([t, t, t, f"<b>{t}", f"<b>{t}</b>", f"{t} <a href='/x'>{words(1, 3)}</a> {words(1, 5)}", f"<em>{words(1, 2)}</em> {t}", f"{t}<br>{words(2, 6)}"])

    def leaf(tag: str, text: str, label: int, close: bool = True) -> str:
        labels.append(label)
        return f"<{tag}>{text}" + (f"</{tag.split()[0]}>" if close else "")

    def links(tag: str, n: int) -> str:
        return f"<{tag}><ul>" + "".join(leaf("li", f"<a href='/{i}'>{words(1, 3)}</a>", OTHER) for i in range(n)) + f"</ul></{tag.split()[0]}>"

    def boiler(where: str) -> str:
        kinds = {
            "top": [lambda: links(rng.choice(["nav", "nav class='menu'", "div class='navbar'", "div id='nav-menu'", "header"]), rng.randint(2, 8)), lambda: f"<header>{leaf('h1', words(1, 4), OTHER)}{leaf('p', words(2, 8), OTHER)}</header>", lambda: leaf(rng.choice(["div class='ad'", "div class='ads banner'", "div class='advert'", "div id='advertisement'", "div class='sponsored'", "div class='promo'"]), prose(), OTHER), lambda: leaf(rng.choice(["div class='notice'", "div class='cookie-notice'", "div id='cookie-banner'", "div class='alert'", "div role='alert'", "div class='consent'", "div class='breadcrumbs'"]), prose(), OTHER), lambda: f"<form><input>{leaf('button', words(1, 2), OTHER)}</form>"],
            "side": [lambda: f"<aside>{leaf('h3', words(1, 3), OTHER)}{leaf('p', prose(), OTHER)}</aside>", lambda: f"<div class='sidebar'>{leaf('h3', words(1, 3), OTHER)}{links('div', rng.randint(1, 5))}{leaf('p', prose(), OTHER)}</div>", lambda: links(rng.choice(["div class='related'", "div class='widget'", "aside class='sidebar'", "section class='recommended'", "div class='share'", "div class='social'"]), rng.randint(1, 5))],
            "end": [lambda: leaf("footer", rng.choice(["&copy; ", "Copyright ", "", "&copy; x.example.com &middot; "]) + prose(), OTHER), lambda: f"<footer>{leaf('p', prose(), OTHER)}{links('div', rng.randint(1, 4))}</footer>", lambda: f"<div class='footer'>{leaf('p', prose(), OTHER)}</div>", lambda: f"<div id='footer'>{leaf('span', prose(), OTHER)}</div>"],
        }
        return rng.choice(kinds[where])()

    def comments() -> str:
        box = rng.choice(["section class='comments'", "div id='comments'", "div class='comment-list'", "ol class='commentlist'", "div class='discussion'", "div id='disqus_thread'", "section id='responses'", "div class='replies'"])
        item = rng.choice(["div class='comment'", "li class='comment'", "article class='comment'", "div class='reply'"])
        body = "".join(f"<{item}>{leaf('p class=author', words(1, 2), OTHER)}{leaf('p', prose(), OTHER)}</{item.split()[0]}>" for _ in range(rng.randint(1, 5)))
        return f"<{box}>{leaf('h2', words(1, 2), OTHER)}{body}</{box.split()[0]}>"

    head = "<head><meta charset=utf-8>" + leaf("title", words(2, 9), OTHER) + "<style>p{margin:0}</style><script>var t='</p>';</script></head>"
    top = "".join(boiler("top") for _ in range(rng.randint(0, 4)))
    side = boiler("side") if rng.random() < 0.25 else ""
    box = rng.choice(["article"] * 5 + ["main", "div class='content'", "div class='post-content'", "div class='entry'", "div id='main-content'", "div class='article-body'", "section class='story'", "div class='text'", "main><article", "div class='page'><article", "div"])
    body = []
    if rng.random() < 0.8:
        body.append(leaf("h1", words(1, 12), CONTENT))
    for _ in range(rng.randint(1, 14)):
        kind = rng.random()
        if kind < 0.72:
            body.append(leaf("p", inline(prose()), CONTENT, rng.random() < 0.8))
        elif kind < 0.80:
            body.append(leaf(rng.choice(["h2", "h3"]), words(1, 8), CONTENT))
        elif kind < 0.86:
            body.append("<ul>" + "".join(leaf("li", inline(prose()), CONTENT) for _ in range(rng.randint(1, 4))) + "</ul>")
        elif kind < 0.89:
            body.append("<blockquote>" + leaf("p", prose(), CONTENT) + "</blockquote>")
        elif kind < 0.91:
            body.append(leaf("pre", prose(), CONTENT))
        elif kind < 0.93:
            body.append("<table>" + "".join("<tr>" + leaf("td", words(1, 4), CONTENT) + leaf("td", words(1, 4), CONTENT) + "</tr>" for _ in range(2)) + "</table>")
        elif kind < 0.95:
            body.append("<div>" + leaf("p", prose(), CONTENT) + "</div>")
        else:
            body.append(rng.choice([lambda: boiler("side"), lambda: leaf("div class='ad'", prose(), OTHER), lambda: leaf("div class='advert'", prose(), OTHER), lambda: leaf("div class='share-buttons'", words(1, 4), OTHER), lambda: leaf("div class='newsletter-signup'", prose(), OTHER)])())
    close = "".join(f"</{t.split()[0]}>" for t in reversed(box.split("><")))
    main = f"<{box}>" + "".join(body) + close
    tail = (comments() if rng.random() < 0.35 else "") + (boiler("side") if rng.random() < 0.3 else "") + (f"<form class='subscribe'>{leaf('p', prose(), OTHER)}</form>" if rng.random() < 0.15 else "") + "".join(boiler("end") for _ in range(rng.randint(0, 2)))
    return f"<!DOCTYPE html><html>{head}<body>{top}{side}{main}{tail}" + rng.choice(["</body></html>", "</body></html>", ""]), labels


@functools.lru_cache(maxsize=1)
def model(pages: int = 700, seed: int = 11) -> crf.Crf:
    """The tagger of leaves, trained on invented labelled pages; the same at every call."""
    rng, made = random.Random(seed), []
    while len(made) < pages:
        page, labels = _page(rng)
        blocks = leaves(page)
        if len(blocks) == len(labels):  # an inline element beside text may join two leaves
            made.append((features(blocks), labels))
    return crf.train(made, 2, BUCKETS, rounds=80)


def extract(page: str | None, m: crf.Crf) -> str:
    """The page's main text: the leaves tagged as content, one to a line."""
    blocks = leaves(page or "")
    if not blocks:
        return ""
    tags = m.viterbi(m.scores(features(blocks)))
    return "\n".join(b.text for b, t in zip(blocks, tags, strict=True) if t == CONTENT)


def _extract(m: crf.Crf):
    used = np.flatnonzero(np.abs(m.emit).sum(1))
    emit, size, move, start = m.emit[used], len(m.emit), m.move, m.start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = crf.Crf(np.zeros((size, len(start))), move, start)
        own.emit[used] = emit
        for batch in batches:
            texts = [extract(v.as_py(), own) for v in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    A null or empty html, or one without main text, gives an empty text. page_id and url pass as they
    are, null or not; repeated rows give equal results; extra columns are ignored; an empty table gives
    an empty one. Each page is parsed whole and by itself, so nothing is shuffled.
    """
    prepare(spark)
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(_extract(model()), "page_id long, url string, text string, n_chars long")
