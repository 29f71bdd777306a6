"""Operator 3, HTML extraction: the maximum-scoring contiguous region of a page.

A page is read as a sequence of words and tags.  A word scores the log-odds that its
block is main text, which is positive in text and negative in what surrounds it; a
tag scores negative, the more the rarer it is inside main text.  Both weights come
from labelled pages: a logistic model of a block's context (its enclosing elements,
the words and word parts of their class and id, the share of words in links and the
length, by the nearest sectioning element, whether the page has an article elsewhere)
and counts of tags.  One linear scan finds the contiguous region of largest score;
elements inside it that are learned to surround text are left out.  Parsing takes a
bounded number of steps a tag, however deep elements are nested.

The labelled pages (``labelled_pages``) are written by rules: kinds of layout, each
with the names that such elements carry, so that the labels are known exactly.

Text in svg elements is left out, that of math elements is kept; either may be
self-closing, or left open and ended by the next HTML tag that can't stand in it.
Blocks are cut at block-level tags and line breaks; character references are
decoded, white space in a block becomes one space, blocks are joined by one line
feed.  Null or empty html, and pages without positive blocks, give the empty text;
broken or cut-off markup is read as far as it goes; null and repeated ids keep a row
each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import fit_logistic

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<raw>script|style|noscript|template|iframe|object|select|textarea|title|audio|video|canvas)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[a-zA-Z/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""display\s*:\s*none|aria-hidden\s*=\s*["']?true|\shidden(?:[\s=>]|$)""", re.I)
_SPACE = re.compile(r"\s+")

# Fixed by the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noframes ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Start tags that end an svg or math element left open.
_BREAKS_OUT = (_BLOCK - {"title"}) | frozenset("b big code em embed i img listing meta nobr ruby s small span strong strike sub sup tt u var".split())
#: Elements of svg that hold HTML.
_HOLDS_HTML = frozenset(("foreignobject", "desc", "title"))
_CLOSES_P = _BLOCK - {"br", "button", "label", "body", "html", "head"}
_SECTIONS = frozenset("article main nav aside header footer form section dialog".split())
#: Characters of a class or id that are looked at; real ones are far shorter.
MOST_NAMES = 4096
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}


@dataclass
class Block:
    text: str
    words: int
    linked: int
    context: frozenset  # features of the enclosing elements
    section: str  # the nearest sectioning element
    tags: list  # tags between the block before and this one


def _features(tag: str, attrs: str) -> frozenset:
    """An element's name, and the words and word parts of its class, id and role."""
    found = {f"<{tag}>"}
    for m in _NAMES.finditer(attrs):
        names = next(g for g in m.groups() if g is not None)[:MOST_NAMES]
        for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower()):
            if w:
                found.add(f".{w}")
                found |= {f"~{w[k : k + 4]}" for k in range(len(w) - 3)}
    if _HIDDEN.search(attrs):
        found.add(".hidden")
    return frozenset(found)


def _end_of_svg(page: str, at: int) -> int:
    """Where the svg element whose content begins at ``at`` ends: after its end tag, or before the HTML that shows it was left open."""
    depth, holders = 1, 0
    left: int | None = None
    for m in _MARKUP.finditer(page, at):
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag in _HOLDS_HTML:
            if m["end"]:
                holders = max(0, holders - 1)
            elif not m["attrs"].endswith("/"):
                holders += 1
        elif tag == "svg":
            if m["end"]:
                depth -= 1
                if not depth:
                    return m.end()
            elif not m["attrs"].endswith("/"):
                depth += 1
        elif tag in (_BLOCK if m["end"] else _BREAKS_OUT):
            if not holders:
                return m.start()
            left = m.start() if left is None else left
    return len(page) if left is None else left


def _tokens(page: str) -> Iterator[re.Match]:
    """The page's tokens; what stands in svg elements is left out."""
    at: int | None = 0
    while at is not None:
        begin, at = at, None
        for m in _TOKEN.finditer(page, begin):
            yield m
            if m["tag"] and not m["end"] and m["tag"].lower() == "svg" and not m["attrs"].endswith("/"):
                at = _end_of_svg(page, m.end())
                break


class Elements:
    """The open elements.  Every tag costs a bounded number of steps, but for what it closes."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, frozenset]] = []
        self.places: dict[str, list[int]] = {}  # by tag, from the outermost
        self.blocks: list[int] = []  # places of block-level elements
        self.sections: list[tuple[int, str]] = [(-1, "none")]
        self.features: Counter = Counter()
        self.known: frozenset | None = frozenset()

    def push(self, tag: str, features: frozenset) -> None:
        if tag in _SECTIONS:
            features = features | {f"{self.sections[-1][1]}>{tag}"}
            self.sections.append((len(self.stack), tag))
        if tag in _BLOCK:
            self.blocks.append(len(self.stack))
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, features))
        self.features.update(features)
        self.known = None

    def cut(self, size: int) -> None:
        """Close all elements but the outermost ``size``."""
        while len(self.stack) > size:
            tag, features = self.stack.pop()
            self.places[tag].pop()
            if tag in _BLOCK:
                self.blocks.pop()
            if self.sections[-1][0] == len(self.stack):
                self.sections.pop()
            for f in features:
                self.features[f] -= 1
                if not self.features[f]:
                    del self.features[f]
            self.known = None

    def last(self, tags) -> int:
        """The place of the innermost of these elements, else -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def before(self, tag: str) -> None:
        """Close what a start tag of this name closes by itself."""
        if tag in _CLOSES_P and self.blocks and self.stack[self.blocks[-1]][0] == "p":
            self.cut(self.blocks[-1])
        if tag in _SAME:
            same = self.last(_SAME[tag])
            if same > self.last(_BARRIER[tag]):
                self.cut(same)

    def context(self) -> frozenset:
        if self.known is None:
            self.known = frozenset(self.features)
        return self.known


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order, with what encloses them."""
    elements = Elements()
    out: list[Block] = []
    text: list[str] = []
    tags: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        joined = _SPACE.sub(" ", "".join(text)).strip()
        text.clear()
        if joined:
            out.append(Block(joined, joined.count(" ") + 1, linked, elements.context(), elements.sections[-1][1], tags.copy()))
            tags.clear()
        linked = 0

    for m in _tokens(page):
        if m["text"] is not None:
            piece = html.unescape(m["text"])
            text.append(piece)
            if elements.places.get("a"):
                linked += len(piece.split())
            continue
        if m["raw"] is not None:
            tags.append(m["raw"].lower())
            if m["raw"].lower() in ("title", "select", "textarea"):
                close()
            continue
        if m["tag"] is None:
            continue
        tag, empty = m["tag"].lower(), m["attrs"].endswith("/")
        if tag == "svg":
            tags += [] if m["end"] else ["svg"]
            continue
        formulas = elements.places.get("math")
        if formulas and tag in (_BLOCK if m["end"] else _BREAKS_OUT):
            elements.cut(formulas[0])
            formulas = None
        if tag == "math" and not m["end"]:
            tags.append("math")
            if not empty:
                elements.push("math", frozenset())
            continue
        if formulas:
            # A formula's text is kept, its markup isn't counted.
            if tag == "math":
                elements.cut(formulas[-1])
            continue
        if tag in _BLOCK:
            close()
        tags.append(tag)
        if m["end"]:
            if elements.places.get(tag):
                elements.cut(elements.places[tag][-1])
            continue
        if tag in _VOID:
            continue
        elements.before(tag)
        if not empty:
            elements.push(tag, _features(tag, m["attrs"]))
    close()
    return out


def block_features(page: list[Block]) -> list[set[str]]:
    """What is known of each block: its enclosing elements, its links and length, and whether the page has its article elsewhere."""
    total = sum(b.words for b in page)
    share = {tag: sum(b.words for b in page if f"<{tag}>" in b.context) / max(total, 1) for tag in ("article", "main")}
    out = []
    for b in page:
        linked, length = min(3, int(b.linked / b.words * 4)), min(5, int(np.log2(b.words)))
        found = {*b.context, f"linked{linked}", f"words{length}", f"{b.section}&linked{linked}", f"{b.section}&words{length}", f"in:{b.section}"}
        found |= {f"outside:{tag}{int(share[tag] * 4)}" for tag in share if share[tag] and f"<{tag}>" not in b.context}
        out.append(found)
    return out


# Labelled pages, by rule ---------------------------------------------------------------------------------------------------

#: Names that elements of a kind carry: content first, then what surrounds it.
CONTENT_NAMES = ["content", "article", "article body", "post", "post content", "post body", "entry content", "main", "main content", "story", "story body", "text", "body", "page content", "prose", "markdown", "single post", "hentry"]
AROUND = {
    "menu": (["nav", "div", "ul", "header"], ["nav", "menu", "navbar", "navigation", "topbar", "breadcrumb", "breadcrumbs", "main menu", "site nav", "toc", "pagination", "pager", "tabs", "skip link", "tags"]),
    "header": (["header", "div", "section"], ["header", "site header", "masthead", "banner", "logo", "branding", "top", "hero bar", "page header", "site title", "tagline"]),
    "footer": (["footer", "div", "section"], ["footer", "site footer", "copyright", "legal", "bottom", "colophon", "page footer", "contact", "imprint"]),
    "sidebar": (["aside", "div", "section"], ["sidebar", "side bar", "aside", "widget", "widgets", "related", "related posts", "recommended", "popular", "trending", "more stories", "author box", "rail", "secondary"]),
    "notice": (["div", "section", "aside", "dialog"], ["notice", "cookie", "cookie banner", "cookie bar", "consent", "gdpr", "alert", "popup", "modal", "overlay", "message", "privacy", "paywall", "warning", "info bar", "disclaimer"]),
    "advert": (["div", "aside", "ins", "section"], ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner ad", "ad slot", "adbox", "adsbygoogle", "teaser", "partner"]),
    "form": (["form", "div", "section"], ["form", "search", "search form", "newsletter", "subscribe", "signup", "sign up", "login", "contact form", "poll", "feedback"]),
    "share": (["div", "ul", "section"], ["share", "sharing", "social", "social links", "share buttons", "follow", "toolbar", "actions", "meta"]),
    "comments": (["section", "div", "ol", "ul", "article", "aside"], ["comments", "comment", "comment list", "reader comments", "respond", "reply", "replies", "discussion", "disqus", "responses", "user comments", "user notes", "feedback list", "reviews", "guestbook", "opinions", "thread"]),
}


def labelled_pages(number: int = 700, seed: int = 7) -> Iterator[list[tuple[str, bool | None]]]:
    """Pages as pieces of html, each with whether its words are main text (None: markup alone)."""
    rnd = random.Random(seed)
    words = lambda n: " ".join("".join(rnd.choice("aeioubcdlmnprst") for _ in range(rnd.randint(1, 9))) for _ in range(n))
    name = lambda names: rnd.choice([f' class="{c}"' if rnd.random() < 0.75 else f' id="{c}"' for c in [rnd.choice(["-", "_", " "]).join(rnd.choice(names).split())]])

    def around(kind: str) -> list[tuple[str, bool | None]]:
        tags, names = AROUND[kind]
        tag = rnd.choice(tags)
        natural = tag in ("nav", "footer", "aside", "form", "header", "dialog")
        attrs = name(names) if not natural or rnd.random() < 0.6 else ""
        inner: list[tuple[str, bool | None]] = []
        if kind in ("menu", "share") or (kind in ("sidebar", "footer", "header") and rnd.random() < 0.6):
            items = "".join(f'<li><a href="/{words(1)}">{words(rnd.randint(1, 4))}</a></li>' for _ in range(rnd.randint(2, 8)))
            inner.append((items if tag == "ul" else f"<ul>{items}</ul>", False))
        if kind in ("header", "footer", "sidebar"):
            inner.append((f"<{(t := rnd.choice(['p', 'div', 'span', 'h3', 'h1']))}>{words(rnd.randint(2, 14))}</{t}>", False))
        if kind in ("notice", "advert"):
            inner.append((words(rnd.randint(3, 30)) if rnd.random() < 0.5 else f"<p>{words(rnd.randint(3, 45))}</p>", False))
        if kind == "form":
            inner.append((f"<label>{words(2)}</label><input><p>{words(rnd.randint(2, 20))}</p><button>{words(1)}</button>", False))
        if kind == "comments":
            for _ in range(rnd.randint(1, 5)):
                t = rnd.choice(["li", "div", "article"]) if tag not in ("ul", "ol") else "li"
                inner.append((f"<{t}{name(['comment', 'comment body', 'reply', 'review', 'response', 'user note', 'remark', 'opinion', 'post reply', 'usercomment'])}><b>{words(1)}</b><p>{words(rnd.randint(4, 60))}</p></{t}>", False))
        return [(f"<{tag}{attrs}>", None), *inner, (f"</{tag}>", None)]

    for _ in range(number):
        page: list[tuple[str, bool | None]] = [("<html><body>", None)]
        for kind in rnd.sample(["notice", "header", "menu", "advert", "form"], rnd.randint(1, 4)):
            page += around(kind)
        wrap = rnd.choice(["div", "main", "section", "", "", ""])
        page.append((f"<{wrap}{name(['container', 'wrapper', 'page', 'layout', 'row', 'site', 'inner', 'main', 'primary', 'col'])}>" if wrap == "div" else f"<{wrap}>" if wrap else "", None))
        style = rnd.random()
        tag = "article" if style < 0.4 else "main" if style < 0.55 else "" if style < 0.67 else rnd.choice(["div", "section", "td"])
        attrs = name(CONTENT_NAMES) if tag in ("div", "section") and rnd.random() < 0.9 or rnd.random() < 0.4 else ""
        page.append((f"<{tag}{attrs}>" if tag else "", None))
        if rnd.random() < 0.7:
            head = f"<h1>{words(rnd.randint(2, 12))}</h1>"
            page.append((f"<header>{head}</header>" if rnd.random() < 0.15 else head, True))
        for _ in range(rnd.randint(1, 12)):
            t = rnd.random()
            if rnd.random() < 0.12:  # text that is mostly links
                link = f'<a href="/{words(1)}">{words(rnd.randint(1, 6))}</a>'
                page.append((rnd.choice([f"<p>{link}</p>", f"<p>{words(1)} {link}</p>", f"<p>{words(2)} {link} {link}</p>", f"<ul>{''.join(f'<li>{link}</li>' for _ in range(rnd.randint(2, 5)))}</ul>"]), True))
            if t < 0.75:
                inner = words(rnd.randint(1, 120))
                if rnd.random() < 0.3:
                    inner += f' <a href="/x">{words(rnd.randint(1, 4))}</a> {words(rnd.randint(1, 20))}'
                page.append((rnd.choice([f"<p>{inner}</p>", f"<p>{inner}</p>", f"<div>{inner}</div>", f"<p><b>{inner}<br>", f"<p>{inner}"]), True))
            elif t < 0.85:
                page.append((f"<h2>{words(rnd.randint(1, 8))}</h2>", True))
            elif t < 0.92:
                page.append((f"<ul>{''.join(f'<li>{words(rnd.randint(1, 25))}</li>' for _ in range(rnd.randint(2, 6)))}</ul>", True))
            elif t < 0.94:
                page.append((f"<section><h2>{words(rnd.randint(1, 6))}</h2><p>{words(rnd.randint(3, 80))}</p><p>{words(rnd.randint(3, 80))}</p></section>", True))
            elif t < 0.97:
                page.append((f"<blockquote><p>{words(rnd.randint(3, 50))}</p></blockquote>", True))
            else:
                page.append((f"<table><tr><td>{words(3)}</td><td>{words(2)}</td></tr></table>", True))
            if rnd.random() < 0.12:
                page += around(rnd.choice(["advert", "form", "share", "sidebar", "notice", "footer"]))
        if rnd.random() < 0.2:
            page += around("comments")
        outside = rnd.random() < 0.5  # what follows stands in the wrapper, too
        page.append(((f"</{tag}>" if tag else "") + (f"</{wrap}>" if wrap and not outside else ""), None))
        for kind in rnd.sample(["sidebar", "comments", "share", "advert", "form", "menu"], rnd.randint(0, 4)) + ["footer"] * (rnd.random() < 0.9):
            page += around(kind)
        page.append((f"</{wrap}>" if wrap and outside else "", None))
        page.append(("</body></html>", None))
        yield page


@dataclass
class Weights:
    blocks: dict[str, float]
    base: float
    tags: dict[str, float]
    other_tag: float

    def odds(self, features: set[str]) -> float:
        """Log-odds that a block is main text."""
        return self.base + sum(self.blocks.get(f, 0.0) for f in features)


@lru_cache(maxsize=2)
def fit_weights(number: int = 500, seed: int = 7) -> Weights:
    """Learn the weights of words and tags from labelled pages."""
    rows: list[tuple[set[str], bool]] = []
    inside, outside = Counter(), Counter()
    for page in labelled_pages(number, seed):
        # Labels ride on the text itself: a mark that no word of the page has.
        marked = "".join(re.sub(r">([^<]+)", lambda m, y=y: f">{'⁑' if y else '⁂'}{m[1]}", f">{piece}")[1:] if y is not None else piece for piece, y in page)
        marked = re.sub(r"(<(?:div|aside|ins|section|dialog)\b[^>]*>)([^<⁂⁑]+)", r"\1⁂\2", marked)
        found = blocks_of(marked)
        for block, features in zip(found, block_features(found), strict=True):
            main = "⁑" in block.text
            rows.append((features, main))
            (inside if main else outside).update(block.tags)
    often = Counter(f for found, _ in rows for f in found)
    names = sorted(f for f, n in often.items() if n >= 8)
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, (found, _) in enumerate(rows):
        x[i, [place[f] for f in found if f in place]] = 1
    model = fit_logistic(x, np.array([y for _, y in rows], float), 0.5, ridge=2.0, tolerance=1e-3)
    weights = model.weights[:-1] / model.scale
    base = float(model.weights[-1] - (weights * model.mean).sum())
    total_in, total_out = sum(inside.values()), sum(outside.values())
    rarity = {t: float(np.log((outside[t] + 1) / total_out * total_in / (inside[t] + 1))) for t in inside | outside}
    tags = {t: -max(0.05, 0.5 * r) for t, r in rarity.items()}
    return Weights({f: float(w) for f, w in zip(names, weights, strict=True)}, base, tags, -0.5)


def best_region(blocks: list[Block], odds: list[float], weights: Weights) -> tuple[int, int]:
    """(first, end) of the contiguous blocks of largest score, in one scan."""
    best, found = 0.0, (0, 0)
    run, start = 0.0, 0
    for k, (block, odd) in enumerate(zip(blocks, odds, strict=True)):
        run += sum(weights.tags.get(t, weights.other_tag) for t in block.tags) if run > 0 else 0.0
        if run <= 0:
            run, start = 0.0, k
        # Words of text score positive; an element that surrounds text costs little, so that the scan passes it to more text beyond.
        run += block.words * min(odd, 4.0) if odd > 0 else max(odd, -4.0) * min(block.words, 4) / 4
        if run > best:
            best, found = run, (start, k + 1)
    return found


def extract(page: str, weights: Weights) -> str:
    """The main text: the region of largest score, less the elements in it that are learned to surround text."""
    blocks = blocks_of(page)
    odds = [weights.odds(f) for f in block_features(blocks)]
    first, end = best_region(blocks, odds, weights)
    return "\n".join(b.text for b, odd in zip(blocks[first:end], odds[first:end], strict=True) if odd > 0)


def main_text(pages: DataFrame, weights: Weights | None = None, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each page."""
    learned = weights or fit_weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p, learned) if p else "" for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["id", "url", "text", "n_chars"])

    slim = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    types = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    return slim.mapInArrow(run, f"id {types['id']}, url {types['url']}, text string, n_chars long").withColumnsRenamed({"id": id_column, "url": url_column})
