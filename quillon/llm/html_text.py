"""Main text of web pages by two-pass block rules.

Pass 1 labels each block by its own length, link density and stop-word density: long blocks with many stop words and few links are text, blocks of links are not, all others
are ambiguous. Stop words are the page's own most frequent words, so that the rules hold for any language (for scripts without spaces, characters are words). Pass 2
gives ambiguous blocks the label of their nearest decided neighbour, where leaving and entering containers makes a neighbour farther away.

Prose that is no part of the article (adverts, notices, comments) has the densities of text; what its container is tells it apart: an element such as footer, or a
name, which counts only if that container does not hold most of the page's text by pass 1. Likewise, where an article or main element holds most of it, the
rest of the page is left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .util import in_batches

#: A quote belongs to a value after = alone; elsewhere in a tag it is a character like others.
_PART = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|title|textarea|noscript|template|svg|iframe|select|button)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][a-zA-Z0-9-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿]|\w+")
#: Elements inside of a line; any other one ends a block.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Containers, and those of them that are no part of an article by what they are. A form may be, as may what has one of the names below: if most of the text is in it.
_BOX = frozenset("article main section div nav aside footer header form ul ol dl table figure blockquote head dialog menu".split())
_APART = frozenset("nav aside footer head dialog menu".split())
#: Names of containers that are no part of an article, and words that may stand beside one of these in a name.
_NAMES = frozenset("ad ads advert adverts advertisement advertising banner sidebar menu nav navbar navigation footer header masthead cookie cookies consent notice popup modal newsletter subscribe subscription promo promotion sponsor sponsored comment comments disqus respond replies sharing share related breadcrumb breadcrumbs pagination widget contentinfo complementary search login".split())
_BESIDE = frozenset("main site page post posts article left right top bottom box list section wrapper wrap container block area inner outer slot bar link links item items form text thread reader user and the".split())
#: A block of fewer characters is short. Shares of links above which, and of stop words from which, a block is decided. Stop words of a page: how many, and how often each at least.
SHORT, LINKS, STOPS, MOST_STOPS, LEAST_COUNT = 80, 0.5, 0.2, 40, 3


class Block(NamedTuple):
    text: str
    linked: int  # characters in links
    depth: int  # open containers
    low: int  # the fewest containers that were open since the block before
    region: int  # outermost article or main, 0: none
    apart: int  # outermost container that is no part of an article, 0: none; negative for elements that never are


def named_apart(attributes: str) -> bool:
    """Whether a class, id or role is a name of what is no part of an article, all parts of it."""
    for m in _ATTR.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = [p for p in re.split(r"[_-]+|\d+", name) if p]
            if any(p in _NAMES for p in parts) and all(p in _NAMES or p in _BESIDE for p in parts):
                return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, region, apart
    opened: Counter[str] = Counter()
    parts, linked, links, low, boxes = [], 0, False, 0, 0

    def flush():
        nonlocal parts, linked, low
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, linked, len(stack) - 1, low, *stack[-1][1:]))
            low = len(stack) - 1
        parts, linked = [], 0

    at = 0
    for m in _PART.finditer(page):
        if at < m.start():
            parts.append(page[at : m.start()])
            linked += m.start() - at if links else 0
        at = m.end()
        tag = (m[2] or m[1] or "").lower()
        if m[1] or not tag:
            if m[1] and tag not in ("script", "style"):
                flush()
            continue
        closing = m[0].startswith("</")
        if tag == "a":
            links = not closing
        elif tag in ("br", "wbr", "img"):
            parts.append(" ")
        if tag in _INLINE:
            continue
        flush()
        links = False
        if tag == "body" and not closing:
            stack, opened, low = [("", 0, 0)], Counter(), 0
        elif tag in _BOX and closing and opened[tag]:
            while True:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == tag:
                    break
            low = min(low, len(stack) - 1)
        elif tag in _BOX and not closing and not m[0].endswith("/>"):
            boxes += 1
            _, region, apart = stack[-1]
            region = region or (boxes if tag in ("article", "main") and not apart else 0)
            if apart >= 0 and (tag in _APART or (tag == "header" and not region)):
                apart = -boxes
            elif not apart and (tag == "form" or (tag not in ("article", "main") and named_apart(m[3] or ""))):
                apart = boxes
            stack.append((tag, region, apart))
            opened[tag] += 1
    if at < len(page):
        parts.append(page[at:])
        linked += len(page) - at if links else 0
    flush()
    return out


def stop_words(words: list[list[str]]) -> frozenset[str]:
    """The most frequent words of a page; none if none is frequent."""
    count = Counter(w for ws in words for w in ws)
    return frozenset(w for w, n in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:MOST_STOPS] if n >= LEAST_COUNT)


def first_labels(found: list[Block]) -> list[bool | None]:
    """Pass 1: text, no text, or ambiguous, by each block's own densities. Without frequent words length and links decide alone."""
    words = [_WORD.findall(b.text.lower()) for b in found]
    stops = stop_words([w for w, b in zip(words, found, strict=True) if b.linked <= LINKS * len(b.text)])
    label: list[bool | None] = []
    for b, ws in zip(found, words, strict=True):
        if b.linked > LINKS * len(b.text):
            label.append(None if b.region and not b.apart and len(ws) <= 1 else False)
        elif len(b.text) < SHORT:
            label.append(None)
        else:
            label.append(True if not stops or sum(w in stops for w in ws) >= STOPS * len(ws) else None)
    return label


def left_out(found: list[Block], label: list[bool | None]) -> list[bool]:
    """Which blocks are in containers apart, or outside of the page's region, by what pass 1 says of the page's text."""
    size = lambda keep, sure: sum(len(b.text) for b, ok in zip(found, label, strict=True) if (ok or (ok is None and not sure)) and keep(b))
    held = Counter()
    for b, ok in zip(found, label, strict=True):
        held[b.apart] += len(b.text) if ok else 0
    total = size(lambda b: b.apart >= 0, False)
    article = {k for k, n in held.items() if 2 * n > total and k > 0}
    out = [bool(b.apart) and b.apart not in article for b in found]
    text = size(lambda b: not b.apart or b.apart in article, True)
    inside = size(lambda b: b.region and (not b.apart or b.apart in article), True)
    if 2 * inside > text or (not text and any(b.region for b in found)):
        out = [x or not b.region for x, b in zip(out, found, strict=True)]
    return out


def second_labels(found: list[Block], label: list[bool | None]) -> list[bool]:
    """Pass 2: each ambiguous block takes the label of its nearest decided neighbour, in two linear passes. A step to the next block is 1, and 2 more for a container
    that is left or entered, 4 more for several; outside of a region, what is before and after the page is no text. Equally near ones that differ: text within a
    region, else not. Where nothing is text, ambiguous blocks without links are."""
    if not any(label):
        return [x is None and b.linked == 0 for x, b in zip(label, found, strict=True)]
    n, far = len(found), float("inf")
    levels = [max(1, found[0].depth)] + [a.depth + b.depth - 2 * min(b.low, a.depth) for a, b in zip(found, found[1:], strict=False)] + [max(1, found[-1].depth)]
    step = [1 + 2 * min(x, 2) for x in levels]
    edge = far if found[0].region else 0
    near = [[far, far] for _ in range(n)]  # distance of the nearest block that is no text, and of the nearest that is
    for order, before in ((range(n), 0), (range(n - 1, -1, -1), 1)):
        best = [edge, far]
        for i in order:
            best = [x + step[i + before] for x in best]
            if label[i] is not None:
                best[label[i]] = 0
            near[i] = [min(a, b) for a, b in zip(near[i], best, strict=True)]
    return [x if x is not None else (t <= f if b.region else t < f) for x, b, (f, t) in zip(label, found, near, strict=True)]


def main_text(page: str | None) -> str:
    """The article's blocks in page order, joined by newlines; empty if there is none."""
    found = blocks(page or "")
    label = first_labels(found)
    kept, low = [], 0
    for b, x, out in zip(found, label, left_out(found, label), strict=True):
        low = min(low, b.low)
        if not out:
            kept.append((b._replace(low=low), x))
            low = b.depth
    if not kept:
        return ""
    some, own = zip(*kept, strict=True)
    return "\n".join(b.text for b, ok in zip(some, second_labels(list(some), list(own)), strict=True) if ok)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text for each row of pages; a null or empty html gives an empty text, an empty table none.

    The whole html of any length is read in one pass, nothing is cut; repeated rows come back as often; other columns are left out."""

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 64):
                part = b.slice(i, 64)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array([main_text(x) for x in part.column("html").to_pylist()], pa.string())], names=["page_id", "url", "text"])

    return in_batches(pages.selectExpr("cast(page_id as long) page_id", "url", "html"), run, "page_id long, url string, text string")
