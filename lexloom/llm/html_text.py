"""Main text of web pages from streaming parser events.

The standard library's parser yields events; block-level tags cut the page into lines. Each line has
a text-to-tag ratio; the ratios of the page's lines are smoothed with a Gaussian kernel, and lines at
or above a threshold form clusters. The clusters choose the content region: the smallest element that
holds all clustered lines outside of marked boilerplate. Where that is within an ``article`` or
``main``, or one of these holds at least half of the clustered text, the region is that element
whole, so that its short first and last lines stay; teasers and cards don't count as articles by
their tag alone. All lines of the region are kept, short ones too, except those in menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, and, without ``article`` and ``main``, lists of links that
no cluster reaches. Class and id marks
and forms only tell a part from the rest: such an element stays when it is or holds the chosen
region, or holds most of its clustered text; where several such elements hold most of it (pages of
widgets), their mark counts no more, unless unmarked text has an ``article`` or ``main``.

Null, empty and text-free pages give an empty text. Repeated rows are pages of their own; the first
of equal regions wins. An empty table gives an empty result, extra columns don't matter. Unclosed
tags end with their parents. Pages of any length are read whole; the stack of open elements is
searched by counts, not by depth.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, utf8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE = frozenset("aside button canvas datalist dialog footer form head header iframe menu nav noscript object script select style svg template textarea title".split())
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted "
    "related reply replies respond share sharing sidebar skyscraper social sponsor sponsored subscribe toolbar widget".split()
)
_COMMENTS = frozenset("comment comments disqus replies reply respond".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


#: The smoothed ratio's logarithm from which lines are content on any page: 25 characters a tag.
PROSE = math.log1p(25)
SIGMA = 2.0
#: Lines that the kernel sees on either side.
REACH = math.ceil(2 * SIGMA)
#: A part of so many lines, without a cluster, with so large a share of its characters in links is a menu.
MENU_LINES, MENU_SHARE = 3, 0.8
#: Marks of an element that is dropped whatever it holds.
HARD = frozenset(["hard"])


def marks(tag: str, attrs) -> frozenset:
    """Why an element may be boilerplate: HARD, or words of its class and id, or its being a form."""
    if tag in BOILERPLATE and tag != "form":
        return HARD
    soft = {"<form>"} if tag == "form" else set()
    for name, value in attrs:
        value = value or ""
        if name in ("class", "id") and tag not in ("body", "html", "main"):
            soft.update(_MARKS.intersection(_SPLIT.split(value.lower())))
        if name == "role" and value.lower() == "form":
            soft.add("<form>")
        elif name == "role" and value.lower() in _ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return HARD
    return frozenset(soft)


class Lines(HTMLParser):
    """Lists ``lines`` as (text, tags, region, characters in links); ``regions`` as (parent, tag, marks)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.regions = [], [(-1, "", frozenset())]
        self.stack = [("", 0, False)]  # tag, region, boilerplate
        self.open = Counter()
        self.parts, self.tags, self.linked = [], 0, 0

    def cut(self):
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        if text:
            self.lines.append((text, self.tags, self.stack[-1][1], self.linked))
            self.tags = 0
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        found = marks(tag, attrs)
        inline = tag in INLINE and not found
        if not inline:
            self.cut()
            if tag not in VOID and self.open["p"] and tag != "p" or tag == "p":
                self.end_paragraph()
        if tag in VOID:
            return
        _, region, bad = self.stack[-1]
        if not inline:
            self.regions.append((region, tag, found))
            region = len(self.regions) - 1
            bad = bad or bool(found)
        self.stack.append((tag, region, bad))
        self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def end_paragraph(self):
        """A block ends an open paragraph, with only inline elements between."""
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[at][0]
            if tag == "p":
                self.close_to(at)
                return
            if tag not in INLINE:
                return

    def close_to(self, at: int):
        for tag, _, _ in self.stack[at:]:
            self.open[tag] -= 1
        del self.stack[at:]

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in INLINE:
            self.cut()
        if not self.open[tag]:
            return
        at = len(self.stack) - 1
        while self.stack[at][0] != tag:
            at -= 1
        if tag in INLINE and any(t not in INLINE for t, _, _ in self.stack[at + 1 :]):
            return  # a stray inline end doesn't end the blocks around it
        if self.stack[at][2] != self.stack[-1][2] or self.stack[at - 1][2] != self.stack[-1][2]:
            self.cut()
        self.close_to(at)

    def handle_data(self, data):
        self.parts.append(data)
        if self.open["a"]:
            self.linked += len(data)


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """With a Gaussian kernel; at the ends with what of it lies within."""
    reach = math.ceil(2 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    n, out = len(values), []
    for i in range(n):
        near = [(kernel[d + reach], values[i + d]) for d in range(max(-reach, -i), min(reach, n - 1 - i) + 1)]
        out.append(sum(k * v for k, v in near) / sum(k for k, _ in near))
    return out


def clustered(lines, kept, regions) -> list[float]:
    """The weight of each kept line: its length in a cluster, little beside.

    Clusters are the lines whose smoothed text-to-tag ratio (its logarithm, so that no long line
    outweighs the others) is half-way from the page's lowest to its highest, or that of prose, and
    whose own isn't below half of that. A heading shortly before such a line, and what is between,
    goes with it.
    """
    own = [math.log1p(len(t) / max(1, tags)) for (t, tags, *_), k in zip(lines, kept) if k]
    if not own:
        return [0.0] * len(lines)
    smoothed = smooth(own)
    threshold = min((min(smoothed) + max(smoothed)) / 2, PROSE)
    core = [x >= threshold and 2 * y >= threshold for x, y in zip(smoothed, own)]
    heads = [regions[line[2]][1] in ("h1", "h2", "h3") for line, k in zip(lines, kept) if k]
    for i in [i for i, h in enumerate(heads) if h and not core[i]]:
        for j in range(i + 1, min(i + 1 + REACH, len(core))):
            if core[j]:
                core[i:j] = [True] * (j - i)
                break
    told = iter(core)
    return [len(line[0]) * (1 if next(told) else 0.01) if k else 0.0 for line, k in zip(lines, kept)]


def choose(lines, regions, hard) -> tuple[int, list[bool]]:
    """The region of the content and, of each region, whether it is in it and not dropped."""
    weights = clustered(lines, [not hard[r] for _, _, r, _ in lines], regions)
    every, plain, under, comment = [0.0] * len(regions), [0.0] * len(regions), [False] * len(regions), [False] * len(regions)
    for (_, _, r, _), x in zip(lines, weights):
        every[r] += x
        plain[r] += x
    for r in range(len(regions) - 1, 0, -1):  # parents come first in the list
        every[regions[r][0]] += every[r]
        if not regions[r][2]:
            plain[regions[r][0]] += plain[r]
    for r in range(1, len(regions)):
        above, tag, found = regions[r]
        under[r] = under[above] or bool(found)
        comment[r] = comment[above] or tag not in ("article", "main") and bool(found & _COMMENTS)
    own = [p if 2 * p >= e else e for p, e in zip(plain, every)]  # without marked parts, unless they are most of it
    named = [r for r, (_, tag, _) in enumerate(regions) if tag in ("article", "main") and not hard[r] and own[r] > 0]
    named = [r for r in named if not comment[r]] or named  # readers' comments only if there's nothing else
    at = all_clusters(lines, regions, inside_of(lines, regions, weights, every, 0)[0])[0] if named else 0
    around = at
    while around and around not in named:
        around = regions[around][0]
    if around:
        named = [around]
    elif named and 2 * max(own[r] for r in named) < (plain[0] or every[0]):
        named = []  # teasers: the clusters lie elsewhere
    clean = max((own[r] for r in named if not under[r]), default=0.0)
    if clean and 2 * clean >= max(own[r] for r in named):  # an unmarked one is the content, unless a marked one is much longer
        named = [r for r in named if not under[r]]
    chosen = max(named, key=lambda r: (own[r], -r)) if named else 0
    return chosen, inside_of(lines, regions, weights, every, chosen)[0]


def inside_of(lines, regions, weights, every, chosen: int) -> tuple[list[bool], frozenset]:
    """Which regions are in the chosen one and not dropped by a mark, and the marks that count no more."""
    whole, lifted = every[chosen], frozenset()
    while True:
        words: list = [None] * len(regions)  # marks that drop a region; None outside the chosen one
        words[chosen] = frozenset()
        named = [False] * len(regions)
        for r in range(chosen + 1, len(regions)):
            if (above := words[regions[r][0]]) is not None:
                found = regions[r][2] - lifted
                words[r] = above | found if found and (found == HARD or 2 * every[r] <= whole) else above
                named[r] = named[regions[r][0]] or regions[r][1] in ("article", "main")
        cover: Counter = Counter()
        kept, article = 0.0, False
        for (_, _, r, _), x in zip(lines, weights):
            if words[r] is not None:
                kept += x * (not words[r])
                article = article or not words[r] and named[r]
                for w in words[r] - HARD:
                    cover[w] += x
        if 2 * kept >= whole or not cover or article:
            break
        lifted |= {max(cover, key=lambda w: (cover[w], w))}
    return [w is not None and not w for w in words], lifted


def all_clusters(lines, regions, inside) -> tuple[int, list[bool]]:
    """The smallest region, no paragraph, that holds all clustered lines, and which regions are no menus.

    Menus are parts of it with no clustered line and hardly any text outside of links.
    """
    count, size, own, linked = ([0] * len(regions) for _ in range(4))
    for (t, _, r, n), x in zip(lines, clustered(lines, [inside[r] for _, _, r, _ in lines], regions)):
        count[r] += x >= len(t)
        size[r] += 1
        own[r] += len(t)
        linked[r] += n
    for r in range(len(regions) - 1, 0, -1):
        for total in (count, size, own, linked):
            total[regions[r][0]] += total[r]
    best = 0
    for r in range(1, len(regions)):
        if count[r] == count[0] and regions[r][1] != "p":
            best = r
    plain = [True] * len(regions)
    for r in range(best + 1, len(regions)):
        plain[r] = plain[regions[r][0]] and not (not count[r] and size[r] >= MENU_LINES and linked[r] >= MENU_SHARE * own[r])
    return best, plain


def extract(html: str) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.cut()
    lines, regions = parser.lines, parser.regions
    hard = [False] * len(regions)
    for r in range(1, len(regions)):
        hard[r] = hard[regions[r][0]] or regions[r][2] == HARD
    if all(hard[r] for _, _, r, _ in lines):
        return ""
    chosen, inside = choose(lines, regions, hard)
    if not any(inside[r] for _, _, r, _ in lines):
        return ""
    if not chosen:
        chosen, plain = all_clusters(lines, regions, inside)
        within = [False] * len(regions)
        within[chosen] = True
        for r in range(chosen + 1, len(regions)):
            within[r] = within[regions[r][0]]
        inside = [a and b and c for a, b, c in zip(inside, within, plain)]
    return " ".join(text for text, _, r, _ in lines if inside[r])


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: ``key``, ``url``, text and n_chars (code points)."""

    def make():
        def work(ids, urls, pages):
            texts = [extract(p.decode("utf-8", "replace")) for p in pages]
            return ids, urls, texts, [len(t) for t in texts]

        return work

    kept = pages.select(F.col(key), F.col(url), utf8(html))
    return map_rows(kept, make, f"{key} {kept.schema[key].dataType.simpleString()}, {url} string, text string, n_chars long")
