"""Main text of HTML pages (operator 8).

The standard library's parser feeds its events to a collector that cuts the page into lines: one per block element.
Elements that never hold main text (menus, forms, scripts, asides, adverts, comments ...) are skipped by tag, role or
class as they stream by. Each line has a text-to-tag ratio; the ratios, smoothed by a Gaussian over neighbouring lines,
are split by a threshold, and the lines above it show where the content is: the lowest container of all of them, which
grows to those around it while they add more text than links. Sections, lists and tables are blocks of the container
around them. Content lines count wherever they are, in an article or not; only a <main> with more than half of their
text is taken at its word. All lines of the region are the text, so that short paragraphs between long ones stay.

A class that often, but not always, names what is beside the text (related, share, promo, widget ...) is a hint only: a
container of such a class stays if at least half of its text is in content lines, and goes if not.

Containers know the one around them and the range of lines they hold, so the work grows with the page's length, not with
its depth. Edge cases: a null or empty page, and one without text, has an empty text; unclosed and misnested elements end
with their container; pages of any length or depth are read whole; repeated rows are extracted alike; an empty table gives
no rows; other columns are ignored, and a result whose name a key has gets an underscore behind it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate, compress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import beside_keys, table
from .words import slices

# Elements by what they mean here.
SKIPPED = frozenset("nav aside footer form script style noscript template iframe object button select textarea svg math head title menu dialog datalist canvas audio video map".split())
CONTAINERS = frozenset("html body article main section div td center table ul ol dl".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr th thead tbody tfoot caption blockquote pre figure figcaption address hr br header hgroup details summary".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Containers that are blocks of the one around them, and those around the whole page.
INNER = frozenset("section td table ul ol dl".split())
OUTER = frozenset(("html", "body"))
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
SKIPPED_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising advertorial banner sponsor sponsored comment comments disqus respond replies "
    "sidebar sidenav cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup popup modal overlay menu navbar nav navigation "
    "breadcrumb breadcrumbs footer masthead toolbar pagination pager".split()
)
HINT_WORDS = frozenset("promo promoted promotion share sharing social related recommended recommendations widget widgets login search skip hidden".split())
#: Skipped unless inside an article, where it may hold the title.
OUTER_WORDS = frozenset(("header",))
SPLIT = re.compile(r"[^a-z0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

SIGMA, RADIUS = 1.0, 2
KERNEL = [math.exp(-(i * i) / (2 * SIGMA * SIGMA)) for i in range(-RADIUS, RADIUS + 1)]


class Lines(HTMLParser):
    """Collects lines of text and the containers they are in. Of each line: text, tags before it, number of its container,
    tag of its block, and characters read inside links. Of each container, of which number 0 is the page: name, the one
    around it, the outermost article or main around it (or itself; 0: none), whether a main is around it, whether its
    class is a hint against it, and the first line in it and the one after its last."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.ratios: list[float] = []
        self.nodes: list[int] = []
        self.kinds: list[str] = []
        self.linked: list[int] = []
        self.names, self.parents, self.article, self.main, self.hinted = [""], [0], [0], [False], [False]
        self.first, self.last = [0], [0]
        self.stack: list[int] = [0]
        self.open: Counter[str] = Counter()
        self.text: list[str] = []
        self.tags = self.depth = 0
        self.kind = ""
        self.in_link, self.link_chars = False, 0
        self.skip: str | None = None

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.texts.append(text)
                self.ratios.append(len(text) / max(self.tags, 1))
                self.nodes.append(self.stack[-1])
                self.kinds.append(self.kind)
                self.linked.append(min(self.link_chars, len(text)))
                self.tags = 0
            self.text, self.link_chars = [], 0

    def finish(self) -> None:
        self.close()
        self.flush()
        self._leave(0)
        self.last[0] = len(self.texts)

    def _leave(self, place: int) -> None:
        """Ends the containers of the stack behind a place."""
        for n in self.stack[place + 1 :]:
            self.open[self.names[n]] -= 1
            self.last[n] = len(self.texts)
        del self.stack[place + 1 :]

    def _enter(self, tag: str, is_main: bool, hinted: bool) -> None:
        up, new = self.stack[-1], len(self.names)
        self.names.append(tag)
        self.parents.append(up)
        self.article.append(self.article[up] or (new if tag == "article" or is_main else 0))
        self.main.append(self.main[up] or is_main)
        self.hinted.append(hinted)
        self.first.append(len(self.texts))
        self.last.append(0)
        self.stack.append(new)
        self.open[tag] += 1

    def _against(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
        """(is skipped, has a hint against it)."""
        inner = self.article[self.stack[-1]] > 0
        hint = False
        if tag in SKIPPED or tag == "header" and not inner:
            return True, False
        for k, v in attrs:
            if k == "hidden" or k == "aria-hidden" and v == "true":
                return True, False
            if not v:
                continue
            v = v.lower()
            if k == "role" and v in SKIPPED_ROLES or k == "style" and HIDDEN.search(v):
                return True, False
            if k in ("class", "id") and tag not in ("html", "body", "article", "main"):
                words = set(SPLIT.split(v))
                if words & SKIPPED_WORDS or not inner and words & OUTER_WORDS:
                    return True, False
                hint = hint or bool(words & HINT_WORDS)
        return hint and tag not in CONTAINERS, hint

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skip is not None:
            if tag == self.skip and tag not in VOID:
                if tag in ("p", "li"):  # implied end of the skipped one
                    self.skip = None
                else:
                    self.depth += 1
                    return
            elif self.skip == "p" and tag in BLOCKS and tag != "br":
                self.skip = None
            else:
                return
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
            self.kind = tag
        if tag in VOID:
            return
        skipped, hint = self._against(tag, attrs) if attrs or tag in SKIPPED or tag == "header" else (False, False)
        if skipped:
            self.flush()
            self.skip, self.depth = tag, 1
            return
        if tag == "a":
            self.in_link = True
        if tag in CONTAINERS:
            self._enter(tag, tag == "main" or ("role", "main") in attrs, hint)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skip is None:
            self.tags += 1
            if tag in BLOCKS:
                self.flush()

    def handle_endtag(self, tag: str) -> None:
        if self.skip is not None:
            if tag == self.skip:
                self.depth -= 1
                if not self.depth:
                    self.skip = None
                return
            if tag not in CONTAINERS or not self.open[tag] or tag in ("div", "ul", "ol", "dl", "table", "td", "section", "center"):
                return
            self.skip = None  # the element around the skipped one ends
        self.tags += 1
        if tag == "a":
            self.in_link = False
        if tag in BLOCKS:
            self.flush()
            self.kind = ""
        if tag in CONTAINERS and self.open[tag]:
            place = len(self.stack) - 1
            while self.names[self.stack[place]] != tag:
                place -= 1
            self._leave(place - 1)

    def handle_data(self, data: str) -> None:
        if self.skip is None:
            self.text.append(data)
            if self.in_link:
                self.link_chars += len(data)

    def drop_hinted(self) -> None:
        """Takes out the lines of hinted containers that are not mostly content."""
        if not any(self.hinted) or not self.texts:
            return
        chars = [len(t) for t in self.texts]
        told = [0] * len(chars)
        for k in content_lines(chars, self.ratios, self.linked):
            told[k] = chars[k]
        total, content = ([0, *accumulate(x)] for x in (chars, told))
        stay, end = [True] * len(chars), 0
        for n, hinted in enumerate(self.hinted):
            a, b = self.first[n], self.last[n]
            if hinted and b > end and 2 * (content[b] - content[a]) < total[b] - total[a]:
                stay[a:b] = [False] * (b - a)
                end = b  # those inside it have gone with it
        place = [0, *accumulate(stay)]
        self.first, self.last = [place[x] for x in self.first], [place[x] for x in self.last]
        for name in ("texts", "ratios", "nodes", "kinds", "linked"):
            setattr(self, name, list(compress(getattr(self, name), stay)))


def smooth(values: list[float]) -> list[float]:
    """Gaussian over neighbouring lines; at the ends over those there are."""
    out = []
    for k in range(len(values)):
        lo, hi = max(0, k - RADIUS), min(len(values), k + RADIUS + 1)
        w = KERNEL[lo - k + RADIUS : hi - k + RADIUS]
        out.append(sum(a * b for a, b in zip(w, values[lo:hi], strict=True)) / sum(w))
    return out


def content_lines(chars: list[int], own: list[float], linked: list[int]) -> list[int]:
    """Lines whose smoothed text-to-tag ratio reaches the threshold: one standard deviation, or the mean if less. Those
    that reach it by their neighbours only, or are mostly links, count where there are no others."""
    ratio = smooth(own)
    mean = sum(ratio) / len(ratio)
    threshold = min(mean, math.sqrt(sum((r - mean) ** 2 for r in ratio) / len(ratio)))
    hits = [k for k, r in enumerate(ratio) if r >= threshold]
    return [k for k in hits if own[k] >= threshold and 2 * linked[k] < chars[k]] or hits


def region(p: Lines) -> tuple[int, int]:
    """First line of the region and the one after its last. The lines of a container follow each other."""
    chars = [len(t) for t in p.texts]
    hits = content_lines(chars, p.ratios, p.linked)
    said = [k for k in hits if p.main[p.nodes[k]]]
    if 2 * sum(chars[k] for k in said) > sum(chars[k] for k in hits):
        hits = said
    # the lowest container of all content lines, or the outermost article or main around it
    c = p.nodes[hits[0]]
    while c and p.last[c] <= hits[-1]:
        c = p.parents[c]
    c = p.article[c] or c
    inside: dict[int, list[int]] = {}
    for n in range(1, len(p.names)):
        if p.last[n] > p.first[n]:
            inside.setdefault(p.parents[n], []).append(n)
    text, links = ([0, *accumulate(x)] for x in (chars, p.linked))
    lo, hi = p.first[c], p.last[c]
    rank = min((x for x in p.kinds[lo:hi] if x in HEADINGS), default="h7")
    while c:
        up = p.parents[c]
        a, b = p.first[up], p.last[up]
        beside = [n for n in inside.get(up, ()) if n != c]
        own = [k for k in (*range(a, lo), *range(hi, b)) if p.nodes[k] == up]
        added = b - a > hi - lo
        titled = any(k < lo and p.kinds[k] in HEADINGS and p.kinds[k] < rank for k in own)
        series = p.names[c] == "article" and any(p.names[n] == "article" for n in beside)
        block = p.names[c] in INNER and (p.names[c] != "section" or bool(own) or any(p.names[n] in INNER for n in beside))
        if added and not (block or titled or series):
            if not up or p.names[up] in OUTER or p.main[c] and not p.main[up]:
                break
            more = text[lo] - text[a] + text[b] - text[hi]
            if 2 * (links[lo] - links[a] + links[b] - links[hi]) >= more:
                break
        rank = min(rank, *(x for x in (*p.kinds[a:lo], *p.kinds[hi:b]) if x in HEADINGS), "h7")
        c, lo, hi = up, a, b
    return lo, hi


def main_text(html: str | None) -> str:
    """Main text of a page: its blocks in order, one a line."""
    if not html:
        return ""
    p = Lines()
    p.feed(html)
    p.finish()
    p.drop_hinted()
    if not p.texts:
        return ""
    lo, hi = region(p)
    return "\n".join(p.texts[lo:hi])


def extract(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """keys, text and n_chars (code points) of each page."""
    rows = pages.select(F.struct(*keys).alias("keys"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in slices(batches, "html"):
            texts = [main_text(h) for h in cut.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([cut.column("keys"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["keys", "text", "n_chars"])

    return beside_keys(rows, keys, run, "text string, n_chars long")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


QUERIES = {"op8_html_extract": op8_html_extract}
ORACLES: dict = {}
