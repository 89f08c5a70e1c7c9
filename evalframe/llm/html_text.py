"""The main text of web pages by text-to-tag ratios.

Parser events give a page's blocks. A block is a line: its ratio is the
characters of its text over the tags since the line before. Ratios are smoothed
by a Gaussian and cut in two clusters; the lines of the upper one are the content
regions.
The regions choose the element that holds them (the articles, if they lie in those);
its text is the result, with any region outside it, without what markup names as no
part of the article.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.llm.common import bound_batches, text_slices, without
from evalframe.runtime import ship_by_value

ship_by_value(__name__)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset(
    "head title script style noscript template nav header footer aside form button select textarea svg math iframe object canvas"
    " audio video menu dialog datalist".split()
)
BLOCK = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html legend li main"
    " ol p pre section summary table tbody tfoot thead tr ul".split()
) | NO_TEXT
IN_HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())
HOLDER = frozenset("article main section div td body".split())
NAMED = frozenset("div section ul ol dl table td p figure fieldset details center li".split())  # blocks: a word in a sentence is text whatever its class
HINT = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice alert"
    " popup modal overlay newsletter subscribe signup sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead header footer"
    " comment comments commentlist commentbox commentform commentsection disqus reply replies respond share sharing social related recommended widget toolbar pagination pager login search".split()
)
ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SIGMA = 1.0
APART = 3.0  # times the other lines' ratio that regions have on a page whose elements don't tell
HOLDS = 0.9  # share of the regions' text that articles, main or a chosen element hold at least


def left_out(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an element is marked as no part of an article."""
    if tag in NO_TEXT:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for name, value in attrs:
        value = (value or "").lower()
        if name in ("class", "id") and tag in NAMED and not HINT.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True
        if name == "role" and value in ROLE or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            return True
    return False


class Lines(HTMLParser):
    """Collects blocks: text, tags before its end, and the holder it is in; each holder knows the one around it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # tag, left out from here, holder in it
        self.counts: Counter[str] = Counter()  # of the open tags
        self.out, self.tags = 0, 0
        self.holders: list[tuple[str, int]] = [("", 0)]  # tag and the number of the holder around; 0 is the page
        self.text: list[str] = []
        self.lines: list[tuple[str, int, int]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            self.lines.append((text, max(1, self.tags), self.open[-1][2] if self.open else 0))
            self.tags = 0

    def pop(self) -> None:
        tag, out, _ = self.open.pop()
        self.out -= out
        self.counts[tag] -= 1

    def close_head(self) -> None:
        """What can't stand in a head ends it, as its end tag may be left out."""
        while self.counts["head"]:
            self.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "body" or tag not in IN_HEAD and self.open and self.open[-1][0] == "head":
            self.close_head()
        if tag in BLOCK:
            self.flush()
            holder = self.open[-1][2] if self.open else 0
            at = len(self.open) - 1
            while self.counts["p"] and at >= 0 and self.open[at][0] != "p" and self.open[at][2] == holder and self.open[at][0] not in HOLDER:
                at -= 1
            if at >= 0 and self.open[at][0] == "p":  # a block ends a paragraph
                while len(self.open) > at:
                    self.pop()
        elif tag in ("br", "td", "th"):
            self.text.append(" ")
        if tag in VOID:
            return
        if tag in CLOSES and self.open and self.open[-1][0] in CLOSES[tag]:
            self.pop()
        out = left_out(tag, attrs)
        holder = self.open[-1][2] if self.open else 0
        if tag in HOLDER:
            self.holders.append((tag, holder))
            holder = len(self.holders) - 1
        self.open.append((tag, out, holder))
        self.counts[tag] += 1
        self.out += out

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if self.counts[tag]:
            while self.open[-1][0] != tag:
                self.pop()
            self.pop()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and data.strip():
            self.close_head()
        if not self.out:
            self.text.append(data)

    def unknown_decl(self, data: str) -> None:
        pass


def lines_of(html: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int]]]:
    """(lines, holders) of a page."""
    for source in (html, html.replace("<![", "&lt;![")):  # a marked section that the parser refuses is text
        parser = Lines()
        try:
            parser.feed(source)
            parser.close()
        except AssertionError:
            continue
        break
    parser.flush()
    return parser.lines, parser.holders


def smooth(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratio)), kernel)[reach : reach + len(ratio)]  # less weight at the ends
    return np.convolve(ratio, kernel)[reach : reach + len(ratio)] / weight


def cluster_threshold(level: np.ndarray) -> float:
    """The cut into two clusters that leaves the least variance within them."""
    order = np.sort(level)
    n = np.arange(1, len(order))
    if not len(n) or order[0] == order[-1]:
        return float(order[0])
    low, high = np.cumsum(order)[:-1] / n, np.cumsum(order[::-1])[::-1][1:] / (len(order) - n)
    return float(order[(n * (len(order) - n) * (high - low) ** 2).argmax() + 1])


def main_text(html: str | None) -> str:
    """The blocks of the main text, joined by empty lines; empty for a page without text.

    No line of the content regions is left out. The articles with such lines are whole if
    together they hold ``HOLDS`` of the regions' text, else main is if it does, else the
    smallest element that holds all regions or, if that is the body, ``HOLDS`` of them.
    """
    lines, holders = lines_of(html or "")
    if not lines:
        return ""
    size = np.array([len(text) for text, _, _ in lines], float)
    ratio = size / np.array([tags for _, tags, _ in lines], float)
    place = np.array([holder for _, _, holder in lines])
    level = np.round(smooth(ratio), 6)  # lines alike are alike, whatever floating point says
    content = level >= cluster_threshold(level)
    held = np.bincount(place, size * content, len(holders))
    touched = np.bincount(place, content, len(holders)) > 0
    depth = np.zeros(len(holders), int)
    for number in range(len(holders) - 1, 0, -1):  # a holder comes after the one around it
        held[holders[number][1]] += held[number]
        touched[holders[number][1]] |= touched[number]
    for number in range(1, len(holders)):
        depth[number] = depth[holders[number][1]] + 1

    def within(chosen: list[int]) -> np.ndarray:
        """Which lines are in one of the holders, at any depth."""
        inside = np.zeros(len(holders), bool)
        inside[chosen] = True
        for number in range(1, len(holders)):
            inside[number] |= inside[holders[number][1]]
        return inside[place]

    def named(*kinds: str) -> list[int]:
        return [h for h in range(1, len(holders)) if touched[h] and holders[h][0] in kinds]

    def joined(kept: np.ndarray) -> str:
        return "\n\n".join(text for (text, _, _), k in zip(lines, kept) if k)

    total = size[content].sum()
    for kind in ("article", "main"):
        marked = within(named(kind))
        if size[content & marked].sum() >= HOLDS * total:
            return joined(content | marked)
    for enough in (total, HOLDS * total):
        able = [h for h in named(*HOLDER - {"body"}) if held[h] >= enough]
        if able:
            return joined(content | within([max(able, key=lambda h: depth[h])]))
    marked = within(named("article", "main"))
    if not marked.any() and not content.all() and ratio[content].mean() < APART * ratio[~content].mean():
        content[:] = True
    return joined(content | marked)


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """``df`` with ``text``, the main text, and ``n_chars``, its code points.

    A NULL or empty page has an empty text. Pages are read whole, one by one, so
    repeated rows give the same. Columns of these names are replaced.
    """
    names = [c for c in df.columns if c.lower() in ("text", "n_chars") and c.lower() != html_col.lower()]
    bound_batches(df.sparkSession)
    rows = without(df, *names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, html_col):
            yield batch.append_column("_text", pa.array([main_text(h) for h in batch.column(html_col).to_pylist()], pa.string()))

    found = rows.mapInArrow(add, T.StructType([*rows.schema.fields, T.StructField("_text", T.StringType())]))
    if html_col.lower() == "text":
        found = found.drop(html_col)
    return found.withColumnRenamed("_text", "text").withColumn("n_chars", F.length("text").cast("long"))
