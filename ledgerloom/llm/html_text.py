"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, or negative in kinds of blocks that
labelled pages have outside their article; tags score negative. One linear scan finds the
contiguous region with the highest sum, and its blocks make the text, without those that are
menus, adverts, forms and the like. What is in those scores nothing, however long it is.

Some elements are never main text (``nav``, ``form`` and so on). A name in class, id or role only
raises a doubt, as wrappers of whole articles are called ``has-sidebar`` or ``promo`` too: an element
in doubt is main text after all if it holds most of what is left of the page and the article, or the
headline where no article is marked. A ``header`` with a headline in an article belongs to it.

Pages that mark exactly one ``article`` or ``main`` element are the labelled ones: the weights come
from how many words and tags all of them have inside and outside that element. What a page marks is
not looked at when it is scored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements without text of the page, up to their end tag; without one, up to the next block tag.
HIDDEN = "script style noscript template iframe svg textarea select title"
TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)
    |<(?P<hidden>{HIDDEN.replace(" ", "|")})(?=[\s/>])[^>]*>
    |<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>[^<>"']*(?:"[^"]*"[^<>"']*|'[^']*'[^<>"']*)*)>
    |<[!?/a-z][^>]*>
    |(?P<text>[^<]+|<)""",
    re.IGNORECASE | re.DOTALL | re.VERBOSE,
)
# Elements that end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body center caption col colgroup dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu"
    " nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Elements that one of the same kind ends, if it is the innermost one.
ALONE = frozenset("p li dt dd td th tr option".split())
HIDDEN_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in HIDDEN.split()}
BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS))})(?=[\s/>])", re.IGNORECASE)
EMPTY = frozenset("hr br img input meta link area base col embed source track wbr".split())
MARKED = ("article", "main")
# Elements and words of class, id and role that are never main text.
ASIDE = frozenset("nav header footer aside form menu dialog button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ASIDE_NAME = re.compile(
    r"""(?i)(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|menu|nav\w*|breadcrumbs?|sidebar|footer|header
    |masthead|comments?|disqus|replies|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|share|sharing
    |social|related|widget|toolbar|search|login|signup|contentinfo|complementary)(?=$|[\s_-])""",
    re.VERBOSE,
)
# Names that tell what a page has or how it stands, and names of headlines and subjects: no doubt.
STATE_NAME = re.compile(
    r"""(?i)(?<![^\s])(?:(?:has|no|with|without|hide|show|is)[_-]\S+|\S+[_-](?:with|without|has|no)[_-]\S+
    |\S+[_-](?:open|opened|closed|active|visible|hidden|enabled|disabled|on|off)
    |(?:entry|post|article|story|content)[_-]+header
    |shar(?:e|ing)[_-]+(?:prices?|holders?|markets?|capital|economy))(?![^\s])""",
    re.VERBOSE,
)
NAMES = re.compile(r"""(?i)(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
# Bounds of the weights, so that no single kind of block decides alone.
WORD_WEIGHT = (-1.0, 1.0)
TAG_WEIGHT = (-0.5, -0.02)
PRIOR = 50.0


@dataclass
class Doubt:
    """An element that may not be main text, and what it holds."""

    outer: Doubt | None
    headline: bool  # a header in an article; else an element with a doubtful name
    own: int = 0  # words outside inner doubts
    words: int = 0
    marked: int = 0
    headings: int = 0
    first_headings: int = 0
    aside: bool = True


@dataclass
class Block:
    """Text between two block tags: its kind, its pieces and the tags in front of it.

    ``aside`` says that it is never main text, ``marked`` that an article or main element is around.
    """

    kind: str
    aside: bool
    marked: bool
    doubt: Doubt | None = None
    pieces: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)

    @cached_property
    def text(self) -> str:
        return " ".join(html.unescape("".join(self.pieces)).split())

    @property
    def words(self) -> int:
        return self.text.count(" ") + 1 if self.text else 0


def _doubtful(tag: str, attributes: str) -> bool:
    """Whether class, id or role name something that is no main text."""
    if tag in ("html", "body") or not attributes:
        return False
    named = " ".join("".join(m) for m in NAMES.findall(attributes))
    return bool(named and ASIDE_NAME.search(STATE_NAME.sub(" ", named)))


def tokens(page: str) -> Iterator[tuple[str | None, str, bool, str]]:
    """Texts and tags of a page in order, without hidden elements: text, or tag, end and attributes.

    An svg element ends in front of a block tag, as browsers have it; other hidden ones only do
    where no end tag follows. A self-closed svg is empty. Behind the last ``>`` all is text.
    """
    at, ends, last = 0, {}, page.rfind(">")
    while at < len(page):
        if at > last and not page.startswith("<!--", at):
            yield page[at:].partition("<!--")[0], "", False, ""
            return
        token = TOKEN.match(page, at)
        at = token.end()
        name = (token["hidden"] or "").lower()
        if not name:
            yield token["text"], (token["tag"] or "").lower(), bool(token["end"]), token["rest"] or ""
            continue
        if name == "svg" and page[at - 2] == "/":
            continue
        end = ends.get(name)
        if name not in ends or (end and end.start() < at):  # each end tag is looked for once
            end = ends[name] = HIDDEN_END[name].search(page, at)
        if end is None or name == "svg":
            block = BLOCK_TAG.search(page, at, end.start() if end else len(page))
            at = block.start() if block else end.end() if end else len(page)
        else:
            at = end.end()


@dataclass
class Element:
    """An open block element."""

    tag: str = ""
    aside: bool = False
    marked: bool = False
    doubt: Doubt | None = None


def _opened(tag: str, attributes: str, around: Element) -> Element:
    """The element that a tag opens inside another one."""
    doubt, aside = around.doubt, around.aside
    if tag == "header" and around.marked:
        doubt = Doubt(doubt, headline=True)
    elif tag in ASIDE:
        aside = True
    elif not aside and _doubtful(tag, attributes):
        doubt = Doubt(doubt, headline=False)
    return Element(tag, aside, around.marked or tag in MARKED, doubt)


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order. ``kind`` is the innermost block element.

    Work and memory grow with the page, however deep it is nested and whatever end tags are astray.
    """
    stack, opened = [Element()], Counter()
    found, doubts, now = [], [], Block("", False, False)
    marked = first_headings = 0
    for text, tag, ends, attributes in tokens(page):
        if text is not None:
            now.pieces.append(text)
            continue
        if not tag:
            continue
        if tag not in BLOCKS:
            if tag == "br":
                now.pieces.append(" ")
            if not ends and tag not in ("br", "wbr"):
                now.tags.append(tag)
            if tag != "button":
                continue
        if now.pieces:
            found.append(now)
            now = Block("", False, False)
        if ends:
            if opened[tag]:
                while True:
                    closed = stack.pop().tag
                    opened[closed] -= 1
                    if closed == tag:
                        break
        elif tag not in EMPTY:
            if tag in ALONE and stack[-1].tag == tag:
                opened[stack.pop().tag] -= 1
            around = stack[-1]
            element = _opened(tag, attributes, around)
            stack.append(element)
            opened[tag] += 1
            doubt = element.doubt
            if doubt is not None and doubt is not around.doubt:
                doubts.append(doubt)
            if not element.aside:
                if tag in MARKED and not around.marked and doubt is around.doubt:
                    marked += 1
                    if doubt:
                        doubt.marked += 1
                if tag == "h1":
                    first_headings += 1
                if doubt and tag in HEADINGS:
                    doubt.headings += 1
                    doubt.first_headings += tag == "h1"
        if not ends:
            now.tags.append(tag)
        inner = stack[-1]
        now.kind, now.aside, now.marked, now.doubt = inner.tag, inner.aside, inner.marked, inner.doubt
    if now.pieces:
        found.append(now)
    if doubts:
        _settle(found, doubts, marked, first_headings)
    return found


def _settle(parts: list[Block], doubts: list[Doubt], marked: int, first_headings: int) -> None:
    """Decide which elements in doubt are main text, the largest first, and mark the blocks."""
    plain = 0
    for part in parts:
        if not part.aside:
            count = part.words
            if part.doubt:
                part.doubt.own += count
            else:
                plain += count
    for doubt in reversed(doubts):  # inner ones come later
        doubt.words += doubt.own
        outer = doubt.outer
        if outer:
            outer.words += doubt.words
            outer.marked += doubt.marked
            outer.headings += doubt.headings
            outer.first_headings += doubt.first_headings
    for doubt in sorted(doubts, key=lambda d: -d.words):  # stable: outer ones stay in front
        if doubt.outer and doubt.outer.aside:
            continue
        if doubt.headline:
            doubt.aside = not doubt.headings
        elif marked:
            doubt.aside = not (doubt.marked == marked and doubt.words > plain)
        elif first_headings:
            doubt.aside = not (doubt.first_headings == first_headings and doubt.words > plain)
        if not doubt.aside:
            plain += doubt.own
    for part in parts:
        if part.doubt and part.doubt.aside:
            part.aside = True


def count_kinds(page: str) -> Counter:
    """Words and tags by (sort, kind, inside) of a page that marks one element; else nothing."""
    parts = blocks(page)
    found: Counter = Counter()
    if sum(tag in MARKED for part in parts for tag in part.tags) != 1:
        return found
    for part in parts:
        inside = part.marked and not part.aside
        if not part.aside:
            found["word", part.kind, inside] += part.words
        for tag in part.tags:
            found["tag", tag, inside] += 1
    return found


def learn_weights(pages: DataFrame) -> dict[tuple[str, str], float]:
    """Weight of a word by (``word``, kind) and of a tag, from all labelled pages.

    Kinds are names of block elements, so the counts that reach the driver are a few hundred.
    """
    known = BLOCKS | {""}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0):
                total.update(count_kinds(page.as_py() or ""))
        rows = [(s, k if k in known else "other", i, n) for (s, k, i), n in total.items() if n]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(columns[0], pa.string()),
                pa.array(columns[1], pa.string()),
                pa.array(columns[2], pa.bool_()),
                pa.array(columns[3], pa.int64()),
            ],
            names=["sort", "kind", "inside", "times"],
        )

    counts = (
        pages.select("html")
        .mapInArrow(count, "sort string, kind string, inside boolean, times bigint")
        .groupBy("sort", "kind")
        .agg(
            F.sum(F.when(F.col("inside"), F.col("times")).otherwise(0)).alias("inside"),
            F.sum(F.when(~F.col("inside"), F.col("times")).otherwise(0)).alias("outside"),
        )
    )
    weights = {}
    for row in counts.collect():
        start = PRIOR if row.sort == "word" else 0.0  # unseen: words are text, tags are not
        odds = math.log((row.inside + start + 1) / (row.outside + 1))
        low, high = {"tag": TAG_WEIGHT, "word": WORD_WEIGHT}[row.sort]
        weights[row.sort, row.kind] = min(high, max(low, odds))
    return weights


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the highest sum; the longer one of equal sums.

    (0, 0) if nothing is positive.
    """
    best, start, found = 0.0, 0, (0, 0)
    total = 0.0
    for i, score in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += score
        if total > best or (total == best > 0 and i + 1 - start > found[1] - found[0]):
            best, found = total, (start, i + 1)
    return found


def main_text(page: str, weights: dict[tuple[str, str], float]) -> str:
    """The text of the best region: blocks joined by an empty line, adverts and the like left out."""
    scores, owners = [], []
    for part in blocks(page):
        if part.aside:  # left out anyway: neither parts a region nor adds to one
            continue
        for tag in part.tags:
            kind = tag if tag in BLOCKS else "other"
            scores.append(weights.get(("tag", kind), TAG_WEIGHT[1]))
            owners.append(None)
        if part.words:
            scores.append(part.words * weights.get(("word", part.kind), WORD_WEIGHT[1]))
            owners.append(part.text)
    start, end = best_region(scores)
    return "\n\n".join(text for text in owners[start:end] if text)


def extract_text(pages: DataFrame, weights: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """Columns page_id, url, text and n_chars (code points) for every row of ``pages``.

    White space inside a block becomes one space, character references are decoded, blocks are
    joined by two line ends. Null or empty pages, and pages where nothing scores positive, have an
    empty text. Without ``weights``, they are learned from ``pages``; without labelled pages among
    them, every word outside menus and the like counts as text. Of regions with equal sums the longer
    one is taken, of equally long ones the first. Repeated rows stay; further columns of ``pages`` are
    not read. Pages may be of any length and depth.
    """
    weights = learn_weights(pages) if weights is None else weights
    wanted = pages.select("page_id", "url", "html")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py() or "", weights) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = wanted.schema["page_id"].dataType.simpleString()
    return wanted.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars bigint")
