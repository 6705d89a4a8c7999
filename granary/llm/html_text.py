"""Main text of web pages: the maximum-scoring subsequence of words and tags.

A page becomes a sequence of tokens.  Words score positive, words in links
less, tags negative; one linear scan finds the contiguous region of largest sum.
The region then grows to the element that holds all of it (short first or last
paragraphs score too little by themselves); where that is the whole body, to the
blocks of the same kind beside it, as far as they hold more words than links.
Scripts, forms and navigation are neutral in the scan and never come out.

A class, id or role is evidence that an element is an advert, a notice, a comment thread and so on, not a
verdict.  Names with a word that turns them round (``no-sidebar``, ``comment-status-open``, ``ads-free``) say
nothing.  An element of several paragraphs or headings whose name says something else too (``search-post``) and that holds more
than half of the page's words is no part beside the article; one that is called nothing but an advert, a thread and so on may
be that long, and is only kept where nearly all words are its own.

The weights come from labelled pages: those that mark their article by an
``article`` or ``main`` element.  Each kind of token weighs the log ratio of its
frequencies inside and outside of the marked part, clipped to its sign.  At
most ``FIT_PAGES`` pages (smallest hash of their id) are used: that bound is a
parameter.  Without any such page ``DEFAULT_WEIGHTS`` hold.  The scan does not
see which element is an ``article``.

Defined results: a null or empty html and a page without words give an empty
text; unclosed elements end where their parent ends; unknown character
references stay as they are; nothing is capped, and time and memory are linear in the page, however deep its elements are nested: a
token keeps the number of its element, not the way to it.  Where an attribute's quote never ends, tags end at the next ``>`` from there on.
Ties between regions go to the first and shortest; rows that repeat an id are pages of their own; a null id or url is kept; an empty table
gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import table

FIT_PAGES = 400
NOTE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?", re.S | re.I)
#: A tag whose quoted attributes may hold ``>``, and one that ends at the next ``>``.
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>")
#: Elements whose content is not markup or not text: they go as a whole, up to their first end tag.
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template textarea title iframe svg math object select button canvas".split()}
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that never hold article text.
NEVER = frozenset("head nav footer aside form dialog menu fieldset".split())
#: Words of class, id and role that name a part which is not the article.
NAMES = frozenset(
    "nav navbar navigation menu submenu header masthead topbar footer sidebar aside ad ads adv advert adverts advertisement advertising adsense banner promo promotion "
    "sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments respond reply "
    "replies discussion disqus share sharing social related recommended breadcrumb breadcrumbs pagination pager widget toolbar search contentinfo complementary skip".split()
)
#: Words that turn a name round: the element has, lacks or allows such a part, it is none.
TURNED = frozenset("no not non has have with without hide hides hidden status enabled disabled free open opened closed layout template allow allowed supports single".split())
#: Names of parts that may hold more words than the article.
THREADS = frozenset("comment comments respond reply replies discussion disqus".split())
#: The share of a page's words above which an element is no part beside the article: one whose name says more, and one that is called nothing else.
MOST, NEARLY_ALL = 0.5, 0.95
#: An element is kept by its share only if it has so many paragraphs and headings.
LEAST_PARTS = 2
#: Elements that a class name does not take out.
KEPT = frozenset("html body article main".split())
P_ENDS = frozenset("address article aside blockquote dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td th tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are parts of an article rather than all of it.
PARTS = HEADINGS | frozenset("p li ul ol blockquote td tr tbody table section".split())
WORD_SPLIT = re.compile(r"[^a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
DEFAULT_WEIGHTS = {"word": 1.0, "link": -1.0, "tag": -2.0}


class Chunk:
    """A piece of text or a tag: what it scores by, the element it stands in (-1: none) and the one whose fate it shares."""

    __slots__ = ("kind", "text", "out", "node", "owner", "marked", "count")

    def __init__(self, kind: str, text: str, node: int, owner: int, marked: bool, count: int):
        self.kind, self.text, self.out, self.node, self.owner, self.marked, self.count = kind, text, False, node, owner, marked, count


#: What speaks against an element: nothing, a word of its name, its whole name, its tag.
FINE, PARTLY, NAMED, NO_TEXT = range(4)


class Elements:
    """The elements of a page by number: tag, parent, depth, the chunks [first, end) that they hold, and what speaks against them."""

    def __init__(self):
        self.tag, self.parent, self.depth, self.first, self.end, self.against = [], [], [], [], [], []

    def add(self, tag: str, parent: int, first: int, against: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.first.append(first)
        self.end.append(-1)
        self.against.append(against)
        return len(self.tag) - 1

    def settle(self, chunks: list[Chunk]) -> None:
        """Decides which elements go, from the words that they hold, and marks their chunks."""
        never = [False] * len(self.tag)
        for i, parent in enumerate(self.parent):
            never[i] = self.against[i] == NO_TEXT or parent >= 0 and never[parent]
        upto, parts = [0], [0]
        for i, c in enumerate(chunks):
            begins = c.owner >= 0 and self.first[c.owner] == i and (self.tag[c.owner] == "p" or self.tag[c.owner] in HEADINGS)
            parts.append(parts[-1] + begins)
            upto.append(upto[-1] + (c.count if c.kind == "word" and not (c.node >= 0 and never[c.node]) else 0))
        out = [False] * len(self.tag)
        for i, parent in enumerate(self.parent):
            share = (upto[self.end[i]] - upto[self.first[i]]) / max(1, upto[-1])
            most = {FINE: -1.0, PARTLY: MOST, NAMED: NEARLY_ALL}.get(self.against[i], 1.0)
            small = share <= most or self.against[i] != FINE and parts[self.end[i]] - parts[self.first[i]] < LEAST_PARTS
            out[i] = parent >= 0 and out[parent] or small
        for c in chunks:
            c.out = c.owner >= 0 and out[c.owner]

    def common(self, a: int, b: int) -> int:
        """The innermost element that holds both, or -1."""
        while a != b:
            if a < 0 or b < 0:
                return -1
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
        return a


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """The page as ("text", text, ""), ("cdata", ...) and ("open" or "close", tag, attributes), without notes and raw elements."""
    pos, last, strict = 0, page.rfind(">"), True
    while pos < len(page):
        at = page.find("<", pos)
        if at != pos:
            at = len(page) if at < 0 else at
            yield "text", page[pos:at], ""
            pos = at
            continue
        note = NOTE.match(page, pos)
        if note and len(note[0]) > 2:
            if note[0][:9].upper() == "<![CDATA[":
                yield "cdata", "", ""
            pos = note.end()
            continue
        m = (TAG if strict else LOOSE_TAG).match(page, pos) if pos < last else None
        if m is None and strict and pos < last:
            m = LOOSE_TAG.match(page, pos)
            # a quote that does not end: from here on, tags are read without regard to quotes
            strict = m is None
        if m is None:
            yield "text", "<", ""
            pos += 1
            continue
        tag = m[2].lower()
        if not m[1] and tag in RAW:
            stop = RAW[tag].search(page, m.end())
            pos = stop.end() if stop else len(page)
            continue
        yield ("close" if m[1] else "open"), tag, m[3]
        pos = m.end()


def _against(tag: str, attributes: str, in_article: bool) -> int:
    """What speaks against an element by itself."""
    if tag in NEVER:
        return NO_TEXT
    if tag == "header" and not in_article:
        return NO_TEXT
    if not attributes or tag in KEPT:
        return FINE
    found = FINE
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return NO_TEXT
        if name in ("class", "id", "role", "aria-label") and (name != "aria-label" or tag not in INLINE):
            for one in value.split() if name != "aria-label" else [value]:
                words = set(WORD_SPLIT.split(CAMEL.sub(" ", one).lower()))
                # a heading's own header class is no site header
                named = NAMES.intersection(words) - ({"header"} if in_article else set())
                if named and not TURNED.intersection(words):
                    found = max(found, NAMED if THREADS.intersection(words) or not words - NAMES - {""} else PARTLY)
    return found


def tokens(page: str | None) -> tuple[list[Chunk], Elements]:
    """The page as chunks, and its elements."""
    found: list[Chunk] = []
    nodes = Elements()
    stack: list[tuple[str, int, bool, bool]] = []  # tag, number, inside a marked part, in a link
    where: dict[str, list[int]] = {}  # places in the stack by tag
    blocks: list[int] = []  # places in the stack of elements that are not inline

    def state() -> tuple[int, bool, bool]:
        return stack[-1][1:] if stack else (-1, False, False)

    def close(at: int) -> None:
        while len(stack) > at:
            tag, node = stack.pop()[:2]
            nodes.end[node] = len(found)
            where[tag].pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()

    for kind, tag, attributes in pieces(page or ""):
        node, marked, link = state()
        if kind == "text":
            text = html_lib.unescape(tag)
            found.append(Chunk("link" if link else "word", text, node, node, marked, len(text.split())))
            continue
        if kind == "cdata":
            found.append(Chunk("block", "", node, node, marked, 0))
            continue
        if kind == "close":
            if not where.get(tag):
                if tag not in INLINE:
                    found.append(Chunk("block", "", node, node, marked, 0))
                continue
            at = where[tag][-1]
            # an inline end tag does not close blocks around it
            if tag in INLINE and blocks and blocks[-1] > at:
                continue
            owner, marked = stack[at][1:3]
            close(at)
        else:
            if tag in P_ENDS and blocks:
                near = stack[blocks[-1]][0]
                if near == "p" or tag == "li" and near == "li" or tag in ("td", "th") and near in ("td", "th") or tag == "tr" and near in ("td", "th", "tr"):
                    close(blocks[-1])
                    node, marked, link = state()
            owner = node
            if tag not in VOID and not attributes.endswith("/"):
                against = _against(tag, attributes, marked)
                # of a header inside an article only the headings are text
                if where.get("header") and tag not in INLINE and tag not in HEADINGS and tag != "div":
                    against = NO_TEXT
                marked = marked or tag in ("article", "main")
                where.setdefault(tag, []).append(len(stack))
                if tag not in INLINE:
                    blocks.append(len(stack))
                owner = nodes.add(tag, node, len(found), against)
                stack.append((tag, owner, marked, link or tag == "a"))
        found.append(Chunk("inline" if tag in INLINE else "block", tag, state()[0], owner, marked, 1))
    close(0)
    nodes.settle(found)
    return found, nodes


def fit_weights(pages: Iterator[str | None]) -> dict[str, float]:
    """Weights from the pages that mark their article."""
    inside, outside = Counter(), Counter()
    for page in pages:
        chunks, _ = tokens(page)
        if any(c.marked for c in chunks):
            for c in chunks:
                if c.text != "article" and c.text != "main":
                    kind = c.kind if c.kind in ("word", "link") else "tag"
                    (inside if c.marked and not c.out else outside)[kind] += c.count
    a, b = sum(inside.values()), sum(outside.values())
    if not a or not b:
        return dict(DEFAULT_WEIGHTS)
    ratio = {k: math.log((inside[k] + 1) / (a + 3)) - math.log((outside[k] + 1) / (b + 3)) for k in ("word", "link", "tag")}
    return {"word": min(max(ratio["word"], 0.1), 3.0), "link": min(ratio["link"], 0.1), "tag": min(max(ratio["tag"], -4.0), -0.1)}


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, stop) of the contiguous run of largest sum; the first and shortest of equal ones."""
    best, region, run, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, region = run, (start, i + 1)
    return region


def _beside(chunks: list[Chunk], nodes: Elements, first: int, last: int, start: int, stop: int) -> tuple[int, int]:
    """[start, stop) grown over the blocks beside it under the body: those of its own kind, or that are parts of texts, while they hold more words than links."""

    def top(node: int) -> int:
        while node >= 0 and nodes.parent[node] >= 0 and nodes.tag[nodes.parent[node]] not in ("body", "html"):
            node = nodes.parent[node]
        return node

    first, last = top(first), top(last)
    if first < 0 or last < 0 or nodes.tag[first] in ("body", "html") or nodes.tag[last] in ("body", "html"):
        return start, stop
    kinds = PARTS | {nodes.tag[first], nodes.tag[last]}
    # blocks of the body in page order
    beside = [i for i, p in enumerate(nodes.parent) if p == nodes.parent[first] and nodes.tag[i] not in INLINE]
    start, stop = min(start, nodes.first[first]), max(stop, nodes.end[last])

    def joins(i: int) -> bool | None:
        """Whether a block belongs to the text; null if it says nothing."""
        held = [c for c in chunks[nodes.first[i] : nodes.end[i]] if not c.out]
        words, links = (sum(c.count for c in held if c.kind == k) for k in ("word", "link"))
        return None if not words + links else nodes.tag[i] in kinds and words > links

    for i in reversed([i for i in beside if i < first]):
        if joins(i) is False:
            break
        start = min(start, nodes.first[i]) if joins(i) else start
    for i in [i for i in beside if i > last]:
        if joins(i) is False:
            break
        stop = max(stop, nodes.end[i]) if joins(i) else stop
    return start, stop


def main_text(page: str | None, weights: dict[str, float]) -> str:
    chunks, nodes = tokens(page)
    scores = [0.0 if c.out else weights[c.kind] * c.count if c.kind in ("word", "link") else weights["tag"] * c.count for c in chunks]
    start, stop = best_region(scores)
    if start == stop:
        return ""
    worded = [c for c in chunks[start:stop] if c.kind in ("word", "link") and c.count and not c.out]
    # in page order, what holds the first and the last holds all between them
    common = nodes.common(worded[0].node, worded[-1].node)
    # a region inside one paragraph, list or inline element grows to the element around it
    while common >= 0 and (nodes.tag[common] in INLINE or nodes.tag[common] in PARTS) and nodes.parent[common] >= 0 and nodes.tag[nodes.parent[common]] not in ("body", "html"):
        common = nodes.parent[common]
    if common >= 0 and nodes.tag[common] not in ("body", "html"):
        start, stop = min(start, nodes.first[common]), max(stop, nodes.end[common])
    if common < 0 or nodes.tag[common] in PARTS or nodes.tag[common] in ("body", "html"):
        start, stop = _beside(chunks, nodes, worded[0].node, worded[-1].node, start, stop)
    blocks, current = [], []
    for c in chunks[start:stop]:
        if c.kind in ("word", "link"):
            if not c.out:
                current.append(c.text)
        elif c.kind == "block":
            blocks.append("".join(current))
            current = []
    blocks.append("".join(current))
    return " ".join(t for t in (" ".join(b.split()) for b in blocks) if t)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", fit_pages: int = FIT_PAGES) -> DataFrame:
    """id_col, url_col, text and n_chars for each page."""
    some = pages.where(F.lower(html_col).rlike("<(article|main)[ >]")).orderBy(F.xxhash64(F.col(id_col).cast("string")), F.col(id_col)).limit(fit_pages).select(html_col)

    def fitted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([fit_weights(h for f in frames for h in f[html_col])])

    rows = some.repartition(1).mapInPandas(fitted, "word double, link double, tag double").collect()
    weights = rows[0].asDict() if rows else dict(DEFAULT_WEIGHTS)

    @F.pandas_udf(T.StringType())
    def text(h: pd.Series) -> pd.Series:
        return h.map(lambda x: main_text(x, weights), na_action=None)

    got = pages.select(F.col(id_col), F.col(url_col), text(F.col(html_col)).alias("text"))
    return got.withColumn("n_chars", F.char_length("text").cast("long"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
