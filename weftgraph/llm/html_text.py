"""HTML extraction by line-block distribution.

Markup is stripped into lines, one for each block element, in page order.  Elements that hold no main text (menus,
headers, footers, sidebars, notices, adverts, forms, comments, scripts, styles) give no lines.  An element is known as
such by its tag, or by a whole name in its class, id or role: a name marks it if it has a marking word and else only words
of layout, so `cookie-notice` and `site-header` mark, `with-sidebar` and `legal-analysis` don't.  Where the word is one
that articles are named by too (LOOSE), the element has to hold the lesser part of the page's text as well.

The text lengths outside links of WINDOW lines in a row are summed, in an article or main element BONUS times; a surge
from below THRESHOLD opens a stretch of main text and a dive to zero closes it.  All lines between a surge and its dive
are kept, however short, so menus without marks, whose lines are all links, are what dives leave out.  A line of links, or
a short one behind it, belongs to the text it stands in: of a marked article that a stretch touches all lines are kept,
elsewhere those with text of their own whose block lies in the same element as a line of a stretch, and all lines between
two such.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weftgraph.llm import jobs

#: Lines of a window, its text length that makes a surge, and the weight of lengths inside a marked article.
WINDOW, THRESHOLD, BONUS = 3, 86, 2

OPENS = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
SPECIAL = re.compile("[\"'>]")
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
RAW = frozenset(("script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
PAGE = frozenset(("html", "body", "article", "main"))
#: Elements without main text, and words that mark one in a class, id or role.
STRIPPED = frozenset("nav header footer aside form menu dialog select button object svg canvas audio video fieldset datalist".split())
FIRM = frozenset(
    """ad ads adsense advert adverts advertisement advertisements advertising sponsor sponsored sponsors menu menus nav navbar navigation breadcrumb breadcrumbs
    cookie cookies consent gdpr newsletter subscribe subscription signup login comment comments commentlist disqus reply replies responses pagination pager""".split()
)
LOOSE = frozenset(
    """promo promos promotion banner sidebar sidebars aside header footer masthead notice notices notification alert popup modal overlay form forms search
    share sharing social related recommended toolbar copyright legal complementary contentinfo""".split()
)
#: Words that may stand beside a marking one.
LAYOUT = frozenset(
    """a above area article articles bar below block body bottom box btn button buttons center col column container content desktop div entry fixed float footer
    full global group head holder icon icons inline inner item items js large left link links list main mobile module nav narrow outer page panel post posts
    primary reader readers reading region right row secondary section site slot small sticky stories story text thread title top unit user users view web
    widget widgets wide wrap wrapper zone""".split()
)
#: Elements that are a block of text by themselves; what holds them is what their line lies in.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre figcaption caption summary address".split())
SCOPES = frozenset(("td", "th", "li", "div", "blockquote", "section"))


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)} if "=" in text else {}


def _strips(tag: str, attributes: str) -> int:
    """2: holds no main text; 1: by a name that articles have too; 0: neither."""
    if tag in PAGE:
        return 0
    if tag in STRIPPED:
        return 2
    if not attributes:
        return 0
    found = _attributes(attributes)
    if found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower() or HIDDEN.search(attributes):
        return 2
    kind = 0
    for name in " ".join(found.get(k, "") for k in ("class", "id", "role")).split():
        words = {n.lower() for n in NAME.findall(name)}
        if words <= FIRM | LOOSE | LAYOUT and (words & FIRM or words & LOOSE):
            kind = max(kind, 2 if words & FIRM or tag in INLINE else 1)
    return kind


class Tags:
    """Where tags end: at the first `>` outside quotes, or at the first one where quotes don't close."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.places: list[int] | None = None
        self.ends: list[int] = []

    def end(self, at: int) -> int:
        """Position of the `>` of the tag that begins at `at`, -1 if there is none."""
        if at > self.last:
            return -1
        close = self.page.find(">", at)
        part = self.page[at:close]
        if '"' not in part and "'" not in part:
            return close
        if self.places is None:  # once a page, from the right: the end from each quote and `>`, by what is open there
            self.places = [m.start() for m in SPECIAL.finditer(self.page)]
            free = single = double = -1
            self.ends = [-1] * (len(self.places) + 1)
            for k in range(len(self.places) - 1, -1, -1):
                char = self.page[self.places[k]]
                if char == ">":
                    free = self.places[k]
                elif char == "'":
                    free, single = single, free
                else:
                    free, double = double, free
                self.ends[k] = free
        found = self.ends[bisect_left(self.places, at)]
        return found if found >= 0 else close


class Line(NamedTuple):
    """text; length outside links; number of the outermost marked article, of the element it lies in, and whether that is the page itself."""

    text: str
    free: int
    article: int
    holder: int
    page: bool


def lines(page: str) -> tuple[list[Line], list[int], list[int]]:
    """The lines of a page, and for each element its parent and the last element inside it; elements are numbered as they open, 0 is the page."""
    out: list[tuple[Line, int]] = []  # with the number of the loosely marked element, 0 outside
    parent, last, tags = [0], [0], [""]
    stack: list[tuple[str, int, bool, bool, int]] = []  # open elements: tag, stripped, article, whether a p is open in this scope, number of the block
    opened: Counter[str] = Counter()
    stripped = links = loose = loosely = 0
    articles: list[int] = []
    parts: list[str] = []
    linked, owner = 0, -1  # owner: number of the block in which the line's text begins

    def flush() -> None:
        nonlocal linked, owner
        text = " ".join("".join(parts).split())
        if text:
            holder = parent[owner] if tags[owner] in BLOCKS else owner
            out.append((Line(text, max(0, len(text) - linked), articles[0] if articles else 0, holder, tags[holder] in ("", "html", "body")), loosely if loose else 0))
        parts.clear()
        linked, owner = 0, -1

    def put(text: str) -> None:
        nonlocal linked, owner
        if not stripped and text:
            text = html.unescape(text)
            if owner < 0 and not text.isspace():
                owner = stack[-1][4] if stack else 0
            parts.append(text)
            if links:
                linked += len(" ".join(text.split()))

    def close(tag: str) -> None:
        nonlocal stripped, links, loose
        if not opened[tag]:
            return
        name = ""
        while name != tag:
            name, strip, article, _, number = stack.pop()
            opened[name] -= 1
            stripped -= strip == 2
            loose -= strip == 1
            if article:
                articles.pop()
            links -= name == "a"
            if name not in INLINE:
                last[number] = len(parent) - 1

    ends = Tags(page)
    start = position = 0
    while True:
        at = page.find("<", position)
        if at < 0 or at > ends.last and not page.startswith("<!--", at):
            at = page.find("<!--", position) if at >= 0 else -1
            if at < 0:
                put(page[start:])
                break
        if page.startswith("<!--", at):
            put(page[start:at])
            end = page.find("-->", at + 4)
            start = position = len(page) if end < 0 else end + 3
            continue
        m = OPENS.match(page, at + 1)
        if m is None:
            if page[at + 1 : at + 2] in ("!", "?"):
                put(page[start:at])
                start = position = page.find(">", at) + 1
            else:
                position = at + 1
            continue
        end = ends.end(at)
        put(page[start:at])
        start = position = end + 1
        tag = m[2].lower()
        if m[1]:
            if tag not in INLINE:
                flush()
            close(tag)
            continue
        if tag == "br":
            put(" ")
            continue
        attributes = page[m.end() : end]
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, position)
            start = position = closing.end() if closing else len(page)
            flush()
            continue
        if tag not in INLINE:
            flush()
            if stack and stack[-1][3] and (stack[-1][0] == "p" or tag in ("p", "div", "ul", "ol", "table", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6")):
                close("p")
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                close(tag)
            if tag == "body":
                close("head")
        if tag in VOID or attributes.endswith("/") and tag not in INLINE:
            continue
        strip = _strips(tag, attributes)
        article = not strip and not stripped and (tag in ("article", "main") or 'role="main"' in attributes or "articleBody" in attributes)
        number = stack[-1][4] if stack else 0
        if tag not in INLINE:
            parent.append(number)
            last.append(0)
            tags.append(tag)
            number = len(parent) - 1
        stack.append((tag, strip, article, tag == "p" or tag not in SCOPES and bool(stack) and stack[-1][3], number))
        opened[tag] += 1
        stripped += strip == 2
        if strip == 1 and not loose:
            loosely += 1
        loose += strip == 1
        if article:
            articles.append(number)
        links += tag == "a"
    flush()
    for _, _, _, _, number in stack:
        last[number] = len(parent) - 1
    last[0] = len(parent) - 1
    held = Counter()
    for line, element in out:
        held[element] += line.free
    # a loosely marked element with most of the page's text is the article
    lost = {e for e, free in held.items() if e and 2 * free <= held.total()}
    return [line for line, element in out if element not in lost], parent, last


def stretches(lengths: list[int], window: int, threshold: int) -> list[tuple[int, int]]:
    """(first, end) of the lines between each surge of the sliding sums and the dive after it."""
    n, found = len(lengths), []
    total = [0] * (n + 1)
    for k, length in enumerate(lengths):
        total[k + 1] = total[k] + length
    sums = [total[min(n, k + window)] - total[k] for k in range(n)]
    k = 0
    while k < n:
        if sums[k] >= threshold and lengths[k]:
            end = k
            while end < n and sums[end] > 0:
                end += 1
            first = k
            while first > 0 and lengths[first - 1]:
                first -= 1
            found.append((first, end))
            k = end
        k += 1
    return found


def main_lines(block: list[Line], parent: list[int], last: list[int], window: int = WINDOW, threshold: int = THRESHOLD) -> list[bool]:
    """Which lines are main text: those of stretches, and those that belong to them by the elements they lie in."""
    lengths = [BONUS * line.free if line.article else line.free for line in block]
    found = stretches(lengths, window, threshold) or stretches(lengths, window, max(1, max(lengths, default=0)))
    keep = [False] * len(block)
    articles: set[int] = set()
    spans: dict[int, list[int]] = {}  # of the elements that lines of stretches lie in, the first and last of those lines
    for first, end in found:
        for k in range(first, end):
            keep[k] = True
            if block[k].free:
                if block[k].article:
                    articles.add(block[k].article)
                spans.setdefault(block[k].holder, [k, k])[1] = k
    for k, line in enumerate(block):  # lines with text of their own beside those of a stretch
        if not keep[k] and (line.article in articles or line.free and line.holder in spans):
            keep[k] = True
            span = spans.setdefault(line.holder, [k, k])
            span[0], span[1] = min(span[0], k), max(span[1], k)
    for page in {line.holder for line in block if line.page}:  # on the page itself links between texts may be menus
        spans.pop(page, None)
    inside: dict[int, int] = {}  # the nearest element with a span, by element
    for k, line in enumerate(block):
        if keep[k] or line.page:
            continue
        chain, at = [], line.holder
        while at not in inside and at not in spans and at:
            chain.append(at)
            at = parent[at]
        nearest = at if at in spans else inside.get(at, 0)
        inside.update(dict.fromkeys(chain, nearest))
        if nearest and nearest <= line.holder <= last[nearest] and spans[nearest][0] < k < spans[nearest][1]:
            keep[k] = True
    return keep


def main_text(page: str, window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    """The main text of one page, blocks joined by a space; empty if there is none."""
    if not page:
        return ""
    block, parent, last = lines(page)
    return " ".join(line.text for line, keep in zip(block, main_lines(block, parent, last, window, threshold), strict=True) if keep)


def extract(pages: DataFrame, window: int = WINDOW, threshold: int = THRESHOLD) -> DataFrame:
    """pages with the columns text and n_chars (code points), which replace columns of these names; html is dropped.

    A null or empty html, or one without main text, has the empty text.  Pages are handled one by one and whole.
    """
    jobs.small_batches(pages.sparkSession)
    kept = pages.drop("text", "n_chars")
    names = [c for c in kept.columns if c != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), window, threshold) for x in batch.column("html")]
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*names, "text", "n_chars"])

    schema = T.StructType([kept.schema[c] for c in names]).add("text", "string").add("n_chars", "long")
    return kept.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `pages`."""
    return extract(jobs.table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
