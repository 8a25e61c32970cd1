"""Main text of web pages by composite text density.

A page is read into a tree of elements. Elements that never hold the article (menus, footers, forms,
scripts, adverts, reader comments ...) are known by tag, role, class or id and left out; but a form, a header or a
hint drops no subtree without which the page would have no ``article`` or ``main``, or, where the page has neither, that
holds most of its text outside links. For every other element the density is its characters per tag, adjusted for how many
of both lie in links; an element's density sum adds up its children. The element with the largest sum is the core;
an ``article`` or ``main`` around it is taken whole. Else the smallest density on the core's path to the body is the
threshold: in every element that reaches it, the element of the largest sum is taken. Headings before what is taken
beside or below them, and paragraphs and texts between such parts that are not mostly links, are taken with it.

The text is that of the chosen subtrees: character references decoded, white space made one blank, blocks
joined by one blank. Nothing is cut off.

Edge cases: null or empty html and pages without text give an empty text; open or stray tags, unquoted
attributes and open comments are read to the page's end; depth is not limited (no recursion); repeated
rows are extracted alike.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import query, table

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)|<[A-Za-z][^>]*+(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PARTS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr img picture ruby rb rt rp".split())
NEVER = frozenset(
    "head nav footer aside form script style noscript template button select option textarea input iframe object embed applet svg math "
    "canvas audio video dialog menu map title xmp noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
LEAVES = HEADINGS | frozenset("p li td th tr dd dt".split())
KEPT = frozenset("html body article main".split())
#: elements that a start tag of the same set ends
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPES = frozenset("ul ol dl table article main section div body html blockquote".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored sidebar nav navbar navigation menu "
    "breadcrumb breadcrumbs footer comment comments disqus reply replies cookie cookies consent notice notices popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations widget masthead pagination "
    "pager toolbar skip alert gdpr respond responses discussion".split())
NEGATING = frozenset(("has", "no", "with", "without"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())


class Page:
    """Elements of a page in page order, as parallel lists; a parent always stands before its children."""

    def __init__(self, source: str):
        self.tags, self.parents, self.dropped = ["#page"], [-1], [False]
        self.hinted = [False]  # dropped by no more than a hint, a header or a form
        self.texts: list[tuple[int, str]] = []
        self._read(source)
        self._settle()

    def _settle(self) -> None:
        """Keep hinted elements that hold the page's article, drop all other subtrees."""
        tags, parents, hinted = self.tags, self.parents, self.hinted
        n = len(tags)
        if any(hinted):
            under, linked, size = [False] * n, [False] * n, [0] * n
            for i in range(1, n):
                p = parents[i]
                self.dropped[i] = self.dropped[i] or self.dropped[p]
                under[i], linked[i] = under[p] or hinted[i], linked[p] or tags[i] == "a"
            articles = [i for i in range(n) if tags[i] in ("article", "main") and not self.dropped[i]]
            if not articles:
                for i, text in self.texts:
                    if not linked[i] and not self.dropped[i]:
                        size[i] += len(text) - text.count(" ") - text.count("\n")
                for i in range(n - 1, 0, -1):
                    size[parents[i]] += size[i]
                for i in range(1, n):
                    hinted[i] = hinted[i] and 2 * size[i] <= size[0]
            elif all(under[i] for i in articles):
                holds = [False] * n
                for i in articles:
                    holds[i] = True
                for i in range(n - 1, 0, -1):
                    hinted[i] = hinted[i] and not holds[i]
                    holds[parents[i]] = holds[parents[i]] or holds[i]
        for i in range(1, n):
            self.dropped[i] = self.dropped[i] or hinted[i] or self.dropped[parents[i]]

    def _hints(self, tag: str, attributes: str, inside: bool) -> bool:
        if tag == "form":
            return True
        if tag in NEVER or tag in KEPT:
            return False
        if tag == "header":
            return not inside
        if "=" in attributes:
            for name, value in _NAMED.findall(attributes):
                words = {w.lower() for w in _PARTS.split(value.strip("\"'"))}
                if name.lower() == "role":
                    if value.strip("\"'").lower() in ROLES:
                        return True
                elif not words & NEGATING and (words & HINTS or not inside and "header" in words):
                    return True
        return False

    def _read(self, source: str) -> None:
        stack, open_tags = [0], Counter()
        tags, parents, dropped, texts = self.tags, self.parents, self.dropped, self.texts
        at, end = 0, len(source)

        def close(depth: int) -> None:
            while len(stack) > depth:
                tag = tags[stack.pop()]
                open_tags[tag] -= 1
                if tag not in INLINE:
                    texts.append((stack[-1], "\n"))

        while at < end:
            found = _TOKEN.search(source, at)
            stop = found.start() if found else end
            if stop > at:
                texts.append((stack[-1], source[at:stop]))
            if not found:
                break
            at = found.end()
            if not found[2]:
                continue
            tag = found[2].lower()
            if found[1]:
                if open_tags[tag]:
                    depth = len(stack) - 1
                    while tags[stack[depth]] != tag:
                        depth -= 1
                    close(depth)
                continue
            if tag not in INLINE:
                ends = SIBLINGS.get(tag, SIBLINGS["p"])
                if open_tags["p"] or any(open_tags[t] for t in ends):
                    for depth in range(len(stack) - 1, 0, -1):
                        open_tag = tags[stack[depth]]
                        if open_tag in SCOPES:
                            break
                        if open_tag in ends or open_tag == "p" and tag not in VOID:
                            close(depth)
                            break
                texts.append((stack[-1], "\n"))
            tags.append(tag)
            parents.append(stack[-1])
            dropped.append(tag in NEVER and tag != "form")
            self.hinted.append(self._hints(tag, found[3], bool(open_tags["article"] or open_tags["main"])))
            if tag in RAW:
                closing = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(source, at)
                skip = source.find(">", closing.start()) if closing else -1
                at = end if skip < 0 else skip + 1
            elif tag not in VOID:
                stack.append(len(tags) - 1)
                open_tags[tag] += 1


def core(page: Page) -> list[int]:
    """The elements whose subtrees are the article, in page order."""
    n = len(page.tags)
    chars, below, link_chars, links = [0] * n, [0] * n, [0] * n, [0] * n
    linked = [False] * n
    for i in range(1, n):
        linked[i] = linked[page.parents[i]] or page.tags[i] == "a"
    for i, text in page.texts:
        if page.dropped[i]:
            continue
        size = len(text) - text.count(" ") - text.count("\n")
        chars[i] += size
        if linked[i]:
            link_chars[i] += size
    for i in range(n - 1, 0, -1):
        if page.dropped[i]:
            continue
        p = page.parents[i]
        chars[p] += chars[i]
        link_chars[p] += link_chars[i]
        below[p] += below[i] + 1
        links[p] += links[i] + (page.tags[i] == "a")
    body = next((i for i in range(n) if page.tags[i] == "body"), 0)
    share = link_chars[body] / max(1, chars[body])
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if page.dropped[i] or not chars[i]:
            continue
        c, t, lc, lt = chars[i], max(1, below[i]), max(1, link_chars[i]), max(1, links[i])
        base = math.log(c * lc / max(1, c - link_chars[i]) + share * c + math.e)
        density[i] = max(0.0, c / t * math.log(max(1.0, c * t / (lc * lt))) / math.log(max(base, 1.0001)))
        if i:
            sums[page.parents[i]] += density[i]
    best = max(range(n), key=lambda i: (sums[i], -i))
    if not sums[best]:
        return [body]
    path = [best]
    while path[-1] not in (body, 0, -1):
        path.append(page.parents[path[-1]])
    path = [i for i in path if i >= 0]
    for i in path:
        if page.tags[i] in ("article", "main"):
            return [i]
    if best == path[-1]:
        return [best]
    return taken(page, path[-1], best, min(density[i] for i in path), density, sums, chars, link_chars)


def taken(page: Page, body: int, best: int, threshold: float, density: list, sums: list, chars: list, link_chars: list) -> list[int]:
    """In every element below ``body`` whose density reaches the threshold, the element of the largest sum."""
    n, parents, tags = len(page.tags), page.parents, page.tags
    own = [sums[i] or density[i] for i in range(n)]  # an element without children counts itself
    most = list(range(n))
    for i in range(n - 1, 0, -1):
        p = parents[i]
        if not page.dropped[i] and own[most[i]] >= own[most[p]] and (most[p] != p or own[most[i]] > own[p]):
            most[p] = most[i]

    block = list(range(n))  # the element itself or, of an inline one, the block around it
    for i in range(body + 1, n):
        if parents[i] > body and tags[i] in INLINE:
            block[i] = block[parents[i]]
    marked, under = [False] * n, [False] * n
    while parents[best] > body and tags[best] in INLINE | LEAVES:
        best = parents[best]
    marked[best] = True
    below = [False] * n
    for i in range(body, n):
        below[i] = i == body or parents[i] >= body and below[parents[i]]
        if i > body:
            under[i] = marked[i] or under[parents[i]]
        if below[i] and i > body and not under[i] and not page.dropped[i] and chars[i] and density[i] >= threshold:
            marked[block[most[i]]] = True
            under[i] = marked[i]
    # what stands beside the taken parts: the last and first of them below each element
    first, last = [n] * n, [-1] * n
    for i in range(n - 1, 0, -1):
        if marked[i] or last[i] >= 0:
            p = parents[i]
            first[p], last[p] = min(first[p], i), max(last[p], i)
    for i in range(body + 1, n):
        p = parents[i]
        if below[i] and not under[p] and not page.dropped[i] and not marked[i] and last[i] < 0 and 2 * link_chars[i] <= chars[i]:
            if tags[i] == "h1" and i < last[body] or i < last[p] and (tags[i] in HEADINGS or i > first[p]):
                marked[i] = True
    return [i for i in range(n) if marked[i]]


def main_text(source: str | None) -> str:
    """The article's text of one page."""
    if not source:
        return ""
    page = Page(source)
    inside = [False] * len(page.tags)
    for i in core(page):
        inside[i] = True
    for i, parent in enumerate(page.parents):
        inside[i] = inside[i] or i > 0 and inside[parent] and not page.dropped[i]
    places = [at for at, (i, _) in enumerate(page.texts) if inside[i]]
    if not places:
        return ""
    around = [False] * len(page.tags)  # elements that hold parts of the article and are none
    for i in range(len(page.tags) - 1, 0, -1):
        if (inside[i] or around[i]) and not inside[page.parents[i]]:
            around[page.parents[i]] = True
    holder = [0] * len(page.tags)
    for i in range(1, len(page.tags)):
        holder[i] = i if around[i] else holder[page.parents[i]]
    first, last = {}, {}
    for at in places:
        i = holder[page.texts[at][0]]
        first.setdefault(i, at)
        last[i] = at
    for i in range(len(page.tags) - 1, 0, -1):
        p = page.parents[i]
        if i in first:
            first[p], last[p] = min(first.get(p, first[i]), first[i]), max(last.get(p, last[i]), last[i])
    parts = []
    for at, (i, text) in enumerate(page.texts):
        if inside[i] or around[i] and first.get(i, at) < at < last.get(i, at):
            parts.append(text)
        elif not page.dropped[i]:
            parts.append("\n")
    return " ".join(html.unescape("".join(parts)).split())


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, main text and its length of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    columns = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).alias("html"))
    return columns.mapInArrow(run, "page_id long, url string, text string, n_chars long")


@query("op5_extraction")
def op5_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
