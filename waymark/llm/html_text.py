"""Main text of HTML pages by tag-path ratios (operator 12).

One linear pass cuts a page into blocks: runs of text under one block element.
A block's path is the chain of block elements from the root, each named by its
tag and first class.  Over a page

1. text length, links and punctuation are summed per path; a path's text ratio
   is its unlinked characters per block, its mark ratio the marks per block;
2. both ratios are smoothed along the page: a block takes a Gaussian mean of
   its neighbours' ratios, weighted by how much of the paths is shared;
3. the two are fused to ``text * (1 + marks) * (1 - linked share)²`` and averaged
   per path;
4. paths below ``threshold`` times the page's mean, weighted by length, are no
   content.  The rest select the content: the article element they lie in, or
   else the page from the first to the last selected block under their common
   element, with headings directly before it.  Inside it a block goes only where
   its path is a list of links.

Elements that announce what they are never take part: scripts, styles, forms,
menus, footers and the like by tag, role, or a class or id with such a word (the
word is ignored behind ``has``, ``with``, ``no``), headers by tag but for the
headings of an article's own header, and what is hidden.

Blocks keep their order.  Character references are decoded, white space becomes
one space; ``br`` is white space.  Markup that never ends hides what follows it,
as in a browser: an unfinished tag, comment or script.

Nulls and odd rows: null, empty and text-free pages give an empty text; a null
id or url stays null; rows that repeat are extracted each; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import small_batches

THRESHOLD, SMOOTHING, REACH = 0.2, 1.0, 3
#: A path whose text is linked to this share is a list of links.
LINKED = 0.7

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
#: Elements whose content is not markup, and elements that are never article text.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = RAW | frozenset("head nav footer aside form noscript template button select option svg math canvas object audio video dialog menu datalist".split())
#: Start tags that end an open paragraph, and those that end an open element of their own kind.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
ENDS_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: An end that is implied never reaches beyond one of these.
SCOPE = frozenset("table ul ol dl div section article main body td th blockquote figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold the article, by tag or role, and by words of a class, id or item property; an article inside a main part wins.
MAIN_PART, ARTICLE = 1, 2
#: Words of a class, id or role that name what is not the article.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar skip search searchbox "
    "masthead footer foot colophon contentinfo copyright legal sidebar side aside complementary widget widgets rail "
    "related recommended recommendations trending popular comment comments commentlist respond reply replies discussion disqus "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login signin register "
    "share sharing social form outbrain taboola".split()
)
#: A header by class is the page's when it is named with these words alone.
PAGE_HEADER = frozenset("header topbar site page top global main".split())
TURNED = frozenset(("has", "with", "no", "without", "is", "hide"))

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.IGNORECASE) for t in RAW}
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_MARKS = re.compile(r"[.,;:!?…。，、；：！？।؟،]")


def _words(value: str) -> set[str]:
    found = [w.lower() for w in _WORDS.findall(value)]
    return {w for i, w in enumerate(found) if not (i and found[i - 1] in TURNED)}


def _rank(tag: str, said: set[str], named: dict[str, str]) -> int:
    if tag == "article" or "article" in said or "articlebody" in named.get("itemprop", "").lower() or (said & {"post", "entry", "story"} and said & {"content", "body", "text"}):
        return ARTICLE
    return MAIN_PART if tag == "main" or named.get("role", "").lower() == "main" else 0


class Page:
    """Blocks of one page: text, path, element, linked characters."""

    def __init__(self, html: str):
        #: Per element: parent, tag, whether it or one above is no article text, the article it lies in and that one's rank, in a header, depth, path.
        self.parent, self.tag, self.off, self.article, self.rank, self.header, self.depth, self.path = [-1], [""], [False], [-1], [0], [False], [0], [0]
        self.paths: dict[tuple[int, str], int] = {}
        self.path_parent, self.path_depth = [0], [0]
        self.texts: list[str] = []
        self.at: list[int] = []
        self.linked: list[int] = []
        self._stack, self._open = [0], {}
        self._parts: list[str] = []
        self._links = self._in_link = 0
        self._read(html)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join(unescape("".join(self._parts)).split())
            top = self._stack[-1]
            if text and not self.off[top] and (not self.header[top] or self.tag[top] in HEADINGS):
                self.texts.append(text)
                self.at.append(top)
                self.linked.append(min(self._links, len(text)))
            self._parts.clear()
        self._links = 0

    def _say(self, text: str) -> None:
        if text:
            self._parts.append(text)
            if self._in_link:
                self._links += len(text)

    def _push(self, tag: str, attributes: str) -> None:
        top = self._stack[-1]
        off, header, name, rank = self.off[top], self.header[top], tag, 0
        named = {}
        if attributes and not attributes.isspace():
            for k, a, b, c in _ATTR.findall(attributes):
                named.setdefault(k.lower(), a or b or c)
        if not off:
            off = tag in NEVER or "hidden" in named or named.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN_STYLE.search(named.get("style", "")))
            said = set() if tag in ("html", "body") else _words(f"{named.get('class', '')} {named.get('id', '')} {named.get('role', '')}")
            off = off or bool(said & MARKED)
            header = header or tag == "header" or bool(said & {"header", "topbar"})
            off = off or (self.article[top] < 0 and (tag == "header" or (header and bool(said) and said <= PAGE_HEADER)))
            rank = 0 if off else _rank(tag, said, named)
        if named.get("class"):
            name = f"{tag}.{named['class'].split()[0] if named['class'].split() else ''}"
        me = len(self.parent)
        key = (self.path[top], name)
        path = self.paths.get(key)
        if path is None:
            path = self.paths[key] = len(self.path_parent)
            self.path_parent.append(self.path[top])
            self.path_depth.append(self.path_depth[self.path[top]] + 1)
        self.parent.append(top)
        self.tag.append(tag)
        self.off.append(off)
        self.article.append(me if rank > self.rank[top] else self.article[top])
        self.rank.append(max(rank, self.rank[top]))
        self.header.append(header)
        self.depth.append(self.depth[top] + 1)
        self.path.append(path)
        self._stack.append(me)
        self._open[tag] = self._open.get(tag, 0) + 1

    def _pop(self) -> str:
        tag = self.tag[self._stack.pop()]
        self._open[tag] -= 1
        return tag

    def _close(self, tag: str) -> None:
        if self._open.get(tag):
            self._flush()
            while self._pop() != tag:
                pass

    def _imply(self, tag: str) -> None:
        if tag in ENDS_P and self._open.get("p"):
            self._close("p")
        for own in ENDS_OWN.get(tag, ()):
            if self._open.get(own):
                for back in range(len(self._stack) - 1, 0, -1):
                    found = self.tag[self._stack[back]]
                    if found == own:
                        self._close(own)
                        break
                    if found in SCOPE:
                        break

    def _start(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            self._in_link += tag == "a" and not self._in_link
            if tag == "br":
                self._parts.append(" ")
            elif tag == "span" and attributes and not self.off[self._stack[-1]] and ("hidden" in attributes or "none" in attributes):
                # Inline elements make no block, unless they hide something.
                self._flush()
                self._push(tag, attributes)
            return
        self._flush()
        self._imply(tag)
        if tag not in VOID:
            self._push(tag, attributes)
        if tag in ENDS_P:
            self._in_link = 0

    def _end(self, tag: str) -> None:
        if tag == "a":
            self._in_link = 0
        elif tag not in INLINE or (tag == "span" and self._open.get("span") and self.tag[self._stack[-1]] == "span"):
            self._close(tag)

    def _read(self, html: str) -> None:
        at, end, quoted = 0, len(html), True
        while at < end:
            lt = html.find("<", at)
            if lt < 0:
                self._say(html[at:])
                break
            self._say(html[at:lt])
            after = html[lt + 1 : lt + 2]
            if after in "!?" and after:
                comment = html.startswith("<!--", lt)
                at = html.find("-->" if comment else ">", lt + 2)
                if at < 0:
                    break
                at += 3 if comment else 1
                continue
            if not (after.isascii() and after.isalpha()) and not (after == "/" and html[lt + 2 : lt + 3].isalpha()):
                self._say("<")
                at = lt + 1
                continue
            m = _TAG.match(html, lt) if quoted else None
            if m is None:
                # A quote that never closes: from here on quotes are not looked at, so the scan stays linear.
                quoted = False
                m = _LOOSE.match(html, lt)
                if m is None:
                    break
            at, tag = m.end(), m.group(2).lower()
            if m.group(1):
                self._end(tag)
                continue
            self._start(tag, m.group(3))
            if tag in RAW:
                closing = _RAW_END[tag].search(html, at)
                if closing is None:
                    break
                self._close(tag)
                at = closing.end()
        self._flush()


def ratios(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """(score, linked share) of each block's path: ratios per path, smoothed along the page and fused."""
    paths, path = np.unique(np.array([page.path[e] for e in page.at]), return_inverse=True)
    size = np.array([len(t) for t in page.texts], float)
    linked = np.minimum(np.array(page.linked, float), size)
    marks = np.array([len(_MARKS.findall(t)) for t in page.texts], float)
    total = lambda x: np.bincount(path, weights=x, minlength=len(paths))
    blocks = total(np.ones(len(size)))
    text, mark = (total(size - linked) / blocks)[path], (total(marks) / blocks)[path]
    share = (total(linked) / total(size))[path]
    depth = np.array([page.path_depth[p] for p in paths], float)[path]
    common = _shared_depth(page, paths, path)
    smooth_text, smooth_mark, weight = text.copy(), mark.copy(), np.ones(len(size))
    for step in range(1, min(REACH, len(size) - 1) + 1):
        near = np.exp(-(step**2) / (2 * SMOOTHING**2)) * common(step) / np.maximum(np.maximum(depth[step:], depth[:-step]), 1)
        for value, smooth in ((text, smooth_text), (mark, smooth_mark)):
            smooth[step:] += near * value[:-step]
            smooth[:-step] += near * value[step:]
        weight[step:] += near
        weight[:-step] += near
    fused = smooth_text / weight * (1 + smooth_mark / weight) * (1 - share) ** 2
    return (total(fused) / blocks)[path], share


def _shared_depth(page: Page, paths: np.ndarray, path: np.ndarray):
    """A function of a distance: how many elements the paths of blocks that far apart share."""
    known: dict[tuple[int, int], int] = {}

    def of(a: int, b: int) -> int:
        if (a, b) not in known:
            x, y = int(paths[a]), int(paths[b])
            while x != y:
                if page.path_depth[x] >= page.path_depth[y]:
                    x = page.path_parent[x]
                else:
                    y = page.path_parent[y]
            known[a, b] = page.path_depth[x]
        return known[a, b]

    return lambda step: np.array([of(a, b) for a, b in zip(path[step:].tolist(), path[:-step].tolist())], float)


def select(page: Page, threshold: float = THRESHOLD) -> np.ndarray:
    """Which blocks are content."""
    n = len(page.texts)
    score, share = ratios(page)
    size = np.array([len(t) for t in page.texts], float)
    mean = float((score * size).sum() / size.sum())
    content = (score >= threshold * mean) & (share < LINKED)
    if not content.any():
        return content
    article, rank = (np.array([of[e] for e in page.at]) for of in (page.article, page.rank))
    best = int(np.argmax(np.where(content, score * size, 0)))
    text = share < LINKED
    if article[best] >= 0:
        # Where a page holds several articles, all that hold selected paths are its text.
        return np.isin(article, np.unique(article[content & (rank == rank[best])])) & text
    content &= article < 0
    spots = np.flatnonzero(content)
    holders = [page.at[i] for i in spots.tolist()]
    # Elements are numbered in page order, so the first and the last one meet where all of them do.
    top, other = min(holders), max(holders)
    while top != other:
        if page.depth[top] >= page.depth[other]:
            top = page.parent[top]
        else:
            other = page.parent[other]
    first = int(spots[0])
    while first and page.tag[page.at[first - 1]] in HEADINGS:
        first -= 1
    under = [False] * len(page.parent)
    for e in range(top, len(under)):
        under[e] = e == top or under[page.parent[e]]
    inside = np.zeros(n, bool)
    inside[first : int(spots[-1]) + 1] = True
    return inside & (article < 0) & text & np.array([under[e] or page.tag[e] in HEADINGS for e in page.at])


def main_text(html: str | None, threshold: float = THRESHOLD) -> str:
    """Content blocks of one page, joined by line feeds."""
    page = Page(html) if html else None
    if page is None or not page.texts:
        return ""
    keep = select(page, threshold)
    return "\n".join(t for t, k in zip(page.texts, keep.tolist()) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """(id, url, text, n_chars), one row per page.  A page is read by one task alone; nothing is shuffled."""
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(html_col).cast("string").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in small_batches(batches, "_html"):
            texts = [main_text(h, threshold) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"])

    return rows.mapInArrow(run, f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, `{url_col}` string, text string, n_chars bigint")
