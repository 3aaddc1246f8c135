"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text, each with its root-to-leaf tag path (element and class or id). For each path the length of text outside
links and the punctuation of its blocks are added up; the ratios per block are smoothed over neighbouring paths in page order and fused
(geometric mean of length and punctuation); a path in an article or main element weighs `LANDMARK`. Paths that say that they are a menu, header,
footer, sidebar, notice, advert, form or reader comment (by element, role, or a word of class or id) are marked: they take part only on a page
that has no other text. Paths that score at or over `BAR` of the mean are content paths; the mean is weighted by length, so many short paths don't lower it.

The page is then entered from its root, into an element that holds nearly all of the length of content blocks. Where that ends in an article or main
element, its unmarked blocks are the main text, but those of articles in it that have no content or less than half of the one with most, or of the content outside articles (teasers).
Elsewhere the content's neighbours under one parent belong to it too, headings and short ones, but not blocks that are mostly links.

Broken markup is read as browsers do: a block closes an open paragraph, list items and cells close their
like, unknown end tags are ignored, raw text runs to its end tag, what is open at the end is closed. Reading and scoring take time
in proportion to the page, however deep it is nested and whatever is left open.

Defined results: null or empty html, or a page without content, gives the empty text; a URL may be null; rows
may repeat; a page is never cut; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from emberline.llm.common import table

# Element names of HTML, and words that mark what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr picture source label".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre section table ul".split()
)
#: Elements that close an open element of the given names, up to the given bounds.
CLOSES_LIKE = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)), "tbody": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead"), ("table",)),
}
#: Elements whose text is no text of the page.
NO_TEXT = frozenset("head script style noscript template button select textarea input iframe object embed svg canvas noframes xmp audio video map".split())
NEVER = frozenset("nav header footer aside form menu dialog fieldset".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
NEVER_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promos promotion banner banners menu menus nav "
    "navbar navigation breadcrumb breadcrumbs sidebar sidebars aside rail widget widgets footer header masthead topbar cookie cookies consent "
    "gdpr notice notices alert alerts popup popover modal overlay newsletter subscribe subscription signup signin login comment comments "
    "commentlist reply replies respond disqus discussion share sharing social related recommended recommendations pagination pager "
    "copyright disclaimer paywall toolbar skip hidden".split()
)
LANDMARKS = frozenset(["article", "main"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？¿¡]")

#: Weight of a path in an article or main element, and share of the mean score that a content path has.
LANDMARK, BAR = 2, 1 / 2
#: Share of the content that an element must hold to be entered.
MOST = 0.9
CONTAINERS = frozenset("html body div section center table tbody tr td".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*(?:\"[^\"]*\"|'[^']*')?|[\"'])*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """An open or closed element. `path`: number of its tag path; `marked`: it, or one around it, is marked as no article; `gone`: its text is none."""

    __slots__ = ("tag", "parent", "block", "number", "path", "marked", "landmark", "gone")

    def __init__(self, tag: str, parent: Node | None, number: int, path: int, marked: bool, gone: bool) -> None:
        self.tag, self.parent, self.number, self.path, self.marked, self.gone = tag, parent, number, path, marked, gone
        self.block = parent.block if parent and tag in INLINE else self
        self.landmark = tag in LANDMARKS or bool(parent and parent.landmark)


def _no_text(tag: str, attributes: dict[str, str]) -> bool:
    return tag in NO_TEXT or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()


def _marked(tag: str, attributes: dict[str, str]) -> bool:
    if tag in NEVER or attributes.get("role", "").lower() in NEVER_ROLES:
        return True
    if tag in ("html", "body"):
        return False
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    if tag in LANDMARKS:  # "post has-sidebar" is an article, "comment" isn't
        return any(n.lower() in NEVER_WORDS for n in names.split())
    return any(w.lower() in NEVER_WORDS for w in _WORD.findall(names))


class Page:
    """Elements in order of their start, blocks: (element that holds the block, text), and of each block the characters in links."""

    def __init__(self, source: str) -> None:
        root = Node("", None, 0, 0, False, False)
        self.nodes, self.blocks, self.linked = [root], [], []
        self._paths: dict[tuple[int, str], int] = {}
        self._open: list[Node] = [root]
        #: Places in _open by element, and of those that are not inline.
        self._where: dict[str, list[int]] = {}
        self._solid: list[int] = [0]
        self._text: list[str] = []
        self._in_links = 0
        self._read(source)
        self._flush()

    def _read(self, source: str) -> None:
        at, tag, cdata = 0, _TAG, True
        while (start := source.find("<", at)) >= 0:
            self._say(source[at:start])
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                at = end + 3 if end >= 0 else len(source)
                continue
            if cdata and source.startswith("<![CDATA[", start):
                end = source.find("]]>", start)
                if end >= 0:
                    self._text.append(source[start + 9 : end])
                    at = end + 3
                    continue
                cdata = False
            if source[start + 1 : start + 2] in ("!", "?"):
                end = source.find(">", start)
                at = end + 1 if end >= 0 else len(source)
                continue
            m = tag.match(source, start)
            if m is None and source[start + 1 : start + 3].lstrip("/")[:1].isalpha() and source[start + 1].isascii():
                if source.find(">", start) < 0:  # no tag ends any more
                    at = len(source)
                    break
                if tag is _TAG:  # a quote is open to the end of the page: from here on quotes count as other signs do
                    tag = _PLAIN_TAG
                    m = tag.match(source, start)
            if m is None:
                self._say("<")
                at = start + 1
                continue
            at, name = m.end(), m[2].lower()
            if m[1]:
                self._end(name)
                continue
            closed = self._start(name, m[3])
            if name in RAW and not closed:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
                self._end(name)
        self._say(source[at:])

    def _say(self, text: str) -> None:
        if text:
            text = html.unescape(text) if "&" in text else text
            self._text.append(text)
            if self._where.get("a"):
                self._in_links += len(text)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            self._text = []
            if text:
                self.blocks.append((self._open[-1].block, text))
                self.linked.append(min(self._in_links, len(text)))
            self._in_links = 0

    def _cut(self, index: int) -> None:
        """Close all from this place on."""
        for node in self._open[index:]:
            self._where[node.tag].pop()
            if node.tag not in INLINE:
                self._solid.pop()
        del self._open[index:]

    def _close_to(self, index: int) -> None:
        self._flush()
        self._cut(index)

    def _last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of these."""
        return max((self._where[t][-1] for t in tags if self._where.get(t)), default=-1)

    def _start(self, tag: str, rest: str) -> bool:
        attributes = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(rest)} if rest.strip(" /") else {}
        if tag == "br":
            self._text.append(" ")
            return True
        if tag not in INLINE:
            self._flush()
        if tag in CLOSES_P and (at := self._last(("p",))) > self._last(("button", "td", "th", "table")):
            self._close_to(at)
        if tag in HEADINGS and self._open[-1].tag in HEADINGS:
            self._close_to(len(self._open) - 1)
        if tag in CLOSES_LIKE:
            like, bounds = CLOSES_LIKE[tag]
            if (at := self._last(like)) > self._last(bounds):
                self._close_to(at)
        if tag in LANDMARKS and self._where.get("nav"):  # a menu that was never closed doesn't swallow the article
            self._close_to(self._where["nav"][0])
        parent = self._open[-1]
        inline = tag in INLINE
        gone = parent.gone or _no_text(tag, attributes) or (inline and bool(attributes) and _marked(tag, attributes))
        if tag in VOID or (rest.rstrip().endswith("/") and tag in ("svg", "path", "iframe", "script")):
            return True
        if gone and not parent.gone and inline:
            self._flush()
        path, marked = parent.path, parent.marked
        if not inline:
            mark = attributes.get("class") or attributes.get("id") or ""
            path = self._paths.setdefault((path, f"{tag}.{mark}" if mark else tag), len(self._paths) + 1)
            marked = marked or _marked(tag, attributes)
        node = Node(tag, parent, len(self.nodes), path, marked, gone)
        self.nodes.append(node)
        self._where.setdefault(tag, []).append(len(self._open))
        if not inline:
            self._solid.append(len(self._open))
        self._open.append(node)
        return False

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._text.append(" ")
            return
        i = self._last((tag,))
        if i < 1:
            return
        if tag not in INLINE:
            self._close_to(i)
        elif self._solid[-1] < i:  # no block is open in it
            if self._open[i].gone and not self._open[i - 1].gone:  # text left out inside a line
                self._text, self._in_links = [], 0
            self._cut(i)


def path_scores(blocks: list[tuple[Node, str, int]]) -> tuple[list[float], list[float], list[int], list[int]]:
    """Fused ratios of each path after and before smoothing, its length, in order of first appearance, and the place in it of each block's path."""
    at: dict[int, int] = {}
    sums: list[list[float]] = []
    which = []
    for node, text, linked in blocks:
        n = at.setdefault(node.path, len(at))
        if n == len(sums):
            sums.append([0, 0, 0, LANDMARK if node.landmark else 1])
        total = sums[n]
        total[0] += len(text) - linked
        total[1] += len(PUNCTUATION.findall(text))
        total[2] += 1
        which.append(n)
    lengths, signs = ([total[k] / total[2] for total in sums] for k in (0, 1))

    def smooth(values: list[float]) -> list[float]:
        padded = [values[0], *values, values[-1]]
        return [padded[i] / 4 + padded[i + 1] / 2 + padded[i + 2] / 4 for i in range(len(values))]

    def fused(a: list[float], b: list[float]) -> list[float]:
        return [total[3] * (x * (1 + y)) ** 0.5 for total, x, y in zip(sums, a, b, strict=True)]

    return fused(smooth(lengths), smooth(signs)), fused(lengths, signs), [total[0] for total in sums], which


def content_blocks(page: Page, threshold: float = BAR) -> list[str]:
    """Texts of the selected blocks, in page order. Content paths score `threshold` times the mean at least (0: all paths do)."""
    blocks = [(node, text, linked) for (node, text), linked in zip(page.blocks, page.linked, strict=True) if not node.gone]
    plain = [x for x in blocks if not x[0].marked]
    blocks = plain if any(len(text) > linked for _, text, linked in plain) else blocks
    if not blocks:
        return []
    smoothed, own, lengths, which = path_scores(blocks)
    # What smoothing alone lifts, because it stands beside long texts, is no content.
    bound, own_bound = (threshold * sum(map(float.__mul__, x, map(float, lengths))) / max(1, sum(lengths)) for x in (smoothed, own))
    chosen = [a >= bound and b >= own_bound / 2 for a, b in zip(smoothed, own, strict=True)]
    # Length of content blocks in each element, from the leaves up, and the child with most of it.
    n = len(page.nodes)
    mass, best = [0] * n, [0] * n
    for (node, text, _), path in zip(blocks, which, strict=True):
        if chosen[path]:
            mass[node.number] += len(text)
    for node in reversed(page.nodes[1:]):
        up = node.parent.number
        mass[up] += mass[node.number]
        if best[up] == 0 or mass[node.number] >= mass[best[up]]:
            best[up] = node.number
    root = page.nodes[0]
    while (child := best[root.number]) and root.tag != "article":
        found = page.nodes[child]
        if not mass[child] > MOST * mass[root.number] or not (found.tag in LANDMARKS or found.tag in CONTAINERS or found.tag not in CLOSES_P):
            break
        root = found
    while root.tag in INLINE and root.parent:
        root = root.parent
    core = root
    if not root.landmark and root.tag not in ("", "html", "body"):
        root = root.parent
    # From the root down: what is in the main element, what is in its core, and in which outermost article.
    inside, central, article = [False] * n, [False] * n, [0] * n
    for node in page.nodes:
        up = node.parent.number if node.parent else 0
        inside[node.number] = node is root or (node.parent is not None and inside[up])
        central[node.number] = node is core or (node.parent is not None and central[up])
        if inside[node.number] and node is not root and node is not core:
            article[node.number] = article[up] or (node.number if node.tag == "article" else 0)
    outside = sum(len(text) for (node, text, _), path in zip(blocks, which, strict=True) if chosen[path] and inside[node.number] and not article[node.number])
    most = max((mass[k] for k in set(article) if k and central[k]), default=0)
    most = most if root.tag == "article" else max(most, outside)
    out = []
    for (node, text, linked), path in zip(blocks, which, strict=True):
        of = article[node.number]
        if not inside[node.number] or (of and (not central[of] or mass[of] == 0 or mass[of] < most / 2)):
            continue
        if chosen[path] or root.landmark or of or 2 * linked <= len(text):
            out.append(text)
    return out


def main_text(source: str | None) -> str:
    return "\n".join(content_blocks(Page(source))) if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
