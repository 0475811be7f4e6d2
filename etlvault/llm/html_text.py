"""Main text of web pages by composite text density.

Every block element is a node; inline elements belong to the text of their block, links are
counted. A node's density is its characters per tag, adjusted by how much of it is links. The
node with the largest sum of child densities is the content; the least density on its path
from the body is the threshold for further parts, which are looked for in the same way below
every node that reaches it. Parts that are no article by their element, role or class (menus,
page headers, footers, adverts, forms, comments …) are left out before densities are taken.
Words in a class or id are a hint only: an element that holds more than half of the page's
text stays (one of reader comments only with a ``main`` or ``h1`` inside), and a name such as
``has-sidebar`` or ``no-comments`` says nothing of the element.

Where the content lies in an ``article`` or ``main`` element the whole element is taken, so its headline is
kept; other parts that reach the threshold are added to it, an ``article`` as a whole. Elsewhere the headings
that stand before the content on its path are added.

Defined cases: NULL and empty html and pages without text give an empty text; unclosed and
crossed tags are closed as the surrounding block closes; any nesting depth works; repeated
rows are extracted alike; an empty table gives no rows.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator
from math import e, log

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from etlvault.llm.common import read

# Element names of HTML, and roles.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
 h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp plaintext".split())
LEFT_OUT = frozenset("""nav footer aside form script style noscript template head button select option input textarea label fieldset svg annotation canvas
 object audio video iframe dialog menu search datalist""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CLOSED_BY_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
# Words in a class or id that mark what is no article.
NAMES = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert
 popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar aside widget widgets footer comment comments reply replies respond disqus
 share sharing social related recommended recommendations newsletter subscribe subscription signup login toolbar pagination pager copyright
 disclaimer skiplink""".split())
# Of these, words for what readers write.
READERS = frozenset("comment comments reply replies respond disqus".split())
# Words that turn a name into a statement about the layout around the element.
LAYOUT = frozenset("has have no not with without hide hidden".split())
PAGE_HEADER = frozenset(["header", "masthead", "topbar"])  # left out outside an article only

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|href|aria-hidden)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


STAYS, BY_KIND, BY_WORD, BY_READERS = range(4)


def _left_out(name: str, attributes: str, in_article: bool) -> int:
    """Whether an element is left out: by its name, role or because it is hidden, or by words in its class or id."""
    if name in LEFT_OUT or name == "header" and not in_article:
        return BY_KIND
    if not attributes.strip() or name in ("html", "body", "main", "article"):
        return STAYS
    found = STAYS
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _INVISIBLE.search(value):
            return BY_KIND
        if key == "role" and value.lower() in ROLES:
            return BY_KIND
        if key in ("class", "id"):
            for part in value.split():
                words = {w.lower() for w in _PART.findall(part)}
                if not words & LAYOUT and (words & NAMES or words & PAGE_HEADER and not in_article):
                    found = BY_READERS if words & READERS else max(found, BY_WORD)
    return found


def _density(chars: int, link_chars: int, tags: int, link_tags: int, whole: float) -> float:
    """Characters per tag, times a logarithm of how few of them are links.

    The base of that logarithm grows with the node's links and, by ``whole``, the page's; it is
    held above a small bound, as a page without any link would give the base one.
    """
    if not chars:
        return 0.0
    tags = max(1, tags)
    base = log(log(chars / max(1, chars - link_chars) * link_chars + whole * chars + e))
    return chars / tags * log(max(1.0, chars / max(1, link_chars) * tags / max(1, link_tags))) / max(base, 0.1)


class Page:
    """Block nodes of a page in document order, and its text pieces between block boundaries.

    ``spared`` has the numbers of elements that stay whatever the words in their names; with
    None all such elements stay, and ``holders`` tells how much text each of them holds.
    """

    def __init__(self, html: str, spared: frozenset[int] | None = frozenset()):
        self.spared, self.number = spared, 0             # number of elements that words mark
        self.total = self.unread = self.tops = 0          # text that counts, text left out by words, main and h1 elements
        self.holders: list[tuple[int, int, bool, int]] = []  # number, text, has a main or h1, reason
        self.names, self.parents = ["#root"], [-1]
        self.chars, self.link_chars, self.tags, self.link_tags = [0], [0], [0], [0]
        self.pieces: list[tuple[int, str] | None] = []  # None is a block boundary
        self.open: list[tuple[str, int, int, tuple | None]] = []  # name, node (-1 inline), left out, marked by words
        self.held: dict[str, int] = {}
        self.skipped = self.worded = self.links = self.articles = 0
        self.node = 0
        self._parse(html)

    def _judge(self, name: str, attributes: str) -> tuple[int, tuple | None]:
        """Whether an element is left out, and what is to be known at its end if words mark it."""
        if self.skipped:
            return STAYS, None
        reason = _left_out(name, attributes, self.articles > 0)
        if reason < BY_WORD:
            return reason, None
        self.number += 1
        if self.spared is None:
            return STAYS, (self.number, self.total, self.tops, reason)
        return (STAYS if self.number in self.spared else reason), None

    def _push(self, name: str, node: int, left_out: int, mark: tuple | None = None) -> None:
        self.open.append((name, node, left_out, mark))
        self.held[name] = self.held.get(name, 0) + 1
        self.skipped += left_out > STAYS
        self.worded += left_out >= BY_WORD
        self.tops += not self.skipped and name in ("main", "h1")
        self.links += name == "a"
        self.articles += name in ("article", "main")
        if node >= 0:
            self.node = node
            self.pieces.append(None)

    def _pop(self) -> str:
        name, node, left_out, mark = self.open.pop()
        self.held[name] -= 1
        self.skipped -= left_out > STAYS
        self.worded -= left_out >= BY_WORD
        if mark:
            self.holders.append((mark[0], self.total - mark[1], self.tops > mark[2], mark[3]))
        self.links -= name == "a"
        self.articles -= name in ("article", "main")
        if node >= 0:
            self.node = self.parents[node]
            self.pieces.append(None)
        return name

    def _close(self, name: str) -> None:
        if self.held.get(name):
            while self._pop() != name:
                pass

    def _close_same(self, name: str) -> None:
        """An item ends the open item of its own list."""
        group = ("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,)
        if any(self.held.get(g) for g in group):
            for other, *_ in reversed(self.open):
                if other in group:
                    self._close(other)
                    return
                if other in CLOSED_BY_SAME[name]:
                    return

    def _text(self, raw: str) -> None:
        if self.skipped or not raw:
            self.unread += len(raw) if self.worded else 0
            return
        text = html_entities.unescape(raw) if "&" in raw else raw
        size = len(text) - text.count(" ") - text.count("\n")
        self.chars[self.node] += size
        self.total += size
        if self.links:
            self.link_chars[self.node] += size
        self.pieces.append((self.node, text))

    def _parse(self, html: str) -> None:
        at, lowered, last = 0, None, html.rfind(">")
        while True:
            # behind the last end of a tag only an open comment can begin; a search would read on from every "<"
            m = _TOKEN.search(html, at) if at <= last else None
            if m is None:
                comment = html.find("<!--", at)
                self._text(html[at:] if comment < 0 else html[at:comment])
                while self.open:
                    self._pop()
                return
            if m.start() > at:
                self._text(html[at:m.start()])
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                if name in BLOCKS or name == "a" or self.held.get(name):
                    self._close(name)
                continue
            if name in RAW:
                lowered = html.lower() if lowered is None else lowered
                end = lowered.find(f"</{name}", at) if len(lowered) == len(html) else _find_end(html, name, at)
                at = len(html) if end < 0 else max(end, at)
                if end >= 0:
                    at = html.find(">", end) + 1 or len(html)
                continue
            if name in BLOCKS:
                if self.held.get("p"):
                    self._close("p")
                if name in CLOSED_BY_SAME:
                    self._close_same(name)
                left_out, mark = self._judge(name, m[3])
                if self.skipped or left_out:  # no node of its own: nothing inside counts
                    if name not in VOID:
                        self._push(name, -1, left_out)
                        self.pieces.append(None)
                    continue
                node = len(self.names)
                self.names.append(name)
                self.parents.append(self.node)
                for column, value in ((self.chars, 0), (self.link_chars, 0), (self.tags, 1), (self.link_tags, 0)):
                    column.append(value)
                self._push(name, node, STAYS, mark)
                if name in VOID:
                    self._pop()
                continue
            if name == "br":
                self._text(" ")
                continue
            if name in VOID:
                continue
            if name == "a":
                self._close("a")
                if not self.skipped:
                    self.link_tags[self.node] += 1
                    self.tags[self.node] += 1
            elif name == "option":
                self._close_same(name)
            self._push(name, -1, *self._judge(name, m[3]))

    def densities(self) -> list[float]:
        """Composite text density of every node."""
        for i in range(len(self.names) - 1, 0, -1):
            p = self.parents[i]
            self.chars[p] += self.chars[i]
            self.link_chars[p] += self.link_chars[i]
            self.tags[p] += self.tags[i]
            self.link_tags[p] += self.link_tags[i]
        whole = self.link_chars[0] / max(1, self.chars[0])
        return [_density(*x, whole) for x in zip(self.chars, self.link_chars, self.tags, self.link_tags, strict=True)]

    def content(self) -> list[bool]:
        """Which nodes belong to the main text."""
        n = len(self.names)
        density = self.densities()
        sums = [0.0] * n
        for i in range(1, n):
            sums[self.parents[i]] += density[i]
        # the best node of every subtree: its own or the best of a child's
        best = list(range(n))
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            if sums[best[i]] > sums[best[p]]:
                best[p] = best[i]
        chosen = best[0]
        path = [chosen]
        while path[-1] > 0:
            path.append(self.parents[path[-1]])
        threshold = min(density[i] for i in path)
        marked = [False] * n
        semantic = next((i for i in reversed(path) if self.names[i] in ("article", "main")), None)
        marked[chosen if semantic is None else semantic] = True
        on_path = set(path)
        reached = [False] * n
        for i in range(n):
            reached[i] = (i == 0 or reached[self.parents[i]]) and density[i] >= threshold and density[i] > 0
            if reached[i]:
                part = best[i] if sums[best[i]] > 0 else i
                marked[i if self.names[i] in ("article", "main") else part] = True
            elif semantic is None and self.names[i] in HEADINGS and i < chosen and self.parents[i] in on_path:
                marked[i] = True
        for i in range(1, n):
            marked[i] = marked[i] or marked[self.parents[i]]
        return marked

    def text(self) -> str:
        keep = self.content()
        lines, block = [], []
        for piece in [*self.pieces, None]:
            if piece is None:
                if block:
                    line = " ".join("".join(block).split())
                    if line:
                        lines.append(line)
                    block = []
            elif keep[piece[0]]:
                block.append(piece[1])
        return "\n".join(lines)


def _find_end(html: str, name: str, at: int) -> int:
    m = re.compile(f"</{re.escape(name)}", re.I).search(html, at)
    return m.start() if m else -1


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page(html)
    if page.unread > page.total:  # words may have left out the article: see how much each such element holds
        counted = Page(html, None)
        spared = frozenset(n for n, chars, has_top, reason in counted.holders if 2 * chars > counted.total and (has_top or reason == BY_WORD))
        page = Page(html, spared) if spared else page
    return page.text()


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text in ``text_col`` instead of the html."""
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in parts:
            yield column.map(main_text)

    rest = [F.col(f"`{c}`") for c in pages.columns if c not in (html_col, text_col)]
    return pages.select(*rest, F.pandas_udf(run, "string")(F.col(f"`{html_col}`")).alias(text_col))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op7_html_text": op7_html_text}
ORACLE: dict[str, str] = {}
