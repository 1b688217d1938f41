"""Main text of web pages by composite text density.

A page becomes a tree of its block elements; inline elements stay in the text of their block and count as tags. Elements that
say themselves that they are not the article (menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments;
by element, role, or a whole class or id) are left out first. Where such a word is only a part of a class or id (`has-sidebar`), a block
element goes only if it holds no more than half of the text outside links. Every node then gets its characters per tag, adjusted for links:

    D = C/T * log_b(C/LC * T/LT),   b = ln(C*LC/(C-LC) + C*LC_body/C_body + e)

with C characters, T tags, LC link characters and LT link tags below the node (1 where a divisor is 0), and plain C/T on a
page without links. The density sum of a node adds the densities of its children and of its own text. The node with the
largest sum is the core; the smallest density between it and the body is the threshold; every node at or above the threshold
contributes its best subtree. Blocks of the marked subtrees are returned in page order, whole.

Null and empty pages, and pages without text, give an empty string. Unclosed elements, missing end tags, stray end tags and a
page cut off inside a tag are read as browsers do. Rows never meet, so ties, repeated rows and extra columns do no harm.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import map_texts

TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)>""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPACE = re.compile(r"\s+")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Element names of the markup language, by behaviour.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp
                      small span strike strong sub sup time tt u var wbr""".split())
RAW = frozenset("script style textarea title noframes xmp".split())
NOT_ARTICLE = frozenset("""nav header footer aside form script style noscript template iframe object embed svg math canvas
                           button select input textarea head title dialog menu audio video datalist fieldset noframes xmp""".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
LABELS = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar
                      aside nav navbar navigation menu breadcrumb breadcrumbs header masthead footer copyright comment comments
                      disqus respond reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter
                      subscribe subscription signup login share sharing social related recommended widget toolbar pagination
                      pager""".split())
CORE = frozenset("html body main article".split())
# Which open elements a start tag ends, and the elements that stop the search.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
        "option": ("option",), "thead": ("tbody", "tr", "td"), "tbody": ("thead", "tbody", "tr", "td", "th"),
        "tfoot": ("tbody", "tr", "td", "th")}
BOUNDS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}


NO, MAYBE, YES = range(3)


def unwanted(name: str, attributes: str) -> int:
    """Whether an element is no part of the article; MAYBE if a label is only a part of a class or id."""
    if name in NOT_ARTICLE:
        return YES
    if not attributes or name in CORE:
        return NO
    found = NO
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return YES
        if key == "style" and UNSEEN.search(value):
            return YES
        if key == "role" and value.lower() in ROLES:
            return YES
        if key in ("class", "id"):
            if any(x in LABELS for x in value.lower().split()):
                return YES
            if any(x.lower() in LABELS for x in PARTS.findall(value)):
                found = MAYBE
    return found


class Page:
    """The block tree of a page: per node its parent, tags, link tags and characters, and the text blocks in page order."""

    def __init__(self, source: str):
        self.parent, self.tags, self.links, self.chars, self.link_chars = [-1], [0], [0], [0], [0]
        self.blocks: list[tuple[int, str, int, int, int]] = []  # node, text, tags, link characters, link tags
        self.doubtful: list[int] = []  # nodes that a part of a class or id calls no article
        self.all_chars = self.all_link_chars = 0  # of the page with its menus
        self.open: list[tuple[str, int, bool, bool]] = [("body", 0, False, False)]  # name, node, unwanted, in a link
        self.pieces: list[str] = []
        self.block_tags = self.block_links = self.block_link_chars = 0
        self.read(source)
        self.flush()

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.pieces)).strip()
        node = self.open[-1][1]
        self.tags[node] += self.block_tags
        self.links[node] += self.block_links
        if text:
            self.blocks.append((node, text, self.block_tags, min(len(text), self.block_link_chars), self.block_links))
            self.chars[node] += len(text)
            self.link_chars[node] += min(len(text), self.block_link_chars)
        self.pieces, self.block_tags, self.block_links, self.block_link_chars = [], 0, 0, 0

    def text(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        size = len(text.strip())
        _, _, hidden, link = self.open[-1]
        self.all_chars += size
        self.all_link_chars += size * link
        if not hidden:
            self.pieces.append(text)
            self.block_link_chars += size * link

    def close_to(self, depth: int) -> None:
        if any(x[0] not in INLINE for x in self.open[depth:]):
            self.flush()
        del self.open[depth:]

    def start(self, name: str, attributes: str) -> None:
        if name not in INLINE:
            for depth in range(len(self.open) - 1, 0, -1):  # only inline elements can stand between a paragraph and its text
                if self.open[depth][0] == "p":
                    self.close_to(depth)
                    break
                if self.open[depth][0] not in INLINE:
                    break
        if name in ENDS:
            stop = BOUNDS.get(name, ("table",))
            for depth in range(len(self.open) - 1, 0, -1):
                if self.open[depth][0] in stop:
                    break
                if self.open[depth][0] in ENDS[name]:
                    self.close_to(depth)
                    if name != "tr" and not name.startswith("t"):
                        break
        _, node, hidden, link = self.open[-1]
        found = NO if hidden else unwanted(name, attributes)
        hidden = hidden or found == YES or found == MAYBE and name in INLINE
        if name in INLINE:
            if not hidden:
                self.block_tags += 1
                self.block_links += name == "a"
            if name == "br" and not self.open[-1][2]:
                self.pieces.append(" ")
        else:
            self.flush()
            if not hidden:
                self.parent.append(node)
                self.tags[node] += 1
                for column in (self.tags, self.links, self.chars, self.link_chars):
                    column.append(0)
                node = len(self.parent) - 1
                if found == MAYBE:
                    self.doubtful.append(node)
        if name not in VOID:
            self.open.append((name, node, hidden, link or name == "a"))

    def end(self, name: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][0] == name:
                self.close_to(depth)
                return
            if name in INLINE and self.open[depth][0] not in INLINE:
                return

    def read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            tag = source.find("<", at)
            if tag < 0:
                self.text(source[at:])
                return
            if tag > at:
                self.text(source[at:tag])
            follow = source[tag + 1:tag + 2]
            if source.startswith("<!--", tag):
                end = source.find("-->", tag + 4)
                at = size if end < 0 else end + 3
            elif follow in ("!", "?"):
                end = source.find(">", tag)
                at = size if end < 0 else end + 1
            elif follow.isascii() and follow.isalpha() or follow == "/":
                if source.find(">", tag) < 0:
                    return
                found = TAG.match(source, tag)
                if not found:  # "</" without a name
                    at = source.find(">", tag) + 1
                    continue
                at, name = found.end(), found[1].lower()
                if follow == "/":
                    self.end(name)
                else:
                    if name in ("html", "body"):
                        self.tags[0] += 1
                        continue
                    self.start(name, found[2])
                    if name in RAW:
                        end = re.compile(f"</{name}\\b", re.I).search(source, at)
                        at = end.start() if end else size
            else:
                self.text("<")
                at = tag + 1


    def drop_doubtful(self) -> None:
        """Take out the doubtful elements that hold at most half of the text outside links."""
        plain = [c - l for c, l in zip(self.chars, self.link_chars)]
        for node in range(len(plain) - 1, 0, -1):
            plain[self.parent[node]] += plain[node]
        gone = {node for node in self.doubtful if 2 * plain[node] <= plain[0]}
        for node in gone:
            self.tags[self.parent[node]] -= 1
        for node in range(1, len(plain)):  # children have larger numbers than their parent
            if node in gone or self.parent[node] in gone:
                gone.add(node)
                self.tags[node] = self.links[node] = self.chars[node] = self.link_chars[node] = 0
        self.blocks = [block for block in self.blocks if block[0] not in gone]


def density(chars: int, tags: int, link_chars: int, links: int, body_ratio: float) -> float:
    if not chars:
        return 0.0
    plain = chars / max(tags, 1)
    base = math.log(chars * link_chars / max(chars - link_chars, 1) + body_ratio * chars + math.e)
    if base <= 1 + 1e-12:
        return plain
    return plain * max(0.0, math.log(chars / max(link_chars, 1) * max(tags, 1) / max(links, 1)) / math.log(base))


def main_blocks(source: str) -> list[str]:
    page = Page(source)
    if page.doubtful:
        page.drop_doubtful()
    if not page.blocks:
        return []
    count, ratio = len(page.parent), page.all_link_chars / max(page.all_chars, 1)
    columns = [page.chars, page.tags, page.link_chars, page.links]
    for node in range(count - 1, 0, -1):  # children have larger numbers than their parent
        for column in columns:
            column[page.parent[node]] += column[node]
    dense = [density(*(c[node] for c in columns), ratio) for node in range(count)]
    total = [0.0] * count
    for node, text, tags, link_chars, links in page.blocks:
        total[node] += density(len(text), max(tags, 1), link_chars, links, ratio)
    for node in range(1, count):
        total[page.parent[node]] += dense[node]
    best = list(range(count))
    for node in range(count - 1, 0, -1):
        above = page.parent[node]
        if (total[best[node]], -best[node]) > (total[best[above]], -best[above]):
            best[above] = best[node]
    core, threshold = best[0], math.inf
    node = core
    while node >= 0:
        threshold, node = min(threshold, dense[node]), page.parent[node]
    marked = {best[node] for node in range(count) if dense[node] >= threshold}
    kept = [False] * count
    for node in range(count):
        kept[node] = node in marked or node > 0 and kept[page.parent[node]]
    return [block[1] for block in page.blocks if kept[block[0]]]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its number of code points for every row of `pages(page_id, url, html)`."""
    def columns(batch, sources):
        texts = ["\n\n".join(main_blocks(x.decode("utf-8", "replace"))) for x in sources]
        return [batch.column(0), batch.column(1), texts, [len(x) for x in texts]]

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("text"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return map_texts(rows, columns, f"page_id {kind}, url string, text string, n_chars bigint")
