"""Main text of web pages by tag-path ratios.

A page becomes text nodes, each with the path of tags from the root. For each path the text length and the punctuation of
its nodes are added up and divided by the number of its nodes; nodes' values in page order are smoothed by a Gaussian
window; length and punctuation ratios are fused by their product, scaled by the spread of each; paths over a threshold
(a share of the fused values' standard deviation) are content, and so are their nodes. What is returned is everything
inside the elements that hold the content nodes, in page order: the outermost main and article elements that hold any,
or where there are none, the nearest common ancestor of all content nodes, there without lists and tables of links alone.
Parts whose tags or names mark them as menus, headers, footers, sidebars, notices, adverts, forms or comments are left out
before all that; inside an article only names that can't be part of it count.

Null and empty pages give an empty text; repeated rows are each answered; an empty table gives an empty result; other
columns are kept whatever their names. Broken markup is closed where it must be: a block tag ends an open paragraph, an
end tag ends what is open inside its element, a tag whose quotes don't close ends at its first >, and one without a > is
text. Pages are answered one by one in time in proportion to their length, however deep their tags nest.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of the HTML standard, and usual names of page parts.
OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
LENIENT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
#: A tag that closes itself; a slash that ends a value without quotes doesn't.
CLOSED = re.compile(r"(?:^|[\s\"'])/\s*$")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "br", "hr", "button", "label", "iframe", "head", "title",
}
NEVER = RAW - {"textarea"} | {"head", "nav", "aside", "footer", "form", "button", "select", "input", "menu", "template", "svg", "canvas", "object", "dialog", "textarea", "label"}
MARKED = re.compile(
    r"(?:^|[-_ ])(?:nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|foot|masthead|banner|ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|notice|alert|popup|modal|"
    r"overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommended|comment\w*|respond|replies|disqus|pagination|pager|skip|toolbar|widget|legal|copyright|complementary|contentinfo)(?:$|[-_ ])",
    re.I,
)
#: What names mark inside an article or main element.
MARKED_INSIDE = re.compile(
    r"(?:^|[-_ ])(?:nav|navbar|navigation|breadcrumbs?|sidebar|footer|ads?|advert\w*|sponsor\w*|promo\w*|cookies?|popup|modal|overlay|newsletter|subscribe|signup|"
    r"share|sharing|social|related|recommended|comments?|respond|replies|disqus|pagination|pager|toolbar)(?:$|[-_ ])",
    re.I,
)
#: Headers of the site; headers of an article are content.
TOP = re.compile(r"(?:^|\s)(?:(?:site|page|top|main|global)[-_])?header(?:$|\s)", re.I)
NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"""(?:\s|^)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
CLOSES_P = BLOCK - {"br", "button", "label", "iframe", "option", "select", "legend", "title", "head", "html", "body"}
PUNCTUATION = re.compile(r"[.,;:!?…。，！？；、]")
SPACE = re.compile(r"\s+")
SPREAD_SHARE = 0.2
WINDOW = np.array([0.054, 0.242, 0.399, 0.242, 0.054])


class Element:
    __slots__ = ("tag", "parent", "path", "dropped", "linked", "names", "inside", "holder", "depth", "weight", "held")

    def __init__(self, tag: str, parent: Element | None, attributes: str = "", path: int = 0):
        self.tag, self.parent, self.path = tag, parent, path
        self.names = " ".join(x.strip("\"'") for x in NAMES.findall(attributes)) if attributes else ""
        inside = parent is not None and parent.inside
        self.inside = inside or tag in ("article", "main")
        names = MARKED_INSIDE if inside else MARKED
        marked = bool(self.names and tag not in ("html", "body", "article", "main") and (names.search(self.names) or not inside and TOP.search(self.names))) or bool(attributes and HIDDEN.search(attributes))
        commented = tag == "article" and bool(re.search(r"(?:^|[-_ ])comments?(?:$|[-_ ])", self.names, re.I))
        self.dropped = (parent is not None and parent.dropped) or tag in NEVER or marked or commented or (tag == "header" and not inside)
        self.linked = tag == "a" or (parent is not None and parent.linked)
        self.holder = self if tag in ("ul", "ol", "dl", "table") else parent.holder if parent is not None else None
        self.depth = parent.depth + 1 if parent is not None else 0
        self.weight, self.held = 0.0, False


class Reader:
    """Tokens of a page: matches of TOKEN, or of LENIENT where quotes don't close.

    `failed` holds the quotes from which no end of a tag was reached, so that no stretch of a page is read again and again."""

    def __init__(self, page: str):
        self.page, self.last, self.marks, self.failed = page, page.rfind(">"), None, set()

    def next(self, at: int) -> re.Match | None:
        while (start := OPEN.search(self.page, at)) is not None:
            at = start.start()
            if self.page.startswith("<!--", at) or self.page.startswith("<![CDATA[", at):
                return TOKEN.match(self.page, at)
            if at > self.last:
                return None
            found = (TOKEN if self.page[at + 1] in "!?" or self.closes(at) else LENIENT).match(self.page, at)
            if found is not None:
                return found
            at += 1
        return None

    def closes(self, at: int) -> bool:
        """A > outside quotes ends the tag that begins here."""
        if self.marks is None:
            self.marks = [m.start() for m in re.finditer("[>\"']", self.page)]
            later: dict[str, int] = {}
            self.pair = [-1] * len(self.marks)  # the next mark that is the same character
            for k in range(len(self.marks) - 1, -1, -1):
                c = self.page[self.marks[k]]
                self.pair[k] = later.get(c, -1)
                later[c] = k
        k, seen = bisect_left(self.marks, at), []
        while 0 <= k < len(self.marks) and k not in self.failed:
            if self.page[self.marks[k]] == ">":
                return True
            seen.append(k)
            k = self.pair[k] + 1 if self.pair[k] >= 0 else -1
        self.failed.update(seen)
        return False


def pieces(page: str) -> tuple[list[tuple[Element, str, int]], list[Element]]:
    """(element, text, block number) of the text nodes in page order, without markup and what is never content; all
    elements, parents first."""
    root = Element("", None)
    open_, out, block, at = root, [], 0, 0
    elements, paths, opened, reader = [root], {}, Counter(), Reader(page)

    def text(a: int, b: int) -> None:
        if b > a and not open_.dropped:
            out.append((open_, html.unescape(page[a:b]), block))

    while True:
        m = reader.next(at)
        if m is None:
            text(at, len(page))
            return out, elements
        text(at, m.start())
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if page.startswith("<![CDATA[", m.start()):
                out += [(open_, page[m.start() + 9 : at - 3], block)] if not open_.dropped else []
            continue
        if tag in BLOCK:
            block += 1
        if m[1]:
            e = open_ if opened[tag] else None  # what was never opened isn't looked for
            while e is not None and e.tag != tag:
                if e.tag in ("td", "th", "table", "body", "article", "main") and tag not in ("tr", "table", "tbody", "body", "html", "article", "main", "div", "section"):
                    e = None
                    break
                e = e.parent
            if e is not None and e.parent is not None:
                open_ = e.parent
            continue
        if tag in CLOSES_P or tag in ("li", "dd", "dt", "option", "tr", "td", "th"):
            e = open_
            while e is not None and (e.tag not in BLOCK):
                e = e.parent
            same = tag in ("li", "option", "tr", "td", "th") and e is not None and e.tag == tag or tag in ("dd", "dt") and e is not None and e.tag in ("dd", "dt")
            if e is not None and (e.tag == "p" or same) and e.parent is not None:
                open_ = e.parent
                if e.tag == "p" and open_.tag == tag and tag in ("li", "dd", "dt", "td", "th", "option"):
                    open_ = open_.parent or open_
        if tag in VOID or CLOSED.search(m[3]) and tag not in BLOCK:
            continue
        e = Element(tag, open_, m[3], paths.setdefault((open_.path, tag), len(paths) + 1))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        elements.append(e)
        opened[tag] += 1
        open_ = e


def content(nodes: list[tuple[Element, str, int]]) -> set[int]:
    """The tag paths over the threshold."""
    paths: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    for e, text, _ in nodes:
        p = paths[e.path]
        p[0] += 1
        p[1] += 0 if e.linked else len(text)
        p[2] += 0 if e.linked else len(PUNCTUATION.findall(text))
    ratio = np.array([[paths[e.path][1] / paths[e.path][0], paths[e.path][2] / paths[e.path][0]] for e, _, _ in nodes])
    for k in range(2):
        padded = np.pad(ratio[:, k], 2, mode="edge")
        ratio[:, k] = np.convolve(padded, WINDOW, "valid")
    scale = ratio.std(0) + ratio.mean(0) + 1e-9
    fused = (ratio[:, 0] / scale[0]) * (1 + ratio[:, 1] / scale[1])
    limit = SPREAD_SHARE * fused.std()
    best: dict[int, float] = defaultdict(float)
    for (e, _, _), value in zip(nodes, fused, strict=True):
        best[e.path] = max(best[e.path], value)
    return {p for p, v in best.items() if v >= limit and paths[p][1] > 0}


def main_text(page: str | None) -> str:
    nodes, elements = pieces(page or "")
    nodes = [x for x in nodes if x[1].strip()]
    if not nodes:
        return ""
    good = content(nodes)
    content_nodes = [e for e, _, _ in nodes if e.path in good] or [e for e, _, _ in nodes]
    for e in content_nodes:
        e.weight += 1
    for e in reversed(elements):  # children before parents
        if e.parent is not None:
            e.parent.weight += e.weight
    tops = {e for e in elements if e.tag in ("article", "main") and e.weight and not e.dropped and not (e.parent is not None and e.parent.inside)}
    if not tops:
        tops = {max((e for e in elements if e.weight == len(content_nodes)), key=lambda e: e.depth)}
    for e in elements:  # parents before children
        e.held = e in tops or (e.parent is not None and e.parent.held)
    return joined([x for x in nodes if x[0].held])


def joined(nodes: list[tuple[Element, str, int]]) -> str:
    """The blocks of the nodes; outside articles a list or table of nothing but links is a menu."""
    blocks: dict[int, list[tuple[Element, str]]] = {}
    plain: set[Element] = set()
    for e, text, block in nodes:
        blocks.setdefault(block, []).append((e, text))
        if e.holder is not None and (e.inside or not e.linked):
            plain.add(e.holder)
    out = []
    for parts in blocks.values():
        holder = parts[0][0].holder
        if holder is not None and holder not in plain:
            continue
        text = SPACE.sub(" ", "".join(t for _, t in parts)).strip()
        if text:
            out.append(text)
    return " ".join(out)


def extract(batch: pa.RecordBatch):
    """The last column, html, gives way to text."""
    text = [main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(text, pa.string())], names=[*batch.schema.names[:-1], "text"])


def main_texts(pages: DataFrame) -> DataFrame:
    """pages, whose last column is the html, with text in its place."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            yield from extract(batch)

    return pages.mapInArrow(run, f"{kept}, text string")
