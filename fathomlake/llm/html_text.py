"""Main text of web pages by minimum-cut labelling.

A page is read into blocks of text. A linear classifier over a block's own features (length, share of links, end, kind
of element, share of the page's text that its container holds, and what the elements around it are called) gives it a
score; a positive score is the capacity of its edge from the source (content), a negative one that of its edge to the sink
(boilerplate). Smoothness edges of the same size tie neighbours by their distance in the tree of elements, and blocks of one
container. The blocks on the source's side of a minimum cut, found by max-flow, are the article: a headline or a short
line of it stays for its neighbours' sake, and a long sentence of a menu goes with the menu.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page. Those of RAW hold no markup either.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROP = RAW | frozenset("head noscript template svg math object canvas audio video select button datalist map".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted outbrain taboola banner cookie cookies consent gdpr notice notices notification alert popup "
    "modal overlay paywall subscribe subscription newsletter signup login signin register comment comments disqus respond reply replies discussion sidebar side rail widget "
    "widgets related recommended recommendations trending popular menu nav navbar navigation navi breadcrumb breadcrumbs crumb crumbs pagination pager footer foot copyright legal "
    "share sharing social follow toolbar tags tagcloud skip search searchbox masthead topbar bottombar metanav feedback rating ratings survey form".split()
)
GOOD_NAMES = frozenset("article articlebody post postbody entry story content maincontent main body bodytext text prose".split())
#: Elements that hold a line of running text, and headings among them.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_TAGS = HEADINGS | frozenset("p li blockquote pre dt dd figcaption caption td th summary address".split())
#: Scores in hundredths of a nat: for every block; for the kinds of elements and names around it; for its links; for a short
#: one without an end; for one with an end; for a heading; for the share of the page's text in its container; for each
#: character, up to a number of characters.
BIAS, INSIDE, OUTSIDE, BAD, HEADER, BAD_NAME, GOOD_NAME = -140, 300, -300, -600, -450, -500, 250
LINKS, SHORT, ENDED, HEADING, SHARE, PER_CHAR, MOST_CHARS = -300, -80, 40, 60, 150, 0.5, 400
#: Smoothness of neighbours by their distance in the tree, from 0 on; a part of it where their elements are of other kinds;
#: blocks of one container that aren't neighbours; neighbours across the border of an article, a menu and the like.
NEAR, OTHER_KIND, CONTAINER, APART = (250, 250, 200, 100, 60, 30), 0.3, 40, 5

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</\s*(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(?P<odd>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)", re.S)
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: A start tag that ends an open element of these kinds, up to the given container.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}),
}


class Block:
    """A piece of text: ``path`` has the numbers of the block elements around it, ``kind`` its own element's tag."""

    __slots__ = ("bad", "chars", "good", "inside", "kind", "links", "parts", "path", "score", "text")

    def __init__(self, path: tuple[int, ...], around: _Open, kind: str):
        self.path, self.kind, self.parts, self.links = path, kind, [], 0
        self.bad, self.good, self.inside = around.bad, around.good, around.inside

    @property
    def container(self) -> int:
        """The element around a line of text, or a block's own."""
        return self.path[-2] if self.kind in TEXT_TAGS and len(self.path) > 1 else self.path[-1]


class _Open:
    __slots__ = ("bad", "drop", "good", "inside", "link", "number", "path", "tag")

    def __init__(self, tag: str, number: int, over: _Open | None):
        self.tag, self.number = tag, number
        self.bad, self.good, self.inside, self.drop, self.link, self.path = (over.bad, over.good, over.inside, over.drop, over.link, over.path) if over else (0, False, False, False, False, (0,))
        if tag in BLOCK:
            self.path = (*self.path, number)


def _opened(tag: str, attrs: str, number: int, over: _Open) -> _Open:
    el = _Open(tag, number, over)
    if tag in DROP:
        el.drop = True
    elif tag == "a":
        el.link = True
    names: set[str] = set()
    role = ""
    if attrs:
        for k, a, b, c in ATTR.findall(attrs):
            k, v = k.lower(), a or b or c
            if k in ("class", "id"):
                names.update(x.lower() for x in NAME.findall(html.unescape(v)))
            elif k == "role":
                role = v.strip().lower()
            elif k == "itemprop" and v.lower() == "articlebody":
                role = "main"
            elif (k == "style" and HIDDEN.search(v)) or k == "hidden" or (k == "aria-hidden" and v.lower() == "true"):
                el.drop = True
    if tag not in ("html", "body"):
        if tag in ("article", "main") or role in ("main", "article"):
            el.inside = True
        if tag in BAD_TAGS or role in BAD_ROLES:
            el.bad = BAD
        elif names & BAD_NAMES:
            el.bad = min(over.bad, BAD_NAME)
        elif (tag == "header" or "header" in names) and not over.inside:
            el.bad = min(over.bad, HEADER)
        if names & GOOD_NAMES and not names & BAD_NAMES:
            el.good = True
    return el


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order; white space is one space, character references are decoded."""
    root = _Open("", 0, None)
    stack, blocks, current, count, at = [root], [], None, 0, 0

    def text(raw: str) -> None:
        nonlocal current
        top = stack[-1]
        if top.drop or not raw:
            return
        if current is None:
            if raw.isspace():
                return
            current = Block(top.path, top, next((e.tag for e in reversed(stack) if e.tag in BLOCK), ""))
            blocks.append(current)
        raw = html.unescape(raw)
        current.parts.append(raw)
        if top.link:
            current.links += len(raw.strip())

    while (m := TOKEN.search(page, at)) is not None:
        text(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            text(m["cdata"])
        elif (name := m["tag"] or m["odd"]) is not None:  # an odd tag has a quote that nothing ends: its attributes aren't read
            tag, attrs = name.lower(), m["attrs"] or ""
            if tag in BLOCK:
                current = None
                if tag in ENDS:
                    kinds, bounds = ENDS[tag]
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag in bounds:
                            break
                        if stack[k].tag in kinds:
                            del stack[k:]
                            break
                for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph and what is open in it
                    if stack[k].tag == "p":
                        del stack[k:]
                        break
                    if stack[k].tag in BLOCK:
                        break
            elif tag == "br":
                text(" ")
            elif tag == "a":  # links don't nest
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "a":
                        del stack[k:]
                        break
                    if stack[k].tag in BLOCK:
                        break
            if tag not in VOID and not (attrs.endswith("/") and tag not in BLOCK | DROP):
                count += 1
                if tag == "body":  # whatever the head left open ends here
                    del stack[1:]
                stack.append(_opened(tag, attrs, count, stack[-1]))
                if tag in RAW:
                    end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                    at = end.start() if end else len(page)
        elif m["end"] is not None:
            tag = m["end"].lower()
            if tag in BLOCK:
                current = None
            elif tag == "br":
                text(" ")
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK and tag not in BLOCK:
                    break
    text(page[at:])
    kept = []
    for b in blocks:
        b.text = " ".join("".join(b.parts).split())
        if b.text:
            b.chars = len(b.text)
            kept.append(b)
    return kept


def scores_of(blocks: list[Block]) -> None:
    has_inside = any(b.inside and not b.bad for b in blocks)
    held: dict[int, int] = {}
    for b in blocks:
        held[b.container] = held.get(b.container, 0) + max(0, b.chars - b.links)
    total = max(1, sum(held.values()))
    for b in blocks:
        s = BIAS + b.bad + (INSIDE if b.inside else OUTSIDE if has_inside else 0) + GOOD_NAME * b.good + HEADING * (b.kind in HEADINGS)
        s += PER_CHAR * min(b.chars, MOST_CHARS) + LINKS * min(1.0, b.links / b.chars) + SHARE * held[b.container] / total
        ended = b.text[-1] in ".!?:;…\"”»)"
        s += ENDED if ended else SHORT if b.chars < 40 else 0
        b.score = round(s)


def closeness(a: Block, b: Block) -> int:
    """Smoothness of two neighbours."""
    if bool(a.bad) != bool(b.bad) or a.inside != b.inside:
        return APART
    common = 0
    for x, y in zip(a.path, b.path):
        if x != y:
            break
        common += 1
    near = NEAR[min(len(a.path) + len(b.path) - 2 * common, len(NEAR) - 1)]
    return near if (a.kind in TEXT_TAGS) == (b.kind in TEXT_TAGS) else round(near * OTHER_KIND)


class MaxFlow:
    """Dinic's algorithm on a small graph with integer capacities."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[int] = []

    def edge(self, a: int, b: int, cap: int, back: int = 0) -> None:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.cap += [cap, back]

    def levels(self, s: int) -> list[int]:
        level = [-1] * len(self.out)
        level[s], queue = 0, [s]
        for a in queue:
            for e in self.out[a]:
                if self.cap[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def run(self, s: int, t: int) -> list[bool]:
        """Push all flow; True for the nodes on the source's side of the least minimum cut."""
        while (level := self.levels(s))[t] >= 0:
            nxt, path, a = [0] * len(self.out), [], s
            while True:
                if a == t:
                    low = min(self.cap[e] for e in path)
                    for k, e in enumerate(path):
                        self.cap[e] -= low
                        self.cap[e ^ 1] += low
                    k = next(k for k, e in enumerate(path) if not self.cap[e])
                    a = self.to[path[k] ^ 1]
                    del path[k:]
                    continue
                while nxt[a] < len(self.out[a]):
                    e = self.out[a][nxt[a]]
                    if self.cap[e] and level[self.to[e]] == level[a] + 1:
                        break
                    nxt[a] += 1
                if nxt[a] < len(self.out[a]):
                    path.append(self.out[a][nxt[a]])
                    a = self.to[path[-1]]
                elif path:
                    a = self.to[path.pop() ^ 1]
                    nxt[a] += 1
                else:
                    break
        return [x >= 0 for x in level]


def labels_of(blocks: list[Block]) -> list[bool]:
    """True for content: the source's side of the minimum cut."""
    n = len(blocks)
    flow, last = MaxFlow(n + 2), {}
    for i, b in enumerate(blocks):
        if b.score > 0:
            flow.edge(n, i, b.score)
        elif b.score < 0:
            flow.edge(i, n + 1, -b.score)
        if i:
            w = closeness(blocks[i - 1], b)
            flow.edge(i - 1, i, w, w)
        k = last.get(b.container)
        if k is not None and k != i - 1:
            w = min(CONTAINER, closeness(blocks[k], b))
            flow.edge(k, i, w, w)
        last[b.container] = i
    return flow.run(n, n + 1)[:n]


def main_text(page: str | None) -> str:
    """The article's blocks joined by an empty line; '' if there are none."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    scores_of(blocks)
    return "\n\n".join(b.text for b, keep in zip(blocks, labels_of(blocks)) if keep)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars.

    Null or empty html, and pages without content, give an empty text and 0. Repeated rows and null keys are
    kept as they are; no rows give none; other columns are ignored.
    """

    def texts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            found = [main_text(x) for x in p["html"]]
            yield pd.DataFrame({"page_id": p["page_id"].astype("Int64"), "url": p["url"], "text": found, "n_chars": [len(x) for x in found]})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(pages[html_col], F.lit("")).alias("html"))
    return rows.mapInPandas(texts, "page_id bigint, url string, text string, n_chars bigint")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
