"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from nightjar.llm.common import arrow_map, typed

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas head title select option textarea button datalist audio video map".split())
INLINE |= (SILENT - {"head", "title"}) | {"img", "input", "label", "picture", "source", "embed"}
SIDE = frozenset("nav footer aside form menu dialog header".split())
MAIN = frozenset(["article", "main"])
#: Share of the text that a side area may hold at most, if only its name or a form makes it one.
MOST = 0.75
#: Words of a class, id or role that name what is no part of the article.
SIDE_NAMES = frozenset((
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright dialog disqus footer gdpr login menu modal nav "
    "navbar navigation newsletter notice paywall popup promo promoted promotion recommended related replies reply search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe toolbar widget").split())
#: What starts anew closes an open element of the second kind, unless one of the third lies between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
NAME = re.compile(r"[A-Za-z0-9]+")


@dataclass
class Node:
    """One stretch of text: its block, its elements from the root down (a path) and what kind of place it is in."""

    block: int
    path: tuple
    text: str
    main: int  # which article or main element it lies in, 0 for none
    side: tuple  # numbers of the side areas it lies in, from the root down
    link: bool


class _Reader(HTMLParser):
    """Text nodes of a page, with the implied end tags that matter for paths."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple] = []  # tag, label, main, side, link, silent
        self.nodes: list[Node] = []
        self.block = self.mains = 0
        self.sure: list[bool] = []  # per side area, whether its element says so and not a name or form alone
        self.holds: set[int] = set()  # side areas with an article or main element inside

    def _close(self, targets: frozenset | set, stop: frozenset | set) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in targets:
                del self.open[i:]
                return
            if self.open[i][0] in stop:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self.block += 1
            if tag not in VOID or tag == "hr":
                self._close({"p"}, {"table", "button", "article", "section", "body"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in VOID:
            return
        given = dict(attrs)
        names = [n.lower() for a in ("class", "id", "role") if given.get(a) for n in NAME.findall(given[a])]
        _, _, main, side, link, silent = self.open[-1] if self.open else ("", "", 0, (), False, False)
        own = tag in MAIN or "main" in (given.get("role") or "").split()
        if own:
            self.holds.update(side)
            if not main:
                self.mains += 1
                main = self.mains
        if tag not in ("html", "body"):
            sure = "hidden" in given or (tag in SIDE and tag != "form" and not (tag == "header" and main))
            named = tag == "form" or any(n in SIDE_NAMES for n in names)
            if sure or named and not (own and all(x[0] != "article" for x in self.open)):
                side += (len(self.sure),)
                self.sure.append(sure)
        label = tag + "".join(f".{n}" for n in names[:3])
        self.open.append((tag, label, main, side, link or tag == "a", silent or tag in SILENT))

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.block += 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        _, _, main, side, link, silent = self.open[-1] if self.open else ("", "", 0, (), False, False)
        if not silent:
            self.nodes.append(Node(self.block, tuple(x[1] for x in self.open), data, main, side, link))


def text_nodes(html: str) -> list[Node]:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    _settle_sides(reader)
    return reader.nodes


def _settle_sides(reader: _Reader) -> None:
    """Lift side areas that a name or a form alone makes, from the root down, where they hold the article.

    That is where no article or main element has text outside side areas and the area holds one, or holds
    ``MOST`` of the text outside links and other areas; an area with an article or main element that holds
    ``MOST`` of the text is lifted in any case.
    """
    while True:
        size: dict = defaultdict(int)
        free = False
        for n in reader.nodes:
            if n.text.strip():
                size[n.side[0] if n.side else None] += 0 if n.link else len(n.text.strip())
                free = free or bool(n.main and not n.side)
        loose = [s for s in size if s is not None and not reader.sure[s]]
        lifted = set() if free else {s for s in loose if s in reader.holds}
        if not lifted and loose:
            s = max(loose, key=lambda s: (size[s], -s))
            if 0 < size[s] >= MOST * (size[s] + size.get(None, 0)) and (not free or s in reader.holds):
                lifted = {s}
        if not lifted:
            return
        for n in reader.nodes:
            if n.side and n.side[0] in lifted:
                n.side = n.side[1:]


def path_scores(nodes: list[Node], reach: int = 2) -> dict[tuple, float]:
    """Fused, smoothed ratio per path.

    The text ratio of a path is its characters over its nodes, the punctuation ratio its punctuation over
    its nodes. Both are averaged over ``reach`` nodes before and after in page order, since the paths of
    an article lie together, and multiplied with each other and with the path's share of text outside links.
    """
    chars, marks, links, count = (defaultdict(float) for _ in range(4))
    seen = [n for n in nodes if n.text.strip()]
    for n in seen:
        size = len(" ".join(n.text.split()))
        chars[n.path] += size
        links[n.path] += size * n.link
        marks[n.path] += len(PUNCTUATION.findall(n.text))
        count[n.path] += 1
    text = [chars[n.path] / count[n.path] for n in seen]
    mark = [marks[n.path] / count[n.path] for n in seen]
    fused: dict[tuple, list] = defaultdict(list)
    for i, n in enumerate(seen):
        a, b = max(0, i - reach), i + reach + 1
        own = text[a:b], mark[a:b]
        fused[n.path].append((sum(own[0]) / len(own[0])) * (1 + sum(own[1]) / len(own[1])))
    return {p: sum(x) / len(x) * (1 - links[p] / chars[p]) for p, x in fused.items()}


def main_text(html: str | None, share: float = 0.25) -> str:
    """The article of a page, blocks joined by one space; empty if there is none.

    Paths that score ``share`` of the best path's score or more, by ratios over all text outside
    side areas, are content. The article is the article or main element with the most content text if the
    page has one, else the smallest common element of the content paths; all of its text outside side areas
    is kept (``_settle_sides`` says which names make none), so headings and short paragraphs between the content nodes stay; in the latter case blocks of
    nothing but links on low paths go.
    """
    nodes = [n for n in text_nodes(html or "") if not n.side]
    marked = [n for n in nodes if n.main and n.text.strip()]
    pool = marked or [n for n in nodes if n.text.strip()]
    if not pool:
        return ""
    scores = path_scores(pool)
    limit = share * max(scores.values())
    content = [n for n in pool if scores[n.path] >= limit]
    if marked:
        size: dict[int, int] = defaultdict(int)
        for n in content:
            size[n.main] += len(n.text)
        best = max(size, key=lambda m: (size[m], -m))
        kept = [n for n in nodes if n.main == best]
    else:
        shared = list(content[0].path)
        for n in content[1:]:
            k = 0
            while k < min(len(shared), len(n.path)) and shared[k] == n.path[k]:
                k += 1
            del shared[k:]
        low = set(scores) - {n.path for n in content}
        root = tuple(shared)
        told = {n.block for n in nodes if not n.link and any(c.isalnum() for c in n.text)}
        kept = [n for n in nodes if n.path[:len(root)] == root and not (n.link and n.path in low and n.block not in told)]
    blocks: list[str] = []
    last = None
    for n in kept:
        if n.block == last:
            blocks[-1] += n.text
        else:
            blocks.append(n.text)
        last = n.block
    return " ".join(" ".join(" ".join(b.split()) for b in blocks).split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    Pages are parsed and scored on their own, whole, in any order: nothing is shuffled. A null or empty
    page, and one without text outside side areas, gives an empty text. Equal rows give equal rows; an
    empty table gives an empty one; extra columns are ignored.
    """
    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.table([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                           names=["page_id", "url", "text", "n_chars"])

    return arrow_map(typed(pages, page_id="bigint", url="string", html="string"), run, "page_id bigint, url string, text string, n_chars bigint")
