"""Main text of HTML pages by a minimum cut.

A page is a list of text blocks. What a block's place and text say becomes two costs: of taking it for content and of
leaving it out. They are the capacities from the source and to the sink; neighbours in page order and blocks of one
parent are joined by smoothness edges. The minimum cut gives the cheapest labelling of all blocks together.
"""

from __future__ import annotations

import re
from collections import deque
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt
fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav
noscript ol optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr
ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text never is the page's main text. A form is not among them: some sites wrap one around every page.
OUTSIDE = frozenset("""aside button dialog footer head iframe menu nav noscript object option script select style
svg template textarea title""".split())
#: Words of a class, an id or a role that speak for the same.
WORDS = frozenset("""ad ads adv advert adverts advertisement advertising advertorial alert banner breadcrumb breadcrumbs
comment comments complementary consent contentinfo cookie cookies copyright dialog disclaimer discussion disqus footer
form gdpr login menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup
promo promoted promotion recommended related remark remarks replies reply responses search share sharing sidebar signup social
sponsor sponsored subscribe subscription toolbar widget""".split())
#: Words of what readers wrote; they count in full beside any other word.
REMARKS = frozenset("comment comments discussion disqus remark remarks replies reply responses".split())
#: The same outside of the article only; inside they may hold its title.
TOPS = frozenset("header masthead".split())
SURE = 1_000_000
#: Cost of taking a block below an element named by such words alone (``cookie-notice``), or by other words too (``has-sidebar``).
NAMED, PARTLY = 600, 350
#: Elements that may stand in the head; any other closes it.
HEADERS = frozenset("base head html link meta noscript script style template title".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Block:
    __slots__ = ("text", "parent", "outside", "inside", "heading", "linked", "mark", "area", "named")

    def __init__(self, text, parent, outside, inside, heading, linked, mark=0, area=0):
        self.text, self.parent, self.outside, self.inside = text, parent, outside, inside
        self.heading, self.linked, self.mark, self.area, self.named = heading, linked, mark, area, 0


class _Reader(HTMLParser):
    """Blocks in page order. An element is (tag, outside, inside the article, number of its nearest block element, of its
    nearest element marked by words, of its nearest article or main element)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, int, int, int]] = []
        self.blocks: list[Block] = []
        self.text: list[str] = []
        self.linked = 0
        self.number = 0
        #: (cost, outer mark) of each element marked by words and (tag, outer area, outside, mark) of each article or main; 0: none.
        self.marks: list[tuple[int, int]] = [(0, 0)]
        self.areas: list[tuple[str, int, bool, int]] = [("", 0, True, 0)]

    def close_head(self, tag):
        """The head's end tag may be left out: the body, or anything that cannot stand in a head, ends it."""
        if tag not in HEADERS and self.stack and (self.stack[-1][0] == "head" or tag == "body"):
            for k, e in enumerate(self.stack):
                if e[0] == "head":
                    self.flush()
                    del self.stack[k:]
                    break

    def handle_starttag(self, tag, attrs):
        self.close_head(tag)
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        if tag in BLOCKS and self.stack and self.stack[-1][0] == "p":
            self.stack.pop()
        if tag in ("li", "option", "dt", "dd", "tr", "td", "th") and self.stack and self.stack[-1][0] == tag:
            self.stack.pop()
        _, outside, inside, number, mark, area = self.stack[-1] if self.stack else ("", False, False, 0, 0, 0)
        inside = inside or tag in ("article", "main")
        cost = NAMED if tag == "form" else 0
        if not outside:
            outside = tag in OUTSIDE or tag == "header" and not inside
            for name, value in attrs:
                if name == "hidden" or name == "aria-hidden" and value == "true":
                    cost = NAMED  # finite, as it may stand on an element around the article
                elif name in ("class", "id", "role") and value and tag not in ("html", "body"):
                    barred = WORDS if inside else WORDS | TOPS
                    for one in value.split():
                        words = {w.lower() for w in _PARTS.findall(one)}
                        if words & barred:
                            cost = max(cost, PARTLY if words - barred and not words & REMARKS else NAMED)
        if cost:
            self.marks.append((cost, mark))
            mark = len(self.marks) - 1
        if tag in ("article", "main"):
            self.areas.append((tag, area, outside, mark))
            area = len(self.areas) - 1
        if tag in BLOCKS:
            self.number += 1
            number = self.number
        self.stack.append((tag, outside, inside, number, mark, area))

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] in ("script", "style"):
            return
        if data.strip():
            self.close_head("")
        self.text.append(data)
        if any(e[0] == "a" for e in self.stack[-4:]):
            self.linked += len(data)

    def flush(self):
        words = "".join(self.text).split()
        if words:
            _, outside, inside, _, mark, area = self.stack[-1] if self.stack else ("", False, False, 0, 0, 0)
            text = " ".join(words)
            near = [e for e in self.stack if e[0] in BLOCKS]
            parent = near[-2][3] if len(near) > 1 else 0
            heading = bool(near) and near[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6")
            self.blocks.append(Block(text, parent, outside, inside, heading, min(1.0, self.linked / len(text)), mark, area))
        self.text, self.linked = [], 0


def blocks_of(html: str) -> list[Block]:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    weigh(reader)
    return reader.blocks


def _sums(sizes: list[int], outer: list[int]) -> list[int]:
    """Of every element its own size and those of all within it; outer elements have smaller numbers."""
    for k in range(len(sizes) - 1, 0, -1):
        sizes[outer[k]] += sizes[k]
    return sizes


def weigh(page: _Reader) -> None:
    """Give each block the cost of the words that mark the elements around it.

    A mark does not count on an element that holds the main element, the largest article if that has a quarter of the page's
    text, or most of the text: of that article, of the main element, or else of the page.
    """
    marks, areas = page.marks, page.areas
    if len(marks) == 1:
        return
    outer = [a for _, a, _, _ in areas]
    sizes = [0] * len(areas)
    for b in page.blocks:
        if not b.outside:
            sizes[b.area] += len(b.text)
    sizes = _sums(sizes, outer)
    main = next((k for k, a in enumerate(areas) if a[0] == "main" and not a[2]), 0)
    within = [main == 0] + [False] * (len(areas) - 1)  # areas in the main element, or all
    for k in range(1, len(areas)):
        within[k] = k == main or within[outer[k]]
    article = max((k for k, a in enumerate(areas) if a[0] == "article" and not a[2] and within[k]), key=lambda k: (sizes[k], -k), default=0)
    if 4 * sizes[article] < sizes[main]:  # sizes[0] is the page's
        article = 0
    scope = article or main
    within = [scope == 0] + [False] * (len(areas) - 1)
    for k in range(1, len(areas)):
        within[k] = k == scope or within[outer[k]]
    held = [0] * len(marks)
    for b in page.blocks:
        if not b.outside and within[b.area]:
            held[b.mark] += len(b.text)
    held = _sums(held, [m for _, m in marks])
    free = set()
    for k in (main, article):
        mark = areas[k][3]
        while mark:
            free.add(mark)
            mark = marks[mark][1]
    named = [0] * len(marks)
    for k in range(1, len(marks)):
        cost, mark = marks[k]
        most = 2 * held[k] > held[0] if cost == PARTLY else 4 * held[k] > 3 * held[0]
        named[k] = named[mark] if k in free or most else max(cost, named[mark])
    for b in page.blocks:
        b.named = named[b.mark]


def costs(block: Block, has_article: bool) -> tuple[int, int]:
    """(cost of leaving the block out, cost of taking it)."""
    if block.outside:
        return 0, SURE
    keep, drop = 10, 10 + block.named
    if has_article:
        keep, drop = (keep + 300, drop) if block.inside else (keep, drop + 300)
    keep += min(len(block.text), 400) // 4 + 15 * sum(block.text.count(c) for c in ".,;:!?") // (1 + len(block.text) // 80)
    drop += int(150 * block.linked)
    if len(block.text) < 25 and not block.heading:
        drop += 25
    return keep, drop


def minimum_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay on the source's side, by augmenting level by level (nodes 0.., source n, sink n + 1)."""
    n = len(source)
    s, t = n, n + 1
    heads, caps, out = [], [], [[] for _ in range(n + 2)]

    def join(a, b, forth, back):
        out[a].append(len(heads))
        heads.append(b)
        caps.append(forth)
        out[b].append(len(heads))
        heads.append(a)
        caps.append(back)

    for i in range(n):
        both = min(source[i], sink[i])  # flows straight through
        if source[i] > both:
            join(s, i, source[i] - both, 0)
        if sink[i] > both:
            join(i, t, sink[i] - both, 0)
    for a, b, weight in edges:
        join(a, b, weight, weight)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if caps[e] and level[heads[e]] < 0:
                    level[heads[e]] = level[a] + 1
                    queue.append(heads[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        node = s
        while True:
            if node == t:
                flow = min(caps[e] for e in path)
                for e in path:
                    caps[e] -= flow
                    caps[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if not caps[e])
                node = heads[path[first] ^ 1]
                del path[first:]
                continue
            while at[node] < len(out[node]):
                e = out[node][at[node]]
                if caps[e] and level[heads[e]] == level[node] + 1:
                    break
                at[node] += 1
            else:
                if node == s:
                    break
                level[node] = -1
                node = heads[path.pop() ^ 1]
                continue
            path.append(e)
            node = heads[e]


def main_text(html: str | None) -> str:
    """Text of the blocks on the content's side, joined by spaces; a null or empty page, or one without: empty."""
    blocks = blocks_of(html or "")
    if not blocks:
        return ""
    has_article = any(b.inside and not b.outside and not b.named for b in blocks)
    pairs = [costs(b, has_article) for b in blocks]
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, 8))
        if b.parent in last and last[b.parent] != i - 1:
            edges.append((last[b.parent], i, 20))
        elif b.parent in last:
            edges[-1] = (i - 1, i, 28)
        last[b.parent] = i
    content = minimum_cut([k for k, _ in pairs], [d for _, d in pairs], edges)
    return " ".join(b.text for b, c in zip(blocks, content) if c)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """The other columns, and ``text`` and ``n_chars`` of each page; input columns of these names give way.

    One row per row: repeated rows and null ids stay as they are. No rows: no rows.
    """
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    names = [f"_c{i}" for i in range(len(keep))]
    rows = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{html}`").alias("_html"))

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=[*names, "text", "n_chars"])

    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "_html")
    return rows.mapInArrow(run, own + "text string, n_chars bigint").toDF(*keep, "text", "n_chars")
