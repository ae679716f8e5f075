"""Main text of web pages by wrapper induction.

The pages of a host share a wrapper, or a few. Every page is parsed; of each of the LAYOUTS most frequent layouts of a host (a
layout is the set of the paths of its upper elements) the page with the lowest hash gives its tree of tags as the reference.
All pages of the host are aligned with the reference of their layout, or the one that fits them best, by simple tree
matching (Yang, 1991): the largest order-preserving matching of children with the same tag, recursively. What the pages have
at each node of the reference is added up where they are read: how many have it, whether its text is always the same, and how
long the text is that varies; text in nodes that the reference lacks belongs to the nearest node that it has.

Constant nodes are the template. The article is the slot that the varying text is in: from the root down, as long as one
container holds SHARE of the varying text of its parent, it is the smallest subtree with most of it. Tags and names only break
ties: text never descends into headings and paragraphs, below ``article`` or ``main``, or into what is away from the article by
its own account (menus, page headers, footers, sidebars, notices, adverts, forms, scripts, reader comments, by tag, role or
class). If what was chosen holds ``article`` or ``main`` elements with text, content is what they hold. In those, headings
and paragraphs are never template, so copies of an article on one host do not erase it; elsewhere constant nodes go if
MANY pages have them.

A page is aligned once more to be read: its own node at the article's place is the content, less template and what is away. Text is
decoded once; white space inside a block becomes one space, blocks are trimmed and joined by one space.

Cases: a null or empty html has the empty text. A null or invalid url has no host and no wrapper; its page is read by place
alone, as is the only page of a layout. Unclosed and unopened tags, open comments and cut-off tags end where the page
ends. Repeated rows stay. Columns other than the id, the url and the html are not read. An empty table gives an empty
table.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillmark.llm.words import frees
from tillmark.sources.shared import discard, written

#: Layouts of a host that get a reference; elements of a page that make its layout lie at most DEPTH deep.
LAYOUTS, DEPTH = 4, 3
#: Pages that a constant node needs to be template, and the share of the varying text that the article's way down holds.
MANY, SHARE = 4, 0.7
#: Nodes of references that a task adds up before it hands them on, and hosts whose references it remembers.
HELD, HOSTS = 50_000, 500
#: Pairs of children up to which two levels are matched without arrays.
NARROW = 600

# Elements by their use in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3
    h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th
    thead tr ul br""".split()
)
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
HOLDS = frozenset("ul ol dl table tbody thead tfoot select article section div body main aside nav".split())
NOT_IN_P = BLOCK - {"br", "option", "legend", "summary", "td", "th", "tr", "tbody", "thead", "tfoot"}
# Places that are not the article.
AWAY_TAGS = frozenset("nav aside footer form button select dialog menu svg canvas object audio video head".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
AWAY_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
    notice notices sidebar menu menus nav navbar navigation navi breadcrumb breadcrumbs footer comment comments reply
    replies respond disqus share sharing social related recommended newsletter subscribe subscription popup modal
    overlay login signup search widget widgets pagination pager copyright toolbar masthead topbar outbrain taboola""".split()
)
HEADERS = frozenset(["header"])
TEXT = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre dt b i em strong a span figcaption".split())
PLAIN = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre td th dd dt b i em strong figcaption article main".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)""",
    re.DOTALL,
)
_NAMES = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")


class Node:
    """An element: its tag, path, whether it is away from the article, and its children, elements and texts in order."""

    __slots__ = ("tag", "path", "away", "inside", "children", "parent")

    def __init__(self, tag: str, path: str, away: bool, inside: bool, parent: Node | None):
        self.tag, self.path, self.away, self.inside, self.parent = tag, path, away, inside, parent
        self.children: list[Node | str] = []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def own(self) -> str:
        return " ".join(" ".join(c for c in self.children if isinstance(c, str)).split())


def _place(tag: str, attributes: str, inside: bool) -> tuple[str, bool]:
    """The element's step in a path, and whether it is away from the article by its own account."""
    names, away = "", tag in AWAY_TAGS or (tag in HEADERS and not inside)
    if attributes:
        for name, value in _NAMES.findall(attributes):
            name, value = name.lower(), entities.unescape(value.strip("\"'"))
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                away = True
            elif name == "role":
                away = away or value.lower() in AWAY_ROLES
            elif name in ("class", "id"):
                parts = {p.lower() for p in _PARTS.findall(value)}
                if tag not in ("html", "body", "article", "main") or parts & {"comment", "comments", "reply", "ad", "advert"}:
                    away = away or not parts.isdisjoint(AWAY_NAMES) or ("header" in parts and not inside)
                if name == "class":
                    names = "." + " ".join(value.split())
    return tag + names, away


def parse(page: str) -> Node:
    root = Node("#", "", False, False, None)
    here, at, end = root, 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        if found is None:
            here.children.append(entities.unescape(page[at:]))
            break
        if found.start() > at:
            here.children.append(entities.unescape(page[at : found.start()]))
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            up = here
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                here = up.parent
            elif tag == "p":
                here.children.append(Node("p", here.path + "/p", False, here.inside, here))
            continue
        if tag in NOT_IN_P:
            up = here
            while up is not root and up.tag not in HOLDS and up.tag != "p":
                up = up.parent
            if up.tag == "p":
                here = up.parent
        if tag in CLOSES:
            up = here
            while up is not root and up.tag not in HOLDS and up.tag not in CLOSES[tag]:
                up = up.parent
            while up.tag in CLOSES[tag]:  # a cell and its row
                here = up = up.parent
        step, away = _place(tag, found[3] or "", here.inside)
        node = Node(tag, here.path + "/" + step, away or here.away, here.inside or (tag in ("article", "main") and not (away or here.away)), here)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = close.start() if close else end
            continue
        here.children.append(node)
        if tag not in VOID and not (found[3] or "").endswith("/"):
            here = node
        elif tag not in VOID:
            here = node  # a slash does not close an element of HTML
    return root


def mark(path: str, text: str) -> int:
    """A template entry: two 31-bit sums of path and text in one number."""
    return (crc32(path.encode()) >> 1) << 31 | crc32(text.encode("utf-8", "surrogatepass")) >> 1


def _shapes(roots: list[Node]) -> tuple[dict[int, int], list[tuple[str, tuple[int, ...]]]]:
    """The shape of each node by its id(), and of each shape the tag and the shapes of the children."""
    found: dict[tuple[str, tuple[int, ...]], int] = {}
    of: dict[int, int] = {}
    for root in roots:
        order, stack = [], [root]
        while stack:
            order.append(stack.pop())
            stack.extend(order[-1].elements())
        for node in reversed(order):
            of[id(node)] = found.setdefault((node.tag, tuple(of[id(c)] for c in node.elements())), len(found))
    return of, list(found)


def _alike(xs: tuple[int, ...], ys: tuple[int, ...]) -> int:
    """How many children two levels begin with that have the same shapes. A largest matching pairs them off, and no other is larger."""
    n = 0
    for x, y in zip(xs, ys, strict=False):
        if x != y:
            break
        n += 1
    return n


def _matching(xs: tuple[int, ...], ys: tuple[int, ...], sizes: dict[tuple[int, int], int]) -> tuple[int, list[tuple[int, int]]]:
    """The size of the largest order-preserving matching of two levels, and its places. Wide levels are held as two bits a pair."""
    if not xs or not ys:
        return 0, []
    if len(xs) * len(ys) <= NARROW:
        return _narrow(xs, ys, sizes)
    distinct, place = np.unique(np.array(ys), return_inverse=True)
    rows = {x: np.array([sizes.get((x, y), 0) for y in distinct.tolist()], np.int64) for x in set(xs)}
    best, above, beside = np.zeros(len(ys) + 1, np.int64), [], []
    for x in xs:
        last, best = best, best.copy()
        best[1:] = np.maximum.accumulate(np.maximum(last[1:], last[:-1] + rows[x][place]))
        above.append(np.packbits(best[1:] == last[1:]))
        beside.append(np.packbits(best[1:] == best[:-1]))
    i, j, out = len(xs), len(ys), []
    while i and j:
        at, bit = (j - 1) >> 3, 128 >> ((j - 1) & 7)
        if above[i - 1][at] & bit:
            i -= 1
        elif beside[i - 1][at] & bit:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return int(best[-1]), out


def _narrow(xs: tuple[int, ...], ys: tuple[int, ...], sizes: dict[tuple[int, int], int]) -> tuple[int, list[tuple[int, int]]]:
    """What ``_matching`` finds, without arrays, which cost more than they spare where there are few pairs."""
    last = [0] * (len(ys) + 1)
    table = [last]
    for x in xs:
        best, left = [0], 0
        for j, y in enumerate(ys):
            left = max(left, last[j + 1], last[j] + sizes.get((x, y), 0))
            best.append(left)
        table.append(best)
        last = best
    i, j, out = len(xs), len(ys), []
    while i and j:
        size = table[i][j]
        if size == table[i - 1][j]:
            i -= 1
        elif size == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return last[-1], out


def align(a: Node, b: Node, pairs: list[tuple[Node, Node]]) -> int:
    """Simple tree matching of two trees with the same root tag: the size of the largest matching, its pairs added. Sizes
    depend on the tags alone, so those of two shapes are found once, however many nodes have them; a shape matches itself whole."""
    of, shapes = _shapes([a, b])
    whole: list[int] = []  # children have lower numbers than their parent
    for _, own in shapes:
        whole.append(1 + sum(map(whole.__getitem__, own)))
    sizes = {(x, x): size for x, size in enumerate(whole)}
    found: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    todo = [(of[id(a)], of[id(b)])]
    while todo:
        x, y = todo[-1]
        if (x, y) not in sizes:
            xs, ys = shapes[x][1], shapes[y][1]
            n = _alike(xs, ys)
            first, xs, ys = xs[:n], xs[n:], ys[n:]
            open_ = [(p, q) for p in set(xs) for q in set(ys) if (p, q) not in sizes and shapes[p][0] == shapes[q][0]]
            if open_:
                todo.extend(open_)
                continue
            size, places = _matching(xs, ys, sizes)
            found[x, y] = n, places
            sizes[x, y] = 1 + sum(map(whole.__getitem__, first)) + size
        todo.pop()
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        pairs.append((x, y))
        shape = of[id(x)], of[id(y)]
        xs, ys = x.elements(), y.elements()
        if shape[0] == shape[1]:
            stack.extend(zip(xs, ys, strict=True))
            continue
        n, places = found[shape]
        stack.extend(zip(xs[:n], ys[:n], strict=True))
        stack.extend((xs[n + i], ys[n + j]) for i, j in places)
    return sizes[of[id(a)], of[id(b)]]


def layout_of(root: Node) -> int:
    """A hash of the set of tag paths of the page's upper elements."""
    paths, level = set(), [("", root)]
    for _ in range(DEPTH):
        level = [(f"{path}/{c.tag}", c) for path, node in level for c in node.elements()]
        paths.update(path for path, _ in level)
    return crc32(" ".join(sorted(paths)).encode())


def outline_of(root: Node) -> str:
    """The tree of tags as text: each element with its marks (! away, + inside an article) and its children in brackets."""
    out: list[str] = []
    stack: list[Node | str] = list(reversed(root.elements()))
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        out.append("!" * node.away + "+" * node.inside + re.sub(r"[()!+]", "_", node.tag) + "(")
        stack.append(")")
        stack.extend(reversed(node.elements()))
    return "".join(out)


class Reference:
    """The tree of an outline, with its nodes by number in document order; the root is number 0."""

    def __init__(self, layout: int, outline: str):
        self.layout = layout
        self.root = here = Node("#", "", False, False, None)
        self.nodes = [here]
        for found in re.finditer(r"(!?)(\+?)([^()!+]+)\(|\)", outline):
            if found[0] == ")":
                here = here.parent
                continue
            node = Node(found[3], "", bool(found[1]), bool(found[2]), here)
            here.children.append(node)
            self.nodes.append(node)
            here = node
        self.number = {id(node): i for i, node in enumerate(self.nodes)}

    def places(self, page: Node) -> tuple[int, dict[int, int]]:
        """The size of the matching with a page, and the number that each matched node of the page has, by its id()."""
        pairs: list[tuple[Node, Node]] = []
        size = align(self.root, page, pairs)
        return size, {id(y): self.number[id(x)] for x, y in pairs}


def fitting(references: list[Reference], page: Node) -> tuple[Reference, dict[int, int]]:
    """The reference of the page's layout, or else the one that matches the page best, and the places of its nodes there."""
    own = layout_of(page)
    same = [r for r in references if r.layout == own]
    tried = [(r, *r.places(page)) for r in same or references]
    best = max(tried, key=lambda t: t[1])
    return best[0], best[2]


def observed(page: Node, places: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """number, mark, length of its own text, and length of the text below it that has no place: of each node of the reference."""
    own: dict[int, tuple[int, int]] = {}
    more: dict[int, int] = {}
    stack = [(page, 0)]
    while stack:
        node, nearest = stack.pop()
        if id(node) in places:
            nearest = places[id(node)]
            text = node.own()
            own[nearest] = (mark(node.path, text), len(text))
        elif not node.away:
            more[nearest] = more.get(nearest, 0) + len(node.own())
        stack.extend((c, nearest) for c in node.elements())
    return [(number, m, size, more.get(number, 0)) for number, (m, size) in own.items()]


def induce(reference: Reference, seen: dict[int, tuple[int, int, int, int, int]]) -> tuple[int, list[int]]:
    """The number of the article's node and the marks of the template, from (pages, least mark, greatest mark, length of texts, length
    of text without a place) of each node that was seen."""
    nodes, pages = reference.nodes, seen.get(0, (0, 0, 0, 0, 0))[0]
    if pages < 2:
        return 0, []

    def weights(varying: bool) -> list[int]:
        total = [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):  # children have higher numbers than their parent
            if not nodes[i].away and i in seen:
                _, least, greatest, size, more = seen[i]
                total[i] += more + (size if least != greatest or not varying else 0)
            if i:
                total[reference.number[id(nodes[i].parent)]] += total[i]
        return total

    total = weights(True)
    varies = total[0] > 0
    total = total if varies else weights(False)
    at = 0
    while nodes[at].tag not in ("article", "main"):
        inner = [i for c in nodes[at].elements() if c.tag not in TEXT and not c.away and total[i := reference.number[id(c)]]]
        best = max(inner, key=total.__getitem__, default=None)
        if best is None or total[best] < SHARE * total[at]:
            break
        at = best
    template = []
    for i, (n, least, greatest, size, _) in seen.items():
        plain = nodes[i].inside and any(t in PLAIN for t in (nodes[i].tag, *_tags_up_to_article(nodes[i])))
        if varies and n >= max(MANY, pages // 2) and least == greatest and size and not plain:
            template.append(least)
    return at, sorted(set(template))


def _tags_up_to_article(node: Node) -> Iterator[str]:
    node = node.parent
    while node is not None and node.tag not in ("article", "main", "#"):
        yield node.tag
        node = node.parent


def content(root: Node, template: frozenset[int], chosen: Node | None = None) -> str:
    """The text of the content slots in the ``chosen`` node, or in all of the page."""
    blocks: list[list[str]] = [[]]
    start = chosen or root
    articles = _has_article(start)

    def walk(node: Node) -> None:
        stack: list[tuple[Node, int, bool]] = [(node, 0, False)]
        while stack:
            here, i, skip = stack.pop()
            if i == 0:
                if here.away:
                    if here.tag in BLOCK:
                        blocks.append([])
                    continue
                if here.tag in BLOCK:
                    blocks.append([])
                skip = bool(template) and mark(here.path, here.own()) in template
            wanted = not skip and (here.inside or not articles)
            while i < len(here.children):
                child = here.children[i]
                i += 1
                if isinstance(child, str):
                    if wanted:
                        blocks[-1].append(child)
                else:
                    stack.append((here, i, skip))
                    stack.append((child, 0, False))
                    break
            else:
                if here.tag in BLOCK:
                    blocks.append([])

    walk(start)
    return " ".join(t for b in blocks if b and (t := " ".join("".join(b).split())))


def main_text(html: str, wrappers: list[tuple[Reference, int, frozenset[int]]]) -> str:
    """The main text of a page under the wrappers of its host."""
    page = parse(html)
    if not wrappers:
        return content(page, frozenset())
    reference, places = fitting([r for r, _, _ in wrappers], page)
    at, template = next((at, template) for r, at, template in wrappers if r is reference)
    chosen, stack = None, [page]
    while stack and chosen is None:
        node = stack.pop()
        if places.get(id(node)) == at:
            chosen = node
        stack.extend(node.elements())
    return content(page, template, chosen)


def _has_article(root: Node) -> bool:
    """Whether an ``article`` or ``main`` of the page holds any text."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.away:
            continue
        for c in node.children:
            if isinstance(c, Node):
                stack.append(c)
            elif node.inside and not c.isspace():
                return True
    return False


def _layouts(rows: DataFrame) -> DataFrame:
    """host, layout, pages and outline of the page with the lowest hash, of each layout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, int], list] = {}
            for host, order, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                root = parse(html)
                entry = found.setdefault((host, layout_of(root)), [0, order + 1, ""])
                entry[0] += 1
                if order < entry[1]:
                    entry[1:] = order, outline_of(root)
            columns = [[h for h, _ in found], [x for _, x in found], *map(list, zip(*found.values(), strict=True))] if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    fields = pa.schema([("host", pa.string()), ("layout", pa.int64()), ("pages", pa.int64()), ("order", pa.int64()), ("outline", pa.string())])
    kind = "host string, layout long, pages long, order long, outline string"
    found = rows.select("host", F.shiftright(F.xxhash64("html"), 1).alias("order"), "html").mapInArrow(frees(run), kind)
    return found.groupBy("host", "layout").agg(F.sum("pages").alias("pages"), F.min_by("outline", F.struct("order", "outline")).alias("outline"))


def _observations(rows: DataFrame, references: DataFrame) -> DataFrame:
    """host, layout, number, pages, least, greatest, size, more: what all pages of a host have at the nodes of its references."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, list[Reference]] = {}
        found: dict[tuple[str, int, int], list[int]] = {}

        def out() -> pa.RecordBatch:
            columns = [*map(list, zip(*found, strict=True)), *map(list, zip(*found.values(), strict=True))] if found else [[]] * 8
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)
            found.clear()
            return batch

        for batch in batches:
            hosts, htmls = batch.column(0).to_pylist(), batch.column(1)
            for i, host in enumerate(hosts):
                if host not in made:
                    if len(made) >= HOSTS:
                        made.clear()
                    made[host] = [Reference(r["layout"], r["outline"]) for r in batch.column(2)[i].as_py()]
                page = parse(htmls[i].as_py())
                reference, places = fitting(made[host], page)
                for number, m, size, more in observed(page, places):
                    entry = found.setdefault((host, reference.layout, number), [0, m, m, 0, 0])
                    entry[:] = entry[0] + 1, min(entry[1], m), max(entry[2], m), entry[3] + size, entry[4] + more
                if len(found) >= HELD:
                    yield out()
        yield out()

    names = ("layout", "number", "pages", "least", "greatest", "size", "more")
    fields = pa.schema([("host", pa.string()), *((n, pa.int64()) for n in names)])
    joined = rows.join(references, "host").select("host", "html", "references")
    found = joined.mapInArrow(frees(run), "host string, " + ", ".join(f"{n} long" for n in names))
    sums = [F.sum("pages").alias("pages"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("size").alias("size"), F.sum("more").alias("more")]
    return found.groupBy("host", "layout", "number").agg(*sums)


def wrappers(pages: DataFrame) -> DataFrame:
    """host and its wrappers (layout, outline, article, template), a written table, from all ``pages`` (host, html)."""
    rows = pages.filter("host is not null and html is not null")
    layouts = _layouts(rows)
    frequent = layouts.withColumn("_rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("pages"), "layout"))).filter(F.col("_rank") <= LAYOUTS)
    chosen = written(frequent.select("host", "layout", "outline"), "layouts")
    references = written(chosen.groupBy("host").agg(F.collect_list(F.struct("layout", "outline")).alias("references")), "references")  # its size is known when the join is planned
    seen = _observations(rows, references)
    entry = F.struct("number", "pages", "least", "greatest", "size", "more")
    of_layout = seen.groupBy("host", "layout").agg(F.collect_list(entry).alias("seen"))

    @F.pandas_udf("article int, template array<long>")
    def induced(outlines: pd.Series, seens: pd.Series) -> pd.DataFrame:
        found = []
        for outline, rows_ in zip(outlines, seens, strict=True):
            nodes = {r["number"]: (r["pages"], r["least"], r["greatest"], r["size"], r["more"]) for r in (rows_ if rows_ is not None else ())}
            found.append(induce(Reference(0, outline), nodes))
        return pd.DataFrame(found, columns=["article", "template"])

    made = chosen.join(of_layout, ["host", "layout"], "left").select("host", "layout", "outline", induced("outline", "seen").alias("w"))
    found = written(made.groupBy("host").agg(F.collect_list(F.struct("layout", "outline", "w.article", "w.template")).alias("wrappers")), "wrappers")
    discard(chosen, references)
    return found


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    @F.pandas_udf("string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        made: dict[str, list[tuple[Reference, int, frozenset[int]]]] = {}
        for hosts, htmls, known in batches:
            out = []
            for host, html, own in zip(hosts, htmls, known, strict=True):
                if host not in made:
                    if len(made) >= HOSTS:
                        made.clear()
                    made[host] = [(Reference(w["layout"], w["outline"]), w["article"], frozenset(w["template"])) for w in (own if own is not None else ())]
                out.append(main_text(html, made[host]) if html else "")
            yield pd.Series(out, dtype=object)

    rows = pages.select("page_id", "url", "html", F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host"))
    joined = rows.join(wrappers(rows.select("host", "html")), "host", "left")
    text = joined.select("page_id", "url", read("host", "html", "wrappers").alias("text"))
    return text.withColumn("n_chars", F.length("text").cast("long"))
