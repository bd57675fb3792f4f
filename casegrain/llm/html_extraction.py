"""HTML extraction by wrapper induction over pages of one host.

Pages of a host are aligned, in groups of bounded size, with a reference page by simple tree matching: the greatest
mapping between two ordered trees that keeps parents and order, by dynamic programming over children.  A node whose text
differs is a slot.  The wrapper of the group is the container whose slots hold most varying text, other than menus, headers,
footers and the like; each page's container is the node that is aligned with it.  The main text is what stands below it,
but for blocks that are the same on enough distinct pages of the group, wherever they stand: template.  Landmarks break
ties (articles that hold all of the container, an article around it) and serve pages without the container and hosts with
one page: all articles, else main, else body.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.llm import frames

#: Pages of one host in a group, on average; large hosts have several groups.
GROUP_PAGES = 64
#: A group has no more characters of HTML than this, but for a single page.
GROUP_CHARS = 16 << 20
#: Tables of alignments larger than this are halved.
TABLE = 1 << 22
#: The container holds this share of the text that varies: well over half, so there is one way down to it.
HOLDS = 0.6
#: A block is template when so many distinct pages of a group have it, and such a share of them.
TEMPLATE_PAGES, TEMPLATE_SHARE = 3, 0.5
#: The table of hosts with more pages than a group is broadcast up to so many rows (some 100 bytes each).
BROADCAST_HOSTS = 200_000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe".split())
BOILERPLATE = frozenset("script style noscript template svg iframe nav header footer aside form button select textarea input menu dialog head title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: What the container may be.
CONTAINER = BLOCK - {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td"}
#: Elements that an opening tag closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCK - {"body", "caption", "html", "option", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt"} | {"p"}
HINT = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|popup|modal|nav\w*|menu|breadcrumbs?|sidebar|widget|share|social|related|recommend\w*|comments?|disqus|replies|reply|footer|header|masthead|subscribe|newsletter|login|signup|pagination|pager|copyright|skip)(?:$|[\s_-])", re.IGNORECASE)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_SPACE = re.compile(r"[\s ]+")


@dataclass(eq=False)
class Node:
    tag: str
    boilerplate: bool = False
    children: list[Node | str] = field(default_factory=list)
    size: int = 0  # characters of text below, but for boilerplate
    shape: int = -1

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


def walk(root: Node, enter: Callable[[Node], bool] = lambda _: True) -> Iterator[Node]:
    """The nodes from root down in page order, but for those (and what is below them) that `enter` refuses; no recursion."""
    stack = [root]
    while stack:
        node = stack.pop()
        if enter(node):
            yield node
            stack += reversed(node.elements())


def parse(html: str) -> Node:
    """A tree of the page; unclosed elements end where their parents do, paragraphs where another block starts."""
    root = Node("#root")
    stack, at, n = [root], 0, len(html)
    open_tags: Counter[str] = Counter()

    def close(k: int) -> None:
        open_tags.subtract(x.tag for x in stack[k:])
        del stack[k:]

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            stack[-1].children.append(html[at:])
            break
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if open_tags[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag in ENDS_P or tag in CLOSES:
            ends = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    close(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        node = Node(tag, tag in BOILERPLATE)
        if m[3]:
            for a in _ATTRIBUTE.finditer(m[3]):
                name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                node.boilerplate |= name in ("class", "id") and tag not in ("body", "html", "article", "main") and bool(HINT.search(value)) or name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true"
        stack[-1].children.append(node)
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(html, at)
            node.children.append(html[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        stack.append(node)
        open_tags[tag] += 1
    for node in reversed(list(walk(root))):  # children before their parents
        node.size = 0 if node.boilerplate else sum(len(c.strip()) if isinstance(c, str) else c.size for c in node.children)
    return root


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node in page order, boilerplate left out; character references decoded, white space single."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append(text)

    todo: list[Node | str | None] = list(reversed(node.children))  # None: a block ends here
    while todo:
        c = todo.pop()
        if c is None:
            flush()
        elif isinstance(c, str):
            run.append(c)
        elif c.boilerplate or c.tag == "br":
            run.append(" ")
        elif c.tag in BLOCK:
            flush()
            todo += [None, *reversed(c.children)]
        else:
            todo += reversed(c.children)
    flush()
    return out


class Shapes:
    """Trees without their texts, numbered: equal ones have one number, and children smaller ones than their parents.

    Simple tree matching of two shapes is worked out once, whatever nodes have them.  Equal shapes match as a whole, and so
    do equal ones at the start and at the end of two lists of children (nothing can match them better); what is left is
    aligned by dynamic programming, a row of the table at once.
    """

    def __init__(self) -> None:
        self.number: dict[tuple, int] = {}
        self.tag: list[str] = []
        self.below: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.known: dict[tuple[int, int], int] = {}

    def add(self, root: Node) -> None:
        for node in reversed(list(walk(root))):
            key = node.tag, tuple(c.shape for c in node.elements())
            node.shape = self.number.setdefault(key, len(self.tag))
            if node.shape == len(self.tag):
                self.tag.append(node.tag)
                self.below.append(key[1])
                self.size.append(1 + sum(self.size[c] for c in key[1]))

    def _weights(self, x: Sequence[int], y: Sequence[int]) -> np.ndarray:
        """Matches of each of x with each of y; all are known."""
        ux, at_x = np.unique(x, return_inverse=True)
        uy, at_y = np.unique(y, return_inverse=True)
        return np.array([[self._pair(c, d) for d in uy.tolist()] for c in ux.tolist()], np.int64)[at_x][:, at_y]

    def _pair(self, a: int, b: int) -> int:
        return self.size[a] if a == b else self.known[a, b] if self.tag[a] == self.tag[b] else 0

    def match(self, a: int, b: int) -> int:
        """The greatest number of nodes that a mapping of two shapes pairs, keeping parents and order."""
        stack = [(a, b)]
        while stack:
            c, d = stack[-1]
            if c == d or self.tag[c] != self.tag[d] or (c, d) in self.known:
                stack.pop()
                continue
            head, tail = _equal_ends(self.below[c], self.below[d])
            x, y = self.below[c][head : len(self.below[c]) - tail], self.below[d][head : len(self.below[d]) - tail]
            missing = [(e, f) for e in set(x) for f in set(y) if e != f and self.tag[e] == self.tag[f] and (e, f) not in self.known]
            if missing:
                stack += missing
                continue
            same = sum(self.size[e] for e in self.below[c][:head]) + sum(self.size[e] for e in self.below[c][len(self.below[c]) - tail :])
            self.known[c, d] = 1 + same + (int(_last_row(self._weights(x, y))[-1]) if x and y else 0)
            stack.pop()
        return self._pair(a, b)

    def aligned(self, x: Sequence[int], y: Sequence[int]) -> list[tuple[int, int]]:
        """Places of the children that a greatest mapping pairs."""
        head, tail = _equal_ends(x, y)
        pairs = [(i, i) for i in range(head)] + [(len(x) - i, len(y) - i) for i in range(tail, 0, -1)]
        x, y = x[head : len(x) - tail], y[head : len(y) - tail]
        if x and y:
            for e in set(x):
                for f in set(y):
                    self.match(e, f)
            pairs += [(head + i, head + j) for i, j in _align(self._weights(x, y))]
        return pairs


def _equal_ends(x: Sequence[int], y: Sequence[int]) -> tuple[int, int]:
    """How many equal ones two lists start with, and how many of the rest they end with."""
    n = min(len(x), len(y))
    head = next((i for i in range(n) if x[i] != y[i]), n)
    tail = next((i for i in range(n - head) if x[-1 - i] != y[-1 - i]), n - head)
    return head, tail


def _last_row(weight: np.ndarray) -> np.ndarray:
    """The greatest sums of an ordered matching of all rows with the first 0, 1, ... columns."""
    best = np.zeros(weight.shape[1] + 1, np.int64)
    for row in weight:
        np.maximum.accumulate(np.maximum(best[1:], best[:-1] + row), out=best[1:])
    return best


def _align(weight: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of a greatest ordered matching; large tables are halved, so that only two rows stand in memory."""
    out, todo = [], [(0, weight.shape[0], 0, weight.shape[1])]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        part = weight[a:b, c:d]
        if part.size > TABLE and b - a > 1:
            half = (b - a) // 2
            cut = int(np.argmax(_last_row(part[:half]) + _last_row(part[half:][::-1, ::-1])[::-1]))
            todo += [(a, a + half, c, c + cut), (a + half, b, c + cut, d)]
            continue
        best = np.zeros((b - a + 1, d - c + 1), np.int64)
        for i, row in enumerate(part):
            np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + row), out=best[i + 1, 1:])
        i, j = b - a, d - c
        while i and j:
            if best[i, j] == best[i - 1, j]:
                i -= 1
            elif best[i, j] == best[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((a + i, c + j))
    return out


def tree_match(a: Node, b: Node, pairs: list[tuple[Node, Node]] | None = None, shapes: Shapes | None = None) -> int:
    """Simple tree matching: the greatest number of nodes that a mapping keeping parents and order pairs; `pairs` gets them.

    `shapes`, where given, knows both trees.
    """
    if shapes is None:
        shapes = Shapes()
        shapes.add(a)
        shapes.add(b)
    total = shapes.match(a.shape, b.shape)
    stack = [(a, b)] if pairs is not None and a.tag == b.tag else []
    while stack:
        c, d = stack.pop()
        pairs.append((c, d))
        x, y = c.elements(), d.elements()
        if c.shape == d.shape:
            stack += zip(x, y, strict=True)
        else:
            places = shapes.aligned([n.shape for n in x], [n.shape for n in y])
            stack += [(x[i], y[j]) for i, j in places if x[i].tag == y[j].tag]
    return total


def _own_text(node: Node) -> str:
    return " ".join(c.strip() for c in node.children if isinstance(c, str)).strip()


def landmarks(root: Node) -> list[Node]:
    """The outermost article elements that have text, in page order; else the main elements, else body, else the whole page."""
    for tag in ("article", "main", "body"):
        found: list[Node] = []

        def enter(node: Node, tag: str = tag, found: list[Node] = found) -> bool:
            if node is not root and node.boilerplate:
                return False
            if node.tag == tag and node.size:
                found.append(node)
                return False
            return True

        for _ in walk(root, enter):
            pass
        if found:
            return found
    return [root]


def induce(trees: list[Node]) -> list[list[Node] | None] | None:
    """The content of each page of a group (None where a page lacks the container); None if the pages have none in common.

    Every page is aligned with the first.  Varying text below each node of the reference is summed over all pages; the
    container is the deepest landmark or block that holds at least HOLDS of it.  One inside a main gives way to that,
    one inside an article to all articles below what holds the reference's, so that headings and the parts of a split
    article stay.  Each page's container is the node aligned with the reference's.
    """
    if len(trees) < 2:
        return None
    reference, shapes = trees[0], Shapes()
    for tree in trees:
        shapes.add(tree)
    nodes = list(walk(reference, lambda n: n is reference or not n.boilerplate))
    parent = {c: n for n in nodes for c in n.elements()}
    varying: dict[Node, int] = dict.fromkeys(nodes, 0)
    own: dict[Node, str] = {}
    aligned: list[dict[Node, Node]] = []
    for tree in trees[1:]:
        pairs: list[tuple[Node, Node]] = []
        tree_match(reference, tree, pairs, shapes)
        aligned.append(dict(pairs))
        for a, b in pairs:
            if a not in varying or b.boilerplate:
                continue
            mine, other = own.get(a), _own_text(b)
            if mine is None:
                mine = own[a] = _own_text(a)
            if mine != other:
                varying[a] += len(other)
    total = sum(varying.values())
    if not total:
        return None
    for node in reversed(nodes[1:]):  # from here on, what varies anywhere below
        varying[parent[node]] += varying[node]
    chain = [reference]
    while (into := next((c for c in chain[-1].elements() if varying.get(c, 0) >= HOLDS * total), None)) is not None:
        chain.append(into)
    while len(chain) > 1 and chain[-1].tag not in CONTAINER:
        chain.pop()
    split = any(n.tag == "article" for n in chain)
    if split:  # the parts of a split article may stand anywhere below what holds them all
        outermost = [n for n in walk(reference, lambda n: n in varying and (n is reference or parent[n].tag != "article")) if n.tag == "article" and varying[n]]
        best = _above(outermost, parent)
    else:
        best = next((n for n in chain if n.tag == "main"), chain[-1])
    at = [best, *(pairs.get(best) for pairs in aligned)]
    return [contents(n, split) if n is not None and not n.boilerplate and n.size else None for n in at]


def _above(nodes: list[Node], parent: dict[Node, Node]) -> Node:
    """The deepest node that holds all of some nodes, and is none of them."""
    shared: list[Node] | None = None
    for node in nodes:
        line = []
        while node in parent:
            node = parent[node]
            line.append(node)
        line.reverse()
        shared = line if shared is None else [a for a, b in zip(shared, line, strict=False) if a is b]
    return shared[-1]


def contents(container: Node, split: bool) -> list[Node]:
    """The articles inside a container, all of them, when the slots are theirs or they hold nine tenths of its text; else itself."""
    found = [n for n in landmarks(container) if n.tag == "article"]
    return found if found and (split or sum(n.size() for n in found) >= 0.9 * container.size()) else [container]


def template(pages: list[list[str]]) -> set[str]:
    """Blocks that are the same on enough pages of a group: three at least, and TEMPLATE_SHARE of those that differ.

    Pages with equal blocks count once, so copies of one article don't make its paragraphs template.
    """
    distinct = {tuple(p) for p in pages if p}
    least = max(TEMPLATE_PAGES, TEMPLATE_SHARE * len(distinct))
    return {block for block, n in Counter(b for p in distinct for b in set(p)).items() if n >= least}


def main_texts(trees: list[Node]) -> list[str]:
    """The main text of each page of a group: the slots of its container.

    A page whose blocks would all go keeps them, and so does one without the container, which has its landmarks.
    """
    containers = induce(trees) or [None] * len(trees)
    pages = [[b for n in (landmarks(tree) if c is None else c) for b in blocks(n)] for tree, c in zip(trees, containers, strict=True)]
    constant = template(pages)
    return ["\n".join([b for b in page if b not in constant] or page) for page in pages]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The main texts of sorted rows, a group at a time."""
    rows: list[tuple] = []
    done: list[tuple] = []
    size, key = 0, None

    def finish() -> None:
        full = [i for i, r in enumerate(rows) if r[2]]
        texts = dict(zip(full, main_texts([parse(rows[i][2]) for i in full]), strict=True))
        done.extend((r[0], r[1], texts.get(i, "")) for i, r in enumerate(rows))
        rows.clear()

    def taken() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["page_id", "url", "text"])
        done.clear()
        return out

    for batch in batches:
        for page, url, html, host, salt in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "host", "salt")), strict=True):
            if rows and ((host, salt) != key or len(rows) >= 4 * GROUP_PAGES or size >= GROUP_CHARS):
                finish()
                size = 0
                if len(done) >= 256:
                    yield taken()
            rows.append((page, url, html))
            size, key = size + len(html or ""), (host, salt)
    if rows:
        finish()
    if done:
        yield taken()


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url and text (main text; empty if none) of every row.

    A null or empty html gives an empty text.  A null url, or one without a host, counts as one more host.  Repeated rows
    each give a row.  A page may be nested or long without bound.  An empty table gives none; other columns are not read.
    Pages move once, to their groups; a host with any share of all rows is cut into groups of about GROUP_PAGES pages
    (however many rows are equal, never above four times that, nor beyond GROUP_CHARS but for one page), each with a
    wrapper of its own.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"), host.alias("host"))
    rows = rows.withColumn("okey", F.xxhash64("page_id", "url"))
    salts = rows.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP_PAGES)).alias("salts")).where("salts > 1").withColumnRenamed("host", "h")
    n = frames.groups_for(frames.volume(rows, "html")[1])
    salts = frames.checkpointed(salts)
    if salts.count() <= BROADCAST_HOSTS:  # else the pages move once more, to join
        salts = F.broadcast(salts)
    salted = rows.join(salts, rows["host"] == salts["h"], "left").withColumn("salt", F.coalesce(F.pmod("okey", "salts"), F.lit(0)))
    placed = salted.repartitionById(n, F.pmod(F.xxhash64("host", "salt"), F.lit(n)).cast("int")).sortWithinPartitions("host", "salt", "okey", "html")
    return frames.map_batches(placed.select("page_id", "url", "html", "host", "salt"), _extract, "page_id long, url string, text string")
