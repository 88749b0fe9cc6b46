"""Main text of web pages by wrapper induction.

Every page becomes a shape: the tree of its blocks, in which runs of equal siblings stand once. The shapes of a host's
different pages are merged into one template tree by simple tree matching, every page is matched with it, and what
stands at a template node is counted over all different pages of the host: a text that half of the pages repeat is
constant and dropped where it stands before or behind the article's varying text, or is no heading, item or paragraph between
parts of it; the node is else a slot, known by how much varying text without links it holds a page. The
article is the smallest part that holds most of that text; slots beside it, and slots within it that consist of links,
of repeated records or of a stray line, are left out. Every page takes part, whatever the size of its host.

Names of elements and classes decide where a host has less than LEAST_PAGES different pages or nearly no varying text,
for nodes that the template does not have, and for small slots of the article (a reader's comment in it).

Defined results: a null or empty html and a page without content give the empty text; a null url belongs to no host;
repeated rows give repeated results and count as one page of the host; pages cut short are read as far as they go; an
empty table gives no row; further columns are ignored; memory is linear in a page, however deep it is nested, but for two bits for
each pair of children that are aligned with one another, and a number for each pair of different shapes of one name.
References are decoded, white space within a block becomes one space, blocks are trimmed and joined by a line break,
and nothing else is dropped or shortened.
"""
from __future__ import annotations

import hashlib
import html as _html
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Different pages needed to call a text constant, and the share of a node's pages that must repeat it.
LEAST_PAGES, CONSTANT = 3, 0.5
#: Share of the varying text that makes a part the article, and that a part named otherwise must hold to be content.
MOST, OVERRULES = 0.5, 0.9
#: Share below which a block that is no paragraph, between paragraphs, is a stray line (an advert).
STRAY = 0.05
#: Products of two numbers of children up to which they are aligned without arrays.
SMALL = 64
#: Shapes of a host that one task merges; more of them are merged in rounds.
BUNCH = 256
#: A table of wrappers up to this size is sent to all executors; beyond it, only those of hosts with more than this share of the pages.
BROADCAST_BYTES, HOT = 8 << 20, 1e-3

# Elements by how HTML treats them, and names of page parts that are not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("caption dd dt li option tbody td tfoot th thead tr head html body".split()) | {"p"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
P_FENCES = ("button", "td", "th", "table", "caption")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks of running text: without blocks in them they share one template node a parent, wherever they stand in it.
FLOW = HEADINGS | frozenset("p li dt dd td th pre blockquote caption figcaption summary address legend".split())
TABLES = frozenset("table thead tbody tfoot tr ul ol dl menu".split())
UNSEEN = frozenset("script style noscript template head title button select textarea iframe svg canvas object video audio".split())
NOT_CONTENT = UNSEEN | frozenset("nav header footer aside form menu dialog".split())
PARTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager share sharing social comment comments disqus respond replies related recommended newsletter subscribe subscription footer masthead toolbar widget".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z""", re.S)
_ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")


class Node:
    """An element. out: it or one around it is named as a part that is not the article; unseen: it shows no text."""

    __slots__ = ("tag", "name", "children", "out", "unseen", "link")

    def __init__(self, tag: str, name: str, out: bool = False, unseen: bool = False, link: bool = False):
        self.tag, self.name, self.out, self.unseen, self.link = tag, name, out, unseen, link
        self.children: list = []


class Shape(Node):
    """A block of a shape or template: n pages have it, in some it stands several times in a row."""

    __slots__ = ("n", "many", "at")

    def __init__(self, name: str, n: int = 1, many: bool = False):
        super().__init__(name.rstrip("!").split(".", 1)[0], name, name.endswith("!"))
        self.n, self.many, self.at = n, many, 0


def _kind(tag: str, attrs: str) -> tuple[str, bool]:
    """The node's name for matching (element, class, and ! if it is named as a part of the page that is not the article),
    and whether it is. So nodes of one name have one role, also where only an id or a role attribute tells it."""
    if not attrs or "=" not in attrs:
        return (f"{tag}!", True) if tag in NOT_CONTENT else (tag, False)
    name, out = tag, tag in NOT_CONTENT
    for key, *values in _ATTR.findall(attrs):
        value = _html.unescape("".join(values)).lower()
        if key.lower() == "role":
            out = out or value.strip() in ROLES
            continue
        if key.lower() == "class" and value:
            name = f"{tag}.{'.'.join(sorted(_DIGITS.sub('0', value).split()))}"  # numbers in classes differ from page to page
        if tag not in ("html", "body", "main", "article"):
            out = out or not PARTS.isdisjoint(re.split(r"[^a-z]+", value))
    return f"{name}!" if out else name, out


def parse(source: str) -> Node:
    """The DOM: nodes with text (references decoded) and nodes as children."""
    root = Node("#root", "")
    stack, places = [root], {}  # open elements, and where those of a tag stand among them
    at, n = 0, len(source)

    def text(a: int, b: int) -> None:
        if b > a:
            piece = source[a:b]
            stack[-1].children.append(_html.unescape(piece) if "&" in piece else piece)

    def innermost(tags: tuple) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(place: int) -> None:
        while len(stack) > place:
            places[stack.pop().tag].pop()

    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            text(at, n)
            break
        text(at, m.start())
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attrs = tag.lower(), (m[1] or m[4] or "") == "/", m[3] or m[6] or ""
        if closing:
            if place := innermost((tag,)):
                close(place)
            continue
        if tag in CLOSES_P and (place := innermost(("p",))) > innermost(P_FENCES):
            close(place)
        if tag in SIBLINGS and (place := innermost(SIBLINGS[tag])) > innermost(FENCES[tag]):
            close(place)
            if tag == "tr" and (row := innermost(("tr",))) > innermost(("table",)):
                close(row)
        name, out = _kind(tag, attrs)
        above = stack[-1]
        node = Node(tag, name, above.out or out, above.unseen or tag in UNSEEN, above.link or tag == "a")
        above.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
            at = n if end is None else end.start()
            node.children.append(source[m.end() : at])
            stop = source.find(">", at)
            at = n if end is None or stop < 0 else stop + 1
        elif tag not in VOID and not attrs.rstrip().endswith("/") or tag in BLOCK and tag not in VOID:
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    return root


def own_text(node: Node) -> str:
    """The text of a block without the blocks in it, or of an inline node."""
    out, todo = [], list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag not in BLOCK and c.tag not in RAW:
            todo.extend(reversed(c.children))
    return _SPACE.sub(" ", "".join(out)).strip()


def text_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class Page:
    """A page's shape, its pieces of text in page order (shape node, text, characters within links, whether it is named
    as no part of the article), and its article and main elements' shape nodes."""

    def __init__(self, root: Node):
        blocks: list[Node] = [root]
        above = [-1]
        pieces: list[tuple[int, str, int, bool]] = []
        held: list[str] = []
        linked = 0

        def flush(block: int) -> None:
            nonlocal linked
            if held:
                text = " ".join("".join(held).split())
                if text:
                    pieces.append((block, text, min(linked, len(text)), blocks[block].out))
                held.clear()
                linked = 0

        todo: list = [(c, 0) for c in reversed(root.children)]
        while todo:
            x, block = todo.pop()
            if x is None:
                flush(block)
            elif isinstance(x, tuple):
                held.append(x[1])
                linked += len(x[1].strip()) * x[0]
            elif isinstance(x, str):
                held.append(x)
            elif x.unseen:
                held.append(" ")
            elif x.tag in BLOCK:
                flush(block)
                blocks.append(x)
                above.append(block)
                own = len(blocks) - 1
                todo.append((None, own))
                todo.extend((c, own) for c in reversed(x.children))
            elif x.out and not blocks[block].out:  # named so within a line
                held.append(" ")
            else:
                if x.tag == "br":
                    held.append(" ")
                todo.extend(((True, c), block) if x.link and isinstance(c, str) else (c, block) for c in reversed(x.children))
        flush(0)
        self._shape(blocks, above)
        self.pieces = [(self.of[b], t, k, out) for b, t, k, out in pieces]
        self.main = sorted({self.of[b] for b, x in enumerate(blocks) if x.tag in ("article", "main") and not x.out})

    def _shape(self, blocks: list[Node], above: list[int]) -> None:
        kids: list[list[int]] = [[] for _ in blocks]
        for b in range(1, len(blocks)):
            kids[above[b]].append(b)
        known: dict = {}
        key = [0] * len(blocks)
        groups: list[list[tuple]] = [[] for _ in blocks]
        for b in range(len(blocks) - 1, -1, -1):  # a block's children have larger numbers
            at: dict = {}
            last = None
            for k in kids[b]:
                if not kids[k] and blocks[k].tag in FLOW:
                    if key[k] not in at:
                        at[key[k]] = []
                        groups[b].append((key[k], at[key[k]]))
                    at[key[k]].append(k)
                elif last is not None and last[0] == key[k]:
                    last[1].append(k)
                else:
                    last = (key[k], [k])
                    groups[b].append(last)
            key[b] = known.setdefault((blocks[b].name, tuple(g[0] for g in groups[b])), len(known))
        self.shape = Shape(blocks[0].name)
        shapes: list = [None] * len(blocks)
        todo = [(0, self.shape)]
        while todo:
            b, s = todo.pop()
            shapes[b] = s
            if len(s.children) < len(groups[b]):
                s.children = [Shape(blocks[members[0]].name) for _, members in groups[b]]
            for (_, members), c in zip(groups[b], s.children):
                c.many = c.many or len(members) > 1
                todo.extend((k, c) for k in members)
        number(self.shape)
        self.of = [s.at for s in shapes]

    def digest(self) -> int:
        """The same for copies of an article in other surroundings: of its long pieces without links."""
        inner = [t for _, t, _, out in self.pieces if not out] or [t for _, t, _, _ in self.pieces]
        long = [t for _, t, k, out in self.pieces if not out and len(t) >= 80 and 2 * k < len(t)]
        return text_hash("\n".join(long or inner))


def number(root: Shape) -> list[Shape]:
    """The nodes in page order, each told its place."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        x.at = len(out)
        out.append(x)
        todo.extend(reversed(x.children))
    return out


def dump(root: Shape) -> str:
    nodes = number(root)
    up = [-1] * len(nodes)
    for x in nodes:
        for c in x.children:
            up[c.at] = x.at
    return json.dumps([[x.name for x in nodes], up, [x.n for x in nodes], [int(x.many) for x in nodes]], separators=(",", ":"))


def load(text: str, n: int | None = None) -> list[Shape]:
    nodes = []
    for name, up, own, many in zip(*json.loads(text)):
        nodes.append(Shape(name, own if n is None else n, bool(many)))
        nodes[-1].at = len(nodes) - 1
        if up >= 0:
            nodes[up].children.append(nodes[-1])
    return nodes


def match(a: Node, b: Node, found: dict[Node, Node]) -> int:
    """Simple tree matching: the size of the largest common top-down, order-keeping alignment of two trees of the same
    root name; found gets the aligned nodes of a. Of equally large ones, that which aligns more leaves with leaves.

    Equal subtrees are one shape, and a pair of shapes is compared once, children by rows of a table of which only one is kept;
    the table as a whole, two bits a place, is made for the pairs on the way of the alignment alone."""
    known: dict[tuple, int] = {}
    kids: list[tuple[int, ...]] = []
    names: list[str] = []
    size: list[int] = []
    whole: list[int] = []  # the score of a shape with itself
    place: dict[Node, int] = {}
    for root in (a, b):
        order = [root]
        for x in order:
            order.extend(_elements(x))
        for x in reversed(order):
            below = tuple(place[c] for c in _elements(x))
            k = known.setdefault((x.name, below), len(known))
            if k == len(kids):
                kids.append(below)
                names.append(x.name)
                size.append(1 + sum(size[c] for c in below))
                whole.append((1 << 32) + 1 + sum(whole[c] for c in below))
            place[x] = k
    pairs = {(place[a], place[b]): 0}
    for x, y in (todo := list(pairs)):
        if x == y or not kids[x] or not kids[y]:
            continue
        own: dict[str, list[int]] = {}
        for v in set(kids[y]):
            own.setdefault(names[v], []).append(v)
        new = [(u, v) for u in set(kids[x]) for v in own.get(names[u], ()) if (u, v) not in pairs]
        pairs.update(dict.fromkeys(new, 0))
        todo += new
    for x, y in sorted(pairs, key=lambda p: size[p[0]] + size[p[1]]):  # children before their parents
        if x == y:
            pairs[x, y] = whole[x]
        else:
            pairs[x, y] = (1 << 32) + (bool(kids[x]) == bool(kids[y])) + (_aligned(kids[x], kids[y], pairs) if kids[x] and kids[y] else 0)
    ways = [(a, b)]
    while ways:
        x, y = ways.pop()
        found[x] = y
        xs, ys = _elements(x), _elements(y)
        if place[x] == place[y]:
            ways.extend(zip(xs, ys))
        elif xs and ys:
            ways.extend((xs[i], ys[j]) for i, j in _way(kids[place[x]], kids[place[y]], pairs))
    return pairs[place[a], place[b]] >> 32


def _scores(xs: tuple[int, ...], ys: tuple[int, ...], pairs: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The scores of the distinct shapes of two rows of children (0: no match), and which of them each child is."""
    ux, x = np.unique(xs, return_inverse=True)
    uy, y = np.unique(ys, return_inverse=True)
    return np.array([[pairs.get((u, v), 0) for v in uy.tolist()] for u in ux.tolist()], np.int64), x, y


def _ends(xs: tuple[int, ...], ys: tuple[int, ...]) -> tuple[int, int]:
    """How many equal shapes two rows of children begin and end with; to align these with one another is never worse."""
    most, z = min(len(xs), len(ys)), 0
    while z < most and xs[-1 - z] == ys[-1 - z]:
        z += 1
    a = 0
    while a < most - z and xs[a] == ys[a]:
        a += 1
    return a, z


def _aligned(xs: tuple[int, ...], ys: tuple[int, ...], pairs: dict[tuple[int, int], int]) -> int:
    """The largest sum of scores of an order-keeping alignment."""
    a, z = _ends(xs, ys)
    if a or z:
        same = sum(pairs[x, x] for x in (*xs[:a], *xs[len(xs) - z :]))
        return same + _aligned(xs[a : len(xs) - z], ys[a : len(ys) - z], pairs)
    if not xs or not ys:
        return 0
    if len(xs) * len(ys) <= SMALL:
        best = [0] * (len(ys) + 1)
        for u in xs:
            over = 0  # of the row before, one place to the left
            for j, v in enumerate(ys, 1):
                before, p = best[j], pairs.get((u, v), 0)
                best[j] = max(before, best[j - 1], over + p)
                over = before
        return best[-1]
    score, x, y = _scores(xs, ys, pairs)
    row = np.zeros(len(ys) + 1, np.int64)
    for i in x.tolist():
        row[1:] = np.maximum(row[1:], row[:-1] + score[i, y])
        np.maximum.accumulate(row, out=row)
    return int(row[-1])


def _way(xs: tuple[int, ...], ys: tuple[int, ...], pairs: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """The places of the aligned children, last ones first."""
    a, z = _ends(xs, ys)
    if a or z:
        n, m = len(xs) - z, len(ys) - z
        inner = _way(xs[a:n], ys[a:m], pairs) if n > a and m > a else []
        return [*((n + k, m + k) for k in range(z - 1, -1, -1)), *((i + a, j + a) for i, j in inner), *((k, k) for k in range(a - 1, -1, -1))]
    score, x, y = _scores(xs, ys, pairs)
    row, taken, passed = np.zeros(len(ys) + 1, np.int64), [], []
    for i in x.tolist():
        own = score[i, y]
        now = row.copy()
        now[1:] = np.maximum(row[1:], row[:-1] + own)
        np.maximum.accumulate(now, out=now)
        taken.append(np.packbits((own > 0) & (now[1:] == row[:-1] + own)))
        passed.append(np.packbits(now[1:] == row[1:]))
        row = now
    out, i, j = [], len(xs), len(ys)
    while i and j:
        byte, bit = divmod(j - 1, 8)
        if taken[i - 1][byte] >> (7 - bit) & 1:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif passed[i - 1][byte] >> (7 - bit) & 1:
            i -= 1
        else:
            j -= 1
    return out


def _elements(node: Node) -> list[Node]:
    return [c for c in node.children if not isinstance(c, str) and c.tag not in RAW]


def merge(into: Shape, other: Shape) -> None:
    """Adds a shape or template to a template: aligned nodes count for both, the others are put in where they stand."""
    found: dict[Shape, Shape] = {}
    match(other, into, found)
    for x, y in list(found.items()):
        y.n, y.many = y.n + x.n, y.many or x.many
        at = 0
        for c in x.children:
            if c in found:
                at = next(k for k in range(at, len(y.children)) if y.children[k] is found[c]) + 1
            else:
                y.children.insert(at, c)
                at += 1


def template(shapes: list[tuple[str, int]], least: int = 0) -> str:
    """The template of (shape or template, pages) rows; pages 0: as counted in it. Nodes of fewer than `least` pages go."""
    rows = sorted(shapes, key=lambda r: (-r[1], r[0]))
    into = load(rows[0][0], rows[0][1] or None)[0]
    for text, n in rows[1:]:
        merge(into, load(text, n or None)[0])
    for x in number(into):
        x.children = [c for c in x.children if c.n >= least]
    return dump(into)


class Wrapper:
    """A host's template with what stands at its nodes."""

    def __init__(self, text: str, stats: list[dict], constant: list):
        self.nodes = load(text)
        size = len(self.nodes)
        self.vary, self.fixed, self.links, self.chars = ([0.0] * size for _ in range(4))
        for s in stats:
            k = s["node"]
            self.vary[k], self.fixed[k], self.links[k], self.chars[k] = float(s["vary"]), float(s["fixed"]), float(s["links"]), float(s["chars"])
        self.own, self.title, self.records = list(self.vary), [False] * size, [0.0] * size
        for x in reversed(self.nodes):
            k = x.at
            if x.tag in HEADINGS and 2 * self.links[k] < self.chars[k] and self.own[k] > 0:
                self.title[k] = True
            for c in x.children:
                for sums in (self.vary, self.fixed, self.links, self.chars, self.records):
                    sums[k] += sums[c.at]
                self.title[k] = self.title[k] or self.title[c.at]
            if x.many and x.children and x.tag not in TABLES and not self.title[k]:
                self.records[k] = self.vary[k]
        self.constant = {(k, h) for k, h in constant}
        # Nearly no text varies: the pages are versions of one text, and nothing can be told from what they repeat.
        self.tells = self.vary[0] > 0.1 * (self.vary[0] + self.fixed[0])
        self.plans: dict[str, tuple] = {}

    def mean(self, k: int) -> float:
        return self.vary[k] / max(1, self.nodes[k].n)

    def plan(self, page: Page) -> tuple[list[bool | None], list[int], bool]:
        """For the page's shape nodes: kept, left out, or (None) for its name to decide; their template nodes; and
        whether texts that are constant go. Depends on the shape alone, and is kept for pages of the same shape."""
        key = dump(page.shape)
        if key not in self.plans:
            if len(self.plans) > 500:
                self.plans.clear()
            self.plans[key] = self._plan(page)
        return self.plans[key]

    def _plan(self, page: Page) -> tuple[list[bool | None], list[int], bool]:
        nodes = number(page.shape)
        found: dict[Shape, Shape] = {}
        match(page.shape, self.nodes[0], found)
        to = [found[x].at if x in found else -1 for x in nodes]
        mains = [k for k in page.main if to[k] >= 0 and self.mean(to[k]) >= 0.2 * self.mean(0)]
        inside = set()
        tops = []
        for k in mains:
            if k not in inside:
                tops.append(k)
                inside.update(x.at for x in _below(nodes[k]))
        keep: list[bool | None] = [False] * len(nodes)
        trust = True
        for top in tops or [0]:
            area, best = self._area(nodes[top], to)
            self._judge(area, best, to, keep)
            t = to[area.at]
            trust = trust and self.fixed[t] <= self.vary[t]
        return keep, to, trust

    def _area(self, x: Shape, to: list[int]) -> tuple[Shape, Shape | None]:
        """The smallest block that holds most of the varying text, and (where a title stands beside it) the part of it."""
        while True:
            kids = [c for c in x.children if to[c.at] >= 0]
            whole = self.own[to[x.at]] / max(1, self.nodes[to[x.at]].n) + sum(self.mean(to[c.at]) for c in kids)
            parts = [c for c in kids if c.children or c.tag not in FLOW]
            best = max(parts, key=lambda c: self.mean(to[c.at]), default=None)
            if best is None or not whole or self.mean(to[best.at]) < MOST * whole:
                return x, None
            if any(self.title[to[c.at]] for c in kids[: kids.index(best)]):
                return x, best
            x = best

    def _judge(self, area: Shape, best: Shape | None, to: list[int], keep: list[bool | None]) -> None:
        t = to[area.at]
        kids = [c for c in area.children if to[c.at] >= 0]
        whole = self.own[t] / max(1, self.nodes[t].n) + sum(self.mean(to[c.at]) for c in kids)
        flow = whole - sum(self.mean(to[c.at]) for c in kids if c.children or c.tag not in FLOW)
        keep[area.at] = True
        before = best is not None
        for c in area.children:
            if c is best:
                before = False
                inner, deeper = self._area(c, to)
                self._judge(inner, deeper, to, keep)
                continue
            k = to[c.at]
            if k < 0:
                verdict: bool | None = None if best is None or c.tag in FLOW else False
            elif 2 * self.links[k] > self.chars[k] or c.out and self.mean(k) < OVERRULES * whole:
                verdict = False
            elif not c.children and c.tag in FLOW:
                verdict = True
            elif best is not None:  # beside the article's part: only what belongs to its title
                verdict = before and self.title[k]
            elif 2 * flow >= whole:
                verdict = self.title[k] or c.tag in TABLES or (self.mean(k) >= STRAY * whole and 2 * self.records[k] < self.vary[k])
            else:
                verdict = 2 * self.records[k] < self.vary[k] or self.mean(k) >= MOST * whole
            for x in _below(c):
                named = x.out and x is not c and to[x.at] >= 0 and self.mean(to[x.at]) < OVERRULES * whole
                keep[x.at] = False if named else verdict
                if verdict and to[x.at] < 0:
                    keep[x.at] = None
                if verdict and to[x.at] >= 0 and 2 * self.links[to[x.at]] > self.chars[to[x.at]]:
                    keep[x.at] = False


def _below(x: Shape) -> Iterator[Shape]:
    todo = [x]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(x.children)


def content(page: Page, wrapper: Wrapper | None) -> list[str]:
    """The content's blocks in page order."""
    if wrapper is not None and wrapper.tells:
        keep, to, trust = wrapper.plan(page)
        kept = [(k, text) for k, text, _, out in page.pieces if (keep[k] if keep[k] is not None else not out)]
        fixed = [trust and to[k] >= 0 and (to[k], text_hash(text)) in wrapper.constant for k, text in kept]
        # What pages repeat goes before and behind the text that varies; between its parts headings, items and paragraphs stay.
        first, last = next((i for i, f in enumerate(fixed) if not f), 0), next((i for i in range(len(fixed) - 1, -1, -1) if not fixed[i]), -1)
        flow = lambda k: nodes[k].tag in FLOW
        nodes = number(page.shape) if any(fixed) else []
        got = [text for i, (k, text) in enumerate(kept) if not fixed[i] or first < i < last and flow(k)]
        if got or not page.pieces:
            return got
    nodes = number(page.shape)
    scope: set[int] = set()
    for k in page.main:
        if k not in scope:
            scope.update(x.at for x in _below(nodes[k]))
    if any(k in scope and not out for k, _, _, out in page.pieces):
        return [t for k, t, _, out in page.pieces if k in scope and not out]
    return [t for _, t, _, out in page.pieces if not out]


def blocks(root: Node, wrapper: dict) -> list[str]:
    """The content's blocks of a parsed page with a wrapper of induce()."""
    return content(Page(root), Wrapper(wrapper["template"], wrapper["stats"], wrapper["constant"]) if wrapper.get("template") else None)


def counted(page_nodes: list[int], hashes: list[int], chars: list[int], links: list[int], to: list[int]) -> list[tuple]:
    """(template node, hash, characters, those in links) of a page's texts, each text of a node once."""
    out: dict = {}
    for k, h, c, l in zip(page_nodes, hashes, chars, links):
        if to[k] >= 0:
            out.setdefault((to[k], h), (c, l))
    return [(k, h, c, l) for (k, h), (c, l) in out.items()]


def induce(pages: list[str]) -> dict:
    """The wrapper of one host's pages, in this process: template, stats and constant texts. What wrappers() does in Spark."""
    different = {}
    for p in pages:
        page = Page(parse(p))
        if page.pieces:
            different.setdefault(page.digest(), page)
    if len(different) < LEAST_PAGES:
        return {"template": None, "stats": [], "constant": []}
    shapes: dict[str, int] = {}
    for page in different.values():
        shapes[dump(page.shape)] = shapes.get(dump(page.shape), 0) + 1
    text = template(list(shapes.items()), LEAST_PAGES)
    nodes, seen = load(text), {}
    for page in different.values():
        found: dict = {}
        match(page.shape, nodes[0], found)
        to = [found[x].at if x in found else -1 for x in number(page.shape)]
        for k, h, c, l in counted([p[0] for p in page.pieces], [text_hash(p[1]) for p in page.pieces], [len(p[1]) for p in page.pieces], [p[2] for p in page.pieces], to):
            s = seen.setdefault((k, h), [0, 0, 0])
            s[0], s[1], s[2] = s[0] + 1, s[1] + c, s[2] + l
    constant = [[k, h] for (k, h), s in seen.items() if s[0] >= LEAST_PAGES and s[0] >= CONSTANT * nodes[k].n]
    fixed, stats = {(k, h) for k, h in constant}, {}
    for (k, h), (_, c, l) in seen.items():
        s = stats.setdefault(k, {"node": k, "vary": 0, "fixed": 0, "links": 0, "chars": 0})
        s["fixed" if (k, h) in fixed else "vary"] += c - l
        s["links"], s["chars"] = s["links"] + l, s["chars"] + c
    return {"template": text, "stats": list(stats.values()), "constant": constant}


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]+)", 1), F.lit("")))


def _with_host(rows: DataFrame, learned: DataFrame, size: int, how: str) -> DataFrame:
    """rows with their host's columns of `learned`. A small table is sent to all executors; of a large one only the rows
    of the few hosts that many rows have (at most 1 / HOT of them), so that no host's rows meet in one task."""
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(learned), "host", how)
    sizes = cut(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "hosts")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = sizes.where(F.col("n") > HOT * total).select("host")
    few = rows.join(F.broadcast(hot), "host", "left_semi").join(F.broadcast(learned.join(F.broadcast(hot), "host", "left_semi")), "host", how)
    return few.unionByName(rows.join(F.broadcast(hot), "host", "left_anti").join(learned, "host", how))


REPS = "page_id string, host string, digest long, shape string, nodes array<int>, hashes array<long>, chars array<int>, links array<int>"


def wrappers(pages: DataFrame) -> DataFrame:
    """host, template, stats and constants (JSON) of every host with LEAST_PAGES different pages. pages: page_id, host, html."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, h, source in zip(b["page_id"], b["host"], b["html"]):
                page = Page(parse(source))
                if page.pieces:
                    rows.append((i, h, page.digest(), dump(page.shape), [p[0] for p in page.pieces], [text_hash(p[1]) for p in page.pieces], [len(p[1]) for p in page.pieces], [p[2] for p in page.pieces]))
            yield pd.DataFrame(rows, columns=["page_id", "host", "digest", "shape", "nodes", "hashes", "chars", "links"])

    named = pages.where("host <> ''").select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page_id"), "host", "html")
    seen = named.mapInPandas(read, REPS)
    different = cut(seen.groupBy("host", "digest").agg(F.min_by(F.struct("shape", "nodes", "hashes", "chars", "links"), "page_id").alias("x")).select("host", "x.*"), "pages")

    def merged(least: int):
        def run(p: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"host": [p["host"].iloc[0]], "shape": [template(list(zip(p["shape"], p["n"])), least)], "n": [0]})

        return run

    shapes = different.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"))
    while True:
        shapes = cut(shapes, "shapes")
        bunches = shapes.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / BUNCH).alias("bunches"))
        if (bunches.agg(F.max("bunches")).first()[0] or 1) == 1:
            break
        dealt = shapes.join(bunches, "host").withColumn("bunch", F.pmod(F.xxhash64("shape"), F.col("bunches")))
        shapes = dealt.groupBy("host", "bunch").applyInPandas(merged(0), "host string, shape string, n long")
    templates = shapes.groupBy("host").applyInPandas(merged(LEAST_PAGES), "host string, shape string, n long").select("host", F.col("shape").alias("template"))
    templates = cut(templates.where(F.get_json_object("template", "$[2][0]").cast("long") >= LEAST_PAGES), "templates")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for b in batches:
            rows = []
            for h, shape, text, nodes, hashes, chars, links in zip(b["host"], b["shape"], b["template"], b["nodes"], b["hashes"], b["chars"], b["links"]):
                if (h, shape) not in known:
                    if len(known) > 2000:
                        known.clear()
                    wanted, found = load(text), {}
                    own = load(shape)
                    match(own[0], wanted[0], found)
                    known[h, shape] = [found[x].at if x in found else -1 for x in own], [x.n for x in wanted]
                to, n = known[h, shape]
                rows.extend((h, k, t, int(c), int(l), n[k]) for k, t, c, l in counted(nodes, hashes, chars, links, to))
            yield pd.DataFrame(rows, columns=["host", "node", "hash", "chars", "links", "pages"])

    size = templates.agg(F.sum(F.length("template"))).first()[0] or 0
    texts = _with_host(different, templates, size, "inner").mapInPandas(count, "host string, node int, hash long, chars long, links long, pages long")
    texts = texts.groupBy("host", "node", "hash").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.max("pages").alias("pages"))
    constant = (F.col("n") >= LEAST_PAGES) & (F.col("n") >= CONSTANT * F.col("pages"))
    free = F.col("chars") - F.col("links")
    # Constant texts are at most 1 / CONSTANT times the blocks of a page, so a host's are a short list.
    nodes = texts.groupBy("host", "node").agg(
        F.sum(F.when(constant, 0).otherwise(free)).alias("vary"), F.sum(F.when(constant, free).otherwise(0)).alias("fixed"), F.sum("links").alias("links"), F.sum("chars").alias("chars"),
        F.collect_list(F.when(constant, F.col("hash"))).alias("hashes"))
    told = nodes.groupBy("host").agg(F.to_json(F.collect_list(F.struct("node", "vary", "fixed", "links", "chars"))).alias("stats"), F.to_json(F.collect_list(F.struct("node", "hashes"))).alias("constants"))
    return templates.join(told, "host")


def _wrapper(text: str, stats: str, constants: str) -> Wrapper:
    return Wrapper(text, json.loads(stats), [(c["node"], h) for c in json.loads(constants) for h in c["hashes"]])


def main_text(pages: DataFrame, learn: bool = True) -> DataFrame:
    """page_id, url, text, n_chars. Without `learn` the names of elements and classes decide alone."""
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    if learn:
        learned = cut(wrappers(rows), "wrappers")
        size = learned.agg(F.sum(F.length("template") + F.length("stats") + F.length("constants"))).first()[0] or 0
        rows = _with_host(rows, learned, size, "left")
    else:
        rows = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in ("template", "stats", "constants")])

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Wrapper | None] = {}
        for b in batches:
            texts = []
            for h, source, *w in zip(b["host"], b["html"], b["template"], b["stats"], b["constants"]):
                if h not in known:
                    if len(known) > 200:
                        known.clear()
                    known[h] = _wrapper(*w) if isinstance(w[0], str) else None
                texts.append("\n".join(content(Page(parse(source)), known[h])))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    out = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "host", "html", "template", "stats", "constants").mapInPandas(extract, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))
