"""Main text of web pages by wrapper induction.

Pages of a host come from one template.  Each page is reduced to a tree of its
block elements, and the trees of a host are aligned by simple tree matching:
of all matchings of two trees that keep roots, levels and order, the one that
pairs the most nodes.  Aligned nodes become one node of the host's wrapper,
which knows on how many distinct pages it stands.  Then the texts of each node
are counted over all pages of the host: a text that most of the node's pages
have is constant, so it is template, and what varies is a slot for content.

The main text of a page is what stands in its article (in the whole body where
no element is one) without constant texts, without the parts that are menus,
headers, footers, sidebars, notices, adverts, forms or comments by element,
role or name, and, outside an article, without blocks that are mostly links.

No task holds a host.  Tasks align the trees they have, partial wrappers are
aligned with one another a few at a time until one per host is left, and texts
are counted by an ordinary aggregate.  Copies of a page count once.

A wrapper of too many nodes gives up its rarest ones.  Whatever of a page then
has no node in its host's wrapper is a node of its own, named by the node above
it that has one and by the labels down from there, and an ordinary aggregate
counts it and its texts like any other.  Such nodes are as many as the pages
make them, so pages get the constant texts of theirs by a join of their own.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutover.llm.common import with_columns_by_batch
from cutover.session import stage

#: Distinct pages that must have a node before a text of it can be constant.
LEAST_PAGES = 5
#: Share of a node's pages that must have a text for it to be constant.
CONSTANT = 0.6
#: Share of an article (of a body without one) that constant texts may take; more means that the host's pages copy one another.
TAKEN, TAKEN_OF_BODY = 0.5, 0.9
#: Share of characters inside links from which a block outside an article is a menu.
LINKED = 0.6
#: Partial wrappers that one step aligns with one another, and hosts a task holds before it passes partial wrappers on.
FAN_IN, HOSTS = 16, 2_000
#: A wrapper of more nodes gives up those on fewer than this share of its pages; they are then counted by name.
NODES, RARE = 2_000, 0.02
#: Levels of a tree; deeper elements count as their ancestor.  Siblings alike beyond ALIKE count as one.
LEVELS, ALIKE = 60, 32
#: Elements open at once; a deeper one ends the innermost, and no text is lost.
DEPTH = 512

# Elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEAD = frozenset("base basefont bgsound head html link meta".split()) | RAW
FLOW = frozenset("p h2 h3 h4 h5 h6 ul ol dl li dt dd blockquote pre figure figcaption table thead tbody tr td th hr".split())
UNSEEN = frozenset("head audio video canvas object applet map select option datalist button form fieldset dialog menu meter progress".split())
AROUND = frozenset("nav header footer aside".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner billboard breadcrumb breadcrumbs comment comments commentlist consent cookie cookies discussion disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup privacy promo promoted "
    "promotion recommended related replies reply respond responses rail search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription "
    "toolbar topbar widget widgets".split())
HEADERS = frozenset("header masthead".split())
ARTICLE_WORDS = frozenset("article content entry post story".split())
NEGATIONS = frozenset("has no with without".split())
P_ENDS = "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul"
CELLS, ROWS = frozenset("td th p".split()), frozenset("tr td th p".split())
#: A start tag ends these open elements, as far out as the nearest of the second set.
IMPLIED = {
    **{t: (frozenset({"p"}), frozenset("button td th li dd table object".split())) for t in P_ENDS.split()},
    "li": (frozenset({"li", "p"}), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd p".split()), frozenset({"dl"})),
    "dd": (frozenset("dt dd p".split()), frozenset({"dl"})),
    "td": (CELLS, frozenset({"tr", "table"})),
    "th": (CELLS, frozenset({"tr", "table"})),
    "tr": (ROWS, frozenset("table thead tbody tfoot".split())),
    **{t: (ROWS | {"thead", "tbody", "tfoot"}, frozenset({"table"})) for t in ("thead", "tbody", "tfoot")},
}
#: End tags of other elements don't reach beyond these.
SCOPE = frozenset("table td th article section main body html".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_UNSEEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}


class Page:
    """The elements of a page in order, and its blocks of text."""

    def __init__(self, text: str | None):
        self.names: list[str] = []
        self.parents: list[int] = []
        self.attributes: list[dict[str, str]] = []
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters of it inside links
        self._open: list[int] = []
        self._pieces: list[tuple[str, bool]] = []
        self._owner, self._links = -1, 0
        self._read(text or "")

    def _push(self, name: str, attributes: dict[str, str]) -> None:
        self.parents.append(self._open[-1] if self._open else -1)
        self.names.append(name)
        self.attributes.append(attributes)
        self._open.append(len(self.names) - 1)

    def _ensure_root(self) -> None:
        if not self._open:
            if self.names:
                self._open.append(0)
            else:
                self._push("html", {})

    def _flush(self) -> None:
        if self._owner >= 0:
            joined = " ".join("".join(p for p, _ in self._pieces).split())
            if joined:
                self.blocks.append((self._owner, joined, sum(len("".join(p.split())) for p, linked in self._pieces if linked)))
        self._pieces, self._owner = [], -1

    def _shut(self, level: int) -> None:
        while len(self._open) > level:
            name = self.names[self._open.pop()]
            if name == "a":
                self._links -= 1
            if name not in INLINE:
                self._flush()

    def _leave_head(self) -> None:
        for level, e in enumerate(self._open[:3]):
            if self.names[e] == "head":
                self._shut(level)
                return

    def _add(self, piece: str) -> None:
        if "&" in piece:
            piece = html.unescape(piece)
        if self._owner < 0:
            if not piece or piece.isspace():
                return
            self._leave_head()
            self._ensure_root()
            self._owner = next((e for e in reversed(self._open) if self.names[e] not in INLINE), 0)
        self._pieces.append((piece, self._links > 0))

    def _start(self, name: str, raw: str) -> None:
        if name not in HEAD:
            self._leave_head()
        if name == "html" and self.names or name == "body" and any(self.names[e] == "body" for e in self._open):
            return
        if name in IMPLIED:
            ends, stops = IMPLIED[name]
            level = None
            for k in range(len(self._open) - 1, -1, -1):
                own = self.names[self._open[k]]
                if own in stops:
                    break
                if own in ends:
                    level = k
            if level is not None:
                self._shut(level)
        if name not in INLINE:
            self._flush()
        if name in VOID:
            return
        if name != "html":
            self._ensure_root()
        attributes: dict[str, str] = {}
        if raw and not raw.isspace():
            for key, a, b, c in _ATTRIBUTE.findall(raw):
                value = a or b or c
                attributes.setdefault(key.lower(), html.unescape(value) if "&" in value else value)
        if len(self._open) >= DEPTH:
            self._shut(DEPTH - 1)
        if name == "a":
            self._links += 1
        self._push(name, attributes)

    def _end(self, name: str) -> None:
        for level in range(len(self._open) - 1, -1, -1):
            own = self.names[self._open[level]]
            if own == name:
                self._shut(level)
                return
            if own in SCOPE and name not in SCOPE:
                return

    def _read(self, text: str) -> None:
        at, n = 0, len(text)
        while at < n:
            start = text.find("<", at)
            if start < 0:
                start = n
            if start > at:
                self._add(text[at:start])
            if start == n:
                break
            found = _TOKEN.match(text, start)
            if found is None:  # a "<" that begins no tag is text; "</" and what is no name is a comment
                if text.startswith("</", start):
                    at = text.find(">", start) + 1 or n
                else:
                    self._add("<")
                    at = start + 1
                continue
            at = found.end()
            if not found[2]:
                continue
            name = found[2].lower()
            if name == "br":
                self._add(" ")
            elif found[1]:
                self._end(name)
            elif name in RAW:
                if name not in HEAD:
                    self._leave_head()
                if not (name in ("svg", "math") and found[3].endswith("/")):
                    close = _RAW_END[name].search(text, at)
                    at = close.end() if close else n
            else:
                self._start(name, found[3])
        self._shut(0)
        self._flush()


def named_around(attributes: dict[str, str], in_article: bool) -> bool:
    """Whether an element's class or id says that it is no part of the article."""
    for one in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w.lower() for w in _WORD.findall(one)]
        for k, w in enumerate(words):
            before = words[k - 1] if k else ""
            if w not in NAMES and before + w in NAMES:
                w, before = before + w, words[k - 2] if k > 1 else ""
            if w in NAMES and before not in NEGATIONS and not (w in HEADERS and (in_article or before in ARTICLE_WORDS)):
                return True
    return False


def regions(page: Page) -> tuple[list[bool], list[bool]]:
    """For each element: whether it is in a part around the article, and whether it is in the article.

    An element that is around by its name only, and yet holds the article or
    the first heading and more than half of the text, is just a frame.
    """
    n = len(page.names)
    below, marks = [0] * n, [False] * n  # characters, and whether an article or h1 is in there
    for e, text, _ in page.blocks:
        below[e] += len(text)
    for e in range(n - 1, -1, -1):
        name = page.names[e]
        marks[e] = marks[e] or name in ("article", "main", "h1")
        if page.parents[e] >= 0:
            below[page.parents[e]] += below[e]
            marks[page.parents[e]] = marks[page.parents[e]] or marks[e]
    whole = below[0] if n else 0
    around, kind, headed = [False] * n, [""] * n, [False] * n
    for e, (name, parent, attributes) in enumerate(zip(page.names, page.parents, page.attributes)):
        role = attributes.get("role", "").lower()
        inside = parent >= 0 and kind[parent] != ""
        if parent >= 0 and around[parent]:
            around[e] = True
        elif name in UNSEEN or name in AROUND and not (name == "header" and inside) or role in ROLES:
            around[e] = True
        elif "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _UNSEEN_STYLE.search(attributes.get("style", "")):
            around[e] = True
        elif name not in ("html", "body") and ("class" in attributes or "id" in attributes) and named_around(attributes, inside):
            around[e] = not (marks[e] and 2 * below[e] > whole)
        kind[e] = kind[parent] if parent >= 0 else ""
        if not around[e] and (name in ("article", "main") or role in ("article", "main")):
            if "article" in (name, role) or kind[e] == "":
                kind[e] = f"{'article' if 'article' in (name, role) else 'main'} {e}" if not kind[e].startswith("article") else kind[e]
        if name == "h1" and kind[e]:
            headed[int(kind[e].split()[1])] = True
    tops = {k for e, k in enumerate(kind) if k and not around[e]}
    texts = {kind[e] for e, _, _ in page.blocks if kind[e] and not around[e]}
    chosen = {k for k in tops & texts if k.startswith("article")} or tops & texts
    chosen = {k for k in chosen if headed[int(k.split()[1])]} or chosen
    return around, [k in chosen for k in kind] if chosen else []


class Node:
    """A node of a page's tree or of a wrapper: label, pages it stands on, children; ``partial`` at a wrapper's root says that it gave up nodes."""

    __slots__ = ("label", "n", "children", "texts", "at", "partial")

    def __init__(self, label: str, n: int = 1):
        self.label, self.n, self.children, self.texts, self.at, self.partial = label, n, [], [], -1, False

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)


def text_hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _label(name: str, attributes: dict[str, str]) -> str:
    first = attributes.get("class", "").split()[:1]
    return re.sub(r"\d+", "", " ".join([name, *first, attributes["id"] if "id" in attributes else ""])).rstrip() if attributes else name


def tree_of(page: Page) -> tuple[Node | None, list[Node]]:
    """The tree of block elements that hold text, and the node of each block.

    Paragraphs, items, rows and the like below one parent are one node if their
    labels agree, and so are other siblings alike beyond ALIKE.
    """
    if not page.blocks:
        return None, []
    nodes: list[Node] = []
    levels: list[int] = []
    merged: list[dict[str, list[Node]]] = []
    of: dict[int, dict[str, list[Node]]] = {}
    needed = set()
    for e, _, _ in page.blocks:
        while e >= 0 and e not in needed:
            needed.add(e)
            e = page.parents[e]
    for e, name in enumerate(page.names):
        parent = page.parents[e]
        if parent < 0:
            node, level = Node(name), 0
            of[id(node)] = {}
        else:
            node, level = nodes[parent], levels[parent]
            if e in needed and name not in INLINE and level < LEVELS:
                label = _label(name, page.attributes[e])
                alike = of[id(node)].setdefault(label, [])
                if not alike or name not in FLOW and len(alike) < ALIKE:
                    made = Node(label)
                    alike.append(made)
                    node.children.append(made)
                    of[id(made)] = {}
                node, level = alike[-1], level + 1
        nodes.append(node)
        levels.append(level)
    owners = [nodes[e] for e, _, _ in page.blocks]
    for node, (_, text, _) in zip(owners, page.blocks):
        node.texts.append(text_hash(text))
    return nodes[0], owners


def _paired(a: Node, b: Node, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two nodes with equal labels: nodes paired, and which children pair."""
    key = (id(a), id(b))
    if key in memo:
        return memo[key]
    left, right = a.children, b.children
    if not left or not right:
        memo[key] = (1, [])
        return memo[key]
    scores = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    pairs = [[_paired(x, y, memo)[0] if x.label == y.label else 0 for y in right] for x in left]
    for i in range(1, len(left) + 1):
        for j in range(1, len(right) + 1):
            scores[i][j] = max(scores[i - 1][j], scores[i][j - 1], scores[i - 1][j - 1] + pairs[i - 1][j - 1] if pairs[i - 1][j - 1] else 0)
    i, j, out = len(left), len(right), []
    while i and j:
        if pairs[i - 1][j - 1] and scores[i][j] == scores[i - 1][j - 1] + pairs[i - 1][j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif scores[i][j] == scores[i - 1][j]:
            i -= 1
        else:
            j -= 1
    memo[key] = (1 + scores[-1][-1], out[::-1])
    return memo[key]


def merge(a: Node, b: Node) -> Node:
    """One wrapper of two whose roots have equal labels: paired nodes add up, the others stay, in order."""
    memo: dict = {}

    def join(x: Node, y: Node) -> Node:
        out = Node(x.label, x.n + y.n)
        i = j = 0
        for p, q in [*_paired(x, y, memo)[1], (len(x.children), len(y.children))]:
            out.children += x.children[i:p] + y.children[j:q]
            if p < len(x.children):
                out.children.append(join(x.children[p], y.children[q]))
            i, j = p + 1, q + 1
        return out

    whole = join(a, b)
    whole.partial = a.partial or b.partial
    if whole.size() > NODES:
        before = whole.size()
        _give_up(whole, max(2, RARE * whole.n))
        whole.partial = whole.partial or whole.size() < before
    return whole


def _give_up(node: Node, least: float) -> None:
    node.children = [c for c in node.children if c.n >= least]
    for c in node.children:
        _give_up(c, least)


def numbered(root: Node) -> Node:
    """Give each node its place in document order."""
    todo, k = [root], 0
    while todo:
        node = todo.pop()
        node.at, k = k, k + 1
        todo += reversed(node.children)
    return root


def placed(tree: Node, wrapper: Node) -> dict[int, int]:
    """The wrapper's node, by number, of each node of a tree that pairs with one."""
    if tree.label != wrapper.label:
        return {}
    memo: dict = {}
    out, todo = {}, [(tree, wrapper)]
    while todo:
        x, y = todo.pop()
        out[id(x)] = y.at
        todo += [(x.children[p], y.children[q]) for p, q in _paired(x, y, memo)[1]]
    return out


def all_placed(tree: Node, wrapper: Node) -> dict[int, int]:
    """``placed``, and a name of 64 bits for each other node: the wrapper's node above it, and the way down from there.

    Siblings without a place that have the same label are told apart by their order.
    """
    out = placed(tree, wrapper)
    todo = [(tree, "")]
    if id(tree) not in out:
        out[id(tree)] = text_hash(f"\n{tree.label}")
    while todo:
        node, way = todo.pop()
        alike: dict[str, int] = {}
        for c in node.children:
            if id(c) in out:
                todo.append((c, ""))
                continue
            alike[c.label] = k = alike.get(c.label, 0) + 1
            down = f"{way or out[id(node)]}\n{c.label}\t{k}"
            out[id(c)] = text_hash(down)
            todo.append((c, str(out[id(c)])))
    return out


def packed(node: Node, texts: bool) -> list:
    out = [node.label, node.texts if texts else node.n, [packed(c, texts) for c in node.children]]
    return [*out, True] if node.partial else out


def unpacked(data: list, texts: bool) -> Node:
    node = Node(data[0], 1 if texts else data[1])
    if texts:
        node.texts = data[1]
    node.children = [unpacked(c, texts) for c in data[2]]
    node.partial = len(data) > 3
    return node


def main_blocks(page: Page, constant: Callable[[int, str], bool] | None) -> list[str]:
    """The blocks of the main text, in order; ``constant`` tells by number and text which are template."""
    around, article = regions(page)
    inside = [k for k, (e, _, _) in enumerate(page.blocks) if not around[e] and (not article or article[e])]
    if not article:
        inside = [k for k in inside if page.blocks[k][2] < LINKED * len("".join(page.blocks[k][1].split()))]
    if constant is not None:
        template = {k for k in inside if constant(k, page.blocks[k][1])}
        length = lambda ks: sum(len(page.blocks[k][1]) for k in ks)
        if length(template) <= (TAKEN if article else TAKEN_OF_BODY) * length(inside):
            inside = [k for k in inside if k not in template]
    return [page.blocks[k][1] for k in inside]


def host_of(url: Column) -> Column:
    """The host of an address, lower-case; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.nullif(host, F.lit(""))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, trees = [], []
        for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            root, _ = tree_of(Page(text))
            if root is not None:
                hosts.append(host)
                trees.append(json.dumps(packed(root, True), separators=(",", ":")))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(trees, pa.string())], names=["host", "tree"])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of the trees of a task; a task with very many hosts passes them on in parts."""
    held: dict[str, Node] = {}

    def out() -> pa.RecordBatch:
        rows = [(h, json.dumps(packed(w, False), separators=(",", ":"))) for h, w in sorted(held.items())]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["host", "wrapper"])

    for batch in batches:
        for host, tree in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            node = unpacked(json.loads(tree), True)
            held[host] = merge(held[host], node) if host in held else node
            if len(held) >= HOSTS:
                yield out()
    if held:
        yield out()


def _joined(wrappers: pa.Table) -> pa.Table:
    whole = None
    for text in sorted(wrappers["wrapper"].to_pylist()):
        one = unpacked(json.loads(text), False)
        whole = one if whole is None else merge(whole, one)
    return pa.table({"host": wrappers["host"].slice(0, 1), "slot": wrappers["slot"].slice(0, 1), "wrapper": pa.array([json.dumps(packed(whole, False), separators=(",", ":"))])})


def induced(pages: DataFrame, url: str = "url", text: str = "html") -> DataFrame:
    """(host, wrapper, constants, page, rest): each host's wrapper and its constant texts as (node, hash of the text).

    For hosts whose wrapper gave up nodes there are more rows, one for each
    distinct page with constant texts that have no node in the wrapper: the
    host, the hash of the page, and these texts as (name, hash of the text).
    Pages without a host or without text have no part in it.
    """
    source = pages.select(host_of(F.col(url)).alias("host"), F.col(text).cast("string").alias("html")).filter("host is not null and html is not null")
    trees = stage(source.mapInArrow(_trees, "host string, tree string").distinct(), "wrapper-trees")
    partial = stage(trees.mapInArrow(_partial, "host string, wrapper string").withColumn("slot", F.spark_partition_id().cast("long")), "wrapper-parts")
    width = (partial.agg(F.max("slot")).first()[0] or 0) + 1
    wrappers = partial.select("host", "slot", "wrapper")
    while True:
        width = -(-width // FAN_IN)
        wrappers = wrappers.withColumn("slot", F.floor(F.col("slot") / FAN_IN)).groupBy("host", "slot").applyInArrow(_joined, "host string, slot long, wrapper string")
        if width == 1:
            break
    wrappers = stage(wrappers.select("host", "wrapper"), "wrappers")

    def nodes_of(root: Node, whole: Node) -> Iterator[tuple[int, list[int | None]]]:
        """The nodes of a page that have a place with their texts; null stands for the node itself where its pages are still to be counted."""
        places, todo = (all_placed if whole.partial else placed)(root, whole), [root]
        while todo:
            node = todo.pop()
            todo += node.children
            if id(node) in places:
                yield places[id(node)], [*set(node.texts), *([None] if whole.partial else [])]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, Node]] = {}
        for batch in batches:
            rows = []
            for host, tree, wrapper in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for place, hashes in nodes_of(unpacked(json.loads(tree), True), _held(known, host, wrapper)):
                    rows += [(host, place, h) for h in hashes]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["host", "node", "text"])

    def rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, Node]] = {}
        for batch in batches:
            rows = []
            for host, page, text, wrapper in zip(*(batch.column(k).to_pylist() for k in range(4))):
                root, _ = tree_of(Page(text))
                if root is not None:
                    whole = _held(known, host, wrapper)
                    inside = set(placed(root, whole).values())
                    rows += [(host, page, place, h) for place, hashes in nodes_of(root, whole) if place not in inside for h in hashes if h is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["host", "page", "node", "text"])

    counted = trees.join(wrappers, "host").select("host", "tree", "wrapper").mapInArrow(texts, "host string, node long, text long").groupBy("host", "node", "text").agg(
        F.count(F.lit(1)).alias("pages"))
    # a text on one page of LEAST_PAGES or more is never constant
    counted = stage(counted.filter("pages > 1"), "wrapper-texts")
    listed = wrappers.mapInArrow(_sizes, "host string, node long, n long, placed boolean, partial boolean")
    # what a wrapper that gave up nodes knows of its pages is too little
    sizes = listed.filter("not partial").select("host", "node", "n").unionByName(counted.filter("text is null").select("host", "node", F.col("pages").alias("n"))).filter(F.col("n") >= LEAST_PAGES)
    constant = counted.filter("text is not null").join(sizes, ["host", "node"]).filter(F.col("pages") >= CONSTANT * F.col("n")).select("host", "node", "text")
    constant = stage(constant.join(listed.select("host", "node", "placed"), ["host", "node"], "left"), "wrapper-constant-texts")
    inside = constant.filter("placed").groupBy("host").agg(F.collect_set(F.struct("node", "text")).alias("constants"))
    outside = constant.filter("placed is null").select("host", "node", "text")
    # only pages of such hosts are read again
    again = source.withColumn("page", page_of(F.col("html"))).join(outside.select("host").distinct(), "host", "left_semi").distinct().join(wrappers, "host")
    rest = again.select("host", "page", "html", "wrapper").mapInArrow(rests, "host string, page string, node long, text long").join(outside, ["host", "node", "text"])
    rest = rest.groupBy("host", "page").agg(F.collect_set(F.struct("node", "text")).alias("rest"))
    return stage(wrappers.join(inside, "host", "left").unionByName(rest, allowMissingColumns=True), "wrapper-constants")


def page_of(html: Column) -> Column:
    """The hash by which a page is known."""
    return F.sha2(html, 256)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, wrapper in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            root = numbered(unpacked(json.loads(wrapper), False))
            todo = [root]
            while todo:
                node = todo.pop()
                rows.append((host, node.at, node.n, True, root.partial))
                todo += node.children
        types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["host", "node", "n", "placed", "partial"])


def _held(known: dict, host: str, wrapper: str) -> Node:
    """A host's wrapper, read once while its pages come one after the other."""
    found = known.get(host)
    if found is None or found[0] != wrapper:
        if len(known) >= 500:
            known.clear()
        known[host] = found = (wrapper, numbered(unpacked(json.loads(wrapper), False)))
    return found[1]


def with_main_text(df: DataFrame, wrappers: DataFrame, url: str = "url", text: str = "html", drop: tuple[str, ...] = ()) -> DataFrame:
    """Append ``text`` (blocks joined by line feeds) and ``n_chars`` (its code points).

    Null and empty pages have an empty text; pages without a host, and hosts
    with fewer than LEAST_PAGES distinct pages, are read without a template.
    Repeated rows get equal results, pages that are no HTML are one block.
    """
    known: dict = {}
    constants: dict = {}

    def rows(texts: list, hosts: list, found: list, listed: list, rests: list) -> list[tuple]:
        out = []
        for t, host, wrapper, pairs, rest in zip(texts, hosts, found, listed, rests):
            page, constant = Page(t), None
            if pairs or rest:
                whole = _held(known, host, wrapper)
                if constants.get(host, (None,))[0] is not whole:
                    if len(constants) >= 500:
                        constants.clear()
                    constants[host] = (whole, {(p["node"], p["text"]) for p in pairs or []})
                constant = _lookup(page, whole, constants[host][1], {(p["node"], p["text"]) for p in rest or []})
            text = "\n".join(main_blocks(page, constant))
            out.append((text, len(text)))
        return out

    own = {c.lower() for c in df.columns}
    joined = {}
    for name in ("host", "wrapper", "constants", "html", "w", "page", "rest", "r", "p"):
        joined[name] = f"_{name}"
        while joined[name] in own:
            joined[name] += "_"
    here = df.withColumns({joined["host"]: host_of(F.col(url)), joined["html"]: F.col(text).cast("string")})
    hosts, rests = wrappers.filter("page is null"), wrappers.filter("page is not null")
    sided = hosts.select(F.col("host").alias(joined["w"]), F.col("wrapper").alias(joined["wrapper"]), F.col("constants").alias(joined["constants"]))
    here = here.join(sided, here[joined["host"]] == sided[joined["w"]], "left").select(*here.columns, joined["wrapper"], joined["constants"])
    of_pages = rests.select(F.col("host").alias(joined["r"]), F.col("page").alias(joined["p"]), F.col("rest").alias(joined["rest"]))
    same = (here[joined["host"]] == of_pages[joined["r"]]) & (page_of(here[joined["html"]]) == of_pages[joined["p"]])
    here = here.join(of_pages, same, "left").select(*here.columns, joined["rest"])
    uses = tuple(joined[n] for n in ("html", "host", "wrapper", "constants", "rest"))
    return with_columns_by_batch(here, "text string, n_chars long", rows, uses, drop=(*drop, *uses))


def _lookup(page: Page, wrapper: Node, constants: set[tuple[int, int]], rest: set[tuple[int, int]]) -> Callable[[int, str], bool]:
    tree, owners = tree_of(page)
    places = {} if tree is None else (all_placed if rest else placed)(tree, wrapper)

    def constant(k: int, text: str) -> bool:
        found = (places.get(id(owners[k]), -1), text_hash(text))
        return found in constants or found in rest

    return constant
