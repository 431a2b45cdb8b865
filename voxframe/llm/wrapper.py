"""Main text of web pages by wrapper induction.

Pages of one host share a template. Two reference pages per host stand for it; every
page's DOM tree is aligned with them by simple tree matching (the largest
order-preserving set of node pairs with equal labels and matched parents). Counts
over all pages of a host then say

- which nodes of a reference keep their text on nearly all pages that have them:
  these are template, whatever their length;
- which label paths hold the text that varies. The host's content is the deepest path
  whose subtrees hold most of it, outside links and outside parts that are never main
  text.

A page is read at its nodes of the content path. A page where these hold too little of
its own text (another layout, a host of one page) is read at its own deepest node that
holds most of it. Headings and neighbours of that node in its container belong to it.
Template blocks and parts that are never main text are left out: elements made for
other things (menus, headers, footers, asides, forms, scripts), and blocks that a class
or id names as such in one whole word. A name that may as well describe the layout does not
count against a block that holds much of the page's text.

Text in one block is joined with single spaces; blocks are joined by two line feeds.
A page of which template nodes hold more than half the text is taken for a copy of
others and keeps them. Null and empty pages, and pages without text, give an empty text. Null urls form one
host of their own. Repeated rows each get their result, extra columns play no part, an
empty table gives an empty result. Depth and number of children are not limited: trees
are walked with stacks, and long lists of children are aligned by the same weighted table as
short ones, of which every so many rows are kept. Subtrees of equal shape (labels and order) align
alike, so each pair of shapes is aligned once.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_lists, materialize

#: Reference pages of a host that stand for its template; statistics cover all pages.
REFERENCES = 2
#: Characters from which a template text is known wherever it stands.
LONG = 40
#: Parts that one host's pages are dealt to.
SALTS = 32
#: Share of aligned pages with the same text from which a reference node is template, and the pages that takes.
CONSTANT, LEAST_ALIGNED = 0.9, 3
#: Share of the varying text that the content node must hold.
HOLDS = 0.7
#: Share of a page's text from which a block's name does not make it a never-part.
PROTECTED = 0.4
MASK = (1 << 63) - 1
#: Cells of a table of child lists up to which it is filled cell by cell, and beyond which row by row, with equal values.
TABLE_CELLS = 400
#: Shapes, aligned children and characters of reference pages that a worker remembers.
KNOWN = 1 << 20

# Fixed values of HTML: elements without content, raw text elements, blocks, and elements that end an open one.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
BLOCK = frozenset("""address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCK - frozenset("body html caption td th tr tbody thead tfoot".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NEVER = frozenset("head script style noscript template iframe svg nav header footer aside form button select textarea dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that name parts which are never main text: those that hold whatever the part's size, and all.
CERTAIN = frozenset("""ad ads advert advertisement advertising comment comments consent cookie cookies disqus modal newsletter popup
replies respond sponsor sponsored subscribe""".split())
PARTS = CERTAIN | frozenset("""banner breadcrumb breadcrumbs footer header menu nav navbar navigation notice notices promo related share
sidebar social widget""".split())
#: Words that may follow one of these, and words before one that make it a part of the article or a mere switch.
HOLDERS = frozenset("area bar block box container content form inner item left list right section slot top bottom unit wrap wrapper".split())
OWNERS = frozenset("article content entry has main no post story with without".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_DIGITS = re.compile(r"\d+")


def named_part(names: str) -> str | None:
    """The word by which one of these class names, ids or roles names a never-part."""
    for name in names.lower().split():
        if name in PARTS:
            return name
        words = re.split(r"[-_]+", name)
        if len(words) > 1:
            if words[-1] in PARTS and words[0] not in OWNERS:
                return words[-1]
            if words[0] in PARTS and words[-1] in HOLDERS:
                return words[0]
    return None


class Node:
    """An element: ``children`` are elements and text pieces in order, ``kids`` the elements among them."""

    __slots__ = ("label", "tag", "path", "depth", "part", "never", "children", "kids", "own", "size", "shape", "count", "at")

    def __init__(self, label: str, tag: str, path: int, depth: int, part: str | None):
        self.label, self.tag, self.path, self.depth, self.part = label, tag, path, depth, part
        self.never, self.size, self.own, self.shape = False, 0, None, None
        self.children: list = []
        self.kids: list[Node] = []


def parse(page: str | None) -> Node:
    """Tree of elements and text pieces (strings); forgiving about tags left open or out of place.

    ``path`` is a hash of the labels from the root; digits in labels count as one sign, so that
    ids with numbers do not set pages apart.
    """
    from xxhash import xxh64_intdigest

    root = Node("", "", 0, 0, None)
    stack, at, page = [root], 0, page or ""
    open_tags: dict[str, int] = {}
    raw_until = 0

    def pop() -> str:
        tag = stack.pop().tag
        open_tags[tag] -= 1
        return tag

    for m in _TOKEN.finditer(page):
        if m.start() < raw_until:
            continue
        if m.start() > at:
            stack[-1].children.append(page[at:m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if open_tags.get(tag):
                while pop() != tag:
                    pass
            continue
        if tag in CLOSES_P and open_tags.get("p"):
            k = len(stack) - 1
            while stack[k].tag != "p" and stack[k].tag not in BLOCK:
                k -= 1
            if stack[k].tag == "p":
                while len(stack) > k:
                    pop()
        elif tag in SIBLINGS:
            k = len(stack) - 1
            while k and stack[k].tag not in SIBLINGS[tag] and stack[k].tag not in BLOCK:
                k -= 1
            if k and stack[k].tag in SIBLINGS[tag]:
                while len(stack) > k:
                    pop()
        attributes = m.group(3)
        named = " ".join(filter(None, (a or b or c for _, a, b, c in _NAMED.findall(attributes)))) if len(attributes) > 3 else ""
        label = tag + "." + ".".join(_DIGITS.sub("#", named).split()) if named else tag
        top = stack[-1]
        node = Node(label, tag, xxh64_intdigest(label, top.path) & MASK, top.depth + 1, named_part(named) if named and tag not in ("html", "body") else None)
        top.children.append(node)
        top.kids.append(node)
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            node.children.append(page[at:end.start()] if end else page[at:])
            raw_until = at = end.start() if end else len(page)
            if end is None:
                break
        stack.append(node)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    if at < len(page) and raw_until < len(page):
        stack[-1].children.append(page[at:])
    _judge(root)
    return root


def in_order(root: Node) -> list[Node]:
    """Parents before children, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.kids))
    return out


def _judge(root: Node) -> None:
    """Sets ``size`` (characters of the subtree outside never-elements) and ``never``, which the subtree inherits."""
    nodes = in_order(root)
    for node in reversed(nodes):
        if node.tag not in NEVER:
            node.size = len(own_text(node)) + sum(k.size for k in node.kids)
    for node in nodes:
        node.never |= node.tag in NEVER or node.part is not None and (node.part in CERTAIN or node.size < PROTECTED * root.size)
        for k in node.kids if node.never else ():
            k.never = True


def own_text(node: Node) -> str:
    if node.own is None:
        node.own = " ".join(" ".join([c for c in node.children if isinstance(c, str)]).split())
    return node.own


def common_labels(xs: list[Node], ys: list[Node]) -> list[tuple[int, int]]:
    """A longest common subsequence of the labels, by bit-vectors of one row each."""
    places: dict[str, int] = {}
    for j, y in enumerate(ys):
        places[y.label] = places.get(y.label, 0) | 1 << j
    full = (1 << len(ys)) - 1
    rows, v = [], full
    for x in xs:
        u = v & places.get(x.label, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    # a zero bit j of row i says that the length grows at column j; walk back along the growth
    out, j = [], len(ys) - 1
    for i in range(len(xs) - 1, -1, -1):
        while j >= 0 and rows[i] >> j & 1:
            j -= 1
        if j < 0:
            break
        if i and not rows[i - 1] >> j & 1:
            continue
        out.append((i, j))
        j -= 1
    return out[::-1]


class Memory(dict):
    """A dict that empties itself, when asked to between two pages, once more than KNOWN was held."""

    held = 0

    def keep(self, key, value, size: int):
        self[key] = value
        self.held += size
        return value

    def tidy(self) -> None:
        if self.held > KNOWN:
            self.clear()
            self.held = 0


#: (label, shapes of the children) -> number; a number never comes back, so that shapes seen before and after tidying differ.
_SHAPES = Memory()
_NUMBERS = count()
#: (shape, shape) -> (matched nodes, matched children); (shape, shape) of whole pages -> places of the matched nodes.
_MATCHED, _PLACES = Memory(), Memory()


def mark_shapes(root: Node) -> list[Node]:
    """The nodes in page order, with ``at`` (place in it), ``count`` (nodes of the subtree) and ``shape`` set."""
    nodes = in_order(root)
    if root.shape is None:
        for at in range(len(nodes) - 1, -1, -1):
            node = nodes[at]
            node.at, node.count = at, 1 + sum([k.count for k in node.kids])
            key = (node.label, *[k.shape for k in node.kids])
            node.shape = _SHAPES.get(key)
            if node.shape is None:
                node.shape = _SHAPES.keep(key, next(_NUMBERS), len(key))
    return nodes


def _table(weights: list, width: int) -> Iterator[tuple[int, list]]:
    """(row, the table's values in it) from the last row back; ``weights`` has one list for each row of the table.

    A large table keeps about the root of its rows, fills the others again between two of them, and so holds
    few rows at once.
    """
    small = len(weights) * width <= TABLE_CELLS
    step = len(weights) + 1 if small else math.isqrt(len(weights)) + 1

    def fill(above, lo: int, hi: int) -> Iterator:
        for w in weights[lo:hi]:
            if small:
                row, left = [0], 0
                for up, corner, v in zip(above[1:], above, w):
                    if up > left:
                        left = up
                    if v and corner + v > left:
                        left = corner + v
                    row.append(left)
            else:
                row = np.zeros(width + 1, np.int64)
                np.maximum.accumulate(np.maximum(above[1:], np.where(w > 0, above[:-1] + w, 0)), out=row[1:])
            yield row
            above = row

    above = [0] * (width + 1) if small else np.zeros(width + 1, np.int64)
    kept = [above]
    if not small:
        for n, row in enumerate(fill(above, 0, len(weights)), 1):
            if n % step == 0:
                kept.append(row)
    for k in range(len(kept) - 1, -1, -1):
        rows = [kept[k], *fill(kept[k], k * step, min(len(weights), (k + 1) * step))]
        rows = rows[:step]
        for n in range(len(rows) - 1, -1, -1):
            yield k * step + n, rows[n]


def align(xs: list[Node], ys: list[Node]) -> tuple[int, list[tuple[int, int]]]:
    """Most nodes that order-preserving pairs of these siblings match, and the pairs (indices)."""
    common = {p.label for p in xs} & {q.label for q in ys}
    if not common:
        return 0, []
    # siblings without a partner of their label are in no pair
    mine, others = [i for i, p in enumerate(xs) if p.label in common], [j for j, q in enumerate(ys) if q.label in common]
    xs, ys = [xs[i] for i in mine], [ys[j] for j in others]
    if not {p.label for p in xs if p.kids} & {q.label for q in ys if q.kids}:
        # every pair counts one: the longest common subsequence of labels, with the table's choice among equals
        pairs = [(mine[i], others[j]) for j, i in common_labels(ys, xs)]
        return len(pairs), pairs
    by_shape: dict[int, list] = {}
    large = len(xs) * len(ys) > TABLE_CELLS
    for p in xs:
        if p.shape not in by_shape:
            w = [0 if p.label != q.label else p.count if p.shape == q.shape else _MATCHED[p.shape, q.shape][0] if p.kids and q.kids else 1 for q in ys]
            by_shape[p.shape] = np.array(w, np.int64) if large else w
    rows = _table([by_shape[p.shape] for p in xs], len(ys))
    pairs, j = [], len(ys)
    i, row = next(rows)
    total = int(row[j])
    for above_i, above in rows:
        # in row i: up while the value stays, else left while it stays, else a pair
        if row[j] != above[j]:
            while row[j] == row[j - 1]:
                j -= 1
                if row[j] == above[j]:
                    break
            else:
                j -= 1
                pairs.append((mine[i - 1], others[j]))
        i, row = above_i, above
        if not j:
            break
    return total, pairs[::-1]


def _match_shapes(a: Node, b: Node) -> None:
    """Fills ``_MATCHED`` for the pair and all pairs of shapes that it asks for, children first."""
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        if x.shape == y.shape or (x.shape, y.shape) in _MATCHED:
            todo.pop()
            continue
        ps, qs = ({k.shape: k for k in n.kids if k.kids}.values() for n in (x, y))
        first = [(p, q) for p in ps for q in qs if p.label == q.label and p.shape != q.shape and (p.shape, q.shape) not in _MATCHED]
        if first:
            todo.extend(first)
            continue
        n, pairs = align(x.kids, y.kids)
        _MATCHED.keep((x.shape, y.shape), (1 + n, pairs), 1 + len(pairs))
        todo.pop()


def match_places(a: Node, b: Node) -> list[tuple[int, int]]:
    """Places, in page order, of the pairs of simple tree matching; both trees have their shapes marked."""
    if a.label != b.label:
        return []
    key = (a.shape, b.shape)
    if key in _PLACES:
        return _PLACES[key]
    _match_shapes(a, b)
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        if x.shape == y.shape:
            out.extend(zip(range(x.at, x.at + x.count), range(y.at, y.at + y.count)))
            continue
        out.append((x.at, y.at))
        if x.kids and y.kids:
            todo.extend((x.kids[i], y.kids[j]) for i, j in _MATCHED[x.shape, y.shape][1])
    return _PLACES.keep(key, out, len(out))


def match_trees(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of simple tree matching: roots match by label, children in order, the largest set."""
    xs, ys = mark_shapes(a), mark_shapes(b)
    return [(xs[i], ys[j]) for i, j in match_places(a, b)]


def text_hash(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text) & MASK


def varying_sizes(root: Node, fixed: set[int]) -> dict[int, int]:
    """id(node) -> characters of its subtree outside links, never-parts and the nodes in ``fixed`` (by id)."""
    out: dict[int, int] = {}
    for node in reversed(in_order(root)):
        if node.never:
            out[id(node)] = 0
        else:
            mine = 0 if id(node) in fixed or node.tag == "a" else len(own_text(node))
            out[id(node)] = mine + sum(out[id(k)] for k in node.kids)
    return out


def deepest_holder(root: Node, sizes: dict[int, int]) -> Node:
    """The deepest block that holds HOLDS of the page's text in ``sizes``."""
    node = best = root
    while True:
        node = next((k for k in node.kids if sizes[id(k)] >= HOLDS * sizes[id(root)]), None)
        if node is None:
            return best
        if node.tag in BLOCK and node.tag not in HEADINGS and node.tag != "p":
            best = node


def _is_template(node: Node, template: set[tuple[int, int]]) -> bool:
    """Whether the node's text is template at its path or, if long, at any (path 0)."""
    text = text_hash(own_text(node))
    return (node.path, text) in template or len(node.own) >= LONG and (0, text) in template


def content_nodes(root: Node, path: int | None, template: set[tuple[int, int]]) -> tuple[list[Node], set[int]]:
    """Nodes to read, in page order, and the ids of the page's template nodes."""
    nodes = in_order(root)
    fixed = {id(n) for n in nodes if n.tag in BLOCK and not n.never and own_text(n) and _is_template(n, template)} if template else set()
    if fixed and 2 * sum(n.size for n in nodes if id(n) in fixed) > root.size:
        fixed = set()  # a page of which most is "template" is a copy of others
    sizes = varying_sizes(root, fixed)
    total = sizes[id(root)]
    chosen = [n for n in nodes if n.path == path and sizes[id(n)]] if path is not None else []
    if sum(sizes[id(n)] for n in chosen) < HOLDS * total or not total:
        chosen = [deepest_holder(root, sizes)]
    picked = {id(n) for n in chosen}
    for node in nodes:
        if not node.never and any(id(k) in picked for k in node.kids):
            inner = node.tag not in ("", "html", "body")
            picked.update(id(k) for k in node.kids if not k.never and sizes[id(k)] and (inner or k.tag in HEADINGS or k.tag == "p"))
        elif node.tag == "h1" and sizes[id(node)]:
            picked.add(id(node))
    return [n for n in nodes if id(n) in picked], fixed


def read_text(root: Node, path: int | None = None, template: set[tuple[int, int]] = frozenset()) -> str:
    """Main text of a page, block by block in page order."""
    chosen, fixed = content_nodes(root, path, template)
    wanted = {id(n) for n in chosen}
    blocks: list[str] = []
    line: list[str] = []

    def close() -> None:
        text = "".join(line)
        text = " ".join((entities.unescape(text) if "&" in text else text).split())
        if text:
            blocks.append(text)
        line.clear()

    todo: list = [(root, False)]
    while todo:
        item, inside = todo.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            line.append(item)
        elif item.never or id(item) in fixed:
            line.append(" ")
        else:
            inside = inside or id(item) in wanted
            block = item.tag in BLOCK
            if block:
                close()
                todo.append((None, False))
            elif item.tag == "br":
                line.append(" ")
            todo.extend((k, inside) for k in reversed(item.children if inside else item.kids))
    close()
    return "\n\n".join(blocks)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


#: Sizes up to which a table of references or wrappers is sent to all tasks; larger ones are joined by (host, salt).
SENT_BYTES = 24 << 20


def _by_host(pages: DataFrame, table: DataFrame, size: int) -> DataFrame:
    """``pages`` with the columns of ``table`` (one row per host): sent whole if ``size`` bytes are few, else
    salted, so that a host with a third of all pages is dealt to SALTS parts."""
    if size <= SENT_BYTES:
        return pages.join(F.broadcast(table), "host", "left")
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("html"), F.lit(SALTS)), F.lit(0)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")


def _references(pages: DataFrame) -> DataFrame:
    """host, references: up to REFERENCES pages per host, those of least hash, by aggregates of constant size."""
    ranked = pages.filter(F.length("html") > 0).select("host", "html", F.xxhash64("html").alias("r"))
    first = ranked.groupBy("host").agg(F.min("r").alias("r"))
    picks = first
    for _ in range(REFERENCES - 1):
        last = _by_host(ranked.select("host", "r", "html"), first.withColumnRenamed("r", "_r"), 0 if first.count() < 100_000 else SENT_BYTES + 1)
        first = last.filter("r > _r").groupBy("host").agg(F.min("r").alias("r"))
        picks = picks.unionByName(first)
    picks = materialize(picks, "reference-hashes")
    small = picks.count() < 200_000
    met = ranked.join(F.broadcast(picks) if small else picks, ["host", "r"], "left_semi")
    return materialize(met.groupBy("host", "r").agg(F.min("html").alias("reference")).groupBy("host").agg(F.collect_list("reference").alias("references")), "references")


FIGURES = "host string, reference long, node int, path long, text long, depth int, first long, second long"


_REFERENCES = Memory()


def parse_reference(page: str) -> tuple[Node, list[tuple[str, tuple | None] | None]]:
    """The tree, and per node its own text, with the key of its figures if it is a block; a worker meets the same few pages again and again."""
    if page in _REFERENCES:
        return _REFERENCES[page]
    tree, name = parse(page), text_hash(page)
    slots = [None if y.never or not own_text(y) else (y.own, (name, k, y.path, text_hash(y.own), y.depth) if y.tag in BLOCK else None)
             for k, y in enumerate(mark_shapes(tree))]
    return _REFERENCES.keep(page, (tree, slots), len(page) // 4)


def page_figures(page: str, references: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """((reference, node, path, text, depth), first, second): for each aligned node of a reference, pages that
    have it and pages that keep its text; for each block path (reference 0), varying characters and 0."""
    for memory in (_SHAPES, _MATCHED, _PLACES, _REFERENCES):
        memory.tidy()
    tree = parse(page)
    nodes = mark_shapes(tree)
    fixed: set[int] = set()
    for reference in references:
        if reference == page:
            continue
        other, slots = parse_reference(reference)
        for i, j in match_places(tree, other):
            if slots[j] is None:
                continue
            text, key = slots[j]
            same = own_text(nodes[i]) == text
            if same:
                fixed.add(id(nodes[i]))
            if key:
                yield key, 1, int(same)
    sizes = varying_sizes(tree, fixed)
    sums: dict[tuple[int, int], int] = {}
    for node in nodes:
        if sizes[id(node)] and (node.tag in BLOCK and node.tag not in HEADINGS and node.tag != "p" or node is tree):
            sums[(node.path, node.depth)] = sums.get((node.path, node.depth), 0) + sizes[id(node)]
    for (path, depth), n in sums.items():
        yield (0, 0, path, 0, depth), n, 0


def induce(pages: DataFrame) -> DataFrame:
    """host, content (path), template (array of path and text hash) from all pages (columns host, html)."""
    references = _references(pages)
    size = references.agg(F.sum(F.aggregate("references", F.lit(0).cast("long"), lambda n, x: n + F.length(x)))).first()[0] or 0
    joined = _by_host(pages.filter("html is not null"), references, size).filter("references is not null")

    def make():
        def step(part: dict[str, list]) -> dict[str, list]:
            sums: dict[tuple, list[int]] = {}
            for host, page, references in zip(part["host"], part["html"], part["references"]):
                for key, first, second in page_figures(page, references):
                    have = sums.setdefault((host, *key), [0, 0])
                    have[0] += first
                    have[1] += second
            rows = [(*k, *v) for k, v in sums.items()]
            return dict(zip((c.split()[0] for c in FIGURES.split(", ")), map(list, zip(*rows)) if rows else [[]] * 8))

        return step

    figures = map_lists(joined.select("host", "html", "references"), make, FIGURES, 512)
    summed = materialize(figures.groupBy("host", "reference", "node", "path", "text", "depth").agg(
        F.sum("first").alias("first"), F.sum("second").alias("second")), "slots")
    template = summed.filter((F.col("reference") != 0) & (F.col("second") >= LEAST_ALIGNED) & (F.col("second") >= CONSTANT * F.col("first"))).groupBy("host").agg(
        F.collect_set(F.struct("path", "text")).alias("template"))
    varying = summed.filter("reference = 0")
    total = varying.filter("depth = 0").select("host", F.col("first").alias("total"))
    content = varying.join(total, "host").filter(F.col("first") >= HOLDS * F.col("total")).groupBy("host").agg(
        F.max(F.struct("depth", "first", "path"))["path"].alias("content"))
    return content.join(template, "host", "full")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text for every page."""
    named = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    wrappers = materialize(induce(named.select("host", "html")), "wrappers")
    size = wrappers.agg(F.sum(F.lit(64) + 16 * F.coalesce(F.size("template"), F.lit(0)).cast("long"))).first()[0] or 0
    joined = _by_host(named, wrappers, size)
    kind = dict(pages.dtypes)["page_id"]

    def make():
        def step(part: dict[str, list]) -> dict[str, list]:
            texts = [read_text(parse(page), content, {x for t in template or () for x in ((t["path"], t["text"]), (0, t["text"]))}) if page else ""
                     for page, content, template in zip(part["html"], part["content"], part["template"])]
            return {"page_id": part["page_id"], "url": part["url"], "text": texts}

        return step

    return map_lists(joined.select("page_id", "url", "html", "content", "template"), make, f"page_id {kind}, url string, text string")
