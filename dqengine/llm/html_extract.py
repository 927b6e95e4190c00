"""HTML extraction by wrapper induction.

Pages of one host and layout (the upper tag tree) share a template. One page with text of each layout that at least ``least``
different pages have stands as its exemplar; pages of rarer layouts go with the host's most frequent one. Every page's DOM tree
is aligned with its exemplar by simple tree matching (the largest order-preserving match of equal tags from the root down). An
exemplar node whose text is the same in most different pages of the layout is template, a node whose text varies is a content
slot. The votes come from all pages, each different page counted once.

Landmarks are a prior: nothing inside menus, headers and footers of the page, sidebars, forms, notices, adverts, comments and
the like is content. Votes decide the rest. Where a page marks its article (article, main), text inside is content unless its
node is template and most of the article's characters stand in other nodes (else all pages share the article, or some are near
copies of each other); text outside is content only in a slot: a node that most different pages have and that varies in most of
those. Where a page marks none, the text outside template nodes is content.

Class names are read in two ways. Some say what a text is (advert, reader comment, cookie banner, sidebar): such elements are
dropped like the landmarks. Others are everyday words too (related, share, notice, search, widget: ``DOUBTFUL``): block elements
of such a name only carry a mark, and votes decide. Inside an article a marked block is content unless its node is template;
where no article is marked, only in a slot; outside a marked article never. The prior drops it where there are no votes
(fewer than ``least`` different pages of the layout) or where they aren't trusted, where most of its characters are links, and
where the element is inline (a label or button).

A null or empty page has empty text. A page without host belongs to the host "". Pages are parsed whole; repeated rows give
repeated results, each different page votes once; an empty table gives no rows; other columns are not read, so their names can't
clash. Of pages or layouts that tie as exemplars the one of least hash stands. Child lists are matched exactly at any length and depth; long ones by divide and
conquer, in memory that grows with their length and the square of their different shapes only.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine.llm.common import materialize, table, text_slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head script style noscript template textarea title nav footer aside form dialog menu select option button iframe object svg math canvas audio video noembed noframes datalist".split())
MAIN = frozenset(("article", "main"))
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo nav navbar breadcrumb breadcrumbs pagination pager sidebar "
    "comment comments disqus cookie cookies consent gdpr popup modal newsletter subscribe signup login footer masthead topbar toolbar".split()
)
"""Words of class names and ids that say what a text is."""
DOUBTFUL = frozenset("alert aside banner menu navigation notice notices overlay promotion recommended related replies respond search share sharing skip social widget".split())
"""Words that may as well name a part of an article."""
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
"""Roles that stand for the elements in ``DROPPED``; the role alert marks like a doubtful word."""
CLOSES = {
    **{t: ("p",) for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()},
    "li": ("li", "p"),
    "dt": ("dt", "dd", "p"),
    "dd": ("dt", "dd", "p"),
    "tr": ("tr", "td", "th", "p"),
    "td": ("td", "th", "p"),
    "th": ("td", "th", "p"),
    "option": ("option",),
}
SCOPES = frozenset("html body article main section div nav aside footer header form table td th ul ol dl blockquote figure".split())
CELLS = 250_000
"""Cells of one alignment of two child lists that are held at once; larger ones are divided."""
UPPER = 3
"""Levels of the tag tree that tell layouts apart: html, body and what lies in it."""
SHARE = 0.5
PAGES = 3
BROADCAST_BYTES = 64 << 20

_NAME = r"(/?)([a-zA-Z][^\s/>]*+)"
_TAG = re.compile(rf"""<(?:!--(?:.*?--!?>|.*)|{_NAME}((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|{_NAME}([^>]*+)>|[!?/][^>]*+>)""", re.S)
"""Comment, tag, tag with unbalanced quotes or a stray "<", declaration. A "<" outside quotes ends the second form, so that at
most one scan for each kind of quote can be open at any place."""
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|$)", re.I) for t in RAW}
_TOKEN = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "children", "index", "shape", "size")

    def __init__(self, tag: str, index: int):
        self.tag, self.index, self.children, self.shape, self.size = tag, index, [], 0, 1


def _judged(tag: str, attributes: str, inside_main: bool) -> tuple[bool, bool]:
    """Whether an element is dropped, and whether its name is doubtful."""
    if tag in DROPPED or (tag == "header" and not inside_main):
        return True, False
    doubtful = False
    if attributes and tag not in MAIN and tag not in ("html", "body"):
        for m in _ATTR.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if name in ("class", "id"):
                words = _TOKEN.findall(value)
                if not HINTS.isdisjoint(words):
                    return True, False
                doubtful = doubtful or not DOUBTFUL.isdisjoint(words)
            elif (name == "role" and value in ROLES) or (name == "hidden") or (name == "aria-hidden" and value == "true"):
                return True, False
            elif name == "role" and value == "alert":
                doubtful = True
    return doubtful and tag in INLINE, doubtful


class _Open:
    """The open elements, with the places of each tag and of the scopes, so that no end tag walks the stack."""

    def __init__(self, root: Node):
        self.stack = [(root, False, False, False, False)]  # node, dropped, inside main, doubtful, inside a link
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def push(self, node: Node, *state: bool) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append((node, *state))

    def close(self, tag: str, within_scope: bool) -> None:
        """Closes the innermost element of the tag and all inside it, unless a scope lies between."""
        found = self.places.get(tag)
        if not found or (within_scope and self.scopes and self.scopes[-1] > found[-1]):
            return
        for _ in range(len(self.stack) - found[-1]):
            node = self.stack.pop()[0]
            self.places[node.tag].pop()
            if node.tag in SCOPES:
                self.scopes.pop()


Block = tuple[str, int, bool, bool]
"""Text, index of the node it began in, inside main?, doubtful?"""


def parse(page: str) -> tuple[Node, list[Block]]:
    """The tree of elements, and the blocks outside dropped elements. Takes time in proportion to the page's length."""
    root = Node("", 0)
    nodes = 1
    elements = _Open(root)
    blocks: list[Block] = []
    parts: list[str] = []
    owner = [0, False, False]
    linked = 0

    def text(value: str) -> None:
        nonlocal linked
        node, dropped, main, doubtful, link = elements.stack[-1]
        if value and not value.isspace():
            if not dropped:
                if not parts:
                    owner[:] = node.index, main, doubtful
                parts.append(value)
                linked += len(value) * link
                return
        if parts and not dropped:
            parts.append(value)

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            line = " ".join(html.unescape(raw).split())
            if line and not (owner[2] and linked * 2 > len(raw)):
                blocks.append((line, owner[0], owner[1], owner[2]))
            parts.clear()
            linked = 0

    at, n = 0, len(page)
    last = page.rfind(">") + 1  # no tag ends behind it
    while at < n:
        m = _TAG.search(page, at, last) if at < last else None
        if m is None:
            rest = page.find("<!--", at)
            text(page[at : rest if rest >= 0 else n])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        end_tag, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            if page.startswith("<!--", m.start()) and not m[0].endswith(("-->", "--!>")):
                break
            continue
        tag = name.lower()
        if tag not in INLINE:
            flush()
        if end_tag:
            elements.close(tag, tag in INLINE)
            continue
        for other in CLOSES.get(tag, ()):
            elements.close(other, True)
        parent, dropped, main, doubtful, link = elements.stack[-1]
        node = Node(tag, nodes)
        nodes += 1
        parent.children.append(node)
        if tag in VOID:
            continue
        drop, doubt = _judged(tag, attributes, main)
        own = dropped or drop
        if own and tag in INLINE:
            flush()
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.start() if end else n
            if not own:
                text(page[m.end() : at])
        elif not attributes.endswith("/") or tag not in ("svg", "math"):
            elements.push(node, own, main or tag in MAIN, doubtful or doubt, link or tag == "a")
    flush()
    return root, blocks


def measure(root: Node) -> Node:
    """Sets size and shape (a hash of the tags below) of every node."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(node.children)
    for node in reversed(order):
        node.size = 1 + sum(c.size for c in node.children)
        node.shape = hash((node.tag, *(c.shape for c in node.children)))
    return root


def layout(root: Node) -> int:
    """A hash of the upper tag tree, runs of equal neighbours taken as one."""

    def upper(node: Node, levels: int) -> str:
        below = [upper(c, levels - 1) for c in node.children] if levels else []
        return f"{node.tag}({','.join(x for x, y in zip(below, [None, *below]) if x != y)})"

    return xxhash.xxh64_intdigest(upper(root, UPPER)) - (1 << 63)


def _path(weight: list[list[int]]) -> list[tuple[int, int]]:
    """The places of the heaviest order-preserving match, from a table of weights."""
    best = [[0] * (len(weight[0]) + 1)]
    for line in weight:
        row, above = [0], best[-1]
        for j, w in enumerate(line):
            row.append(max(row[j], above[j + 1], above[j] + w))
        best.append(row)
    i, j, found = len(weight), len(weight[0]), []
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append((i, j))
    return found


def _divided(weight: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """The same for long lists of shape numbers x and y: halves of x are matched with the parts of y that serve both best."""

    def last_row(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        row = np.zeros(len(v) + 1, np.int64)
        for i in u:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weight[i, v]))
        return row

    found, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if b - a == 1 or (b - a) * (d - c) <= CELLS:
            found += [(a + i, c + j) for i, j in _path(weight[np.ix_(x[a:b], y[c:d])].tolist())]
            continue
        m = (a + b) // 2
        k = int(np.argmax(last_row(x[a:m], y[c:d]) + last_row(x[m:b][::-1], y[c:d][::-1])[::-1]))
        todo += [(a, m, c, c + k), (m, b, c + k, d)]
    return found


def matches(x: list[Node], y: list[Node], memo: dict[tuple[int, int], int]) -> list[tuple[Node, Node]]:
    """The heaviest order-preserving match of two child lists."""
    low, p, q = 0, len(x), len(y)
    found: list[tuple[Node, Node]] = []
    while low < p and low < q and x[low].shape == y[low].shape:
        found.append((x[low], y[low]))
        low += 1
    while p > low and q > low and x[p - 1].shape == y[q - 1].shape:
        p, q = p - 1, q - 1
        found.append((x[p], y[q]))
    x, y = x[low:p], y[low:q]
    if x and y and len(x) * len(y) > CELLS:
        one, two = {u.shape: u for u in x}, {v.shape: v for v in y}
        weight = np.array([[size_of(u, v, memo) if u.tag == v.tag else 0 for v in two.values()] for u in one.values()], np.int64)
        at, to = {h: i for i, h in enumerate(one)}, {h: i for i, h in enumerate(two)}
        places = _divided(weight, np.array([at[u.shape] for u in x]), np.array([to[v.shape] for v in y]))
    elif x and y:
        places = _path([[size_of(u, v, memo) if u.tag == v.tag else 0 for v in y] for u in x])
    else:
        places = []
    return found + [(x[i], y[j]) for i, j in places]


def size_of(a: Node, b: Node, memo: dict[tuple[int, int], int]) -> int:
    """The size of the largest match of two trees with equal root tags; memo holds those of different shapes."""
    if a.shape == b.shape:
        return a.size
    if not a.children or not b.children:
        return 1
    size = memo.get((a.shape, b.shape))
    if size is None:
        size = 1
        for u, v in matches(a.children, b.children, memo):
            size += size_of(u, v, memo)
        memo[a.shape, b.shape] = size
    return size


def align(a: Node, b: Node, pairs: list[tuple[Node, Node]] | None = None) -> int:
    """Simple tree matching of two trees with equal root tags: the size of the largest match; pairs gets its node pairs."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000 + 4 * min(a.size, b.size)))  # size_of and matches go as deep as both trees
    memo: dict[tuple[int, int], int] = {}
    todo = [(a, b)] if pairs is not None else []
    while todo:
        u, v = todo.pop()
        pairs.append((u, v))
        todo += zip(u.children, v.children) if u.shape == v.shape else matches(u.children, v.children, memo)
    return size_of(a, b, memo)


def node_lines(blocks: list[Block]) -> dict[int, list[str]]:
    """The texts of the blocks that begin in each node."""
    lines: dict[int, list[str]] = {}
    for text, i, *_ in blocks:
        lines.setdefault(i, []).append(text)
    return lines


def aligned(page: str, exemplar: tuple[Node, dict[int, list[str]]]) -> tuple[list[dict], list[int], list[int]]:
    """The page's blocks with the exemplar node each belongs to (-1: none), and the exemplar nodes with equal and with other
    text. A node's text is that of the blocks that begin in it, their inline elements included."""
    root, blocks = parse(page)
    tree, lines = exemplar
    pairs: list[tuple[Node, Node]] = []
    align(measure(root), tree, pairs)
    to = {a.index: b.index for a, b in pairs}
    same, other = [], []
    for i, own in node_lines(blocks).items():
        if i in to:
            (same if lines.get(to[i]) == own else other).append(to[i])
    return [{"text": t, "node": to.get(i, -1), "main": m, "doubtful": d} for t, i, m, d in blocks], same, other


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = SHARE, least: int = PAGES) -> DataFrame:
    """(id, url, text, blocks, path) of every page; blocks keeps each block's text, exemplar node and whether it lies in main and has a
    doubtful name; path names what decided: votes (no article marked), both, or landmarks (article shared by most pages)."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host.alias("_host"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    laid_schema = T.StructType([*base.schema.fields]).add("_layout", "long").add("_full", "boolean")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "_html", 4 << 20):
            trees = [parse(page) for page in part.column("_html").to_pylist()]
            more = [pa.array([layout(root) for root, _ in trees], pa.int64()), pa.array([bool(blocks) for _, blocks in trees], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], laid_schema.names)

    laid = base.mapInArrow(lay, laid_schema)
    keys = materialize(laid.where("_full").select("_host", "_layout", F.xxhash64("_html").alias("_sign")).distinct(), "html-layouts")
    layouts = keys.groupBy("_host", "_layout").agg(F.count("*").alias("_n"), F.min("_sign").alias("_sign"))
    first = layouts.groupBy("_host").agg(F.max(F.struct("_n", "_layout"))["_layout"].alias("_first"))
    kept = layouts.join(first, "_host").withColumn("_is_first", F.col("_layout") == F.col("_first")).where(F.col("_is_first") | (F.col("_n") >= least))
    kept = materialize(kept, "html-chosen")  # of known size, so that few of them are broadcast and pages are not shuffled
    chosen = base.select("_host", "_html", F.xxhash64("_html").alias("_sign")).join(kept, ["_host", "_sign"])
    exemplars = materialize(chosen.groupBy("_host", "_layout").agg(F.min("_html").alias("_exemplar"), F.max("_is_first").alias("_is_first")), "html-exemplars")
    bound = exemplars.agg(F.coalesce(F.sum(F.length("_exemplar") + F.length("_host")), F.lit(0))).first()[0]
    few = F.broadcast if bound * 4 <= BROADCAST_BYTES else lambda df: df
    own = exemplars.select("_host", "_layout", F.col("_layout").alias("_own"), F.col("_exemplar").alias("_own_exemplar"))
    common = exemplars.where("_is_first").select("_host", F.col("_layout").alias("_common"), F.col("_exemplar").alias("_common_exemplar"))
    dealt = laid.join(few(own), ["_host", "_layout"], "left").join(few(common), "_host", "left")
    use, exemplar = F.coalesce("_own", "_common", F.lit(0)).alias("_use"), F.coalesce("_own_exemplar", "_common_exemplar", F.lit("")).alias("_exemplar")
    schema = T.StructType.fromDDL("_host string, _use long, _blocks array<struct<text string, node int, main boolean, doubtful boolean>>, _same array<int>, _other array<int>, _sig long")
    schema = T.StructType([pages.schema[id_col], pages.schema[url_col], *schema.fields])
    kind = pa.list_(pa.struct([("text", pa.string()), ("node", pa.int32()), ("main", pa.bool_()), ("doubtful", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[tuple[str, int], tuple[Node, dict[int, list[str]]]] = {}
        for part in text_slices(batches, "_html", 4 << 20):
            found, signs = [], []
            for name, page, exemplar in zip(zip(part.column("_host").to_pylist(), part.column("_use").to_pylist()), part.column("_html").to_pylist(), part.column("_exemplar").to_pylist()):
                if name not in trees:
                    if len(trees) >= 200:
                        trees.clear()
                    root, blocks = parse(exemplar)
                    trees[name] = measure(root), node_lines(blocks)
                found.append(aligned(page, trees[name]))
                signs.append(xxhash.xxh64_intdigest(page) - (1 << 63))
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), part.column("_url"), part.column("_host"), part.column("_use"), pa.array([f[0] for f in found], kind), *(pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in (1, 2)), pa.array(signs, pa.int64())], schema.names
            )

    parsed = materialize(dealt.select("_id", "_url", "_host", use, "_html", exemplar).mapInArrow(run, schema), "html-blocks")
    different = parsed.groupBy("_host", "_use", "_sig").agg(F.first(F.struct("_same", "_other")).alias("_nodes"))
    counts = different.groupBy("_host", "_use").agg(F.count("*").alias("_pages"))
    cell = lambda equal: lambda i: F.struct(i.alias("_node"), F.lit(equal).alias("_equal"))
    cells = F.concat(F.transform("_nodes._same", cell(1)), F.transform("_nodes._other", cell(0)))
    votes = different.select("_host", "_use", F.inline(cells)).groupBy("_host", "_use", "_node").agg(F.count("*").alias("_seen"), F.sum("_equal").alias("_votes"))
    most = lambda c: F.col(c) > F.col("_pages") * share
    constant = F.when(most("_votes"), F.col("_node"))
    varied = F.when(most("_seen") & (F.col("_votes") <= F.col("_seen") * (1 - share)), F.col("_node"))
    voted = votes.join(counts, ["_host", "_use"]).where(F.col("_pages") >= least).groupBy("_host", "_use").agg(F.collect_set(constant).alias("_template"), F.collect_set(varied).alias("_slots"))
    template = materialize(voted, "html-template")
    few = F.broadcast if bound * 4 <= BROADCAST_BYTES else lambda df: df  # a layout's votes name no more nodes than its exemplar has
    whole = parsed.join(few(template), ["_host", "_use"], "left")
    among = lambda c, b: F.coalesce(F.array_contains(F.col(c), b["node"]), F.lit(False))
    chars = lambda keep: F.aggregate(F.filter("_blocks", keep), F.lit(0).cast("long"), lambda n, b: n + F.length(b["text"]))
    in_main = F.exists("_blocks", lambda b: b["main"])
    trust = chars(lambda b: b["main"] & among("_template", b)) * 2 < chars(lambda b: b["main"])
    whole = whole.withColumn("_path", F.when(in_main, F.when(trust, "both").otherwise("landmarks")).otherwise("votes"))
    plain = lambda b: F.when(F.col("_path") == "votes", ~among("_template", b)).when(b["main"], (F.col("_path") == "landmarks") | ~among("_template", b)).otherwise(among("_slots", b))
    marked = lambda b: F.when(F.col("_template").isNull() | (F.col("_path") == "landmarks"), False).when(F.col("_path") == "votes", among("_slots", b)).otherwise(b["main"] & ~among("_template", b))
    content = F.filter("_blocks", lambda b: F.when(b["doubtful"], marked(b)).otherwise(plain(b)))
    return whole.select(F.col(id_col), F.col(url_col), F.array_join(F.transform(content, lambda b: b["text"]), " ").alias("text"), F.col("_blocks").alias("blocks"), F.col("_path").alias("path"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the main text of every page."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
