"""Main text of web pages by wrapper induction over the pages of a host.

The pages of a host fall into layouts, by the outer structure of their elements. Each layout of a few pages or more has
a reference page; rarer ones take that of their host's largest. The DOM tree of every page is aligned with its reference's
by simple tree matching, so that text blocks get the slot of the reference block they match; blocks that match none have
their path of tags as slot. A slot whose text is the same on nearly all distinct pages that have it (at least a fifth of
the layout's) is template and is dropped; varying slots are content. Where a page marks its article or main element,
content comes from there, and nothing in it is dropped for its name. Menus, headers, footers, sidebars, notices, adverts,
forms and comments vary from page to page on many hosts, so outside such an element they are told by tag, role and class;
class names are a hint only, and are not heeded where nothing would be left or where the element holds most of the page's
text (comments excepted). Counts run over all pages and are combined before they are shuffled.

On pages whose tags say it all, as those of the test tables do, the wrapper finds nothing more to drop; it works on
unmarked notices, boxes inside articles and menus that are the same on a layout's pages. Unmarked menus that vary stay.

Edge cases: null and empty pages give an empty text; a null or malformed url is a host of its own kind (''); repeated
rows give repeated rows and count as one page of their host; an empty table gives an empty result; very long and very
deep pages are taken whole; further columns but the html pass through, and a column with an output's name is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import Stages, hot_join

#: A slot is template if one text holds it on so large a share of so many distinct pages.
CONSTANT_SHARE, CONSTANT_PAGES = 0.9, 5
#: ... where that many are the pages that have the slot (a layout of the host), at least this share of the layout's pages.
LAYOUT_SHARE = 0.2
#: Bytes of rows for each layout that may be broadcast; beyond it they are joined by a shuffle that deals hot layouts.
BROADCAST_BYTES = 8 << 20
#: Cells of an alignment's table that are kept at once; longer lists are halved, with the same result.
_TABLE_CELLS = 1 << 20
#: Reference trees that this worker keeps, and of how many characters of pages.
_trees: dict[str, "Node"] = {}
_TREE_CHARS = 2 << 20
#: Matched nodes of two shapes, known to this worker.
_known: dict[tuple[int, int], int] = {}

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_UNSEEN = frozenset("script style noscript template head title iframe object svg canvas select button textarea input datalist".split())
_ROLES = frozenset("nav header footer aside form menu dialog".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?\w*|consent|gdpr|notices?|alert|popup|modal|overlay|sidebar|side-bar|widget\w*"
    r"|comments?|respond|replies|disqus|share\w*|social|related|recommended|breadcrumbs?|menu|navbar|nav|navigation|pagination|newsletter|subscribe\w*"
    r"|signup|login|footer|header|masthead|skip\w*)(?:$|[\s_-])",
    re.I,
)
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|respond|replies|disqus)(?:$|[\s_-])", re.I)
#: Elements that make a layout, and how deep they are looked at.
_STRUCTURE = re.compile(r"<(/?)(div|section|main|article|nav|header|footer|aside|form|table)\b([^>]*)>", re.I)
_CLASS = re.compile(r"""\bclass\s*=\s*["']?([^"'>]*)""", re.I)
_LAYOUT_DEPTH = 3
_ARIA = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Open elements that a start tag closes, and the elements that end the search for them.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("article section div main body html table ul ol dl td th form aside nav header footer blockquote".split())
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "role", "children", "slot", "drop", "inside", "comments")

    def __init__(self, tag: str, role: str, inside: bool = False, comments: bool = False):
        self.tag, self.role, self.children, self.slot = tag, role, [], -1  # children: nodes and strings
        self.drop, self.inside, self.comments = role in ("unseen", "aside", "named"), inside or role == "main", comments


def _role(tag: str, attrs: dict[str, str | None], hints: bool = True) -> str:
    """What an element is for: 'unseen', 'aside' (never content), 'named' (aside by its name only), 'main' or ''."""
    if tag in _UNSEEN or "hidden" in attrs:
        return "unseen"
    told = (attrs.get("role") or "").lower()
    if tag in _ROLES or told in _ARIA:
        return "aside"
    if hints and tag not in ("html", "body", "article", "main") and _NAMES.search(_names(attrs)):
        return "named"
    return "main" if tag in ("article", "main") or told in ("main", "article") else ""


def _names(attrs: dict[str, str | None]) -> str:
    return f"{attrs.get('class') or ''} {attrs.get('id') or ''}"


class _Builder(HTMLParser):
    def __init__(self, hints: bool):
        super().__init__(convert_charrefs=True)
        self.hints, self.named = hints, False
        self.root = Node("#root", "")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self._close({"p"}, _SCOPE)
        if tag in _CLOSES:
            self._close(_CLOSES[tag], _SCOPE - {"td", "th"} if tag == "tr" else _SCOPE - _CLOSES[tag])
        told, parent = dict(attrs), self.open[-1]
        role = _role(tag, told, self.hints and not parent.inside)
        node = Node(tag, role, parent.inside, role == "named" and bool(_COMMENTS.search(_names(told))))
        self.named |= role == "named"
        parent.children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in _VOID or len(self.open) < 2 or self.open[-1].tag != tag:
            return
        self.open.pop()

    def _close(self, tags, scope):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in scope:
                return

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str, hints: bool = True) -> Node:
    builder = _Builder(hints)
    builder.feed(html)
    builder.close()
    if builder.named and next(_mains(builder.root), None) is None:  # else content comes from the main element alone
        _unname(builder.root)
    return builder.root


def _unname(root: Node) -> None:
    """Named elements that hold most of the visible text aren't dropped for their name."""
    held, named, stack = {}, [], [(root, False)]
    while stack:
        node, done = stack.pop()
        if node.role in ("unseen", "aside"):
            held[id(node)] = 0
        elif done:
            held[id(node)] = sum(len(c.strip()) if isinstance(c, str) else held[id(c)] for c in node.children)
        else:
            if node.role == "named" and not node.comments:
                named.append(node)
            stack.append((node, True))
            stack.extend((c, False) for c in _elements(node))
    for node in named:
        node.drop = 2 * held[id(node)] <= held[id(root)]


def layout(html: str) -> int:
    """A hash of the outer elements of a page, outside its article: tags and classes without digits, runs of equal ones once."""
    depth, skip, seen = 0, 0, []
    for closing, tag, attrs in _STRUCTURE.findall(html):
        tag = tag.lower()
        if closing:
            depth = max(0, depth - 1)
            skip = 0 if depth < skip else skip
            continue
        depth += 1
        if depth <= _LAYOUT_DEPTH and not skip:
            told = _CLASS.search(attrs)
            what = (depth, tag, re.sub(r"\d+", "", told[1]) if told else "")
            if not seen or seen[-1] != what:
                seen.append(what)
        if tag in ("article", "main") and not skip:
            skip = depth
    return zlib.crc32(repr(seen).encode())


def _elements(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node)]


def number(root: Node) -> Node:
    """Give the nodes of a reference tree their slots, in page order."""
    stack, n = [root], 0
    while stack:
        node = stack.pop()
        node.slot, n = n, n + 1
        stack.extend(reversed(_elements(node)))
    return root


_SHAPES: dict[tuple, int] = {}


def _shape(root: Node) -> dict[int, tuple[int, int]]:
    """(shape, number of elements) of each element by its id; equal subtrees of tags and roles have one shape."""
    out, stack = {}, [(root, False)]
    while stack:
        node, done = stack.pop()
        if not done:
            stack.append((node, True))
            stack.extend((c, False) for c in _elements(node))
        else:
            below = [out[id(c)] for c in _elements(node)]
            key = (node.tag, node.role, *(s for s, _ in below))
            out[id(node)] = (_SHAPES.setdefault(key, len(_SHAPES)), 1 + sum(n for _, n in below))
    return out


def align(left: list[int], right: list[int], gain) -> list[tuple[int, int]]:
    """The order-preserving pairs (i, j) of most gain, with `gain(x, y)` for the shapes `left[i]` and `right[j]`.

    Equal heads and tails pair up (no other choice gains more). The rest is one table of gains, or, where the table would
    be large, two halves that meet at the column of most gain, so that memory grows with the length and not its square.
    """
    pairs, todo = [], [(0, len(left), 0, len(right))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and left[a] == right[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and left[b - 1] == right[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        kinds, which = np.unique(np.array(right[c:d]), return_inverse=True)
        memo = {x: np.array([gain(x, y) for y in kinds.tolist()], np.int64)[which] for x in set(left[a:b])}

        def rows(order: list[int], flip: bool, keep: bool, memo=memo, width=d - c):
            row, table = np.zeros(width + 1, np.int64), []
            for i in order:
                g = memo[left[i]][::-1] if flip else memo[left[i]]
                new = np.maximum(row[1:], row[:-1] + g)
                row = np.concatenate([[0], np.maximum.accumulate(new)])
                table.append(row) if keep else None
            return table if keep else row

        if (b - a) * (d - c) > _TABLE_CELLS and b - a > 1:
            mid = (a + b) // 2
            cut = c + int(np.argmax(rows(range(a, mid), False, False) + rows(range(b - 1, mid - 1, -1), True, False)[::-1]))
            todo += [(a, mid, c, cut), (mid, b, cut, d)]
            continue
        table = [np.zeros(d - c + 1, np.int64), *rows(range(a, b), False, True)]
        i, j = b - a, d - c
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((a + i, c + j))
    return sorted(pairs)


def match(page: Node, reference: Node) -> None:
    """Simple tree matching: the order-preserving alignment of two trees with the most matched nodes gives slots.

    Subtrees of equal shapes are matched once for all their occurrences; there is no limit to the number of children
    or to the depth.
    """
    if len(_SHAPES) > 1 << 18 or len(_known) > 1 << 20:
        _SHAPES.clear()
        _known.clear()
    shapes = _shape(page) | _shape(reference)
    kids: dict[int, list[int]] = {}
    size: dict[int, int] = {}
    head: dict[int, tuple[str, str]] = {}
    for root in (page, reference):
        stack = [root]
        while stack:
            node = stack.pop()
            shape, n = shapes[id(node)]
            if shape not in size:
                size[shape], head[shape], kids[shape] = n, (node.tag, node.role), [shapes[id(c)][0] for c in _elements(node)]
            stack.extend(_elements(node))

    def gain(x: int, y: int) -> int:
        if head[x] != head[y]:
            return 0
        return size[x] if x == y else _known[x, y]

    def settle(x: int, y: int) -> None:
        """Work out the matched nodes of two shapes, those of their children before."""
        stack = [(x, y)]
        while stack:
            u, v = stack[-1]
            if u == v or head[u] != head[v] or (u, v) in _known:
                stack.pop()
                continue
            open_ = [(p, q) for p in set(kids[u]) for q in set(kids[v]) if p != q and head[p] == head[q] and (p, q) not in _known]
            if open_:
                stack += open_
                continue
            stack.pop()
            _known[u, v] = 1 + sum(gain(kids[u][i], kids[v][j]) for i, j in align(kids[u], kids[v], gain))

    stack = [(page, reference)]
    while stack:
        a, b = stack.pop()
        a.slot = b.slot
        left, right = _elements(a), _elements(b)
        settle(shapes[id(a)][0], shapes[id(b)][0])
        for i, j in align([shapes[id(c)][0] for c in left], [shapes[id(c)][0] for c in right], gain):
            if (left[i].tag, left[i].role) == (right[j].tag, right[j].role):
                stack.append((left[i], right[j]))


def blocks(root: Node) -> list[tuple[int, str]]:
    """(slot, text) of the content blocks in page order: inline text runs together, block elements part it."""
    has_main = any(True for _ in _mains(root))
    out: list[tuple[int, str]] = []
    run: list[str] = []

    def flush(slot: int) -> None:
        text = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append((slot, text))

    # an explicit stack, as pages may nest deeply: (node, next child, inside the main element, hash of the path)
    stack = [[root, 0, not has_main, 0]]
    while stack:
        node, i, inside, path = stack[-1]
        if i >= len(node.children):
            if node.tag in _BLOCK:
                flush(_slot(node, path))
            stack.pop()
            continue
        stack[-1][1] += 1
        child = node.children[i]
        if isinstance(child, str):
            if inside:
                run.append(child)
        elif child.drop and not (child.tag == "header" and inside and has_main and _holds_heading(child)):
            run.append(" ")
        elif child.tag in ("br", "wbr", "img", "hr"):
            run.append("" if child.tag == "wbr" else " ")
        else:
            if child.tag in _BLOCK:
                flush(_block_slot(stack))
            stack.append([child, 0, inside or child.role == "main", zlib.crc32(child.tag.encode(), path)])
    flush(_slot(root, 0))
    return out


def _holds_heading(node: Node) -> bool:
    """A header element inside an article that holds its heading belongs to the article."""
    return any(c.tag in ("h1", "h2", "h3") for c in _elements(node))


def _slot(node: Node, path: int) -> int:
    """The slot of the reference that a node matches, or a negative one for its path of tags."""
    return node.slot if node.slot >= 0 else -1 - (path & 0x3FFFFFFF)


def _block_slot(stack: list) -> int:
    return next((_slot(n, path) for n, _, _, path in reversed(stack) if n.tag in _BLOCK), -1)


def _mains(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        if node.role == "main":
            yield node
        elif not node.drop:
            stack.extend(_elements(node))


def _reference(html: str) -> Node:
    """The numbered tree of a reference page; a worker keeps trees of `_TREE_CHARS` characters of pages at most."""
    if html not in _trees:
        if len(html) + sum(map(len, _trees)) > _TREE_CHARS:
            _trees.clear()
        _trees[html] = number(parse(html))
    return _trees[html]


def page_blocks(html: str, reference: str) -> list[dict]:
    if not html:
        return []
    root = parse(html)
    match(root, _reference(reference or html))
    found = blocks(root)
    if not found:  # names alone must not empty a page: they are a hint only
        root = parse(html, hints=False)
        match(root, _reference(reference or html))
        found = blocks(root)
    return [{"slot": slot, "hash": xxhash.xxh3_64_intdigest(text) - (1 << 63), "text": text} for slot, text in found]


_BLOCKS = T.ArrayType(T.StructType().add("slot", T.IntegerType()).add("hash", T.LongType()).add("text", T.StringType()))


@F.arrow_udf(_BLOCKS)
def _aligned(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("slot", pa.int32()), ("hash", pa.int64()), ("text", pa.string())]))
    for pages, references in columns:
        yield pa.array([page_blocks(p or "", r or "") for p, r in zip(pages.to_pylist(), references.to_pylist(), strict=True)], kind)


@F.arrow_udf(T.LongType())
def _layout(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in columns:
        yield pa.array([layout(p or "") for p in pages.to_pylist()], pa.int64())


def _host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def _joined(rows: DataFrame, single: DataFrame, key: list[str], size, counts: DataFrame, how: str = "inner") -> DataFrame:
    """`rows` with `single` (one row a key): broadcast while its bytes are few, else a shuffle that deals hot keys."""
    total = single.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return rows.join(F.broadcast(single), key, how) if total <= BROADCAST_BYTES else hot_join(rows, single, key, how, counts)


def extract(pages: DataFrame) -> DataFrame:
    """`pages` with text (content blocks, one a line) and n_chars."""
    stages = Stages(pages.sparkSession, "wrappers")
    rest = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), _host(F.col("url")).alias("host"), F.xxhash64("page_id", "url", "html").alias("pick"), html.alias("html"))
    rows = rows.withColumn("layout", _layout("html"))

    # layouts of enough pages have a reference of their own, others that of their host's largest layout
    width, both = F.octet_length("host") + 32, ["host", "wrapper"]
    layouts = stages.keep(rows.groupBy("host", "layout").agg(F.count("*").alias("n"), F.min("pick").alias("pick")))
    tops = stages.keep(layouts.groupBy("host").agg(F.max(F.struct("n", "layout", "pick")).alias("top")))
    told = _joined(layouts, tops, ["host"], width, layouts.groupBy("host").agg(F.count("*").alias("n")))
    own = F.col("n") >= CONSTANT_PAGES
    told = told.select("host", "layout", F.when(own, F.col("layout")).otherwise(F.col("top.layout")).alias("wrapper"), F.when(own, F.col("pick")).otherwise(F.col("top.pick")).alias("pick"), "n")
    told = stages.keep(told)
    sizes = told.groupBy(*both).agg(F.sum("n").alias("n"), F.first("pick").alias("pick"))
    picks = stages.keep(sizes)
    picked = _joined(rows.select("host", "pick", "html"), picks.drop("n"), ["host", "pick"], width, rows.groupBy("host", "pick").agg(F.count("*").alias("n")))
    references = stages.keep(picked.select(*both, F.col("html").alias("reference")).dropDuplicates(both))

    laid = _joined(rows, told.select("host", "layout", "wrapper"), ["host", "layout"], width, told)
    aligned = _joined(laid, references, both, F.octet_length("reference") + width, picks).withColumn("blocks", _aligned("html", "reference"))
    aligned = stages.keep(aligned.select("row", *both, "blocks"))
    stages.drop(layouts, tops, told, references)

    # texts of slots over the distinct pages of each layout
    facts = aligned.select(*both, F.xxhash64("blocks.hash").alias("page"), F.explode("blocks").alias("b"))
    seen = facts.groupBy(*both, "b.slot", "b.hash", "page").agg(F.lit(1).alias("one"))
    texts = seen.groupBy(*both, "slot", "hash").agg(F.count("*").alias("n")).where(f"n >= {CONSTANT_PAGES}")
    slots = facts.groupBy(*both, "b.slot", "page").agg(F.lit(1).alias("one")).groupBy(*both, "slot").agg(F.count("*").alias("having"))
    distinct = aligned.groupBy(*both, F.xxhash64("blocks.hash").alias("page")).agg(F.lit(1).alias("one")).groupBy(*both).agg(F.count("*").alias("pages"))
    constant = texts.join(slots, [*both, "slot"]).where(f"n >= {CONSTANT_SHARE} * having").join(distinct, both)
    constant = constant.where(f"having >= {LAYOUT_SHARE} * pages")
    # at most one text for each slot: slots are as many as a reference has nodes, and paths that a fifth of the pages have
    wrappers = stages.keep(constant.groupBy(*both).agg(F.collect_list(F.struct("slot", "hash")).alias("template")))
    out = _joined(aligned, wrappers, both, F.size("template") * 16 + width, picks, "left")
    template = lambda b: F.array_contains("template", F.struct(b.slot.alias("slot"), b.hash.alias("hash")))
    kept = F.when(F.col("template").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda b: ~template(b)))
    text = F.array_join(F.transform(kept, lambda b: b.text), "\n")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
