"""Main text of web pages by wrapper induction over the DOM trees of each host.

1. A few pages of each host are merged into one tree by simple tree matching: a node of the merged
   tree stands for the nodes that the matching pairs, optional nodes are inserted where they occur.
2. Every page of the host is aligned with that tree, and agreement is counted per node over all
   pages (sums, added up before the shuffle): how often a node occurs, how often a text is the same,
   how much text and how much link text it holds.
3. Constant texts, and regions that are links almost only, become template; a region that is no
   article by its name does too, unless the host has its main text there. Every page is aligned
   with the template, and the varying slots that are left are its text.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.session import cut
from quillgraph.llm.text import map_batches
from quillgraph.llm.url_filter import host_and_path

#: Pages of a host that its tree is merged from, whatever they look like (one per slot of a hash of the key).
EXEMPLARS = 8
#: Share of a host's pages that show a tag, class or id above which two of them are exemplars as well, so that every kind of page aligns.
KIND_SHARE = 1 / 32
#: Share of the pages that show a text that must agree on it; inside an article one page of doubt is added to them.
AGREEING = 0.8
#: Share of a page's text equal to its host's tree above which the page is a copy of an exemplar and no evidence.
COPY_SHARE = 0.5
#: Share of link text that makes a region a menu, and share of all text that makes a named region the main text.
MENU_LINKS, MAIN_SHARE = 0.7, 0.5
#: Hosts, and bytes of their trees, that are broadcast; beyond either pages and trees are joined by host.
BROADCAST_HOSTS, BROADCAST_BYTES = 50_000, 64 << 20
#: Levels of the tree; deeper elements are blocks of the last level.
_DEPTH = 100
#: Cells of an alignment table that is kept whole; longer lists are halved (linear memory, the same result).
_CELLS = 1 << 20

# Element names of HTML by role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NO_TEXT = RAW | frozenset("template select datalist".split())  # scripts, styles, titles, form fields
REGIONS = frozenset("nav header footer aside form menu dialog".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login comment comments "
    "disqus respond replies related recommended share sharing social widget toolbar pagination pager".split()
)
#: Words that may stand beside them; a name that holds any other word (no-sidebar, social-policy) says nothing.
NEUTRAL = frozenset("box block bar area wrapper wrap container list item items links link section top bottom left right main site page global inner outer thread form text row col column icons buttons posts".split())
ROLES_NOT_ARTICLE = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar alertdialog".split())
_PLAIN, _REGION, _NAMED, _ARTICLE = range(4)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_END = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_ATTR = re.compile(r"(?<![\w-])(class|id|role)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.I)
_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile("[0-9]+")
# Noncharacters that stand around link text until a block is cleaned.
_LINK, _UNLINK = "\ufdd0", "\ufdd1"
_LINKED = re.compile(f"{_LINK}([^{_LINK}{_UNLINK}]*)")


def region_name(value: str) -> bool:
    """Whether a class or id names a region that is no article: one such word, else neutral words."""
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if any(w in NOT_ARTICLE for w in words) and all(w in NOT_ARTICLE or w in NEUTRAL for w in words):
            return True
    return False


def _kind(tag: str, attrs: str, in_article: bool) -> tuple[int, str] | None:
    """(kind, symbol) of an element, by which nodes are matched; None if it shows no text."""
    if tag in NO_TEXT:
        return None
    kind, symbol = _PLAIN, tag
    if tag in ("article", "main"):
        kind = _ARTICLE
    elif tag in REGIONS and not (tag == "header" and in_article):
        kind = _REGION
    if attrs and tag not in ("body", "html"):
        for m in _ATTR.finditer(attrs):
            name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
            if name == "role" and value.lower() in ROLES_NOT_ARTICLE:
                kind = _REGION
            elif name in ("class", "id"):
                symbol += f" {name}={_DIGITS.sub('0', value)}"
                if kind == _PLAIN and region_name(value):
                    kind = _NAMED
    return kind, symbol


class Node:
    """An element or, with ``text``, a cleaned text of it. Ids: ``form`` without, ``full`` with texts."""

    __slots__ = ("symbol", "kind", "kids", "text", "size", "leaves", "chars", "links", "form", "full", "at", "seen", "texts")

    def __init__(self, symbol: str, kind: int = _PLAIN, kids=None, text: str | None = None, links: int = 0):
        self.symbol, self.kind, self.kids, self.text, self.links = symbol, kind, kids if kids is not None else [], text, links
        self.seen, self.texts = 1, None
        self.measure()

    def measure(self) -> None:
        if self.text is not None:
            self.size = self.leaves = 1
            self.chars = len(self.text)
            self.form, self.full = 0, hash(self.text)
        else:
            self.size, self.leaves, self.chars, self.links = 1, 0, 0, 0
            for k in self.kids:
                self.size += k.size
                self.leaves += k.leaves
                self.chars += k.chars
                self.links += k.links
            self.form = hash((self.symbol, *[k.form for k in self.kids]))
            self.full = hash((self.symbol, *[k.full for k in self.kids]))


def parse(page: str) -> Node:
    """Tree of the page's block elements and cleaned texts; elements without text are left out.

    Inline markup joins its text to the block; inline markup that names a region is left out at once.
    Missing end tags are implied as HTML has it; a page that breaks off is read to its end.
    """
    root: list = ["html", _PLAIN, []]
    marks = _LINK not in page and _UNLINK not in page
    stack = [("html", root, False)]  # (name, node that takes text, left out)
    open_names: dict[str, int] = {"html": 1}
    pos, n, low, quotes = 0, len(page), None, True
    text: list[str] = []

    def flush() -> None:
        if text:
            _, node, out = stack[-1]
            if not out:
                kids = node[2]
                joined = "".join(text)
                if kids and isinstance(kids[-1], str):
                    kids[-1] += joined
                else:
                    kids.append(joined)
            text.clear()

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            open_names[stack.pop()[0]] -= 1

    def innermost(name: str) -> int:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                return i
        return 0

    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            text.append(page[pos:])
            break
        if at > pos:
            text.append(page[pos:at])
        nxt = page[at + 1 : at + 2]
        if nxt and nxt in "!?":
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                pos = n if end < 0 else end + 3
            else:
                end = page.find(">", at)
                pos = n if end < 0 else end + 1
            continue
        closing = nxt == "/"
        m = _NAME.match(page, at + 1 + closing)
        if not m:
            if closing:
                end = page.find(">", at)
                pos = n if end < 0 else end + 1
            else:
                text.append("<")
                pos = at + 1
            continue
        name = m.group().lower()
        end = _TAG_END.match(page, m.end()) if quotes else None
        if end:
            stop = end.end()
        else:
            quotes = False
            stop = page.find(">", m.end()) + 1 or n
        attrs, pos = page[m.end() : stop - 1], stop
        if closing:
            if name == "br":
                text.append(" ")
            elif open_names.get(name, 0):
                if name == "a" and marks:
                    text.append(_UNLINK)
                flush()
                if depth := innermost(name):
                    pop_to(depth)
            continue
        if name == "br" or name == "wbr":
            if name == "br":
                text.append(" ")
            continue
        if name in RAW:
            low = page.lower() if low is None else low
            if len(low) != n:  # a few capitals change length when lowered
                found = re.compile(f"</{name}", re.I).search(page, pos)
                end_at = found.start() if found else -1
            else:
                end_at = low.find(f"</{name}", pos)
            if end_at < 0:
                pos = n
            else:
                close = page.find(">", end_at)
                pos = n if close < 0 else close + 1
            continue
        block = name in BLOCKS
        if block and open_names.get("p", 0):
            flush()
            pop_to(innermost("p"))
        if name in CLOSES:
            flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in CLOSES[name]:
                    pop_to(i)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select", "div", "section", "article"):
                    break
        if name in VOID:
            if block:
                flush()
            continue
        if attrs.endswith("/") and not block and name not in ("a", "b", "i", "span", "em", "strong"):
            continue
        parent, node, out = stack[-1]
        kind = None if out else _kind(name, attrs, bool(open_names.get("article", 0) or open_names.get("main", 0)))
        gone = out or kind is None or not block and kind[0] in (_REGION, _NAMED)
        if block or gone != out or (kind and kind[0] != _PLAIN):
            flush()
            mine = node
            if not gone:
                if len(stack) >= _DEPTH:  # too deep to nest: a block of its own, or no article
                    gone = kind[0] in (_REGION, _NAMED)
                    if not gone:
                        stack_node = stack[_DEPTH - 1][1]
                        mine = ["p", _PLAIN, []]
                        stack_node[2].append(mine)
                else:
                    mine = [kind[1], kind[0], []]
                    node[2].append(mine)
            stack.append((name, mine, gone))
        else:
            if name == "a" and marks:
                text.append(_LINK)
            stack.append((name, node, out))  # inline: text goes on in the same block
        open_names[name] = open_names.get(name, 0) + 1
    flush()
    return _cleaned(root)


def _cleaned(tree: list) -> Node:
    kids = []
    for child in tree[2]:
        if isinstance(child, str):
            links = 0
            if _LINK in child or _UNLINK in child:
                links = sum(len(clean(x)) for x in _LINKED.findall(child))
                child = child.replace(_LINK, "").replace(_UNLINK, "")
            if text := clean(child):
                kids.append(Node("", text=text, links=min(links, len(text))))
        else:
            inner = _cleaned(child)
            if inner.kids:
                kids.append(inner)
    return Node(tree[0], tree[1], kids)


def clean(text: str) -> str:
    return " ".join(html_lib.unescape(text).split())


def weight(a: Node, b: Node, memo: dict) -> int:
    """Simple tree matching: nodes matched between two trees, equal texts counting twice."""
    if a.text is not None or b.text is not None:
        return 0 if a.text is None or b.text is None else 2 if a.text == b.text else 1
    if a.symbol != b.symbol:
        return 0
    if a.full == b.full:
        return a.size + a.leaves
    if a.form == b.form and a.leaves == 1:
        return a.size
    key = (id(a), id(b))
    if key not in memo:
        memo[key] = 1 + sum(w for _, _, w in aligned(a.kids, b.kids, memo))
    return memo[key]


def aligned(xs: list[Node], ys: list[Node], memo: dict) -> list[tuple[int, int, int]]:
    """Order-keeping alignment of two child lists of the largest weight: (i, j, weight).

    Equal ends are paired first, which no best alignment has to undo. Tables stay under _CELLS cells:
    longer lists are halved where the best rows from both ends meet.
    """
    m, n, head = len(xs), len(ys), 0
    while head < m and head < n and xs[head].full == ys[head].full:
        head += 1
    while m > head and n > head and xs[m - 1].full == ys[n - 1].full:
        m, n = m - 1, n - 1
    own = lambda i, j: (i, j, weight(xs[i], ys[j], memo))
    out = [own(k, k) for k in range(head)]
    out += [(i + head, j + head, w) for i, j, w in _middle(xs[head:m], ys[head:n], memo)]
    return out + [own(m + k, n + k) for k in range(len(xs) - m)]


def _row(x: Node, ys: list[Node], memo: dict) -> np.ndarray:
    return np.fromiter((weight(x, y, memo) for y in ys), np.int64, len(ys))


def _last_row(xs: list[Node], ys: list[Node], memo: dict) -> np.ndarray:
    best = np.zeros(len(ys) + 1, np.int64)
    for x in xs:
        w = _row(x, ys, memo)
        best[1:] = np.maximum(best[1:], np.where(w > 0, best[:-1] + w, 0))
        np.maximum.accumulate(best, out=best)
    return best


def _middle(xs: list[Node], ys: list[Node], memo: dict) -> list[tuple[int, int, int]]:
    m, n = len(xs), len(ys)
    if not m or not n:
        return []
    if m > 1 and (m + 1) * (n + 1) > _CELLS:
        half = m // 2
        down = _last_row(xs[:half], ys, memo)
        up = _last_row(xs[half:][::-1], ys[::-1], memo)[::-1]
        cut_at = int((down + up).argmax())
        rest = _middle(xs[half:], ys[cut_at:], memo)
        return _middle(xs[:half], ys[:cut_at], memo) + [(i + half, j + cut_at, w) for i, j, w in rest]
    if m * n <= 256:
        best = [[0] * (n + 1) for _ in range(m + 1)]
        w = [[0] * n for _ in range(m)]
        for i in range(m):
            row, up = best[i + 1], best[i]
            for j in range(n):
                w[i][j] = v = weight(xs[i], ys[j], memo)
                row[j + 1] = max(up[j + 1], row[j], up[j] + v if v else 0)
    else:
        best = np.zeros((m + 1, n + 1), np.int64)
        w = np.empty((m, n), np.int64)
        for i, x in enumerate(xs):
            w[i] = _row(x, ys, memo)
            best[i + 1, 1:] = np.maximum(best[i, 1:], np.where(w[i] > 0, best[i, :-1] + w[i], 0))
            np.maximum.accumulate(best[i + 1], out=best[i + 1])
    out, i, j = [], m, n
    while i and j:
        v = int(w[i - 1][j - 1])
        if v and best[i][j] == best[i - 1][j - 1] + v:
            out.append((i - 1, j - 1, v))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def matched(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Nodes and texts that simple tree matching pairs, parents first."""
    memo: dict = {}
    out, stack = [], [(a, b)]
    while stack:
        x, y = stack.pop()
        if x.symbol != y.symbol:
            continue
        out.append((x, y))
        if x.text is None:
            stack += [(x.kids[i], y.kids[j]) for i, j, _ in aligned(x.kids, y.kids, memo)]
    return out


def merge(tree: Node, page: Node) -> Node:
    """``tree`` with the nodes of ``page``: matched nodes are counted, others inserted in order."""
    memo: dict = {}

    def both(x: Node, y: Node) -> None:
        x.seen += 1
        if x.text is not None:
            x.texts[y.text] += 1
            x.text = min(x.texts, key=lambda t: (-x.texts[t], t))
            x.measure()
            return
        kids, i, j = [], 0, 0
        for p, q, _ in [*aligned(x.kids, y.kids, memo), (len(x.kids), len(y.kids), 0)]:
            kids += x.kids[i:p]
            kids += [_counted(k) for k in y.kids[j:q]]
            if p < len(x.kids):
                pairs.append((x.kids[p], y.kids[q]))
                kids.append(x.kids[p])
            i, j = p + 1, q + 1
        x.kids = kids

    pairs = [(tree, page)]
    while pairs:
        both(*pairs.pop())
    _remeasure(tree)
    return tree


def _counted(node: Node) -> Node:
    """A copy of a page's subtree as part of a host's tree."""
    made = Node(node.symbol, node.kind, [_counted(k) for k in node.kids], node.text, node.links)
    if node.text is not None:
        made.texts = Counter([node.text])
    return made


def _remeasure(node: Node) -> None:
    for k in node.kids:
        _remeasure(k)
    node.measure()


def induce(pages: list[str]) -> str | None:
    """The host's tree as JSON: what at least two different pages have; None for fewer pages."""
    trees = {}
    for page in sorted(set(pages)):
        tree = parse(page)
        trees.setdefault(json.dumps(_packed(tree)), tree)
    if len(trees) < 2:
        return None
    first, *others = (trees[k] for k in sorted(trees, key=lambda k: (len(k), k)))
    host = _counted(first)
    for other in others:
        merge(host, other)

    def prune(node: Node) -> None:
        node.kids = [k for k in node.kids if k.seen > 1]
        for k in node.kids:
            prune(k)

    prune(host)
    return json.dumps(_packed(host))


def _packed(node: Node) -> list:
    if node.text is not None:
        return [node.text]
    return [node.symbol, node.kind, [_packed(k) for k in node.kids]]


def unpack(packed: list) -> tuple[Node, list[Node]]:
    """A host's tree and its nodes, numbered in page order; ``at`` is a node's number."""
    nodes: list[Node] = []

    def build(p: list) -> Node:
        at = len(nodes)
        nodes.append(None)  # type: ignore[arg-type]
        node = Node("", text=p[0]) if len(p) == 1 else Node(p[0], p[1], [build(k) for k in p[2]])
        node.at = at
        nodes[at] = node
        return node

    return build(packed), nodes


def agreement(tree: Node, page: Node, into: dict[int, list[int]]) -> None:
    """Add what one page says of a tree's nodes: pages, equal texts, characters, characters of links, of the page."""
    pairs = matched(tree, page)
    same = sum(y.chars for x, y in pairs if x.text is not None and x.text == y.text)
    if same > COPY_SHARE * page.chars:
        return
    for x, y in pairs:
        sums = into.setdefault(x.at, [0, 0, 0, 0, 0])
        sums[0] += 1
        sums[1] += x.text is not None and x.text == y.text
        sums[2] += y.chars
        sums[3] += y.links
        sums[4] += page.chars


def decide(packed: list, sums: dict[int, tuple]) -> str | None:
    """The host's template as JSON: [tree, {node: what}]; None if the host decides nothing.

    What: "text" for a constant text, "menu" for a region of links outside articles, "gone" and
    "main" for a region that is no article by its name and that does not, or does, hold the host's
    main text. The tree is one page's word and each page that is no copy of it another; a text in an article is constant if the pages that
    agree are the share AGREEING of those that show it and one more.
    """
    tree, nodes = unpack(packed)
    what: dict[int, str] = {}

    def visit(node: Node, in_article: bool) -> None:
        pages, equal, chars, links, total = sums.get(node.at, (0, 0, 0, 0, 0))
        in_article |= node.kind in (_ARTICLE, _REGION)  # regions by tag go whatever is said of them
        if pages:
            if node.text is not None:
                if equal >= AGREEING * (pages + in_article):
                    what[node.at] = "text"
            elif node.kind == _NAMED:
                what[node.at] = "main" if chars >= MAIN_SHARE * total else "gone"
            elif node.kind == _PLAIN and not in_article and chars < MAIN_SHARE * total and links >= MENU_LINKS * chars:
                what[node.at] = "menu"
        if what.get(node.at) not in ("gone", "menu"):
            for k in node.kids:
                visit(k, in_article)

    visit(tree, False)
    if not what:
        return None
    keep: set[int] = set()

    def needed(node: Node) -> bool:
        inner = [needed(k) for k in node.kids]
        if node.at in what or any(inner):
            keep.add(node.at)
        return node.at in keep

    needed(tree)
    numbers: dict[str, str] = {}

    def pack(node: Node) -> list:
        if node.at in what:
            numbers[str(len(order))] = what[node.at]
        order.append(node.at)
        return [node.text] if node.text is not None else [node.symbol, node.kind, [pack(k) for k in node.kids if k.at in keep]]

    order: list[int] = []
    return json.dumps([pack(tree), numbers])


def extract(page: str | None, template: tuple[Node, dict[int, str]] | None = None) -> str:
    """Main text of a page: its varying slots, one block a line.

    Elements that are a region by tag or role go. A region by class or id goes if the host says so
    or, where the host says nothing, unless it holds the page's main text: half of the text outside
    regions by tag, and no article or main element outside it has text.
    """
    tree = parse(page or "")
    said: dict[int, str] = {}
    if template:
        for x, y in matched(template[0], tree):
            what = template[1].get(x.at)
            if what == "text" and x.text != y.text or what == "menu" and y.links < MENU_LINKS * y.chars:
                continue
            if what:
                said[id(y)] = what
    total, article = _main_chars(tree)
    out: list[str] = []

    def visit(node: Node) -> None:
        what = said.get(id(node))
        if node.text is not None:
            if what != "text":
                out.append(node.text)
            return
        if node.kind == _REGION or what in ("gone", "menu"):
            return
        if node.kind == _NAMED and what != "main":
            inner, own = _main_chars(node)
            if 2 * inner < total or article > own:
                return
        for k in node.kids:
            visit(k)

    visit(tree)
    return "\n".join(out)


def _main_chars(node: Node) -> tuple[int, int]:
    """Characters outside regions by tag, and of those the ones in article or main elements."""
    if node.text is not None:
        return node.chars, 0
    if node.kind == _REGION:
        return 0, 0
    both = [_main_chars(k) for k in node.kids]
    total = sum(b[0] for b in both)
    return total, total if node.kind == _ARTICLE else sum(b[1] for b in both)


def _marks(html) -> Column:
    """The tags, classes and ids of a page, each once; digits of a class or id are all alike."""
    tags = F.transform(F.regexp_extract_all(html, F.lit("<([A-Za-z][A-Za-z0-9]*)"), F.lit(1)), F.lower)
    names = F.regexp_extract_all(html, F.lit(r"""[\s"'](?i:class|id)\s*=\s*("[^"<>]*"|'[^'<>]*'|[^\s"'<>]+)"""), F.lit(1))
    return F.array_distinct(F.concat(tags, F.transform(names, lambda v: F.concat(F.lit("="), F.regexp_replace(F.translate(v, "\"'", ""), "[0-9]", "0")))))


def exemplars(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(host, k): the pages that a host's tree is merged from.

    One for each slot of a hash of the key, and, for each tag, class or id that KIND_SHARE of the host's pages
    show, the pages of least and greatest hash among those that show it: two of every kind of page. All are
    pre-aggregated extremes; a host has at most 64 times as many exemplars as a page has marks, and 8 more.
    """
    host, _ = host_and_path("url")
    h = F.xxhash64(F.col(key))
    one = F.struct(h.alias("h"), F.col(key).alias("k"))
    known = pages.where(F.col(key).isNotNull())
    marks = F.explode(F.concat(F.array(F.concat(F.lit("#"), F.pmod(h, F.lit(EXEMPLARS)).cast("string")), F.lit("")), F.coalesce(_marks(F.col("html")), F.array())))
    shown = known.select(host.alias("host"), one.alias("one"), marks.alias("mark")).groupBy("host", "mark").agg(F.count("*").alias("n"), F.min("one").alias("lo"), F.max("one").alias("hi"))
    shown = cut(shown)
    all_pages = shown.where("mark = ''").select(F.col("host").alias("of"), F.col("n").alias("pages"))
    kinds = shown.where("mark <> '' and not startswith(mark, '#')").join(all_pages, F.col("host") == F.col("of")).where(F.col("n") >= F.greatest(F.lit(2), F.col("pages") * KIND_SHARE))
    slots = shown.where("startswith(mark, '#')").select("host", F.col("lo.k").alias("k"))
    return slots.unionByName(kinds.select("host", F.explode(F.array("lo.k", "hi.k")).alias("k"))).distinct()


def host_trees(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(host, tree) of the hosts with two different pages or more, merged from their exemplars.

    Repeated keys count once; a host of any size gives a bounded number of exemplars and no task holds its pages.
    """
    host, _ = host_and_path("url")
    chosen = cut(exemplars(pages, key))
    small = chosen.count() <= 8 * BROADCAST_HOSTS
    rows = pages.select(F.col(key).alias("p"), host.alias("own"), "html")
    html = rows.join(F.broadcast(chosen) if small else chosen, (F.col("p") == F.col("k")) & (F.col("own") == F.col("host")))
    html = html.groupBy("host", "p").agg(F.min("html").alias("html"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "tree": [induce([p or "" for p in pdf["html"]])]})

    return html.groupBy("host").applyInPandas(one, "host string, tree string").where("tree is not null")


def _with_host(pages: DataFrame, trees: DataFrame, column: str, key: str) -> DataFrame:
    """(key, url, html, host, column): every page with the column of its host, null where it has none."""
    host, _ = host_and_path("url")
    mine = pages.select(F.col(key), "url", "html", host.alias("host"))
    known = trees.select(F.col("host").alias("h"), column)
    size = trees.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(column)), F.lit(0)).alias("bytes")).first()
    if size["n"] == 0:
        return mine.withColumn(column, F.lit(None).cast("string"))
    small = size["n"] <= BROADCAST_HOSTS and size["bytes"] <= BROADCAST_BYTES
    return mine.join(F.broadcast(known) if small else known, F.col("host") == F.col("h"), "left")


def _reader(read):
    """Read a JSON text once for the rows that share it."""
    held: dict[str, object] = {}

    def get(text: str | None):
        if text is None:
            return None
        if text not in held:
            if len(held) > 1000:
                held.clear()
            held[text] = read(text)
        return held[text]

    return get


def host_templates(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(host, template, n_text, n_menu, n_gone, n_main) of the hosts that decide on some node.

    Every page of a host is aligned with the host's tree; a worker adds up the pages of a batch, so
    a host of any size sends few sums.
    """
    trees = cut(host_trees(pages, key))

    def make():
        tree_of = _reader(lambda t: unpack(json.loads(t))[0])

        def each(batch: pa.RecordBatch):
            sums: dict[str, dict[int, list[int]]] = {}
            for page, host, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                tree = tree_of(text)
                if tree is not None:
                    agreement(tree, parse(page or ""), sums.setdefault(host, {}))
            rows = [(host, at, *s) for host, own in sums.items() for at, s in own.items()]
            if rows:
                kinds = [pa.string(), *[pa.int64()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["host", "node", "pages", "equal", "chars", "links", "total"])

        return each

    names = ["pages", "equal", "chars", "links", "total"]
    counted = map_batches(_with_host(pages, trees, "tree", key).where("tree is not null"), ["html", "host", "tree"], make, "host string, node long, pages long, equal long, chars long, links long, total long")
    sums = counted.groupBy("host", "node").agg(*[F.sum(c).alias(c) for c in names])
    # As many nodes as the host's tree has, at most.
    per = sums.groupBy(F.col("host").alias("h")).agg(F.collect_list(F.struct("node", *names)).alias("sums"))

    def settle(batches):
        for pdf in batches:
            made = []
            for tree, own in zip(pdf["tree"], pdf["sums"], strict=True):
                made.append(decide(json.loads(tree), {r["node"]: tuple(r[c] for c in names) for r in own}))
            counts = [Counter(json.loads(t)[1].values() if t else ()) for t in made]
            yield pd.DataFrame({"host": pdf["host"], "template": made} | {f"n_{k}": [c[k] for c in counts] for k in ("text", "menu", "gone", "main")})

    found = trees.join(per, F.col("host") == F.col("h")).select("host", "tree", "sums")
    return found.mapInPandas(settle, "host string, template string, n_text long, n_menu long, n_gone long, n_main long").where("template is not null")


def extract_pages(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url, text) of every row: the main text, one block a line.

    Templates come from all pages of a host; only the tree they are counted on is merged from
    exemplars, two or more of every kind of page that KIND_SHARE of the host's pages are. Constant text of
    a host is template if its pages that are no copies of each other agree on it: two or more pages, in an
    article four or more. Formulas, hidden texts, texts of noscript, object and button elements outside forms
    and link lists in an article stay: only form fields, scripts, styles and regions go. Null and empty html give an
    empty text; a null url has the empty host; repeated rows give equal texts; other columns are not
    read.
    """
    joined = _with_host(pages, cut(host_templates(pages, key).select("host", "template")), "template", key)

    def make():
        def read(text: str):
            packed, what = json.loads(text)
            return unpack(packed)[0], {int(k): v for k, v in what.items()}

        template_of = _reader(read)

        def each(batch: pa.RecordBatch):
            texts = [extract(page, template_of(t)) for page, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[key, "url", "text"])

        return each

    return map_batches(joined, [key, "url", "html", "template"], make, f"{key} {dict(pages.dtypes)[key]}, url string, text string")


def op4_wrapper_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``."""
    out = extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
