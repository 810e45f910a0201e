"""Main text of HTML pages by composite text density.

A page is read into a tree once. Each node has the characters and tags below it and those of them inside links; its
density is characters per tag, scaled down by a logarithm as its share of link text nears that of the body. The densities of
a node's children are summed, and of all nodes the one of greatest sum is the candidate; the least density on the path from
it to the body is the threshold. The candidate is kept, and so is every subtree beside its path that reaches the threshold;
of a side that holds such a subtree the node of greatest sum is kept too, so that short paragraphs among long ones stay.
An article (else a main part) goes first where sums are equal, and is kept whole where some of it is kept; a part beside
the candidate, of its element and with a heading like its own, is kept too, as a second article of the page.

Menus, page headers, footers, sidebars, dialogs, fields and what is hidden are cut off before by their elements, roles and
attributes, as are scripts and styles. Forms, articles inside articles (readers' comments), and parts whose class or id is one
of the few ``CUT_NAMES`` of adverts, notices and comments are cut off too, unless the page's text stands in them
(``settle``): where a notice is as long as the article (below about 300 characters) no density tells them apart. Elsewhere density alone
decides. All other text of the kept parts stays, in page order: one line per block, white space turned into single spaces,
character references decoded.

A page is read in time and memory in proportion to its length, however deep, unclosed or misquoted its tags are: what a
tag closes is known from stacks of open tags, and from the first tag with unbalanced quotes on, where a tag ends is known from
one pass over the page's quotes. A ``<`` behind the last ``>`` is text unless a comment begins there.

Defined results: null or empty pages, and pages without a text outside the parts that are cut off, give an empty text;
unclosed and misnested tags close as their elements end, a head at the first thing that can't be in it; columns of any
name, clashing ones too, pass through ``extract`` unread; rows are independent, so repeats, ties and empty tables need
nothing, and a page's memory is its own tree.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.storage import map_texts, numbered

#: Fixed values of the HTML standard: elements without content, with raw content, and that stand for blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag ends: the nearest open element of a group, unless one of the group's walls lies between.
GROUPS = {
    "p": ({"p"}, frozenset("table td th caption button body html".split())),
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
    "a": ({"a"}, BLOCK),
}
ENDS = {"li": "li", "dt": "dt", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "option": "option", "a": "a"}
_P_ENDS = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend"}
CUT = frozenset("nav footer aside button select dialog menu head iframe noscript object embed canvas template svg input".split())
#: What may stand in a head; anything else ends it.
HEAD = frozenset("base link meta title script style noscript template".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Class and id names of adverts, notices and readers' comments, alone or with one of the endings.
CUT_NAMES = frozenset("ad ads advert advertisement advertising sponsored promo cookie cookies consent notice newsletter sidebar breadcrumb breadcrumbs comment comments commentlist replies disqus".split())
ENDINGS = frozenset("area banner bar block box consent container form list modal notice overlay popup section signup slot thread unit widget wrapper".split())
#: So many times the rest of the page's text, and so many characters, a part is the page and not an advert, a form or a comment.
HOLDS, LEAST = 20, 100
_TAG = r"<(/?)([a-zA-Z][^\s/>]*)"
_OPEN = re.compile(_TAG)
_SPECIAL = re.compile("[>\"']")
_QUOTED = re.compile(_TAG + r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN = re.compile(_TAG + r"([^>]*+)>")
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/][^>]*+>", re.DOTALL)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {tag: re.compile(f"</{tag}[^>]*+>", re.IGNORECASE | re.ASCII) for tag in RAW}


#: The groups that an element opens or walls off.
_TOUCHED = {tag: [g for g, (kinds, walls) in GROUPS.items() if tag in kinds or tag in walls] for tag in {t for k, w in GROUPS.values() for t in (*k, *w)}}


class Node:
    __slots__ = ("tag", "parent", "items", "cut", "doubtful", "chars", "tags", "link_chars", "link_tags", "density", "total", "depth", "block", "near")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False, doubtful: bool = False):
        self.tag, self.parent, self.cut, self.doubtful = tag, parent, cut, doubtful
        self.depth = parent.depth + 1 if parent else 0
        #: the depth of the nearest block from here up, and by group the nearest open element within the group's walls
        self.block = self.depth if tag in BLOCK or not parent else parent.block
        self.near = parent.near if parent else {}
        for group in _TOUCHED.get(tag, ()):
            new = self if tag in GROUPS[group][0] else None
            if self.near.get(group) is not new:
                self.near = {**self.near, group: new}
        self.items: list = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _kind(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is cut off, and whether it is unless it holds the page's text (see ``settle``)."""
    if tag in CUT or (tag == "header" and not in_article):
        return True, False
    doubtful = tag == "form" or (tag == "article" and in_article)
    if not attributes or tag in ("html", "body", "main"):
        return False, doubtful
    found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTR.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return True, False
    if tag != "article" and found.get("role") in CUT_ROLES:
        return found["role"] != "form", True
    names = f"{found.get('class', '')} {found.get('id', '')}".replace("_", "-").split()
    return False, doubtful or (tag != "header" and any(_of_no_article(n) for n in names))


def _of_no_article(name: str) -> bool:
    first, _, ending = name.partition("-")
    return name in CUT_NAMES or (first in CUT_NAMES and ending in ENDINGS)


class _Ends:
    """Where a tag ends when quotes count: the first ``>`` outside of quotes, for every place of a page in one pass over it."""

    def __init__(self, html: str):
        self.at = [m.start() for m in _SPECIAL.finditer(html)]
        self.end = [-1] * (len(self.at) + 1)
        later = {">": -1, '"': -1, "'": -1}
        for i in range(len(self.at) - 1, -1, -1):
            sign = html[self.at[i]]
            if sign == ">":
                self.end[i] = self.at[i]
            elif later[sign] >= 0:
                self.end[i] = self.end[later[sign] + 1]
            later[sign] = i

    def of(self, place: int) -> int:
        return self.end[bisect_left(self.at, place)]


def _tokens(html: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, "/" of an end tag, tag, attributes) of each tag, and the text behind the last one with no tag."""
    at, text_from, ends, last = 0, 0, None, html.rfind(">")
    while True:
        at = html.find("<", at)
        if at < 0 or at > last:
            comment = html.find("<!--", max(at, text_from))
            yield html[text_from : comment if comment >= 0 else len(html)], "", "", ""
            return
        m = _QUOTED.match(html, at) if ends is None else None
        found = m and (m[1], m[2], m[3], m.end())
        if found is None and (m := _OPEN.match(html, at)):
            # quotes don't close in this tag: from here on the ends of tags are looked up, and without one quotes don't count
            ends = ends or _Ends(html)
            end = ends.of(m.end())
            end = html.index(">", m.end()) if end < 0 else end
            found = m[1], m[2], html[m.end() : end], end + 1
        if found is None:
            m = _OTHER.match(html, at)
            if m is None:
                at += 1
                continue
            yield html[text_from : m.start()], "", "", ""
            at = text_from = m.end()
            continue
        slash, tag, rest, end = found
        tag = tag.lower()
        yield html[text_from:at], slash, tag, rest
        at = end
        if tag in RAW and not slash and not rest.endswith("/"):
            close = _RAW_END[tag].search(html, at)
            at = close.end() if close else len(html)
        text_from = at


def tree(html: str) -> Node:
    """The page's tree; texts are strings among a node's items."""
    root = Node("html", None)
    top, body = root, None
    stacks: dict[str, list[Node]] = defaultdict(list)

    def up_to(node: Node) -> None:
        """Close all open elements below ``node``."""
        nonlocal top
        while top is not node:
            stacks[top.tag].pop()
            top = top.parent

    for text, end, tag, rest in _tokens(html):
        if stacks["head"] and ((text and not text.isspace()) or not (end or tag in HEAD)):
            up_to(stacks["head"][-1].parent)
        if text:
            top.items.append(" " if text.isspace() else unescape(text))
        if not tag or tag in RAW:
            continue
        if end:
            # a stray inline end tag doesn't close a block
            if stacks[tag] and (tag in BLOCK or stacks[tag][-1].depth > top.block):
                up_to(stacks[tag][-1].parent)
        elif tag in VOID:
            top.items.append(Node(tag, top) if tag == "hr" else " " if tag in ("br", "wbr") else "")
        elif tag in ("html", "body"):
            if tag == "body" and body is None:
                up_to(root)
                top = body = Node("body", root)
                root.items.append(body)
                stacks["body"].append(body)
        else:
            for group in ("p" if tag in _P_ENDS else None, ENDS.get(tag)):
                if group and top.near.get(group):
                    up_to(top.near[group].parent)
            node = Node(tag, top, *_kind(tag, rest, bool(stacks["article"])))
            top.items.append(node)
            if not rest.endswith("/") or tag in BLOCK:
                top = node
                stacks[tag].append(node)
    settle(root)
    return root


def settle(root: Node) -> None:
    """Decide on the doubtful nodes: forms, parts named like adverts or comments, articles inside articles.

    An article inside another is a reader's comment unless such articles are on average longer than what the outer one has
    beside them. A doubtful node is cut off unless it has more than ``LEAST`` characters and ``HOLDS`` times the text that stands
    outside of all that are, or the page's first heading or main part: then it is no such part but what the page's text stands in. The largest are asked first.
    """
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in reversed(node.items) if isinstance(x, Node) and not x.cut]
    own, outer, inner = {}, {}, defaultdict(list)
    for node in order:
        up = outer.get(node.parent)
        if node.tag == "article" and up:
            inner[up].append(node)
        outer[node] = up or (node if node.tag == "article" else None)
    for node in reversed(order):
        below = [x for x in node.items if isinstance(x, Node) and not x.cut]
        own[node] = sum(len(x.strip()) for x in node.items if isinstance(x, str)) + sum(own[x] for x in below if not x.doubtful)
    for article, nested in inner.items():
        nested = [n for n in nested if n.doubtful]
        if nested and sum(own[n] for n in nested) > own[article] * len(nested):
            for n in nested:
                n.doubtful = False
    held, outside = set(), own[root]

    def hold(node: Node | None) -> None:
        """Keep a node and all that it stands in."""
        nonlocal outside
        while node is not None and node not in held:
            held.add(node)
            outside += own[node] if node.doubtful else 0
            node = node.parent

    hold(next((n for n in order if n.tag in ("h1", "main")), None))
    for n in sorted((n for n in order if n.doubtful), key=lambda n: -own[n]):
        if own[n] > max(HOLDS * outside, LEAST):
            hold(n)
    for n in order:
        n.cut = n.doubtful and n not in held


def measured(root: Node) -> list[Node]:
    """All nodes that aren't cut off, children before parents, with characters, tags, densities and their sums."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in node.items if isinstance(x, Node) and not x.cut]
    order.reverse()
    for node in order:
        for x in node.items:
            if isinstance(x, str):
                node.chars += len(x.strip())
            elif not x.cut:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.chars if x.tag == "a" else x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
    body = root
    share = body.link_chars / max(1, body.chars)
    for node in order:
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        if c:
            base = log(c * lc / max(1, c - lc) + share * c + e)
            node.density = c / t * log(max(1.0, c * t / (max(1, lc) * lt)) + 1e-9) / base if base > 1e-9 else 0.0
            node.density = max(node.density, 0.0) if c > 1 else 0.0
        node.total = sum(x.density for x in node.items if isinstance(x, Node) and not x.cut)
    return order


def chosen(root: Node) -> list[Node]:
    """The subtrees that hold the main text, in page order."""
    order = measured(root)
    if not root.chars:
        return []
    most = max(n.total for n in order)
    if not most:
        return [root]
    ties = [n for n in order if n.total >= most * (1 - 1e-9)]
    best = max(ties, key=lambda n: (n.tag == "article", n.tag == "main", n.chars))
    path, threshold, node = {best}, best.density, best
    while node.tag != "body" and node.parent is not None:
        node = node.parent
        path.add(node)
        threshold = min(threshold, node.density)
    while node.parent is not None:
        node = node.parent
        path.add(node)
    # of each node, parents first: the subtree beside the path that holds it, and the outermost article (else main part)
    beside, marked = {}, {}
    for n in reversed(order):
        if n not in path:
            beside[n] = n if n.parent in path and n.parent is not best else beside.get(n.parent)
        up = marked.get(n.parent)
        marked[n] = n if n.tag == "article" and (up is None or up.tag == "main") else up or (n if n.tag == "main" else None)
    reach = {n for n in order if beside.get(n) and n.density >= threshold}
    sides = {beside[n] for n in reach}
    largest: dict[Node, Node] = {}
    for n in order:
        side = beside.get(n)
        if side in sides and (side not in largest or (n.total, n.chars) > (largest[side].total, largest[side].chars)):
            largest[side] = n
    # a part made like the kept one is one more of its kind, however short
    heading = {}
    for n in order:
        first = next((x for x in n.items if isinstance(x, Node) and not x.cut and (x.tag in HEADINGS or heading.get(x))), None)
        heading[n] = first and (first.tag if first.tag in HEADINGS else heading[first])
    alike = [x for n in path if n.tag != "body" and n.parent in path and heading[n] for x in n.parent.items if isinstance(x, Node) and x not in path and not x.cut and (x.tag, heading[x]) == (n.tag, heading[n]) and 2 * x.link_chars < x.chars]
    # inline parts are kept with the block that they stand in
    whole = {}
    for n in reversed(order):
        whole[n] = n if n.tag in BLOCK or n in path or n.parent in path else whole[n.parent]
    kept = {marked[whole[n]] or whole[n] for n in (best, *largest.values(), *reach, *alike)}
    held, out = set(), []
    for n in reversed(order):
        if n.parent in held:
            held.add(n)
        elif n in kept:
            held.add(n)
            out.append(n)
    at = {n: i for i, n in enumerate(order)}
    return sorted(out, key=at.__getitem__)


def lines(node: Node) -> list[str]:
    """The blocks of a subtree's text."""
    out, now = [], []

    def flush() -> None:
        text = " ".join("".join(now).split())
        now.clear()
        if text:
            out.append(text)

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif not x.cut or x is node:
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(x.items)
    flush()
    return out


def main_text(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    return "\n".join(x for node in chosen(tree(html)) for x in lines(node))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with text__ in place of the html column."""
    at = pages.columns.index(column)
    others = [c for c in pages.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 200):
                b = whole.slice(first, 200)
                text = pa.array([main_text(x.as_py()) for x in b.column(at)], pa.string())
                kept = [c for i, c in enumerate(b.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*kept, text], names=[str(i) for i in range(len(kept) + 1)])

    plain, _ = numbered(pages)
    _, schema = numbered(pages.select(*[F.col(f"`{c}`") for c in others]), f"`{len(others)}` string")
    done = map_texts(plain, run, schema)
    return done.toDF(*others, "text__")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", F.col("text__").alias("text"), F.length("text__").cast("long").alias("n_chars"))
