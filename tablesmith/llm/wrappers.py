"""Main text of web pages by wrapper induction.

Every page is aligned with its host's first page (by hash) with simple tree matching: two trees match where their tags
and classes do, and a dynamic programme over children keeps their order. A slot (path of tags and classes) is template if
aligned nodes have the same text in it on at least ``MIN_SAME`` different pages, and no page of the host, aligned there
or not, holds another text in it; any other slot is content. Regions that by tag, role or class name are
menus, headers, footers, sidebars, notices, adverts, forms or comments are left out also where they vary. Every page is
then read with its host's wrapper; a host with too few different pages has an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tablesmith.llm.common import written

#: A slot is template if it was the same on so many different pages as on the host's first, and never different.
MIN_SAME = 4
#: First pages and wrappers are broadcast up to so many rows and characters; their number grows with the hosts.
BROADCAST_ROWS, BROADCAST_CHARS = 20_000, 1 << 25
#: First pages held as trees, counts of slots held, and shapes of subtrees held, before they are passed on or made anew.
_TREES, _SLOTS, _SHAPES = 256, 50_000, 200_000

VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
LEFT_OUT = set("aside button dialog footer form head header iframe menu nav noscript object script select style svg template textarea title".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMES = set(
    "ad ads adsense advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login "
    "masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted related replies reply share sharing sidebar signup "
    "social sponsor sponsored subscribe toolbar widget".split())
#: An opening tag closes these open ones.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("article aside body div footer form header html main nav ol section table td th ul blockquote".split())


class Node:
    __slots__ = ("tag", "name", "hidden", "children", "shape", "size")

    def __init__(self, tag: str, attrs: dict[str, str | None]) -> None:
        words = re.split(r"[\s_-]+", f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower())
        self.tag = tag
        self.name = f"{tag}.{attrs['class'].strip().split()[0]}" if (attrs.get("class") or "").strip() else tag
        self.hidden = (
            tag in LEFT_OUT or (attrs.get("role") or "").lower() in ROLES or "hidden" in attrs
            or tag not in ("html", "body", "article", "main") and not NAMES.isdisjoint(words)
            or tag not in ("html", "body") and any(w.startswith("comment") or w.endswith(("comment", "comments")) for w in words))
        self.children: list[Node | str] = []


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag in BLOCK:
            self._close({"p"}, SCOPES)
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPES - CLOSES[tag])
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        if tag == "html":
            return
        # An inline end tag does not close blocks around it.
        self._close({tag}, set() if tag in BLOCK else BLOCK)

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def _close(self, tags, stop):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _nodes(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node)]


def own_text(node: Node) -> str:
    return " ".join("".join(c for c in node.children if isinstance(c, str)).split())


class Shapes:
    """Numbers for the shapes of subtrees (names in order, texts left out), and matches of two shapes: pages of a host share most."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.matches: dict[tuple[int, int], int] = {}

    def number(self, root: Node) -> None:
        order, todo = [], [root]
        while todo:
            node = todo.pop()
            order.append(node)
            todo += _nodes(node)
        for node in reversed(order):
            key = (node.name, *[c.shape for c in node.children if isinstance(c, Node)])
            node.shape = self.numbers.setdefault(key, len(self.numbers))
            node.size = 1 + sum(c.size for c in node.children if isinstance(c, Node))


def _apart(xs: list[Node], ys: list[Node]) -> tuple[int, int]:
    """How many children in front and at the end have equal shapes: matching these with each other is always best."""
    n, front, back = min(len(xs), len(ys)), 0, 0
    while front < n and xs[front].shape == ys[front].shape:
        front += 1
    while back < n - front and xs[-1 - back].shape == ys[-1 - back].shape:
        back += 1
    return front, back


def match(a: Node, b: Node, matches: dict) -> int:
    """Nodes in the largest match of two numbered trees that keeps tags, classes and order; ``matches`` gets those of all shapes met."""
    todo = [(a, b)] if a.name == b.name and a.shape != b.shape else []
    # A list as stack: pages nest deeper than Python's own.
    while todo:
        x, y = todo[-1]
        if (x.shape, y.shape) not in matches:
            xs, ys = _nodes(x), _nodes(y)
            front, back = _apart(xs, ys)
            ends = sum(c.size for c in [*xs[:front], *xs[len(xs) - back:]])
            xs, ys = xs[front:len(xs) - back], ys[front:len(ys) - back]
            missing = [(c, d) for c in xs for d in ys if c.name == d.name and c.shape != d.shape and (c.shape, d.shape) not in matches]
            if missing:
                todo += missing
                continue
            matches[x.shape, y.shape] = 1 + ends + _table(xs, ys, matches)[-1][-1]
        todo.pop()
    return _weight(a, b, matches)


def _weight(x: Node, y: Node, matches: dict) -> int:
    return x.size if x.shape == y.shape else matches.get((x.shape, y.shape), 0) if x.name == y.name else 0


def _table(xs: list[Node], ys: list[Node], matches: dict) -> list[list[int]]:
    rows = [[0] * (len(ys) + 1)]
    for x in xs:
        last, row = rows[-1], [0]
        for j, y in enumerate(ys):
            row.append(max(row[-1], last[j + 1], last[j] + _weight(x, y, matches)))
        rows.append(row)
    return rows


def aligned(a: Node, b: Node, matches: dict) -> Iterator[tuple[Node, Node]]:
    """The matched nodes of two numbered trees."""
    match(a, b, matches)
    todo = [(a, b)] if a.name == b.name else []
    while todo:
        a, b = todo.pop()
        yield a, b
        xs, ys = _nodes(a), _nodes(b)
        front, back = (len(xs), 0) if a.shape == b.shape else _apart(xs, ys)
        todo += [*zip(xs[:front], ys), *zip(xs[len(xs) - back:], ys[len(ys) - back:])]
        xs, ys = xs[front:len(xs) - back], ys[front:len(ys) - back]
        rows = _table(xs, ys, matches)
        i, j = len(xs), len(ys)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((xs[i], ys[j]))


def slots(root: Node) -> Iterator[tuple[str, Node]]:
    """All nodes with their slots."""
    stack = [("html", root)]
    while stack:
        path, node = stack.pop()
        yield path, node
        stack += [(f"{path}/{c.name}", c) for c in _nodes(node)]


def extract(html: str | None, template: set[str] | frozenset = frozenset()) -> str:
    """The blocks of the page's article, or of its body if it has none, without what the wrapper knows as template."""
    root = parse(html or "")

    def articles(node: Node) -> list[tuple[str, Node]]:
        out, stack = [], [("html", node)]
        while stack:
            path, at = stack.pop()
            if at.hidden:
                continue
            if at.tag in ("article", "main"):
                out.append((path, at))
            else:
                stack += reversed([(f"{path}/{c.name}", c) for c in _nodes(at)])
        return out

    blocks: list[str] = []
    run: list[str] = []

    def flush():
        text = " ".join("".join(run).split())
        if text:
            blocks.append(text)
        run.clear()

    # A list as stack: pages nest deeper than Python's own.
    for top, region in articles(root) or [("html", root)]:
        stack: list = [("open", top, region)]
        while stack:
            kind, path, item = stack.pop()
            if kind == "text":
                run.append(item)
            elif kind == "flush":
                flush()
            elif item.tag == "br":
                run.append(" ")
            elif item is region or not item.hidden:
                block = item.tag in BLOCK
                if block:
                    flush()
                    stack.append(("flush", "", None))
                quiet = path in template
                for c in reversed(item.children):
                    if isinstance(c, Node):
                        stack.append(("open", f"{path}/{c.name}", c))
                    elif not quiet:
                        stack.append(("text", "", c))
        flush()
    return "\n\n".join(blocks)


def host(url: Column) -> Column:
    """Host name in lower case; empty for a null or odd URL."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, h, html, first) to what the pages say of their first page's slots: ``low`` and ``high`` of the hashes of texts that
    they hold there, and the hashes ``page`` of up to ``MIN_SAME`` pages whose aligned text is the same."""
    shapes, trees = Shapes(), {}
    low: dict[tuple[str, str], int] = {}
    high: dict[tuple[str, str], int] = {}
    same: dict[tuple[str, str], set[int]] = {}

    def out() -> pa.RecordBatch:
        rows = [(*k, low[k], high[k], page) for k in low for page in same.get(k) or [None]]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["host", "slot", "low", "high", "page"])

    def known(name: str, html: str) -> tuple[Node, dict[int, str], set[str]]:
        if name not in trees:
            if len(trees) >= _TREES:
                trees.clear()
            root = parse(html)
            shapes.number(root)
            found = {id(node): path for path, node in slots(root)}
            trees[name] = root, found, set(found.values())
        return trees[name]

    for batch in batches:
        for name, h, html, first in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if len(shapes.numbers) + len(shapes.matches) > _SHAPES:
                shapes = Shapes()
                trees.clear()
            root, path_of, wanted = known(name, first)
            page = parse(html)
            for slot, node in slots(page):
                if slot in wanted:
                    k, x = (name, slot), xxhash.xxh64_intdigest(own_text(node)) - (1 << 63)
                    low[k], high[k] = min(low.get(k, x), x), max(high.get(k, x), x)
            if html != first:
                shapes.number(page)
                for x, y in aligned(root, page, shapes.matches):
                    text, pages = own_text(x), same.setdefault((name, path_of[id(x)]), set())
                    if text and len(pages) < MIN_SAME and text == own_text(y):
                        pages.add(h)
            if len(low) > _SLOTS:
                yield out()
                low, high, same = {}, {}, {}
    yield out()


def _small(df: DataFrame, text: str | None = None) -> DataFrame:
    chars = F.sum(F.length(text)) if text else F.lit(0)
    n, size = df.agg(F.count("*"), chars).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_CHARS else df


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, slots) for every host with a template.

    The host's page with the smallest hash of its html comes first; picking it is an aggregate that combines before the shuffle.
    All pages are compared with it where they lie, and only counts of slots are moved.
    """
    rows = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).where("host <> '' AND html IS NOT NULL")
    hashed = rows.withColumn("h", F.xxhash64("html"))
    picked = written(hashed.groupBy("host").agg(F.min("h").alias("h")), "picked")
    first = hashed.join(_small(picked), ["host", "h"]).groupBy("host").agg(F.min("html").alias("first"))
    texts = hashed.join(_small(written(first, "first"), "first"), "host").select("host", "h", "html", "first").mapInArrow(
        _compared, "host string, slot string, low bigint, high bigint, page bigint")
    # Minimum and maximum of the hashes tell whether a slot holds more than one text.
    seen = texts.groupBy("host", "slot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count_distinct("page").alias("same"))
    return written(seen.where(f"low = high AND same >= {MIN_SAME}").groupBy("host").agg(F.collect_list("slot").alias("slots")), "wrappers")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``; null and empty pages have empty text.

    A page without a host name is read without a wrapper. Repeated rows give repeated results, ties between picked
    pages go by hash, and pages of any length and depth are read whole. Further columns are left out. An empty table gives none.
    """
    known = wrappers(pages, url_col, html_col)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("host"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, frozenset(s or ())) for h, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return rows.join(_small(known), "host", "left").select("page_id", "url", "html", "slots").mapInArrow(
        read, f"page_id {kind}, url string, text string, n_chars bigint")
