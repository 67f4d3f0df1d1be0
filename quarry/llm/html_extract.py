"""Main text of web pages, with site templates removed.

Pages are parsed leniently and in one pass forward: comments, declarations and raw-text elements are skipped, end tags
may be missing, attribute values may hold ``>``. Every element subtree is hashed, bottom-up in one pass,
seeded by its host, and the hashes are counted over the distinct pages of that host:

    exact     element, class and id (digits as one), and the texts (white space as one) of block
              subtrees outside ``article`` and ``main``, or anywhere if a page has neither
    menu      the same place; element, class and id, and the set of those of its subtrees, without any text, of block
              subtrees whose text is links for four fifths and more (three links at least)
    shape     what a menu has and the path from the root, of the containers that lie outside the ``article`` or ``main`` of
              their page, hold none, and are short (``LONG``) or half links; paragraphs and headings are none
    marked    element, class and id of subtrees that name themselves menu, footer, notice, advert, form,
              sidebar, comments or the like

One rule holds for hosts of all sizes. A shape is a template of its host, and goes, from three distinct pages (two of two); a name counts as one page
more, so what is marked goes from two. Exact subtrees and menus, which may lie in the text, need eight pages, or half of the host's and three. Pages
of equal main text count as one, so a page that was crawled often is not its own template. What recurs inside an
article is its text, unless it is marked.

Elements that hold no article text in HTML (``nav``, ``footer``, ``form``, ``script`` and so on) always go. A host of one or two
pages tells nothing by counts: there the name alone decides. A class
or id marks if all its words are in ``NAMES`` or ``NEUTRAL`` and one is in ``NAMES``: ``share price`` marks nothing.

Counting is pre-aggregated in each task. The templates of all hosts are counted: up to ``BROADCAST_HASHES`` they are
broadcast as one sorted array; beyond that they are joined with the subtrees of each distinct page, so
what joins a page is bounded by the page, however many templates its host has.

The text is all that is left of the page. Every block element is one line: references decoded, white space runs one blank,
trimmed; empty blocks are left out. ``br`` is white space. Defined results: null or empty html gives an empty text; a page without a host is
not compared with others; repeated rows get equal texts; depth is not limited; an empty table gives an empty result; other columns are not read,
whatever their names. Parsing takes time in proportion to the page, whatever is left open in it: a quote that nothing closes
ends the hiding of ``>`` by quotes for the rest of its page.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Container, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _scratch
from . import _text as tx

MANY_PAGES, SHARE, LEAST_PAGES = 8, 0.5, 3
SHAPE_PAGES = 3
LONG = 1000
MENU_LINKS, MENU_SHARE = 3, 0.8
#: Up to so many hashes of all hosts together (4 MB), the templates are broadcast.
BROADCAST_HASHES = 500_000
#: Kinds of counted things; a host of many pages is one.
HOST, EXACT, MENU, MARKED, SHAPE = range(5)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("nav aside footer form script style noscript template iframe button select textarea input object embed canvas audio video dialog head title menu search xmp noembed".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search comment comments commentlist disqus replies respond discussion share sharing social related recommended pagination pager toolbar widget skip".split())
NEUTRAL = frozenset("left right top bottom main primary secondary wrapper wrap container box block inner outer area section site page global bar list item items row links link icons reader user the and by".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
CONTAINERS = frozenset("address aside center details dialog dir div dl fieldset figure footer form header hgroup menu nav ol search section summary table ul".split())
WHOLE = frozenset("html body article main #".split())
#: A start tag of the key ends an open element named in the value.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
UNSEEN = frozenset("script style head title template noscript iframe".split())
SCOPES = frozenset("ul ol dl table select body html article section div".split())

_ENDED = frozenset(x for own in ENDS.values() for x in own)
_NAME, _STOP = re.compile(r"[a-zA-Z][^\s/>]*"), re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD, _DIGITS = re.compile(r"[^\W_]+"), re.compile(r"\d+")
_HOST = r"^(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


class Node:
    __slots__ = ("tag", "dropped", "marked", "shape", "children", "exact", "frame", "holds", "size", "linked", "links")

    def __init__(self, tag: str, dropped: bool = False, marked: bool = False, shape: str = ""):
        self.tag, self.dropped, self.marked, self.shape = tag, dropped, marked, shape
        self.children: list[Node | str] = []


def _named(tag: str, attributes: str, in_article: bool) -> tuple[bool, str]:
    """Whether class, id or role mark the element, and the shape of class and id."""
    if "=" not in attributes:
        return False, ""
    marked, shape = False, []
    for name, value in _ATTRIBUTE.findall(attributes):
        value = value.strip("\"'").lower()
        parts = _WORD.findall(value)
        if name.lower() == "role":
            marked |= any(x in ROLES for x in value.split())
            continue
        shape.append(_DIGITS.sub("0", " ".join(sorted(value.split()))))
        names = NAMES if in_article else NAMES | {"header"}
        marked |= any(x in names for x in parts) and all(x in names or x in NEUTRAL or x.isdecimal() for x in parts)
    return marked and tag not in WHOLE - {"article"}, "|".join(shape)


def tags(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether an end tag, name, attributes) of the tags in order, name and attributes empty for comments and declarations. Takes
    ``send(place)`` to go on from there."""
    at, n, last, quotes = 0, len(html), html.rfind(">"), True
    while True:
        start = html.find("<", at)
        if start < 0:
            return
        if start > last:  # nothing is closed from here on
            odd = [x for x in (html.find("<!", start), html.find("<?", start)) if x >= 0]
            cut = html.rfind("<")
            cut = min(odd) if odd else cut if re.match(r"</?[a-zA-Z]", html[cut : cut + 3]) else n
            if cut < n:
                yield cut, n, False, "", ""
            return
        if html.startswith("<!--", start):
            over = html.find("-->", start + 4)
            at = n if over < 0 else over + 3
            yield start, at, False, "", ""
            continue
        if html[start + 1 : start + 2] in ("!", "?"):
            at = html.find(">", start) + 1
            yield start, at, False, "", ""
            continue
        slash = html.startswith("/", start + 1)
        name = _NAME.match(html, start + 1 + slash)
        if name is None:
            at = start + 1
            continue
        end, look = -1, name.end()
        while quotes:
            stop = _STOP.search(html, look)
            if stop is None or stop[0] == ">":
                end = stop.start() if stop else -1
                break
            look = html.find(stop[0], stop.end()) + 1
            if not look:
                break
        if end < 0:
            quotes, end = False, html.find(">", name.end())
        at = end + 1
        to = yield start, at, slash, name[0].lower(), html[name.end() : end]
        if to is not None:
            at = to
            yield at, at, False, "", ""


def parse(html: str) -> Node:
    """The page as a tree."""
    root = Node("#")
    stack, n = [root], len(html)
    opened: dict[str, list[int]] = {}  # places in the stack, by element
    blocks: list[int] = []
    ends: list[int] = []
    wholes: list[int] = []

    def close(to: int) -> None:
        while len(stack) > to:
            opened[stack.pop().tag].pop()
        for places in (blocks, ends, wholes):
            while places and places[-1] >= to:
                places.pop()

    found, text = tags(html), 0
    for start, end, slash, tag, attributes in found:
        if start > text:
            stack[-1].children.append(html[text:start])
        text = end
        if not tag:
            continue
        if slash:
            at = opened.get(tag)
            if at and (tag in BLOCK or not wholes or wholes[-1] <= at[-1]):
                close(at[-1])
            continue
        if tag in BLOCK:
            if blocks and stack[blocks[-1]].tag == "p":  # a block ends an open paragraph
                close(blocks[-1])
            if tag in ENDS:
                k = len(ends) - 1
                while k >= 0 and stack[ends[k]].tag not in SCOPES:
                    if stack[ends[k]].tag in ENDS[tag]:
                        close(ends[k])
                    k -= 1
        in_article = bool(opened.get("article") or opened.get("main"))
        marked, shape = _named(tag, attributes, in_article)
        node = Node(tag, tag in DROPPED or (tag == "header" and not in_article), marked, shape)
        stack[-1].children.append(node)
        if tag in RAW:
            over = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(html, end)
            text = over.end() if over else n
            found.send(text)
        elif tag not in VOID and not (attributes.endswith("/") and tag not in BLOCK):
            k = len(stack)
            opened.setdefault(tag, []).append(k)
            for places, kind in ((blocks, BLOCK), (ends, _ENDED | SCOPES), (wholes, WHOLE)):
                if tag in kind:
                    places.append(k)
            stack.append(node)
    if text < n:
        stack[-1].children.append(html[text:])
    return root


def _print(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed) - (1 << 63)


def _seed(host: str) -> int:
    return xxhash.xxh64_intdigest(host)


def host_mark(seed: int) -> int:
    """What stands among the templates for a host of three pages and more."""
    return _print("host", seed)


class Sorted:
    """A set of 64-bit numbers in a sorted array."""

    def __init__(self, values: array):
        self.values = values

    def __contains__(self, x: int) -> bool:
        at = bisect_left(self.values, x)
        return at < len(self.values) and self.values[at] == x

    def __len__(self) -> int:
        return len(self.values)


def digest(root: Node, seed: int) -> list[Node]:
    """All nodes, parents first, with their hashes, text sizes and links filled in."""
    nodes = [root]
    for node in nodes:  # grows while it is read
        nodes += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(nodes):
        texts, frames = [], set()
        size = linked = links = 0
        holds = node.tag in ("article", "main")
        for c in node.children:
            if isinstance(c, str):
                text = " ".join(c.split())
                if text:
                    texts.append(text)
                    size += len(text)
            else:
                texts.append(f"\1{c.exact}")
                size, linked, links, holds = size + c.size, linked + c.linked, links + c.links, holds or c.holds
                if c.tag in BLOCK or c.tag == "a":
                    frames.add(c.frame)
        if node.tag == "a":
            linked, links = size, 1
        node.size, node.linked, node.links, node.holds = size, linked, links, holds
        node.exact = _print("\0".join((node.tag, node.shape, *texts)), seed)
        own = () if node.marked or node.dropped else sorted(frames)
        node.frame = _print("\2".join((node.tag, node.shape, *map(str, own))), seed)
    return nodes


def counted(nodes: list[Node]) -> list[tuple[int, int, Node]]:
    """Kind, hash and node of the subtrees that may be templates."""
    root, out = nodes[0], []
    has_article = root.holds
    todo = [(root, False, 0)]
    while todo:
        node, inside, path = todo.pop()
        inside = inside or has_article and node.tag in ("article", "main")
        if node.dropped or node.marked:
            out.append((MARKED, node.frame, node))
        if node.dropped:
            continue
        if node.tag in BLOCK and node.tag not in WHOLE and not inside and node.size and not any(isinstance(c, Node) and c.tag in WHOLE for c in node.children):
            out.append((EXACT, node.exact, node))
            if node.links >= MENU_LINKS and node.linked >= MENU_SHARE * node.size:
                out.append((MENU, node.frame, node))
        if has_article and not inside and not node.holds and node.tag in CONTAINERS and node.size and (node.size <= LONG or node.linked * 2 >= node.size):
            out.append((SHAPE, _print(f"{path}\4{node.frame}"), node))
        if has_article and not inside and node.tag in BLOCK:
            path = _print(f"{path}\3{node.tag}\3{node.shape}")
        todo += [(c, inside, path) for c in node.children if isinstance(c, Node)]
    return out


def subtrees(html: str, seed: int = 0) -> set[tuple[int, int]]:
    """Kind and hash of the subtrees that may be templates."""
    return {(kind, h) for kind, h, _ in counted(digest(parse(html), seed))}


def _lines(root: Node, gone: Container[int]) -> str:
    """The text of a tree without the nodes whose ``id`` is in ``gone``."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    todo: list = [root]
    while todo:
        node = todo.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            line.append(unescape(node))
        elif node.tag == "br":
            line.append(" ")
        else:
            block = node.tag in BLOCK or node.tag == "#"
            if block:
                flush()
            if id(node) in gone:
                continue
            if block:
                todo.append(None)
            todo += reversed(node.children)
    flush()
    return "\n".join(blocks)


def extract(html: str, template: Container[int] = frozenset(), seed: int = 0, names: bool | None = None) -> str:
    """The main text without the subtrees in ``template``. ``names``: whether whatever is marked goes,
    and what holds no article text in HTML; by default the latter, and the former unless the host is known to have
    pages to count. False leaves all to the templates but what no reader sees."""
    nodes = digest(parse(html), seed)
    gone = {id(node) for _, h, node in counted(nodes) if h in template}
    marked = names is not False and host_mark(seed) not in template
    for node in nodes:
        if node.tag in UNSEEN or (names is not False and node.dropped) or (marked and node.marked):
            gone.add(id(node))
    return _lines(nodes[0], gone)


def templates(pages: DataFrame) -> DataFrame:
    """``subtree``: the recurring subtrees of all hosts, and the marks of hosts of three pages and more."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches, "html"):
            rows: list[tuple[int, int, int, int]] = []
            for host, html in zip(tx.column(b, "host").to_pylist(), tx.column(b, "html").to_pylist(), strict=True):
                seed = _seed(host)
                nodes = digest(parse(html), seed)
                page = _print(_lines(nodes[0], {id(x) for x in nodes if x.dropped or x.marked}))
                rows += [(seed - (1 << 63), page, kind, h) for kind, h in {(HOST, host_mark(seed)), *((kind, h) for kind, h, _ in counted(nodes))}]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64())], names=["host", "page", "kind", "subtree"])

    known = pages.where("host <> '' and html <> ''").select("host", "html")
    found = known.mapInArrow(emit, "host long, page long, kind int, subtree long")
    counts = found.groupBy("host", "kind", "subtree", "page").count().groupBy("host", "kind", "subtree").agg(F.count("*").alias("n"))  # copies of a page once
    counts = _scratch.write_table(counts.where((F.col("n") >= 2) | (F.col("kind") == HOST)), "subtrees")
    size = counts.where(F.col("kind") == HOST).select("host", F.col("n").alias("pages"))
    kind, n, of = F.col("kind"), F.col("n"), F.col("pages")
    text = kind.isin(EXACT, MENU) & ((n >= MANY_PAGES) | (n >= LEAST_PAGES) & (n >= SHARE * of))
    shape = (kind == SHAPE) & (n >= F.least(F.lit(SHAPE_PAGES), F.greatest(F.lit(2), of)))
    name = kind.isin(MARKED, HOST) & (of >= SHAPE_PAGES) & ((kind == HOST) | (n >= SHAPE_PAGES - 1))
    return counts.join(size, "host").where(text | shape | name).select("subtree").distinct()


def _of_pages(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``key, template``: for each distinct page (host and html) that holds templates, which ones."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches, "html"):
            keys, hashes = [], []
            for key, host, html in zip(tx.column(b, "key").to_pylist(), tx.column(b, "host").to_pylist(), tx.column(b, "html").to_pylist(), strict=True):
                here = {host_mark(_seed(host)), *(h for _, h in subtrees(html, _seed(host)))}
                keys += [key] * len(here)
                hashes += here
            yield pa.record_batch([pa.array(keys, pa.string()), pa.array(hashes, pa.int64())], names=["key", "subtree"])

    held = rows.where("host <> '' and html <> ''").select("key", "host", "html").mapInArrow(emit, "key string, subtree long")
    return held.join(found, "subtree").groupBy("key").agg(F.collect_set("subtree").alias("template"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``."""
    url = F.col("url").cast("string")
    rows = pages.select("page_id", "url", F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1)).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    found = _scratch.write_table(templates(rows), "templates")
    whole = None
    if found.count() <= BROADCAST_HASHES:
        values = np.sort(found.toArrow()["subtree"].to_numpy())
        whole = rows.sparkSession.sparkContext.broadcast(Sorted(array("q", values.tobytes())))
        joined = rows.select("page_id", "url", "host", "html")
    else:
        keyed = rows.withColumn("key", F.md5(F.concat_ws("\n", "host", "html")))
        joined = keyed.join(_of_pages(keyed, found), "key", "left").select("page_id", "url", "host", "html", "template")
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches, "html"):
            hosts, htmls = tx.column(b, "host").to_pylist(), tx.column(b, "html").to_pylist()
            lists = [whole.value] * len(htmls) if whole else [frozenset(t or ()) for t in tx.column(b, "template").to_pylist()]
            texts = [extract(h, t if host else frozenset(), _seed(host)) for host, h, t in zip(hosts, htmls, lists, strict=True)]
            yield pa.record_batch([tx.column(b, "page_id"), tx.column(b, "url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
