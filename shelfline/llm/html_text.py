"""Main text of web pages by composite text density.

Method. A page becomes a tree of its block elements; inline markup belongs to the block it stands in. Every node has characters C, tags T
(itself not counted, at least one), and both inside links, LC and LT. Its density is the characters per tag, C / T, times
ln(C * T / (LC * LT)) / ln(1 + ln(e + C * LC / (C - LC) + C * LCb / Cb)), where b is the body: text in links counts little, and less on
pages with few links. The density sum of a node is the sum over its children (a leaf's is its own density, loose text is a leaf). The
node with the greatest sum is the core of the article. The least density on the path from it to the body is the threshold: the core
grows to its parent as long as what the parent adds reaches it, and it grows to an enclosing article or main element at
once. A core above a single article element shrinks to that element.

Before that, elements that say what they are go: navigation, footers, page headers, asides, forms, scripts, styles, dialogs, hidden
elements, and elements whose class, id or role names an advert, a notice, a menu, a sidebar, sharing, related links or comments. The
greatest article or main element is never inside such a removal. A header inside an article keeps its headings.

Text: character references are decoded, white space inside a block becomes one space, blocks in page order are joined by line feeds.
A line break element and a table cell's end are white space, a table row is a block. Preformatted text is treated alike.

Reading is tolerant: end tags may lack, paragraphs end where a block begins, stray end tags are skipped, raw elements (scripts, styles)
end only at their own end tag, unclosed comments and tags reach the end of the page. Work and memory of a page are linear in its
length, and no step is recursive. Pages are independent rows: no shuffle.

Defined results: null or empty html gives an empty text. Null ids and urls, repeated rows and rows with equal ids are rows of their own.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: HTML's element kinds, fixed by the standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
                  "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
CELLS = frozenset(("td", "th"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: An element of the key ends open elements of the values, up to the nearest of the barriers.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": CELLS, "th": CELLS, "option": ("option",), "optgroup": ("option", "optgroup"),
        "thead": ("tr", "tbody", "thead"), "tbody": ("tr", "tbody", "thead"), "tfoot": ("tr", "tbody", "thead")}
BARRIERS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",),
            "optgroup": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}

PARAGRAPH_BARRIERS = ("table", "td", "th", "button", "li", "dd", "blockquote", "div", "section", "article")

#: Elements that are never part of an article.
APART = frozenset("nav footer aside form script style noscript template dialog menu iframe svg math canvas object select button textarea title head header "
                  "xmp noembed noframes datalist audio video map search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Words of a class or id that name something else than the article.
NAMES = frozenset("""ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox banner banners sponsor sponsored sponsors promo promos promotion
    nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer masthead topbar cookie cookies consent gdpr notice notices notification
    notifications alert popup modal overlay paywall newsletter subscribe subscription signup login comment comments disqus reply replies respond
    discussion share sharing sharebar social related recommended recommendations pagination pager toolbar widget widgets""".split())
PAGE_HEADERS = frozenset("header site-header page-header top-header main-header global-header top-bar".split())
#: Names that the wrapper of a whole page may also have ("has-sidebar").
LAYOUT_NAMES = frozenset("nav navbar navigation menu menus sidebar sidebars aside footer header widget widgets related banner banners toolbar".split())
COMMENT_NAMES = frozenset("comment comments disqus reply replies respond discussion".split())

TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|</[^>]*(?:>|\Z)"""
                   r"""|<([A-Za-z][^\s/>]*)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """A block element. Parts are texts and nodes in page order; inline elements only add to the tag counts."""

    __slots__ = ("tag", "parent", "parts", "apart", "names", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, apart: int = 0, names: frozenset[str] = frozenset()):
        self.tag, self.parent, self.apart, self.names = tag, parent, apart, names
        self.parts: list[str | Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), html.unescape(next(filter(None, values), "")))
    return found


def stands_apart(tag: str, source: str) -> tuple[int, frozenset[str]]:
    """How surely an element says that it is no part of an article (2 by kind, 1 by name or as a form), and the telling words of its names."""
    kind = (1 if tag == "form" else 2) if tag in APART else 0
    if not source.strip():
        return kind, frozenset()
    given = attributes(source)
    names = given.get("class", "") + " " + given.get("id", "")
    words = frozenset(w.lower() for w in NAME_WORD.findall(names)) & NAMES
    if PAGE_HEADERS & frozenset(names.lower().split()):
        words |= {"header"}
    if ("hidden" in given or given.get("aria-hidden", "").lower() == "true" or HIDDEN.search(given.get("style", ""))
            or given.get("role", "").lower() in ROLES):
        kind = 2
    named = bool(words) and tag != "main" and (tag != "article" or bool(words & COMMENT_NAMES))
    return max(kind, int(named)), words


class Open:
    """The open elements, with the places of every tag, so that no step looks through them."""

    def __init__(self, root: Node):
        self.elements = [("html", root)]
        self.places: defaultdict[str, list[int]] = defaultdict(list)

    def push(self, tag: str, node: Node) -> None:
        for name in (tag, "block") if tag in BLOCK or tag in CELLS else (tag,):
            self.places[name].append(len(self.elements))
        self.elements.append((tag, node))

    def last(self, tags: Iterable[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def close(self, tags: Iterable[str], barriers: Iterable[str] = ()) -> bool:
        """End the innermost element of these tags and all inside it, unless a barrier stands inside it."""
        at = self.last(tags)
        if at <= self.last(barriers):
            return False
        for tag, _ in reversed(self.elements[at:]):
            for name in (tag, "block") if tag in BLOCK or tag in CELLS else (tag,):
                self.places[name].pop()
        del self.elements[at:]
        return True


def page_tree(source: str) -> list[Node]:
    """The blocks of a page in page order, the root first. Inline elements that stand apart (an advert in a span) are nodes too."""
    root = Node("html", None)
    nodes, opened = [root], Open(root)
    links = opened.places["a"]

    def add_text(text: str) -> None:
        node = opened.elements[-1][1]
        node.parts.append(text)
        size = len(text) - text.count(" ")
        node.chars += size
        node.link_chars += size if links else 0

    position = 0
    while position < len(source):
        token = TOKEN.search(source, position)
        text_end = token.start() if token else len(source)
        if text_end > position:
            add_text(html.unescape(source[position:text_end]))
        if token is None:
            break
        position = token.end()
        end, start, rest = token.groups()
        tag = (end or start or "html").lower()
        if tag in ("html", "body"):
            # also comments, doctypes and empty end tags: they leave nothing
            continue
        if end:
            if tag in CELLS or tag == "br":
                add_text(" ")
            # the end tag of an inline element does not end the blocks inside it
            opened.close((tag,), ("table",) if tag in CELLS else () if tag in BLOCK else ("block",))
            continue
        if tag in BLOCK:
            opened.close(("p",), PARAGRAPH_BARRIERS)
        if tag in ENDS:
            opened.close(ENDS[tag], BARRIERS[tag])
        if tag in HEADINGS and opened.elements[-1][0] in HEADINGS:
            opened.close((opened.elements[-1][0],))
        if tag == "a" and links:
            opened.close(("a",), ("block",))
        parent = opened.elements[-1][1]
        parent.tags += 1
        parent.link_tags += tag == "a" or bool(links)
        if tag in ("br", "img") or tag in CELLS:
            add_text(" ")
        if tag in RAW:
            closing = RAW_END[tag].search(source, position)
            position = source.find(">", closing.start()) + 1 if closing else 0
            position = position or len(source)
            continue
        apart, words = stands_apart(tag, rest)
        node = parent
        if tag in BLOCK or apart:
            node = Node(tag, parent, apart, words)
            parent.parts.append(node)
            nodes.append(node)
        if tag not in VOID and (tag in BLOCK or not rest.endswith("/")):
            opened.push(tag, node)
    return nodes


def below(nodes: list[Node], starts) -> set[int]:
    """Identities of the nodes that satisfy a test and of all below them; parents come first."""
    found: set[int] = set()
    for node in nodes:
        if node.parent is not None and id(node.parent) in found or starts(node):
            found.add(id(node))
    return found


def sums(nodes: list[Node], without: set[int]) -> dict[int, int]:
    """Characters of every node and what is below it, without some nodes."""
    sizes = {id(n): 0 if id(n) in without else n.chars for n in nodes}
    for node in reversed(nodes[1:]):
        sizes[id(node.parent)] += sizes[id(node)]
    return sizes


def cleaned(nodes: list[Node]) -> list[Node]:
    """The nodes that stay, with counts summed over what stays below each."""
    # the greatest article that is not in an aside, a comment or the like; a name or a form around it does not remove it
    strict = below(nodes, lambda n: n.apart == 2 or n.apart and n.names & COMMENT_NAMES)
    sizes = sums(nodes, strict)
    article = max((n for n in nodes if n.tag in ("article", "main") and id(n) not in strict), key=lambda n: sizes[id(n)], default=None)
    holders, node = set(), article
    while node is not None:
        holders.add(id(node))
        node = node.parent
    # without an article element, a form or a layout name around most of what is left is the page's wrapper
    layout = {id(n) for n in nodes if n.apart == 1 and n.names <= LAYOUT_NAMES}
    sizes = sums(nodes, strict | below(nodes, lambda n: n.apart == 1 and id(n) not in layout))
    wrappers = {i for i in layout if 2 * sizes[i] > sizes[id(nodes[0])]} if article is None else set()
    inside = below(nodes, lambda n: n.parent is not None and n.parent.tag in ("article", "main"))
    headers = {id(n) for n in nodes if n.tag == "header" and id(n) in inside}
    exempt = holders | wrappers | headers | {id(nodes[0])}
    gone = below(nodes, lambda n: n.apart and id(n) not in exempt)
    # of a header inside an article only the headings stay
    bare = below(nodes, lambda n: id(n) in headers) - below(nodes, lambda n: n.tag in HEADINGS)
    stay = [n for n in nodes if id(n) not in gone]
    for node in stay:
        node.parts = [p for p in node.parts if (id(node) not in bare if isinstance(p, str) else id(p) not in gone)]
        if id(node) in bare:
            node.chars = node.link_chars = 0
    for node in reversed(stay[1:]):
        up = node.parent
        up.chars, up.tags, up.link_chars, up.link_tags = up.chars + node.chars, up.tags + node.tags, up.link_chars + node.link_chars, up.link_tags + node.link_tags
    return stay


def density(chars: int, tags: int, link_chars: int, link_tags: int, body: Node) -> float:
    if not chars:
        return 0.0
    tags, own = max(tags, 1), max(chars - link_chars, 1)
    links = math.log(1 + math.log(math.e + chars * link_chars / own + chars * body.link_chars / max(body.chars, 1)))
    return chars / tags * math.log(1 + chars * tags / (max(link_chars, 1) * max(link_tags, 1))) / links


def article_of(nodes: list[Node]) -> Node:
    """The core of the article, from cleaned nodes."""
    body = nodes[0]
    for node in nodes:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, body)
        loose = sum(len(p) - p.count(" ") for p in node.parts if isinstance(p, str) and not p.isspace())
        inner = any(not isinstance(p, str) for p in node.parts)
        node.total = density(loose, 1, 0, 0, body) if inner else node.density
    for node in reversed(nodes[1:]):
        node.parent.total += node.density
    core = max(nodes, key=lambda n: n.total)
    path = [core]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    marked = [n for n in path if n.tag == "article"] or [n for n in path if n.tag == "main"]
    if marked:
        return marked[-1]
    inside = below(nodes, lambda n: n is core)
    held = below(nodes, lambda n: n.parent is not None and n.parent.tag in ("article", "main"))
    tops = [n for n in nodes if n.tag in ("article", "main") and id(n) in inside and id(n) not in held]
    if len(tops) == 1:
        return tops[0]
    threshold = min(n.density for n in path)
    for up in path[1:]:
        added = density(up.chars - core.chars, up.tags - core.tags, up.link_chars - core.link_chars, up.link_tags - core.link_tags, body)
        if up.chars > core.chars and added < threshold:
            break
        core = up
    return core


def block_texts(top: Node) -> Iterator[str]:
    """Texts of the blocks under a node, in page order."""
    run: list[str] = []
    todo: list[str | Node | None] = [top]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            run.append(part)
            continue
        # a block begins or ends here (None), so the text so far is a block of its own
        if part is None or part.tag in BLOCK:
            if text := " ".join("".join(run).split()):
                yield text
            run = []
        if part is not None:
            if part.tag in BLOCK:
                todo.append(None)
            todo.extend(reversed(part.parts))
    if text := " ".join("".join(run).split()):
        yield text


def main_text(source: str | None) -> str:
    return "\n".join(block_texts(article_of(cleaned(page_tree(source or "")))))


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    kept = pages.select("page_id", "url", F.col("html").alias("text"))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(source.as_py()) for source in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return kept.mapInArrow(extracted, kept.schema).withColumn("n_chars", F.char_length("text").cast("long"))
