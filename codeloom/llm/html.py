"""Main text of web pages: subtrees that recur across a host go first, over whole bodies; what is left decides where the main text lies.

Each page is parsed once, and every element's subtree (its tags and text) gets a hash, keyed with the page's host. Spark
counts on how many pages each key occurs. A subtree is deleted where its key occurs on ``MANY_PAGES`` pages more
than its parent's does: a menu that all pages share goes, while the parts of an article that is copied as a whole occur
as often as the copy itself and stay. Within articles and main elements, prose elements and subtrees that hold ``OWN_SHARE`` of the
main text are never deleted.

Then the page's main text is chosen by what is left: its articles, if they hold half of the page's remaining text, else its main
elements, if those do, else the whole body; so an article that is a mere teaser doesn't hide the text beside it, and template
text doesn't outweigh a short article. Markup drops elements that are boilerplate by tag, and blocks that class, id or role name so. Names never
drop inline elements, and words that prose sections bear as well (``WEAK_HINTS``) drop a block of the main text only where it is mostly links.

What is parsed is written once. Only keys are counted and joined; pages are never grouped by host. Pages whose text no deletion can
change have it settled when they are parsed.

Cases: a null page is an empty one with empty text; a null url has the host ''; a page without elements is taken
as text; unclosed and stray tags are repaired as browsers do; very long pages are parsed whole; repeated rows give repeated results and
count as pages each; further columns are left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_path, small_batches, tidy

MANY_PAGES, OWN_SHARE = 10, 0.2
#: Share of a page's text that its articles need to be its main text, and of links in a block that a weak hint drops.
MAIN_SHARE, LINK_SHARE = 0.5, 0.5

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTR = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HINT = re.compile(r"[a-z]+")
_SPACES = re.compile(r"\s{2,}")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose text is never the article's.
BOILERPLATE = frozenset("head script style noscript template title nav footer aside form button select option textarea iframe svg math object applet audio video canvas dialog menu fieldset datalist label noembed noframes xmp".split())
#: Words of class and id, and values of role, that name boilerplate.
HINTS = frozenset(
    "ad ads adv advert advertisement adsense sponsor sponsored banner nav navbar menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr popup modal overlay "
    "newsletter subscribe subscription signup comment comments disqus respond toolbar pagination pager copyright".split()
)
#: Words that name boilerplate, but parts of an article too.
WEAK_HINTS = frozenset("promo promotion navigation masthead topbar notice alert share sharing social related recommended reply replies widget login search".split())
#: Elements of running text; their names drop nothing.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
BLOCK = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements within the main text that may go where they recur; the others there are prose.
CONTAINER = frozenset("center details div dl figure header ol section span table ul".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "figcaption", "li", "dd", "dt", "summary"}
#: A start tag ends these open elements, looked for no further up than the stops.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
        "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    """An element: its subtree's hash, characters of text in all, in links, and of those that markup doesn't drop; ``zone`` 2 in articles, 1 in main elements."""

    __slots__ = ("tag", "drop", "weak", "kids", "hash", "raw", "links", "chars", "at", "zone")

    def __init__(self, tag: str, drop: bool, weak: bool = False):
        self.tag, self.drop, self.weak, self.kids = tag, drop, weak, []
        self.hash = self.raw = self.links = self.chars = self.zone = 0
        self.at = -1


def _named_boilerplate(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether tag or attributes drop the element for certain, and whether a weak hint names it."""
    if tag in BOILERPLATE:
        return True, False
    weak = False
    if not attrs or tag in ("html", "body", "main", "article"):
        return False, False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True, False
        if tag in INLINE:
            continue
        words = _HINT.findall(value) if name in ("class", "id") else ()
        if name == "role" and value in ROLES or not HINTS.isdisjoint(words):
            return True, False
        weak = weak or not WEAK_HINTS.isdisjoint(words)
    return False, weak


def parse(html: str) -> Node:
    """The page as a tree; text is unescaped, elements without a place are repaired."""
    top = Node("#page", False)
    stack, at = [top], 0

    def text(raw: str) -> None:
        if raw:
            stack[-1].kids.append(unescape(raw) if "&" in raw else raw)

    def close(tags: set[str] | frozenset[str], stops: set[str] | frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in stops:
                return

    while m := _TAG.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if any(n.tag == tag for n in stack):
                close({tag}, set() if tag in BLOCK else {"td", "th", "table"})
            continue
        if tag in CLOSES_P:
            close({"p"}, {"td", "th", "table", "button", "object"})
        if tag in SIBLINGS:
            close(*SIBLINGS[tag])
        node = Node(tag, *_named_boilerplate(tag, m[3]))
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.I).search(html, at)
            node.kids.append(html[at : end.start() if end else len(html)])
            at = end.end() if end else len(html)
        elif tag not in VOID:
            stack.append(node)
    text(html[at:])
    return top


def _measure(top: Node) -> list[Node]:
    """Set zone, hash and sizes of every subtree, children first; the elements that hold text, in page order."""
    order, todo = [], [top]
    while todo:
        n = todo.pop()
        order.append(n)
        n.zone = max(n.zone, {"article": 2, "main": 1}.get(n.tag, 0))
        for k in reversed(n.kids):
            if not isinstance(k, str):
                k.zone = n.zone
                todo.append(k)
    for n in reversed(order):
        h = xxhash.xxh64(n.tag)
        for k in n.kids:
            if isinstance(k, str):
                flat = " ".join(k.split())
                n.raw += len(flat)
                n.chars += len(flat)
                h.update(flat)
            else:
                n.raw += k.raw
                n.links += k.links
                n.chars += k.chars
                h.update(k.hash.to_bytes(8, "little"))
        n.links = n.raw if n.tag == "a" else n.links
        n.drop = n.drop or n.weak and (not n.zone or n.links >= LINK_SHARE * n.raw)
        n.chars = 0 if n.drop else n.chars
        n.hash = h.intdigest()
    return [n for n in order if n.raw]


def _roots(top: Node, tag: str) -> list[Node]:
    """The outermost elements of a tag that hold text and that markup leaves."""
    out, todo = [], [top]
    while todo:
        n = todo.pop()
        if n.tag == tag and n.chars:
            out.append(n)
        elif not n.drop:
            todo += [k for k in reversed(n.kids) if not isinstance(k, str)]
    return out


@dataclass
class Page:
    """Elements that hold text, in page order, and the pieces of text that markup leaves.

    Of an element: its ``key``, its ``parent``'s place (-1: none), whether it may go where it recurs (``open``), and
    whether such text lies in it (``main``). Of a piece: its text, the place of the element it stands in, its block, its zone.
    """

    key: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    open: list[bool] = field(default_factory=list)
    main: list[bool] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    block: list[int] = field(default_factory=list)
    zone: list[int] = field(default_factory=list)

    def chosen(self, hidden: list[bool]) -> int:
        """The least zone of the main text, by the characters that are left in each."""
        size = [0, 0, 0]
        for piece, i, zone in zip(self.pieces, self.at, self.zone):
            if not hidden[i]:
                size[zone] += len("".join(piece.split()))
        whole = sum(size)
        return 2 if size[2] and size[2] >= MAIN_SHARE * whole else 1 if size[1] + size[2] and size[1] + size[2] >= MAIN_SHARE * whole else 0

    def text(self, gone: set[tuple[int, int]] | None = None) -> str:
        """The main text without the subtrees whose (key, parent's key) is in ``gone``."""
        hidden = [False] * (len(self.key) + 1)  # the last place serves pieces that no element holds
        for i, up in enumerate(self.parent) if gone else ():
            hidden[i] = up >= 0 and (hidden[up] or self.open[i] and (self.key[i], self.key[up]) in gone)
        least = self.chosen(hidden)
        runs: dict[int, list[str]] = {}
        for piece, i, block, zone in zip(self.pieces, self.at, self.block, self.zone):
            if zone >= least and not hidden[i]:
                runs.setdefault(block, []).append(piece)
        flat = (" ".join("".join(r).split()) for r in runs.values())
        return "\n".join(f for f in flat if f)

    def settled(self) -> bool:
        """Whether no deletion can change the text: none of its elements may go, and what may go elsewhere only adds to its share."""
        if not any(self.open):
            return True
        least = self.chosen([False] * (len(self.key) + 1))
        holds = [False] * (len(self.key) + 1)
        for i, zone in zip(self.at, self.zone):
            holds[i] = holds[i] or zone >= least
        for i in range(len(self.key) - 1, -1, -1):  # children stand behind their parents
            if holds[i]:
                if self.open[i] and self.parent[i] >= 0:
                    return False
                holds[self.parent[i]] = holds[self.parent[i]] or self.parent[i] >= 0
        return True


def read_page(html: str | None, host: str | None = "", own_share: float = OWN_SHARE) -> Page:
    """Parse one page; keys are subtree hashes mixed with the host's."""
    page = Page()
    if not html:
        return page
    top = parse(html)
    held = _measure(top)
    for i, n in enumerate(held):
        n.at = i
    site = xxhash.xxh64_intdigest(host or "")
    page.key = [_signed(n.hash ^ site) for n in held]
    page.parent = [-1] * len(held)
    for i, n in enumerate(held):
        for k in n.kids:
            if not isinstance(k, str) and k.raw:
                page.parent[k.at] = i
    articles, mains = _roots(top, "article"), _roots(top, "main")
    zone_of = {id(n): 1 for n in mains} | {id(n): 2 for n in articles}
    most = own_share * sum(r.chars for r in articles or mains or [top])
    page.open, page.main = [True] * len(held), [False] * len(held)
    # depth first without recursion; a mark (element, True, ...) closes it. ``at``: the nearest element that holds text
    block, todo = 0, [(top, False, top.at, 0)]
    while todo:
        n, left, at, zone = todo.pop()
        if isinstance(n, str):
            page.pieces.append(_SPACES.sub(" ", n))
            page.at.append(at)
            page.block.append(block)
            page.zone.append(zone)
            continue
        block += n.tag in BLOCK
        if left or n.drop:
            continue
        kids = n.kids
        zone = max(zone, zone_of.get(id(n), 0))
        if n.tag == "br":
            kids = [" "]
        elif n.tag == "header":
            kids = _within(n, HEADINGS) if zone else []
        if n.at >= 0:
            at = n.at
            page.main[at] = bool(n.chars and kids)
            if zone or not zone_of:  # of the body beside the main text anything may go
                page.open[at] = id(n) not in zone_of and n.tag in CONTAINER and n.chars < most
        todo.append((n, True, at, zone))
        todo += [(k, False, at, zone) for k in reversed(kids)]
    for r in articles + mains:  # what holds the main text isn't in doubt itself
        up = page.parent[r.at] if r.at >= 0 else -1
        while up >= 0:
            page.open[up], up = False, page.parent[up]
    return page


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _within(n: Node, tags: frozenset[str]) -> list[Node]:
    out, todo = [], list(reversed(n.kids))
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            continue
        if k.tag in tags and not k.drop:
            out.append(k)
        elif not k.drop:
            todo += reversed(k.kids)
    return out


SKELETON = "key array<long>, parent array<int>, open array<boolean>, main array<boolean>, pieces array<string>, at array<int>, block array<int>, zone array<int>"
_LISTS = [("key", pa.int64()), ("parent", pa.int32()), ("open", pa.bool_()), ("main", pa.bool_()), ("pieces", pa.string()), ("at", pa.int32()),
    ("block", pa.int32()), ("zone", pa.int32())]


def parsed(df: DataFrame, id_col: str, url_col: str, html_col: str, host: Column) -> DataFrame:
    """Every page with its elements, written once: ``text`` where it is settled, else the ``pieces`` of the main text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 128):
            pages = [read_page(h, s) for h, s in zip(b.column("html").to_pylist(), b.column("host").to_pylist())]
            texts = [p.text() if p.settled() else None for p in pages]
            for p, t in zip(pages, texts):
                if t is not None:
                    p.pieces = p.at = p.block = p.zone = []
            lists = [pa.array([getattr(p, name) for p in pages], pa.list_(kind)) for name, kind in _LISTS]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string()), *lists],
                ["id", "url", "text", *(name for name, _ in _LISTS)])

    slim = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    kind = slim.schema["id"].dataType.simpleString()
    out = slim.mapInArrow(tidy(scan), f"id {kind}, url string, text string, {SKELETON}").withColumn("row", F.monotonically_increasing_id())
    path = fresh_path(df.sparkSession, "pages")
    out.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)


def templates(pages: DataFrame, many: int = MANY_PAGES) -> DataFrame:
    """(row, key, up, main): the subtrees to delete from each page, by their own key and their parent's."""
    often = pages.select(F.explode(F.array_distinct("key")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= many)
    often = cut(often, "often")
    inside = F.filter(F.arrays_zip("key", "parent", "open", "main"), lambda x: x["open"] & (x["parent"] >= 0))
    held = F.transform(inside, lambda x: F.struct(x["key"].alias("key"), F.get("key", x["parent"]).alias("up"), x["main"].alias("main")))
    seen = pages.select("row", F.explode(F.array_distinct(held)).alias("e")).select("row", "e.*")
    above = often.select(F.col("key").alias("up"), F.col("n").alias("n_up"))
    excess = F.col("n") - F.coalesce("n_up", F.lit(0)) >= many
    return seen.join(often, "key").join(above, "up", "left").filter(excess).select("row", "key", "up", "main")


def extract(df: DataFrame, host: Column, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", many: int = MANY_PAGES) -> DataFrame:
    """id, url, text, n_template (subtrees deleted because they recur across the host) and n_chars of every page."""
    pages = parsed(df, id_col, url_col, html_col, host)
    hits = templates(pages, many).groupBy("row").agg(F.count(F.lit(1)).cast("int").alias("n_template"),
        F.collect_set(F.when(F.col("main"), F.struct("key", "up"))).alias("gone"))
    hits = cut(hits, "template-hits")
    count = F.coalesce("n_template", F.lit(0)).alias("n_template")
    settled = pages.filter("text is not null").select("row", "id", "url", "text").join(hits.select("row", "n_template"), "row", "left").select("id",
        "url", "text", count)
    doubtful = pages.filter("text is null").join(hits, "row", "left").select("id", "url", count, "gone", *(name for name, _ in _LISTS))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 128):
            lists = zip(*(b.column(name).to_pylist() for name, _ in _LISTS))
            texts = [Page(*own).text({(g["key"], g["up"]) for g in gone or ()}) for own, gone in zip(lists, b.column("gone").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string()), b.column("n_template")],
                ["id", "url", "text", "n_template"])

    kind = pages.schema["id"].dataType.simpleString()
    both = settled.union(doubtful.mapInArrow(tidy(finish), f"id {kind}, url string, text string, n_template int"))
    return both.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_template", F.length("text").cast("long").alias("n_chars"))
