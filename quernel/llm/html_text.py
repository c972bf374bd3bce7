"""Main-text extraction with site template removal.

A page is parsed to a tree. The hashes of its element subtrees are counted per host over distinct pages, and subtrees that
recur on many pages of the host are deleted. An article or main element, where there is one, guards the main text: around
it a few pages are enough to make a subtree a template, and what is not in it is left out; inside it only blocks count
(not words, table cells or list items on their own), articles with the same text count once, what recurs on other hosts
too is copied text unless most articles of the host have it, and a page that would lose most of its text is a copy and
keeps all of it. Menus, headers, footers, sidebars, notices, adverts, forms and reader comments also go by element and
by name, whether they recur or not; scripts and styles are never text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.shared import BROADCAST_BYTES, in_slices, written
from quernel.llm.url_rules import host_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HARD = frozenset("head title script style noscript template iframe object svg canvas audio video map".split())  #: never text
DROPPED = frozenset("nav header footer aside form button select textarea option dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Start tags that end an open element, up to an enclosing container.
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
_NAME = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
#: Inside an article these go only with the whole list or table.
PARTS = frozenset("li dt dd tr td th thead tbody tfoot caption col colgroup".split())
#: Words in class, id or role that mark what is not the main text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside header masthead footer comment comments commentlist disqus "
    "respond reply replies share sharing social related recommended newsletter subscribe subscription signup popup modal overlay widget widgets "
    "toolbar pagination pager skip complementary contentinfo search login".split()
)
#: Words that may stand beside a mark in one name: site-footer is a footer, related-work is no list of related pages.
BESIDE = frozenset("area bar block box buttons container content group inner item items left link links list main outer page panel posts right row section site slot stories text thread top bottom unit wrap wrapper".split())


@dataclass(frozen=True)
class Params:
    least_pages: int = 5  #: distinct pages of a host that must hold a subtree; enough around an article or main element
    percent: int = 20  #: else, of the host's pages that must hold it,
    many_pages: int = 100  #: or pages that are enough on a host of any size
    lift: int = 10  #: inside an article, how many times the share of other hosts' pages the host's share must be,
    most_percent: int = 50  #: or of the host's pages that must hold it
    names: bool = True  #: whether elements also go by tag and name
    guard: bool = True  #: whether only the article or main element is the main text, where there is one


class Node:
    __slots__ = ("tag", "items", "hard", "skip", "main", "hash")

    def __init__(self, tag: str, hard: bool, skip: bool, main: bool):
        self.tag, self.items, self.hard, self.skip, self.main, self.hash = tag, [], hard, hard or skip, main, 0


def marked(tag: str, attrs) -> bool:
    """Whether an element's class, id or role names what is not the main text, or it is hidden.

    A name is split at hyphens, underscores and humps; one part must be a mark and the others marks or words that go with
    any; of an inline element, whose text is part of a sentence, all parts must be marks.
    """
    fine = MARKS if tag in INLINE else MARKS | BESIDE
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for token in value.split():
                parts = [w for w in _NAME.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if w and not w.isdigit()]
                if not MARKS.isdisjoint(parts) and fine.issuperset(parts):
                    return True
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return True
    return False


class _Tree(HTMLParser):
    """Builds the tree; tolerates unclosed and stray tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", False, False, False)
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close({"p"}, {"button", "td", "th", "table", "div", "article", "section", "li", "blockquote", "main", "body"})
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPES.get(tag, set()))
        main = tag in ("article", "main") or ("role", "main") in attrs
        kept = tag in ("html", "body") or main and not any(x.main for x in self.open)  # whatever their names are
        node = Node(tag, tag in HARD, not kept and (tag in DROPPED or marked(tag, attrs)), main)
        self.open[-1].items.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in INLINE and tag in ("svg", "path"):
            self.handle_endtag(tag)

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
            if self.open[i].tag in ("article", "main") and tag not in ("body", "html"):
                return  # a stray end tag does not end the article

    def handle_data(self, data):
        self.open[-1].items.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def mains(root: Node) -> list[Node]:
    """The outermost article and main elements that are not inside dropped ones; articles within a main are part of it."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        for x in reversed([x for x in node.items if isinstance(x, Node)]):
            todo.append(x)
        if node.skip:
            del todo[len(todo) - sum(isinstance(x, Node) for x in node.items) :]
        elif node.main:
            del todo[len(todo) - sum(isinstance(x, Node) for x in node.items) :]
            found.append(node)
    return found


def _walk(node: Node, out: list[str], dropped: frozenset | set, names: bool) -> None:
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.hard or x.skip and names or x.hash and x.hash in dropped:
            out.append(" ")
        else:
            if x.tag not in INLINE:
                out.append(" ")
                todo.append(" ")
            todo.extend(reversed(x.items))


def hash_subtrees(root: Node, seed: int = 0, apart=()) -> set[int]:
    """Hashes of all element subtrees with text, but for inline ones; each node keeps its own.

    With seed 1, for an article or main element, the found ones are those of blocks only. The lowest bit is the seed.
    Nodes in apart have hashes of their own and are left out.
    """
    found, todo, apart = set(), [(root, False)], {id(x) for x in apart}
    while todo:
        node, done = todo.pop()
        kids = [x for x in node.items if isinstance(x, Node) and not x.hard and id(x) not in apart]
        if not done:
            todo.append((node, True))
            todo.extend((x, False) for x in kids)
            continue
        h = xxhash.xxh3_64(node.tag, seed=seed)
        text = False
        for x in node.items:
            if isinstance(x, str):
                x = " ".join(x.split())
                text |= bool(x)
                h.update(b"\x00" + x.encode("utf-8", "replace"))
            elif not x.hard and id(x) not in apart:
                text |= bool(x.hash)
                h.update(b"\x01" + x.hash.to_bytes(8, "little"))
        node.hash = (h.intdigest() & ~1 | seed or 2) if text else 0
        if node.hash and node.tag not in ("", "html", "body") and node.tag not in INLINE and not (seed and node.tag in PARTS):
            found.add(node.hash)
    return found


def hash_page(root: Node, inside: list[Node]) -> tuple[set[int], set[int]]:
    """Hashes of subtrees around the article and main elements, and inside them."""
    within = set().union(*(hash_subtrees(r, 1) for r in inside))
    return hash_subtrees(root, 0, inside), within


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _text(roots: list[Node], drop=frozenset(), names: bool = True) -> str:
    out: list[str] = []
    for r in roots:
        _walk(r, out, drop, names)
        out.append(" ")
    return " ".join("".join(out).split())


def template_hashes(html: str | None, params: Params = Params()) -> tuple[int | None, list[int]]:
    """Signed 64-bit hashes of all subtrees of a page; and the hash of the text of its article and main elements, by which
    copies of an article count as one page (None without such an element)."""
    root = parse(html or "")
    inside = mains(root)
    around, within = hash_page(root, inside)
    key = _signed(xxhash.xxh3_64_intdigest(_text(inside, names=params.names).encode("utf-8", "replace"))) if inside else None
    return key, [_signed(h) for h in (*around, *within)]


def main_text(html: str | None, templates=(), params: Params = Params()) -> str:
    """The main text; templates holds hashes of subtrees to delete.

    An article that would lose more than half of its text by them is a copy of others, and stays whole.
    """
    root = parse(html or "")
    inside = mains(root)
    drop = {h & ((1 << 64) - 1) for h in templates}
    if not inside or not params.guard:
        if drop:
            hash_page(root, inside)
        return _text([root], drop, params.names)
    whole = _text(inside, names=params.names)
    drop = {h for h in drop if h & 1}  # templates inside articles; those around them are left out anyway
    if not drop or drop.isdisjoint(set().union(*(hash_subtrees(r, 1) for r in inside))):
        return whole
    rest = _text(inside, drop, params.names)
    return rest if 2 * len(rest) >= len(whole) else whole


def templates(pages: DataFrame, params: Params = Params()) -> DataFrame:
    """host and hash: the subtrees that recur on enough distinct pages of a host (by URL and content; by the text of its
    article or main elements where a page has such)."""

    def run(batches):
        for b in in_slices(batches):
            got = [template_hashes(x, params) for x in b.column(1).to_pylist()]
            page = [p if k is None else k for p, (k, _) in zip(b.column(2).to_pylist(), got, strict=True)]
            # the hash 0, which no subtree has, counts the pages
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(page, pa.int64()), pa.array([k is not None for k, _ in got], pa.bool_()), pa.array([[0, *h] for _, h in got], pa.list_(pa.int64()))], names=["host", "page", "guarded", "hashes"])

    rows = _pages(pages)
    parsed = rows.select("host", "html", "page").mapInArrow(run, "host string, page bigint, guarded boolean, hashes array<bigint>")
    distinct = parsed.select("host", "page", "guarded", F.explode("hashes").alias("hash")).distinct()
    counts = written(distinct.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"), F.count_if("guarded").alias("guarded")), "template-counts")
    totals = counts.filter("hash = 0").select("host", F.col("n").alias("pages"))
    share = 100 * F.col("n") / F.col("pages")
    within = F.col("hash") % 2 != 0
    often = counts.filter((F.col("hash") != 0) & (F.col("n") >= params.least_pages)).join(totals, "host")
    often = often.filter((share >= params.percent) | (F.col("n") >= params.many_pages) | ~within & (F.col("guarded") >= params.least_pages))
    often = written(often, "template-often")
    everywhere = counts.join(often.filter(within).select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(F.sum("n").alias("all_n"))
    joined = often.join(everywhere, "hash", "left").crossJoin(F.broadcast(totals.agg(F.sum("pages").alias("all_pages"))))
    elsewhere = 100 * (F.col("all_n") - F.col("n") + 1) / (F.col("all_pages") - F.col("pages") + 1)
    return joined.filter(~within | (share >= params.most_percent) | (share >= params.lift * elsewhere)).select("host", "hash")


def _pages(pages: DataFrame) -> DataFrame:
    """page_id, url, html (empty for null), host and page, a hash of URL and html, of every row."""
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"), F.xxhash64("url", F.coalesce("html", F.lit(""))).alias("page"))


def extract(pages: DataFrame, params: Params = Params()) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html), from whole pages.

    Null html counts as empty and gives an empty text; pages with a null URL share the empty host. Repeated rows give
    repeated rows and count as one page; an empty table gives an empty one. Very long and deeply nested pages are read
    whole. Templates are broadcast by host while their measured size is small; else each page's own ones are found by a
    join on host and hash, and brought to it by a join on the page, so that a large host's pages never meet in one task.
    """
    found = written(templates(pages, params), "templates")
    rows = _pages(pages)
    if 16 * found.count() <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(found.groupBy("host").agg(F.collect_list("hash").alias("hashes"))), "host", "left")
    else:
        joined = rows.join(_own_templates(rows, found, params), "page", "left")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches):
        for b in in_slices(batches, 2):
            text = [main_text(h, t or (), params) for h, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "hashes").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


def _own_templates(rows: DataFrame, found: DataFrame, params: Params) -> DataFrame:
    """page and hashes: of each page, those of its subtrees that are templates of its host."""

    def run(batches):
        for b in in_slices(batches):
            got = [template_hashes(x, params)[1] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(got, pa.list_(pa.int64()))], names=["host", "page", "hashes"])

    parsed = rows.select("host", "html", "page").mapInArrow(run, "host string, page bigint, hashes array<bigint>")
    own = parsed.select("host", "page", F.explode("hashes").alias("hash")).distinct().join(found, ["host", "hash"], "left_semi")
    return written(own.groupBy("page").agg(F.collect_list("hash").alias("hashes")), "page-templates")
