"""Main text of web pages by site style trees.

Every page becomes a tree of styled elements (tag with class, id or role). The trees of a host are
merged by counting, for each style path, which texts lie there, on how many pages, and which sequences
of child styles the element around them has. The entropy of the texts at a path, relative to the largest
possible, is the importance of its content; the entropy of the child sequences around it that of its
presentation; the branch has the mean of both. A branch below ``least_importance`` on at least
``min_blocks`` blocks is low, and so is a text at a path that recurs on at least ``common`` of the host's pages.

A page may name its parts. Elements of furniture kinds or with a name of furniture (menus, footers, adverts,
forms, comments and the like) are cut, but a form that holds an article, or most of a page's text, is no furniture. A declared article or main part
is kept whole, as a host may hold many near copies of one article, if it has at least ``declared_share`` of the page's
unlinked text (a teaser has not). Everything the page leaves open is decided by the tree of its host: blocks
of pages that declare no such part, and branches in an article of which only a part of the name sounds
like furniture ("share-price").

Only counts are shuffled. A host's low branches are broadcast while there are at most
``broadcast_rows`` of them in all, and joined to the pages on a salted host key beyond that. A host has at
most one low branch for ``min_blocks`` of its blocks, and two recurring texts for each block of a page.

Cases: null and empty pages give the empty text; pages without host, or of hosts with fewer than
``min_blocks`` pages, are judged by their own names alone; unclosed and stray tags are mended as browsers do; broken-off
pages end there; nesting may be of any depth; repeated rows each get their row; no rows give an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

# Element kinds of HTML and style words of page furniture.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template head title svg math iframe object canvas audio video select option button textarea input form dialog nav footer aside menu".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br img wbr".split())
CONTAINERS = set("html body article main section div td th table ul ol dl blockquote figure header".split())
FURNITURE = set(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead footer "
    "sidebar aside widget cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social "
    "related recommended recommendations trending comment comments commentlist disqus reply replies respond pager pagination toolbar copyright legal hidden".split()
)
#: Words that mean furniture as a part of a name too ("user-comments", "related-posts"), in an article as elsewhere.
CLEAR = set("advert advertisement advertising sponsored navbar submenu breadcrumb breadcrumbs sidebar cookie cookies gdpr newsletter related recommended recommendations comment comments commentlist disqus pager pagination".split())
MAIN_STYLES = set("article main content post entry story body-text article-body post-content entry-content".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
SALTS = 16


@lru_cache(maxsize=1 << 14)
def _look(tag: str, names: str, marked_hidden: bool) -> tuple[str, bool, bool, bool]:
    """Style of an element, whether it is furniture, sounds like it in part, and is a main part."""
    words = names.lower().split()
    whole, parts = set(words), {p for w in words for p in re.split(r"[-_:]+", w)}
    main = tag in ("article", "main") or bool(MAIN_STYLES & whole) or "articlebody" in whole
    page = tag in ("html", "body", "article", "main")
    furniture = tag in HIDDEN or bool(FURNITURE & whole or CLEAR & parts) and not page or marked_hidden
    return tag + "".join(f".{w}" for w in sorted(words)), furniture, bool(FURNITURE & parts) and not page and not furniture, main


class Element:
    """An open element with what its place in the page says: nothing is looked up along the stack later."""

    __slots__ = ("tag", "path", "around", "hidden", "doubtful", "main", "head", "heading", "linked", "children", "form", "cut")

    def __init__(self, tag: str, attributes: list, parent: Element | None):
        names, marked_hidden = "", False
        if attributes:
            own = dict(attributes)
            names = " ".join(own.get(name) or "" for name in ("id", "class", "role", "itemprop"))
            marked_hidden = "hidden" in own or own.get("aria-hidden") == "true"
        style, furniture, doubtful, named_main = _look(tag, names, marked_hidden)
        inside = parent is not None and parent.main
        self.tag, self.main = tag, inside or named_main
        self.form = tag == "form" or parent is not None and parent.form and not named_main
        self.head = tag == "header" or parent is not None and parent.head
        self.heading = tag in HEADINGS or parent is not None and parent.heading
        self.linked = tag == "a" or parent is not None and parent.linked
        above = parent is not None and parent.hidden
        if named_main and parent is not None and parent.form and not parent.main:
            above = False  # a page wrapped in a form
        # outside a main part a name that sounds like furniture is enough; inside, the tree is asked
        own = furniture and not (tag == "header" and inside) or tag == "header" and not inside or doubtful and not inside
        self.hidden = own or above
        #: hidden for more than lying in a form: a form may wrap a whole page
        self.cut = own and (tag != "form" or marked_hidden) or parent is not None and parent.cut
        self.doubtful = doubtful and inside or parent is not None and parent.doubtful
        #: hash of the styles from the root; inline elements are part of their block
        if tag in INLINE:
            self.path, self.around, self.children = (parent.path, parent.around, parent.children) if parent is not None else (0, 0, [0])
        else:
            self.path, self.around, self.children = _code(style, parent.path if parent is not None else 0), parent.path if parent is not None else 0, [0]
            if parent is not None:
                parent.children[0] = _code(style, parent.children[0])


class Block:
    """A run of text between block elements."""

    __slots__ = ("path", "around", "text", "main", "hidden", "doubtful", "linked", "siblings", "formed")

    def __init__(self, inner: Element | None, text: str, linked: int):
        self.text, self.linked = text, linked
        if inner is None:
            self.path = self.around = 0
            self.main = self.hidden = self.doubtful = self.formed = False
            self.siblings = [0]
        else:
            self.path, self.around, self.main, self.doubtful = inner.path, inner.around, inner.main, inner.doubtful
            head = inner.head and not inner.heading
            self.hidden, self.formed = inner.hidden or head, inner.hidden and not inner.cut and not head
            self.siblings = inner.children


class Page(HTMLParser):
    """The blocks of a page in order, in time linear in its length."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.stack: list[Element] = []
        self.open: dict[str, list[int]] = defaultdict(list)  # places of the open elements of each tag
        self.text: list[str] = []
        self.place: Element | None = None
        self.placed, self.linked = False, 0
        self.feed(html)
        self.close()
        self.flush()

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers are of no use here."""
        return j

    def flush(self) -> None:
        if not self.text:
            return
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append(Block(self.place, text, self.linked))
        self.text, self.place, self.placed, self.linked = [], None, False, 0

    def pop_to(self, tag: str, within: Iterable[str]) -> bool:
        """Closes the last open ``tag`` and all in it, unless an element of ``within`` was opened after it."""
        if not self.open.get(tag):
            return False
        at = self.open[tag][-1]
        if any(places and places[-1] > at for places in map(self.open.get, within)):
            return False
        for e in self.stack[at:]:
            self.open[e.tag].pop()
        del self.stack[at:]
        return True

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in INLINE:
            if tag == "br":
                self.text.append(" ")
        else:
            self.flush()
            self.pop_to("p", CONTAINERS)
            if tag in CLOSED_BY_SAME:
                self.pop_to(tag, CLOSED_BY_SAME[tag])
        if tag not in VOID:
            self.stack.append(Element(tag, attrs, self.stack[-1] if self.stack else None))
            self.open[tag].append(len(self.stack) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        self.pop_to(tag, CONTAINERS if tag in INLINE or tag == "p" else ())

    def handle_data(self, data: str) -> None:
        inner = self.stack[-1] if self.stack else None
        if inner is not None and inner.tag in ("script", "style"):
            return
        if not self.placed and data and not data.isspace():
            self.place, self.placed = inner, True
        self.text.append(data)
        if inner is not None and inner.linked:
            self.linked += len(data.strip())


def _code(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed)


def _signed(codes) -> np.ndarray:
    return np.array(codes, np.uint64).view(np.int64)


def main_text(blocks: list[Block], low: set[int], declared_share: float = 0.3) -> str:
    """Text of a page after its low branches are cut; ``low`` has signed codes of paths, and of texts at paths."""

    def important(b: Block) -> bool:
        return not low or not (low & set(_signed([b.path, _code(b.text, b.path)]).tolist()))

    unlinked = lambda some: sum(len(b.text) - b.linked for b in some)
    shown, formed = [b for b in blocks if not b.hidden], [b for b in blocks if b.formed]
    if formed and unlinked(formed) > unlinked(shown):
        shown = [b for b in blocks if not b.hidden or b.formed]  # a page wrapped in a form
    declared = [b for b in shown if b.main]
    if declared and unlinked(declared) >= declared_share * unlinked(shown):
        kept = [b for b in declared if not b.doubtful or important(b)]
    else:
        kept = [b for b in shown if b.linked < 0.6 * len(b.text) and important(b)]
    return "\n".join(b.text for b in kept)


def _host(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _statistics(batches: Iterator) -> Iterator:
    """(host, path, text, n) of all blocks that are not furniture, and (host, path, null, n, children) of what is around them."""
    import pyarrow as pa

    for batch in batches:
        counts: Counter = Counter()
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if host and html:
                counts.update({(host, b.path, _code(b.text, b.path), b.siblings[0]) for b in Page(html).blocks if not b.hidden})
        columns = list(zip(*counts, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(_signed(c)) for c in columns[1:]], pa.array(list(counts.values()), pa.int64())], ["host", "path", "text", "children", "n"])


def low_branches(pages: DataFrame, url_col: str, html_col: str, least_importance: float, min_blocks: int, common: float) -> DataFrame:
    """(host, codes): codes of the low style paths, and of path with text, of each host."""
    texts = pages.select(_host(url_col).alias("host"), F.col(html_col).alias("html"))
    counted = texts.mapInArrow(_statistics, "host string, path long, text long, children long, n long")
    counted = materialise(counted.groupBy("host", "path", "text", "children").agg(F.sum("n").alias("n")), "blocks")
    sizes = texts.filter("host != ''").groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_blocks)

    def spread(kind: str) -> DataFrame:
        """Entropy over ``kind`` at each path, as a share of the largest possible."""
        entropy = F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")
        each = counted.groupBy("host", "path", kind).agg(F.sum("n").alias("n")).groupBy("host", "path")
        return each.agg(F.sum("n").alias("blocks"), entropy.alias("e")).filter(F.col("blocks") >= min_blocks).select("host", "path", (F.col("e") / F.ln("blocks")).alias(f"of_{kind}"))

    importance = (F.col("of_text") + F.col("of_children")) / 2
    low = spread("text").join(spread("children"), ["host", "path"]).filter(importance < least_importance).join(sizes.select("host"), "host", "left_semi").select("host", F.col("path").alias("code"))
    recurring = counted.groupBy("host", "text").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_blocks * common)
    frequent = recurring.join(sizes, "host").filter(F.col("n") >= common * F.col("pages")).select("host", F.col("text").alias("code"))
    return materialise(low.unionByName(frequent).groupBy("host").agg(F.collect_set("code").alias("codes")), "branches")


def extract(
    pages: DataFrame, least_importance: float = 0.25, min_blocks: int = 8, common: float = 0.5, declared_share: float = 0.3, broadcast_rows: int = 200_000,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """page_id, url and text of every page."""
    low = low_branches(pages, url_col, html_col, least_importance, min_blocks, common)
    rows = low.agg(F.coalesce(F.sum(F.size("codes") + 1), F.lit(0))).first()[0]
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), _host(url_col).alias("host"), F.col(html_col).alias("html"))
    if rows <= broadcast_rows:
        joined = named.join(F.broadcast(low), "host", "left")
    else:
        salted = low.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = named.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "_salt"], "left")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, of, codes = [], None, set()
            for i, (host, html) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if host != of:  # a host's pages often come together
                    of, codes = host, set(batch.column(4)[i].as_py() or ())
                texts.append(main_text(Page(html).blocks, codes, declared_share) if html else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = named.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "host", "html", "codes").mapInArrow(run, f"page_id {kind}, url string, text string")
