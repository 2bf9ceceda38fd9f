"""Main text of web pages by site template removal (operator 1).

Each page is parsed once into text blocks, each with the digests of the element
subtrees around it. Digests are counted per host in Spark, once a page; a
subtree that recurs across many pages of its host is template and is deleted
with all it holds. Menus, headers, footers, sidebars, notices, adverts, forms
and comments are counted by what they are called, as their words and shape
change from page to page. On hosts of fewer than ``FEW_PAGES`` pages, where no
count can show it, they go by that name alone. No name counts on an element
that holds the article or, without one, most of the page's text.

Outside a page's article a subtree's digest is over its elements (a menu keeps
its shape when its words change); inside, or on a page without an article
element, it also covers the words. Inside an article, subtrees with paragraphs
or headings are never template, so that articles which repeat on a host stay
whole; on a page without one they are, unless they are most of its text.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import stash

MIN_PAGES = 3           # a template is seen on as many pages of its host at least,
OUTSIDE_SHARE = 0.05    # on this share of the host's pages outside articles,
INSIDE_SHARE = 0.5      # and on this share inside
FEW_PAGES = 10          # hosts of fewer pages go by role words, too

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote article".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
                     "main menu nav ol p pre section table ul".split())
CLOSES_SAME = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option",
               "thead": "thead tbody tr td th", "tbody": "thead tbody tr td th"}
CLOSES_SAME = {k: frozenset(v.split()) for k, v in CLOSES_SAME.items()}
SCOPES = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "option": frozenset(("select",))}
DROPPED = frozenset("head script style noscript template nav footer aside form button select textarea input iframe object svg canvas "
                    "dialog menu title xmp noembed noframes".split())
UNSHOWN = DROPPED - frozenset("nav footer aside form dialog menu".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
DROPPED_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer ad ads advert adverts advertisement "
                          "adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay "
                          "newsletter subscribe subscription share sharing social comment comments commentlist disqus replies "
                          "respond related recommended widget login signup toolbar pagination pager skip".split())
HEAD_WORDS = frozenset("header masthead topbar".split())
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"""
                 r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[^a-z]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "prose", "holds_main", "size")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.children, self.prose, self.holds_main = tag, [], tag in PROSE, False
        self.size = 0
        found = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attrs)} if attrs.strip("/ \n") else {}
        self.attrs = found

    def words(self) -> set[str]:
        return {w for k in ("class", "id") if k in self.attrs for w in WORDS.split(self.attrs[k].lower()) if w}


def parse(html: str) -> Node:
    """Element tree of a page; unclosed and stray tags are repaired as browsers do."""
    root = Node("#root")
    stack, at = [root], 0
    size = len(html)
    while at < size:
        m = TAG.search(html, at)
        if m is None:
            stack[-1].children.append(html[at:])
            break
        if m.start() > at:
            stack[-1].children.append(html[at:m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break  # a stray inline end tag closes no block
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        if same := CLOSES_SAME.get(tag):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in same:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES.get(tag, ("table",)):
                    break
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}\\s*>", re.I).search(html, at)
            if tag not in DROPPED:
                node.children.append(html[at:end.start() if end else size])
            at = end.end() if end else size
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return root


def is_main(n: Node) -> bool:
    return n.tag in ("article", "main") or n.attrs.get("role") in ("main", "article") or n.attrs.get("itemprop") == "articleBody"


def invisible(n: Node) -> bool:
    """Never shown, on whatever host."""
    return (n.tag in UNSHOWN or "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true"
            or "display:none" in n.attrs.get("style", "").replace(" ", "").lower())


def by_role(n: Node, inside: bool) -> bool:
    """Boilerplate by what the element says it is."""
    if n.tag in DROPPED or n.attrs.get("role") in DROPPED_ROLES:
        return True
    words = n.words()
    if words & DROPPED_WORDS and n.tag not in ("html", "body", "main"):
        return True
    return not inside and (n.tag == "header" or bool(words & HEAD_WORDS)) and n.tag not in ("html", "body")


def _mark(root: Node) -> None:
    """Which elements hold the article or, on a page without one, most of the text, and
    which hold prose (no recursion). The article is the longest one; one that no role
    word stands around is preferred if it is half as long."""
    order, todo, above = [], [(root, False)], {}
    while todo:
        x, roled = todo.pop()
        order.append((x, roled))
        if not invisible(x):
            for c in x.children:
                if isinstance(c, Node):
                    above[id(c)] = x
                    todo.append((c, roled or by_role(x, True)))
    for x, _ in reversed(order):
        if not invisible(x):
            kids = [c for c in x.children if isinstance(c, Node)]
            x.prose = x.prose or any(c.prose for c in kids)
            x.size = sum(c.size for c in kids) + sum(len("".join(c.split())) for c in x.children if isinstance(c, str))
    mains = [(x, roled) for x, roled in order if is_main(x) and x.size]
    if mains:
        most = max(x.size for x, _ in mains)
        x = next((x for x, roled in sorted(mains, key=lambda m: -m[0].size) if not roled and 2 * x.size >= most),
                 next(x for x, _ in mains if x.size == most))
        path = set(map(id, _up(x, above)))
        # several articles below a role word, none most of the text: comments or teasers
        alone = all(id(y) in path or any(z is x for z in _up(y, above)) for y, _ in mains)
        if alone or 2 * x.size > root.size:
            for y in _up(x, above):
                y.holds_main = True
    # further articles that no role word stands on or around
    for x, roled in mains:
        if not roled and not by_role(x, True):
            for y in _up(x, above):
                y.holds_main = True


def _up(x: Node, above: dict[int, Node]) -> Iterator[Node]:
    while x is not None:
        yield x
        x = above.get(id(x))


def digest(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def collapse(text: str) -> str:
    return " ".join((entities.unescape(text) if "&" in text else text).split())


def subtree(n: Node, words: bool, done: dict[tuple[int, bool], int]) -> int:
    """Digest of an element subtree: tags, class words, repeated neighbours once; with
    its words if asked for. ``done`` keeps the digests of a page's elements."""
    todo = [n]
    while todo:
        x = todo[-1]
        if (id(x), words) in done:
            todo.pop()
            continue
        if new := [c for c in x.children if isinstance(c, Node) and (id(c), words) not in done]:
            todo.extend(new)
            continue
        parts = [x.tag, " ".join(sorted(x.words()))]
        for c in x.children:
            part = str(done[id(c), words]) if isinstance(c, Node) else collapse(c) if words else ""
            if part and (words or part != parts[-1]):
                parts.append(part)
        done[id(x), words] = digest(*parts)
        todo.pop()
    return done[id(n), words]


def blocks(html: str) -> tuple[list[tuple[str, list[int], list[int], list[int], bool]], set[tuple[int, bool]]]:
    """A page's text units, each with the subtree digests around it (outside and inside
    the article, and of prose on a page without one) and whether a role word stands
    around it, and all digests of the page with whether they lie inside."""
    root = parse(html)
    _mark(root)
    done: dict[tuple[int, bool], int] = {}
    counted: set[tuple[int, bool]] = set()
    runs: list[tuple[tuple, list[str]]] = []  # text by the digests around it, in page order

    def add(around: tuple, text: str) -> None:
        if not runs or runs[-1][0] is not around:
            runs.append((around, []))
        runs[-1][1].append(text)

    bare = not root.holds_main
    # digests around an element as links (digest, the links around it): shared by all that lies inside
    todo: list[tuple] = [(root, bare, (None, None, None, False))]
    while todo:
        x, inside, around = todo.pop()
        if isinstance(x, str):
            add(around, entities.unescape(x) if "&" in x else x)
            continue
        out, ins, prose, role = around
        inside = not role and (inside or is_main(x))
        kept = x.holds_main or 2 * x.size > root.size and bare
        if not role and not kept and by_role(x, inside):
            # known by its name, not by its words: its shape may change from page to page
            role, inside, d = True, False, digest("role", x.tag, " ".join(sorted(x.words())))
            counted.add((d, False))
            out = (d, out)
            around = (out, ins, prose, role)
        if x.tag not in INLINE:
            add(around, " ")
            todo.append((" ", inside, around))
            if x.tag not in ("#root", "html", "body", "head", "br", "hr") and not x.holds_main:
                if not inside or not x.prose:
                    d = subtree(x, inside, done)
                    counted.add((d, inside))
                    around = (out, (d, ins), prose, role) if inside else ((d, out), ins, prose, role)
                elif bare and not kept:
                    d = subtree(x, True, done)
                    counted.add((d, True))
                    around = (out, ins, (d, prose), role)
        if not invisible(x):
            todo.extend((c, inside, around) for c in reversed(x.children))
    units = [(t, *map(_chain, around[:3]), around[3]) for around, parts in runs if (t := " ".join("".join(parts).split()))]
    return units, counted


def _chain(link: tuple | None) -> list[int]:
    """Distinct digests of a chain of links, the outermost first."""
    out: dict[int, None] = {}
    while link is not None:
        out[link[0]] = None
        link = link[1]
    return list(out)[::-1]


def parsed(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Stored table of parsed pages: ``page_id, url, host, units, digests``."""
    src = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                    F.coalesce(F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit("")).alias("host"),
                    F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    unit = pa.struct([("text", pa.string()), ("outside", pa.list_(pa.int64())), ("inside", pa.list_(pa.int64())),
                      ("prose", pa.list_(pa.int64())), ("role", pa.bool_())])
    seen = pa.struct([("digest", pa.int64()), ("inside", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                units, digests = [], []
                for h in part["html"]:
                    u, c = blocks(h.as_py())
                    units.append([{"text": t, "outside": o, "inside": i, "prose": p, "role": r} for t, o, i, p, r in u])
                    digests.append([{"digest": d, "inside": i} for d, i in sorted(c)])
                yield pa.RecordBatch.from_arrays(
                    [part["page_id"], part["url"], part["host"], pa.array(units, pa.list_(unit)), pa.array(digests, pa.list_(seen))],
                    names=["page_id", "url", "host", "units", "digests"])

    return stash(src.mapInArrow(run, "page_id long, url string, host string, units array<struct<text:string,outside:array<bigint>,"
                                     "inside:array<bigint>,prose:array<bigint>,role:boolean>>, digests array<struct<digest:bigint,inside:boolean>>"), "pages")


def templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per host its pages and the digests that recur on enough of its pages; their number is at most
    the digests of a page divided by the share."""
    total = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    seen = (pages.select("host", F.explode("digests").alias("d")).groupBy("host", "d.digest", "d.inside")
                 .agg(F.count(F.lit(1)).alias("c")))
    share = F.when(F.col("inside"), INSIDE_SHARE).otherwise(OUTSIDE_SHARE)
    recurring = (seen.join(total, "host").filter((F.col("c") >= min_pages) & (F.col("c") >= share * F.col("pages")))
                     .groupBy("host").agg(F.collect_set("digest").alias("template")))
    return total.join(recurring, "host", "left")


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              min_pages: int = MIN_PAGES) -> DataFrame:
    """Per input row: ``page_id, url, text, n_chars`` and the number of blocks deleted
    as template.

    A null or empty page has the text ``""``; pages without a host (null or
    relative URL) share one. Rows that repeat a page are pages of their own. An
    empty table gives no rows.
    """
    pages = parsed(df, id_col, url_col, html_col)
    # stored, so that its size is known when the join is planned and few hosts' templates are broadcast
    j = pages.drop("digests").join(stash(templates(pages, min_pages), "templates"), "host")
    t = F.coalesce("template", F.array().cast("array<bigint>"))
    few = F.col("pages") < FEW_PAGES
    stays = F.filter("units", lambda u: ~F.arrays_overlap(u["outside"], t) & ~F.arrays_overlap(u["inside"], t) & ~(few & u["role"]))
    j = j.select("page_id", "url", F.size("units").alias("blocks"), stays.alias("all"), F.filter(stays, lambda u: ~F.arrays_overlap(u["prose"], t)).alias("own"))
    size = lambda c: F.aggregate(c, F.lit(0), lambda n, u: n + F.length(u["text"]))
    # what recurs is no template where it is most of the page, as on copies of a page
    out = j.select("page_id", "url", "blocks", F.when(2 * size("own") >= size("all"), F.col("own")).otherwise(F.col("all")).alias("kept"))
    out = out.withColumn("text", F.array_join(F.transform("kept", lambda u: u["text"]), " "))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"),
                      (F.col("blocks") - F.size("kept")).alias("template_blocks"))
