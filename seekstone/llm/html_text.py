"""Main text of web pages: site templates found by counting element subtrees per host.

A page becomes a tree of elements. Every container outside the prose gets a hash of its subtree;
Spark counts, for each host, on how many different pages a subtree stands, and those that recur on
many pages are the site's template and are deleted. Pages count as different when their article's
largest block differs, so that copies of one article never make its text a template. Subtrees within
an article are counted too; they go when the articles around them have nothing in common, so that
what near copies of an article share is never taken for a box that the site puts into each. What no
count can know, because it differs from page to page, goes by its element or its stated role:
scripts, forms, menus, sidebars, notices, adverts, reader comments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from seekstone.llm.textvec import bound_batches
from seekstone.shared import stage

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"'<]|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*+)>|<[!?][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")

#: Element names by what they mean for the text.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head nav aside form footer menu dialog button select option template svg canvas audio video object applet map datalist fieldset".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}}
CONTAINERS = frozenset("div nav ul ol dl table footer header aside section form menu center figure details".split())
#: Words of a class, id or role that say that an element is not the article's prose, and
#: words that say nothing beside them. A name counts as a whole: ``has-sidebar`` states no sidebar.
STATED = frozenset(
    "nav navbar navigation menu header masthead footer contentinfo sidebar complementary aside cookie cookies consent gdpr notice notices alert popup modal overlay ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner comment comments commentlist disqus replies reply respond share sharing social related recommended recommendations subscribe subscription newsletter breadcrumb breadcrumbs pagination pager login signup search widget copyright toolbar skip hidden sr-only".split()
)
BESIDE = frozenset("site page global main primary secondary top bottom left right container wrapper wrap box list item items section area block bar link links inner outer button buttons form panel post posts article articles story stories content text title group row col column unit slot icon icons count thread js mobile desktop".split())
#: Words that name prose, too, where they stand within an article; ids that still count on its sections.
OF_PROSE = frozenset("header masthead notice notices alert search".split())
READERS = frozenset("comments commentlist disqus replies respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BODY_LIKE = frozenset(("html", "body", "article", "main"))


@dataclass(frozen=True)
class Recurrence:
    """A subtree is template if it stands on ``pages`` different pages of its host, however many it has.

    Within articles also no passage of five words may stand in more than one of ``pages`` of the articles
    around it, as far as the ``sketch`` least hashes of each article's passages tell.
    """

    pages: int = 4
    broadcast_rows: int = 1_000_000
    sketch: int = 16


class Node:
    __slots__ = ("tag", "children", "dropped", "named", "digest", "attributes")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.attributes = tag, attributes
        self.children: list = []
        self.dropped, self.named, self.digest = False, False, 0  # named: dropped by its name alone


@lru_cache(maxsize=20_000)
def names_no_prose(tag: str, name: str, value: str, within: bool) -> bool:
    """Whether a class, id or role says that its element holds no prose of the article."""
    if name == "id" and tag in HEADINGS:
        return False
    for token in value.lower().split():
        if name == "id" and within and tag == "section":
            found = token in READERS
        else:
            parts = [w for w in re.split("[-_]+", token) if w and not w.isdigit()]
            held = {token, *parts} & STATED - (OF_PROSE if within else frozenset())
            found = token in held or bool(held) and all(w in STATED or w in BESIDE for w in parts)
        if found:
            return True
    return False


def stated(tag: str, attributes: str, within: bool) -> tuple[bool, bool]:
    """Whether an element says itself that it holds no prose of the article, and whether only its name
    says so."""
    if tag in NEVER or tag == "header" and not within:
        return True, tag == "form"
    if not attributes or tag in BODY_LIKE:
        return False, False
    named = False
    for name, a, b, c, hidden in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if hidden or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True, False
        named = named or name in ("class", "id", "role") and names_no_prose(tag, name, value, within)
    return named, named


def spare(tree: Node) -> None:
    """Keep elements dropped by name that hold most of the page's text, or more of article and main
    elements than all that is kept."""
    order, todo, kept = [], [(tree, True, False)], []
    while todo:
        n, free, within = todo.pop()
        order.append(n)
        free = free and not n.dropped
        if free and not within and n.tag in ("article", "main"):
            within = True
            kept.append(n)
        todo += [(c, free, within) for c in n.children if not isinstance(c, str) and (c.named or not c.dropped)]
    size: dict[int, int] = {}
    held: dict[int, int] = {}
    for n in reversed(order):
        size[id(n)] = sum(len(c.strip()) if isinstance(c, str) else size.get(id(c), 0) for c in n.children)
        held[id(n)] = size[id(n)] if n.tag in ("article", "main") else sum(held.get(id(c), 0) for c in n.children if not isinstance(c, str))
    most = sum(size[id(n)] for n in kept)
    for n in order:
        if n.named and n.dropped and (held[id(n)] > most or n.tag != "form" and 2 * size[id(n)] > size[id(tree)]):
            n.dropped = False


def parse(html: str) -> Node:
    """The tree of a page, however malformed; leaves are strings with references decoded."""
    root = Node("html", "")
    stack, at, within, named = [root], 0, 0, False

    def leave(to: int) -> None:
        nonlocal within
        for node in stack[to:]:
            within -= node.tag in ("article", "main")
        del stack[to:]

    for m in TAG.finditer(html):
        if m.start() < at:
            continue
        if m.start() > at:
            stack[-1].children.append(unescape(html[at : m.start()]) if "&" in html[at : m.start()] else html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, attributes = name.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    leave(k)
                    break
                if tag not in BLOCKS and stack[k].tag in BLOCKS:
                    break  # a stray end of an inline element closes no block
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    leave(k)
                    break
                if stack[k].tag in BLOCKS:
                    break
        if tag in CLOSED_BY:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSED_BY[tag]:
                    leave(k)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
                elif stack[k].tag in FENCES.get(tag, ()):
                    break
        if stack[-1].tag == "head" and tag in BLOCKS:
            leave(len(stack) - 1)
        node = Node(tag, attributes)
        node.dropped, node.named = (True, False) if tag in RAW else stated(tag, attributes, within > 0)
        named = named or node.named
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}[^a-zA-Z]", re.I).search(html, at)
            at = end.start() if end else len(html)
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
            within += tag in ("article", "main")
    if at < len(html):
        rest = html[at:]
        cut = re.search(r"<(?:/?[a-zA-Z]|!)[^<>]*\Z", rest)  # a tag that the page's end cuts off
        stack[-1].children.append(unescape(rest[: cut.start()] if cut else rest))
    if named:
        spare(root)
    return root


def blocks_of(node: Node, template: frozenset) -> list[str]:
    """Text blocks below a node in page order, without dropped elements and template subtrees."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    def walk(n: Node) -> None:
        todo = [(n, 0)]
        while todo:
            n, k = todo.pop()
            if k == 0 and n.tag in BLOCKS:
                flush()
            while k < len(n.children):
                child = n.children[k]
                k += 1
                if isinstance(child, str):
                    run.append(child)
                elif child.tag in ("br", "wbr"):
                    run.append(" " if child.tag == "br" else "")
                elif not child.dropped and child.digest not in template:
                    todo += [(n, k), (child, 0)]
                    break
                elif child.tag in BLOCKS:
                    flush()
            else:
                if n.tag in BLOCKS:
                    flush()

    walk(node)
    flush()
    return out


def roots(node: Node, tag: str) -> list[Node]:
    """Outermost kept elements of a name, in page order."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if n.tag == tag:
            out.append(n)
        else:
            todo += [c for c in reversed(n.children) if not isinstance(c, str) and not c.dropped]
    return out


def main_elements(tree: Node, tag: str, boxes: frozenset) -> list[list[str]]:
    """Blocks of the largest article (or main element) and of those at least half as long: a card that
    leads to another story is no article of the page."""
    found = [blocks_of(n, boxes) for n in roots(tree, tag)]
    sizes = [sum(map(len, b)) for b in found]
    return [b for b, size in zip(found, sizes) if size and 2 * size >= max(sizes)]


def main_blocks(tree: Node, template: frozenset, boxes: frozenset = frozenset()) -> list[str]:
    """Blocks of the article if the page names one, else of its main element, else of what is left, or,
    where nothing is, of what was dropped by its name. Within articles only ``boxes`` are deleted."""
    for tag in ("article", "main"):
        found = [b for blocks in main_elements(tree, tag, boxes) for b in blocks]
        if found:
            return found
    found = blocks_of(tree, template)
    return found or (main_blocks(tree, template, boxes) if restore(tree) else [])


def restore(tree: Node) -> int:
    """Keep again what was dropped by its name; returns how many elements."""
    n, todo = 0, [tree]
    while todo:
        node = todo.pop()
        if node.named and node.dropped:
            node.dropped = False
            n += 1
        todo += [c for c in node.children if not isinstance(c, str)]
    return n


def extract(html: str, template: frozenset = frozenset(), boxes: frozenset = frozenset()) -> str:
    """The main text of one page, given the digests of its host's template subtrees, outside and within
    articles."""
    tree = parse(html)
    if template or boxes:
        digest_tree(tree)
    return "\n\n".join(main_blocks(tree, template, boxes))


def article_sketch(html: str, without: frozenset, size: int) -> list[int]:
    """The least hashes of the passages of five words of a page's article, some subtrees left out; of a
    shorter text the hash of all of it, of none the hash of nothing."""
    tree = parse(html)
    digest_tree(tree)
    words = " ".join(b for tag in ("article", "main") for n in roots(tree, tag) for b in blocks_of(n, without)).lower().split()
    passages = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    return sorted(xxhash.xxh3_64_intdigest(p) - (1 << 63) for p in passages)[:size]


def digest_tree(tree: Node) -> tuple[dict[int, int], dict[int, int]]:
    """Digests of all nodes, without deep recursion; returns those of containers that may be template,
    outside and within article and main elements."""
    found: dict[int, int] = {}
    inner: dict[int, int] = {}
    order, todo, prose = [], [(tree, False)], set()
    while todo:
        n, within = todo.pop()
        order.append(n)
        within = within or n.tag in ("article", "main")
        if within:
            prose.add(id(n))
        todo += [(c, within) for c in n.children if not isinstance(c, str)]
    sizes: dict[int, int] = {}
    for n in reversed(order):
        parts, size = [n.tag, n.attributes], 0
        for child in n.children:
            if isinstance(child, str):
                text = " ".join(child.split())
                parts.append(text)
                size += len(text)
            else:
                size += sizes[id(child)]
                parts.append(f"\x00{child.digest}")
        sizes[id(n)] = size
        n.digest = xxhash.xxh3_64_intdigest("\x01".join(parts)) - (1 << 63)
        if n.tag in CONTAINERS and size:  # paragraphs are no containers: what articles share stays
            (inner if id(n) in prose else found)[n.digest] = size
    return found, inner


def page_mark(tree: Node) -> int:
    """A digest that tells pages apart: of an article's largest block, which near copies mostly share,
    or, where no article or main element is named, of the whole text."""
    for tag in ("article", "main"):
        blocks = [b for of in main_elements(tree, tag, frozenset()) for b in of]
        if blocks:
            return xxhash.xxh3_64_intdigest(max(blocks, key=len)) - (1 << 63)
    return xxhash.xxh3_64_intdigest("\n".join(blocks_of(tree, frozenset()))) - (1 << 63)


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), HOST, 1))
    return pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host")).withColumn("own", F.xxhash64("host", "html"))


def subtrees(pages: DataFrame) -> DataFrame:
    """``(host, digest, page, own, inner)`` of every container subtree; ``page`` stands for the page's main
    text, ``own`` for its host and html, ``inner`` is whether it lies within an article."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, digests, marks, owns, inside = [], [], [], [], []
            for host, html, own in zip(*(c.to_pylist() for c in batch.columns)):
                tree = parse(html)
                outer, inner = digest_tree(tree)
                mark = page_mark(tree)
                for found, within in ((outer, False), (inner, True)):
                    hosts += [host] * len(found)
                    digests += found
                    marks += [mark] * len(found)
                    owns += [own] * len(found)
                    inside += [within] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(x, pa.int64()) for x in (digests, marks, owns)), pa.array(inside, pa.bool_())], names=["host", "digest", "page", "own", "inner"])

    return pages.where("host <> ''").select("host", "html", "own").mapInArrow(run, "host string, digest bigint, page bigint, own bigint, inner boolean")


def article_boxes(pages: DataFrame, seen: DataFrame, rule: Recurrence) -> DataFrame:
    """``(host, digest)``: subtrees within articles that recur in articles that have nothing in common.

    Of each page with subtrees that recur, all of these are left out, and what remains of the article
    is sketched. A subtree's pages are different if no hash of the sketches stands on more than one of
    ``rule.pages`` of them: near copies share most hashes. Counts are partially aggregated by subtree
    and hash; no page list is gathered.
    """
    inside = seen.where("inner").select("host", "digest", "own").distinct()
    recurring = inside.groupBy("host", "digest").agg(F.count("*").alias("n")).where(F.col("n") >= rule.pages)
    recurring = stage(recurring, "recurring")
    if recurring.isEmpty():
        return recurring.select("host", "digest")
    held = inside.join(F.broadcast(recurring.select("host", "digest")) if recurring.count() <= rule.broadcast_rows else recurring.select("host", "digest"), ["host", "digest"])
    by_page = held.groupBy("own").agg(F.collect_set("digest").alias("digests"))  # bounded by the page
    asked = pages.select("own", "host", "html").dropDuplicates(["own"]).join(by_page, "own").select("host", "html", "digests")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, digests, values = [], [], []
            for host, html, held in zip(*(c.to_pylist() for c in batch.columns)):
                sketch = article_sketch(html, frozenset(held), rule.sketch)
                for digest in held:
                    hosts += [host] * len(sketch)
                    digests += [digest] * len(sketch)
                    values += sketch
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.int64()), pa.array(values, pa.int64())], names=["host", "digest", "value"])

    counts = asked.mapInArrow(run, "host string, digest bigint, value bigint").groupBy("host", "digest", "value").agg(F.count("*").alias("on"))
    most = counts.groupBy("host", "digest").agg(F.max("on").alias("most"))
    return recurring.join(most, ["host", "digest"]).where(F.col("most") * rule.pages <= F.col("n")).select("host", "digest")


def templates(pages: DataFrame, rule: Recurrence) -> DataFrame:
    """``(own, digests, boxes)``: of each page that holds any, the template subtrees of its host that it
    holds, outside and within its article.

    A page's array is bounded by the page, not by what its host has.
    """
    seen = stage(subtrees(pages), "subtrees")
    outside = seen.where("not inner").select("host", "digest", "page").distinct().groupBy("host", "digest").agg(F.count("*").alias("n")).where(F.col("n") >= rule.pages)
    often = outside.select("host", "digest", F.lit(False).alias("inner")).unionByName(article_boxes(pages, seen, rule).withColumn("inner", F.lit(True)))
    often = stage(often, "often")
    often = F.broadcast(often) if often.count() <= rule.broadcast_rows else often
    held = seen.select("host", "digest", "own", "inner").join(often, ["host", "digest", "inner"])
    of = lambda inner: F.collect_set(F.when(F.col("inner") == inner, F.col("digest")))
    return stage(held.groupBy("own").agg(of(False).alias("digests"), of(True).alias("boxes")), "templates")


def extract_pages(pages: DataFrame, rule: Recurrence = Recurrence()) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages(page_id, url, html)``.

    A null html is empty and gives an empty text; a null or hostless url has no template, only stated
    roles count there; rows are returned as often as they come, null ids too. Other columns are
    ignored, and an empty table gives no rows.
    """
    bound_batches(pages.sparkSession)
    pages = with_host(pages)
    known = templates(pages, rule)
    n = known.agg(F.coalesce(F.sum(F.size("digests") + F.size("boxes")), F.lit(0))).first()[0]
    given = pages.join(F.broadcast(known) if n <= rule.broadcast_rows else known, "own", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(html, frozenset(digests or ()), frozenset(boxes or ())) for html, digests, boxes in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return given.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html", "digests", "boxes").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
