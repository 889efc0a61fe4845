"""Main text of web pages by wrapper induction.

Pages of one host are aligned by simple tree matching: their trees are walked
from the top, and children are matched in order by the size of the largest
match of their subtrees, equal texts deciding between equal sizes.  A node
whose text stays the same on most pages of the host is template; the varying
slots are content.  Templates are merged pairwise, and nodes on less than an
eighth of the pages are let go, so a template stays as small as a few pages.
How many pages hold a text is counted by a second pass over all of them.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .domtree import BLOCK, RAW, Node, Shape, child_pairs, parse, stripped

#: A text is template if so many pages of the host, at least, were seen, and this share of them holds it there.
LEAST_PAGES, SAME = 4, 0.7
#: Hosts a task keeps open before it passes their templates on.
OPEN_HOSTS = 2000
#: Partial templates of one host are merged in so many groups first.
MERGE_SALTS = 32
#: Templates are broadcast up to so many bytes, and joined by host beyond.
BROADCAST_BYTES = 32 << 20

# Elements and marks of what surrounds an article.
AROUND = frozenset("nav aside footer form button select input label dialog menu head".split())
MARKS_AROUND = frozenset(
    "ad ads advert adverts advertisement adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal "
    "overlay nav navbar navigation menu topbar breadcrumb breadcrumbs footer sidebar aside related recommended share sharing social newsletter subscribe "
    "signup comment comments disqus respond replies login search pagination pager widget contentinfo complementary".split()
)
MARKS_HEADER = frozenset("header masthead".split())
MARKS_MAIN = frozenset("article content main post entry story body".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
# Marks that tell how a page is laid out (no-sidebar, comments-open), not what an element is.
_STATE = re.compile(r"(?:no|has|with|without|is|show|hide)[-_].+|.+[-_](?:open|closed|enabled|disabled|fixed|active|visible|hidden|on|off)")


def _around(node: Node, in_article: bool) -> bool:
    if node.hidden or node.tag in AROUND or node.tag in RAW or (node.tag == "header" and not in_article):
        return True
    if not node.marks:
        return False
    marks = {piece for mark in node.marks.split() if not _STATE.fullmatch(mark) for piece in _SPLIT.split(mark)}
    if node.tag in ("html", "body", "article", "main") and not marks & {"comment", "comments", "ad", "advert", "related"}:
        return False
    return bool(marks & MARKS_AROUND) or (bool(marks & MARKS_HEADER) and not in_article)


def pruned(node: Node, in_article: bool = False) -> Node:
    """The tree without what surrounds an article, by element and mark."""
    inside = in_article or node.tag == "article"
    node.children = [pruned(c, inside) for c in node.children if c.tag == "#text" or not _around(c, inside)]
    return node


def host(url: str | None) -> str:
    """Host of a url in lower case; what has none is the empty host."""
    m = re.match(r"\s*[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


# A template node is [tag, marks, pages, text hash, pages with that text, children].
def template(node: Node) -> list:
    if node.tag == "#text":
        return ["#text", "", 1, xxhash.xxh3_64_hexdigest(stripped(node.text)), 1, []]
    return [node.tag, node.marks, 1, "", 0, [template(c) for c in node.children if c.tag != "#text" or not c.text.isspace()]]


def shape(t: list) -> Shape:
    """A template node as tree matching sees it."""
    return Shape((t[0], t[1]), t[3], [shape(c) for c in t[5]])


def merge(a: list, b: list, sa: Shape | None = None, sb: Shape | None = None) -> list:
    """Both templates in one; counts of a text that differs cancel out, so that only a majority survives."""
    sa, sb = sa or shape(a), sb or shape(b)
    pages = a[2] + b[2]
    if a[3] == b[3]:
        text, held = a[3], a[4] + b[4]
    else:
        text, held = (a[3], a[4] - b[4]) if a[4] >= b[4] else (b[3], b[4] - a[4])
    children, pa_, pb_ = [], 0, 0
    for i, j in [*child_pairs(sa, sb), (len(a[5]), len(b[5]))]:
        children += a[5][pa_:i] + b[5][pb_:j]
        if i < len(a[5]):
            children.append(merge(a[5][i], b[5][j], sa.children[i], sb.children[j]))
        pa_, pb_ = i + 1, j + 1
    return [a[0], a[1], pages, text, held, children]


def trimmed(t: list, pages: int | None = None) -> list:
    """The template without nodes on less than an eighth of its pages."""
    pages = pages or t[2]
    return [*t[:5], [trimmed(c, pages) for c in t[5] if 8 * c[2] >= pages]]


def add(held: list[list], t: list) -> None:
    """Adds a page; only templates of equally many pages are merged, so that trimming loses a slot few of its pages."""
    held.append(t)
    while len(held) > 1 and held[-1][2] == held[-2][2]:
        b, a = held.pop(), held.pop()
        held.append(trimmed(merge(a, b)))


def joined(parts: list[list]) -> list:
    """All templates in one, the smallest first."""
    todo = [(t[2], k, t) for k, t in enumerate(parts)]
    heapq.heapify(todo)
    while len(todo) > 1:
        (_, k, a), (_, _, b) = heapq.heappop(todo), heapq.heappop(todo)
        m = trimmed(merge(a, b))
        heapq.heappush(todo, (m[2], k, m))
    return todo[0][2]


def partial_templates(pages: DataFrame) -> DataFrame:
    """(host, salt, body): templates of the pages of each host that one task read; no page is shuffled."""

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[list]] = {}

        def out() -> pa.RecordBatch:
            bodies = [json.dumps(t, separators=(",", ":")) for t in map(joined, found.values())]
            return pa.record_batch([pa.array(list(found)), pa.array([xxhash.xxh32_intdigest(b) % MERGE_SALTS for b in bodies], pa.int32()), pa.array(bodies, pa.string())], ["host", "salt", "body"])

        for b in batches:
            for url, page in zip(b.column("url").to_pylist(), b.column("html").to_pylist()):
                if not page:
                    continue
                name, t = host(url), template(pruned(parse(page)))
                add(found.setdefault(name, []), t)
                if len(found) > OPEN_HOSTS:
                    yield out()
                    found.clear()
        if found:
            yield out()

    return pages.select("url", "html").mapInArrow(induce, "host string, salt int, body string")


def _merged(rows: DataFrame, by: list[str]) -> DataFrame:
    def join(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        whole = joined([json.loads(body) for body in sorted(part["body"])])
        return pd.DataFrame({"host": [key[0]], "body": [json.dumps(whole, separators=(",", ":"))]})

    return rows.groupBy(*by).applyInPandas(join, "host string, body string")


def _slots(t: list) -> list[list]:
    """The text nodes of a template, in page order."""
    return [t] if t[0] == "#text" else [x for c in t[5] for x in _slots(c)]


def _placed(pages: DataFrame, found: DataFrame, broadcast_bytes: int):
    """Pages with their host and, unless templates are broadcast, its template; and what looks a template up."""
    small = (found.agg(F.sum(F.octet_length("body") + 100)).first()[0] or 0) <= broadcast_bytes
    named = pages.withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", r"^\s*[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("")))
    if small:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: r["body"] for r in found.toLocalIterator()})
    else:
        shared, named = None, named.join(found, "host", "left")

    def lookup(b: pa.RecordBatch, known: dict[str, tuple]) -> Iterator[tuple]:
        bodies = b.column("body").to_pylist() if shared is None else None
        for i, (name, page) in enumerate(zip(b.column("host").to_pylist(), b.column("html").to_pylist())):
            if name not in known:
                if len(known) > OPEN_HOSTS:
                    known.clear()
                body = shared.value.get(name) if shared is not None else bodies[i]
                known[name] = (t := json.loads(body), shape(t)) if body else (None, None)
            yield name, page, *known[name]

    return named, lookup


def templates(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(host, body): one template for each host, with the pages that hold each text in its slot.

    Merging finds the likely text of each slot; a second pass over the pages counts who holds it.
    """
    found = staged(_merged(_merged(partial_templates(pages), ["host", "salt"]), ["host"]), "likely_templates")
    named, lookup = _placed(pages.select("url", "html"), found, broadcast_bytes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([h for h, _ in held], pa.string()), pa.array([k for _, k in held], pa.int32()), pa.array(list(held.values()), pa.int64())], ["host", "slot", "n"])

        for b in batches:
            for name, page, t, like in lookup(b, known):
                if not page or t is None:
                    continue
                if t[2] != -1:  # read for the first time: slots are numbered
                    for k, x in enumerate(_slots(t)):
                        x[4] = k
                    t[2] = -1
                held[name, -1] += 1
                for _, of in equal_texts(pruned(parse(page)), t, like):
                    held[name, of[4]] += 1
            if len(held) > 100 * OPEN_HOSTS:
                yield out()
                held.clear()
        if held:
            yield out()

    counts = named.mapInArrow(count, "host string, slot int, n long").groupBy("host", "slot").agg(F.sum("n").alias("n"))
    of_host = counts.groupBy("host").agg(F.collect_list(F.struct("slot", "n")).alias("counts"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = []
            for body, counts in zip(b.column("body").to_pylist(), b.column("counts").to_pylist()):
                t, n = json.loads(body), {c["slot"]: c["n"] for c in counts}
                for k, x in enumerate(_slots(t)):
                    x[4] = n.get(k, 0)
                t[2] = n[-1]
                bodies.append(json.dumps(t, separators=(",", ":")))
            yield pa.record_batch([b.column("host"), pa.array(bodies, pa.string())], ["host", "body"])

    return staged(found.join(of_host, "host").select("host", "body", "counts").mapInArrow(write, "host string, body string"), "templates")


def equal_texts(node: Node, t: list, like: Shape | None = None, own: Shape | None = None) -> Iterator[tuple[Node, list]]:
    """Text nodes that equal the text of their slot, with the slot; ``like`` is the shape of ``t``."""
    like, own = like or shape(t), own or shape(template(node))
    if own.texts.isdisjoint(like.texts):
        return
    children = [c for c in node.children if c.tag != "#text" or not c.text.isspace()]
    for i, j in child_pairs(own, like):
        child, of = children[i], t[5][j]
        if child.tag != "#text":
            yield from equal_texts(child, of, like.children[j], own.children[i])
        elif own.children[i].text == of[3]:
            yield child, of


def constants(node: Node, t: list, pages: int, out: set[int], like: Shape | None = None) -> None:
    """Adds to ``out`` the ids of text nodes that are template."""
    out.update(id(n) for n, of in equal_texts(node, t, like) if of[4] >= SAME * pages)


def _length(node: Node, fixed: set[int]) -> int:
    if node.tag == "#text":
        return 0 if id(node) in fixed else len(node.text.strip())
    node.size = sum(_length(c, fixed) for c in node.children)
    return node.size


def _regions(root: Node) -> list[Node]:
    """The elements that hold the article, in page order: every outermost article with text, else main, else marked as content, else the page."""
    kinds = ("article", "main", "marked")
    found: dict[str, list[Node]] = {k: [] for k in kinds}
    todo: list[tuple[Node, frozenset]] = [(root, frozenset())]
    while todo:
        node, within = todo.pop()
        kind = ""
        if node.tag in ("article", "main"):
            kind = node.tag
        elif node.marks and "main" in _SPLIT.split(node.marks):
            kind = "main"
        elif node.marks and set(_SPLIT.split(node.marks)) & MARKS_MAIN and node.tag != "body":
            kind = "marked"
        if kind and kind not in within:
            found[kind].append(node)
            within |= {kind}
        todo += [(c, within) for c in node.children[::-1] if c.tag != "#text"]
    for kind in kinds:
        kept = [n for n in found[kind] if n.size]
        if kept:
            return kept
    return [root]


def _texts(nodes: list[Node]) -> list[Node]:
    """The texts below ``nodes``."""
    out, todo = [], [*nodes]
    while todo:
        at = todo.pop()
        if at.tag == "#text":
            out.append(at)
        todo += at.children
    return out


def blocks(nodes: list[Node], fixed: set[int]) -> list[str]:
    """Texts of the blocks below ``nodes``, in page order; empty ones, and those that are template throughout, left out."""
    out: list[str] = []
    held: list[Node] = []

    def flush() -> None:
        text = stripped("".join([n.text for n in held]))
        if text and not all(id(n) in fixed or n.text.isspace() for n in held):
            out.append(text)
        held.clear()

    # Depth first without recursion, for trees as deep as a page likes.
    todo: list = [x for n in nodes[::-1] for x in (None, n)]
    while todo:
        at = todo.pop()
        if at is None:
            flush()
        elif at.tag == "#text":
            held.append(at)
        else:
            if at.tag in BLOCK:
                flush()
                todo.append(None)
            todo += at.children[::-1]
    flush()
    return out


def main_text(page: str | None, t: list | None, like: Shape | None = None) -> str:
    """Main text of one page, by the template of its host."""
    if not page:
        return ""
    root = pruned(parse(page))
    fixed: set[int] = set()
    if t is not None and t[2] >= LEAST_PAGES:
        constants(root, t, t[2], fixed, like)
    # Copies and near-copies of one article look like a template: marks that would take most of an article are let go.
    whole = _length(root, set())
    regions = _regions(root)
    inside = _texts(regions)
    if 2 * sum(len(n.text.strip()) for n in inside if id(n) in fixed) > sum(n.size for n in regions):
        fixed -= {id(n) for n in inside}
    elif whole:
        _length(root, fixed)
        regions = _regions(root)
    return "\n".join(blocks(regions, fixed))


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Null and empty html give the empty text; pages without a host share one;
    repeated pages are extracted alike; a host with fewer than
    ``LEAST_PAGES`` pages has no template, and its pages are read by elements
    and marks alone.  Templates are broadcast if their size, which is
    measured, is within ``broadcast_bytes``, and joined by host otherwise.
    """
    named, lookup = _placed(pages.select("page_id", "url", "html"), templates(pages, broadcast_bytes), broadcast_bytes)
    kinds = dict(pages.dtypes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for b in batches:
            texts = [main_text(page, t, like) for _, page, t, like in lookup(b, known)]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return named.mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
