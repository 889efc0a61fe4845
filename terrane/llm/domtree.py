"""HTML as trees: a forgiving parser, simple tree matching, and text blocks."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
RAW = frozenset("script style textarea title noscript template iframe svg math canvas object".split())
#: Elements that part text into blocks.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag ends, if it is open inside the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_ENDS_P = BLOCK - {"br", "body", "html", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "li", "dt", "dd", "option", "optgroup", "legend", "summary", "figcaption"} | {"li", "dt", "dd"}
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"(id|class|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=[\s/>\"']|$)", re.I)


#: Attribute texts remembered with their meaning, a matter of speed only.
ATTRIBUTES_KEPT = 5000
#: Deeper elements become siblings, as in browsers.
DEPTH = 200


@dataclass(slots=True)
class Node:
    """An element (``tag``) or a text (``tag`` is "#text", with ``text``)."""

    tag: str
    text: str = ""
    marks: str = ""
    hidden: bool = False
    children: list = field(default_factory=list)
    size: int = 1


def parse(page: str) -> Node:
    """Tree of a page; unclosed and crossed tags are mended as browsers mend the common cases."""
    root = Node("#root")
    stack = [root]
    at, raw = 0, None
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            stack[-1].children.append(Node("#text", page[at : m.start()]))
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(Node("#text", html.escape(m[0][9:].removesuffix("]]>"))))
            continue
        tag = name.lower()
        if m[1]:
            if tag == "p" and not any(n.tag == "p" for n in stack):
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if stack[depth].tag in ("table", "body", "html") and tag not in ("table", "body", "html"):
                    break
            continue
        if tag in _ENDS_P:
            _close(stack, {"p"}, {"table", "button", "#root"})
        if tag in CLOSES:
            _close(stack, *CLOSES[tag])
        node = Node(tag)
        if m[3]:
            node.marks, node.hidden = _attributes(m[3])
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(page, at)
            node.text = page[at : end.start() if end else len(page)]
            at = end.end() if end else len(page)
        elif tag not in VOID and (tag in BLOCK or not m[3].endswith("/")) and len(stack) < DEPTH:
            stack.append(node)
    if at < len(page):
        stack[-1].children.append(Node("#text", page[at:]))
    return root


@lru_cache(ATTRIBUTES_KEPT)
def _attributes(written: str) -> tuple[str, bool]:
    """Marks of an opening tag, and whether it hides its element."""
    marks, hidden = [], False
    for key, value in _ATTRIBUTE.findall(written):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("id", "class", "role"):
            marks.append(value)
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            hidden = True
    return " ".join(marks), hidden


def _close(stack: list[Node], tags: set[str], within: set[str]) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag in tags:
            del stack[depth:]
            return
        if stack[depth].tag in within:
            return


def align(a: list, b: list, score, equal, table=None) -> list[tuple[int, int]]:
    """Pairs (i, j) in order with the largest sum of ``score``; pairs of score 0 are never made.

    ``table`` gives the scores of two lists, if there is a quicker way than one by one.

    Equal items at both ends are aligned outright, which loses nothing: no
    item scores higher with another than with its equal.
    """
    low, ea, eb = 0, len(a), len(b)
    while low < min(ea, eb) and equal(a[low], b[low]):
        low += 1
    tail = []
    while ea > low and eb > low and equal(a[ea - 1], b[eb - 1]):
        ea, eb = ea - 1, eb - 1
        tail.append((ea, eb))
    n, m = ea - low, eb - low
    out = [(i, i) for i in range(low)]
    if n and m:
        scored = table(a[low:ea], b[low:eb]) if table else [[score(x, y) for y in b[low:eb]] for x in a[low:ea]]
        if n == 1 or m == 1:
            # One item pairs with the first of those that score most.
            line = scored[0] if n == 1 else [row[0] for row in scored]
            most = max(line)
            k = line.index(most)
            return out + ([(low, low + k) if n == 1 else (low + k, low)] if most else []) + tail[::-1]
        gains = np.array(scored, np.int64)
        best = np.zeros((n + 1, m + 1), np.int64)
        for i in range(n - 1, -1, -1):
            row = np.maximum(best[i + 1, :-1], best[i + 1, 1:] + gains[i])
            best[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
        i = j = 0
        while i < n and j < m:
            if gains[i, j] and best[i, j] == best[i + 1, j + 1] + gains[i, j]:
                out.append((low + i, low + j))
                i, j = i + 1, j + 1
            elif best[i + 1, j] >= best[i, j + 1]:
                i += 1
            else:
                j += 1
    return out + tail[::-1]


def match(a: list, b: list, same) -> list[tuple[int, int]]:
    """Pairs of items aligned in order, of equal kind, as many as can be."""
    return align(a, b, lambda x, y: 1 if same(x, y) else 0, same)


#: A matched node outweighs any number of equal texts.
NODE = 1 << 20
#: Cells of the largest table that an alignment holds at once.
CELLS = 1 << 20
#: Scores, and alignments of children, remembered, a matter of speed only.
SCORES_KEPT, PAIRS_KEPT = 200_000, 20_000


class Shape:
    """A tree reduced to what simple tree matching sees: kind of the root, text hash of a leaf, and children."""

    __slots__ = ("kind", "text", "children", "form", "whole", "texts")

    def __init__(self, kind: tuple, text: str, children: list):
        self.kind, self.text, self.children = kind, text, children
        self.form = hash((kind, tuple([c.form for c in children])))
        self.whole = hash((kind, text, tuple([c.whole for c in children])))
        self.texts = frozenset([text]) if text else frozenset().union(*[c.texts for c in children]) if children else frozenset()


_scores: dict[tuple[int, int], int] = {}
_pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
#: The last alignment of a long list, which is asked for again at once.
_long: dict[tuple[int, int], list[tuple[int, int]]] = {}


def matched(a: Shape, b: Shape) -> int:
    """Score of the largest match of two trees: ``NODE`` for each pair of nodes, one for each pair of equal texts."""
    if a.kind != b.kind:
        return 0
    if not a.children or not b.children:
        return NODE + (1 if a.text and a.text == b.text else 0)
    # Without a text in common the score depends on the forms alone, which repeat.
    key = (a.form, b.form) if a.texts.isdisjoint(b.texts) else (a.whole, b.whole)
    found = _scores.get(key)
    if found is None:
        if len(_scores) > SCORES_KEPT:
            _scores.clear()
        found = _scores[key] = NODE + sum(matched(a.children[i], b.children[j]) for i, j in child_pairs(a, b))
    return found


def child_pairs(a: Shape, b: Shape) -> list[tuple[int, int]]:
    """``pairs`` of the children of two trees, which merging asks for again after scoring."""
    # Without a text in common only subtrees without text can be equal, which their forms tell.
    key = (a.form, b.form) if a.texts.isdisjoint(b.texts) else (a.whole, b.whole)
    found = _pairs.get(key, _long.get(key))
    if found is None:
        found = pairs(a.children, b.children)
        if len(_pairs) > PAIRS_KEPT:
            _pairs.clear()
        if len(found) > 100:
            _long.clear()
        (_pairs if len(found) <= 100 else _long)[key] = found
    return found


def _score_table(a: list[Shape], b: list[Shape]) -> list[list[int]]:
    """``matched`` of every pair; trees that share no text with the other list are scored once for each form."""
    texts = frozenset().union(*[y.texts for y in b])
    firsts: dict[int, Shape] = {}
    for y in b:
        firsts.setdefault(y.form, y)
    rows: dict[int, list[int]] = {}
    out = []
    for x in a:
        if not x.texts.isdisjoint(texts):
            out.append([matched(x, y) for y in b])
            continue
        row = rows.get(x.form)
        if row is None:
            of_form = {f: matched(x, y) for f, y in firsts.items()}
            row = rows[x.form] = [of_form[y.form] for y in b]
        out.append(row)
    return out


def _equal(x: Shape, y: Shape) -> bool:
    return x.whole == y.whole


def pairs(a: list[Shape], b: list[Shape]) -> list[tuple[int, int]]:
    """Children that simple tree matching aligns: in order, by the scores of their whole subtrees.

    Lists too long for one table are aligned alike, a few rows of the table at a time.
    """
    if len(a) * len(b) <= CELLS:
        return align(a, b, matched, _equal, _score_table)
    low, ea, eb = 0, len(a), len(b)
    while low < min(ea, eb) and _equal(a[low], b[low]):
        low += 1
    while ea > low and eb > low and _equal(a[ea - 1], b[eb - 1]):
        ea, eb = ea - 1, eb - 1
    inner = _Rows(a[low:ea], b[low:eb]).path() if ea > low and eb > low else []
    return [(i, i) for i in range(low)] + [(low + i, low + j) for i, j in inner] + [(ea + k, eb + k) for k in range(len(a) - ea)]


class _Rows:
    """The table of ``align`` by rows: sums of some rows are kept, those between are worked out again when the path comes there."""

    def __init__(self, a: list[Shape], b: list[Shape]):
        self.a, self.b = a, b
        number: dict[int, int] = {}
        self.columns = np.array([number.setdefault(y.whole, len(number)) for y in b])
        firsts: dict[int, Shape] = {}
        for y in b:
            firsts.setdefault(y.whole, y)
        #: The different subtrees of ``b``, those of each form, and those that hold a text.
        self.different = list(firsts.values())
        self.holding: dict[str, list[int]] = {}
        of_form: dict[int, list[int]] = {}
        for k, y in enumerate(self.different):
            of_form.setdefault(y.form, []).append(k)
            for text in y.texts:
                self.holding.setdefault(text, []).append(k)
        self.of_form = {form: np.array(members) for form, members in of_form.items()}
        self.by_form: dict[tuple[int, int], int] = {}
        self.known: dict[tuple[bool, int], np.ndarray] = {}

    def gains(self, i: int) -> np.ndarray:
        """``matched`` of item ``i`` with every item of ``b``; without a text in common it depends on the forms alone."""
        x = self.a[i]
        common = {k for text in x.texts for k in self.holding.get(text, ())}
        key = (True, x.whole) if common else (False, x.form)
        row = self.known.get(key)
        if row is None:
            scored = np.zeros(len(self.different), np.int64)
            for form, members in self.of_form.items():
                if (x.form, form) not in self.by_form:
                    k = next((k for k in members if k not in common), None)
                    if k is None:
                        continue
                    if len(self.by_form) > SCORES_KEPT:
                        self.by_form.clear()
                    self.by_form[x.form, form] = matched(x, self.different[k])
                scored[members] = self.by_form[x.form, form]
            for k in common:
                scored[k] = matched(x, self.different[k])
            if len(self.known) * len(self.columns) > CELLS:
                self.known.clear()
            row = self.known[key] = scored[self.columns]
        return row

    def sums(self, low: int, high: int, below: np.ndarray, start: int, every: int) -> dict[int, np.ndarray]:
        """Largest sums from rows ``low`` to ``high``, of columns from ``start`` on, for every ``every``-th row; ``below`` is that of ``high``."""
        kept = {high: below}
        for i in range(high - 1, low - 1, -1):
            row = np.zeros_like(below)
            row[:-1] = np.maximum.accumulate(np.maximum(below[:-1], below[1:] + self.gains(i)[start:])[::-1])[::-1]
            below = row
            if (i - low) % every == 0:
                kept[i] = row
        return kept

    def path(self) -> list[tuple[int, int]]:
        """Pairs of the largest sum, chosen as ``align`` chooses them."""
        n, m = len(self.a), len(self.b)
        out, at = [], 0
        # (first row, last row, sums of the last row, column its sums begin at); the next rows are on top
        todo = [(0, n, np.zeros(m + 1, np.int64), 0)]
        while todo and at < m:
            low, high, below, start = todo.pop()
            below, start = below[at - start :], at
            rows = max(2, CELLS // (m + 1 - start))
            every = 1
            while every * rows < high - low:
                every *= rows
            sums = self.sums(low, high, below, start, every)
            if every > 1:
                edges = sorted(sums)
                todo += [(x, y, sums[y], start) for x, y in zip(edges, edges[1:])][::-1]
                continue
            i = low
            gains = self.gains(i)
            while i < high and at < m:
                j = at - start
                if gains[at] and sums[i][j] == sums[i + 1][j + 1] + gains[at]:
                    out.append((i, at))
                    i, at = i + 1, at + 1
                elif sums[i + 1][j] >= sums[i][j + 1]:
                    i += 1
                else:
                    at += 1
                    continue
                if i < high:
                    gains = self.gains(i)
        return out


_BLANKS = re.compile(r"\s+")


def clean(raw: str) -> str:
    """Character references decoded, white space runs made one blank."""
    return _BLANKS.sub(" ", html.unescape(raw) if "&" in raw else raw)


def stripped(raw: str) -> str:
    """``clean`` without blanks at the ends."""
    return " ".join((html.unescape(raw) if "&" in raw else raw).split())
