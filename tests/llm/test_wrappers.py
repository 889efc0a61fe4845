import html
import random
import re

import pytest

from terrane.llm import domtree
from terrane.llm import wrappers as W
from terrane.llm.domtree import NODE, Shape, match, matched, pairs


def page(i, article, extra=""):
    return (
        f"<html><head><title>T{i}</title><style>p{{}}</style></head><body><header>Site</header><nav><a>n{i}</a></nav><div class='promo'>buy {i}</div>"
        f"<article><p>By our staff</p>{article}</article>{extra}<section class='comments'><p>first! {i}</p></section><form>mail {i}</form><footer>f</footer></body></html>"
    )


@pytest.fixture(scope="module")
def rows(spark):
    return lambda pages: spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, host string, body string")


def texts(df, **how):
    return {r.page_id: r.text for r in W.extract(df, **how).collect()}


@pytest.mark.parametrize("size", [W.BROADCAST_BYTES, 0])
def test_constant_nodes_are_template(rows, size):
    pages = [("https://a.example/x" + str(i), page(i, f"<h2>Head {i}</h2><p>A&amp;B &lt;{i}&gt;\n  c<b>d</b></p>" + "<p>more</p>" * (i % 3))) for i in range(9)]
    got = texts(rows(pages), broadcast_bytes=size)
    for i in range(9):
        assert got[i].split("\n")[:2] == [f"Head {i}", f"A&B <{i}> cd"]
        assert "staff" not in got[i] and "first!" not in got[i] and "buy" not in got[i] and "mail" not in got[i]


def test_edge_cases(rows):
    pages = [
        (None, None), ("", ""), ("http://one.example", page(0, "<p>only page")), ("no host", "<p>plain</p> tail <br>x<script>no()</script>"),
        ("http://deep.example", "<div>" * 5000 + "deep"), ("http://long.example", "<article>" + "<p>word</p>" * 20_000 + "</article>"), ("http://odd.example", "<p a='>'>q</p><!-- <p>no --><textarea>t</textarea><p>r &#x41;&nbsp;b <"),
    ] + [("http://same.example", "<article><p>All the same</p></article>")] * 6
    got = texts(rows(pages))
    assert got[0] == got[1] == "" and got[2] == "By our staff\nonly page" and got[3] == "plain\ntail\nx"
    assert got[4] == "deep" and got[5].count("\n") == 19_999 and got[6] == "q\nr A b <" and got[7] == "All the same"
    assert W.extract(rows([])).count() == 0


def test_pages_of_the_test_data(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in W.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)\b[^>]*>", inner)]
        assert got[r.page_id].text == "\n".join(x for x in parts if x) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_alignment_is_the_longest_common_order():
    same = lambda a, b: a == b
    assert match(list("abcde"), list("abxde"), same) == [(0, 0), (1, 1), (3, 3), (4, 4)]
    assert match(list("abc"), [], same) == [] and len(match(list("xaybzc"), list("abc"), same)) == 3


def test_near_copies_keep_their_article(rows):
    body = [f"Paragraph {k} of the one article that every page of the host repeats word by word." for k in range(6)]
    pages = [("https://copies.example/" + str(i), "<body><header>Site</header><article>" + "".join(f"<p>{x}</p>" for x in body) + f"<p>Edited on day {i}</p></article></body>") for i in range(8)]
    # One page is not edited at all: nothing on it varies.
    pages.append(("https://copies.example/plain", "<body><article>" + "".join(f"<p>{x}</p>" for x in body) + "</article><p>elsewhere</p></body>"))
    got = texts(rows(pages))
    for i in range(8):
        assert got[i].split("\n") == [*body, f"Edited on day {i}"]
    assert got[8].split("\n") == body


def test_constant_tail_after_varying_paragraphs(rows):
    pages = [("https://tail.example/" + str(i), "<article><h1>Head %d</h1>%s<p>Write to the editors</p></article>" % (i, "".join(f"<p>Paragraph {k} of page {i} says this.</p>" for k in range(2 + i % 4)))) for i in range(12)]
    got = texts(rows(pages))
    for i in range(12):
        assert got[i].split("\n") == [f"Head {i}", *[f"Paragraph {k} of page {i} says this." for k in range(2 + i % 4)]]


def test_children_align_by_their_subtrees():
    tree = lambda h: W.shape(W.template(W.parse(h)))
    a, b = tree("<div>x</div><div><ul><li>1<li>2</ul></div>"), tree("<div><ul><li>3<li>4</ul></div>")
    assert pairs(a.children, b.children) == [(1, 0)] and matched(a.children[1], b.children[0]) == 6 * NODE


def test_long_pages_align_in_parts():
    leaf = lambda x: Shape(("p", ""), x, [])
    a = [leaf(f"a{i}") for i in range(1500)] + [leaf("same")] + [leaf(f"c{i}") for i in range(10)]
    b = [leaf(f"b{i}") for i in range(1400)] + [leaf("same")] + [leaf(f"d{i}") for i in range(10)]
    got = pairs(a, b)
    assert (1500, 1400) in got and len(got) == 1411 and got == sorted(got)


def test_articles_in_parts_are_joined():
    assert W.main_text("<div class=content><p>First part of it.</p></div><div class=ad>Buy</div><div class=content><p>Second.</p></div><p>tail", None) == "First part of it.\nSecond."
    assert W.main_text("<article><p>One</p><article>two</article></article><p>no</p><article><p>Three and more</p></article>", None) == "One\ntwo\nThree and more"


def test_real_share_decides(rows):
    note = lambda i: "Read this first" if i % 4 else f"Other note {i}"
    pages = [("https://share.example/" + str(i), f"<article><p>{note(i)}</p><h2>A head of page {i}</h2><div>Its own text, number {i}, is here.</div></article>") for i in range(40)]
    for size in (W.BROADCAST_BYTES, 0):
        got = texts(rows(pages), broadcast_bytes=size)
        for i in range(40):
            assert got[i].split("\n")[:-2] == ([] if i % 4 else [note(i)]) and len(got[i].split("\n")) == (2 if i % 4 else 3)


@pytest.mark.parametrize("frame", [
    '<div class="layout no-sidebar"><article>{}</article></div>', '<div class="site comments-open"><main>{}</main></div>',
    '<body class="home page has-footer with-sidebar nav-fixed"><div class="is-menu-open"><article>{}</article></div></body>',
])
def test_layout_marks_lose_no_article(frame):
    text = "A first paragraph of the article.", "And a second one."
    page = frame.format("".join(f"<p>{t}</p>" for t in text) + '<div class="sidebar">Beside</div>')
    assert W.main_text(page, None) == "\n".join(text)


def test_paragraphs_without_common_texts_are_scored_once_a_form(monkeypatch):
    def tree(word: str, n: int) -> Shape:
        leaves = [Shape(("p", ""), "", [Shape(("#text", ""), f"{word}{k}", [])] * (1 + k % 2)) for k in range(n)]
        return Shape(("div", ""), "", [*leaves, Shape(("p", ""), "", [Shape(("#text", ""), "shared", [])])])

    a, b = tree("a", 200), tree("b", 200)
    plain = domtree.align(a.children, b.children, matched, lambda x, y: x.whole == y.whole)
    calls, scored = [], domtree.matched
    monkeypatch.setattr(domtree, "matched", lambda x, y: calls.append(1) or scored(x, y))
    domtree._pairs.clear()
    assert domtree.child_pairs(a, b) == plain == pairs(a.children, b.children)
    # Forty thousand one by one; here a few for each form, and the row of the shared text.
    assert len(calls) < 2000
    small = tree("a", 30), tree("b", 30)
    once = domtree.child_pairs(*small)
    calls.clear()
    assert domtree.child_pairs(*small) == once and not calls


def test_one_item_pairs_with_the_first_of_the_best():
    gains = {("x", "b"): 2, ("x", "c"): 3, ("x", "d"): 3}
    one = domtree.align(["x"], list("abcd"), lambda p, q: gains.get((p, q), 0), lambda p, q: False)
    other = domtree.align(list("abcd"), ["x"], lambda p, q: gains.get((q, p), 0), lambda p, q: False)
    assert one == [(0, 2)] and other == [(2, 0)] and domtree.align(["x"], ["a"], lambda p, q: 0, lambda p, q: False) == []


def test_long_lists_align_as_in_one_table(monkeypatch):
    rng = random.Random(3)
    text = lambda x: Shape(("#text", ""), x, [])

    def item(side: str) -> Shape:
        inside = [text(rng.choice(["same", "other", f"{side}{rng.randrange(9)}"])) for _ in range(rng.randrange(3))]
        return Shape((rng.choice(["p", "li", "div"]), ""), "", [Shape(("b", ""), "", inside)] * rng.randrange(3) + inside)

    for n, m in [(40, 55), (55, 40), (1, 50), (50, 1), (30, 30), (0, 9)]:
        for cells in (0, 30, 200):
            a, b = [item("a") for _ in range(n)], [item("b") for _ in range(m)]
            a, b = a + b[-3:], b
            plain = domtree.align(a, b, matched, lambda x, y: x.whole == y.whole)
            monkeypatch.setattr(domtree, "CELLS", cells)
            assert pairs(a, b) == plain
            monkeypatch.undo()


def test_long_lists_of_other_kinds_lose_no_pair():
    leaf = lambda kind, x: Shape((kind, ""), x, [])
    a = [leaf("h2", "only here")] + [leaf("p", f"a{i}") for i in range(1100)]
    b = [leaf("p", f"b{i}") for i in range(1100)]
    assert pairs(a, b) == [(i + 1, i) for i in range(1100)]
