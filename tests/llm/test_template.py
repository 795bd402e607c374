"""Templates of pages: repeated rows, nesting, names, references and depth."""

import time

import pyarrow as pa
import pytest

from entigraph.llm import html_extract
from entigraph.llm.html_extract import extract


@pytest.mark.parametrize(
    "html, want",
    [
        ('<div class="layout no-sidebar"><article><p>Kept</p></article></div>', "Kept"),
        ('<div class="post comments-open"><p>Kept</p></div>', "Kept"),
        ('<div class="ad-free content"><p>Kept</p></div>', "Kept"),
        ("<article>foo&nbsp;<b>bar</b> a&#32;<i>b</i>&#10;c</article>", "foo bar a b c"),
        ('<article><p>Kept</p><div class="comment-list"><p>Out</p></div><div class="ads"><p>Out</p></div></article>', "Kept"),
        ('<article><div class="comments"><p>All of the text stands in an element of this name</p></div></article>', "All of the text stands in an element of this name"),
        ("<div class=sidebar><article><p>Kept</p></article></div>", "Kept"),
    ],
)
def test_names_tell_little(html, want):
    assert extract(html) == want


def test_any_depth_in_linear_time():
    took = []
    for n in (25_000, 100_000):
        began = time.perf_counter()
        assert extract("<article>" + "<div>" * n + "Deep" + "</div>" * (n // 2)) == "Deep"
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] and took[1] < 30


PAGE = "<html><body><div class=q1><p>Our motto on every page of this site</p><ul>{menu}</ul></div><div class=q2><h2>{title}</h2>{body}<p>Copyright line that never changes</p></div></body></html>"


def site(n, host="a.example"):
    return [(k, f"http://{host}/{k}", PAGE.format(menu="".join(f"<li>m{j}</li>" for j in range(3 + k % 3)), title=f"Title {k}", body="".join(f"<p>Story {k} line {j} with quite a few more words in it to read</p>" for j in range(4 + k % 5)))) for k in range(n)]


def expected(k):
    return "\n".join([f"Title {k}", *(f"Story {k} line {j} with quite a few more words in it to read" for j in range(4 + k % 5))])


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_slots_and_constant_texts(spark):
    got = {r.page_id: r.text for r in html_extract.main_text(frame(spark, site(12))).collect()}
    assert got == {k: expected(k) for k in range(12)}


def test_repeated_rows_are_pages_of_their_own(spark):
    rows = site(8)
    got = [(r.page_id, r.text) for r in html_extract.main_text(frame(spark, rows * 2)).collect()]
    assert sorted(got) == sorted([(k, expected(k)) for k in range(8)] * 2)
    parsed = html_extract._parsed(frame(spark, rows * 2).withColumn("_host", html_extract.host_of(html_extract.F.col("url"))))
    classes = html_extract._classes(html_extract._statistics(parsed))
    assert classes.where("host <> '*'").select("class").distinct().count() > 1


def test_a_page_with_little_text_of_its_own(spark):
    """What is constant goes, however little is left on one page."""
    rows = [*site(12), (50, "http://a.example/50", PAGE.format(menu="<li>m0</li>", title="T", body=""))]
    got = {r.page_id: r.text for r in html_extract.main_text(frame(spark, rows)).collect()}
    assert got[50] == "T" and got[3] == expected(3)


def test_pages_that_are_all_copies(spark):
    rows = [(k, "http://c.example/", "<html><body><nav>menu</nav><article><h1>One title</h1><p>The same article on all pages of the host</p></article></body></html>") for k in range(9)]
    assert {r.text for r in html_extract.main_text(frame(spark, rows)).collect()} == {"One title\nThe same article on all pages of the host"}


def test_an_element_is_described_once_for_all_pages_of_a_layout(monkeypatch):
    """Starts with the same attributes in the same place are looked up; long attributes are read every time."""
    seen, described = [], html_extract._described
    monkeypatch.setattr(html_extract, "_described", lambda tag, attributes: seen.append(tag) or described(tag, attributes))
    for k in range(40):
        html_extract.parse(f"<section class=met-once-{"ab"[k % 2]}><p>Text {k}<p>More</section>")
    assert len(seen) == 4
    for _ in range(3):
        html_extract.parse(f"<div class='{'long ' * 100}'>x</div>")
    assert len(seen) == 7


def test_pages_come_back_from_slices_of_a_batch():
    pages = [html_extract.parse(x) for x in [None, *(r[2] for r in site(5)), "", "<p> </p>\n<!-- x -->", "&#1; a"]]
    batch = pa.RecordBatch.from_arrays([pa.array([p[k] for p in pages], t) for k, t in enumerate(html_extract._PAGE_TYPES)], list(html_extract.Page._fields))
    for a in range(0, len(pages), 2):
        assert list(html_extract._pages_of(batch.slice(a, 3))) == pages[a : a + 3]
    assert list(html_extract._pages_of(batch.slice(0, 0))) == []


def slow_valid(pages, template):
    """Classes whose occurrences on a page are whole, in turn, and within one gap, by comparing all spans."""
    bad = set()
    for page in pages:
        at = {}
        for k, (kind, path, text) in enumerate(zip(page.kinds, page.paths, page.texts)):
            found = template.place.get(html_extract.token(kind, path, text))
            if found:
                at.setdefault(found[0], []).append((k, found[1]))
        for c, own in at.items():
            if [p for _, p in own] != [k % template.length[c] for k in range(len(own))] or len(own) % template.length[c]:
                bad.add(c)
    return bad


def test_order_and_nesting():
    """Tokens 1 2 3 around repeated 4 5; a class whose tokens stand in another order isn't valid."""
    rows = [r[2] for r in site(6)]
    pages = [html_extract.parse(x) for x in rows]
    li = next(p for k, p, b in zip(pages[0].kinds, pages[0].paths, pages[0].bits) if k == html_extract.START)
    starts = [p for k, p in zip(pages[0].kinds, pages[0].paths) if k == html_extract.START]
    end = lambda p: html_extract.token(html_extract.END, p, "")
    outer, items = [starts[0], starts[1], end(starts[1]), end(starts[0])], [starts[4], end(starts[4])]
    good = html_extract.Template([*outer, *items], [1, 1, 1, 1, 2, 2])
    for page in pages:
        slots, around, wrong = good.fitted(page)
        assert not wrong and around[1] == {None} and around[2] == {(1, 2)} and slot_of(page, slots, "m0") == (2, 1)
    assert not slow_valid(pages, good) and li == starts[0]
    turned = html_extract.Template([*outer, *items[::-1]], [1, 1, 1, 1, 2, 2])
    assert all(2 in turned.fitted(p)[2] for p in pages) and slow_valid(pages, turned) == {2}
    crossing = html_extract.Template([starts[2], end(starts[1]), starts[1], end(starts[2])], [1, 1, 2, 2])
    assert all(crossing.fitted(p)[2] for p in pages)


def slot_of(page, slots, text):
    return next(s for s, t in zip(slots, page.texts) if t.strip() == text)


def test_edges(spark):
    rows = [(1, None, None), (2, "x", ""), (None, "http://a.example/", "<p>a</p>"), (4, "http://a.example/", "<article>" + "<p>long text</p>" * 30_000 + "</article>")]
    table = spark.createDataFrame([(*r, 1, "y") for r in rows], "page_id long, url string, html string, _host int, kinds string")
    got = {r.page_id: r.text for r in html_extract.main_text(table).collect()}
    assert got[1] == got[2] == "" and got[None] == "a" and got[4].count("\n") == 29_999
