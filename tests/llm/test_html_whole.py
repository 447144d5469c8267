"""Whole articles, whatever is nested in them and however their elements are called."""

from __future__ import annotations

import pytest

from weftgraph.llm import html_extract

ONE, TWO, THREE = "one " * 150, "two " * 100, "three " * 20
A, B, C = ONE.strip(), TWO.strip(), THREE.strip()


def texts(spark, *pages):
    frame = spark.createDataFrame([(i, f"http://h{i}/", x) for i, x in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in sorted(html_extract.extract(frame).collect())]


NESTED = {
    f"<body><article><section>{A}</section><section>{B}</section></article>": [A, B],
    f"<body><article><h1>Head</h1><div class=body><p>{A}</p></div></article>": ["Head", A],
    f"<body><article><p>{B}</p><table><tr><td>{A}</td></tr></table></article>": [B, A],
    f"<body><div><div><section><p>{A}</p></section></div><div><p>{B}</p></div></div>": [A, B],
    f"<body><div class=part><p>{A}</p></div><div class=part><p>{B}</p></div>": [A, B],
}
NAMED = [
    f"<body>{a}<p>{A}</p><p>{B}</p>{b}"
    for a, b in [
        ("<div class='content has-sidebar'>", "</div>"), ("<main class='no-sidebar'>", "</main>"), ("<article class='post social'>", "</article>"),
        ("<div id='side-by-side'>", "</div>"), ("<div class=social>", "</div>"), ("<form><div>", "</div></form>"), ("<div class=comments>", "</div>"),
    ]
]


def test_nested_parts_stay(spark):
    assert texts(spark, *NESTED) == ["\n".join(x) for x in NESTED.values()]


def test_equal_paths_of_a_host_stay(spark):
    page = f"<body><article><p>{A}</p></article><article><p>{B}</p></article>"
    frame = spark.createDataFrame([(i, "http://h/", page) for i in range(3)], "page_id long, url string, html string")
    assert [r.text for r in html_extract.extract(frame).collect()] == [f"{A}\n{B}"] * 3


def test_names_do_not_lose_a_page(spark):
    assert texts(spark, *NAMED) == [f"{A}\n{B}"] * len(NAMED)


@pytest.mark.parametrize("name", ["sidebar", "cookie-notice", "comments", "social_share"])
def test_furniture_stays_out(name):
    params = html_extract.ExtractParams()
    for x in ("article", "div class=post"):
        page = f"<body><{x}><p>{B}</p></{x.split()[0]}><div class={name}><p>{C}</p></div>"
        assert html_extract.extract_one(page, [], params)[0] == B
    long = f"<body><div class=post><p>{B}</p></div><div class=comments><p>{A}</p></div>"
    assert html_extract.extract_one(long, [], params)[0] == B


@pytest.mark.parametrize("name", ["comment-list", "comments-area", "user-comments", "ad-slot-3", "ad_728x90", "related-posts", "share-buttons", "cookie-bar", "site-nav", "newsletter-form"])
def test_furniture_of_paired_names_stays_out(name):
    params = html_extract.ExtractParams()
    for attr in ("class", "id"):
        inside = f"<body><article><p>{B}</p><div {attr}='{name}'><p>{C}</p></div><p>{A}</p></article>"
        assert html_extract.extract_one(inside, [], params)[0] == f"{B}\n{A}"
        beside = f"<body><div class=post><p>{B}</p></div><div {attr}='{name}'><p>{C}</p></div>"
        assert html_extract.extract_one(beside, [], params)[0] == B


@pytest.mark.parametrize("name", ["post-header", "widget-container", "has-sidebar", "comment-free", "nav-story", "page-content", "article-body", "main", "list_2"])
def test_other_names_stay_in(name):
    page = f"<body><article><div class='{name}'><p>{C}</p></div><p>{B}</p><p>{A}</p></article>"
    assert html_extract.extract_one(page, [], html_extract.ExtractParams())[0] == f"{C}\n{B}\n{A}"


@pytest.mark.parametrize("end", ["<!-- cut <p>off", "<p class='cut", "<a href=x", "</p", "<!", "<script>cut", "<!---->", ""])
def test_what_the_end_cuts_off_is_no_text(end):
    assert html_extract.extract_one(f"<article><p>{A}</p>{end}", [], html_extract.ExtractParams())[0] == A
    for tail in ("1 < 2", "a <3 b", "x &amp", "R&D"):
        assert html_extract.extract_one(f"<article><p>{A}</p>{tail}", [], html_extract.ExtractParams())[0] == f"{A}\n{tail.replace('&amp', '&')}"


#: Pages that have no container of the usual kind, or little prose in it.
PLAIN = {
    "<p>Hello there world</p><p>Second para</p>": "Hello there world\nSecond para",
    "<html><h1>Title</h1><p>Some text</p></html>": "Title\nSome text",
    "plain text only": "plain text only",
    f"<main><section>{'a' * 70}</section><section>{'b' * 30}</section></main>": "a" * 70 + "\n" + "b" * 30,
    "<article><h1>Title</h1><div class='body'><p>first words of it</p></div><p>last words</p></article>": "Title\nfirst words of it\nlast words",
    "<form action=/><article><h1>Title</h1><p>in a form</p></article></form>": "Title\nin a form",
    "<article><p><a href=/x>one link</a></p></article>": "one link",
    "<body><nav><a>Home</a></nav><p><a>only link</a></p><footer>f</footer>": "only link",
    "<div><div class=part><p>aa</p></div><div class=part><p>bb</p></div><div class=part><p>cc</p></div></div>": "aa\nbb\ncc",
    "<body><div class='a>b'><p>odd name</p></div>": "odd name",
    "": "",
    "<body><nav>menu</nav></body>": "",
}


def test_pages_of_any_shape(spark):
    assert texts(spark, *PLAIN) == list(PLAIN.values())
    params = html_extract.ExtractParams()
    for page, want in PLAIN.items():  # and again by their own path
        text, path = html_extract.extract_one(page, [], params)
        assert (text, path) == html_extract.extract_one(page, [path], params) and text == want


@pytest.mark.parametrize(
    "make",
    [
        lambda n: "<div>" * n + "<p>deep", lambda n: "<div>" * n + "x" + "</section>" * n + "</div>" * n, lambda n: "<b>" * n + "<hr>" * n + "x", lambda n: "<a><div>" + "<b>" * n + "</a>" * n + "x",
        lambda n: "<b>x " * n, lambda n: "<ul>" + "<li>x<b>" * n, lambda n: "<article><p>x</p></article>" * n + "<div class=ad>y</div>" * n, lambda n: "<article><div class=menu>x" * n,
    ],
)
def test_time_is_linear_in_the_page(make):
    import time

    params, took = html_extract.ExtractParams(), []
    for n in (10_000, 100_000):
        began = time.process_time()
        text, path = html_extract.extract_one(make(n), [], params)
        took.append(time.process_time() - began)
        assert text and len(path) < 6000
    assert took[1] < 40 * took[0] + 1


def test_empty_table_repeated_rows_and_clashes(spark):
    rows = [(1, "http://h/", "<p>x y</p>"), (1, "http://h/", "<p>x y</p>"), (2, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS paths", "2 AS host", "3 AS text_path", "4 AS extra")
    got = html_extract.extract(frame).collect()
    assert sorted((r.page_id, r.text, r.paths, r.host, r.extra) for r in got) == [(1, "x y", 1, 2, 4), (1, "x y", 1, 2, 4), (2, "", 1, 2, 4)]
    assert html_extract.extract(frame.limit(0)).count() == 0
