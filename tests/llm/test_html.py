import html
import re
import time

import pyarrow.parquet as pq
import pytest

from setforge.llm import html_extract as H

PAGES = {
    "<p>One  two&nbsp;&amp; three</p>\n<p>Four <b>five</b>, six.</p>": "One two & three\nFour five, six.",
    "<body><nav><a>Menu</a></nav><article><h1>T</h1><p>a<p>b <i>c</i><br>d</article><footer>f</footer>": "T\na\nb c d",
    "<article><p><b>bold<br><p>next</p></article><p>outside</p>": "bold\nnext",
    "<article><p>a</p><div class='ad banner'>buy<p>now</p></div><form><p>x</p></form><p>b</p><!-- <p>no</p> --><script>var t='</p>';</script><style>p{}</style></article>": "a\nb",
    "<article><p>text that is cut off &am": "text that is cut off &am",
    "<article><p>text</p><p>more</p><foot": "text\nmore",
    "<article><header><h1>Head</h1></header><p>x &lt;b&gt; 1 < 2</p><section id=comments><p>first!</p></section></article>": "Head\nx <b> 1 < 2",
    "<main><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table></main>": "one\ntwo\na\nb\nc",
    "": "",
    "<html><head><title>x</title></head><body></body></html>": "",
    "just text": "just text",
    "<article></article></p></div><p>a</p>": "a",
    "<p title='a > b'>q</p><p hidden>h</p><div aria-hidden=true>z</div>": "q",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert H.main_text(page) == PAGES[page]


def test_ratios_choose_paths():
    page = "<div class=top><a href=/>Home</a></div><div class=text><h2>Title</h2>" + "<p>A long sentence, with marks; and more of it, so that it counts.</p>" * 4 + "<p>Short.</p></div><div class=tags><span>x</span></div><div class=tags><span>y</span></div>"
    text = H.main_text(page)
    assert text.split("\n")[0] == "Title" and text.endswith("Short.") and "Home" not in text and "x" not in text.split("\n")


def article(page):
    """By definition, for pages with one plain article: its text between block tags."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h[1-6])>", re.sub(r"<!--.*?-->", "", inner, flags=re.S))
    parts = (" ".join(html.unescape(re.sub(r"<[^<>]*>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in parts)
    return "\n".join(x for x in parts if x)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_all_pages(sf):
    for page in pq.read_table(f"/root/testdata/{sf}/pages.parquet")["html"].to_pylist():
        assert H.main_text(page) == article(page)


def test_ratios_without_marks():
    """The same pages with nothing that says what it is: menus go by their ratios, articles stay."""
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        menu = re.findall(r"<li>(.*?)</li>", page)
        plain = re.sub(r"<(/?)(?:nav|article|footer|div)\b[^>]*>", r"<\1div>", page)
        assert "article" not in plain[: plain.index("<body")] and "class" not in plain
        got = H.main_text(plain).split("\n")
        assert not {html.unescape(re.sub("<[^>]*>", "", x)) for x in menu} & set(got)
        assert set(article(page).split("\n")) <= set(got)


P = "<p>A sentence of some length, with marks; it says a thing or two, and ends.</p>"
WRAPPED = {
    f"<form action=x><div><a href=/>Home</a> <a href=/b>B</a></div>{P * 4}</form>": 4,
    f"<div class=post-with-comments>{P * 3}</div>": 3,
    f"<article>{P}</article><div>{P * 20}</div>": 1,
    f"<div>{P * 6}<ul><li>one item of a list here</li><li>and one more item of it</li></ul></div>": 8,
    f"<article>{P * 3}<ul><li><a href=/1>A link</a><li><a href=/2>Other link</a></ul></article>": 3,
    f"<article>{P * 3}<table><tr><td>1<td>2</table>{P}</article>": 6,
    f"<aside><article>{P}</article></aside><main>{P * 2}</main>": 2,
    f"<div>{P * 3}</div><div class=comments>{P * 5}</div>": 3,
    f"<a name=top>{P * 3}": 3,
    f'<p class="x"">{P * 3}': 3,
    f'<article>{P * 2}<p title="never closed>x</p></article>': 3,
    f"<nav><ul><li><a href=/>x</a></ul></nav><footer>{P}</footer>": 0,
}


@pytest.mark.parametrize("page", WRAPPED)
def test_wrappers_and_signs(page):
    assert len([x for x in H.main_text(page).split("\n") if x]) == WRAPPED[page]


def test_marked_phrases():
    assert H.main_text(f"<article>{P}<p>Some <span class=share>share</span> words, and more.</p></article>").split("\n")[1] == "Some words, and more."


@pytest.mark.parametrize("page", ["<a" * 100_000, "<a b='" * 50_000, '<a b="c' * 50_001, "<p>" + "<b>" * 50_000 + "<p>" * 50_000, "<div>" * 50_000 + "</x>" * 50_000, "<ul><li>" * 30_000, "<!--" * 50_000, "<script>" * 50_000, "< " * 100_000, "<td>" * 50_000, "<a b " * 50_000 + "=" * 50_000, "<div><p>x" * 20_000])
def test_hostile_markup_takes_linear_time(page):
    begin = time.monotonic()
    H.main_text(page)
    assert time.monotonic() - begin < 8


def test_query_and_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    got = H.op4_html_extract(spark, sf).collect()
    assert len(got) == 50 and all(r.n_chars == len(r.text) for r in got)
    rows = [(1, "u", None), (2, None, ""), (2, None, ""), (None, "v", "<p>x</p>"), (3, "w", "<p>" + "word " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars")
    out = H.extract(pages).collect()
    assert sorted(r.n_chars for r in out) == [0, 0, 0, 1, 499_999]
    assert H.extract(pages.limit(0)).count() == 0
