"""Main text of pages: frames go, the article stays whole."""

import pytest

from tabscope.llm import pages, queries

FRAME = """<!DOCTYPE html><html><head><title>{t}</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li><li><a href="/x">{t} link</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class='ad'>Buy {t}</div>{main}<aside>Side {t}</aside>
<form><p>Mail</p><input></form><section id="comments"><p>Reader says {t}</p></section><footer>&copy; Site</footer></body></html>"""
MAIN = "<article><h1>{t} &amp; more</h1><p>First <b>bold</b>\n  text<br>line&nbsp;two<p>Second &lt;b&gt; &#233;<ul><li>one<li>two</ul>{extra}</article>"
TEXT = "{t} & more\nFirst bold text line two\nSecond <b> é\none\ntwo"


def page(k, extra=""):
    return FRAME.format(t=f"T{k}", main=MAIN.format(t=f"T{k}", extra=extra))


def test_frames_go(spark, tmp_path):
    rows = [(k, f"https://h{k % 2}.example/{k}", page(k)) for k in range(30)]
    rows += [(100, "https://h0.example/odd", page(100, "<p>Third</p><div class='related'>See also</div>")), (101, None, page(101))]
    rows += [(102, "bad url", None), (103, "https://h0.example/", ""), (104, "https://h1.example/cut", page(104).split("<aside>")[0][:-10])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r["page_id"]: r for r in queries.op8_pages(spark, str(tmp_path)).collect()}
    expected = {k: TEXT.format(t=f"T{k}") for k in [*range(30), 101]} | {100: TEXT.format(t="T100") + "\nThird", 102: "", 103: ""}
    for k, text in expected.items():
        assert found[k]["text"] == text
        assert found[k]["n_chars"] == len(text)
    assert found[104]["text"].startswith(TEXT.format(t="T104")[:40])


def test_unmarked_pages():
    """Without an article element, slots are text, and fixed texts and links frame."""
    host = [f'<div><a href="/">Home</a> <a href="/a">About</a></div><div><p>Story {k} begins</p><p>and ends {k * 7}</p></div><div>All by Foo</div>' for k in range(6)]
    wrapper = pages.wrapper_of(host)
    assert pages.extract(host[2], wrapper) == "Story 2 begins\nand ends 14"


@pytest.mark.parametrize(
    ("bodies", "regex"),
    [
        (["<p>a</p>", "<p>b</p><p>c</p>"], "(<p>#</p>)+"),
        (["<h1>x</h1><p>a</p>", "<p>a</p>"], "(<h1>x</h1>)?<p>a</p>"),
        (["<dl><dt>a<dd>b<dt>c<dd>d</dl>"], "<dl>(<dt>#</dt>)+(<dd>#</dd>)+</dl>"),
        (["<b>x</b><i>y</i>", "<b>x</b><i>z</i>"], "<b>x</b><i>#</i>"),
    ],
)
def test_union_free_expressions(bodies, regex):
    assert "".join(i.regex() for i in pages.inferred(bodies)) == regex


SCRAMBLED = (("article", "section class='q'"), ("header", "div class='k'"), ("nav", "div class='w'"), ("aside", "div class='z'"),
             ("footer", "div class='v'"), ("form", "div class='m'"))


def scrambled(html):
    for tag, other in SCRAMBLED:
        html = html.replace(f"<{tag}>", f"<{other}>").replace(f"</{tag}>", f"</{other.split(' ')[0]}>")
    for k, name in enumerate(("cookie-notice", "'ad'", "comments")):
        html = html.replace(name, f"'u{'abc'[k]}'" if name[0] == "'" else f"u{'abc'[k]}")
    return html.replace('id="', 'class="')


def long_page(k, extra=""):
    more = "".join(f"<p>Paragraph {k * n} of story {k} with some more words {n} to read</p>" for n in range(2, 6))
    return page(k, more + extra)


def test_names_that_give_nothing_away():
    """With all names scrambled, the wrapper finds the same text; without it, fixed frames stay in doubt."""
    plain = [long_page(k) for k in range(12)]
    hidden = [scrambled(p) for p in plain]
    assert not any(w in "".join(hidden) for w in ("<article", "<nav", "footer", "cookie-notice", "comments"))
    by_names, by_slots = pages.wrapper_of(plain), pages.wrapper_of(hidden)
    for p, h in zip(plain, hidden, strict=True):
        assert pages.extract(h, by_slots) == pages.extract(p, by_names) != ""
    assert pages.extract(plain[3], by_names).startswith(TEXT.format(t="T3"))


def test_wrapper_changes_the_result():
    """A text that the host repeats on every page is known by the wrapper only."""
    notice = "<div>This story was first printed in the Daily Example</div>"
    host = [long_page(k, notice) for k in range(10)]
    assert "Daily Example" in pages.extract(host[1], None)
    assert "Daily Example" not in pages.extract(host[1], pages.wrapper_of(host))
    other = long_page(99, "<div>This story was first printed elsewhere</div>")
    assert "elsewhere" in pages.extract(other, pages.wrapper_of(host))


@pytest.mark.parametrize("html", [
    "<div>" * 5000 + "deep" + "</div>" * 5000,
    "<a " * 330_000, '<a ">" ' * 150_000, "<!" * 500_000, "</" * 500_000, "<p>x" * 250_000, "<b>" * 300_000 + "y",
    "<li><i>" * 100_000, "<td 'x" * 100_000 + ">", "<script " * 100_000,
])
def test_broken_pages_end(html):
    import time

    began = time.perf_counter()
    text = pages.extract(html, None)
    pages.wrapper_of([html, html[:1000]])
    assert time.perf_counter() - began < 30
    if "deep" in html:
        assert text == "deep"


def test_empty_table_and_clashes(spark):
    schema = "page_id long, url string, html string, main_text string, host string, page_host string"
    assert pages.main_texts(spark.createDataFrame([], schema)).collect() == []
    found = pages.main_texts(spark.createDataFrame([(1, "http://x/", "<p>a</p>", "old", "h", "p")] * 2, schema)).collect()
    assert [(r["main_text"], r["host"], r["page_host"]) for r in found] == [("a", "h", "p")] * 2


def test_odd_markup():
    assert pages.extract("<p>a < b & c &eacute;<p>x<b>y", None) == "a < b & c é\nxy"
    assert pages.extract("<!-- <p>no</p> --><p>yes<script>no", None) == "yes"
    assert pages.extract('<p title="a>b">q</p></div></p>', None) == "q"
    assert pages.extract("no markup", None) == "no markup"
