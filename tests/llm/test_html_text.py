import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest
from helpers import DATA

from quern.llm.html_text import build, extract_text, op9_html_text, page_text

CASES = {
    "": "", "plain": "plain", "<p>a<p>b": "a\n\nb", "a<br>b<br><br>c": "a\nb\n\nc", "<div>a</div><div>b</div>": "a\nb", " <b> a </b> <i>b</i>  c ": "a b c",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "- a\n- b\n  - c\n- d", "<ol start=9><li>a<li value=20>b<li>c</ol>": "9. a\n20. b\n21. c",
    "<table><tr><th>Name<th>N<tr><td>ab<td>1<tr><td>abcde<td>22</table>": "Name   N\nab     1\nabcde  22",
    "<table><tr><td rowspan=2>x<td>1<tr><td>2</table>": "x  1\n   2", "<table><tr><td colspan=2>wide title<tr><td>a<td>b</table>": "wide title\na  b",
    "<table><td>no row<td>b</table>": "no row  b", "<table><tr><td><p>l1<p>l2<td>r</table>": "l1  r\n\nl2",
    "<pre>\n a\n   b</pre>": " a\n   b", "<dl><dt>T<dd>D</dl>": "T\n  D", "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "<title>t</title><style>s{}</style><script>if (a<b) '</p>'</script>x": "x", "<p hidden>a</p><p style='display: none'>b</p><span style=visibility:hidden>c</span>d": "d",
    "<template>a</template><noscript>b</noscript><!-- c --><!doctype html>d<input value=e>": "d", "&lt;a&gt; &amp;&copy;&nbsp;b &unknown; &am": "<a> &©\xa0b &unknown; &am",
    "<p>a</div></p></b>b": "a\n\nb", "<h1>H<h2>I</h1>t": "H\n\nI\n\nt", "<select><option>a<option>b</select>": "a\nb", "<p>x<hr>y": "x\n\ny", "a < b <3 c": "a < b <3 c",
    "<body><head><title>n</title></head>v</body>w": "vw", '<p title="a>b">c</p>': "c", "<textarea> t </textarea>u": "t u",
    "<p><b>one<br><p>two</b>": "one\n\ntwo", "<details open><summary>s</summary>t</details>": "s\nt", "<svg><title>t</title><defs><text>u</text></defs><path d=1 /><text>a</text></svg>b": "ab", "x = <math><mi>y</mi><annotation>z</annotation></math>": "x = y", "<p>a</p>\n\n<p>b</p>": "a\n\nb",
}


@pytest.mark.parametrize("source", list(CASES))
def test_layout(source):
    assert page_text(source) == CASES[source]


def test_implied_tags():
    shape = lambda n: n if isinstance(n, str) else (n.tag, *map(shape, n.kids))
    assert shape(build("<title>t</title><p>a<table><td>b")) == ("html", ("head", ("title", "t")), ("body", ("p", "a"), ("table", ("tr", ("td", "b")))))


def test_hard_pages():
    for s in ("<" * 2000, "<div>" * 30_000 + "deep", "<table>" * 150 + "<td>q", "<td colspan=999999999>a", "<li>x", "<!-- a", "<script>b", "<a href='x", "</", "\x00", "<ol><li value=x>a", "&#xD800;"):
        page_text(s)
    assert page_text("<div>" * 30_000 + "deep") == "deep" and page_text(None) is None


LONG = ("<b>{}</i>", "<div>{}</li>", "<div>{}</td>", "<p>{}<p>", "<b>{}<p>", "<li>{}</b>", "<table>{}<td>a", "<table><td>a{}", "<blockquote>a{}", "<ul><li>a{}", "<td colspan=900>{}a", "<tr>{}<td>", "<h1>{}</h2>", "<pre>{}<br>a", "<a href='{}\">", "<svg>{}</g>", "<select>{}<option>")


@pytest.mark.parametrize("shape", LONG)
def test_time_grows_with_the_page(shape):
    """Twice and four times as many tags take about twice and four times as long, opened first or by turns."""
    a, b = shape.split("{}")
    for page in (lambda n: a * n + b * n, lambda n: (a + b) * n):
        times = []
        for n in (2000, 8000):
            source = page(n)
            times.append(min(_seconds(source) for _ in range(2)))
        assert times[1] < 9 * times[0] + 0.1, times


def _seconds(source):
    begin = time.perf_counter()
    page_text(source)
    return time.perf_counter() - begin


class Visible(HTMLParser):
    """The words that a page shows, by another parser: no tree, no layout, only what is within elements that are not shown."""

    HIDDEN = ("head", "title", "script", "style", "template", "noscript", "iframe", "datalist")
    VOID = ("br", "hr", "img", "input", "link", "meta", "wbr", "col", "area", "base", "source", "embed", "track")

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.parts, self.open = [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        style = re.sub(r"\s", "", a.get("style") or "")
        if tag not in self.VOID:
            self.open.append((tag, tag in self.HIDDEN or "hidden" in a or "display:none" in style or "visibility:hidden" in style))
        if tag in ("br", "p", "div", "li", "td", "th", "tr", "h1", "h2", "h3", "ul", "ol", "table"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass
        if tag not in ("b", "i", "em", "strong", "a", "span", "code"):
            self.parts.append(" ")

    def handle_data(self, data):
        if not any(hidden for _, hidden in self.open):
            self.parts.append(data)


def words(text):
    """How often each word comes, list markers aside."""
    return Counter(w for w in text.split() if not re.fullmatch(r"-|\d+\.", w))


def test_query(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = op9_html_text(spark, str(DATA)).collect()
    assert {r["page_id"] for r in got} == set(pages) and all(r["n_chars"] == len(r["text"]) for r in got)
    for r in got:
        assert words(r["text"]) == words("".join(Visible(pages[r["page_id"]]).parts)), r["page_id"]


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, "<p>a"), (1, "<p>a"), (None, "b"), (2, None), (3, "")], "page_id long, html string").selectExpr("*", "'x' as text", "'y' as n_chars")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in extract_text(df).collect()), key=str)
    assert got == sorted([(1, "a", 1), (1, "a", 1), (None, "b", 1), (2, None, 0), (3, "", 0)], key=str)
    assert extract_text(df.where("false")).count() == 0
