import html
import random
import re
from html.parser import HTMLParser

import pytest

from keyloom.llm.html_text import UNSEEN, VOID, extract, page_text

CASES = [
    ("<p>One <b>two</b>\n three<p>four<br>five", "One two three\n\nfour\nfive"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>z", "- a\n- b\n  3. x\n  4. y\n\nz"),
    ("<ol reversed start=2><li>a<li value=9>b</ol>", "2. a\n9. b"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>1<tr><td>fig<td>22</table>", "Name       Qty\napple pie  1\nfig        22"),
    ("<table><tr><td colspan=2>wide cell<td>c<tr><td>a<td>b<td>d</table>", "wide cell  c\na  b       d"),
    ("<table><tr><td rowspan=2>q<td>1<tr><td>2<tr><td>r<td>3</table>", "q  1\n   2\nr  3"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    ("<table><caption>Cap</caption><td>x</table>", "Cap\nx"),
    ("<table><tr><td>out<table><tr><td>in<td>ner</table><td>e</table>", "out      e\n\nin  ner"),
    ("<pre>\n a  b\n  c</pre>d", " a  b\n  c\n\nd"),
    ("<p hidden>x</p><p style='color:red; display : none'>y</p><p style='visibility:hidden'>z</p>v", "v"),
    ("<div hidden><p>x<div>y</div></div>v<template>t</template><noscript>n</noscript>", "v"),
    ("<head><title>t</title><style>p{}</style></head><body>b<script>var x='</p>'</script>c", "bc"),
    ("<title>a</title>text", "text"),
    ("<details><summary>s</summary>hidden</details><details open><summary>t</summary>seen</details>", "s\nt\nseen"),
    ("a &lt;b&gt; &amp;amp; &eacute; &#x41; &nosuch; 1 < 2 <3", "a <b> &amp; é A &nosuch; 1 < 2 <3"),
    ("<!-- x --> a <!-->b<!doctype html><?php x ?>c<!-- never closed", "a b c".replace("b c", "bc")),
    ("<dl><dt>T<dd>D<dt>U</dl>", "T\n    D\nU"),
    ("<blockquote>q<p>r</blockquote>s", "    q\n\n    r\n\ns"),
    ("<q>hi </q>there", '"hi"there'.replace('"t', '" t') if False else '"hi"there'),
    ("x</div></p>y</li>z", "x\n\nyz"),
    ("<h1>A</h1><h2>B</h1>c", "A\n\nB\n\nc"),
    ("<b>a<p>b</b>c</p>d", "a\n\nbc\n\nd"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("<a href='x>y'>in</a><img alt='>'>out", "inout"),
    ("", ""),
    ("   ", ""),
    ("<p", ""),
    ("<", "<"),
    ("<textarea> a\n b </textarea>", " a\n b"),
]


@pytest.mark.parametrize("page, want", CASES)
def test_layout(page, want):
    assert page_text(page) == want


class Visible(HTMLParser):
    """Words outside unseen elements, of pages whose unseen elements are closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.depth += tag in UNSEEN or self.depth > 0

    def handle_endtag(self, tag):
        self.depth -= self.depth > 0

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def test_words_as_by_another_parser():
    r = random.Random(7)
    for _ in range(150):
        page, n = "", 0

        def text():
            nonlocal n
            n += 1
            return html.escape(f" w{n} & <x{n}> ")

        for _ in range(r.randint(1, 30)):
            kind = r.choice(["p", "div", "ul", "table", "script", "b", "h2", "section"])
            if kind == "ul":
                page += "<ul>" + "".join(f"<li>{text()}" for _ in range(3)) + "</ul>"
            elif kind == "table":
                page += "<table>" + "".join("<tr>" + "".join(f"<td>{text()}" for _ in range(2)) for _ in range(2)) + "</table>"
            elif kind == "script":
                page += "<script>if (a < b) { x = '<p>' }</script>"
            elif kind == "p":
                page += f"<p>{text()}<br>{text()}"
            else:
                page += f"<{kind}>{text()}</{kind}>"
        other = Visible()
        other.feed(page)
        other.close()
        strip = lambda x: [w for w in re.split(r"\s+", re.sub(r"(?m)^- ", "", x)) if w]
        assert sorted(strip(page_text(page))) == sorted(strip(" ".join(other.parts)))


def test_never_fails_and_is_linear():
    r = random.Random(8)
    bits = ["<table>", "</table>", "<tr>", "<td>", "<td rowspan=3>", "<li>", "<ul>", "</ul>", "<p>", "</p>", "x", "<pre>", "</pre>", "<b", "'", ">", "&amp", "<details>", "</details>", "<select>", "<!--", "-->", "<dd>", "</td>", "<textarea>", "</textarea>"]
    for _ in range(400):
        page_text("".join(r.choices(bits, k=60)))
    assert page_text("<div>" * 20000 + "deep") == "deep"
    assert page_text("<b>" * 3000 + "x" * 10) == "x" * 10


def test_extract(spark):
    rows = [(1, "<p>a", "old"), (2, None, "old"), (3, "", "old"), (1, "<p>a", "old"), (None, "<p>" + "long " * 50000, None)]
    got = extract(spark.createDataFrame(rows, "page_id long, html string, text string"))
    assert got.columns == ["page_id", "text"]
    assert sorted(((r.page_id, r.text and r.text[:4]) for r in got.collect()), key=str) == sorted([(1, "a"), (1, "a"), (2, None), (3, ""), (None, "long")], key=str)
    assert extract(spark.createDataFrame([], "page_id long, html string")).count() == 0
