"""Numbers of lists, visibility, drawings and formulas, unclosed quotes, and the time that deep pages take."""

import time

import pytest

from keyloom.llm.html_text import page_text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<ol start=0><li>a<li>b</ol>", "0. a\n1. b"),
        ('<ol start="-2"><li>a<li>b</ol>', "-2. a\n-1. b"),
        ("<ol><li>a<li value=0>b<li>c</ol>", "1. a\n0. b\n1. c"),
        ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"),
        ("<ol reversed start=9><li>a<li>b</ol>", "9. a\n8. b"),
        ("<ol reversed><li>a<ol reversed><li>x<li>y</ol><li>b</ol>", "2. a\n   2. x\n   1. y\n1. b"),
        ("<table><tr><td colspan=0>a<td colspan=-3>b</table>", "a  b"),
    ],
)
def test_lists_are_numbered_as_they_say(page, text):
    assert page_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div style="visibility:hidden">a <b style="visibility:visible">b</b> c</div>', "b"),
        ('<p style="visibility:hidden">a<p>b', "b"),
        ('x<span style="visibility:collapse">a<q>b</q></span>y', "xy"),
        ('<div style="display:none">a <b style="visibility:visible">b</b></div>c', "c"),
        ('<ul style="visibility:hidden"><li>a<li style="visibility:visible">b</ul>', "- b"),
    ],
)
def test_visibility_can_be_taken_back(page, text):
    assert page_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<svg><title>t</title><defs><text>d</text></defs><text>one</text><text>two</text></svg>", "one\ntwo"),
        ("so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds", "so x=2 holds"),
    ],
)
def test_drawings_and_formulas_show_their_text(page, text):
    assert page_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('a <a href="foo>text', "a"),
        ("a <i title=it's>b</i> don't", "a b don't"),
        ('a <i x"y>b</i> "c"', 'a b "c"'),
        ("a <i title='x > y'>b</i>", "a b"),
        ("a <br", "a"),
    ],
)
def test_quotes(page, text):
    assert page_text(page) == text


@pytest.mark.parametrize(
    "page",
    [
        lambda n: "<div>" * n,
        lambda n: "<span>" * n + "</b>" * n,
        lambda n: "<p><button>" + "<div>" * n,
        lambda n: "<b>" * n + "<div>" * n + "</b>" * n,
        lambda n: "<div a='" + "=" * n,
    ],
)
def test_deep_pages_take_time_in_proportion(page):
    def least(n):
        took = []
        for _ in range(3):
            start = time.process_time()
            page_text(page(n) + "x")
            took.append(time.process_time() - start)
        return min(took)

    least(1_000)
    assert least(16_000) < 9 * max(least(4_000), 0.01)
