"""The HTML extractor against a plain reference for random trees, browsers' readings of odd markup, and its running time."""

import random
import time
from html import escape

import pytest

from colloquy.llm import html_text as H

BLOCKS, INLINES = ("div", "section", "p", "blockquote", "h2", "ul"), ("b", "i", "span", "a", "em")


def made(rng, depth, shown, words, inside_p=False):
    """(markup, its visible words in order): a random well-formed tree, read by the definition of each way to hide."""
    markup, seen = [], []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.45 or depth == 0:
            w = f"w{len(words)}{rng.choice(['', '&', '<', 'é', '>'])}"
            words.append(w)
            markup.append(f" {escape(w)} ")
            seen += [w] if shown else []
            continue
        tag = rng.choice(INLINES if inside_p or kind < 0.7 else BLOCKS)
        how = rng.choice(["", "", "", ' class="a"', " hidden", ' style="display:none"', ' style="color:red; visibility: hidden"', ' style="visibility:visible"', ' aria-hidden="true"'])
        gone = how == " hidden" or "display" in how
        own = shown if "visibility" not in how else how.endswith('visible"')
        inner, told = made(rng, depth - 1, own, words, inside_p or tag in ("p", "h2"))
        markup.append(f"<{tag}{how}><li>{inner}</li></{tag}>" if tag == "ul" else f"<{tag}{how}>{inner}</{tag}>")
        seen += [] if gone else told
    if rng.random() < 0.2:
        markup.append(rng.choice(["<script>var a = '<p>no';</script>", "<!-- no -->", "<style>no</style>", "<template><p>no</p></template>", "<noscript>no</noscript>"]))
    return "".join(markup), seen


def test_visible_words_of_random_trees():
    rng = random.Random(11)
    for _ in range(400):
        markup, words = made(rng, 5, True, [])
        assert [w for w in H.extract(markup, screen=True).split() if w not in (">", "-")] == words, markup


def test_random_tables_against_a_plain_grid():
    rng = random.Random(12)
    for _ in range(200):
        n = rng.randint(1, 4)
        rows, carried, html, number = [], {}, [], 0
        for _ in range(rng.randint(1, 5)):
            row, line = {}, []
            column = 0
            while column < n:
                if carried.get(column, 0) > 0:
                    carried[column] -= 1
                    column += 1
                    continue
                wide = rng.randint(1, 2) if column + 1 < n and carried.get(column + 1, 0) == 0 else 1
                tall = rng.choice([1, 1, 1, 2, 3])
                row[column] = f"c{number}" * rng.randint(1, 3)
                number += 1
                line.append(f"<td colspan={wide} rowspan={tall}>{row[column]}")
                for k in range(column, column + wide):
                    carried[k] = tall - 1
                column += wide
            rows.append(row)
            html.append("<tr>" + "".join(line))
        used = sorted({c for r in rows for c in r})
        width = {c: max(len(r.get(c, "")) for r in rows) for c in used}
        want = ["  ".join(r.get(c, "").ljust(width[c]) for c in used).rstrip() for r in rows if r]
        assert H.extract("<table>" + "".join(html) + "</table>").split("\n") == want, html


READ = [
    ("<div>" * 205 + "<div hidden>SECRET</div>", ""),
    ("<div>" * 300 + "<table><tr><td>aa<td>b<tr><td>c<td>d</table>", "aa  b\nc   d"),
    ("<table><td>a<td>b</table>", "a  b"),
    ("<table><tr><td rowspan=2>AAAA<td>b<tr><td>c</table>", "AAAA  b\n      c"),
    ("<table><tr><td rowspan=0>A<td>b<tr><td>c<tr><td>d</table>", "A  b\n   c\n   d"),
    ("<table><tr><td colspan=1000>a<td>b<tr><td colspan=1000>cc<td>d</table>", "a   b\ncc  d"),
    ("<table><tr><td>1<tfoot><tr><td>foot</tfoot><thead><tr><td>head</table>", "head\n1\nfoot"),
    ("<table><span><td>a</span><td>b</table>", "a  b"),
    ("<p style='visibility:hidden'>a<b style='visibility:visible'>b</b></p>", "b"),
    ("<b hidden><div>secret</b>shown", "shown"),
    ("<b><div>one</b> two</div>", "one two"),
    ("<ol start='--5'><li>x</ol>", "1. x"),
    (f"<ol start={'9' * 5000}><li>x</ol>", "1000000000. x"),
    ("<ol><li value=4>x<li>y</ol>", "4. x\n5. y"),
    (f"<table><td colspan={'9' * 5000}>q</table>", "q"),
    (f"&#{'9' * 5000};&#x{'f' * 5000};&#00000000065;", "��A"),
    ("a</p>b", "a\n\nb"),
    ("x <b", "x"),
    ("x <a href='never closed>y</a> z", "x"),
    ("<ruby>漢<rp>(</rp><rt>kan</rt><rp>)</rp></ruby>", "漢kan"),
    ("<pre>a<div>b</div>c</pre>", "a\nb\nc"),
    ("<select><option>a</select><input value=x>b", "a b"),
    ("<div/>a<br/>b", "a\nb"),
    ("<svg><path/><text>t</text></svg>u", "t u"),
]


def test_odd_markup_is_read_as_browsers_do():
    for html, want in READ:
        assert H.extract(html) == want, html[:80]


def test_screen_mode_shows_all():
    for html, want in [
        ('<p aria-hidden="true">a</p>b', "a\n\nb"),
        ("x<textarea>\nhi &amp; ho\n <b>there</textarea>y", "x\nhi & ho\n <b>there\ny"),
        ("<input type=submit value=Go><input type=hidden value=no><input placeholder=Find><input type=password value=no><input value=v placeholder=no>", "Go Find v"),
        ("<input hidden value=no><textarea hidden>no</textarea>z", "z"),
    ]:
        assert H.extract(html, screen=True) == want, html


def test_titles():
    for html, want in [("<title> A &amp;\n B </title><title>c</title>", "A & B"), ("<svg><title>no</title></svg><title>yes</title>", "yes"), ("x", None), (None, None), ("<title></title>", "")]:
        assert H.title(html) == want


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 350_000, "<title>" * 150_000, "<div>" * 200_000 + "x", "<ul><li>x" * 100_000, "<p><button>" + "<div>" * 200_000, "<table><tr><td>x" * 60_000,
        "<table>" + "<tr><td rowspan=65534>x" * 20_000, "<table>" + "".join(f"<tr><td colspan={i % 1000}>a<td>b" for i in range(30_000)), "<mfrac><mi>ab</mi>" * 50_000,
        "<b><div>" * 100_000 + "</b>" * 100_000, "<script/>" * 100_000, '<a b="' * 150_000, "<!" * 500_000, "<" * 1_000_000, "<blockquote>x" * 70_000, "<select><optgroup label=x>" * 40_000,
        "<table><tr><td>" + "y" * 100_000 + "<td>z" + "<tr><td>a<td>b" * 50_000,
    ],
    ids=range(17),
)
def test_a_megabyte_of_anything_takes_seconds(page):
    start = time.process_time()
    text = H.extract(page, screen=True)
    assert time.process_time() - start < 12 and len(text) < 60 * len(page)
