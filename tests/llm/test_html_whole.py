"""HTML at any size and nesting, and against a plain extraction of visible words."""

import html as entities
import os
import random
import re
import time
from html.parser import HTMLParser

import pytest

from lexmill.llm import html


@pytest.mark.parametrize(
    "source",
    ["<div>" * 200_000 + "x", "<ul><li>x" * 100_000, "<p><span>x" * 100_000, '<a "' * 250_001, "<a '" * 250_001, "<!--" * 250_000, "<table><tr><td>x" * 60_000, "<blockquote>x" * 70_000, "</b></p>" * 120_000, "<td colspan=9999999>x" * 45_000, "<b " + "a " * 500_000 + ">x", "x &amp" * 140_000, "<script>" * 120_000],
    ids=lambda s: s[:12],
)
def test_a_megabyte_takes_seconds(source):
    began = time.thread_time()
    text = html.to_text(source)
    assert time.thread_time() - began < 12 and len(text) < 60 * len(source)


@pytest.mark.parametrize(("cells", "breaks"), [(100, 500), (200, 1000), (400, 2000), (1000, 1)])
def test_many_cells_times_many_lines_stay_small(cells, breaks):
    source = "<table><tr>" + f"<td>{'w' * 100}" * cells + "<td>" + "x<br>" * breaks + "</table>"
    text = html.to_text(source)
    assert len(text) < 16 * len(source) and text.count("x") == breaks and text.count("w") == 100 * cells


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<input type=password value=secret> <input type=CHECKBOX value=on> <input type=radio value=r> <input value=shown> <input type=submit value=Send> <input type=image alt=Go value=no> <input type=hidden value=h>", "shown Send Go"),
        ("<div style='visibility: hidden'>a <b style='visibility:visible'>b</b> c</div> d", "b\nd"),
        ("<div style='visibility:hidden'><table><tr><td>x<td style='visibility:visible'>y</table><q>z</q><input value=v></div>", "| y"),
        ("<div style='display:none'>a <b style='visibility:visible'>b</b></div>c", "c"),
        ("<select><option><b>Bold</b> x<option>y</select>", "Bold x"),
        ("<ruby>漢<rp>(</rp><rt>kan</rt><rp>)</rp></ruby>", "漢kan"),
        ("a<dialog>closed</dialog><dialog open>opened</dialog>", "a\nopened"),
        ("<object data=x>fallback <b>text</b></object>", "fallback text"),
        ("<table><tr><td>a<td><td>c<tr><td>d<td>e<td></table>", "a |   | c\nd | e"),
    ],
    ids=lambda s: s[:24],
)
def test_what_is_seen(source, text):
    assert html.to_text(source).strip() == text


def test_tables_against_a_plain_layout():
    """Random small tables: every column begins where its widest cells let it."""
    rng = random.Random(9)
    for _ in range(300):
        rows = [[["".join(rng.choices("ab", k=rng.randint(0, 6))) for _ in range(rng.choice([1, 1, 2, 3]))] for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 4))]
        source = "<table>" + "".join("<tr>" + "".join("<td>" + "<br>".join(c) for c in row) for row in rows) + "</table>"
        shown = [[[x for x in c if x] for c in row] for row in rows]
        # A blank line inside a cell is kept where text follows it.
        shown = [[html.to_text("<div>" + "<br>".join(c) + "</div>").split("\n") for c in row] for row in rows]
        most = [max((len(x) for row in shown if i < len(row) for x in row[i]), default=0) for i in range(max(map(len, shown)))]
        want = []
        for row in shown:
            for k in range(max(map(len, row))):
                cells = [(c[k] if k < len(c) else "").ljust(w) for c, w in zip(row, most, strict=False)]
                while cells and not cells[-1].strip():
                    cells.pop()
                want.append(" | ".join(cells).rstrip())
        assert [x.rstrip() for x in html.to_text(source).split("\n")] == [x for x in want if x] or html.to_text(source) == ""


def test_wide_tables_stay_small():
    rows = "<tr><td>" + "w" * 100_000 + "<td>b" + "<tr><td>a<td>b" * 5_000
    text = html.to_text(f"<table>{rows}</table>")
    assert len(text) < 3_000_000 and "a" + " " * 199 + " | b" in text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
        ("<table><tr><td>a<td rowspan=3>b<td>c<tr><td>d<td>e<tr><td>f<td>g<tr><td>h<td>i<td>j</table>", "a | b | c\nd |   | e\nf |   | g\nh | i | j"),
        ("<table><tr><td colspan=2>a<td>b<tr><td>c<td>d<td>e</table>", "a |   | b\nc | d | e"),
        ("x <math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>no</annotation></math> y", "x a+b y"),
        ("x <svg><defs>no</defs><text>label</text></svg> y", "x label y"),
        ("pick <select><option>one<option selected>two<option>three</select> now", "pick two now"),
        ("pick <select><optgroup><option>one<option>two</select> now", "pick one now"),
        ("pick <select multiple><option>one<option>two</select>", "pick one two"),
        ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
        ("a <b title='never closed>b", "a"),
        ("<ul>" * 3 + "<li>x" + "</ul>" * 3 + "y", "- x\n\ny"),
    ],
)
def test_shown(source, text):
    assert html.to_text(source) == text


class Words(HTMLParser):
    """Visible words in their order, without any layout."""

    def __init__(self):
        super().__init__()
        self.hidden, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.words.append("|")
        if tag not in html.VOID and (self.hidden or tag in html.HIDDEN or "hidden" in dict(attrs) or html._GONE.search(dict(attrs).get("style") or "")):
            self.hidden += 1

    def handle_endtag(self, tag):
        self.words.append("|")
        if self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden:
            self.words += [data]


def visible(source):
    parser = Words()
    parser.feed(source)
    parser.close()
    return "".join(re.sub(r"\s+", "", x) for x in parser.words if x != "|")


def squeezed(text):
    return re.sub(r"\s+", "", re.sub(r"(?m)^ *(?:- |[0-9]+\. )+| \| |[“”]| \|$", "", text))


def test_random_pages_lose_no_visible_text():
    rng = random.Random(9)
    count = iter(range(10**9))

    def made(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            word = f"w{next(count)}x"
            if kind < 0.4 or depth > 6:
                out.append(f" {word} {entities.escape('<&>' * rng.randint(0, 1))} ")
            elif kind < 0.8:
                tag = rng.choice(["div", "section", "span", "b", "blockquote", "article", "em"])
                out.append(f"<{tag}{rng.choice(['', '', ' hidden', ' style="display:none"'])}>{made(depth + 1)}</{tag}>")
            elif kind < 0.9:
                out.append("<ul>" + "".join(f"<li>{made(depth + 1)}</li>" for _ in range(rng.randint(1, 3))) + "</ul>")
            else:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>w{next(count)}y</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
        return "".join(out)

    for _ in range(300):
        source = made(0)
        assert squeezed(html.to_text(source)) == visible(source)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_whole_table_against_plain_extraction(spark):
    from lexmill.llm.queries import QUERIES

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = {r.page_id: r for r in QUERIES["op3_html_layout"](spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(pages)
    for i, source in pages.items():
        want = sorted(re.findall(r"\w+", visible(source)))
        assert "".join(sorted("".join(re.findall(r"\w", got[i].text)))) == "".join(sorted("".join(want))) or sorted(re.findall(r"[^\W\d]", squeezed(got[i].text))) == sorted(re.findall(r"[^\W\d]", visible(source)))
        assert got[i].n_chars == len(got[i].text) and got[i].n_lines == got[i].text.count("\n") + bool(got[i].text)
