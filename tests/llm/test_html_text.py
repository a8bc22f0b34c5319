import re
from html.parser import HTMLParser

import pytest

from replenish.llm.html_text import extract, page_text

CASES = {
    "": "",
    "plain &amp; text": "plain & text",
    "<p>one<p>two  \n three</p>four": "one\n\ntwo three\n\nfour",
    "<div>a<div>b</div>c</div>d": "a\nb\nc\nd",
    "<b>a</b><i> b</i>c <em>d</em>": "a bc d",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e": "* a\n* b\n  * c\n* d\n\ne",
    "<ol start=3><li>a<p>b</p></li><li>c</li></ol>": "3. a\n\n   b\n\n4. c",
    "<table><tr><th>name<th>n<tr><td>long cell<td>1<tr><td>x<td>22</table>": "name       n\nlong cell  1\nx          22",
    "<table><tr><td colspan=2>wide<td>c<tr><td>a<td>bb<td>d</table>": "wide   c\na  bb  d",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a  b\n   c",
    "<table><tr><td>a<br>b<td>c</table>": "a  c\nb",
    "<table><tr><td><table><tr><td>x<td>y</table><td>z</table>": "x  y  z",
    "<head><title>no</title><style>p{}</style></head><body>yes<script>var t='</p>'</script>!": "yes!",
    "<p hidden>no</p><p style='color:red; display : none'>no</p><p style='visibility:hidden'>no</p>yes": "yes",
    "a<!-- <p>no</p> -->b<!-- open": "ab",
    "a</b></p>b": "a\n\nb",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<pre>\n  x\n   y</pre>z": "  x\n   y\n\nz",
    "a &copy &nbsp;&#65; &unknown; < b <3": "a © \xa0A &unknown; < b <3",
    "x<a href='>'>y</a><a b\"c>z</a>": "xyz",
    "x<a href=\"never closed>y": "x",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "<textarea><b>&lt;</textarea>q": "<b><q",
    "<select><option>a<option>b</select>": "a\nb",
    "<li>a<li>b": "* a\n* b",
    "<tr><td>a</td></tr>": "a",
    "<h1>T</h1><p>a</p><hr><p>b": "T\n\na\n\nb",
    "<blockquote>q<br>r</blockquote>s": "  q\n  r\n\ns",
    "<p>a<br></p><p>b": "a\n\nb",
    "<p>a<table><tr><td>b</table>": "a\n\nb",
    "<p><b>a<p>b</b>c": "a\n\nbc",
    "a<!-->b<!--->c<!-- x -- y -->d<!--e--!>f": "abcdf",
    "x <math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>a+b</annotation></math> y": "x a+b y",
    "u<svg><title>no</title><defs><text>no</text></defs><path d='M0'/> no <text>label <tspan>one</tspan></text><desc>no</desc></svg>v": "ulabel onev",
    "<xmp><b>raw</b> &lt;\n  two</xmp>z": "<b>raw</b> &lt;\n  two\n\nz",
}


@pytest.mark.parametrize("page", CASES)
def test_cases(page):
    got = page_text(page)
    want = CASES[page]
    assert got == want or [x.rstrip() for x in got.split("\n")] == [x.rstrip() for x in want.split("\n")]


class Visible(HTMLParser):
    """Words outside head, script and style, in order."""

    def __init__(self):
        super().__init__()
        self.off, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("head", "script", "style")

    def handle_endtag(self, tag):
        self.off -= tag in ("head", "script", "style")

    def handle_data(self, data):
        if not self.off:
            self.words.append(data)


def test_pages_keep_all_visible_characters(spark, sf0001):
    pages = spark.read.parquet(f"{sf0001}/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    assert len(got) == pages.count()
    squeeze = lambda s: re.sub(r"[\s*]+", "", s)  # noqa: E731  (bullets are added)
    for r in pages.collect():
        v = Visible()
        v.feed(r.html)
        v.close()
        assert squeeze(got[r.page_id]) == squeeze("".join(v.words))


def cells_of(rng, n_rows, n_cols):
    words = ["a", "bb", "ccc dd", "e f g", "", "é😀", "long cell of words"]
    return [[words[rng.randrange(len(words))] for _ in range(n_cols)] for _ in range(n_rows)]


def test_table_cells_stand_in_columns():
    """Every cell begins where its column does: two blanks after the widest cell of the column before."""
    import random

    rng = random.Random(8)
    for _ in range(200):
        rows = cells_of(rng, rng.randint(1, 5), rng.randint(1, 4))
        page = "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in rows) + "</table>"
        lines = page_text(page).split("\n")
        widths = [max(len(r[c]) for r in rows) for c in range(len(rows[0]))]
        at = [sum(w + 2 for w in widths[:c]) for c in range(len(widths))]
        shown = [r for r in rows if any(r)]
        want = []
        for r in rows:
            line = ""
            for c, cell in enumerate(r):
                if cell:
                    line = line.ljust(at[c]) + cell
            want.append(line)
        assert [x for x in lines if x] == [x for x in want if x], page
        assert len([x for x in lines if x]) == len(shown)


def test_deep_and_long_pages_take_linear_time():
    assert page_text("<div>" * 30000 + "x" + "</span>" * 30000) == "x"
    assert page_text("<b>" * 50000 + "y") == "y"
    assert len(page_text("<p>" + "w " * 300000)) == 599999
    assert page_text("<a '" * 30000 + "z").count("z") in (0, 1)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "t"), (None, "<p>a", "t"), (2, "", "t"), (2, "", "t")], "page_id long, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in extract(df).collect()) == [(0, "a"), (1, ""), (2, ""), (2, "")]
    assert extract(df.limit(0)).count() == 0
