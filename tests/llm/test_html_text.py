import html
import html.parser
import re

import pytest

from sessionlake.llm import html_text
from sessionlake.llm.html_text import text_of


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\n\nb"), ("<div>a<div>b</div>c</div>", "a\nb\nc"), ("a <b> b </b> c", "a b c"), ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<ul><li>x<li>y<ul><li>z</ul></ul>", "- x\n- y\n  - z"), ("<ol start=9><li>x<li value=20>y<li>z</ol>", "9. x\n20. y\n21. z"),
        ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a   | bb\nccc | d"), ("<table><td>a<td>b</table>", "a | b"), ("<table><tr><td colspan=2>wide<td>x<tr><td>1<td>2<td>3</table>", "wide  | x\n1 | 2 | 3"),
        ("<pre>\n a\n  b </pre>", " a\n  b"), ("<p hidden>a</p><p style='display: none'>b<p>c", "c"), ("<style>.x, p#y {display:none}</style><p class='q x'>a<p id=y>b<div id=y>c</div>", "c"),
        ("<script>if (a < b) '</p>'</script>x<!-- <p>no --> y", "x y"), ("<title>no</title><textarea>\n a <b> </textarea>", " a <b>"), ("<details><summary>s</summary>no</details><details open>yes</details>", "s\nyes"),
        ("<dialog>no</dialog><select><option>a<option selected>b</select>", "b"), ("1 < 2 <3 & 4", "1 < 2 <3 & 4"), ("<a title='>'>x</a><a title=\"y", "x"), ("x</p>y</div>z", "xyz"), ("a&nbsp;&nbsp;b", "a  b"),
        ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"), ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"), ("<h1>a<h2>b</h2>c", "a\n\nb\n\nc"), ("<noscript>n</noscript><svg><text>no</text></svg>", "n"),
        ("<table><tr><td><table><tr><td>i<td>j</table><td>k</table>", "i | j | k"), ("<P>A<LI>b", "A\n\n- b"), ("<table>stray<tr><td>a</table>", "stray\na"),
    ],
)
def test_layout(page, text):
    assert text_of(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p style='-webkit-backface-visibility: hidden; backface-visibility:hidden'>a", "a"), ("<style>.a{backface-visibility:hidden}</style><p class=a>a", "a"),
        ("<style>@media print{.n{display:none}} @media screen and (max-width:600px){.n{display:none}}</style><p class=n>a", "a"), ("<style>@media screen{.n{display:none}}</style><p class=n>a<p>b", "b"),
        ("<style media=print>p{display:none}</style><p>a", "a"), ("<style>.x{display:none}.x{display:block}</style><p class=x>a", "a"), ("<style>.x{display:block}.x{display:none}</style><p class=x>a<p>b", "b"),
        ("<style>#i{display:block}.x{display:none}</style><p class=x id=i>a", "a"), ("<style>.x{display:none!important}</style><p class=x style='display:block'>a<p>b", "b"),
        ("<style>@keyframes k{from{visibility:hidden}}/* p{display:none} */</style><p>a", "a"), ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b></div>", "b"),
    ],
)
def test_visibility(page, text):
    assert text_of(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<math><mfrac><mi>x</mi><mn>2</mn></mfrac><annotation>tex</annotation></math>", "x 2"), ("<svg><g><rect/><text y=5>one</text></g><text y='9'>two</text><defs><text y=1>no</text></defs></svg>", "one\ntwo"),
        ("<object data=x><p>instead</object>", "instead"), ("<select><optgroup label=g><option>a<option selected>b</optgroup></select>", "b"),
        ("<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e</table>", "a | b | c\n  | d | e"), ("<table><tbody><tr><td rowspan=9>a<td>b</tbody><tbody><tr><td>c<td>d</table>", "a | b\nc | d"),
        ("<table><tr><td>" * 14 + "<table><tr><td>a<td>b</table>", "a | b"),
    ],
)
def test_shown_parts(page, text):
    assert text_of(page) == text


class Words(html.parser.HTMLParser):
    """The visible words of pages without tables, by the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.off, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title", "head")
        self.out.append(" " if tag in html_text.BLOCKS or tag == "br" else "")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title", "head")
        self.out.append(" " if tag in html_text.BLOCKS else "")

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)


def test_words_against_the_standard_parser(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(rows).collect()}
    for r in rows.collect():
        parser = Words()
        parser.feed(r.html)
        parser.close()
        assert re.sub(r"(?m)^\s*(- )+", "", got[r.page_id]).split() == "".join(parser.out).split()


def test_deep_long_and_hostile_pages():
    assert text_of("<div>" * 50_000 + "x") == "x" and text_of("<table><tr><td>" * 200 + "x").strip() == "x" and text_of("<b>" * 50_000 + "x") == "x"
    assert text_of("<a '" * 20_000) == "" and len(text_of("<" * 50_000)) == 50_000 and text_of("<p>word " * 100_000).count("word") == 100_000


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "<p>a", 5), (2, "<p>a", 5), (2, "<p>a", 5)], "page_id bigint, html string, text int")
    assert sorted((str(r.page_id), r.text) for r in html_text.extract(df).collect()) == [("1", None), ("2", "a"), ("2", "a"), ("None", "a")]
    assert html_text.extract(df.limit(0)).count() == 0
