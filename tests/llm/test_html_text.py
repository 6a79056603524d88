import pytest

from twinloom.llm.html_text import extract_text, render
from twinloom.llm.queries import op7_html_extraction

FOLDER = "/root/testdata/sf0.001"

CASES = [
    ("", ""),
    ("plain  text\n here", "plain text here"),
    ("<p>one<p>two<div>three</div>four", "one\n\ntwo\n\nthree\nfour"),
    ("<b>a</b><i>b</i> c", "ab c"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>after", "- a\n- b\n  - c\n- d\n\nafter"),
    ("<ol start=3><li>a<li value=7>b<li>c", "3. a\n7. b\n8. c"),
    ("<table><tr><th>name<th>n<tr><td>long name<td>1</table>", "name       n\nlong name  1"),
    ("<table><tr><td colspan=2>wide cell here<td>x<tr><td>a<td>b<td>c</table>", "wide cell here  x\na  b  c"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
    ("<table><caption>cap</caption><tbody><tr><td>1<td>2</table>", "cap\n1  2"),
    ("<td>stray</td> cell", "stray\ncell"),
    ("<script>x<p>y</script>a<style>b</style><!-- c --><template>d</template>e", "ae"),
    ("<p hidden>no</p><p style='display: none'>no</p><p style=visibility:hidden>no</p>yes", "yes"),
    ("<title>t</title><p>body", "body"),
    ("<head><title>t</title><p>body text ends the head", "body text ends the head"),
    ("<pre>a\n  b\n\nc</pre>", "a\n  b\n\nc"),
    ("a &lt;b&gt; &amp; &eacute;&#33; 1 < 2", "a <b> & é! 1 < 2"),
    ("<p>cut off <b>bold", "cut off bold"),
    ("text <a href='x>y'>link</a>", "text link"),
    ("<img alt='a picture'><img src=x>", "a picture"),
    ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\n  d1\n  d2"),
    ("<select><option>a<option>b</select>c<noscript>n</noscript>", "a c"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("<script>unclosed", ""),
    ("<!doctype html><html><body><h1>H</h1><h2>I</h2>x", "H\n\nI\n\nx"),
    ("</p>a</div></span>", "a"),
    ("<table><tr><td><ul><li>x<li>y</ul><td>z</table>", "- x - y  z"),
    ("<DIV>A</DIV><Div>B</dIV>", "A\nB"),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_render(html, text):
    assert render(html) == text


def test_depth_and_length():
    assert render("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert render("<ul><li>" * 1000 + "x").split()[-1] == "x"
    assert render("<b" + " a=1" * 10_000 + ">x").endswith("x")
    assert len(render("<p>word</p>" * 20_000).split()) == 20_000
    assert render("<" * 10_000).count("<") == 10_000


def test_table_rows(spark):
    rows = [(1, "u", "<p>a"), (2, None, None), (3, "u", ""), (None, "u", "<b>x"), (1, "u", "<p>a")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    found = sorted(map(tuple, extract_text(pages).collect()), key=repr)
    assert found == sorted([(1, "a"), (2, ""), (3, ""), (None, "x"), (1, "a")], key=repr)
    assert extract_text(pages.limit(0)).count() == 0


def test_all_visible_words_of_the_table(spark):
    """The text has exactly the words outside tags, scripts and styles, in their order."""
    import re
    from html import unescape

    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    found = op7_html_extraction(spark, FOLDER).collect()
    assert len(found) == len(html)
    for row in found:
        page = re.sub(r"<head>.*?</head>|<!--.*?-->", "", html[row["page_id"]], flags=re.S)
        want = unescape(re.sub(r"<[^>]*(>|$)", " ", page)).split()
        assert [w for w in row["text"].split() if w != "-"] == [w for w in want if w != "-"]


@pytest.mark.parametrize(
    "html, text",
    [
        ("where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> is", "where x=2 is"),
        ("<math><semantics><mi>y</mi><annotation>\\y</annotation></semantics></math> z", "y z"),
        ("a<svg><title>t</title><desc>d</desc><defs><text>n</text></defs><text>b</text><text>c</text></svg>d", "a b c d"),
        ("<svg><defs/><path d='M0 0'/><text>b</text></svg>", "b"),
        ("<svg><foreignObject><div>in<desc>e</desc></div></foreignObject></svg>", "ine"),
        ("<desc>shown</desc>", "shown"),
        ("pick <select><option>a<option selected>b<option>c</select> now", "pick b now"),
        ("<select multiple><option>a<option>b</select>", "a\nb"),
        ("pick <select><option disabled>a<optgroup><option>b<option>c</select> now", "pick b now"),
        ("pick <select></select> now", "pick now"),
    ],
)
def test_drawings_formulas_and_choices(html, text):
    assert render(html) == text
