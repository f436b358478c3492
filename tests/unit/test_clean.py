import pytest
from pyspark.sql import functions as F

from tidewell.functions.clean import clean_title, html_clean, main_block, markdown
from tidewell.functions.urls import dedupe_key, export_path, path_words, portable

CASES = [
    ("<p>Hello <b>world</b></p>", "", "Hello world"),
    ("<body><script>x<y</script><style>p{}</style><nav>menu</nav><p>Text</p><footer>f</footer></body>", "", "Text"),
    ("a<!-- gone -->b", "", "ab"),
    ("1 < 2 and 3 > 2", "", "1 < 2 and 3 > 2"),
    ("open <b never closed", "", "open"),
    ("a&nbsp;b&amp;c&apos;d", "", "a b&c'd"),
    ('<div id="main-content"><div>in</div>side</div><p>out</p>', "", "inside"),
    ('<section id="main-content">never closed', "", "never closed"),
    ('<p>x</p><div class="site-footer"><span>gone</span>rest</div>', "", "xrest"),
    ("<h1>Title</h1> Body text", "Title", "Body text"),
    ("x" * 60 + "Title", "Title", "x" * 60 + "Title"),
    ("", "", ""),
    ("<>a", "", "a"),
    ("<body>no end", "", "no end"),
]


def test_clean(spark):
    df = spark.createDataFrame([(i, h, t) for i, (h, t, _) in enumerate(CASES)], "i int, h string, t string")
    got = {r["i"]: r["x"] for r in df.select("i", html_clean(F.col("h"), F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(CASES))] == [w for _, _, w in CASES]


def test_titles(spark):
    df = spark.createDataFrame([("<b>A</b> &amp; <script>x</script>B",)], "t string")
    assert df.select(clean_title(F.col("t"))).first()[0] == "A & B"


@pytest.mark.parametrize("html,want", [('<div id="main-content">a</div>', "a"), ("<p>no</p>", None), ('<main id="main-content"><main>x</main>y</main>z', "<main>x</main>y"), ('<div id="main-content">a', None)])
def test_main_block(html, want):
    assert main_block(html) == want


def test_urls(spark):
    rows = [("https://x.org/a/b.html?q=1#f", "/a/b.html?q=1#f", "a/b.html/index.html"), ("https://x.org", "/", "index.html"), ("/docs/", "/docs/", "docs/index.html"), ("/a//b", "/a//b", "a//b/index.html"), ("http://x.org?q", "/?q", "index.html")]
    df = spark.createDataFrame([(u,) for u, _, _ in rows], "u string")
    assert [tuple(r) for r in df.select("u", portable(F.col("u")), export_path(F.col("u"))).collect()] == rows
    one = spark.createDataFrame([("/A/Page.HTML", "/blog/my-post.html?x")], "a string, b string")
    assert tuple(one.select(dedupe_key(F.col("a")), path_words(F.col("b"))).first()) == ("/a/page", "blog my-post")


def test_markdown():
    assert markdown("") == ""
    assert markdown("- a\n- **b**\n\ntext *i* <x>") == "<ul><li>a</li><li><strong>b</strong></li></ul><p>text <em>i</em> &lt;x&gt;</p>"
    assert markdown("see [label](https://x.org/long") == "<p>see <strong>label</strong></p>"
    assert '<a href="https://x.org"' in markdown("[l](https://x.org)")


@pytest.mark.parametrize(
    "text,html",
    [
        ("***a***", "<p><strong><em>a</em></strong></p>"),
        ("**a *b* c**", "<p><strong>a <em>b</em> c</strong></p>"),
        ("2 * 3", "<p>2 * 3</p>"),
        ("[label] only", "<p><strong>label</strong> only</p>"),
        ("[x](javascript:alert)", "<p>[x](javascript:alert)</p>"),
        ("- [a](/b?c=1&d=2)", '<ul><li><a href="/b?c=1&amp;d=2" target="_blank" rel="noopener">a</a></li></ul>'),
        ('[" onx=](https://x/"y) it\'s', '<p><a href="https://x/&quot;y" target="_blank" rel="noopener">&quot; onx=</a> it&#039;s</p>'),
    ],
)
def test_markdown_spans(text, html):
    assert markdown(text) == html


def test_references_of_any_length(spark):
    from tidewell.functions.clean import decode_entities

    df = spark.createDataFrame([("&#" + "9" * 5000 + ";", "&#" + "0" * 5000 + "65; &lt;")], "a string, b string")
    assert tuple(df.select(decode_entities("a"), decode_entities("b")).first()) == ("\ufffd", "A <")


def test_references_without_a_semicolon_are_text():
    from html import unescape
    from html.entities import html5

    from tidewell.functions.clean import _decode

    for text in ("a&ampThe", "&copy", "&#65", "&#065 ", "&#x41 b", "&notit;", "&;", "&#;", "&#x;", "& amp;", "&amp"):
        assert _decode(text) == text
    for name in html5:
        assert _decode(f"a&{name}b") == ("a" + html5[name] + "b" if name.endswith(";") else f"a&{name}b")
    for number in ("0", "00", "65", "0065", "128", "55296", "1114111", "1114112", "9999999", "x41", "X1F600", "x" + "f" * 5000):
        assert _decode(f"&#{number};") == unescape(f"&#{number};")
    assert _decode("&amp;quot; &amp;amp;") == "&quot; &amp;"


@pytest.mark.parametrize("part", ["< id='x", "<a id='x", "<!--", "<script", "<script>", "</script ", "<nav>", "<div id='main-content'>", '<p class="footer">', "<p class=footer id='", "<", "<a b c=\"", "<body>", "</body", "<x a a a a", "<style>a</style", " \t", "&#0", "<footer id=\"", "<a" + " " * 50])
def test_cleaning_takes_linear_time(part):
    import time

    from tidewell.functions.clean import _decode
    from tidewell.functions.regions import Page

    def seconds(n):
        html = part * (n // len(part)) + "x"
        start = time.process_time()
        _decode(Page(html).text())
        return time.process_time() - start

    assert seconds(1_000_000) < max(16 * seconds(125_000), 1.0)


def test_regions():
    from tidewell.functions.regions import Page

    for html, want in [
        ("a<nav>b<nav>c</nav>d</nav>e", "ade"),
        ("a<script>x</b><p>y</script>b", "ab"),
        ("a<script>never", "anever"),
        ("a<style media='x'>p > q</STYLE >b", "ab"),
        ("a<div ID = 'Page-Footer'>b</p>c</div>d", "acd"),
        ("a<div data-id='footer'>b</div>c", "abc"),
        ("a<div id='footer'><script>x</script>b</div>c", "abc"),
        ("a<!-- <nav> -->b</nav>c", "abc"),
        ("a<!-- b>c", "ac"),
        ("a<nav-bar>b</nav-bar>c", "abc"),
        ("<BODY x>a<footer\n>b</FOOTER>c</Body>d", "ac"),
        ("x<div><main id=\"main-content\">a<main>b</main><nav>n</nav>c</main>d</div>", "abc"),
        ("<script>'<div id=\"main-content\">'</script><body>a</body>", "a"),
        ("a <", "a <"),
        ("a < b", "a < b"),
        ("<", "<"),
    ]:
        assert Page(html).text() == want, html


def test_regions_equal_single_passes_on_given_pages(spark):
    """Each kind of element taken out by itself, as often as it takes, by plain searches."""
    from tidewell.functions.regions import Page

    def without(html, name):
        low = html.lower()
        while (a := low.find(f"<{name}>")) >= 0 or (a := low.find(f"<{name} ")) >= 0:
            b = low.index(f"</{name}>", a) + len(name) + 3
            html, low = html[:a] + html[b:], low[:a] + low[b:]
        return html

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        html = r["html"]
        want = html[html.index(">", html.index("<body")) + 1 : html.index("</body>")] if "<body" in html and "</body>" in html else html
        while (a := want.find("<!--")) >= 0:
            want = want[:a] + want[want.index("-->", a) + 3 :]
        for name in ("footer", "script", "style", "nav"):
            want = without(want, name)
        text = ""
        while want:
            a = want.find("<")
            text, want = (text + want, "") if a < 0 else (text + want[:a], want[want.index(">", a) + 1 :])
        assert Page(html).text() == text
