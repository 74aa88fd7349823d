import pytest
from pyspark.sql import functions as F

from inkweave.functions import html as H
from inkweave.operators import content as C


def pages(spark, *bodies):
    return spark.createDataFrame([(i, f"https://h/a/p{i}", b) for i, b in enumerate(bodies)],
                                 "page_id long, url string, html string")


def evaluate(spark, text, expression):
    return spark.createDataFrame([(text,)], "x string").select(expression(F.col("x")).alias("g")).first().g


@pytest.mark.parametrize("html, want", [
    ("<h1 id=a>One</h1><p>Two <b>bold</b> and <em>it</em></p>", "# One\n\nTwo **bold** and *it*\n"),
    ("<p>a<br>b</p><hr/><p>c</p>", "a  \nb\n\n---\n\nc\n"),
    ("<p>x <b> y </b>z <strong><i>q</i></strong></p>", "x  **y** z ***q***\n"),
    ("<ul><li>a<li>b<ul><li>c</li></ul></li></ul><p>z</p>", "- a\n- b\n  - c\n\nz\n"),
    ("<ol><li><p>a</p></li><li>b<ol><li>c</li></ol></li><li>d</li></ol>", "1. a\n\n2. b\n  1. c\n3. d\n"),
    ("<p>q:</p><blockquote><p>one</p><p>two</p><blockquote>in</blockquote></blockquote><p>z</p>",
     "q:\n\n> one\n> \n> two\n\n> > in\n\nz\n"),
    ("<pre><code># not a heading\n  x &lt; 1\n</code></pre>", "```\n# not a heading\n  x < 1\n```\n"),
    ("run <code>a  b</code>", "run `a b`\n"),
    ('<a href="/x" title="T">t</a> <a name=k>n</a>', '[t](/x "T") n\n'),
    ('<img src="a.png"><img src="data:image/png;base64,AA" alt="p"><img alt="q"><img>',
     "![Image](a.png)[Embedded Image: p][Missing Image Source: q][Missing Image Source]\n"),
    ("<table><tr><th>A</th><th>B|C</th></tr><tr><td><a href=x>1</a></td><td><span>2</span></td></tr></table>",
     "| A | B\\|C |\n| --- | --- |\n| [1](x) | 2 |\n"),
    ("<p>&amp;lt; &copy; &#233; &#x4e2d; &nope; &eacute;</p>", "&lt; © é 中 &nope; é\n"),
    ("<p>a\n   b</p>", "a b\n"),
    ("<p title='x > y'>a</p>", "a\n"),
    ("<p>one<p>two <b>open", "one\n\ntwo open\n"),
])
def test_conversion(spark, html, want):
    assert evaluate(spark, html, H.html_to_md) == want


def test_line_breaks_kept_by_first_profile(spark):
    assert evaluate(spark, "<p>a \n  b</p>", lambda x: H.html_to_md(x, "v1")) == "a\nb\n"


@pytest.mark.parametrize("html, selector, content", [
    ('<body><article>x</article><div role="main">y<div>z</div></div>t</body>', 'div[role="main"]',
     '<div role="main">y<div>z</div></div>'),
    ('<div class="a theme-doc-markdown b markdown">q</div><main>m</main>', "div.theme-doc-markdown.markdown",
     '<div class="a theme-doc-markdown b markdown">q</div>'),
    ('<main><p>n</p><section class="content">c</section></main>', "main .content", '<section class="content">c</section>'),
    ('<p class="content">c</p><i id="content">d</i>', "#content", '<i id="content">d</i>'),
    ('<div class="main-contents">no</div><p class="x main-content">c</p>', ".main-content",
     '<p class="x main-content">c</p>'),
    ("<body class=b>t</body>", "body", "<body class=b>t</body>"),
    ("plain", None, "plain"),
    ("<article>open", "article", "<article>open"),
])
def test_main_content(spark, html, selector, content):
    got = evaluate(spark, html, H.main_content)
    assert (got.selector, got.html) == (selector, content)


def test_furniture_goes_only_off_the_body(spark):
    body = "<body><header>h</header><p>x</p><nav><nav>n</nav>m</nav><footer>f</footer>y</body>"
    assert evaluate(spark, body, H.content_html_v2) == "<body><p>x</p>y</body>"
    kept = "<main><header>h</header>x</main>"
    assert evaluate(spark, kept, H.content_html_v2) == kept


def test_noise(spark):
    html = "a<script>var t='</p>';</script><!-- <p> --><STYLE>x</STYLE><meta a=b>b<svg><path/></svg><noscript>n</noscript>"
    assert evaluate(spark, html, H.drop_noise) == "ab"


def test_titles(spark):
    df = spark.createDataFrame([
        ("https://h/a/b", "<title> A &amp; B </title>", "A & B", "A & B"), ("https://h/a/b", "<title> </title>", "b", "Untitled"),
        ("https://h/", "<p>", "h", "Untitled"), ("", "", "Untitled Page", "Untitled")], "url string, html string, v2 string, v1 string")
    for r in df.withColumn("g2", H.title_v2("html", "url")).withColumn("g1", H.title_v1("html")).collect():
        assert (r.g1, r.g2) == (r.v1, r.v2)


def test_page_tables(spark):
    source = pages(
        spark, '<title>T</title><body><img src=a.png><img src="data:image/x"><table><tr><td>1<td>2</tr></table></body>', "", "<script>x</script>")
    images = {r.pos: (r.alt, r.placeholder) for r in C.images(source).collect()}
    assert images == {0: ("Image", None), 1: ("", "[Embedded Image Removed]")}
    assert [(r.row_no, r.col_no, r.text) for r in C.table_cells(source).collect()] == [(0, 0, "1"), (0, 1, "2")]
    got = {r.page_id: r for r in C.to_markdown(source).collect()}
    assert got[0].conversion_status == "converted" and got[0].title == "T"
    assert got[1].conversion_status == "failed" and got[1].md.startswith("## Conversion Failed for https://h/a/p1")


def test_deep_and_long_pages_do_not_overflow(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    long = "<article>" + "<p>" + "word <b>b</b> " * 20000 + "</p></article>"
    got = {r.page_id: r.md for r in C.to_markdown(pages(spark, f"<body>{deep}</body>", long)).collect()}
    assert got[0] == "x\n" and got[1].count("**b**") == 20000


def test_noise_keeps_custom_elements_and_drops_nested_objects(spark):
    html = "<video-player>keep1</video-player><p>keep2</p><video>z</video><OBJECT a='1'><object>x</object>y</OBJECT><p>keep3</p>"
    assert evaluate(spark, html, H.drop_noise) == "<video-player>keep1</video-player><p>keep2</p><p>keep3</p>"
    assert evaluate(spark, "<object>a<p>b", H.drop_noise) == "a<p>b"
    assert evaluate(spark, "&#x000000E9;&#000000233;&#x110000;&#99999999999;", H.decode_entities) == "éé&#x110000;&#99999999999;"


def test_conversion_looks_no_character_up(spark):
    """Only code blocks go through a table of characters; page text is searched for single signs."""
    page = "<body><blockquote><p>q x</p></blockquote><pre>a\n\t b</pre>​</body>"
    pages = spark.createDataFrame([(1, "https://h/", page)], "page_id long, url string, html string")
    got = C.to_markdown(pages)
    assert got.first()["md"] == "> q x\n\n```\na\nb\n```\n"
    assert got._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
