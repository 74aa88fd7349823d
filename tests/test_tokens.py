import re

from pyspark.sql import functions as F

from inkweave.functions import html as H
from inkweave.operators import links as L
from inkweave.operators import tokens as T

PAGES = [
    (1, "<!DOCTYPE html><body><!-- <nav> --><p>a<b>c<p>d</p></nav><nav id=x><ul class='nav'><li><a href='/1'>1</a><li><a href=\"/2\">2</a></ul></nav><a href='/3'>3</a>"),
    (2, "<div class='menu'><div><a href=/4>4</a></div><a>no</a><div class=toc><a href='/5'/></div></div><a href='/6'>6</a><script>'<a href=\"/7\">' </div></script><aside class='side nav'><a href='/8'>8</a>"),
    (3, ""), (4, "plain < text > only"), (5, "</div><div class=\"content\">x<br/>é😀<div>y</div>z</div> tail"),
    (6, "<main><div>no</div></main><div class='content'>out</div><main class=m><p class='a content b'>in<p>more</main>"), (7, "<article>never closed <b>x</b>"),
]


def table(spark):
    return spark.createDataFrame([(i, f"https://h/{i}", h) for i, h in PAGES], "page_id long, url string, html string")


def test_tokens_are_the_page(spark):
    got = {}
    for r in T.token_table(table(spark)).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append(r)
    for i, html in PAGES:
        rows = got.get(i, [])
        assert "".join(r.source for r in rows) == html
        assert all(html[r.begin:].startswith(r.source) for r in rows) if all(ord(c) < 65536 for c in html) else True
    one = {r.pos: r for r in got[1]}
    names = {r.pos: (r.kind, r.name) for r in got[1]}
    ends = {names[r.pos][1]: one[r.until].source for r in got[1] if r.until is not None and r.name != "p" and r.name != "a"}
    assert ends == {"nav": "</nav>", "ul": "</ul>"} and [k for k, n in names.values() if n == "nav"] == ["close", "open", "close"]
    assert {r.source: r.depth for r in got[1] if r.source in ("1", "3", "d")} == {"1": 3, "3": 1, "d": 1}
    assert [r.kind for r in got[2] if r.name == "script"] == ["raw"]


def test_navigation_equals_the_tag_walk(spark):
    pages = table(spark)
    for profile in ("v1", "v2"):
        want = sorted(map(tuple, L.navigation_links(pages, profile).collect()))
        assert sorted(map(tuple, T.navigation_links(T.token_table(pages), profile).collect())) == want and want


def test_main_content_equals_the_text_search(spark):
    pages = table(spark)
    for profile in ("v1", "v2"):
        source = H.drop_noise("html") if profile == "v2" else F.col("html")
        chosen = pages.select("page_id", H.main_content(source, profile).alias("c")).select("page_id", "c.selector", "c.html")
        assert sorted(map(str, map(tuple, T.main_content(pages, profile).collect()))) == sorted(map(str, map(tuple, chosen.collect())))


def test_one_shuffle(spark):
    plan = T.navigation_links(T.token_table(table(spark)))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_token_table_without_text(spark):
    """Only opening and void tags keep their source; navigation and main content need no more."""
    html = '<nav class="x"><a href="/a">a</a> text <!-- c --></nav><main>m <b>b</b></main><a href="/z">z</a><script>s</script>'
    pages = spark.createDataFrame([(1, "https://h/", html)], "page_id long, url string, html string")
    whole, lean = T.token_table(pages), T.token_table(pages, text=False)
    rest = [c for c in whole.columns if c != "source"]
    assert sorted(whole.select(*rest).collect(), key=str) == sorted(lean.select(*rest).collect(), key=str)
    kept = {r.kind for r in lean.where("source IS NOT NULL").collect()}
    assert kept == {"open"} and lean.where("kind = 'open' AND source IS NULL").count() == 0
    assert [r.href for r in T.navigation_links(lean).collect()] == ["/a"] == [r.href for r in T.navigation_links(whole).collect()]
    assert T.main_spans(lean).collect() == T.main_spans(whole).collect()
