import pytest
from pyspark.sql import functions as F

from inkweave.functions import markdown as M

RULE_CASES = [
    ("colon_lines", "x\n:: note\ny", "x\n\ny"),
    ("class_braces", "a{.x y z=1}b", "ab"),
    ("bracket_braces", "[a]{.x}", "[a]"),
    ("odd_separators", "a\n---|---\nb\n--\n", "a\n\nb\n--\n"),
    ("empty_attributes", '<p class="" data-x="">', "<p>"),
    ("double_brackets", "[[a]]", "[a]"),
    ("space_before_hash", "a\n\n  # H", "a\n# H"),
    ("hash_at_end", "# H #  \nC#", "# H \nC"),
    ("quote_space", "  >\tq", "> q"),
    ("attribute_braces", "h {#id} x{.c}{k=v}", "h  x"),
    ("colon_fences", ":::tip\nbody\n:::\n", "body\n"),
    ("colon_fences", ":::\nrest", "\nrest"),
    ("code_fences", "``` {.py}\nx\n```  \n", "```\nx\n```"),
    ("code_fences", "```py  \nx", "```py\nx"),
    ("comments", "<!-- hi --><!-- -->", "[Comment: hi]"),
    ("heading_bang", "## ! Head", "## Head"),
    ("marker_bang", "- ! a\n> ! b\n1. !c", "- a\n> b\n1. c"),
    ("line_bang", "!Text\n![a](b)", "Text\n![a](b)"),
    ("blank_links", "[ ](http://x)", ""),
    ("symbol_links", "[¶](http://x)", "<http://x>"),
    ("data_images", "![a](data:image/png;base64,AA)", "[Embedded Image Removed]"),
    ("newline_runs", "a\n\n\n\nb", "a\n\nb"),
    ("blank_lines", "a\n \n\nb", "a\nb"),
    ("repeated_embedded", "[Embedded Image: a] [Embedded Image Removed] x", "[Embedded Image Removed] x"),
    ("repeated_embedded_v1", "[Embedded Image][Embedded Image]", "[Embedded Image]"),
    ("reference_marks", "a [1] b [2](x)", "a b [2](x)"),
    ("link_definitions", "[r]: http://x", ""),
]


def test_rules(spark):
    for name in {c[0] for c in RULE_CASES}:
        rows = [(a, b) for n, a, b in RULE_CASES if n == name]
        got = spark.createDataFrame(rows, "a string, b string").select("a", "b", M.apply_rule("a", name).alias("g")).collect()
        assert all(r.b == r.g for r in got), (name, got)


@pytest.mark.parametrize("step, text, want", [
    (M.plain_spaces, "a​b c", "ab c"),
    (M.trim_lines, " a \r\n\tb c \n", "a\nb\nc"),
    (M.drop_symbol_lines, "a\n~~~\n---\n\n* *\n```\n", "a\n---\n\n* *\n```\n"),
    (M.finish, "\n\n a \n\n", "a\n"),
    (M.strip_leftover_tags, "x <div> </div><section>y</section><br>", "x y<br>"),
    (M.rewrite_links_v2, '<a href="/p/q"></a> <a href="javascript:x">t</a> <a href="/u"><b>w</b></a> <a>n</a>',
     "[q](/p/q) t [w](/u) n"),
    (M.rewrite_images_v2, '<img src="a.png"> <img alt="x"> <img alt="" src=""> <img src="b.png" alt="B">',
     "![Image](a.png) [Image: x] [Image placeholder] ![B](b.png)"),
    (M.drop_empty_links, '<a href="x"> </a>y', "y"),
    (M.rewrite_images_v1,
     '<img src="spacer.gif"><img src="https://h/pic.png"><a href="/t" aria-label="L"><img src="i.png" alt="q"></a>'
     '<a href="/v"><img src="x.gif"></a><img alt="k"><img src="/a.png" alt="A">',
     "![Image](https://h/pic.png)[L](/t)[link](/v)[Image: k]![A](/a.png)"),
    (M.strip_frontmatter, "---\ntitle: a---b\n---\n\nx", "b\n---\n\nx"),
    (M.strip_frontmatter, "x\n---\ny", "x\n---\ny"),
])
def test_steps(spark, step, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(step(F.col("t")).alias("g")).first().g
    assert got == want


def test_chains(spark):
    text = "  # Title {#id}\n\n\n\n::: tip\nbody\n:::\n\nsee [1] [¶](http://x)\n~~~\n<div><a href='/k/z'></a></div>\n"
    row = spark.createDataFrame([(text,)], "t string").select(M.clean_v2("t").alias("v2"), M.clean_v1("t").alias("v1")).first()
    assert row.v2 == "# Title\n\nbody\n\nsee <http://x>\n[z](/k/z)\n"
    assert "\n\n\n" not in row.v1 and "<div>" not in row.v1


def test_cleaning_is_idempotent(spark):
    texts = ["# A\n\nb [x](/y)\n", "> q\n\n- a\n- b\n", "```py\nx = 1\n```\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", M.clean_v2("t").alias("a"))
    assert all(r.t == r.a == r.b for r in df.withColumn("b", M.clean_v2("a")).collect())


def test_frontmatter(check):
    check("t string, want string", [('a"b', '---\ntitle: "a\\"b"\nsource_url: u\ndate_generated: d\n---\n\n')],
          M.frontmatter_v2("t", F.lit("u"), F.lit("d")))
    check("t string, want string", [('a"b', '---\ntitle: "a\'b"\nsource_url: "u"\ndate: "dZ"\n---\n\n')],
          M.frontmatter_v1("t", F.lit("u"), F.lit("d")))
