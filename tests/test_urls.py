from urllib.parse import urljoin, urlsplit

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkweave.functions import urls


def test_join(check):
    rows = [
        ("https://h/a/b", "/x", "https://h/x"),
        ("https://h/a/b", "c", "https://h/a/c"),
        ("https://h/a/b/", "../c/./d", "https://h/a/c/d"),
        ("https://h/a", "//k/z", "https://k/z"),
        ("https://h/a?p=1", "?q=2", "https://h/a?q=2"),
        ("https://h/a", "#top", "https://h/a#top"),
        ("https://h", "c", "https://h/c"),
        ("https://h/a/b/c", "../../../../x", "https://h/x"),
        ("https://h/a", "", "https://h/a"),
        ("https://h/a/b", "..", "https://h/"),
        ("https://h/a/b", ".", "https://h/a/"),
        ("https://my_host.com/a", "/b", "https://my_host.com/b"),
        ("https://h/a", "mailto:x@y", "mailto:x@y"),
    ]
    check("base string, href string, want string", rows, urls.join("base", "href"))


def test_join_agrees_with_standard_library(spark):
    piece = st.sampled_from(["a", "b.html", "..", ".", "c d", "é", "x_y"])
    path = st.lists(piece, max_size=5).map("/".join)

    @settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.tuples(path, path, st.sampled_from(["", "/"]), st.sampled_from(["", "/"]),
                              st.sampled_from(["", "?q=1", "#f"])), min_size=60, max_size=60))
    def run(cases):
        rows = [(f"https://host.x/{a}{s}", f"{lead}{b}{t}", urljoin(f"https://host.x/{a}{s}", f"{lead}{b}{t}"))
                for a, b, s, lead, t in cases if not (lead + b).startswith("//")]
        got = spark.createDataFrame(rows, "base string, href string, want string").withColumn(
            "got", urls.join("base", "href")).where("got != want").collect()
        assert not got, got
    run()


def test_parts_agree_with_standard_library(spark):
    samples = ["https://User:p@Host.Example:8080/a/b;c?x=1&y=#z", "http://my_host/a b|c[", "//k/z?q", "mailto:x@y",
               "https://h", "HTTPS://H/?#", "/only/path", "not a url", "https://h?x#y#z"]
    rows = [(u,) for u in samples]
    got = spark.createDataFrame(rows, "u string").select(
        "u", urls.scheme("u").alias("s"), urls.host("u").alias("h"), urls.path("u").alias("p"),
        urls.query("u").alias("q"), urls.fragment("u").alias("f")).collect()
    for row in got:
        want = urlsplit(row.u)
        assert (row.s, row.h, row.p, row.q, row.f) == (
            want.scheme, want.hostname, want.path, want.query, want.fragment), row


def test_page_types(check):
    rows = [
        ("https://h", None, True, True), ("https://h/a.pdf", None, False, False),
        ("https://h/a.pdf", "text/html", False, True), ("https://h/a", "application/json", True, False),
        ("https://h/a/", "application/pdf", True, True), ("https://h/a.php", None, True, True),
        ("https://h/a.css", None, False, True), ("https://h/a.css.gz", None, False, True),
        ("https://h/v1.2/page", None, True, True), ("https://h/.pdf", None, True, True),
        ("https://h/a.unknown", "", True, False), ("https://h/a.PDF", None, False, False),
    ]
    check("u string, t string, v1 boolean", [r[:3] for r in rows], urls.is_html_v1("u"))
    check("u string, t string, v2 boolean", [(r[0], r[1], r[3]) for r in rows], urls.is_html_v2("u", "t"))


def test_file_names(check):
    rows = [
        ("https://h/", "index.md", "index.md", "index.md"),
        ("https://h/a/b.html", "a_b.html.md", "a_b.html.md", "a/b.html.md"),
        ("https://h/f%C3%BCr/x?y=1", "f%C3%BCr_x.md", "f_r_x.md", "f_r/x.md"),
        ("https://h/%41%zz/b+c/", "%41%zz_b+c.md", "A_zz_b_c.md", "A_zz/b_c.md"),
        ("https://h//a//b/", "a__b.md", "a_b.md", "a/b.md"),
        ("https://h/" + "x" * 60, "x" * 60 + ".md", "x" * 50 + ".md", "x" * 50 + ".md"),
    ]
    for n, fn in ((1, urls.filename_v1), (2, urls.filename_v2_flat), (3, urls.filename_v2_nested)):
        check("u string, want string", [(r[0], r[n]) for r in rows], fn("u"))


def test_segments_and_hrefs(check):
    check("u string, want array<string>", [
        ("https://h/a//b/", ["a", "", "b"]), ("https://h/", []), ("https://h", [])], urls.segments("u"))
    check("u string, want array<string>", [("https://h/a//b/c", ["a", "b"])],
          urls.prefix_parts("u", 2, keep_inner_blanks=False))
    check("h string, want boolean", [("", True), ("#x", True), ("mailto:x", True), ("/x", False)], urls.skipped_href("h"))


def test_names_of_artifacts(check):
    check("d string, k string, f string, want string", [
        ('attachment; filename="x.md"', "j/y.zip", "zip", "x.md"), ("", "j/y.zip", "zip", "y.zip"),
        (None, "", "single_md", "docs_export_J.md")],
        urls.attachment_name("d", "k", F.lit("J"), "f"))
    check("d string, k string, want string", [("/cdn.x/", "/j/a.md", "https://cdn.x/j/a.md")], urls.public_url("d", "k"))


def test_hrefs_lose_outer_blanks_and_line_ends(check):
    check("b string, h string, want string", [
        ("https://h/p/", " /x", "https://h/x"), ("https://h/p/", "\n/y\n", "https://h/y"), ("https://h/p/", "a\tb ", "https://h/p/ab"),
        ("https://h/p/", "/a b", "https://h/a b")], urls.join("b", "h"))
