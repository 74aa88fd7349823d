from pyspark.sql import functions as F

from inkweave.functions import scope
from inkweave.operators import jobs as J


def _jobs(spark):
    rows = [
        ("root", "https://h/", None, None, 1000, "zip"), ("one", "https://h/en", None, None, 1000, "zip"),
        ("deep", "https://h/a/b/c", None, None, 1000, "zip"), ("inc", "https://h/", ["/docs"], None, 1000, "zip"),
        ("incslash", "https://h/", ["/docs/"], None, 1000, "zip"),
        ("exc", "https://h/", None, ["beta", r"\?page="], 1000, "zip"),
        ("both", "https://h/x/y", ["/en"], ["/en/9"], 5, "zip"),
        ("bad", "not a url", None, None, 1000, "zip"), ("fmt", "https://h/", None, None, 1000, "pdf"),
        ("re", "https://h/", None, ["(("], 1000, "zip"),
    ]
    return J.with_scope(spark.createDataFrame(
        [(*r, False) for r in rows], J.JOB_SCHEMA))


def test_scope(spark):
    urls = ["https://h/", "https://h/docs", "https://h/docs/x", "https://h/docsx", "https://h/a/b", "https://h/a/z",
            "https://h/a/b/q", "https://h/en", "https://h/en/9", "https://h/x/y/1", "https://h/b?page=2", "https://k/"]
    pairs = _jobs(spark).where("job_id != 're'").crossJoin(spark.createDataFrame([(u,) for u in urls], "url string"))
    scoped = pairs.select(
        "job_id", "url",
        scope.in_scope_v1("url", "host", "seed_prefix", "include_prefixes", "exclude_regexes").alias("v1"),
        scope.in_scope_v2("url", "host", "seed_prefixes", "include_prefixes", "exclude_regexes").alias("v2"))
    got = {(r.job_id, r.url[9:]): (r.v1, r.v2) for r in scoped.where("url not like 'https://k%'").collect()}
    assert got["root", "/a/z"] == (True, True)
    assert got["one", "/en/9"] == (True, True) and got["one", "/docs"] == (False, False)
    assert got["deep", "/a/b/q"] == (True, True) and got["deep", "/a/z"] == (False, True)
    assert got["inc", "/docs/x"] == (True, True) and got["inc", "/docsx"] == (True, False)
    assert got["inc", "/docs"] == (True, True) and got["incslash", "/docs"] == (False, False)
    assert got["exc", "/b?page=2"] == (False, False) and got["exc", "/en"] == (True, True)
    assert got["both", "/en"] == (False, True) and got["both", "/en/9"] == (False, False)
    assert got["both", "/x/y/1"] == (False, False)
    assert not any(v for r in scoped.where("url like 'https://k%' or job_id = 'bad'").collect() for v in (r.v1, r.v2))


def test_seed_prefixes(spark):
    got = {r.job_id: r.seed_prefixes for r in _jobs(spark).collect()}
    assert got["root"] == [[]] and got["one"] == [["en"]] and got["inc"] == [["docs"]]
    assert got["deep"] == [["a", "b"], ["a"]]


def test_status(spark):
    got = {r.job_id: r.error for r in J.with_status(_jobs(spark)).collect()}
    assert got["bad"] == "Invalid URL" and got["fmt"] == "Invalid output_format"
    assert got["re"] == "Invalid exclude pattern" and got["exc"] is None


def test_normalise_round_trip(spark):
    rows = [("a", "https://h/", None, " /x, y ,,", True, "p1\n\n p2 \r\n", None), ("b", "https://h/", "zip", None, False, "p", 7)]
    jobs = J.normalise(spark.createDataFrame(rows, J.REQUEST_SCHEMA))
    got = {r.job_id: r for r in jobs.collect()}
    assert got["a"].include_prefixes == ["/x", "/y"] and got["a"].exclude_regexes == ["p1", "p2"]
    assert (got["a"].max_pages, got["a"].output_format, got["b"].max_pages) == (1000, "zip", 7)
    assert got["b"].exclude_regexes == []
    back = {r.job_id: r for r in J.as_request(jobs).collect()}
    assert back["a"].path_prefix == "/x,/y" and back["a"].custom_regex == "p1\np2" and back["b"].path_prefix is None


def test_named_groups_are_translated(check):
    check("p string, want string", [(r"(?P<a>x)(?P=a)", r"(?<a>x)\k<a>")], scope.java_pattern(F.col("p")))


def test_patterns_of_either_dialect_fail_their_job_alone(spark):
    from inkweave.functions import scope
    rows = [(1, ["a+", r"\\.html$"], True), (2, ["/{id}/"], False), (3, ["(open"], False), (4, ["(?P<x>a)"], False), (5, None, True), (6, [], True), (7, ["[a&&b]", "a*+"], True)]
    got = spark.createDataFrame(rows, "id int, p array<string>, want boolean").select("id", "want", scope.patterns_compile("p").alias("got")).collect()
    assert all(r.want == r.got for r in got), got
