import random
import re

from pyspark.sql import functions as F

from inkweave.functions import scope, urls
from inkweave.operators import patterns as P

SIGNS = ["docs", "v1", r"\.html$", r"\d+", "(?:old)?", "[a-z]+", "page=", "x?", "ab+", "y{2}", "z{0,3}", r"\/", "^https", "(ref|utm)", ".*", r"\bapi\b", "(a(b)c)", r"\w", "[^/]", r"[\]x]", "-", "%20"]


def test_required_text_is_in_every_match(spark):
    r = random.Random(1)
    made = ["".join(r.choice(SIGNS) for _ in range(r.randint(1, 5))) for _ in range(600)] + ["(?i)Docs", r"\Qa.b\E", r"a\\d", "docs|blog", "", r"a\|bcd", "docs(?!x)", "x{2}abc", "(abc)+def", "a.bcd*"]
    texts = ["".join(r.choice(["docs", "v1", ".html", "12", "old", "abc", "page=", "x", "abb", "yy", "/", "https://", "ref", "utm", "api", "-", "%20", "]", "a|bcd", "def"]) for _ in range(r.randint(1, 8))) for _ in range(400)]
    found = {x.p: x.t for x in spark.createDataFrame([(p,) for p in set(made)], "p string").select("p", P.required_text(F.col("p")).alias("t")).collect()}
    for p, t in found.items():
        if t and "\\Q" not in p:
            assert all(t in s for s in texts if re.search(p, s)), (p, t)
    assert {p: found[p] for p in made[-10:]} == {"(?i)Docs": "", r"\Qa.b\E": "", r"a\\d": "", "docs|blog": "", "": "", r"a\|bcd": "a|bcd", "docs(?!x)": "", "x{2}abc": "abc", "(abc)+def": "def", "a.bcd*": "bc"}


def test_matches_equal_one_by_one_tests(spark):
    r = random.Random(2)
    parts = ["docs", "docsx", "v1", "a.b", "", "page=2", "x.html", "api"]
    addresses = [f"https://{r.choice(['h', 'H', 'g'])}" + r.choice(["", "/" + "/".join(r.choice(parts) for _ in range(r.randint(0, 4))), "?page=2/docs"]) for _ in range(300)]
    includes = ["/", "/docs", "/docs/", "/docs/v1", "", "/docs//", "/a.b/x.html", "docs"] + ["/" + "/".join(r.choice(parts) for _ in range(3)) for _ in range(200)]
    excludes = [r"\.html$", "page=2", "docs|api", "^/docs", r"/v\d/", "x", "/docs/v1", "(?i)DOCS", "a.b", "api$"]
    table = spark.createDataFrame([(u,) for u in set(addresses)], "url string")
    rows = [(f"j{k % 9}", r.choice("hg"), p, q) for k, (p, q) in enumerate(zip(includes, excludes * 30, strict=False))]
    patterns = spark.createDataFrame(rows, "job_id string, host string, prefix string, pattern string")
    both = table.withColumn("host", urls.host("url")).join(patterns, "host")
    want = both.where(scope.include_hit(urls.path("url"), F.array("prefix"))).select("url", "job_id").distinct()
    assert sorted(P.include_matches(table, patterns).collect()) == sorted(want.collect())
    want = both.where(scope.excluded(F.col("url"), urls.path("url"), F.array("pattern"))).select("url", "job_id").distinct()
    assert sorted(P.exclude_matches(table, patterns).collect()) == sorted(want.collect())
    assert P.include_matches(table.limit(0), patterns).count() == P.exclude_matches(table, patterns.limit(0)).count() == 0


def test_only_what_meets_is_tested(spark):
    table = spark.range(2000).select(F.concat(F.lit("https://h/docs/"), F.col("id").cast("string")).alias("url"))
    patterns = spark.range(3000).select(F.lit("j").alias("job_id"), F.lit("h").alias("host"), F.concat(F.lit("/blog/"), F.col("id").cast("string"), F.lit("$")).alias("pattern"))
    plan = P.exclude_matches(table, patterns)
    assert plan.count() == 0
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()


def test_alternatives_in_groups_and_shared_parts_do_not_bring_all_pairs(spark):
    """Expressions of one page each, whose short parts all share: what is tested stays near what matches."""
    ids = spark.range(1000, 3000).select(F.col("id").cast("string").alias("id"))
    table = ids.select(F.concat(F.lit("https://h/en/"), "id").alias("url"))
    pattern = F.when(F.col("id") % 2 == 0, F.concat(F.lit("^https?://[^/]+/en/"), "id", F.lit("/?(utm|$)"))).otherwise(F.concat(F.lit("/en/"), "id", F.lit(r"\b")))
    patterns = ids.select(F.lit("j").alias("job_id"), F.lit("h").alias("host"), pattern.alias("pattern"))
    texts = patterns.select(P.required_text(F.col("pattern")).alias("t")).distinct()
    assert texts.where(F.length("t") >= 8).count() == 2000
    plan = P.exclude_matches(table, patterns)
    assert plan.count() == 2000
    tree = plan._jdf.queryExecution().executedPlan()
    assert max(_join_rows(tree)) < 100_000


def test_alternatives_that_need_nothing(spark):
    want = {r"\d<abc|def>x": "", "abc|def": "", "(abc|defg)hij": "hij", "(?:a|(b|c)d)+/docs/": "/docs/", r"docs\|blog": "docs|blog", "[|]docs": "docs", "(?i:a|b)docs": "", "(a|b)|docs": ""}
    got = spark.createDataFrame([(p,) for p in want], "p string").select("p", P.required_text(F.col("p")).alias("t")).collect()
    assert {r.p: r.t for r in got} == want


def _join_rows(node):
    """Rows that every join of a finished plan gave."""
    name, found = node.nodeName(), []
    if name == "AdaptiveSparkPlan":
        return _join_rows(node.executedPlan())
    if "Join" in name:
        found.append(node.metrics().apply("numOutputRows").value())
    kids = [node.plan()] if "QueryStage" in name else [node.children().apply(i) for i in range(node.children().size())]
    return found + [n for kid in kids for n in _join_rows(kid)]
