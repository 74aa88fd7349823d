import re
import time

import random

from pyspark.sql import functions as F

from inkweave.functions import slugs
from inkweave.operators import bundle, toc
from inkweave.plans import site_job
from inkweave.operators.jobs import JOB_SCHEMA
from inkweave.sources import readers, sinks


def sequential(bases):
    taken, out = set(), []
    for base in bases:
        name, n = base, 1
        while name in taken:
            name, n = f"{base}-{n}", n + 1
        taken.add(name)
        out.append(name)
    return out


def test_headings(spark):
    md = "# A\n## A\n### no\n#none\n#   \n# Élan & Co\n## ​\n"
    got = toc.headings(spark.createDataFrame([(1, md)], "id long, md string"), ["id"]).orderBy("pos").collect()
    assert [(r.level, r.text, r.slug) for r in got] == [
        (1, "A", "a"), (2, "A", "a-1"), (1, "Élan & Co", "elan-co"), (2, "Untitled Section", "section")]


def test_slug_uniqueness_is_sequential(spark):
    rng = random.Random(7)
    cases = [["a", "a", "a-1"], ["a-1", "a", "a"], ["a", "a-1", "a", "a-1", "a"]] + [
        [rng.choice(["a", "a-1", "a-2", "a-1-1", "b"]) for _ in range(rng.randrange(1, 14))] for _ in range(60)]
    rows = [(i, "\n".join(f"# {b}" for b in bases)) for i, bases in enumerate(cases)]
    got = toc.headings(spark.createDataFrame(rows, "id long, md string"), ["id"]).orderBy("id", "pos").collect()
    for i, bases in enumerate(cases):
        assert [r.slug for r in got if r.id == i] == sequential(bases), bases


def test_slugs_and_anchors(check):
    check("t string, want string", [("Intro", "intro"), ("A B", "a-b"), ("A-B", "a-b"), ("日本", "page"), ("_x_ ", "_x_")],
          slugs.title_anchor("t"))
    check("t string, want string", [("  Ünï -- codé! ", "uni-code"), ("!!!", "section"), ("日 本", "日-本")], slugs.slug("t"))
    check("t string, want string", [("A_b c.MD", "a_b-c"), ("???.md", "file-4")], slugs.file_anchor("t", F.lit(4)))


def test_order_with_orphans(spark):
    files = spark.createDataFrame([("j", f"{n}.md") for n in ("a", "b", "c", "z")] + [("k", "q.md"), ("k", "p.md")],
                                  "job_id string, filename string")
    listed = spark.createDataFrame([("j", 0, "https://h/b"), ("j", 1, "https://h/none"), ("j", 2, "https://h/a"), ("j", 3, "https://h/b")],
                                   "job_id string, pos long, url string")
    got = toc.document_order(files, listed).orderBy("job_id", "position").collect()
    assert [(r.job_id, r.position, r.filename) for r in got] == [
        ("j", 1, "b.md"), ("j", 2, "a.md"), ("j", 3, "b.md"), ("j", 4, "c.md"), ("j", 5, "z.md"),
        ("k", 1, "p.md"), ("k", 2, "q.md")]


def test_stitched_documents(spark, tmp_path):
    pages = spark.createDataFrame([("j", n, t, f"body {n}\n") for n, t in enumerate(["Intro", "Intro", "A B"], 1)],
                                  "job_id string, pos long, title string, md string")
    parts = toc.stitched_v2(pages)
    want = ("# Table of Contents\n- [Intro](#intro)\n- [Intro](#intro-1)\n- [A B](#a-b)\n\n---\n\n"
            '<a name="intro"></a>\n# Intro\n\nbody 1\n\n\n---\n\n<a name="intro-1"></a>\n# Intro\n\nbody 2\n\n\n---\n\n'
            '<a name="a-b"></a>\n# A B\n\nbody 3\n\n\n---\n\n')
    assert "".join(r.text for r in parts.orderBy("section", "pos").collect()) == want
    sinks.write_document(parts, str(tmp_path / "doc"), ["section", "pos"])
    written = "".join(p.read_text() for p in sorted((tmp_path / "doc" / "job_id=j").glob("part-*")))
    assert written == want
    files = spark.createDataFrame([("j", 1, "a.md", "---\nt: x\n---\n\n# One\n\ntext\n"), ("j", 2, "b.md", "## Two")],
                                  "job_id string, position long, filename string, md string")
    parts = toc.stitched_v1(files)
    want = ("# Table of Contents\n\n- [One](#a-one)\n  - [Two](#b-two)\n\n\n\n<!-- Source File: a.md -->\n\n\n\n# One\n\ntext\n\n"
            "\n\n<!-- Source File: b.md -->\n\n\n\n## Two")
    assert "".join(r.text for r in parts.orderBy("section", "pos", "sub").collect()) == want
    sinks.write_document(parts, str(tmp_path / "one"), ["section", "pos", "sub"], "v1")
    written = "".join(p.read_text() for p in sorted((tmp_path / "one" / "job_id=j").glob("part-*")))
    assert written == want + "\n"


def test_readers(spark, tmp_path):
    folder = tmp_path / "in" / "job7"
    folder.mkdir(parents=True)
    (folder / "order.txt").write_text("https://h/b\n\n  https://h/a \n")
    (folder / "a.md").write_text("# A\n")
    orders = readers.order_lists(spark, str(tmp_path / "in")).collect()
    assert [(r.job_id, r.pos, r.url) for r in orders] == [("job7", 0, "https://h/b"), ("job7", 2, "https://h/a")]
    assert [tuple(r) for r in readers.markdown_folder(spark, str(tmp_path / "in")).collect()] == [("job7", "a.md", "# A\n")]
    listing = readers.artifact_listing(spark, str(tmp_path / "in"))
    assert {(r.key, r.length) for r in listing.collect()} == {("job7/order.txt", 28), ("job7/a.md", 4)}
    assert "content" not in listing.columns
    (tmp_path / "req.json").write_text('{"job_id": "x", "site_url": "https://h/", "path_prefix": "docs"}\n')
    assert readers.requests(spark, str(tmp_path / "req.json")).first().include_prefixes == ["/docs"]


SITE = [
    ("https://h/", '<title>Home</title><nav><a href="/b">b</a><a href="/a#x">a</a></nav><main><h1>Home</h1><p>hi <b>you</b></p></main>'),
    ("https://h/a", '<title>A</title><main><p>aa</p><a href="/c">c</a> <a href="/gone">g</a></main>'),
    ("https://h/b", '<title>A</title><main><p>bb</p><a href="/">home</a></main>'),
    ("https://h/c", "<main><p>cc</p></main>"),
    ("https://h/lost", "<main>never linked</main>"),
]


def test_whole_jobs(spark, tmp_path):
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(SITE)], "page_id long, url string, html string")
    jobs = spark.createDataFrame([("all", "https://h/", None, None, 100, "zip", False), ("two", "https://h/", None, None, 2, "single_md", False),
                                  ("bad", "nowhere", None, None, 9, "zip", False), ("strict", "https://h/", None, None, 6, "zip", True)], JOB_SCHEMA)
    corpus = site_job.run_v2(pages, jobs, F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-01T00:00:00"))
    got = {(r.job_id, r.pos): (r.url, r.title) for r in corpus.pages.collect()}
    assert [got["all", n] for n in range(1, 5)] == [
        ("https://h/", "Home"), ("https://h/b", "A"), ("https://h/a", "A"), ("https://h/c", "c")]
    assert ("two", 3) not in got and ("bad", 1) not in got
    summary = {r.job_id: r for r in corpus.summary.collect()}
    assert summary["all"].pages_crawled == 4 and summary["bad"].error == "Invalid URL"
    assert summary["two"].object_key == "two/all_docs.md"
    names = {r.arcname for r in corpus.manifest.where("job_id = 'all'").collect()}
    assert names == {"docs/index.md", "docs/a.md", "docs/b.md", "docs/c.md", "docs/order.txt", "all_docs.md"}
    corpus.write(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "pages")).where("job_id = 'all'").count() == 4
    first = site_job.run_v1(pages, jobs.where("job_id != 'bad'"), F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-01T00:00:00"))
    saved = {(r.job_id, r.pos): r.url for r in first.pages.collect()}
    assert [saved["all", n] for n in range(1, 5)] == ["https://h/", "https://h/a", "https://h/b", "https://h/c"]
    assert {k for k in saved if k[0] == "strict"} == {("strict", 1), ("strict", 2)}
    document = [r.text for r in first.parts.where("job_id = 'all'").orderBy("section", "pos", "sub").collect()]
    assert document[0] == "# Table of Contents\n\n" and "Source File: index.md" in document[-1]
    assert "Source File: b.md" in document[-4]


def test_collisions(spark):
    pages = spark.createDataFrame([("j", 1, "https://h/a?x=1"), ("j", 2, "https://h/a?x=2"), ("j", 3, "https://h/b")],
                                  "job_id string, pos long, url string")
    assert [(r.filename, r.n_urls) for r in bundle.filename_collisions(pages).collect()] == [("a.md", 2)]


def test_best_capture_of_an_address_wins(spark):
    pages = spark.createDataFrame([(1, "https://h/a#x", ""), (2, "https://h/a", "<p>good</p>"), (3, "https://h/a#y", None), (4, "https://h/b", "<p>1</p>"), (5, "https://h/b#z", "<p>2</p>")], "page_id long, url string, html string")
    got = {r.url: (r.page_id, r.outcome) for r in site_job._captured(pages, None).collect()}
    assert got == {"https://h/a": (2, "ok"), "https://h/b": (5, "ok")}


def test_refused_and_empty_jobs_fail(spark):
    from inkweave.operators import bundle
    rows = [("a", "https://h/", ["("], "zip"), ("b", "https://h/", [], "zip"), ("c", "https://h/", [], "single_md"), ("d", "/x", [], "zip"), ("e", "https://h/", [], "pdf"), ("f", "https://h/", [], "zip")]
    jobs = spark.createDataFrame(rows, "job_id string, seed_url string, exclude_regexes array<string>, output_format string").withColumns(
        {"include_prefixes": F.array().cast("array<string>"), "max_pages": F.lit(5), "strict_limit": F.lit(False)})
    counts = spark.createDataFrame([("f", 2, 3), ("a", 0, 0)], "job_id string, n_crawled long, n_fetched long")
    got = {r.job_id: (r.state, r.error, r.object_key is None) for r in bundle.summary(jobs, counts, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got == {"a": ("FAILURE", "Invalid exclude pattern", True), "b": ("FAILURE", "ZIP creation failed", True), "c": ("FAILURE", "all_docs.md missing for single_md export", True),
                   "d": ("FAILURE", "Invalid URL", True), "e": ("FAILURE", "Invalid output_format", True), "f": ("SUCCESS", None, False)}


def test_a_page_of_equal_headings_that_clash_is_linear(spark):
    rows = [("x\n\n# a-1\n" + "# a\n" * 20_000,)]
    files = spark.createDataFrame(rows, "md string").withColumn("id", F.lit(1))
    start = time.time()
    got = [r.slug for r in toc.headings(files, ["id"]).orderBy("pos").collect()]
    assert got[:4] == ["a-1", "a", "a-2", "a-3"] and len(set(got)) == 20_001 and time.time() - start < 30


def test_heading_text_is_worked_out_once(spark):
    """One extraction a line in each of the two branches (plain files, files whose slugs clash)."""
    files = spark.createDataFrame([(1, "# A\n#no\n## B -- c!\n# ​\n# -É-\n")], "id long, md string")
    found = toc.headings(files, ["id"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?U)^#{1,2}\s+(.+)$") <= 2
    assert [(r.pos, r.level, r.text, r.slug) for r in found.orderBy("pos").collect()] == [
        (0, 1, "A", "a"), (2, 2, "B -- c!", "b-c"), (3, 1, "Untitled Section", "section"), (4, 1, "-É-", "e")]


def test_a_file_is_read_and_moved_once(spark):
    """Entries and body come out of one row: no windows, no shuffle but that of the job ids."""
    files = spark.createDataFrame([("j", 1, "a.md", "# A\n# A\n# A-1\n"), ("j", 2, "b.md", None)],
                                  "job_id string, position long, filename string, md string")
    parts = toc.stitched_v1(files)
    optimized, physical = (str(getattr(parts._jdf.queryExecution(), n)()) for n in ("optimizedPlan", "sparkPlan"))
    assert optimized.count(r"(?U)^#{1,2}\s+(.+)$") == 1 and "Window" not in physical and "Sort" not in physical
    got = [(r.section, r.pos, r.sub, r.text) for r in parts.orderBy("section", "pos", "sub").collect()]
    assert got == [(0, 0, 0, "# Table of Contents\n\n"), (1, 1, 0, "- [A](#a-a)\n"), (1, 1, 1, "- [A](#a-a-1)\n"),
                   (1, 1, 2, "- [A-1](#a-a-1-1)\n"), (2, 0, 0, "\n"),
                   (3, 1, 0, "\n\n<!-- Source File: a.md -->\n\n\n\n# A\n# A\n# A-1"), (3, 2, 0, None)]
    assert [r.slug for r in toc.headings(files, ["job_id", "position"], full_unicode=True).orderBy("pos").collect()] == ["a", "a-1", "a-1-1"]


def test_slugs_of_odd_texts(check):
    odd = ["a\tb \x0b c", "--a - b--", "!a?b!", "\x00\x1fa\x7f", "a_b", "É\u2003ß—x", "ÀÉ\u0301 \u00a0-Z", "K \u212a", "", "- -", "日\x1c本 *", "İ I"]

    def plain(text):
        text = "".join(slugs.LATIN_TO[slugs.LATIN_FROM.index(c)] if c in slugs.LATIN_FROM else c for c in text).replace("\u0301", "").lower()
        kept = re.sub(r"[\s\-]+", "-", re.sub(r"[^\w\s\-]|[\x1c-\x1f]", "", text))
        return kept.strip("-") or "section"

    check("t string, want string", [(t, plain(t)) for t in odd], slugs.slug("t"))


def test_lines_end_as_the_request_parser_counts(check):
    texts = ["", "a", "a\nb\n", "a\r\nb\rc", "\x0ba\x0cb", "a\x1cb\x1dc\x1ed", "a\x85b", "a\u2028b\u2029c", "a\u00a0b\u2003 \n"]
    check("t string, want array<string>", [(t, re.split("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", t)) for t in texts], slugs.lines("t"))
