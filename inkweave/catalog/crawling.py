"""Walks over a site derived from the captured pages.

The captured links never reach another captured page. Here page ``n`` becomes page ``n div 4`` of
site ``n mod 4``; its own text and links stay, and links to pages ``2i+1``, ``2i+2``, ``3i+1`` and
``i div 2`` are written into it. Targets past the end are broken links, the last one makes cycles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from inkweave.catalog.common import NOW, NOW_ISO, load, now
from inkweave.catalog.content import sql_article_md, sql_clean
from inkweave.functions import urls
from inkweave.operators import bundle, graph, links
from inkweave.operators.jobs import with_scope
from inkweave.operators.ordered import first_occurrence
from inkweave.plans import site_job

SITES = 4


def _address(index):
    return F.concat(F.lit("https://site"), F.col("s").cast("string"), F.lit(".test/p/"), index.cast("string"))


def site_pages(spark, folder):
    i = F.col("i")
    hrefs = [i * 2 + 1, i * 2 + 2, i * 3 + 1, F.floor(i / 2)]
    added = F.concat(F.lit("<p>"), *[F.concat(F.lit('<a href="/p/'), h.cast("string"), F.lit('">x</a>')) for h in hrefs],
                     F.lit("</p></article>"))
    return load(spark, folder, "pages").select(
        "page_id", "html", (F.col("page_id") % SITES).alias("s"), F.floor(F.col("page_id") / SITES).alias("i")).select(
        "page_id", _address(i).alias("url"), F.replace(F.col("html"), F.lit("</article>"), added).alias("html"))


def site_jobs(pages):
    """A job per site from its page 0; the page limit differs per site."""
    site = F.regexp_extract("url", r"//site(\d+)", 1).cast("int")
    return with_scope(pages.groupBy(site.alias("s")).agg(F.count("*").alias("n")).select(
        F.concat(F.lit("job"), F.col("s").cast("string")).alias("job_id"),
        F.concat(F.lit("https://site"), F.col("s").cast("string"), F.lit(".test/p/0")).alias("seed_url"),
        F.expr("cast(array() as array<string>)").alias("include_prefixes"),
        F.expr("cast(array() as array<string>)").alias("exclude_regexes"),
        F.when(F.col("s") == 0, F.lit(1000000)).otherwise(F.floor(F.col("n") * F.col("s") / SITES)).cast("int").alias("max_pages"),
        F.when(F.col("s") == 3, "single_md").otherwise("zip").alias("output_format"), F.lit(False).alias("strict_limit")))


def captured(pages):
    """Every seventh page of a site failed to load, every eleventh was no HTML."""
    i = F.regexp_extract("url", r"(\d+)$", 1).try_cast("long")
    return pages.select("url", F.when(i % 7 == 3, "failed").when(i % 11 == 5, "not_html").otherwise("ok").alias("outcome"))


def site_edges(pages, jobs):
    return links.job_edges(links.extract_links(pages), jobs)


def walk(spark, folder):
    pages = site_pages(spark, folder)
    jobs = site_jobs(pages)
    seeds = jobs.select("job_id", F.col("seed_url").alias("url"), "max_pages")
    return graph.crawl(site_edges(pages, jobs), captured(pages), seeds)


SQL_SITE = f"""site AS (SELECT page_id, page_id % {SITES} AS s, page_id // {SITES} AS i, html FROM pages),
jobs AS (SELECT s, 'job' || s AS job_id, CASE WHEN s = 0 THEN 1000000 ELSE count(*) * s // {SITES} END AS max_pages FROM site GROUP BY s),
own AS (SELECT s, i, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM site),
every_link AS (SELECT s, i, unnest(list_concat(hrefs, ['/p/' || (2*i+1), '/p/' || (2*i+2), '/p/' || (3*i+1), '/p/' || (i // 2)])) AS href,
  generate_subscripts(list_concat(hrefs, ['', '', '', '']), 1) - 1 AS pos FROM own),
edges AS (SELECT s, '/p/' || i AS src, href AS dst, min(pos) AS pos FROM every_link
  WHERE regexp_matches(href, '^/p(/|$)') GROUP BY ALL),
got AS (SELECT s, '/p/' || i AS url, CASE WHEN i % 7 = 3 THEN 'failed' WHEN i % 11 = 5 THEN 'not_html' ELSE 'ok' END AS outcome FROM site)"""


#: Every level of the walk until none is left; ``walk`` keeps one row per address, the first.
SQL_WALK = f"""{SQL_SITE},
walk(s, url, depth, queue_pos, crawl_pos, state, gives) USING KEY (s, url) AS (
  SELECT jobs.s, '/p/0', 0, 1, CASE WHEN outcome = 'ok' AND max_pages > 0 THEN 1 END, CASE WHEN max_pages <= 0 THEN 'queued' WHEN outcome = 'ok' THEN 'crawled' ELSE outcome END,
    outcome = 'ok' AND 1 < max_pages
  FROM jobs JOIN (SELECT j.s, coalesce(g.outcome, 'failed') AS outcome FROM jobs j LEFT JOIN got g ON g.s = j.s AND g.url = '/p/0') USING (s)
  UNION
  SELECT n.s, n.url, n.depth, n.queue_pos, CASE WHEN outcome = 'ok' AND hits - 1 < max_pages THEN hits END,
    CASE WHEN hits - (outcome = 'ok')::INT >= max_pages THEN 'queued' WHEN outcome = 'ok' THEN 'crawled' ELSE outcome END, outcome = 'ok' AND hits < max_pages
  FROM (
    SELECT f.s, f.url, f.depth, coalesce(g.outcome, 'failed') AS outcome, b.seen + row_number() OVER (PARTITION BY f.s ORDER BY f.first) AS queue_pos,
      b.done + count(*) FILTER (WHERE g.outcome = 'ok') OVER (PARTITION BY f.s ORDER BY f.first) AS hits
    FROM (SELECT e.s, e.dst AS url, p.depth + 1 AS depth, min((p.queue_pos, e.pos)) AS first FROM walk p JOIN edges e ON e.s = p.s AND e.src = p.url
      LEFT JOIN recurring.walk old ON old.s = e.s AND old.url = e.dst WHERE p.gives AND old.url IS NULL GROUP BY e.s, e.dst, p.depth) f
    JOIN (SELECT s, count(*) AS seen, count(crawl_pos) AS done FROM recurring.walk GROUP BY s) b ON b.s = f.s
    LEFT JOIN got g ON g.s = f.s AND g.url = f.url) n JOIN jobs ON jobs.s = n.s),
visits AS (SELECT * FROM walk)"""


def bfs_crawl(spark, folder):
    return walk(spark, folder).select("job_id", "url", F.col("depth").cast("long").alias("depth"), "queue_pos", "crawl_pos", "state")


SQL_BFS = f"""WITH RECURSIVE {SQL_WALK}
SELECT 'job' || s AS job_id, 'https://site' || s || '.test' || url AS url, depth, queue_pos, crawl_pos, state FROM visits"""


def crawl_order_limited(spark, folder):
    return walk(spark, folder).where("state = 'crawled'").select("job_id", "crawl_pos", "url")


SQL_ORDER = f"""WITH RECURSIVE {SQL_WALK}
SELECT 'job' || s AS job_id, crawl_pos, 'https://site' || s || '.test' || url AS url FROM visits WHERE state = 'crawled'"""


def depth_counts(spark, folder):
    return bundle.depth_counts(walk(spark, folder)).select(
        "job_id", F.col("depth").cast("long").alias("depth"), "n_urls", "n_crawled")


SQL_DEPTHS = f"""WITH RECURSIVE {SQL_WALK}
SELECT 'job' || s AS job_id, depth, count(*) AS n_urls, count(*) FILTER (WHERE state = 'crawled') AS n_crawled FROM visits GROUP BY ALL"""


def crawl_counters(spark, folder):
    return bundle.crawl_counts(walk(spark, folder))


SQL_COUNTERS = f"""WITH RECURSIVE {SQL_WALK}
SELECT 'job' || s AS job_id, count(*) AS n_queued, count(*) FILTER (WHERE state = 'crawled') AS n_crawled,
  count(*) FILTER (WHERE state IN ('crawled', 'not_html')) AS n_fetched, count(*) FILTER (WHERE state = 'failed') AS n_failed,
  count(*) FILTER (WHERE state = 'not_html') AS n_not_html, count(*) FILTER (WHERE state = 'queued') AS n_pending
FROM visits GROUP BY s"""


def _reached(spark, folder):
    pages = site_pages(spark, folder)
    jobs = site_jobs(pages)
    seeds = jobs.select("job_id", F.col("seed_url").alias("url"), "max_pages")
    nodes = captured(pages).where("outcome = 'ok'").select("url")
    return graph.reachable(site_edges(pages, jobs), nodes, seeds), seeds


def reachable(spark, folder):
    reached, _ = _reached(spark, folder)
    return reached.select("job_id", "url", F.col("depth").cast("long").alias("depth"))


SQL_REACH = f"""{SQL_SITE},
good AS (SELECT s, url FROM got WHERE outcome = 'ok'),
walked(s, url, depth) USING KEY (s, url) AS (SELECT jobs.s, '/p/0', 0 FROM jobs JOIN good g ON g.s = jobs.s AND g.url = '/p/0'
  UNION SELECT e.s, e.dst, w.depth + 1 FROM walked w JOIN edges e ON e.s = w.s AND e.src = w.url JOIN good g ON g.s = e.s AND g.url = e.dst
  LEFT JOIN recurring.walked old ON old.s = e.s AND old.url = e.dst WHERE old.url IS NULL),
reached AS (SELECT s, url, min(depth) AS depth FROM walked GROUP BY ALL)"""


def strict_budget(spark, folder):
    """Discovery takes half of the reachable pages off a limit of three quarters."""
    reached, _ = _reached(spark, folder)
    sizes = reached.groupBy("job_id").agg(F.count("*").alias("n"))
    limits = sizes.select("job_id", F.floor(F.col("n") * 3 / 4).cast("int").alias("max_pages"))
    found = sizes.select("job_id", F.floor(F.col("n") / 2).cast("int").alias("n_discovered"))
    return graph.save_order(reached, found, limits)


SQL_BUDGET = f"""WITH RECURSIVE {SQL_REACH},
placed AS (SELECT 'job' || s AS job_id, 'https://site' || s || '.test' || url AS url, count(*) OVER (PARTITION BY s) AS n,
  row_number() OVER (PARTITION BY s ORDER BY url) AS save_pos FROM reached)
SELECT job_id, url, save_pos FROM placed WHERE save_pos <= n * 3 // 4 - n // 2"""


def component_sizes(spark, folder):
    """Captured, reachable and unreachable pages of each job."""
    reached, seeds = _reached(spark, folder)
    pages = site_pages(spark, folder)
    total = captured(pages).groupBy(urls.host("url").alias("host")).agg(F.count("*").alias("n_pages"))
    sized = reached.groupBy("job_id").agg(F.countDistinct("url").alias("n_reached"), F.max("depth").cast("long").alias("depth"))
    return seeds.select("job_id", urls.host("url").alias("host")).join(total, "host").join(sized, "job_id").select(
        "job_id", "n_pages", "n_reached", "depth")


SQL_SIZES = f"""WITH RECURSIVE {SQL_REACH}
SELECT 'job' || s AS job_id, n_pages, count(*) AS n_reached, max(depth) AS depth
FROM reached JOIN (SELECT s, count(*) AS n_pages FROM got GROUP BY s) USING (s) GROUP BY s, n_pages"""


def neighbours_captured(spark, folder):
    """Edges whose target was captured, and how many the job has in all."""
    pages = site_pages(spark, folder)
    edges = site_edges(pages, site_jobs(pages))
    kept = edges.join(pages.select(F.col("url").alias("dst")), "dst", "left_semi")
    return edges.groupBy("job_id").agg(F.count("*").alias("n_edges")).join(
        kept.groupBy("job_id").agg(F.count("*").alias("n_captured")), "job_id")


SQL_NEIGHBOURS = f"""WITH {SQL_SITE}
SELECT 'job' || e.s AS job_id, count(*) AS n_edges, count(g.url) AS n_captured
FROM edges e LEFT JOIN got g ON g.s = e.s AND g.url = e.dst GROUP BY e.s"""


def navigation_or_discovery(spark, folder):
    """Order list per page as its own seed: navigation links for even pages, plain links for the rest."""
    pages = load(spark, folder, "pages")
    job = F.col("page_id").cast("string").alias("job_id")
    nav = links.resolve(links.navigation_links(pages), "v1").where(
        urls.is_html_v1("dst")).select(job, "pos", F.col("dst").alias("url"))
    nav = first_occurrence(nav, ["job_id", "url"], ["pos"]).join(
        pages.where("length(html) % 2 = 0").select(job), "job_id", "left_semi")
    discovery = pages.select(job, F.lit(0).alias("pos"), "url")
    return graph.navigation_or_discovery(nav, discovery).select("job_id", "pos", "url", "source")


SQL_NAVIGATION = r"""
WITH l AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, length(html) AS n,
    unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
    generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS pos FROM pages),
nav AS (SELECT page_id, min(pos) AS pos, origin || href AS url FROM l WHERE n % 2 = 0 GROUP BY page_id, origin || href)
SELECT page_id::VARCHAR AS job_id, pos, url, 'nav' AS source FROM nav
UNION ALL SELECT page_id::VARCHAR, 0, url, 'discovery' FROM pages WHERE page_id NOT IN (SELECT page_id FROM nav)"""


def seed_status(spark, folder):
    """Seeds of twice as many sites as there are; only captured seeds start a walk."""
    pages = site_pages(spark, folder)
    seeds = pages.select("page_id", F.concat(F.lit("https://site"), (F.col("page_id") % (2 * SITES)).cast("string"), F.lit(
        ".test/p/"), F.floor(F.col("page_id") / SITES).cast("string")).alias("url")).select(
        F.col("page_id").cast("string").alias("job_id"), "url")
    return graph.seed_status(seeds, pages.select("url"))


SQL_STATUS = f"""
SELECT page_id::VARCHAR AS job_id, 'https://site' || (page_id % {2 * SITES}) || '.test/p/' || (page_id // {SITES}) AS url,
  page_id % {2 * SITES} < {SITES} AND EXISTS (SELECT 1 FROM pages q WHERE q.page_id = (p.page_id // {SITES}) * {SITES} + p.page_id % {2 * SITES}) AS in_graph
FROM pages p"""

def site_corpus_v2(spark, folder):
    """The whole job: crawl, convert, name and stitch."""
    pages = site_pages(spark, folder)
    log = captured(pages).select("url", F.lit("2024-01-01").cast("timestamp").alias("ts"), F.when(
        F.col("outcome") == "failed", 500).otherwise(200).alias("status"), F.when(
        F.col("outcome") == "not_html", "application/pdf").otherwise("text/html").alias("content_type"), F.lit(None).cast("string").alias("retry_after"))
    jobs = site_jobs(pages).drop("host", "seed_prefix", "seed_prefixes")
    # An address without extension stays HTML whatever it is served as, so those pages fail instead.
    log = log.withColumn("status", F.when(F.col("content_type") == "application/pdf", 404).otherwise(F.col("status")))
    corpus = site_job.run_v2(pages, jobs, now(), F.lit(NOW_ISO), log)
    files = corpus.files.select("job_id", "pos", "url", "filename", F.md5("content").alias("content_md5"))
    return files.join(corpus.summary.select("job_id", "pages_crawled", "object_key"), "job_id")


_CORPUS_WALK = SQL_WALK.replace("WHEN i % 11 = 5 THEN 'not_html'", "WHEN i % 11 = 5 THEN 'failed'")
_SITE_MD = f"""SELECT page_id, {sql_article_md()} || chr(10) || chr(10) || '[x](/p/' || (2 * (page_id // {SITES}) + 1) || ')[x](/p/' || (2 * (page_id // {SITES}) + 2)
  || ')[x](/p/' || (3 * (page_id // {SITES}) + 1) || ')[x](/p/' || (page_id // {SITES} // 2) || ')' || chr(10) AS md FROM pages"""
SQL_CORPUS = f"""WITH RECURSIVE {_CORPUS_WALK},
{sql_clean(_SITE_MD)},
done AS (SELECT v.s, v.url, v.crawl_pos, site.page_id, trim(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)', 1),
  '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&')) AS title FROM visits v JOIN site ON site.s = v.s AND '/p/' || site.i = v.url WHERE state = 'crawled')
SELECT 'job' || s AS job_id, crawl_pos AS pos, 'https://site' || s || '.test' || url AS url, ltrim(url, '/') || '.md' AS filename,
  md5('---' || chr(10) || 'title: "' || replace(title, '"', '\\"') || '"' || chr(10) || 'source_url: https://site' || s || '.test' || url || chr(10)
    || 'date_generated: {NOW_ISO}' || chr(10) || '---' || chr(10) || chr(10) || md) AS content_md5,
  count(*) OVER (PARTITION BY s) AS pages_crawled,
  'job' || s || '/' || CASE WHEN s = 3 THEN 'all_docs.md' ELSE 'docs_export_' || epoch(TIMESTAMP '{NOW}')::BIGINT || '.zip' END AS object_key
FROM done JOIN cleaned USING (page_id)"""


def site_corpus_v1(spark, folder):
    """The two-pass job without a strict limit: what is saved, in address order. Seeds are site roots."""
    pages = site_pages(spark, folder).withColumn("url", F.regexp_replace("url", "/p/0$", "/"))
    jobs = site_jobs(pages).drop("host", "seed_prefix", "seed_prefixes").withColumn("max_pages", F.lit(1000000)).withColumn(
        "seed_url", F.regexp_replace("seed_url", "/p/0$", "/"))
    corpus = site_job.run_v1(pages, jobs, now(), F.lit(NOW_ISO))
    toc_lines = corpus.parts.groupBy("job_id").agg(F.count_if(F.col("section") == 3).alias("n_bodies"))
    return corpus.files.select("job_id", "pos", "url", "filename").join(toc_lines, "job_id")


_ROOTED = SQL_SITE.replace("CASE WHEN i % 7 = 3 THEN 'failed' WHEN i % 11 = 5 THEN 'not_html' ELSE 'ok' END", "'ok'").replace(
    "'/p/' || i AS src", "CASE i WHEN 0 THEN '/' ELSE '/p/' || i END AS src").replace(
    "'/p/' || i AS url", "CASE i WHEN 0 THEN '/' ELSE '/p/' || i END AS url")
SQL_CORPUS_V1 = f"""WITH RECURSIVE {_ROOTED},
walked AS (SELECT DISTINCT s, '/' AS url FROM jobs UNION SELECT w.s, e.dst FROM walked w JOIN edges e ON e.s = w.s AND e.src = w.url
  JOIN got g ON g.s = e.s AND g.url = e.dst)
SELECT 'job' || s AS job_id, row_number() OVER (PARTITION BY s ORDER BY url) AS pos, 'https://site' || s || '.test' || url AS url,
  coalesce(nullif(replace(ltrim(url, '/'), '/', '_'), ''), 'index') || '.md' AS filename, count(*) OVER (PARTITION BY s) AS n_bodies FROM walked"""

ENTRIES = {
    "site_corpus_v2": (site_corpus_v2, SQL_CORPUS),
    "site_corpus_v1": (site_corpus_v1, SQL_CORPUS_V1),
    "bfs_crawl": (bfs_crawl, SQL_BFS),
    "crawl_order_limited": (crawl_order_limited, SQL_ORDER),
    "depth_counts": (depth_counts, SQL_DEPTHS),
    "crawl_counters": (crawl_counters, SQL_COUNTERS),
    "reachable": (reachable, f"WITH RECURSIVE {SQL_REACH} SELECT 'job' || s AS job_id, 'https://site' || s || '.test' || url AS url, depth FROM reached"),
    "strict_budget": (strict_budget, SQL_BUDGET),
    "component_sizes": (component_sizes, SQL_SIZES),
    "neighbours_captured": (neighbours_captured, SQL_NEIGHBOURS),
    "navigation_or_discovery": (navigation_or_discovery, SQL_NAVIGATION),
    "seed_status": (seed_status, SQL_STATUS),
}
