"""Links and scope over every captured page."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkweave.operators.joins import salted_join
from inkweave.catalog.common import SQL_FIRST, SQL_HOST, SQL_JOBS, SQL_ORIGIN, SQL_PATH, host_jobs, load, text_list
from inkweave.functions import scope, urls
from inkweave.operators import jobs as J
from inkweave.operators import links as L
from inkweave.operators import patterns as P
from inkweave.operators import tokens as T

# Every page also gets links outside of its navigation and an area marked by class.
_EXTRA = ('<p><a href="/outside?a=1&amp;b=2#x">o</a> <a href="mailto:m@x">m</a> <a name="k">n</a> '
          '<a href="{url}">self</a></p><div class="side toc"><div><a href=\'/in-toc\'>t</a></div></div>'
          '<!-- <a href="/hidden">h</a> --><a href="/after">z</a></article>')


def linked_pages(spark, folder):
    extra = F.replace(F.lit(_EXTRA), F.lit("{url}"), F.col("url"))
    return load(spark, folder, "pages").select(
        "page_id", "url", F.replace(F.col("html"), F.lit("</article>"), extra).alias("html"))


_LIST = """list_concat(regexp_extract_all(html, '<a href="([^"]*)"', 1),
  ['/outside?a=1&b=2#x', 'mailto:m@x', NULL, url, '/in-toc', '/after'])"""
SQL_LINKS = f"""lists AS (SELECT page_id, url, len(regexp_extract_all(html, '<a href="', 0)) AS n_nav, {_LIST} AS hrefs FROM pages),
all_links AS (SELECT page_id, url, n_nav, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS pos FROM lists),
links AS (SELECT * FROM all_links WHERE href IS NOT NULL)"""
SQL_RESOLVED = f"""{SQL_LINKS},
resolved AS (SELECT page_id, url, pos, n_nav, CASE WHEN href LIKE '/%' THEN {SQL_ORIGIN} || split_part(href, '#', 1)
    ELSE split_part(href, '#', 1) END AS dst FROM links WHERE href NOT LIKE 'mailto:%')"""


def extract_links(spark, folder):
    return L.extract_links(linked_pages(spark, folder)).select("page_id", "pos", "href")


def href_filter(spark, folder):
    links = L.resolve(L.extract_links(linked_pages(spark, folder)), "v1")
    return links.select("page_id", "pos", "dst", urls.is_html_v1("dst").alias("is_html"))


SQL_FILTER = f"""
WITH {SQL_LINKS}
SELECT page_id, pos, CASE WHEN href LIKE '/%' THEN {SQL_ORIGIN} || href ELSE href END AS dst, true AS is_html
FROM links WHERE NOT regexp_matches(href, '^(#|mailto:|tel:|javascript:)')"""


def nav_links_v1(spark, folder):
    return L.navigation_links(linked_pages(spark, folder), "v1").select("page_id", "pos", "href")


def nav_links_v2(spark, folder):
    return L.navigation_links(linked_pages(spark, folder), "v2").select("page_id", "pos", "href")


def nav_links_tokens(spark, folder):
    """Navigation links by the interval-coded token table."""
    return T.navigation_links(T.token_table(linked_pages(spark, folder), text=False)).select("page_id", "pos", "href")


SQL_NAV = f"WITH {SQL_LINKS} SELECT page_id, pos, href FROM links WHERE pos < n_nav OR href = '/in-toc'"


def union_links(spark, folder):
    """All links with a mark for navigation; each target once per page."""
    pages = linked_pages(spark, folder)
    marked = L.navigation_links(pages).select("page_id", "pos", F.lit(True).alias("in_nav"))
    links = L.resolve(L.extract_links(pages)).join(marked, ["page_id", "pos"], "left")
    return links.groupBy("page_id", "dst").agg(
        F.min("pos").alias("pos"), F.bool_or(F.coalesce("in_nav", F.lit(False))).alias("in_nav"))


SQL_UNION = f"""
WITH {SQL_RESOLVED}
SELECT page_id, dst, min(pos) AS pos, bool_or(pos < n_nav OR dst LIKE '%/in-toc') AS in_nav FROM resolved GROUP BY page_id, dst"""

SQL_SCOPE_V2 = f"""len(list_filter(excludes, lambda r: regexp_matches(url, r) OR regexp_matches({SQL_PATH}, r))) = 0
  AND CASE WHEN len(includes) > 0 THEN len(list_filter(includes, lambda p: {SQL_PATH} = p OR starts_with({SQL_PATH}, rtrim(p, '/') || '/'))) > 0
    ELSE {SQL_FIRST} = '' OR string_split(trim({SQL_PATH}, '/'), '/')[1] = {SQL_FIRST} END"""
SQL_SCOPE_V1 = f"""len(list_filter(excludes, lambda r: regexp_matches(url, r))) = 0
  AND (len(includes) = 0 OR len(list_filter(includes, lambda p: starts_with({SQL_PATH}, p))) > 0)
  AND CASE k % 5 WHEN 1 THEN string_split(trim({SQL_PATH}, '/'), '/')[1] = 'en'
    WHEN 2 THEN string_split(trim({SQL_PATH}, '/'), '/')[1:2] = ['en', 'sub']
    WHEN 4 THEN string_split(trim({SQL_PATH}, '/'), '/')[1:2] = ['fr', '9'] ELSE true END"""


def _edges(spark, folder, profile):
    pages = linked_pages(spark, folder)
    return L.job_edges(L.extract_links(pages), host_jobs(load(spark, folder, "pages")), profile)


SQL_EDGES = f"""{SQL_RESOLVED}, {SQL_JOBS},
targets AS (SELECT r.url AS src, r.dst AS url, r.pos FROM resolved r),
edges AS (SELECT job_id, src, t.url AS dst, min(pos) AS pos FROM targets t JOIN jobs j ON j.host = {SQL_HOST.replace('url', 't.url')}
  WHERE {SQL_SCOPE_V2.replace('regexp_matches(url', 'regexp_matches(t.url').replace('(url,', '(t.url,')} GROUP BY ALL)"""


def job_edges(spark, folder):
    return _edges(spark, folder, "v2")


def outlink_sets(spark, folder):
    return L.outlink_sets(_edges(spark, folder, "v2")).select(
        "job_id", "src", F.size("targets").cast("long").alias("n_targets"), text_list(F.col("targets")).alias("targets"))


SQL_SETS = f"""
WITH {SQL_EDGES}
SELECT job_id, src, count(DISTINCT dst) AS n_targets, string_agg(DISTINCT dst, ' ' ORDER BY dst) AS targets FROM edges GROUP BY ALL"""


def broken_links(spark, folder):
    broken = L.broken_links(_edges(spark, folder, "v2"), load(spark, folder, "pages"))
    return broken.groupBy("job_id").agg(F.count("*").alias("n_broken"), F.countDistinct("dst").alias("n_targets"))


SQL_BROKEN = f"""
WITH {SQL_EDGES}
SELECT job_id, count(*) AS n_broken, count(DISTINCT dst) AS n_targets FROM edges
WHERE dst NOT IN (SELECT split_part(url, '#', 1) FROM pages) GROUP BY job_id"""


def scope_report(spark, folder):
    """Per host: pages, links, distinct targets and how many links stay in scope."""
    pages = load(spark, folder, "pages")
    links = L.resolve(L.extract_links(pages)).select(urls.host("url").alias("job_id"), "dst")
    jobs = host_jobs(pages).drop("k")
    hit = scope.in_scope_v2("dst", "host", "seed_prefixes", "include_prefixes", "exclude_regexes")
    per_link = salted_join(links, jobs, ["job_id"], F.col("dst")).groupBy("job_id").agg(
        F.count("*").alias("n_links"), F.countDistinct("dst").alias("n_targets"), F.count_if(hit).alias("n_in_scope"))
    return pages.groupBy(urls.host("url").alias("job_id")).agg(F.count("*").alias("n_pages")).join(per_link, "job_id")


SQL_REPORT = f"""
WITH {SQL_JOBS},
plain AS (SELECT {SQL_HOST} AS job_id, {SQL_ORIGIN} || unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS url FROM pages)
SELECT job_id, n_pages, count(*) AS n_links, count(DISTINCT url) AS n_targets, count(*) FILTER (WHERE {SQL_SCOPE_V2}) AS n_in_scope
FROM plain JOIN jobs USING (job_id) JOIN (SELECT {SQL_HOST} AS job_id, count(*) AS n_pages FROM pages GROUP BY 1) USING (job_id)
GROUP BY job_id, n_pages"""


def seed_prefixes(spark, folder):
    jobs = host_jobs(load(spark, folder, "pages"))
    return jobs.select("job_id", F.explode("seed_prefixes").alias("p")).select("job_id", text_list(F.col("p")).alias("prefix"))


SQL_SEEDS = f"""
WITH {SQL_JOBS}
SELECT job_id, unnest(CASE WHEN len(includes) > 0 THEN [trim(includes[1], '/')]
  ELSE CASE k % 5 WHEN 1 THEN ['en'] WHEN 2 THEN ['en sub', 'en'] WHEN 4 THEN ['fr 9', 'fr'] ELSE [''] END END) AS prefix FROM jobs"""


def _scoped(spark, folder, hit):
    pages = load(spark, folder, "pages").select("page_id", "url", urls.host("url").alias("host"))
    jobs = host_jobs(load(spark, folder, "pages"))
    return salted_join(pages, jobs, ["host"], F.col("page_id")).select("job_id", "page_id", hit.alias("in_scope"))


def in_scope_v1(spark, folder):
    return _scoped(spark, folder, scope.in_scope_v1("url", "host", "seed_prefix", "include_prefixes", "exclude_regexes"))


def in_scope_v2(spark, folder):
    return _scoped(spark, folder, scope.in_scope_v2("url", "host", "seed_prefixes", "include_prefixes", "exclude_regexes"))


SQL_PAGES_OF_JOBS = f"{SQL_JOBS}, here AS (SELECT page_id, url, jobs.* FROM pages JOIN jobs ON {SQL_HOST} = jobs.host)"


def include_prefix(spark, folder):
    return _scoped(spark, folder, scope.include_hit(urls.path("url"), "include_prefixes"))


def exclude_regex(spark, folder):
    return _scoped(spark, folder, scope.excluded(F.col("url"), urls.path("url"), "exclude_regexes"))


def _requests(spark, folder):
    page = F.col("page_id")
    return load(spark, folder, "pages").select(
        page.cast("string").alias("job_id"), F.col("url").alias("site_url"), F.lit(None).cast("string").alias("output_format"),
        F.when(page % 3 == 0, F.concat(F.lit(" /en , p"), page.cast("string"), F.lit(",, "))).when(page % 3 == 1, ",").alias("path_prefix"),
        (page % 2 == 0).alias("use_regex"), F.concat(F.lit("  x"), page.cast("string"), F.lit("$ \n\n(?P<n>y)\r\n ")).alias("custom_regex"),
        F.when(page % 4 == 0, page.cast("int")).alias("max_pages"))


def request_normalise(spark, folder):
    return J.normalise(_requests(spark, folder)).select(
        "job_id", text_list(F.col("include_prefixes")).alias("includes"), text_list(F.col("exclude_regexes")).alias("excludes"),
        F.col("max_pages").cast("long").alias("max_pages"), "output_format")


SQL_NORMALISE = """
SELECT page_id::VARCHAR AS job_id, CASE WHEN page_id % 3 = 0 THEN '/en /p' || page_id ELSE '' END AS includes,
  CASE WHEN page_id % 2 = 0 THEN 'x' || page_id || '$ (?<n>y)' ELSE '' END AS excludes,
  CASE WHEN page_id % 4 = 0 THEN page_id ELSE 1000 END AS max_pages, 'zip' AS output_format
FROM pages"""


def request_text_form(spark, folder):
    return J.as_request(J.normalise(_requests(spark, folder), "api")).select(
        "job_id", "path_prefix", "use_regex", "custom_regex", F.col("max_pages").cast("long").alias("max_pages"))


SQL_TEXT_FORM = """
SELECT page_id::VARCHAR AS job_id, CASE WHEN page_id % 3 = 0 THEN '/en,/p' || page_id END AS path_prefix, page_id % 2 = 0 AS use_regex,
  CASE WHEN page_id % 2 = 0 THEN 'x' || page_id || '$' || chr(10) || '(?<n>y)' END AS custom_regex,
  CASE WHEN page_id % 4 = 0 THEN page_id ELSE 50 END AS max_pages
FROM pages"""


def invalid_seeds(spark, folder):
    page = F.col("page_id")
    jobs = load(spark, folder, "pages").select(
        page.cast("string").alias("job_id"),
        F.when(page % 7 == 1, F.concat(F.lit("no host "), page.cast("string"))).otherwise(F.col("url")).alias("seed_url"),
        F.when(page % 5 == 2, F.array(F.lit("(("))).otherwise(F.array(F.lit("ok"))).alias("exclude_regexes"),
        F.when(page % 4 == 3, "pdf").otherwise("zip").alias("output_format"))
    return J.with_status(jobs).select("job_id", "error")


SQL_INVALID = """
SELECT page_id::VARCHAR AS job_id, CASE WHEN page_id % 7 = 1 THEN 'Invalid URL' WHEN page_id % 5 = 2 THEN 'Invalid exclude pattern'
  WHEN page_id % 4 = 3 THEN 'Invalid output_format' END AS error FROM pages"""



def _page_patterns(spark, folder):
    """Two patterns of every page for its host: a path prefix, and an expression with or without a text that must occur."""
    k, path = F.col("page_id"), urls.path("url")
    prefix = F.when(k % 3 == 0, path).when(k % 3 == 1, F.substring_index(path, "/", 2)).otherwise(F.concat(F.substring_index(path, "/", 2), F.lit("/")))
    pattern = F.when(k % 5 == 0, F.lit(r"\.html$")).when(k % 5 == 1, F.concat(path, F.lit(r"\b"))).when(k % 5 == 2, F.lit(r"[?&](?:page|ref)=\w+&")).when(
        k % 5 == 3, F.concat(F.lit("^https?://[^/]+"), path, F.lit("/?(utm|$)"))).otherwise(F.concat(F.expr("substring(url, instr(url, '.'), 9)"), F.lit(".*[0-9]{3}")))
    return load(spark, folder, "pages").select(F.concat(F.lit("job"), (k % 7).cast("string")).alias("job_id"), urls.host("url").alias("host"), prefix.alias("prefix"), pattern.alias("pattern"))


SQL_PATTERNS = f"""patterns AS (SELECT 'job' || page_id % 7 AS job_id, {SQL_HOST} AS host,
  CASE page_id % 3 WHEN 0 THEN {SQL_PATH} WHEN 1 THEN '/' || split_part({SQL_PATH}, '/', 2) ELSE '/' || split_part({SQL_PATH}, '/', 2) || '/' END AS prefix,
  CASE page_id % 5 WHEN 0 THEN '\\.html$' WHEN 1 THEN {SQL_PATH} || '\\b' WHEN 2 THEN '[?&](?:page|ref)=\\w+&' WHEN 3 THEN '^https?://[^/]+' || {SQL_PATH} || '/?(utm|$)'
    ELSE substring(url, instr(url, '.'), 9) || '.*[0-9]{{3}}' END AS pattern FROM pages)"""


def include_prefix_index(spark, folder):
    """Addresses that the include prefixes of each job take, all patterns of a host at once."""
    return P.include_matches(load(spark, folder, "pages").select("url").distinct(), _page_patterns(spark, folder))


SQL_INCLUDE_INDEX = f"""
WITH {SQL_PATTERNS}
SELECT DISTINCT url, job_id FROM pages JOIN patterns ON {SQL_HOST} = host
AND CASE WHEN ends_with(prefix, '/') THEN starts_with({SQL_PATH}, prefix) ELSE {SQL_PATH} = prefix OR starts_with({SQL_PATH}, prefix || '/') END"""


def exclude_regex_index(spark, folder):
    """Addresses that the expressions of each job exclude, all patterns of a host at once."""
    return P.exclude_matches(load(spark, folder, "pages").select("url").distinct(), _page_patterns(spark, folder))


SQL_EXCLUDE_INDEX = f"""
WITH {SQL_PATTERNS}
SELECT DISTINCT url, job_id FROM pages JOIN patterns ON {SQL_HOST} = host AND (regexp_matches(url, pattern) OR regexp_matches({SQL_PATH}, pattern))"""

ENTRIES = {
    "include_prefix_index": (include_prefix_index, SQL_INCLUDE_INDEX),
    "exclude_regex_index": (exclude_regex_index, SQL_EXCLUDE_INDEX),
    "extract_links": (extract_links, f"WITH {SQL_LINKS} SELECT page_id, pos, href FROM links"),
    "href_filter": (href_filter, SQL_FILTER),
    "nav_links_tokens": (nav_links_tokens, SQL_NAV),
    "nav_links_v1": (nav_links_v1, SQL_NAV),
    "nav_links_v2": (nav_links_v2, SQL_NAV),
    "union_links": (union_links, SQL_UNION),
    "job_edges": (job_edges, f"WITH {SQL_EDGES} SELECT job_id, src, dst, pos FROM edges"),
    "outlink_sets": (outlink_sets, SQL_SETS),
    "broken_links": (broken_links, SQL_BROKEN),
    "scope_report": (scope_report, SQL_REPORT),
    "seed_prefixes": (seed_prefixes, SQL_SEEDS),
    "in_scope_v1": (in_scope_v1, f"WITH {SQL_PAGES_OF_JOBS} SELECT job_id, page_id, {SQL_SCOPE_V1} AS in_scope FROM here"),
    "in_scope_v2": (in_scope_v2, f"WITH {SQL_PAGES_OF_JOBS} SELECT job_id, page_id, {SQL_SCOPE_V2} AS in_scope FROM here"),
    "include_prefix": (include_prefix, f"""WITH {SQL_PAGES_OF_JOBS} SELECT job_id, page_id,
        len(list_filter(includes, lambda p: {SQL_PATH} = p OR starts_with({SQL_PATH}, rtrim(p, '/') || '/'))) > 0 AS in_scope FROM here"""),
    "exclude_regex": (exclude_regex, f"""WITH {SQL_PAGES_OF_JOBS} SELECT job_id, page_id,
        len(list_filter(excludes, lambda r: regexp_matches(url, r) OR regexp_matches({SQL_PATH}, r))) > 0 AS in_scope FROM here"""),
    "request_normalise": (request_normalise, SQL_NORMALISE),
    "request_text_form": (request_text_form, SQL_TEXT_FORM),
    "invalid_seeds": (invalid_seeds, SQL_INVALID),
}
