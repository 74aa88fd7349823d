"""URL scalars over every captured address."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkweave.catalog.common import NOW, SQL_HOST, SQL_ORIGIN, SQL_PATH, load, now, text_list
from inkweave.functions import fetching, urls


def url_parts(spark, folder):
    return load(spark, folder, "pages").select(
        "page_id", urls.scheme("url").alias("scheme"), urls.host("url").alias("host"), urls.path("url").alias("path"),
        urls.query("url").alias("query"), urls.fragment("url").alias("fragment"))


SQL_PARTS = f"""
SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS scheme, {SQL_HOST} AS host, {SQL_PATH} AS path,
  regexp_extract(url, '[?]([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment
FROM pages"""


def url_resolve(spark, folder):
    href = F.element_at(F.array(*[F.lit(h) for h in (
        "/x/y", "c/d", "../up", "//other.example/z", "?q=2", "#frag", "./s/../t", "https://abs.example/a")]),
        (F.col("page_id") % 8 + 1).cast("int"))
    return load(spark, folder, "pages").select("page_id", href.alias("href"), urls.join("url", href).alias("resolved"))


SQL_RESOLVE = f"""
WITH p AS (SELECT page_id, url, {SQL_ORIGIN} AS origin, {SQL_PATH} AS path FROM pages),
d AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS dir FROM p)
SELECT page_id,
  ['/x/y', 'c/d', '../up', '//other.example/z', '?q=2', '#frag', './s/../t', 'https://abs.example/a'][page_id % 8 + 1] AS href,
  CASE page_id % 8 WHEN 0 THEN origin || '/x/y' WHEN 1 THEN origin || dir || 'c/d'
    WHEN 2 THEN origin || regexp_replace(dir, '[^/]+/$', '') || 'up'
    WHEN 3 THEN regexp_extract(url, '^([a-z]+:)', 1) || '//other.example/z'
    WHEN 4 THEN origin || path || '?q=2' WHEN 5 THEN split_part(url, '#', 1) || '#frag'
    WHEN 6 THEN origin || dir || 't' ELSE 'https://abs.example/a' END AS resolved
FROM d"""


def url_strip_fragment(spark, folder):
    return load(spark, folder, "pages").select("page_id", urls.strip_fragment("url").alias("bare"))


def path_prefix(spark, folder):
    return load(spark, folder, "pages").select(
        "page_id", text_list(urls.prefix_parts("url", 2)).alias("two"), text_list(urls.prefix_parts("url", 1)).alias("one"))


SQL_PREFIX = f"""
WITH p AS (SELECT page_id, string_split(trim({SQL_PATH}, '/'), '/') AS parts FROM pages)
SELECT page_id, array_to_string(parts[1:2], ' ') AS two, array_to_string(parts[1:1], ' ') AS one FROM p"""

_SUFFIXES = ["", ".pdf", ".html", ".css", ".tar.gz", "/", ".unknown", ".JPG"]
_TYPES = ["", "text/html; charset=utf-8", "application/json", "image/png", "application/octet-stream"]


def _typed(spark, folder):
    suffix = F.element_at(F.array(*[F.lit(s) for s in _SUFFIXES]), (F.col("page_id") % len(_SUFFIXES) + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(s) for s in _TYPES]), (F.col("page_id") % len(_TYPES) + 1).cast("int"))
    path = F.regexp_replace(F.regexp_extract("url", "^([^?#]*)", 1), r"(?:/|\.html)$", "")
    return load(spark, folder, "pages").select("page_id", F.concat(path, suffix).alias("url"), kind.alias("content_type"))


SQL_TYPED = f"""typed AS (
  SELECT page_id, regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '(/|\\.html)$', '') || {_SUFFIXES}[page_id % {len(_SUFFIXES)} + 1] AS url,
    {_TYPES}[page_id % {len(_TYPES)} + 1] AS content_type FROM pages)"""


def is_html_url_v1(spark, folder):
    return _typed(spark, folder).select("page_id", "url", urls.is_html_v1("url").alias("is_html"))


# Fixed values, written out again for the check.
SQL_NON_HTML = """'.zip', '.pdf', '.tar', '.bz2', '.gz', '.rar', '.7z', '.png', '.jpg', '.jpeg', '.gif', '.svg', '.webp', '.bmp', '.ico', '.mp3', '.mp4',
  '.avi', '.mov', '.ogg', '.webm', '.exe', '.msi', '.dmg', '.deb', '.rpm', '.whl', '.txt', '.csv', '.json', '.xml', '.yaml', '.yml', '.css', '.js',
  '.doc', '.docx', '.xls', '.xlsx', '.ppt', '.pptx', '.odt'"""
SQL_HTML_V1 = f"""
WITH {SQL_TYPED}
SELECT page_id, url, lower(regexp_extract({SQL_PATH}, '[^/](\\.[^./]*)$', 1)) NOT IN ({SQL_NON_HTML}) AS is_html
FROM typed"""


def is_html_url_v2(spark, folder):
    return _typed(spark, folder).select("page_id", "url", urls.is_html_v2("url", "content_type").alias("is_html"))


SQL_HTML_V2 = f"""
WITH {SQL_TYPED}
SELECT page_id, url, CASE
  WHEN content_type LIKE 'text/html%' THEN true
  WHEN url LIKE '%/' THEN true
  WHEN content_type IN ('application/json', 'image/png') THEN false
  WHEN url LIKE '%.html' OR url LIKE '%.css' THEN true
  ELSE NOT regexp_matches(url, '\\.(pdf|gz|unknown|JPG)$') END AS is_html
FROM typed"""


def _named(spark, folder):
    base = F.regexp_replace(F.regexp_extract("url", "^([^?#]*)", 1), "/$", "")
    tail = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/f%C3%BCr n("), F.col("page_id").cast("string"), F.lit(").x?q=1"))).when(
        F.col("page_id") % 3 == 1, F.concat(F.lit("/"), F.repeat(F.lit("long-part_"), 7), F.lit("/"))).otherwise("")
    return load(spark, folder, "pages").select("page_id", F.concat(base, tail).alias("url"))


SQL_NAMED = f"""named AS (
  SELECT page_id, regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/$', '') || CASE page_id % 3
    WHEN 0 THEN '/f%C3%BCr n(' || page_id || ').x?q=1' WHEN 1 THEN '/' || repeat('long-part_', 7) || '/' ELSE '' END AS url FROM pages),
parts AS (SELECT page_id, url, trim({SQL_PATH}, '/') AS path FROM named),
safe AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''),
  lambda x: left(regexp_replace(url_decode(x), '[^a-zA-Z0-9_.-]', '_', 'g'), 50)) AS segs FROM parts)"""


def filename_v1(spark, folder):
    return _named(spark, folder).select("page_id", urls.filename_v1("url").alias("filename"))


def filename_v2_flat(spark, folder):
    return _named(spark, folder).select("page_id", urls.filename_v2_flat("url").alias("filename"))


def filename_v2_nested(spark, folder):
    return _named(spark, folder).select("page_id", urls.filename_v2_nested("url").alias("filename"))


def object_names(spark, folder):
    """Object keys, public addresses, bundle names and attachment names of one artifact per page."""
    named = load(spark, folder, "pages").select("page_id", urls.host("url").alias("job"), F.when(
        F.col("page_id") % 2 == 0, "all_docs.md").otherwise("pack.zip").alias("artifact"))
    key = urls.object_key("job", "artifact")
    header = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('attachment; filename="dl-'), F.col("artifact"), F.lit('"'))).otherwise("")
    shown_key = F.when(F.col("page_id") % 5 == 1, "").otherwise(key)
    return named.select(
        "page_id", key.alias("object_key"), urls.public_url(F.lit("/cdn.example/"), key).alias("public_url"),
        urls.export_name(now() + F.make_interval(secs=F.col("page_id"))).alias("bundle"),
        urls.attachment_name(header, shown_key, "job", F.lit("zip")).alias("attachment"))


SQL_NAMES = f"""
WITH n AS (SELECT page_id, {SQL_HOST} AS job, CASE WHEN page_id % 2 = 0 THEN 'all_docs.md' ELSE 'pack.zip' END AS artifact FROM pages)
SELECT page_id, job || '/' || artifact AS object_key, 'https://cdn.example/' || job || '/' || artifact AS public_url,
  'docs_export_' || (epoch(TIMESTAMP '{NOW}')::BIGINT + page_id) || '.zip' AS bundle,
  CASE WHEN page_id % 3 = 0 THEN 'dl-' || artifact WHEN page_id % 5 = 1 THEN 'docs_export_' || job || '.zip' ELSE artifact END AS attachment
FROM n"""


def artifact_headers(spark, folder):
    key = F.concat(urls.host("url"), F.lit("/v1.2/"), F.element_at(F.array(
        F.lit("all_docs.md"), F.lit("pack.ZIP"), F.lit("order.txt"), F.lit("noext")), (F.col("page_id") % 4 + 1).cast("int")))
    return load(spark, folder, "pages").select("page_id", key.alias("key")).select(
        "page_id", fetching.artifact_content_type("key").alias("content_type"),
        fetching.artifact_disposition("key").alias("disposition"))


SQL_HEADERS = """
SELECT page_id, ['text/markdown; charset=UTF-8', 'application/zip', 'application/octet-stream', 'application/octet-stream'][page_id % 4 + 1] AS content_type,
  'attachment; filename="' || ['all_docs.md', 'pack.ZIP', 'order.txt', 'noext'][page_id % 4 + 1] || '"' AS disposition
FROM pages"""

ENTRIES = {
    "url_parts": (url_parts, SQL_PARTS),
    "url_resolve": (url_resolve, SQL_RESOLVE),
    "url_strip_fragment": (url_strip_fragment, "SELECT page_id, split_part(url, '#', 1) AS bare FROM pages"),
    "path_prefix": (path_prefix, SQL_PREFIX),
    "is_html_url_v1": (is_html_url_v1, SQL_HTML_V1),
    "is_html_url_v2": (is_html_url_v2, SQL_HTML_V2),
    "filename_v1": (filename_v1, f"WITH {SQL_NAMED} SELECT page_id, replace(path, '/', '_') || '.md' AS filename FROM parts"),
    "filename_v2_flat": (filename_v2_flat, f"WITH {SQL_NAMED} SELECT page_id, left(array_to_string(segs, '_'), 150) || '.md' AS filename FROM safe"),
    "filename_v2_nested": (filename_v2_nested, f"WITH {SQL_NAMED} SELECT page_id, array_to_string(segs, '/') || '.md' AS filename FROM safe"),
    "object_names": (object_names, SQL_NAMES),
    "artifact_headers": (artifact_headers, SQL_HEADERS),
}
