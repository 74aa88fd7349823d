"""Files, bundles, documents and job results over every captured page, a job per host."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from inkweave.catalog.common import NOW, NOW_ISO, SQL_HOST, SQL_JOBS, SQL_ORIGIN, SQL_PATH, host_jobs, load, now
from inkweave.catalog.content import sql_article_md, sql_clean
from inkweave.catalog.documents import SQL_TITLED, titled_pages
from inkweave.functions import urls
from inkweave.operators import bundle, content, toc
from inkweave.session import shared_dir, stage
from inkweave.sources import placed, readers, sinks


def job_pages(spark, folder):
    pages = content.to_markdown(load(spark, folder, "pages"))
    named = titled_pages(spark, folder).select(F.col("pos").alias("page_id"), F.col("title").alias("shown"))
    return pages.join(named, "page_id").select(
        urls.host("url").alias("job_id"), F.col("page_id").alias("pos"), "url", F.col("shown").alias("title"), "md")


SQL_PAGES = f"""{sql_clean(f"SELECT page_id, {sql_article_md()} || chr(10) AS md FROM pages")}, {SQL_TITLED},
job_pages AS (SELECT t.*, md FROM toc t JOIN cleaned c ON c.page_id = t.pos),
files AS (SELECT job_id, url, pos, title, trim({SQL_PATH}, '/') || '.md' AS filename, replace(trim({SQL_PATH}, '/'), '/', '_') || '.md' AS flat_name,
  '---' || chr(10) || 'title: "' || title || '"' || chr(10) || 'source_url: ' || url || chr(10) || 'date_generated: {NOW_ISO}' || chr(10) || '---'
  || chr(10) || chr(10) || md AS content FROM job_pages),
parts AS (SELECT job_id, 1 AS section, pos, '- [' || title || '](#' || anchor || ')' || chr(10) AS text FROM toc
  UNION ALL SELECT DISTINCT job_id, 0, 0, '# Table of Contents' || chr(10) FROM toc
  UNION ALL SELECT DISTINCT job_id, 2, 0, chr(10) || '---' || chr(10) || chr(10) FROM toc
  UNION ALL SELECT job_id, 3, pos, '<a name="' || anchor || '"></a>' || chr(10) || '# ' || title || chr(10) || chr(10) || md || chr(10) || chr(10) || '---' || chr(10) || chr(10) FROM job_pages)"""


def _files(spark, folder):
    return bundle.page_files(job_pages(spark, folder), F.lit(NOW_ISO))


def page_files(spark, folder):
    return _files(spark, folder).select("job_id", "pos", "filename", "flat_name", F.md5("content").alias("content_md5"))


def stitched_v2(spark, folder):
    return toc.stitched_v2(job_pages(spark, folder)).select(
        "job_id", F.col("section").cast("long").alias("section"), "pos", F.md5("text").alias("text_md5"))


def bundle_manifest(spark, folder):
    # Converted once, read by the page files and by the document.
    pages = stage(job_pages(spark, folder))
    return bundle.manifest(bundle.page_files(pages, F.lit(NOW_ISO)), toc.stitched_v2(pages))


SQL_MANIFEST = f"""WITH {SQL_PAGES},
kept AS (SELECT *, row_number() OVER (PARTITION BY job_id, filename ORDER BY pos DESC) AS r FROM files)
SELECT job_id, 'docs/' || filename AS arcname, strlen(content) AS n_bytes, 1 AS n_parts FROM kept WHERE r = 1
UNION ALL SELECT job_id, 'docs/order.txt', sum(strlen(flat_name) + 1)::BIGINT, count(*) FROM files GROUP BY job_id
UNION ALL SELECT job_id, 'all_docs.md', sum(strlen(text))::BIGINT, count(*) FROM parts GROUP BY job_id"""


def _colliding(spark, folder):
    """Addresses that differ only in their query, so that several map to one file."""
    url = F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1), F.lit("/en/"), (F.col("page_id") % 5).cast("string"),
                   F.lit("?q="), F.col("page_id").cast("string"))
    return load(spark, folder, "pages").select(urls.host("url").alias("job_id"), F.col("page_id").alias("pos"), url.alias("url"))


SQL_COLLIDING = f"""colliding AS (SELECT {SQL_HOST} AS job_id, page_id AS pos, {SQL_ORIGIN} || '/en/' || (page_id % 5) || '?q=' || page_id AS url,
  'en/' || (page_id % 5) || '.md' AS filename FROM pages)"""


def filename_collisions(spark, folder):
    return bundle.filename_collisions(_colliding(spark, folder))


def last_write_wins(spark, folder):
    named = _colliding(spark, folder).withColumn("filename", urls.filename_v2_nested("url"))
    return bundle.last_write_wins(named).select("job_id", "filename", "pos", "url")


def job_summary(spark, folder):
    """Every third host has nothing crawled; some jobs are refused for a pattern that does not compile or a seed without host."""
    pages = load(spark, folder, "pages")
    k = F.col("k")
    jobs = host_jobs(pages).withColumn("exclude_regexes", F.when(k % 7 == 1, F.array(F.lit("(unclosed"))).when(k % 7 == 2, F.array(F.lit("/{id}/"))).otherwise(F.col("exclude_regexes"))).withColumn(
        "seed_url", F.when(k % 11 == 3, F.lit("/no/host")).otherwise(F.col("seed_url")))
    counts = pages.groupBy(urls.host("url").alias("job_id")).agg(
        F.when(F.min("page_id") % 3 == 0, 0).otherwise(F.count("*")).alias("n_crawled"), F.count("*").alias("n_fetched"))
    got = bundle.summary(jobs, counts, now())
    return got.select("job_id", "site_url", "state", "status", "error", "pages_crawled", "total_pages_fetched", "object_key",
                      "output_format", F.col("params_used.max_pages").cast("long").alias("max_pages"),
                      F.unix_micros("expires_at").alias("expires_us"))


SQL_SUMMARY = f"""
WITH {SQL_JOBS},
n AS (SELECT {SQL_HOST} AS job_id, CASE WHEN min(page_id) % 3 = 0 THEN 0 ELSE count(*) END AS crawled, count(*) AS fetched FROM pages GROUP BY 1),
s AS (SELECT * REPLACE (CASE WHEN k % 11 = 3 THEN '/no/host' ELSE seed_url END AS seed_url),
  CASE WHEN k % 11 = 3 THEN 'Invalid URL' WHEN k % 7 IN (1, 2) THEN 'Invalid exclude pattern' WHEN output_format = 'pdf' THEN 'Invalid output_format'
    WHEN crawled = 0 AND output_format = 'single_md' THEN 'all_docs.md missing for single_md export' WHEN crawled = 0 THEN 'ZIP creation failed' END AS error,
  job_id || '/' || CASE WHEN output_format = 'single_md' THEN 'all_docs.md' ELSE 'docs_export_' || epoch(TIMESTAMP '{NOW}')::BIGINT || '.zip' END AS key
  FROM jobs JOIN n USING (job_id))
SELECT job_id, seed_url AS site_url, CASE WHEN error IS NULL THEN 'SUCCESS' ELSE 'FAILURE' END AS state,
  CASE WHEN error IS NULL THEN 'Completed. Output: ' || output_format || '. Artifact: ' || key || '. Pages crawled: ' || crawled || '. Total fetched: ' || fetched || '.'
    || CASE WHEN strict_limit THEN ' (Strict page limit: ' || max_pages || ')' ELSE '' END END AS status,
  error, crawled AS pages_crawled, fetched AS total_pages_fetched, CASE WHEN error IS NULL THEN key END AS object_key, output_format, max_pages,
  CASE WHEN error IS NULL THEN epoch_us(TIMESTAMP '{NOW}' + INTERVAL 1 HOUR) END AS expires_us FROM s"""

def _written_order(spark, folder):
    """The order list of every host, written as job folders."""
    path = f"{shared_dir(spark)}/order-{uuid.uuid4().hex}"
    pages = load(spark, folder, "pages")
    sinks.write_order(pages.select(urls.host("url").alias("job_id"), F.col("page_id").alias("pos"), "url"), path)
    return path


def order_list_scan(spark, folder):
    """Order lists written by the sink and read again."""
    return readers.order_lists(spark, _written_order(spark, folder)).select("job_id", F.col("pos").cast("long").alias("pos"), "url")


def artifact_scan(spark, folder):
    """Listing of the order lists' files: bytes of every job."""
    listing = readers.artifact_listing(spark, _written_order(spark, folder)).where("key like '%part-%' and modified is not null")
    return listing.groupBy(F.regexp_extract("key", "job_id=([^/]*)/", 1).alias("job_id")).agg(F.sum("length").alias("n_bytes"))


def markdown_scan(spark, folder):
    """Page files written by the sink and read again."""
    path = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    sinks.write_pages(bundle.last_write_wins(_files(spark, folder)), path)
    return readers.stored_pages(spark, path).select("job_id", "filename", F.md5("md").alias("md_md5"))


def markdown_files(spark, folder):
    """Page files written as ``.md`` files in job folders and read again."""
    path = f"{shared_dir(spark)}/markdown-{uuid.uuid4().hex}"
    placed.write_markdown(bundle.last_write_wins(_files(spark, folder)), path)
    return readers.markdown_folder(spark, path).select("job_id", "filename", F.md5("md").alias("md_md5"))


def single_document(spark, folder):
    """The stitched document of every host written as one file and read again."""
    path = f"{shared_dir(spark)}/document-{uuid.uuid4().hex}"
    placed.write_single(toc.stitched_v2(stage(job_pages(spark, folder))), path, ["section", "pos"])
    return placed.single_documents(spark, path).select("job_id", "n_bytes", F.sha2("content", 256).alias("document_sha256"))


ENTRIES = {
    "markdown_files": (markdown_files, f"""WITH {SQL_PAGES}, kept AS (SELECT *, row_number() OVER (PARTITION BY job_id, filename ORDER BY pos DESC) AS r FROM files)
        SELECT job_id, filename, md5(content) AS md_md5 FROM kept WHERE r = 1"""),
    "single_document": (single_document, f"""WITH {SQL_PAGES} SELECT job_id, sum(strlen(text))::BIGINT AS n_bytes, sha256(string_agg(text, '' ORDER BY section, pos)) AS document_sha256
        FROM parts GROUP BY job_id"""),
    "order_list_scan": (order_list_scan, f"SELECT {SQL_HOST} AS job_id, row_number() OVER (PARTITION BY {SQL_HOST} ORDER BY page_id) - 1 AS pos, url FROM pages"),
    "artifact_scan": (artifact_scan, f"SELECT {SQL_HOST} AS job_id, sum(strlen(url) + 1)::BIGINT AS n_bytes FROM pages GROUP BY 1"),
    "markdown_scan": (markdown_scan, f"""WITH {SQL_PAGES}, kept AS (SELECT *, row_number() OVER (PARTITION BY job_id, filename ORDER BY pos DESC) AS r FROM files)
        SELECT job_id, filename, md5(content) AS md_md5 FROM kept WHERE r = 1"""),
    "page_files": (page_files, f"WITH {SQL_PAGES} SELECT job_id, pos, filename, flat_name, md5(content) AS content_md5 FROM files"),
    "stitched_v2": (stitched_v2, f"WITH {SQL_PAGES} SELECT job_id, section, pos, md5(text) AS text_md5 FROM parts"),
    "bundle_manifest": (bundle_manifest, SQL_MANIFEST),
    "filename_collisions": (filename_collisions, f"""WITH {SQL_COLLIDING} SELECT job_id, filename, count(*) AS n_urls, min(url) AS first_url
        FROM colliding GROUP BY job_id, filename HAVING count(*) > 1"""),
    "last_write_wins": (last_write_wins, f"""WITH {SQL_COLLIDING} SELECT job_id, filename, max(pos) AS pos, arg_max(url, pos) AS url
        FROM colliding GROUP BY job_id, filename"""),
    "job_summary": (job_summary, SQL_SUMMARY),
}
