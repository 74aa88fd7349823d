"""File tables, bundle manifests and job summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.functions import markdown as M
from inkweave.functions import urls
from inkweave.functions.fetching import expires_at
from inkweave.operators.jobs import with_status

# Names inside a bundle.
DOCS_FOLDER, ALL_DOCS, ORDER_LIST = "docs", "all_docs.md", "order.txt"


def page_files(pages: DataFrame, generated: Column, profile: str = "v2") -> DataFrame:
    """(job_id, url, pos, filename, flat_name, content); ``generated`` is an ISO time as text."""
    if profile == "v2":
        name, front = urls.filename_v2_nested("url"), M.frontmatter_v2("title", "url", generated)
        flat = urls.filename_v2_flat("url")
    else:
        name, front = urls.filename_v1("url"), M.frontmatter_v1("title", "url", generated)
        flat = name
    return pages.select("job_id", "url", "pos", name.alias("filename"), flat.alias("flat_name"),
                        F.concat(front, F.col("md")).alias("content"))


def filename_collisions(pages: DataFrame) -> DataFrame:
    """File names more than one URL of a job maps to."""
    named = pages.select("job_id", urls.filename_v2_nested("url").alias("filename"), "url")
    return named.groupBy("job_id", "filename").agg(
        F.count("*").alias("n_urls"), F.min("url").alias("first_url")).where("n_urls > 1")


def last_write_wins(files: DataFrame) -> DataFrame:
    """One row per file name: the page written last. The winners are found without the pages' text."""
    last = files.groupBy("job_id", "filename").agg(F.max("pos").alias("pos"))
    return files.join(last, ["job_id", "filename", "pos"], "left_semi").select(*files.columns)


def manifest(files: DataFrame, parts: DataFrame) -> DataFrame:
    """(job_id, arcname, n_bytes, n_parts) of every bundle member.

    ``files`` are page files, ``parts`` the stitched document. Sizes are sums over rows, so the
    order list and the document are never built as one value.
    """
    written = last_write_wins(files.select("job_id", "filename", "pos", F.octet_length("content").cast("long").alias("n_bytes")))
    page = written.select("job_id", F.concat(F.lit(f"{DOCS_FOLDER}/"), F.col("filename")).alias("arcname"),
                          "n_bytes", F.lit(1).cast("long").alias("n_parts"))
    order = files.groupBy("job_id").agg(
        F.sum(F.octet_length("flat_name").cast("long") + 1).alias("n_bytes"), F.count("*").alias("n_parts")).select(
        "job_id", F.lit(f"{DOCS_FOLDER}/{ORDER_LIST}").alias("arcname"), "n_bytes", "n_parts")
    whole = parts.groupBy("job_id").agg(
        F.sum(F.octet_length("text").cast("long")).alias("n_bytes"), F.count("*").alias("n_parts")).select(
        "job_id", F.lit(ALL_DOCS).alias("arcname"), "n_bytes", "n_parts")
    return page.unionByName(order).unionByName(whole)


def crawl_counts(visits: DataFrame) -> DataFrame:
    """Counters per job. Only fetched pages count as fetched; failures never subtract."""
    state = F.col("state")
    return visits.groupBy("job_id").agg(
        F.count("*").alias("n_queued"),
        F.count_if(state == "crawled").alias("n_crawled"),
        F.count_if(state.isin("crawled", "not_html")).alias("n_fetched"),
        F.count_if(state.isin("failed", "empty", "limited")).alias("n_failed"),
        F.count_if(state == "not_html").alias("n_not_html"),
        F.count_if(state == "queued").alias("n_pending"),
    )


def depth_counts(visits: DataFrame) -> DataFrame:
    return visits.groupBy("job_id", "depth").agg(
        F.count("*").alias("n_urls"), F.count_if(F.col("state") == "crawled").alias("n_crawled"))


def summary(jobs: DataFrame, counts: DataFrame, finished: Column) -> DataFrame:
    """One result row per job. ``finished`` is the end time, given so that results repeat.

    A job that was refused, or whose bundle would be empty, is a FAILURE with its reason.
    """
    refused = jobs if "error" in jobs.columns else with_status(jobs)
    n = F.coalesce("n_crawled", F.lit(0))
    fetched = F.coalesce("n_fetched", F.lit(0))
    artifact = F.when(F.col("output_format") == "single_md", F.lit(ALL_DOCS)).otherwise(urls.export_name(finished))
    key = urls.object_key("job_id", artifact)
    empty = F.when(F.col("output_format") == "single_md", "all_docs.md missing for single_md export").otherwise("ZIP creation failed")
    error = F.coalesce(F.col("error"), F.when(n == 0, empty))
    status = F.concat(
        F.lit("Completed. Output: "), F.col("output_format"), F.lit(". Artifact: "), key,
        F.lit(". Pages crawled: "), n.cast("string"), F.lit(". Total fetched: "), fetched.cast("string"), F.lit("."))
    suffix = F.when(F.coalesce("strict_limit", F.lit(False)), F.concat(
        F.lit(" (Strict page limit: "), F.col("max_pages").cast("string"), F.lit(")"))).otherwise("")
    return refused.join(counts, "job_id", "left").select(
        "job_id", F.col("seed_url").alias("site_url"),
        F.when(error.isNull(), "SUCCESS").otherwise("FAILURE").alias("state"),
        F.when(error.isNull(), F.concat(status, suffix)).alias("status"), error.alias("error"),
        n.alias("pages_crawled"), fetched.alias("total_pages_fetched"),
        F.when(error.isNull(), key).alias("object_key"), "output_format",
        F.struct("include_prefixes", "exclude_regexes", "max_pages", "output_format", "strict_limit").alias("params_used"),
        F.when(error.isNull(), expires_at(finished)).alias("expires_at"),
    )
