"""A documentation job from captured pages to corpus, for all jobs at once, in both profiles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.functions import urls
from inkweave.operators import bundle, content, graph, links, toc
from inkweave.operators.jobs import with_scope, with_status
from inkweave.operators.ordered import first_occurrence, last_occurrence
from inkweave.session import stage
from inkweave.sources.readers import captured_pages
from inkweave.sources import sinks


@dataclass
class Corpus:
    """Tables of a finished run. Nothing is computed until one of them is used, but the walk."""

    visits: DataFrame
    pages: DataFrame
    files: DataFrame
    parts: DataFrame
    manifest: DataFrame
    summary: DataFrame

    def write(self, path: str, profile: str = "v2") -> None:
        base = path.rstrip("/")
        order = ["section", "pos"] if profile == "v2" else ["section", "pos", "sub"]
        sinks.write_pages(bundle.last_write_wins(self.files), f"{base}/pages")
        sinks.write_document(self.parts, f"{base}/document", order, profile)
        sinks.write_order(self.pages.select("job_id", "pos", "url"), f"{base}/order")
        sinks.write_manifest(self.manifest, f"{base}/manifest")
        self.summary.write.mode("overwrite").parquet(f"{base}/summary")


def _captured(pages: DataFrame, fetch_log: DataFrame | None) -> DataFrame:
    """One captured page per address (page_id, url, outcome): a good one before others, the latest among equals."""
    known = captured_pages(pages, fetch_log)
    named = known.select("page_id", urls.strip_fragment("url").alias("url"), "outcome", (F.col("outcome") == "ok").alias("good"))
    return last_occurrence(named, ["url"], ["good", "page_id"]).drop("good")


def _of_good(pages: DataFrame, known: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``extract`` takes out of the well captured pages, under the address the walk knows them by.

    Rows are taken out in the scan; only they, not the pages' text, meet the list of good pages.
    """
    taken = extract(pages.withColumn("url", urls.strip_fragment("url")))
    return taken.join(known.where("outcome = 'ok'").select("page_id"), "page_id", "left_semi")


def _converted(pages: DataFrame, wanted: DataFrame, profile: str) -> DataFrame:
    """(page_id, title, md) of the wanted pages, each converted once however many jobs share it."""
    return content.to_markdown(pages.join(wanted.select("page_id").distinct(), "page_id", "left_semi"), profile)


def run_v2(pages: DataFrame, jobs: DataFrame, finished: Column, generated: Column,
           fetch_log: DataFrame | None = None) -> Corpus:
    """Single pass: crawl in order, convert, bundle."""
    checked = with_status(jobs)
    valid = with_scope(checked.where(F.col("error").isNull()).drop("error"))
    known = stage(_captured(pages, fetch_log))
    edges = links.job_edges(_of_good(pages, known, links.extract_links), valid)
    seeds = valid.select("job_id", urls.strip_fragment("seed_url").alias("url"), "max_pages")
    visits = graph.crawl(edges, known, seeds)
    crawled = visits.where("state = 'crawled'").join(known.select("page_id", "url"), "url")
    done = stage(_converted(pages, crawled, "v2").select("page_id", "title", "md"))
    job_pages = crawled.select("job_id", "page_id", "url", F.col("crawl_pos").alias("pos")).join(done, "page_id").select(
        "job_id", "pos", "url", "title", "md")
    files = bundle.page_files(job_pages, generated)
    parts = toc.stitched_v2(job_pages)
    return Corpus(visits, job_pages, files, parts, bundle.manifest(files, parts),
                  bundle.summary(checked, bundle.crawl_counts(visits), finished))


def run_v1(pages: DataFrame, jobs: DataFrame, finished: Column, generated: Column,
           fetch_log: DataFrame | None = None) -> Corpus:
    """Two passes: discover within the limit, then save reachable pages in address order."""
    checked = with_status(jobs)
    valid = with_scope(checked.where(F.col("error").isNull()).drop("error"))
    known = stage(_captured(pages, fetch_log))
    edges = stage(links.job_edges(_of_good(pages, known, links.extract_links), valid, "v1"))
    seeds = valid.select("job_id", urls.strip_fragment("seed_url").alias("url"), "max_pages", "strict_limit")
    visits = graph.crawl(edges, known, seeds.drop("strict_limit"))
    found = visits.where("state = 'crawled'")
    reached = found.select("job_id", "url")
    spent = found.groupBy("job_id").agg(F.count("*").alias("n"))
    strict = seeds.join(spent, "job_id").select(
        "job_id", F.when(F.col("strict_limit"), F.col("n")).otherwise(0).alias("n_discovered"))
    saved = graph.save_order(reached, strict, seeds.select("job_id", "max_pages")).join(known.select("page_id", "url"), "url")
    done = stage(_converted(pages, saved, "v1").select("page_id", "title", "md"))
    job_pages = saved.select("job_id", "page_id", "url", F.col("save_pos").alias("pos")).join(done, "page_id").select(
        "job_id", "pos", "url", "title", "md")
    files = bundle.page_files(job_pages, generated, "v1")
    nav = links.resolve(_of_good(pages, known, lambda p: links.navigation_links(p, "v1")), "v1").select(
        urls.strip_fragment("url").alias("seed"), urls.strip_fragment("dst").alias("url"), "pos")
    own = nav.join(seeds.select("job_id", F.col("url").alias("seed")), "seed").join(
        edges.select("job_id", F.col("src").alias("seed"), F.col("dst").alias("url")), ["job_id", "seed", "url"], "left_semi")
    nav_order = first_occurrence(own.select("job_id", "url", "pos"), ["job_id", "url"], ["pos"]).select(
        "job_id", F.col("pos").cast("long").alias("pos"), "url")
    # Both are read several times below: by the order, by the contents and by the document.
    ordering = stage(graph.navigation_or_discovery(
        nav_order, found.select("job_id", F.col("crawl_pos").alias("pos"), "url")))
    stored = stage(bundle.last_write_wins(files).select("job_id", "filename", F.col("content").alias("md")))
    ordered = stage(toc.document_order(stored, ordering)).join(stored, ["job_id", "filename"])
    parts = toc.stitched_v1(ordered)
    counts = bundle.crawl_counts(visits).drop("n_crawled").join(
        job_pages.groupBy("job_id").agg(F.count("*").alias("n_crawled")), "job_id", "left")
    return Corpus(visits, job_pages, files, parts, bundle.manifest(files, parts), bundle.summary(checked, counts, finished))
