"""Time the headline queries and print one JSON line. Reads BENCH_SF_DIR and BENCH_CPUS."""

import json
import os
import re
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from inkweave.catalog import entries  # noqa: E402
from inkweave.session import build_session  # noqa: E402

HEADLINE = [
    "scope_report", "extract_links", "nav_links_v2", "job_edges", "in_scope_v2", "filename_v2_nested", "page_title",
    "main_content_v2", "html_to_markdown", "pages_markdown_v2", "markdown_clean_v2", "headings", "toc_v2", "stitched_v2",
    "bundle_manifest", "bfs_crawl", "reachable", "success_streak", "adaptive_delay_v2", "progress_changes", "retention",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scale = re.search(r"sf([\d.]+)", folder)
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.inkweave.scanPartitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="inkweave-warehouse-")})
    spark.sparkContext.setLogLevel("OFF")
    known, times = entries(), {}
    entries()["url_parts"][0](spark, folder).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        start = time.perf_counter()
        known[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(scale.group(1)) if scale else None}))


if __name__ == "__main__":
    main()
