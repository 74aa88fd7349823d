"""Writing results: one folder per job, ordered where order matters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_pages(files: DataFrame, path: str) -> None:
    """Page files as a table partitioned by job; a large job takes many tasks, a task few jobs."""
    ranged = files.repartitionByRange("job_id", "filename")
    ranged.select("job_id", "url", "filename", "content").write.mode("overwrite").partitionBy("job_id").parquet(path)


def write_document(parts: DataFrame, path: str, order: list[str], profile: str = "v2") -> None:
    """The stitched document of each job as ordered text files.

    Range partitioning by (job, order) splits a large job over many tasks; its files in name order
    are the document. The sink ends every row with a line feed, so one is taken off each part.
    """
    text = F.regexp_replace("text", r"\n\z", "")
    if profile == "v1":
        text = F.when((F.col("section") == 3) & (F.col("pos") > 1), F.regexp_replace("text", r"\A\n", "")).otherwise(text)
    ranged = parts.repartitionByRange("job_id", *order).sortWithinPartitions("job_id", *order)
    ranged.select("job_id", text.alias("value")).write.mode("overwrite").partitionBy("job_id").text(path)


def write_order(ordering: DataFrame, path: str, position: str = "pos") -> None:
    """The order list of each job, one URL per line, in position order over its files."""
    ranged = ordering.repartitionByRange("job_id", position).sortWithinPartitions("job_id", position)
    ranged.select("job_id", F.col("url").alias("value")).write.mode("overwrite").partitionBy("job_id").text(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.repartitionByRange("job_id", "arcname").write.mode("overwrite").partitionBy("job_id").parquet(path)
