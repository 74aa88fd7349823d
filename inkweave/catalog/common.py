"""Inputs several queries share, as DataFrames and as the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.functions import urls
from inkweave.operators.jobs import with_scope
from inkweave.session import prepare
from inkweave.sources.readers import table

NOW = "2024-02-01 00:00:00"
NOW_ISO = "2024-02-01T00:00:00"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return table(prepare(spark), folder, name)


def text_list(values: Column) -> Column:
    """Arrays travel as text, so both engines hash the same value."""
    return F.array_join(values, " ")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


SQL_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
SQL_PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
SQL_ORIGIN = "regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)"


def host_jobs(pages: DataFrame) -> DataFrame:
    """One job per host; seed, includes and excludes differ from host to host."""
    k = F.col("k")
    seed_path = F.when(k % 5 == 0, "/").when(k % 5 == 1, "/en").when(k % 5 == 2, "/en/sub/deep").when(
        k % 5 == 3, "/").otherwise("/fr/9")
    jobs = pages.groupBy(urls.host("url").alias("job_id")).agg(F.min("page_id").alias("k")).select(
        "job_id", "k",
        F.concat(F.lit("https://"), F.col("job_id"), seed_path).alias("seed_url"),
        F.when(k % 4 == 1, F.array(F.lit("/en"))).when(k % 4 == 2, F.array(F.lit("/fr/"), F.lit("/de"))).otherwise(
            F.expr("cast(array() as array<string>)")).alias("include_prefixes"),
        F.when(k % 3 == 1, F.array(F.lit("page=2"), F.lit(r"\.html$"))).otherwise(
            F.expr("cast(array() as array<string>)")).alias("exclude_regexes"),
        (F.lit(5) + k % 7).cast("int").alias("max_pages"),
        F.when(k % 6 == 5, "pdf").when(k % 2 == 0, "zip").otherwise("single_md").alias("output_format"),
        (k % 2 == 1).alias("strict_limit"),
    )
    return with_scope(jobs)


SQL_JOBS = f"""jobs AS (
  SELECT host AS job_id, host, k,
    'https://' || host || CASE k % 5 WHEN 0 THEN '/' WHEN 1 THEN '/en' WHEN 2 THEN '/en/sub/deep' WHEN 3 THEN '/' ELSE '/fr/9' END AS seed_url,
    CASE k % 4 WHEN 1 THEN ['/en'] WHEN 2 THEN ['/fr/', '/de'] ELSE []::VARCHAR[] END AS includes,
    CASE WHEN k % 3 = 1 THEN ['page=2', '\\.html$'] ELSE []::VARCHAR[] END AS excludes,
    5 + k % 7 AS max_pages,
    CASE WHEN k % 6 = 5 THEN 'pdf' WHEN k % 2 = 0 THEN 'zip' ELSE 'single_md' END AS output_format,
    k % 2 = 1 AS strict_limit
  FROM (SELECT {SQL_HOST} AS host, min(page_id) AS k FROM pages GROUP BY 1))"""

# First path segment of the seed; empty at the root. Deep seeds widen to their first segment.
SQL_FIRST = "CASE k % 5 WHEN 1 THEN 'en' WHEN 2 THEN 'en' WHEN 4 THEN 'fr' ELSE '' END"
