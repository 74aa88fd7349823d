"""Requests to job rows: defaults, scope columns, validity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkweave.functions import scope, urls

REQUEST_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("site_url", T.StringType()),
    T.StructField("output_format", T.StringType()),
    T.StructField("path_prefix", T.StringType()),
    T.StructField("use_regex", T.BooleanType()),
    T.StructField("custom_regex", T.StringType()),
    T.StructField("max_pages", T.IntegerType()),
])
JOB_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("seed_url", T.StringType()),
    T.StructField("include_prefixes", T.ArrayType(T.StringType())),
    T.StructField("exclude_regexes", T.ArrayType(T.StringType())),
    T.StructField("max_pages", T.IntegerType()),
    T.StructField("output_format", T.StringType()),
    T.StructField("strict_limit", T.BooleanType()),
])
# Page limits by way of submission.
DEFAULT_MAX_PAGES = {"job": 1000, "api": 50, "command_line": 10}
OUTPUT_FORMATS = ["zip", "single_md"]


def normalise(requests: DataFrame, source: str = "job") -> DataFrame:
    """Text fields of a request to typed job columns, with the defaults of its source."""
    return requests.select(
        "job_id",
        F.col("site_url").alias("seed_url"),
        scope.split_prefixes("path_prefix").alias("include_prefixes"),
        scope.split_regexes("custom_regex", "use_regex").alias("exclude_regexes"),
        F.coalesce("max_pages", F.lit(DEFAULT_MAX_PAGES[source])).alias("max_pages"),
        F.coalesce("output_format", F.lit("zip")).alias("output_format"),
        F.lit(source == "command_line").alias("strict_limit"),
    )


def as_request(jobs: DataFrame) -> DataFrame:
    """List fields back to the text form a job submission takes."""
    return jobs.select(
        "job_id", F.col("seed_url").alias("site_url"), "output_format",
        scope.joined_prefixes("include_prefixes").alias("path_prefix"),
        scope.given("exclude_regexes").alias("use_regex"),
        scope.joined_regexes("exclude_regexes").alias("custom_regex"),
        "max_pages",
    )


def with_scope(jobs: DataFrame) -> DataFrame:
    """Add host and both kinds of seed prefix."""
    return jobs.select(
        "*",
        urls.host("seed_url").alias("host"),
        urls.prefix_parts("seed_url", scope.SCOPE_DEPTH, keep_inner_blanks=False).alias("seed_prefix"),
        scope.seed_prefixes_v2("seed_url", "include_prefixes").alias("seed_prefixes"),
    )


def with_status(jobs: DataFrame) -> DataFrame:
    """Why a job cannot start; NULL for one that can."""
    return jobs.withColumn(
        "error",
        F.when(urls.host("seed_url").isNull(), "Invalid URL")
        .when(~scope.patterns_compile("exclude_regexes"), "Invalid exclude pattern")
        .when(~F.col("output_format").isin(OUTPUT_FORMATS), "Invalid output_format"),
    )
