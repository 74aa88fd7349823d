"""Reading captured sites: every reader returns a pruned, typed DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkweave.functions.fetching import fetch_outcome
from inkweave.operators.jobs import REQUEST_SCHEMA, normalise
from inkweave.operators.ordered import last_occurrence

FETCH_LOG_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("ts", T.TimestampType()),
    T.StructField("status", T.IntegerType()), T.StructField("content_type", T.StringType()),
    T.StructField("retry_after", T.StringType()),
])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder. ``spark.inkweave.scanPartitions``, unset by default, deals its rows anew.

    A file of one row group is one task however many cores there are; a user with such files may
    name the number of tasks. Nothing is decided by the size of the input or the cluster.
    """
    rows, dealt = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet"), spark.conf.get("spark.inkweave.scanPartitions", None)
    return rows.repartition(int(dealt)) if dealt else rows


#: Attempts in order. What they gave settles attempts of one time, so that no run depends on the order of the rows.
FETCH_ORDER = ["ts", "status", "content_type", "retry_after"]


def latest_fetch(log: DataFrame, key: str = "url") -> DataFrame:
    """A retry is a later row: the last attempt of a URL counts, or of what else ``key`` names."""
    return last_occurrence(log, [key], FETCH_ORDER)


def captured_pages(pages: DataFrame, fetch_log: DataFrame | None = None, key: str = "url") -> DataFrame:
    """Pages with an ``outcome``. Without a log every page with a body was fetched well.

    ``key`` is the column of both tables that tells whose attempt a row is. An address that was captured
    twice has two pages; only a log that names the page can tell their attempts apart.
    The body is only tested for being there, so a plan that drops ``html`` never reads more.
    """
    body = F.coalesce(F.length("html") > 0, F.lit(False))
    if fetch_log is None:
        return pages.withColumn("outcome", fetch_outcome("url", F.lit(200), F.lit("text/html"), body))
    # tested in the scan, so that a plan without ``html`` does not join it
    joined = pages.withColumn("_body", body).join(
        latest_fetch(fetch_log, key).select(key, "status", "content_type"), key, "left")
    return joined.withColumn("outcome", fetch_outcome(
        "url", F.coalesce("status", F.lit(200)), F.coalesce("content_type", F.lit("text/html")), F.col("_body"))).select(
        *pages.columns, "outcome")


def requests(spark: SparkSession, path: str, source: str = "job") -> DataFrame:
    """JSON request records as normalised jobs."""
    return normalise(spark.read.schema(REQUEST_SCHEMA).json(path), source)


def job_of_path(path: Column) -> Column:
    """Folder of a file; the sinks name it ``job_id=<escaped id>``, and file pages may lie deeper."""
    own, near = F.regexp_extract(path, r"/(job_id=[^/]+)/", 1), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    folder = F.when(own != "", own).otherwise(near)
    stored = F.url_decode(F.url_decode(F.replace(F.regexp_replace(folder, "^job_id=", ""), F.lit("+"), F.lit("%2B"))))
    return F.when(folder.startswith("job_id="), stored).otherwise(folder)


def order_lists(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, pos, url) of ``<job>/order.txt`` files, or of what ``write_order`` wrote: a URL per line, blanks dropped.

    Line numbers come from the text itself, so one file is one row; a list of many files is
    numbered through in the order of their names.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter="{order.txt,part-*}", recursiveFileLookup=True).select(
        job_of_path(F.col("_metadata.file_path")).alias("job_id"), F.col("_metadata.file_name").alias("file"),
        F.split(F.regexp_replace("value", r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n").alias("lines"))
    before = F.sum("n").over(Window.partitionBy("job_id").orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select("job_id", "file", F.size("lines").alias("n")).withColumn("start", F.coalesce(before, F.lit(0))).drop("n")
    lines = files.join(starts, ["job_id", "file"]).select("job_id", "start", F.posexplode("lines").alias("pos", "line"))
    return lines.select("job_id", (F.col("start") + F.col("pos")).cast("int").alias("pos"), F.trim("line").alias("url")).where(F.col("url") != "")


def markdown_folder(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, filename, md) of ``<job>/*.md`` files; a file of a ``job_id=`` folder keeps its folders in its name. Files without a byte give no row."""
    place = F.col("_metadata.file_path")
    name = F.when(place.contains("/job_id="), F.url_decode(F.replace(F.regexp_extract(place, r"/job_id=[^/]+/(.*)$", 1), F.lit("+"), F.lit("%2B")))).otherwise(F.col("_metadata.file_name"))
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).select(
        job_of_path(place).alias("job_id"), name.alias("filename"), F.col("value").alias("md"))


def stored_pages(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, filename, md) of what ``write_pages`` wrote."""
    kinds = "url string, filename string, content string, job_id string"
    return spark.read.schema(kinds).parquet(path).select("job_id", "filename", F.col("content").alias("md"))


def artifact_listing(spark: SparkSession, path: str, expirations: DataFrame | None = None) -> DataFrame:
    """(key, modified, length, expiration); content is never read."""
    base = path.rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.regexp_replace(F.regexp_extract("path", r"^(?:[a-z0-9]+:/*)?(.*)$", 1), rf"^/*{base.lstrip('/')}/", "").alias("key"),
        F.col("modificationTime").alias("modified"), "length")
    if expirations is None:
        return listed.withColumn("expiration", F.lit(None).cast("timestamp"))
    return listed.join(expirations.select("key", "expiration"), "key", "left")
