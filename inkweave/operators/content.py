"""Captured pages to titles, images, table cells and Markdown."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.functions import html as H
from inkweave.functions import markdown as M
from inkweave.functions import strip_space


def with_title(pages: DataFrame, profile: str = "v2") -> DataFrame:
    value = H.title_v2("html", "url") if profile == "v2" else H.title_v1("html")
    return pages.withColumn("title", value)


def main_content(pages: DataFrame, profile: str = "v2") -> DataFrame:
    """(page_id, url, selector, content): the element a page's text is taken from."""
    source = H.drop_noise("html") if profile == "v2" else F.col("html")
    chosen = pages.select("page_id", "url", H.main_content(source, profile).alias("chosen"))
    return chosen.select("page_id", "url", "chosen.selector", F.col("chosen.html").alias("content"))


def images(pages: DataFrame) -> DataFrame:
    """Every image with the text that replaces it, when it has no usable source."""
    found = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all(
        H.drop_noise("html"), F.lit(rf"(?is)<img(?![\w\-])({H.ATTRS})>"), 1)).alias("pos", "inside"))
    parsed = found.select("page_id", "url", "pos", H.attribute(F.col("inside"), "src").alias("src"),
                          strip_space(H.attribute(F.col("inside"), "alt")).alias("alt"))
    shown = F.when((F.col("alt") == "") & (F.col("src") != "") & ~F.col("src").startswith("data:image"),
                   "Image").otherwise(F.col("alt"))
    return parsed.select("page_id", "url", "pos", "src", shown.alias("alt"),
                         H.image_placeholder(F.col("src"), F.col("alt")).alias("placeholder"))


def table_cells(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, row_no, col_no, text) of every table."""
    tables = pages.select("page_id", F.posexplode(F.regexp_extract_all(
        H.drop_noise("html"), F.lit(r"(?is)<table(?![\w\-])[^>]*>.*?</table\s*>"), 0)).alias("table_no", "table"))
    rows = tables.select("page_id", "table_no", F.posexplode(H.table_rows(F.col("table"))).alias("row_no", "cells"))
    return rows.select("page_id", "table_no", "row_no", F.posexplode("cells").alias("col_no", "text")).withColumn(
        "text", H.decode_entities("text"))


def failure_text(url: Column) -> Column:
    return F.concat(F.lit("## Conversion Failed for "), url, F.lit("\n\n_Source: "), url, F.lit(
        "_\n\nContent might be malformed or too complex for automated conversion.\n"))


@cache
def _conversion(profile: str) -> tuple[Column, Column, Column]:
    """Markdown of ``html``, clean-up of ``_md`` and plain text of ``html``: long expressions by name, built once."""
    content = H.content_html_v2("html") if profile == "v2" else H.content_html_v1("html")
    clean = M.clean_v2 if profile == "v2" else M.clean_v1
    return H.html_to_md(content, profile), clean("_md"), H.plain_text("html")


def to_markdown(pages: DataFrame, profile: str = "v2") -> DataFrame:
    """(…pages columns but html, title, md, conversion_status).

    Narrow from end to end: one scan, no shuffle. Conversion that leaves nothing falls back to
    the page's plain text, then to a failure notice.
    """
    converted, clean, plain = _conversion(profile)
    titled = with_title(pages, profile)
    rough = titled.withColumn("_md", converted)
    cleaned = rough.withColumn("_md", clean)
    blank = ~F.col("_md").rlike(r"(?U)\S")
    rescued = cleaned.withColumn("_plain", F.when(blank, plain))
    return rescued.select(
        *[c for c in pages.columns if c != "html"], "title",
        F.when(~blank, F.col("_md")).when(F.col("_plain") != "", F.concat("_plain", F.lit("\n"))).otherwise(
            failure_text(F.col("url"))).alias("md"),
        F.when(~blank, "converted").when(F.col("_plain") != "", "plain_text").otherwise("failed").alias(
            "conversion_status"),
    )
