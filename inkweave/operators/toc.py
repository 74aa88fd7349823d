"""Headings, tables of contents, document order and stitched parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.functions import markdown as M
from inkweave.functions import let, slugs, strip_space
from inkweave.functions import urls
from inkweave.operators.ordered import numbered, numbered_by_range, position_slot


def heading_lists(files: DataFrame, full_unicode: bool = False) -> DataFrame:
    """``files(…, md)`` with ``headings``, an array of (pos, level, text, slug); slugs unique per file.

    A file's headings stay in its row, so nothing is shuffled and text is not sorted. Counting equal
    slugs is right unless a counted name meets another heading's own name. Files where that happens
    are renumbered one heading after the other.
    """
    # most lines stop at their first character
    leveled = F.transform(slugs.lines("md"), lambda line, n: F.struct(
        n.alias("pos"), F.when(line.startswith("#"), slugs.heading_level(line)).otherwise(0).alias("level"), line.alias("line")))
    texts = F.transform(F.filter(leveled, lambda h: h["level"] > 0), lambda h: F.struct(
        h["pos"].alias("pos"), h["level"].alias("level"), slugs.heading_text(h["line"]).alias("raw")))
    # every column of a step is used more than once above it, which keeps Spark from working it out again there
    found = files.select(*files.columns, F.filter(texts, lambda h: h["raw"] != "").alias("_found"))
    based = found.withColumn("_base", slugs.slug_each(F.transform("_found", lambda h: h["raw"]), full_unicode))
    counted = based.withColumn("_slug", F.when(slugs.repeated("_base"), slugs.counted("_base")).otherwise(F.col("_base")))
    named = counted.withColumn("_again", slugs.unique_slugs(F.when(slugs.repeated("_slug"), F.col("_base"))))
    return named.select(*files.columns, F.zip_with("_found", F.coalesce("_again", "_slug"), lambda h, slug: F.struct(
        h["pos"].alias("pos"), h["level"].alias("level"), slugs.display_text(h["raw"]).alias("text"), slug.alias("slug"))).alias("headings"))


def _inlined(lists: Column | str, *names: str) -> Column:
    """Rows of an array of structs. Of a plain column Spark would first test the size, below the step that makes it, and so make it twice."""
    return F.inline(F.transform(lists, lambda item: F.struct(*[item[n].alias(n) for n in names])))


def headings(files: DataFrame, key: list[str], full_unicode: bool = False) -> DataFrame:
    """Level 1 and 2 headings of ``md``: key + (pos, level, text, slug), slugs unique per file."""
    return heading_lists(files.select(*key, "md"), full_unicode).select(*key, _inlined("headings", "pos", "level", "text", "slug"))


def document_order(files: DataFrame, order_list: DataFrame) -> DataFrame:
    """(job_id, position, filename): listed files in list order, then the others by name.

    ``order_list(job_id, pos, url)``. A listed page without a file is dropped, one listed twice
    comes twice. A job without a list is ordered by name.
    """
    listed = order_list.select("job_id", "pos", urls.filename_v1("url").alias("filename"))
    hits = listed.join(files.select("job_id", "filename"), ["job_id", "filename"])
    first = numbered(hits, ["job_id"], position_slot(F.col("pos")), [F.col("pos")], "position")
    orphans = files.select("job_id", "filename").join(listed, ["job_id", "filename"], "left_anti")
    placed = numbered_by_range(orphans, ["job_id"], ["filename"], "rank")
    listed_counts = hits.groupBy("job_id").agg(F.count("*").alias("listed"))
    rest = placed.join(listed_counts, "job_id", "left").select(
        "job_id", (F.coalesce("listed", F.lit(0)) + F.col("rank")).alias("position"), "filename")
    return first.select("job_id", "position", "filename").unionByName(rest)


def toc_v2(pages: DataFrame) -> DataFrame:
    """(job_id, pos, title, anchor, line): one entry per page; a repeated title gets a number."""
    counted = numbered(pages.select("job_id", "pos", "title"), ["job_id", "title"],
                       position_slot(F.col("pos")), [F.col("pos")], "nth")
    base = slugs.title_anchor("title")
    anchored = counted.withColumn("anchor", F.when(F.col("nth") == 1, base).otherwise(
        F.concat(base, F.lit("-"), (F.col("nth") - 1).cast("string"))))
    return anchored.select("job_id", "pos", "title", "anchor", F.concat(
        F.lit("- ["), F.col("title"), F.lit("](#"), F.col("anchor"), F.lit(")")).alias("line"))


def toc_v2_unique(pages: DataFrame) -> DataFrame:
    """As :func:`toc_v2`, but numbered per anchor, so different titles cannot share one."""
    based = pages.select("job_id", "pos", "title", slugs.title_anchor("title").alias("base"))
    counted = numbered(based, ["job_id", "base"], position_slot(F.col("pos")), [F.col("pos")], "nth")
    own = counted.select("job_id", F.col("base").alias("anchor")).distinct().withColumn("owned", F.lit(True))
    tried = counted.withColumn("anchor", F.when(F.col("nth") == 1, F.col("base")).otherwise(
        F.concat("base", F.lit("-"), (F.col("nth") - 1).cast("string"))))
    # A numbered name another title owns by itself gets a second, unmistakable number.
    clash = tried.join(own, ["job_id", "anchor"], "left")
    return clash.select("job_id", "pos", "title", F.when(
        F.col("owned") & (F.col("nth") > 1), F.concat("base", F.lit("--"), (F.col("nth") - 1).cast("string"))).otherwise(
        F.col("anchor")).alias("anchor"))


def _contents(ordered_files: DataFrame, full_unicode: bool) -> DataFrame:
    """(job_id, position, filename, md, lines): ``md`` without its frontmatter, ``lines`` an array of its entries (pos, line)."""
    bodies = ordered_files.select("job_id", "position", "filename",
                                  slugs.file_anchor("filename", F.col("position") - 1, full_unicode).alias("file"),
                                  M.strip_frontmatter("md").alias("md"))
    # the anchor of a file is worked out once, not for each of its headings
    entries = let(F.concat(F.lit("](#"), F.col("file"), F.lit("-")), lambda anchor: F.transform("headings", lambda h: F.struct(
        h["pos"].alias("pos"), F.concat(F.repeat(F.lit("  "), h["level"] - 1), F.lit("- ["), h["text"], anchor, h["slug"],
                                        F.lit(")")).alias("line"))))
    return heading_lists(bodies, full_unicode).select("job_id", "position", "filename", "md", entries.alias("lines"))


def toc_v1(ordered_files: DataFrame, full_unicode: bool = False) -> DataFrame:
    """(job_id, position, pos, line) for files (job_id, position, filename, md)."""
    return _contents(ordered_files, full_unicode).select("job_id", "position", _inlined("lines", "pos", "line"))


def stitched_v2(pages: DataFrame) -> DataFrame:
    """Document parts (job_id, section, pos, text); a document is its parts in order.

    ``pages(job_id, pos, title, md)``. Nothing is concatenated: a job may be larger than a row.
    """
    toc = toc_v2(pages)
    entries = toc.select("job_id", F.lit(1).alias("section"), F.col("pos"), F.concat("line", F.lit("\n")).alias("text"))
    # Fixed text of every document, from one pass over its job ids.
    fixed = pages.select("job_id").distinct().select("job_id", F.inline(F.array(
        F.struct(F.lit(0).alias("section"), F.lit("# Table of Contents\n").alias("text")),
        F.struct(F.lit(2).alias("section"), F.lit("\n---\n\n").alias("text"))))).select(
        "job_id", "section", F.lit(0).cast("long").alias("pos"), "text")
    bodies = pages.join(toc.select("job_id", "pos", "anchor"), ["job_id", "pos"]).select(
        "job_id", F.lit(3).alias("section"), F.col("pos"), F.concat(
            F.lit('<a name="'), F.col("anchor"), F.lit('"></a>\n# '), F.col("title"), F.lit("\n\n"), F.col("md"),
            F.lit("\n\n---\n\n")).alias("text"))
    return fixed.unionByName(entries).unionByName(bodies)


def stitched_v1(ordered_files: DataFrame, full_unicode: bool = False) -> DataFrame:
    """Document parts (job_id, section, pos, sub, text) for files (job_id, position, filename, md).

    A file's entries and its body come out of one row, so its text is read and moved once.
    """
    zero = F.lit(0).cast("long")
    fixed = ordered_files.select("job_id").distinct().select("job_id", F.inline(F.array(
        F.struct(F.lit(0).alias("section"), F.lit("# Table of Contents\n\n").alias("text")),
        F.struct(F.lit(2).alias("section"), F.lit("\n").alias("text"))))).select(
        "job_id", "section", zero.alias("pos"), zero.alias("sub"), "text")
    joint = F.when(F.col("position") == 1, "").otherwise("\n\n")
    body = F.struct(F.lit(3).alias("section"), zero.alias("sub"), F.concat(
        joint, F.lit("\n\n<!-- Source File: "), F.col("filename"), F.lit(" -->\n\n\n\n"), strip_space(F.col("md"))).alias("text"))
    entries = F.transform("lines", lambda entry: F.struct(
        F.lit(1).alias("section"), entry["pos"].cast("long").alias("sub"), F.concat(entry["line"], F.lit("\n")).alias("text")))
    none = F.array().cast("array<struct<section:int,sub:bigint,text:string>>")
    parts = _contents(ordered_files, full_unicode).select(
        "job_id", F.col("position").alias("pos"), F.inline(F.concat(F.coalesce(entries, none), F.array(body)))).select(
        "job_id", "section", "pos", "sub", "text")
    return fixed.unionByName(parts)
