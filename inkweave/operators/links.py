"""Links of captured pages: extraction, navigation areas, resolution to job edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.functions import as_col, let, once, scope, strip_space, urls
from inkweave.functions.html import ATTRS, attribute, decode_entities
from inkweave.operators.joins import salted_join

_LINK = rf"(?is)<a(?![\w\-])({ATTRS})>"
_OPEN_NAME = r"^<([A-Za-z][A-Za-z0-9]*)"
_NAME = r"^</?([A-Za-z][A-Za-z0-9]*)"


def _visible(html: Column | str) -> Column:
    """Text a parser sees as tags: comments, scripts and styles off."""
    return F.regexp_replace(as_col(html), rf"(?is)<!--.*?-->|<(script|style)(?![\w\-]){ATTRS}>.*?</\1\s*>", "")


def _href(tag_inside: Column) -> Column:
    return decode_entities(attribute(tag_inside, "href"))


def extract_links(pages: DataFrame) -> DataFrame:
    """Every ``a`` with an href: (page_id, url, pos, href); pos counts links of the page from 0."""
    # taken out before the rows are made, so that later filters do not repeat the work
    hrefs = F.transform(F.regexp_extract_all(_visible("html"), F.lit(_LINK), 1), lambda inside: F.when(
        inside.rlike(r"(?i)(?:^|\s)href\s*="), _href(inside)))
    return pages.select("page_id", "url", F.posexplode(hrefs).alias("pos", "href")).where(F.col("href").isNotNull())


def _marked(tag: Column, profile: str) -> Column:
    """Opening tag of a navigation area."""
    name = F.lower(F.regexp_extract(tag, _OPEN_NAME, 1))

    def classed(word: str) -> Column:
        return tag.rlike(rf"""(?is)\sclass\s*=\s*["']?(?:[^"'>]*\s)?{word}(?=[\s"'/>])""")

    def named(word: str) -> Column:
        return tag.rlike(rf"""(?is)\sid\s*=\s*["']?{word}(?=[\s"'/>])""")

    def holds(attr: str, word: str) -> Column:
        return tag.rlike(rf"""(?is)\s{attr}\s*=\s*(?:"[^"]*{word}|'[^']*{word}|[^\s"'>]*{word})""")

    # What counts as navigation in each profile.
    if profile == "v1":
        hit = classed("sidebar") | classed("toc") | named("sidebar") | named("nav") | named("toc")
    else:
        hit = classed("sidebar") | classed("toc") | classed("menu") | named("TableOfContents")
        for word in ("nav", "menu", "toc", "sidebar"):
            hit = hit | ((name == "div") & (holds("class", word) | holds("id", word)))
        hit = hit | (name.isin("ul", "ol", "aside") & holds("class", "nav")) | ((name == "aside") & holds("id", "nav"))
    # Most tags have neither attribute and stop at the first test.
    return (name == "nav") | (tag.rlike(r"(?i)\s(?:class|id)\s*=") & hit)


def tag_tokens(pages: DataFrame, profile: str = "v2") -> DataFrame:
    """Link tags and tags named like a navigation area of the page, in order.

    Only tags travel, never text, and only names that matter on that page.
    """
    found = F.regexp_extract_all(_visible("html"), F.lit(rf"(?is)</?[A-Za-z]{ATTRS}>"), 0)

    def relevant(tags: Column) -> Column:
        opened = F.filter(tags, lambda t: _marked(t, profile))
        areas = F.array_distinct(F.transform(opened, lambda t: F.lower(F.regexp_extract(t, _OPEN_NAME, 1))))
        return let(areas, lambda names: F.when(F.size(names) > 0, F.filter(
            tags, lambda t: t.rlike(r"(?is)^<a[\s/>]")
            | F.array_contains(names, F.lower(F.regexp_extract(t, _NAME, 1))))))

    kept = pages.select("page_id", "url", let(found, relevant).alias("tags"))
    return kept.select("page_id", "url", F.posexplode("tags").alias("pos", "tag")).select(
        "page_id", "url", "pos", "tag",
        F.lower(F.regexp_extract("tag", _NAME, 1)).alias("name"),
        F.col("tag").startswith("</").alias("closing"),
        (~F.col("tag").startswith("</") & ~F.col("tag").rlike(r"(?s)/>$") & _marked(F.col("tag"), profile)).alias("area"),
    )


def navigation_links(pages: DataFrame, profile: str = "v2") -> DataFrame:
    """Links inside a navigation area, with the same ``pos`` as :func:`extract_links`.

    Depth runs per tag name, so other unclosed tags do no harm. One shuffle by page serves all
    the windows.
    """
    tokens = tag_tokens(pages, profile).repartition("page_id")
    by_name = Window.partitionBy("page_id", "name").orderBy("pos")
    page = Window.partitionBy("page_id").orderBy("pos")
    step = F.when(F.col("closing"), -1).when(F.col("tag").rlike(r"(?s)/>$"), 0).otherwise(1)
    levelled = tokens.withColumn("level", F.sum(step).over(by_name) + F.col("closing").cast("int"))
    # A closing tag ends an area when the last tag opened at its level was one.
    at_level = Window.partitionBy("page_id", "name", "level").orderBy("pos")
    ends = F.col("closing") & F.coalesce(F.lag("area").over(at_level), F.lit(False))
    moved = levelled.withColumn("move", F.when(F.col("area"), 1).when(ends, -1).otherwise(0))
    is_link = (F.col("name") == "a") & ~F.col("closing")
    placed = moved.select(
        "page_id", "url", "tag", is_link.alias("is_link"),
        F.sum("move").over(page).alias("open_areas"),
        (F.sum(is_link.cast("int")).over(page) - 1).alias("pos"),
    )
    inside = F.regexp_extract("tag", _LINK, 1)
    return placed.where(F.col("is_link") & (F.col("open_areas") > 0)
                        & inside.rlike(r"(?i)(?:^|\s)href\s*=")).select(
        "page_id", "url", "pos", _href(inside).alias("href"))


def resolve(links: DataFrame, profile: str = "v2") -> DataFrame:
    """Add the absolute target; references that lead nowhere go. ``v2`` drops fragments."""
    if profile == "v1":
        cleaned = links.withColumn("href", strip_space(F.col("href"))).where(~urls.skipped_href("href"))
        return cleaned.select("*", once(urls.join("url", "href")).alias("dst")).where(urls.fetchable("dst"))
    kept = links.where(~F.col("href").rlike(r"^(?:mailto:|tel:|javascript:)"))
    return kept.select("*", once(urls.strip_fragment(urls.join("url", "href"))).alias("dst"))


def job_edges(links: DataFrame, jobs: DataFrame, profile: str = "v2") -> DataFrame:
    """In-scope edges (job_id, src, dst, pos), the first link of each target; one row per job and link.

    Fragments never make a second node, in either profile.
    ``jobs`` carries scope columns. Scope tests run on the narrow link rows, after an equi-join
    on the host, so patterns never cause a nested-loop join.
    """
    targets = resolve(links, profile).select(
        urls.host("dst").alias("host"), F.col("url").alias("src"), urls.strip_fragment("dst").alias("dst"), "pos")
    joined = salted_join(targets, jobs.select(
        "job_id", "host", "seed_prefix", "seed_prefixes", "include_prefixes", "exclude_regexes"),
        ["host"], spread=F.col("src"))
    if profile == "v1":
        hit = scope.in_scope_v1("dst", "host", "seed_prefix", "include_prefixes", "exclude_regexes") \
            & urls.is_html_v1("dst")
    else:
        hit = scope.in_scope_v2("dst", "host", "seed_prefixes", "include_prefixes", "exclude_regexes")
    return joined.where(hit).groupBy("job_id", "src", "dst").agg(F.min("pos").alias("pos"))


def outlink_sets(edges: DataFrame) -> DataFrame:
    return edges.groupBy("job_id", "src").agg(F.sort_array(F.collect_set("dst")).alias("targets"))


def broken_links(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """In-scope links whose target was not captured."""
    known = pages.select(urls.strip_fragment("url").alias("dst")).distinct()
    return edges.join(known, "dst", "left_anti")
