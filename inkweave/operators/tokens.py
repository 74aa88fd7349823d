"""Pages as a table of tokens with intervals: what lies inside an element is a range of positions.

Every page is cut into comments, raw elements (scripts, styles), tags and text; the pieces put
together are the page. An opening tag knows the position of its own closing tag (``until``), so
"inside" is a comparison of positions and needs no tree. A closing tag belongs to the last open
tag of its name, so unclosed tags of other names do no harm; an unclosed tag has no ``until`` and
reaches to the end of the page. One shuffle by page serves all windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.functions.html import ATTRS, MAIN_SELECTORS_V1, MAIN_SELECTORS_V2, _selector_pattern, drop_noise
from inkweave.operators.links import _LINK, _href, _marked
from inkweave.session import width

_TOKEN = rf"(?is)<!--.*?-->|<(script|style)(?![\w\-]){ATTRS}>.*?</\1\s*>|</?[A-Za-z]{ATTRS}>|<![^>]*>|[^<]++|<"
# Elements without content and closing tag.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
#: Position behind every token, for tags that are never closed.
END = 2**31 - 1


def token_table(pages: DataFrame, text: bool = True) -> DataFrame:
    """(page_id, url, pos, kind, name, source, begin, length, depth, until) of every token of ``pages(page_id, url, html)``.

    ``kind`` is text, open, close, void, comment or raw; ``begin`` and ``length`` count characters;
    ``depth`` is the number of closed elements around the token; ``until`` is the position of an
    opening tag's closing tag, NULL when there is none. Unmatched closing tags stand for themselves.
    Without ``text`` only opening and void tags keep their ``source``, so a page's text is neither
    shuffled nor sorted; all else is the same.
    """
    cut = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(_TOKEN), 0)).alias("pos", "source"))
    tag = F.lower(F.regexp_extract("source", r"^</?([A-Za-z][^\s/>]*)", 1))
    kinds = (F.when(F.col("source").startswith("<!"), "comment").when(F.col("name") == "", "text").when(F.col("source").startswith("</"), "close")
             .when(F.col("name").isin("script", "style") & F.col("source").rlike(r"(?s)</[^<]*>$"), "raw")
             .when(F.col("name").isin(*VOID) | F.col("source").rlike(r"(?s)/>$"), "void").otherwise("open"))
    named = cut.withColumn("name", tag).withColumn("kind", kinds).withColumn("length", F.length("source"))
    if not text:
        named = named.withColumn("source", F.when(F.col("kind").isin("open", "void"), F.col("source")))
    # a named number of parts is not put together again, so what a task sorts stays small
    named = named.repartition(width(pages.sparkSession), "page_id")
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1)
    # tokens that open or close nothing stay out of the pairing
    by_name = Window.partitionBy("page_id", "name", "_pairs").orderBy("pos")
    page = Window.partitionBy("page_id").orderBy("pos")
    levelled = named.withColumn("_pairs", step.isNotNull()).withColumn("_level", F.sum(step).over(by_name) + (F.col("kind") == "close").cast("int"))
    at_level = Window.partitionBy("page_id", "name", "_pairs", "_level").orderBy("pos")
    near = levelled.withColumn("_next", F.lead(F.struct("kind", "pos")).over(at_level)).withColumn("_before", F.lag("kind").over(at_level))
    matched = near.withColumn("until", F.when((F.col("kind") == "open") & (F.col("_next.kind") == "close"), F.col("_next.pos"))).withColumn(
        "_ends", (F.col("kind") == "close") & F.coalesce(F.col("_before") == "open", F.lit(False)))
    move = F.col("until").isNotNull().cast("int") - F.col("_ends").cast("int")
    return matched.select(
        "page_id", "url", "pos", "kind", F.nullif("name", F.lit("")).alias("name"), "source", (F.sum("length").over(page) - F.col("length")).alias("begin"), "length",
        (F.sum(move).over(page) - F.col("until").isNotNull().cast("int")).alias("depth"), "until")


def within(areas: Column) -> Column:
    """Whether a token lies inside an element whose opening tag meets ``areas``: one running maximum, nested or not."""
    before = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(areas & (F.col("kind") == "open"), F.coalesce("until", F.lit(END)))).over(before)
    return F.coalesce(reach > F.col("pos"), F.lit(False))


def navigation_links(tokens: DataFrame, profile: str = "v2") -> DataFrame:
    """Links inside navigation areas of a token table, with the ``pos`` of :func:`inkweave.operators.links.extract_links`."""
    page = Window.partitionBy("page_id").orderBy("pos")
    link = (F.col("name") == "a") & F.col("kind").isin("open", "void")
    # an area reaches to a position, so closing tags and text need not be sorted again
    placed = tokens.where(F.col("kind").isin("open", "void")).withColumn("_in", within(_marked(F.col("source"), profile))).withColumn("_nth", F.sum(link.cast("int")).over(page) - 1)
    inside = F.regexp_extract("source", _LINK, 1)
    return placed.where(link & F.col("_in") & inside.rlike(r"(?i)(?:^|\s)href\s*=")).select("page_id", "url", F.col("_nth").alias("pos"), _href(inside).alias("href"))


def _meets(selector: str) -> Column:
    """Whether an opening tag meets a selector without a blank."""
    return F.col("kind").isin("open", "void") & F.col("source").rlike(_selector_pattern(selector).replace("(?is)", "(?is)^", 1))


def main_spans(tokens: DataFrame, profile: str = "v2") -> DataFrame:
    """(page_id, selector, begin, length) of the element a page's text is taken from; pages that no selector hits have no row."""
    hits = []
    for rank, selector in enumerate(MAIN_SELECTORS_V2 if profile == "v2" else MAIN_SELECTORS_V1):
        outer, _, inner = selector.rpartition(" ")
        test = _meets(inner) & within(F.col("name") == outer) if outer else _meets(inner)
        hits.append(F.when(test, F.struct(F.lit(rank).alias("rank"), F.lit(selector).alias("selector"))))
    page = Window.partitionBy("page_id").orderBy("pos")
    marked = tokens.withColumn("_hit", F.coalesce(*hits)).withColumn("_stop", F.col("begin") + F.col("length"))
    chosen = F.min(F.when(F.col("_hit").isNotNull(), F.struct(F.col("_hit.rank").alias("rank"), "pos", F.col("_hit.selector").alias("selector"), "begin", "until")))
    best = marked.withColumn("_best", chosen.over(Window.partitionBy("page_id")))
    stop = F.max(F.when(F.col("_best.until").isNull() | (F.col("pos") <= F.col("_best.until")), F.col("_stop")))
    return best.where(F.col("_best").isNotNull()).groupBy("page_id").agg(F.first("_best").alias("_best"), stop.alias("_stop")).select(
        "page_id", "_best.selector", "_best.begin", (F.col("_stop") - F.col("_best.begin")).alias("length"))


def main_content(pages: DataFrame, profile: str = "v2") -> DataFrame:
    """(page_id, selector, content) by the token table; the whole page where no selector hits."""
    source = pages.select("page_id", "url", (drop_noise("html") if profile == "v2" else F.col("html")).alias("html"))
    spans = main_spans(token_table(source, text=False), profile)
    # a character is not always one unit of the text, and substring counts characters as length does
    return source.join(spans, "page_id", "left").select("page_id", "selector", F.coalesce(F.expr("substring(html, begin + 1, length)"), F.col("html")).alias("content"))
