"""Headings, tables of contents and document order over documents and page titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkweave.catalog.common import SQL_HOST, load
from inkweave.catalog.content import sql_text
from inkweave.functions import html as H
from inkweave.functions import slugs, urls
from inkweave.functions.markdown import strip_frontmatter
from inkweave.operators import toc
from inkweave.session import stage

FRONT = "---\ntitle: x\n---\n\n"


def files(spark, folder):
    """Every document as a file of its source; its lines after the first become headings."""
    md = F.concat(F.lit(FRONT + "# Élan "), F.col("lang"), F.lit(" & Co\n\n#   \n### no\n#none\n"),
                  F.replace(F.col("text"), F.lit("\n"), F.lit("\n## ")))
    return load(spark, folder, "documents").select(
        F.col("source").alias("job_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("filename"),
        "doc_id", md.alias("md"))


SQL_SLUG = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(raw)), '[^\p{L}\p{N}\p{Mn}_\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '-')"""
SQL_HEADINGS = f"""lines AS (SELECT source AS job_id, doc_id, unnest(list_prepend('# Élan ' || lang || ' & Co', list_transform(string_split(text, chr(10))[2:], lambda l: '## ' || l))) AS line,
    unnest(list_prepend(0, range(6, 5 + len(string_split(text, chr(10)))))) AS pos FROM documents),
raw AS (SELECT job_id, doc_id, pos, length(regexp_extract(line, '^(#+)', 1)) AS level, trim(regexp_extract(line, '^#+\\s+(.*)$', 1)) AS raw FROM lines
  WHERE trim(regexp_extract(line, '^#+\\s+(.*)$', 1)) <> ''),
based AS (SELECT *, coalesce(nullif({SQL_SLUG}, ''), 'section') AS base FROM raw),
headings AS (SELECT job_id, doc_id, pos, level, raw AS text, base || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '-' || (row_number() OVER w - 1) END AS slug
  FROM based WINDOW w AS (PARTITION BY doc_id, base ORDER BY pos))"""


def headings(spark, folder):
    bodies = files(spark, folder).select("doc_id", strip_frontmatter("md").alias("md"))
    return toc.headings(bodies, ["doc_id"]).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), F.col("level").cast("long").alias("level"), "text", "slug")


def full_unicode_slugs(spark, folder):
    """Marks off in any script; the built-in form covers Latin letters."""
    title = F.concat(H.title_v1("html"), F.lit(" Ǻ ế й ά __ x"))
    return load(spark, folder, "pages").select(
        "page_id", slugs.slug(title, full_unicode=True).alias("any_script"), slugs.slug(F.translate(title, "йά", "")).alias("latin"))


_TITLE_SQL = """trim(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)', 1), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'))"""
SQL_UNICODE = f"""
WITH a AS (SELECT page_id, {_TITLE_SQL} || ' Ǻ ế й ά __ x' AS raw FROM pages),
b AS (SELECT page_id, {SQL_SLUG} AS any_script FROM a),
c AS (SELECT page_id, {_TITLE_SQL} || ' Ǻ ế   __ x' AS raw FROM pages)
SELECT page_id, any_script, {SQL_SLUG} AS latin FROM b JOIN c USING (page_id)"""


def order_list(spark, folder):
    """Two of three documents, last first; some twice, some lines without a file."""
    doc = F.col("doc_id")
    many = load(spark, folder, "documents").where(doc % 3 != 0).select(F.col("source").alias("job_id"), "doc_id", F.explode(F.when(
        doc % 10 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"))
    name = F.when(doc % 7 == 4, "gone-").otherwise("doc-")
    return many.select("job_id", (F.lit(10_000_000) - doc * 2 + F.col("again")).alias("pos"),
                       F.concat(F.lit("https://h/"), name, doc.cast("string")).alias("url"))


def order_with_orphans(spark, folder):
    return toc.document_order(files(spark, folder), order_list(spark, folder))


SQL_ORDERED = """listed AS (SELECT source AS job_id, doc_id, 10000000 - doc_id * 2 + again AS pos FROM documents,
    LATERAL (SELECT unnest(CASE WHEN doc_id % 10 = 1 THEN [0, 1] ELSE [0] END) AS again) WHERE doc_id % 3 <> 0 AND doc_id % 7 <> 4),
everything AS (SELECT job_id, doc_id, 0 AS part, pos, '' AS name FROM listed
  UNION ALL SELECT source, doc_id, 1, 0, 'doc-' || doc_id || '.md' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM listed)),
ordered AS (SELECT job_id, doc_id, 'doc-' || doc_id || '.md' AS filename, row_number() OVER (PARTITION BY job_id ORDER BY part, pos, name) AS position FROM everything)"""


def _ordered_files(spark, folder):
    stored = files(spark, folder)
    # narrow rows, written once: the contents, the document and its jobs read them
    return stage(toc.document_order(stored, order_list(spark, folder))).join(stored.select("job_id", "filename", "md"), ["job_id", "filename"])


def toc_v1(spark, folder):
    return toc.toc_v1(_ordered_files(spark, folder)).select("job_id", "position", F.col("pos").cast("long").alias("pos"), "line")


SQL_TOC_V1 = f"""
WITH {SQL_ORDERED}, {SQL_HEADINGS}
SELECT o.job_id, position, pos, CASE level WHEN 2 THEN '  ' ELSE '' END || '- [' || text || '](#doc-' || o.doc_id || '-' || slug || ')' AS line
FROM ordered o JOIN headings h ON h.doc_id = o.doc_id"""


def stitched_v1(spark, folder):
    parts = toc.stitched_v1(_ordered_files(spark, folder))
    return parts.select("job_id", F.col("section").cast("long").alias("section"), F.col("pos").cast("long").alias("pos"), "sub",
                        F.md5("text").alias("text_md5"))


SQL_STITCHED_V1 = f"""
WITH {SQL_ORDERED}, {SQL_HEADINGS},
parts AS (
  SELECT DISTINCT job_id, 0 AS section, 0 AS pos, 0 AS sub, '# Table of Contents' || chr(10) || chr(10) AS text FROM ordered
  UNION ALL SELECT DISTINCT job_id, 2, 0, 0, chr(10) FROM ordered
  UNION ALL SELECT o.job_id, 1, position, pos, CASE level WHEN 2 THEN '  ' ELSE '' END || '- [' || text || '](#doc-' || o.doc_id || '-' || slug || ')' || chr(10)
    FROM ordered o JOIN headings h ON h.doc_id = o.doc_id
  UNION ALL SELECT o.job_id, 3, position, 0, CASE WHEN position = 1 THEN '' ELSE chr(10) || chr(10) END || chr(10) || chr(10) || '<!-- Source File: ' || filename || ' -->'
    || repeat(chr(10), 4) || regexp_replace('# Élan ' || lang || {sql_text(" & Co\n\n#   \n### no\n#none\n")} || replace(text, chr(10), chr(10) || '## '), '^\\s+|\\s+$', '', 'g')
    FROM ordered o JOIN documents d ON d.doc_id = o.doc_id)
SELECT job_id, section, pos, sub, md5(text) AS text_md5 FROM parts"""


def titled_pages(spark, folder):
    """A job per host; two of three titles repeat, and some differ only by punctuation."""
    k = F.col("page_id") % 3
    title = F.when(k == 0, H.title_v1("html")).when(k == 1, "A B").otherwise(F.when(F.col("page_id") % 2 == 0, "A-B").otherwise("日本"))
    return load(spark, folder, "pages").select(
        urls.host("url").alias("job_id"), F.col("page_id").alias("pos"), "url", title.alias("title"))


SQL_TITLED = f"""titled AS (SELECT {SQL_HOST} AS job_id, page_id AS pos, url, html, CASE page_id % 3 WHEN 0 THEN {_TITLE_SQL} WHEN 1 THEN 'A B'
    ELSE CASE WHEN page_id % 2 = 0 THEN 'A-B' ELSE '日本' END END AS title FROM pages),
anchored AS (SELECT *, coalesce(nullif(trim(regexp_replace(lower(title), '[^a-z0-9_]+', '-', 'g'), '-'), ''), 'page') AS base,
    row_number() OVER (PARTITION BY job_id, title ORDER BY pos) AS nth FROM titled),
toc AS (SELECT *, base || CASE WHEN nth = 1 THEN '' ELSE '-' || (nth - 1) END AS anchor FROM anchored)"""


def toc_v2(spark, folder):
    return toc.toc_v2(titled_pages(spark, folder))


def toc_v2_unique(spark, folder):
    return toc.toc_v2_unique(titled_pages(spark, folder)).select("job_id", "pos", "anchor")


SQL_TOC_UNIQUE = f"""
WITH {SQL_TITLED},
again AS (SELECT job_id, pos, base, row_number() OVER (PARTITION BY job_id, base ORDER BY pos) AS nth FROM anchored),
tried AS (SELECT *, base || CASE WHEN nth = 1 THEN '' ELSE '-' || (nth - 1) END AS anchor FROM again)
SELECT job_id, pos, CASE WHEN nth > 1 AND EXISTS (SELECT 1 FROM again a WHERE a.job_id = t.job_id AND a.base = t.anchor)
  THEN base || '--' || (nth - 1) ELSE anchor END AS anchor FROM tried t"""

ENTRIES = {
    "headings": (headings, f"WITH {SQL_HEADINGS} SELECT doc_id, pos, level, text, slug FROM headings"),
    "full_unicode_slugs": (full_unicode_slugs, SQL_UNICODE),
    "order_with_orphans": (order_with_orphans, f"WITH {SQL_ORDERED} SELECT job_id, position, filename FROM ordered"),
    "toc_v1": (toc_v1, SQL_TOC_V1),
    "stitched_v1": (stitched_v1, SQL_STITCHED_V1),
    "toc_v2": (toc_v2, f"""WITH {SQL_TITLED} SELECT job_id, pos, title, anchor, '- [' || title || '](#' || anchor || ')' AS line FROM toc"""),
    "toc_v2_unique": (toc_v2_unique, SQL_TOC_UNIQUE),
}
