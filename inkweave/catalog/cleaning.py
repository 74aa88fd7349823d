"""Cleaning rules over every document, each rule's subject written into every text.

The captured texts have none of the marks these rules remove, so each query adds lines with them,
numbered by document. Both sides then rewrite the whole text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from inkweave.catalog.common import load
from inkweave.catalog.content import sql_clean, sql_text
from inkweave.functions import markdown as M


def _marked(spark, folder, sample):
    added = F.replace(F.lit(sample), F.lit("{id}"), F.col("doc_id").cast("string"))
    return load(spark, folder, "documents").select("doc_id", F.concat("text", F.lit("\n"), added).alias("md"))


def sql_marked(sample):
    return f"text || chr(10) || replace({sql_text(sample)}, '{{id}}', doc_id::VARCHAR)"


def _group(sample, names, want=None, sql=None):
    """The rules over every text with the sample behind it; ``want`` is what they leave of the sample, written out."""
    def query(spark, folder):
        value = F.col("md")
        for name in names:
            value = M.apply_rule(value, name)
        return _marked(spark, folder, sample).select("doc_id", value.alias("md"))
    return query, sql or f"SELECT doc_id, {sql_left(want)} AS md FROM documents"


def sql_left(want):
    return f"text || chr(10) || replace({sql_text(want)}, '{{id}}', doc_id::VARCHAR)"


ARTIFACT_SAMPLE = """:: note {id}
::: {.x}
word{.cls-a b role="x"} [t{id}]{.lead} p
---|---|---
a {id}
 <i class="" data-k{id}="" id="">z</i>
[[deep {id}]] [[a]](u)"""
HEAD_SAMPLE = """

   # Head {id} #
x{id} C#
  >  quote {id}
>\tq"""
BRACE_SAMPLE = """## T {id} {#sec-{id}} {.cls} {k=v w} {} {plain}
:::tip
body {id}
:::
after
::: warn
tail"""
FENCE_SAMPLE = """```   {.py .x}
a = {id}
```
```c++  
b
```   
<!-- note {id} --><!--   --><!--
two
lines--> end"""
BANG_SAMPLE = """### ! Warn {id}
- ! item {id}
> ! said
12. ! twelfth
* !star
!Plain {id}
![img{id}](a.png)"""
LINK_SAMPLE = """[ ](http://a/{id}) [](b) [¶](http://c/{id}) [-->](d) [ok {id}](e)
![x](data:image/png;base64,AA{id}==) ![y](z.png)"""
PLACE_SAMPLE = """[Embedded Image: a{id}] [Embedded Image Removed]
[Embedded Image] end {id}
[Missing Image Source: q] [Missing Image Source]
[Image placeholder][Image placeholder] tail



gap {id}
[ref{id}]: http://x/{id} "t"
  [r2]: y"""
NEWLINE_SAMPLE = "a{id}\n\n\n\n\nb\n \n\t\nc{id}"


def line_bang(spark, folder):
    return _marked(spark, folder, BANG_SAMPLE).select("doc_id", M.apply_rule("md", "line_bang").alias("md"))


def reference_marks(spark, folder):
    sample = "See [{id}] and [2](u) and [3] [4]\n[5]! x[6] y [7](z) end [8]"
    return _marked(spark, folder, sample).select("doc_id", M.apply_rule("md", "reference_marks").alias("md"))


SQL_MARKS = f"""SELECT doc_id, text || chr(10) || 'See and [2](u) and! x[6] y [7](z) end' AS md FROM documents"""

INVISIBLE_SAMPLE = "a\u200bb{id} c \u00e2\u20ac\u2039d\u00a0\u00a0e"


def invisible_characters(spark, folder):
    return _marked(spark, folder, INVISIBLE_SAMPLE).select(
        "doc_id", M.plain_spaces("md").alias("spaced"), M.drop_invisible("md").alias("kept"))


SQL_INVISIBLE = """SELECT doc_id, replace(text, chr(160), ' ') || chr(10) || 'ab' || doc_id || ' c d  e' AS spaced,
  text || chr(10) || 'ab' || doc_id || ' c d' || chr(160) || chr(160) || 'e' AS kept FROM documents"""

SYMBOL_SAMPLE = "~~~\n---\n=== {id}\n***\n| --- |\n* *\n\n```\n¶ ¶\né\n#!\n"


def symbol_lines(spark, folder):
    return _marked(spark, folder, SYMBOL_SAMPLE).select("doc_id", M.drop_symbol_lines("md").alias("md"))


SQL_SYMBOL = """
SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda l: trim(l) = '' OR regexp_matches(l, '[a-zA-Z0-9]')), chr(10))
  || chr(10) || array_to_string(['---', '=== ' || doc_id, '***', '* *', '', '```', ''], chr(10)) AS md FROM documents"""


def trimmed_lines(spark, folder):
    return _marked(spark, folder, "  a{id} \r\n\tb \r c d \n").select("doc_id", M.trim_lines("md").alias("md"))


SQL_TRIMMED = """
SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13))), chr(10))
  || chr(10) || array_to_string(['a' || doc_id, 'b', 'c', 'd'], chr(10)) AS md FROM documents"""

LEFTOVER_SAMPLE = ('<div class="a"> </div><section><p>s{id}</p></section><button>go</button><a href="/k/z{id}"></a>'
                   '<a href="javascript:x">js</a><a href="/u{id}"><b>w</b></a><img src="a{id}.png"><img src="b.png" alt="B"><img alt="N"><img src="" alt="">')


def leftover_tags_v2(spark, folder):
    marked = _marked(spark, folder, LEFTOVER_SAMPLE)
    return marked.select("doc_id", M.chain("md", [M.strip_leftover_tags, M.rewrite_images_v2, M.rewrite_links_v2]).alias("md"))


SQL_LEFT_V2 = """SELECT doc_id, text || chr(10) || '<p>s' || doc_id || '</p>go[z' || doc_id || '](/k/z' || doc_id || ')js[w](/u' || doc_id || ')![Image](a'
  || doc_id || '.png)![B](b.png)[Image: N][Image placeholder]' AS md FROM documents"""

LEFT_V1_SAMPLE = ('<span>s{id}</span><img src="/spacer.gif"><img src="https://h/p{id}.png"><a href="/t{id}" aria-label="L"><img src="i.png" alt="q"></a>'
                  '<a href="/v"> <img src="x.gif"> </a><a href="data:x"><img alt="D"></a><img alt="k"><img src="/a.png" alt="A"><a href="/e"> </a>end')


def leftover_tags_v1(spark, folder):
    marked = _marked(spark, folder, LEFT_V1_SAMPLE)
    return marked.select("doc_id", M.chain("md", [M.rewrite_images_v1, M.unwrap_v1, M.drop_empty_links]).alias("md"))


SQL_LEFT_V1 = """SELECT doc_id, text || chr(10) || 's' || doc_id || '![Image](https://h/p' || doc_id || '.png)[L](/t' || doc_id
  || ')[link](/v)D[Image: k]![A](/a.png)end' AS md FROM documents"""

CHAIN_SAMPLE = HEAD_SAMPLE + "\n\n\n\n- item {id}\n~~~\n  tail\n"


def markdown_clean_v2(spark, folder):
    return _marked(spark, folder, CHAIN_SAMPLE).select("doc_id", M.clean_v2("md").alias("md"))


SQL_CLEAN_V2 = f"""
WITH {sql_clean(f"SELECT doc_id AS page_id, {sql_marked(CHAIN_SAMPLE)} AS md FROM documents")}
SELECT page_id AS doc_id, md FROM cleaned"""


def markdown_clean_v1(spark, folder):
    return _marked(spark, folder, ARTIFACT_SAMPLE.replace("<i ", "<u ") + NEWLINE_SAMPLE).select("doc_id", M.clean_v1("md").alias("md"))


SQL_CLEAN_V1 = f"""SELECT doc_id, trim({sql_left('word [t{id}] p' + chr(10) + 'a {id}' + chr(10) + ' <u class="" data-k{id}="" id="">z</i>' + chr(10) + '[[deep {id}]] [[a]](u)a{id}' + chr(10) + 'b' + chr(10) + 'c{id}')}, ' ' || chr(10)) || chr(10) AS md
FROM documents"""

# The one group that also changes the documents' own lines: the three rules in the other dialect.
SQL_HEADING_SPACE = f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({sql_marked(HEAD_SAMPLE)}, '(?m)^\\s*#', '#', 'g'), '(?m)#\\s*$', '', 'g'),
  '(?m)^\\s*>\\s', '> ', 'g') AS md FROM documents"""

ENTRIES = {
    "md_artifacts_v2": _group(ARTIFACT_SAMPLE, [
        "colon_lines", "class_braces", "bracket_braces", "odd_separators", "empty_attributes", "double_brackets"], '\n\nword [t{id}] p\n\na {id}\n <i>z</i>\n[deep {id}] [a](u)'),
    "md_artifacts_v1": _group(ARTIFACT_SAMPLE, ["colon_lines", "class_braces_v1", "odd_separators"], '\n\nword [t{id}] p\n\na {id}\n <i class="" data-k{id}="" id="">z</i>\n[[deep {id}]] [[a]](u)'),
    "md_bracket_braces": _group(ARTIFACT_SAMPLE, ["bracket_braces"], ':: note {id}\n::: {.x}\nword{.cls-a b role="x"} [t{id}] p\n---|---|---\na {id}\n <i class="" data-k{id}="" id="">z</i>\n[[deep {id}]] [[a]](u)'),
    "md_heading_space": _group(HEAD_SAMPLE, ["space_before_hash", "hash_at_end", "quote_space"], sql=SQL_HEADING_SPACE),
    "md_braces_and_colons": _group(BRACE_SAMPLE, ["attribute_braces", "colon_fences"], '## T {id}    {} {plain}\nbody {id}\nafter\n\ntail'),
    "md_fences_and_comments": _group(FENCE_SAMPLE, ["code_fences", "comments", "blank_comments"], '```\na = {id}\n```\n```c++\nb\n```\n[Comment: note {id}][Comment: two\nlines] end'),
    "md_heading_and_marker_bang": _group(BANG_SAMPLE, ["heading_bang", "marker_bang"], '### Warn {id}\n- item {id}\n> said\n12. twelfth\n* star\n!Plain {id}\n![img{id}](a.png)'),
    "md_line_bang": (line_bang, f"SELECT doc_id, regexp_replace({sql_marked(BANG_SAMPLE)}, '(?m)^!\\s*([A-Za-z0-9])', '\\1', 'g') AS md FROM documents"),
    "md_links_and_images": _group(LINK_SAMPLE, ["blank_links", "symbol_links", "data_images"], '  <http://c/{id}> <d> [ok {id}](e)\n[Embedded Image Removed] ![y](z.png)'),
    "md_placeholders": _group(PLACE_SAMPLE, ["newline_runs", "repeated_embedded", "repeated_missing", "repeated_images", "link_definitions"], '[Embedded Image] end {id}\n[Missing Image Source]\n[Image placeholder] tail\n\ngap {id}\n\n'),
    "md_newlines_v1": _group(NEWLINE_SAMPLE, ["newline_runs", "blank_lines"], 'a{id}\nb\nc{id}'),
    "md_reference_marks": (reference_marks, SQL_MARKS),
    "md_invisible": (invisible_characters, SQL_INVISIBLE),
    "md_symbol_lines": (symbol_lines, SQL_SYMBOL),
    "md_trimmed_lines": (trimmed_lines, SQL_TRIMMED),
    "md_leftover_tags_v2": (leftover_tags_v2, SQL_LEFT_V2),
    "md_leftover_tags_v1": (leftover_tags_v1, SQL_LEFT_V1),
    "markdown_clean_v2": (markdown_clean_v2, SQL_CLEAN_V2),
    "markdown_clean_v1": (markdown_clean_v1, SQL_CLEAN_V1),
}
