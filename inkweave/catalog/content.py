"""Page content over every captured page."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkweave.catalog.common import SQL_HOST, SQL_PATH, load
from inkweave.functions import html as H
from inkweave.functions import markdown as M
from inkweave.operators import content as C
from inkweave.operators import tokens

# Written into every article, {id} being the page: elements the captured pages do not use.
BLOCK = """<h2 class="x">Sec {id}</h2>
<p>Some <em>em</em> and <strong>strong {id}</strong> with <code>x  y</code>.</p>
<ul><li>one</li><li>two<ol><li>n</li><li>m</li></ol></li></ul>
<blockquote><p>quoted {id}</p></blockquote>
<pre><code># raw
  {id} &lt; 2</code></pre>
<p><a href="/t/{id}" title="T">go</a> <img src="i{id}.png"> <img src="data:image/png;base64,AA" alt="pic"> <img alt="gone"></p>
<table class="t"><tr><th>A</th><th>B</th></tr><tr><td>{id}</td><td><b>z</b></td></tr></table><hr>"""
BLOCK_MD = """## Sec {id}

Some *em* and **strong {id}** with `x y`.

- one
- two
  1. n
  2. m

> quoted {id}

```
# raw
  {id} < 2
```

[go](/t/{id} "T") ![Image](i{id}.png) [Embedded Image: pic] [Missing Image Source: gone]

| A | B |
| --- | --- |
| {id} | **z** |

---"""


def rich_pages(spark, folder):
    block = F.replace(F.lit(BLOCK + "</article>"), F.lit("{id}"), F.col("page_id").cast("string"))
    return load(spark, folder, "pages").select(
        "page_id", "url", F.replace(F.col("html"), F.lit("</article>"), block).alias("html"))


def sql_text(text):
    return "'" + text.replace("'", "''") + "'"


def sql_article_md(column="html"):
    """Headings, paragraphs and line breaks of an article, as the captured pages have them."""
    steps = [(r"[ \t\r\n\f]+", " "), (r"(?i) *<br[^>]*> *", "  \n"), (r"(?i)\s*<h1[^>]*>\s*", "\n\n# "),
             (r"(?i)\s*</h[1-6]>\s*", "\n\n"), (r"(?i)\s*</?p[^>]*>\s*", "\n\n"), (r"<[^>]*>", "")]
    text = f"regexp_extract({column}, '(?s)<article>(.*)</article>', 1)"
    for pattern, replacement in steps:
        text = f"regexp_replace({text}, {sql_text(pattern)}, {sql_text(replacement)}, 'g')"
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return f"trim(regexp_replace({text}, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"


SQL_RICH_MD = f"""{sql_article_md()} || chr(10) || chr(10) || replace({sql_text(BLOCK_MD)}, '{{id}}', page_id::VARCHAR) || chr(10)"""


def sql_clean(source):
    """The cleaning chain on text without braces, tags and comments. ``source`` gives (page_id, md)."""
    return f"""clean1 AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(md, chr(160), ' '),
    '(?m)^\\s*#', '#', 'g'), '(?m)#\\s*$', '', 'g'), '(?m)^\\s*>\\s', '> ', 'g') AS md FROM ({source})),
clean2 AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(md, '(?m)^:+.*$', '', 'g'), '```\\s*(\\n|$)', '```\\1', 'g'),
    '\\n{{3,}}', chr(10) || chr(10), 'g') AS md FROM clean1),
clean3 AS (SELECT page_id, list_transform(string_split(regexp_replace(md, '\\n$', ''), chr(10)), lambda l: trim(l)) AS lines FROM clean2),
clean4 AS (SELECT page_id, list_filter(string_split(regexp_replace(array_to_string(lines, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)),
    lambda l: l = '' OR regexp_matches(l, '^(-{{3,}}|_{{3,}}|\\*{{3,}}|```.*)$') OR regexp_matches(l, '[a-zA-Z0-9]')
      OR (regexp_matches(l, '[!#*\\[\\]()_]') AND regexp_matches(l, '[a-zA-Z0-9\\s]'))) AS lines FROM clean3),
cleaned AS (SELECT page_id, trim(regexp_replace(array_to_string(lines, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) || chr(10) AS md FROM clean4)"""


def page_title(spark, folder):
    title = F.when(F.col("page_id") % 3 == 1, F.regexp_replace("html", "<title>[^<]*", "<title>\n ")).when(
        F.col("page_id") % 3 == 2, F.regexp_replace("html", "<title>[^<]*</title>", "")).otherwise(F.col("html"))
    pages = load(spark, folder, "pages").select("page_id", "url", title.alias("html"))
    return pages.select("page_id", H.title_v1("html").alias("v1"), H.title_v2("html", "url").alias("v2"))


SQL_TITLE = f"""
WITH t AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN trim(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)', 1),
  '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&')) END AS title FROM pages)
SELECT page_id, coalesce(nullif(title, ''), 'Untitled') AS v1,
  coalesce(nullif(title, ''), nullif(regexp_extract({SQL_PATH}, '[^/]*$'), ''), {SQL_HOST}) AS v2 FROM t"""

_WRAPS = [("<article>", "</article>"), ("<main>", "</main>"), ('<div id="q" role="main">', "</div>"),
          ('<section class="a main-content">', "</section>"), ('<main><p>no</p><div class="content x">', "</div></main>"),
          ("<section>", "</section>")]


def wrapped_pages(spark, folder):
    """The article under another container in five of six pages; the last kind has only a body."""
    k = F.col("page_id") % len(_WRAPS)
    opened, closed = F.lit(_WRAPS[0][0]), F.lit(_WRAPS[0][1])
    for n, (a, b) in enumerate(_WRAPS[1:], 1):
        opened, closed = F.when(k == n, a).otherwise(opened), F.when(k == n, b).otherwise(closed)
    inner = F.concat(opened, F.lit("<div>d</div>"), F.regexp_extract("html", "(?s)<article>(.*)</article>", 1), closed)
    page = F.concat(F.regexp_extract("html", "(?s)^(.*)<article>", 1), inner, F.regexp_extract("html", "(?s)</article>(.*)$", 1))
    return load(spark, folder, "pages").select("page_id", "url", page.alias("html"))


SQL_WRAPPED = f"""w AS (SELECT page_id, '<div>d</div>' || regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS inside,
    {[a for a, _ in _WRAPS]}[page_id % {len(_WRAPS)} + 1] AS opened, {[b for _, b in _WRAPS]}[page_id % {len(_WRAPS)} + 1] AS closed,
    regexp_extract(html, '(?s)^(.*)<article>', 1) AS head, regexp_extract(html, '(?s)</article>(.*)$', 1) AS tail FROM pages)"""


def _main(profile):
    def query(spark, folder):
        got = C.main_content(wrapped_pages(spark, folder), profile)
        return got.select("page_id", "selector", F.md5("content").alias("content_md5"), F.length("content").cast("long").alias("n_chars"))
    return query


def main_content_tokens(spark, folder):
    """The main element by the interval-coded token table."""
    got = tokens.main_content(wrapped_pages(spark, folder))
    return got.select("page_id", "selector", F.md5("content").alias("content_md5"), F.length("content").cast("long").alias("n_chars"))


def token_table(spark, folder):
    """Tokens of every page: how many of each kind, the deepest one, and the texts put together."""
    got = tokens.token_table(load(spark, folder, "pages"))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "source"))), lambda x: x["source"]), "")
    return got.groupBy("page_id").agg(
        F.count("*").alias("n_tokens"), F.count_if(F.col("kind") == "text").alias("n_text"), F.count_if(F.col("kind").isin("open", "void")).alias("n_opened"),
        F.count_if(F.col("until").isNotNull()).alias("n_closed"), F.max("depth").alias("depth"), F.md5(ordered).alias("html_md5"))


#: The closing tag of an opening one is the next of its name that brings the count of open ones below; depth counts the pairs around a token.
SQL_TOKENS = r"""
WITH one AS (SELECT page_id, unnest(t) AS x, unnest(range(len(t))) AS pos FROM (SELECT page_id,
  regexp_extract_all(html, '(?s:<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>)|</?[A-Za-z][^>]*>|<![^>]*>|[^<]+|<') AS t FROM pages)),
named AS (SELECT *, lower(regexp_extract(x, '^</?([A-Za-z][^\s/>]*)', 1)) AS name FROM one),
stepped AS (SELECT *, CASE WHEN name IN ('', 'script', 'style', 'meta', 'link', 'br', 'hr', 'img', 'input') OR x LIKE '%/>' THEN 0 WHEN x LIKE '</%' THEN -1 ELSE 1 END AS step FROM named),
leveled AS (SELECT *, sum(step) OVER (PARTITION BY page_id, name ORDER BY pos) AS level FROM stepped),
pairs AS (SELECT o.page_id, o.pos, min(c.pos) AS until FROM leveled o JOIN leveled c ON c.page_id = o.page_id AND c.name = o.name AND c.pos > o.pos AND c.step = -1 AND c.level = o.level - 1
  WHERE o.step = 1 GROUP BY o.page_id, o.pos),
depths AS (SELECT page_id, max(n) AS depth FROM (SELECT t.page_id, t.pos, count(p.pos) AS n FROM one t LEFT JOIN pairs p ON p.page_id = t.page_id AND p.pos < t.pos AND t.pos < p.until GROUP BY ALL) GROUP BY page_id)
SELECT page_id, count(*) AS n_tokens, count(*) FILTER (WHERE x NOT LIKE '<%') AS n_text, count(*) FILTER (WHERE name NOT IN ('', 'script', 'style') AND x NOT LIKE '</%') AS n_opened,
  (SELECT count(*) FROM pairs p WHERE p.page_id = s.page_id) AS n_closed, any_value(depth) AS depth, md5(string_agg(x, '' ORDER BY pos)) AS html_md5
FROM stepped s JOIN depths USING (page_id) GROUP BY page_id"""


def _sql_main(selectors, body, inner):
    return f"""
WITH {SQL_WRAPPED},
noiseless AS (SELECT page_id, inside, opened, closed, {body.format(x='head')} AS head, {body.format(x='tail')} AS tail FROM w),
chosen AS (SELECT page_id, {selectors}[page_id % {len(_WRAPS)} + 1] AS selector, CASE {selectors}[page_id % {len(_WRAPS)} + 1]
  WHEN 'body' THEN regexp_replace(regexp_extract(head || opened || inside || closed || tail, '(?s)(<body.*)', 1), '(?s)</body>.*$', '</body>')
  WHEN 'main .content' THEN {inner} ELSE opened || inside || closed END AS content FROM noiseless)
SELECT page_id, selector, md5(content) AS content_md5, length(content) AS n_chars FROM chosen"""


_NOISE_SQL = "regexp_replace({x}, '(?s)<!--.*?-->|<script>.*?</script>|<style>.*?</style>|<(meta|link)[^>]*>', '', 'g')"
SQL_MAIN_V2 = _sql_main(["article", "main", 'div[role="main"]', ".main-content", "main .content", "body"], _NOISE_SQL,
                        """'<div class="content x">' || inside || '</div>'""")
SQL_MAIN_V1 = _sql_main(["body", "main", 'div[role="main"]', "body", "main", "body"], "{x}", "opened || inside || closed")


NOISE_EXTRA = "<video-player>keep1</video-player><p>keep2</p><video>z</video><object><object>x</object>y</object><p>keep3</p>"
NOISE_LEFT = "<video-player>keep1</video-player><p>keep2</p><p>keep3</p>"


def noise_removed(spark, folder):
    """Every page also has an element whose name begins like a noise element, media, and nested objects."""
    pages = load(spark, folder, "pages").withColumn("html", F.replace("html", F.lit("</body>"), F.lit(NOISE_EXTRA + "</body>")))
    return pages.select("page_id", F.md5(H.drop_noise("html")).alias("quiet_md5"), F.md5(H.drop_comments("html")).alias("open_md5"))


SQL_NOISE = f"""SELECT page_id, md5({_NOISE_SQL.format(x=f"replace(html, '</body>', '{NOISE_LEFT}</body>')")}) AS quiet_md5,
  md5(regexp_replace(replace(html, '</body>', '{NOISE_EXTRA}</body>'), '(?s)<!--.*?-->', '', 'g')) AS open_md5 FROM pages"""


def body_furniture(spark, folder):
    """Whole bodies lose header, footer, aside and navigation, then layout tags."""
    page = F.regexp_replace("html", "</?article>", "")
    page = F.replace(page, F.lit("</body>"), F.lit("<aside><aside>a</aside>b</aside><header>h</header></body>"))
    return load(spark, folder, "pages").select("page_id", F.md5(H.content_html_v2(page)).alias("content_md5"))


SQL_FURNITURE = f"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_extract({_NOISE_SQL.format(x='html')}, '(?s)(<body.*)', 1), '(?s)</body>.*$', '</body>'),
  '(?s)<nav>.*?</nav>|<footer>.*?</footer>', '', 'g'), '</?(div|article)[^>]*>', '', 'g')) AS content_md5 FROM pages"""


def html_to_markdown(spark, folder):
    return rich_pages(spark, folder).select("page_id", H.html_to_md(H.content_html_v2("html")).alias("md"))


def html_to_markdown_v1(spark, folder):
    """Same rules, source line breaks kept; no page break inside of the captured texts matters here."""
    return load(spark, folder, "pages").select(
        "page_id", F.regexp_replace(H.html_to_md(H.content_html_v1(F.regexp_replace("html", "</?article>|</?body>", "")), "v1"), r"\s+", " ").alias("words"))


def _sql_v1_words():
    text = _NOISE_SQL.format(x="html")
    for pattern, replacement in [("</?(article|body)>", ""), (r"(?s)<a href=\"([^\"]*)\">([^<]*)</a>", r"[\2](\1)"), (r"(?s)<li[^>]*>", "\n- "),
                                 (r"(?i)<h1[^>]*>", "\n# "), (r"<(p|br|/p|/h1|html|title|/title|head|/head|/html|nav|/nav|div|/div|ul|/ul|footer|/footer)(\s[^>]*)?>", "\n"),
                                 (r"<[^>]*>", "")]:
        text = f"regexp_replace({text}, {sql_text(pattern)}, {sql_text(replacement)}, 'g')"
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return f"SELECT page_id, trim(regexp_replace({text}, '\\s+', ' ', 'g')) || ' ' AS words FROM pages"


def pages_markdown_v2(spark, folder):
    """Titles, Markdown and status of every page, the whole chain."""
    return C.to_markdown(rich_pages(spark, folder)).select("page_id", "title", "md", "conversion_status")


SQL_PAGES_MD = f"""
WITH {sql_clean(f"SELECT page_id, {SQL_RICH_MD} AS md FROM pages")}
SELECT page_id, trim(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)', 1), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&')) AS title,
  md, 'converted' AS conversion_status FROM cleaned JOIN pages USING (page_id)"""


def conversion_status(spark, folder):
    """Every fourth page empty, script only, or of symbols cleaning takes away."""
    k = F.col("page_id") % 4
    page = F.when(k == 1, "").when(k == 2, "<script>x</script>").when(k == 3, "<body><p>~~ ~~</p></body>").otherwise(F.col("html"))
    pages = load(spark, folder, "pages").select("page_id", "url", page.alias("html"))
    return C.to_markdown(pages).select("page_id", "conversion_status", F.when(
        F.col("conversion_status") != "converted", F.col("md")).alias("replacement"))


SQL_CONVERSION = r"""
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'converted' WHEN page_id % 4 = 3 THEN 'plain_text' ELSE 'failed' END AS conversion_status,
  CASE WHEN page_id % 4 = 3 THEN '~~ ~~' || chr(10) WHEN page_id % 4 <> 0 THEN '## Conversion Failed for ' || url || chr(10) || chr(10) || '_Source: ' || url || '_'
    || chr(10) || chr(10) || 'Content might be malformed or too complex for automated conversion.' || chr(10) END AS replacement FROM pages"""


def images(spark, folder):
    return C.images(rich_pages(spark, folder)).select("page_id", F.col("pos").cast("long").alias("pos"), "src", "alt", "placeholder")


SQL_IMAGES = """
SELECT page_id, unnest([0, 1, 2]) AS pos, unnest(['i' || page_id || '.png', 'data:image/png;base64,AA', '']) AS src, unnest(['Image', 'pic', 'gone']) AS alt,
  unnest([NULL, '[Embedded Image: pic]', '[Missing Image Source: gone]']) AS placeholder FROM pages"""


def html_tables(spark, folder):
    return C.table_cells(rich_pages(spark, folder)).select(
        "page_id", *[F.col(c).cast("long").alias(c) for c in ("table_no", "row_no", "col_no")], "text")


SQL_TABLES = """
SELECT page_id, 0 AS table_no, unnest([0, 0, 1, 1]) AS row_no, unnest([0, 1, 0, 1]) AS col_no, unnest(['A', 'B', page_id::VARCHAR, 'z']) AS text FROM pages"""


def leftover_tables(spark, folder):
    """Table elements left in Markdown text."""
    text = F.concat(F.col("text"), F.lit("\n<TABLE id=a><tr><td><span>x|y</span></td><td>"), F.col("doc_id").cast("string"),
                    F.lit("</td></tr><tr><td> b \n c<td>d</tr></TABLE>\nend"))
    return load(spark, folder, "documents").select("doc_id", H.tables_to_md(F.regexp_replace(text, "(?i)(</?table)", "$1")).alias("md"))


SQL_LEFTOVER = """
SELECT doc_id, text || chr(10) || '| x\\|y | ' || doc_id || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| b c | d |' || chr(10) || 'end' AS md FROM documents"""


def entities(spark, folder):
    """Character references written into every text, once decoded."""
    text = F.concat(F.regexp_replace("text", "&", "&amp;"), F.lit(" &lt;b&gt; &amp;lt; &eacute;&nbsp;&#233;&#x4E2D;&bogus; &#0; &"))
    return load(spark, folder, "documents").select("doc_id", H.decode_entities(text).alias("plain"))


SQL_ENTITIES = "SELECT doc_id, text || ' <b> &lt; é' || chr(160) || 'é中&bogus; &#0; &' AS plain FROM documents"


def frontmatter(spark, folder):
    pages = load(spark, folder, "pages").withColumn("title", F.concat(H.title_v1("html"), F.lit(' "q"')))
    stamp = F.lit("2024-01-01T00:00:00")
    both = pages.select("page_id", M.frontmatter_v1("title", "url", stamp).alias("v1"), M.frontmatter_v2("title", "url", stamp).alias("v2"))
    return both.withColumn("body", M.strip_frontmatter(F.concat("v2", F.lit("body --- x"))))


SQL_FRONT = r"""
WITH t AS (SELECT page_id, url, trim(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)', 1), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&')) || ' "q"' AS title FROM pages)
SELECT page_id, '---' || chr(10) || 'title: "' || replace(title, '"', '''') || '"' || chr(10) || 'source_url: "' || url || '"' || chr(10)
    || 'date: "2024-01-01T00:00:00Z"' || chr(10) || '---' || chr(10) || chr(10) AS v1,
  '---' || chr(10) || 'title: "' || replace(title, '"', '\"') || '"' || chr(10) || 'source_url: ' || url || chr(10)
    || 'date_generated: 2024-01-01T00:00:00' || chr(10) || '---' || chr(10) || chr(10) AS v2,
  'body --- x' AS body FROM t"""

ENTRIES = {
    "page_title": (page_title, SQL_TITLE),
    "main_content_v1": (_main("v1"), SQL_MAIN_V1),
    "main_content_v2": (_main("v2"), SQL_MAIN_V2),
    "main_content_tokens": (main_content_tokens, SQL_MAIN_V2),
    "token_table": (token_table, SQL_TOKENS),
    "noise_removed": (noise_removed, SQL_NOISE),
    "body_furniture": (body_furniture, SQL_FURNITURE),
    "html_to_markdown": (html_to_markdown, f"SELECT page_id, {SQL_RICH_MD} AS md FROM pages"),
    "html_to_markdown_v1": (html_to_markdown_v1, _sql_v1_words()),
    "pages_markdown_v2": (pages_markdown_v2, SQL_PAGES_MD),
    "conversion_status": (conversion_status, SQL_CONVERSION),
    "images": (images, SQL_IMAGES),
    "html_tables": (html_tables, SQL_TABLES),
    "leftover_tables": (leftover_tables, SQL_LEFTOVER),
    "entities": (entities, SQL_ENTITIES),
    "frontmatter": (frontmatter, SQL_FRONT),
}
