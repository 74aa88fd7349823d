"""Page content as column expressions: title, main element, clean-up, Markdown conversion.

There is no tree. Text is cut at the tags a rule cares about (a split with look-ahead), the cuts
are mapped or folded as an array inside the row, and joined again. Nothing is shuffled, and each
value is used once per rule, so expressions stay linear in the number of rules.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkweave.functions import as_col, blank_to_null, has, let, only_if, strip_space
from inkweave.functions import urls

# Inside of a tag; a ">" in a quoted attribute does not end it. Possessive, so it cannot recurse deeply.
ATTRS = r"""[^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+"""
ANY_TAG = rf"</?[A-Za-z]{ATTRS}>"

# Elements that never hold content.
NOISE_PAIRED = ["script", "style", "svg", "noscript", "iframe", "object", "map", "canvas", "audio", "video"]
NOISE_VOID = ["meta", "link", "embed", "param", "source", "track", "area"]
# Elements taken off a whole body.
PAGE_FURNITURE = ["header", "footer", "aside", "nav"]
# Layout elements whose content stays.
UNWRAP_V2 = ["div", "span", "font", "section", "article", "figure", "figcaption", "details", "summary"]
UNWRAP_V1 = ["div", "span", "font", "section", "article", "aside", "header", "footer", "main",
             "figure", "figcaption"]
# Where the main content is looked for, first hit wins.
MAIN_SELECTORS_V2 = [
    "div.theme-doc-markdown.markdown", "article.md-content__inner", "main .content", 'div[role="main"]',
    "main", "article", "#content", ".content", "#main-content", ".main-content", "body",
]
MAIN_SELECTORS_V1 = [
    "div.theme-doc-markdown.markdown", "article.md-content__inner", 'div[role="main"]', "main", "body",
]

_COMMON_ENTITIES = ["amp", "lt", "gt", "quot", "nbsp"]
# Private-use characters hold code-block white space and quotation limits while tags are rewritten.
_LINE, _BLANK, _TAB = "\ue00a", "\ue00b", "\ue00c"
_QUOTE_IN, _QUOTE_OUT = "\ue00d", "\ue00e"


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in a tag's inside; empty when absent."""
    # one group for the three ways to write a value: what stands before it tells which
    value = r"""(?:["']|(?=[^\s"'>]))((?<=")[^"]*(?=")|(?<=')[^']*(?=')|(?<!["'])[^\s"'>]+)"""
    return F.regexp_extract(tag, rf"""(?is)(?:^|[\s"'/]){name}\s*=\s*{value}""", 1)


def decode_entities(text: Column | str) -> Column:
    """Character references, each decoded once."""
    names = _COMMON_ENTITIES + sorted(set(name2codepoint) - set(_COMMON_ENTITIES))
    listed = "\x1e".join(f"{n}\x1f{chr(name2codepoint[n])}" for n in names)
    table = F.str_to_map(F.lit(listed), F.lit("\x1e"), F.lit("\x1f"))

    def from_code(code: Column) -> Column:
        return F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF),
                      F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    def one(piece: Column, index: Column) -> Column:
        ref = F.regexp_extract(piece, r"^(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);", 1)
        # any number of digits; without leading zeros a longer one is no code point
        digits = F.regexp_replace(ref, "^#[xX]?0*", "")
        char = (
            F.when(ref == "", F.lit(None).cast("string"))
            .when(ref.startswith("#") & (F.length(digits) > 7), F.lit(None).cast("string"))
            .when(ref.rlike("^#[xX]"), from_code(F.conv(digits, 16, 10).cast("long")))
            .when(ref.startswith("#"), from_code(digits.try_cast("long")))
            .otherwise(F.try_element_at(table, ref))
        )
        plain = F.concat(F.lit("&"), piece)
        return F.when(index == 0, piece).otherwise(F.coalesce(
            F.concat(char, F.regexp_replace(piece, r"^[^;]*;", "")), plain))

    return only_if(as_col(text), has("&"), lambda value: F.array_join(F.transform(F.split(value, "&"), one), ""))


def title(html: Column | str) -> Column:
    """Text of the first title element; NULL when missing or blank."""
    inner = F.regexp_extract(as_col(html), r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    return blank_to_null(strip_space(decode_entities(inner)))


def title_v1(html: Column | str) -> Column:
    return F.coalesce(title(html), F.lit("Untitled"))


def title_v2(html: Column | str, url: Column | str) -> Column:
    last = blank_to_null(F.regexp_extract(urls.path(url), r"([^/]*)$", 1))
    return F.coalesce(title(html), last, urls.host(url), F.lit("Untitled Page"))


def drop_noise(html: Column | str) -> Column:
    """Comments, scripts, styles, media and other elements without content; nested objects to their own end."""
    void, end = "|".join(NOISE_VOID), r"(?![\w\-])"

    def cut(text: Column, paired: list[str]) -> Column:
        names = "|".join(paired)
        return F.regexp_replace(text, rf"(?is)<!--.*?-->|<({names}){end}{ATTRS}>.*?</\1\s*>|</?(?:{void}|{names}){end}{ATTRS}>", "")

    def nested(text: Column) -> Column:
        # an object that is never closed loses its tag only
        balanced = F.regexp_count(text, F.lit(rf"(?is)<object{end}")) == F.regexp_count(text, F.lit(r"(?is)</object\s*>"))
        return F.when(balanced, drop_elements(text, "object")).otherwise(cut(text, ["object"]))

    return only_if(cut(as_col(html), [n for n in NOISE_PAIRED if n != "object"]), lambda t: t.rlike(rf"(?i)</?object{end}"), nested)


def drop_comments(html: Column | str) -> Column:
    return F.regexp_replace(as_col(html), r"(?s)<!--.*?-->", "")


def unwrap(html: Column | str, tags: list[str]) -> Column:
    return F.regexp_replace(as_col(html), rf"(?is)</?(?:{'|'.join(tags)})(?![\w\-]){ATTRS}>", "")


def _cut_at(tag: Column | str) -> Column:
    name = F.lit(tag) if isinstance(tag, str) else tag
    return F.concat(F.lit("(?i)(?=</?"), name, F.lit(r"[\s/>])"))


def _step(piece: Column) -> Column:
    """Depth change of a piece that starts at a tag."""
    return (
        F.when(piece.startswith("</"), -1)
        .when(piece.rlike(r"(?s)^<[^>]*/>"), 0)
        .otherwise(1)
    )


def element_at_start(text: Column, tag: Column) -> Column:
    """The element ``text`` starts with, up to its own closing tag."""
    def walk(pieces: Column) -> Column:
        state = F.aggregate(
            pieces,
            F.struct(F.lit(0).alias("depth"), F.lit(0).alias("taken"), F.lit(False).alias("closed")),
            lambda acc, piece: F.when(acc["closed"], acc).otherwise(F.struct(
                (acc["depth"] + _step(piece)).alias("depth"),
                (acc["taken"] + 1).alias("taken"),
                (acc["depth"] + _step(piece) <= 0).alias("closed"))),
        )

        def rebuild(end: Column) -> Column:
            body = F.array_join(F.slice(pieces, 1, F.greatest(end["taken"] - 1, F.lit(0))), "")
            last = F.regexp_extract(F.element_at(pieces, end["taken"]), r"(?s)^(<[^>]*>)", 1)
            return F.when(end["closed"], F.concat(body, last)).otherwise(F.array_join(pieces, ""))

        return let(state, rebuild)

    return let(F.split(text, _cut_at(tag)), walk)


def drop_elements(html: Column | str, tag: str) -> Column:
    """Remove every ``tag`` element with its content, nested ones included."""
    def walk(pieces: Column) -> Column:
        state = F.aggregate(
            pieces,
            F.struct(F.lit(0).alias("depth"), F.expr("cast(array() as array<string>)").alias("kept")),
            lambda acc, piece: F.when(
                ~piece.rlike(rf"(?i)^</?{tag}[\s/>]"),
                F.struct(acc["depth"].alias("depth"), F.concat(acc["kept"], F.array(piece)).alias("kept")),
            ).otherwise(let(
                F.greatest(acc["depth"] + _step(piece), F.lit(0)),
                lambda depth: F.struct(depth.alias("depth"), F.concat(acc["kept"], F.array(
                    F.when(depth == 0, F.regexp_replace(piece, r"(?s)^<[^>]*>", "")).otherwise(""))).alias("kept")),
            )),
        )
        return F.array_join(state["kept"], "")

    return let(F.split(as_col(html), _cut_at(tag)), walk)


def _selector_pattern(selector: str) -> str:
    """Opening tag a simple selector matches; group 2 is the element name."""
    def holds(attr: str, token: str) -> str:
        return rf"""(?=[^>]*?\s{attr}\s*=\s*["']?(?:[^"'>]*\s)?(?-i:{token})(?=[\s"'/>]))"""

    if selector.startswith("#"):
        name, checks = r"[A-Za-z][A-Za-z0-9]*", [
            rf"""(?=[^>]*?\sid\s*=\s*["']?(?-i:{selector[1:]})(?=[\s"'/>]))"""]
    elif "[" in selector:
        name, rest = selector.split("[", 1)
        key, value = rest.rstrip("]").split("=")
        unquoted = value.strip('"')
        checks = [rf"""(?=[^>]*?\s{key}\s*=\s*["']?(?-i:{unquoted})(?=["'\s/>]))"""]
    else:
        name, *classes = selector.split(".")
        checks = [holds("class", c) for c in classes]
        name = name or r"[A-Za-z][A-Za-z0-9]*"
    return rf"(?is)(<({name})(?![\w\-]){''.join(checks)}.*)$"


def _selector_word(selector: str) -> str:
    """Case-sensitive text a page must hold for the selector to hit; empty when there is none."""
    last = selector.split(" ")[-1]
    if "[" in last:
        return last.split("=")[1].rstrip("]").strip('"')
    return last.lstrip("#").split(".")[-1] if ("." in last or "#" in last) else ""


def _find(html: Column, selector: str) -> Column:
    """struct(selector, rest, tag) from the first opening tag that matches, or NULL."""
    pattern = _selector_pattern(selector.split(" ")[-1])

    def opened(text: Column) -> Column:
        match = F.struct(F.lit(selector).alias("selector"), F.regexp_extract(text, pattern, 1).alias("rest"),
                         F.regexp_extract(text, pattern, 2).alias("tag"))
        return let(match, lambda m: F.when(m["tag"] != "", m))

    if " " not in selector:
        return opened(html)
    outer = selector.split(" ")[0]
    insides = F.transform(
        F.filter(F.split(html, rf"(?i)(?=<{outer}[\s/>])"), lambda p: p.rlike(rf"(?i)^<{outer}[\s/>]")),
        lambda p: F.regexp_replace(element_at_start(p, F.lit(outer)), r"(?s)^<[^>]*>", ""))
    return let(F.get(F.filter(insides, lambda p: p.rlike(pattern)), F.lit(0)), opened)


def main_content(html: Column | str, profile: str = "v2") -> Column:
    """struct(selector, html): the first selector that hits; the whole page when none does.

    ``main .x`` looks inside main elements.
    """
    selectors = MAIN_SELECTORS_V2 if profile == "v2" else MAIN_SELECTORS_V1

    def choose(page: Column) -> Column:
        hits = []
        for selector in selectors:
            word, hit = _selector_word(selector), _find(page, selector)
            hits.append(F.when(page.contains(word), hit) if word else hit)
        whole = F.struct(F.lit(None).cast("string").alias("selector"), page.alias("rest"), F.lit("").alias("tag"))
        return let(F.coalesce(*hits, whole), lambda hit: F.struct(
            hit["selector"].alias("selector"),
            F.when(hit["tag"] == "", hit["rest"]).otherwise(element_at_start(hit["rest"], hit["tag"])).alias("html")))

    return let(as_col(html), choose)


def content_html_v2(html: Column | str) -> Column:
    """Main content without noise, ready to convert. Page furniture goes only off a whole body."""
    def trim_body(chosen: Column) -> Column:
        body = chosen["html"]
        for tag in PAGE_FURNITURE:
            body = drop_elements(body, tag)
        whole = chosen["selector"].isNull() | (chosen["selector"] == "body")
        return F.when(whole, body).otherwise(chosen["html"])

    return unwrap(let(main_content(drop_noise(html), "v2"), trim_body), UNWRAP_V2)


def content_html_v1(html: Column | str) -> Column:
    return let(main_content(html, "v1"), lambda chosen: drop_noise(chosen["html"]))


def _map_pieces(text: Column, cut: str, change: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(F.split(text, cut), change), "")


def _map_closed(text: Column, tags: str, build: Callable[[Column, Column, Column], Column]) -> Column:
    """Rewrite each innermost ``tags`` element from its attributes and its text."""
    close, opened = rf"(?i)</(?:{tags})\s*>", rf"(?is)^(.*)<(?:{tags})(?![\w\-])({ATTRS})>(.*)$"

    def each(pieces: Column) -> Column:
        return F.array_join(F.transform(pieces, lambda p, i: F.when(
            (i < F.size(pieces) - 1) & p.rlike(opened),
            F.concat(F.regexp_extract(p, opened, 1),
                     build(F.regexp_extract(p, opened, 2), F.regexp_extract(p, opened, 3), p)),
        ).otherwise(p)), "")

    return let(F.split(text, close), each)


def image_placeholder(src: Column, alt: Column) -> Column:
    """Text that stands in for an image without a usable source; NULL for a usable one."""
    return (
        F.when(src.startswith("data:image"), F.when(alt != "", F.concat(
            F.lit("[Embedded Image: "), alt, F.lit("]"))).otherwise("[Embedded Image Removed]"))
        .when(src == "", F.when(alt != "", F.concat(
            F.lit("[Missing Image Source: "), alt, F.lit("]"))).otherwise("[Missing Image Source]"))
    )


def _titled(target: Column, title_text: Column) -> Column:
    return F.when(title_text != "", F.concat(target, F.lit(' "'), title_text, F.lit('"'))).otherwise(target)


def _images_to_md(text: Column, profile: str) -> Column:
    pattern = rf"(?is)^<img(?![\w\-])({ATTRS})>"

    def change(piece: Column) -> Column:
        def render(img: Column) -> Column:
            alt = F.when(img["alt"] == "", "Image").otherwise(img["alt"]) if profile == "v2" else img["alt"]
            shown = F.concat(F.lit("!["), alt, F.lit("]("), _titled(img["src"], img["title"]), F.lit(")"))
            return F.coalesce(image_placeholder(img["src"], img["alt"]), shown) if profile == "v2" else shown

        inside = F.regexp_extract(piece, pattern, 1)
        parsed = F.struct(attribute(inside, "src").alias("src"), strip_space(attribute(inside, "alt")).alias("alt"),
                          attribute(inside, "title").alias("title"))
        return F.when(piece.rlike(pattern), F.concat(
            let(parsed, render), F.regexp_replace(piece, pattern, ""))).otherwise(piece)

    return _map_pieces(text, r"(?i)(?=<img[\s/>])", change)


def _fence(piece: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(piece, r"(?i)<br\s*/?>", "\n"), rf"{ANY_TAG}", "")
    body = F.regexp_replace(F.regexp_replace(body, r"^\r?\n", ""), r"\s+$", "")
    kept = F.translate(F.replace(body, F.lit("\r\n"), F.lit("\n")), "\n \t", _LINE + _BLANK + _TAB)
    return F.concat(F.lit(f"\n\n```{_LINE}"), kept, F.lit(f"{_LINE}```\n\n"))


def _emphasis(mark: str) -> Callable[[Column, Column, Column], Column]:
    def build(_attrs: Column, text: Column, _piece: Column) -> Column:
        lead, tail = F.regexp_extract(text, r"^(\s*)", 1), F.regexp_extract(text, r"(?s)\S(\s*)$", 1)
        bare = strip_space(text)
        return F.when(bare == "", text).otherwise(F.concat(lead, F.lit(mark), bare, F.lit(mark), tail))
    return build


def _link(attrs: Column, text: Column, _piece: Column) -> Column:
    def render(link: Column) -> Column:
        return F.when(link["href"] == "", link["text"]).otherwise(F.concat(
            F.lit("["), link["text"], F.lit("]("), _titled(link["href"], link["title"]), F.lit(")")))
    return let(F.struct(strip_space(attribute(attrs, "href")).alias("href"),
                        attribute(attrs, "title").alias("title"), strip_space(text).alias("text")), render)


def table_rows(table: Column) -> Column:
    """array<array<string>>: cell texts of one table, tags off, white space collapsed."""
    cell = r"(?is)<t[hd](?![\w\-])[^>]*>(.*?)(?=</t[hd]\s*>|<t[hd](?![\w\-])|$)"
    rows = F.filter(F.split(table, r"(?i)(?=<tr[\s/>])"), lambda r: r.rlike(r"(?i)^<tr[\s/>]"))

    def clean(text: Column) -> Column:
        return strip_space(F.regexp_replace(F.regexp_replace(text, ANY_TAG, ""), r"(?U)\s+", " "))

    return F.filter(F.transform(rows, lambda r: F.transform(F.regexp_extract_all(
        F.regexp_replace(r, r"(?i)</tr\s*>|</?t(?:able|body|head|foot)(?![\w\-])[^>]*>", ""), F.lit(cell), 1), clean)),
        lambda cells: F.size(cells) > 0)


def table_to_md(table: Column) -> Column:
    """Pipe table; the first row is the header."""
    def line(cells: Column) -> Column:
        escaped = F.transform(cells, lambda c: F.replace(c, F.lit("|"), F.lit("\\|")))
        return F.concat(F.lit("| "), F.array_join(escaped, " | "), F.lit(" |"))

    def render(rows: Column) -> Column:
        rule = line(F.transform(F.element_at(rows, 1), lambda _c: F.lit("---")))
        return F.when(F.size(rows) == 0, "").otherwise(F.array_join(F.concat(
            F.array(line(F.element_at(rows, 1)), rule),
            F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n"))

    return let(table_rows(table), render)


def tables_to_md(text: Column | str) -> Column:
    """Replace every table element in a text by its pipe table."""
    return _map_pieces(as_col(text), r"(?i)(?=<table[\s/>])|(?<=</table>)", lambda p: F.when(
        p.rlike(r"(?is)^<table[\s/>].*</table>$"), table_to_md(p)).otherwise(p))


def _lists_to_md(text: Column) -> Column:
    """Bullets and running numbers, indented by nesting depth."""
    def fold(acc: Column, piece: Column) -> Column:
        rest = F.regexp_replace(piece, r"(?s)^<[^>]*>\s*", "")
        stack, depth = acc["stack"], F.size(acc["stack"])
        top = F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit(0))
        below = F.slice(stack, 1, F.greatest(depth - 1, F.lit(0)))
        gap = F.when(depth == 0, "\n\n").otherwise("")
        marker = F.concat(
            F.lit("\n"), F.repeat(F.lit("  "), F.greatest(depth - 1, F.lit(0))),
            F.when(top == 0, "- ").otherwise(F.concat(top.cast("string"), F.lit(". "))),
            F.regexp_replace(rest, r"(?i)^\s*(?:<p\b[^>]*>\s*)?", ""))

        def put(new_stack: Column, out: Column) -> Column:
            return F.struct(new_stack.alias("stack"), F.concat(acc["out"], F.array(out)).alias("out"))

        return (
            F.when(piece.rlike(r"(?i)^<ul[\s/>]"), put(F.concat(stack, F.array(F.lit(0))), F.concat(gap, rest)))
            .when(piece.rlike(r"(?i)^<ol[\s/>]"), put(F.concat(stack, F.array(F.lit(1))), F.concat(gap, rest)))
            .when(piece.rlike(r"(?i)^<li[\s/>]"), put(
                F.when(top > 0, F.concat(below, F.array(top + 1))).otherwise(stack), marker))
            .when(piece.rlike(r"(?i)^</[uo]l"), put(
                below, F.concat(F.when(depth <= 1, "\n\n").otherwise(""), rest)))
            .when(piece.rlike(r"(?i)^</li"), put(stack, rest))
            .otherwise(put(stack, piece))
        )

    start = F.struct(F.expr("cast(array() as array<int>)").alias("stack"),
                     F.expr("cast(array() as array<string>)").alias("out"))
    return F.array_join(F.aggregate(F.split(text, r"(?i)(?=</?(?:ul|ol|li)[\s/>])"), start, fold)["out"], "")


def _quotes_to_md(text: Column) -> Column:
    """Prefix quoted lines once per open quotation."""
    def each(parts: Column) -> Column:
        def level(index: Column) -> Column:
            return F.aggregate(F.slice(parts, 1, index + 1), F.lit(0), lambda acc, p: F.greatest(
                acc + F.when(p.startswith(_QUOTE_IN), 1).when(p.startswith(_QUOTE_OUT), -1).otherwise(0), F.lit(0)))

        def prefix(part: Column, index: Column) -> Column:
            bare = F.replace(F.replace(part, F.lit(_QUOTE_IN), F.lit("")), F.lit(_QUOTE_OUT), F.lit(""))
            return let(level(index), lambda depth: F.when(depth == 0, bare).otherwise(F.concat(
                F.lit("\n\n"), F.regexp_replace(F.regexp_replace(strip_space(bare), r"\s*\n\s*", "\n\n"),
                                                r"(?m)^", F.repeat(F.lit("> "), depth)), F.lit("\n\n"))))
        return F.array_join(F.transform(parts, prefix), "")

    return let(F.split(text, f"(?=[{_QUOTE_IN}{_QUOTE_OUT}])"), each)


def html_to_md(html: Column | str, profile: str = "v2") -> Column:
    """Ordered conversion rules. The command-line profile keeps source line breaks.

    Rules for elements the page does not have are skipped, after one look at its lower-case text.
    """
    words = {"pre": "<pre", "table": "<table", "img": "<img", "a": "</a", "list": "<li", "quote": "<blockquote",
             "br": "<br", "hr": "<hr", **{f"h{n}": f"<h{n}" for n in range(1, 7)}}
    words |= {n: f"</{n}" for n in ("em", "i", "strong", "b", "code", "tt", "kbd", "samp")}

    def convert(page: Column) -> Column:
        lowered = let(F.lower(page), lambda low: F.struct(*[low.contains(w).alias(n) for n, w in words.items()]))
        return let(lowered, lambda seen: rules(page, seen))

    def rules(text: Column, seen: Column) -> Column:
        def step(value: Column, test: Column, change: Callable[[Column], Column]) -> Column:
            return let(value, lambda v: F.when(test, change(v)).otherwise(v))

        def swap(pattern: str, replacement: str) -> Callable[[Column], Column]:
            return lambda v: F.regexp_replace(v, pattern, replacement)

        def element(name: str) -> str:
            return rf"(?i)\s*<{name}(?![\w\-]){ATTRS}>\s*"

        text = step(text, seen["pre"], lambda v: _map_pieces(v, r"(?i)(?=<pre[\s>])|(?<=</pre>)", lambda p: F.when(
            p.rlike(r"(?is)^<pre[\s>].*</pre>$"), _fence(p)).otherwise(p)))
        if profile == "v2":
            text = F.regexp_replace(text, r"[ \t\r\n\f]+", " ")
        else:
            text = F.regexp_replace(F.regexp_replace(text, r"[ \t\f]*\r?\n[ \t\r\n\f]*", "\n"), r"[ \t\f]+", " ")
        text = step(text, seen["pre"], swap(f" ?```({_LINE}[^`]*{_LINE})``` ?", "\n\n```$1```\n\n"))
        text = step(text, seen["img"], lambda v: _images_to_md(v, profile))
        text = step(text, seen["code"] | seen["tt"] | seen["kbd"] | seen["samp"], lambda v: _map_closed(
            v, "code|tt|kbd|samp", lambda _a, t, _p: F.concat(F.lit("`"), strip_space(t), F.lit("`"))))
        text = step(text, seen["em"] | seen["i"], lambda v: _map_closed(v, "em|i", _emphasis("*")))
        text = step(text, seen["strong"] | seen["b"], lambda v: _map_closed(v, "strong|b", _emphasis("**")))
        text = step(text, seen["a"], lambda v: _map_closed(v, "a", _link))
        text = step(text, seen["table"], lambda v: _map_pieces(
            v, r"(?i)(?=<table[\s/>])|(?<=</table>)", lambda p: F.when(
                p.rlike(r"(?is)^<table[\s/>].*</table>$"),
                F.concat(F.lit("\n\n"), table_to_md(p), F.lit("\n\n"))).otherwise(p)))
        text = step(text, seen["list"], _lists_to_md)
        text = step(text, seen["br"], swap(rf"(?i) *<br(?![\w\-]){ATTRS}> *\n?", "  \n"))
        text = step(text, seen["hr"], swap(element("hr"), "\n\n---\n\n"))
        for level in range(1, 7):
            text = step(text, seen[f"h{level}"], swap(element(f"h{level}"), f"\n\n{'#' * level} "))
        text = F.regexp_replace(text, r"(?i)\s*</h[1-6]\s*>\s*", "\n\n")
        text = step(text, seen["quote"], lambda v: F.regexp_replace(F.regexp_replace(
            v, element("blockquote"), _QUOTE_IN), r"(?i)\s*</blockquote\s*>\s*", _QUOTE_OUT))
        text = F.regexp_replace(
            text, r"(?i)\s*</?(?:p|div|section|article|main|body|html|head|header|footer|nav|aside|title"
                  rf"|dl|dt|dd|form|fieldset|address)(?![\w\-]){ATTRS}>\s*", "\n\n")
        text = step(text, seen["quote"], _quotes_to_md)
        text = only_if(text, has("<"), swap(rf"(?s){ANY_TAG}|<![A-Za-z][^>]*>", ""))
        text = only_if(text, has("&"), decode_entities)
        # a replacement of one sign is a byte search, F.translate looks every character up
        text = step(text, seen["pre"], lambda v: F.replace(F.replace(F.replace(
            v, F.lit(_LINE), F.lit("\n")), F.lit(_BLANK), F.lit(" ")), F.lit(_TAB), F.lit("\t")))
        text = only_if(text, has("\n\n\n"), swap(r"\n{3,}", "\n\n"))
        return F.concat(F.btrim(text, F.lit(" \t\n\r\f")), F.lit("\n"))

    return let(as_col(html), convert)


def plain_text(html: Column | str) -> Column:
    """All tags off: what is left when conversion gives nothing."""
    bare = F.regexp_replace(drop_noise(html), ANY_TAG, " ")
    return strip_space(F.regexp_replace(decode_entities(bare), r"(?U)\s+", " "))
