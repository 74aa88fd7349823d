"""Markdown cleaning: ordered rules over one text column.

Patterns are written for Java: ``U`` makes classes Unicode, ``d`` makes the line feed the only
line end, ``m`` lets ``^`` and ``$`` match at lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkweave.functions import as_col, has, let, only_if, strip_space
from inkweave.functions import urls
from inkweave.functions.html import (
    ANY_TAG, ATTRS, UNWRAP_V1, _map_closed, _map_pieces, attribute, tables_to_md)
from inkweave.functions.scope import LINE_END

ZERO_WIDTH = "\u200b"
ZERO_WIDTH_MOJIBAKE = "\u00e2\u20ac\u2039"
NO_BREAK_SPACE = "\u00a0"

# Leftover tags taken out of finished Markdown.
LEFTOVER_TAGS = [
    "div", "span", "font", "section", "article", "header", "footer", "aside", "nav", "figure", "figcaption", "details",
    "summary", "button", "form", "input", "label", "textarea", "select", "option", "iframe", "canvas", "map", "area", "audio",
    "video", "source", "track", "embed", "object", "param",
]
# Signs of a decorative image.
DECORATIVE = ["spacer", "pixel", "icon"]
DECORATIVE_MAX_SRC = 10

# The cleaning patterns, (text that must be present, [(pattern, replacement)]).
RULES: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "colon_lines": (":", [(r"(?md)^:+.*$", "")]),
    "class_braces": ("{.", [(r"(?U)\{\.[\w\s.\-⚙]+[^}]*\}", "")]),
    "class_braces_v1": ("{.", [(r"\{\.[^}]*\}", "")]),
    "bracket_braces": ("]{.", [(r"(?U)\]\{\.[\w\s.\-⚙]+[^}]*\}", "]")]),
    "odd_separators": ("-|", [(r"(?md)^-+\|[-|]+$", "")]),
    "empty_attributes": ('=""', [(r'(?U) (class|id|style|data-\w+)=""', "")]),
    "double_brackets": ("[[", [(r"\[\[([^\]]+)\]\]", "[$1]")]),
    "space_before_hash": ("#", [(r"(?mdU)^\s*#", "#")]),
    "hash_at_end": ("#", [(r"(?mdU)#\s*$", "")]),
    "quote_space": (">", [(r"(?mdU)^\s*>\s", "> ")]),
    "attribute_braces": ("{", [(r"(?dU)\{\s*(#[\w\-]+|\.[\w\-]+|[\w\-]+=.+?)\s*\}", "")]),
    "colon_fences": (":::", [
        (r"(?mdU)^:::.+\n([\s\S]*?)\n:::(\s*\n|$)", "$1\n"),
        (r"(?md)^:::.*$", ""),
    ]),
    "code_fences": ("```", [
        (r"(?U)```\s*\{[^}]+\}", "```"),
        (r"(?U)```([\w+\-]+)\s*\n", "```$1\n"),
        (r"(?dU)```\s*(\n|$)", "```$1"),
    ]),
    "comments": ("<!--", [
        (r"(?U)<!--\s*-->", ""),
        (r"(?sU)<!--\s*(.*?)\s*-->", "[Comment: $1]"),
    ]),
    "blank_comments": ("[Comment:", [(r"(?U)\[Comment:\s*\]", "")]),
    "heading_bang": ("!", [(r"(?mdU)^(#+\s+)!\s*", "$1")]),
    "marker_bang": ("!", [(r"(?mdU)^(\s*[*\-]\s*|\s*>\s*|\s*\d+\.\s*)!\s*", "$1")]),
    "line_bang": ("!", [(r"(?mdU)^(?!\s*!\[)!\s*(?=[A-Za-z0-9])", "")]),
    "blank_links": ("](", [(r"(?U)\[\s*\]\([^)]+\)", "")]),
    "symbol_links": ("](", [(r"\[[^a-zA-Z0-9]*?\]\(([^)]+)\)", "<$1>")]),
    "data_images": ("](data:image/", [(r"!\[[^\]]*\]\(data:image/[^;]+;base64,[^)]+\)", "[Embedded Image Removed]")]),
    "newline_runs": ("\n\n\n", [(r"\n{3,}", "\n\n")]),
    "blank_lines": ("\n", [(r"(?mdU)^\s*\n", "")]),
    "repeated_embedded": ("[Embedded Image", [(r"(?U)(\[Embedded Image(?: Removed|: [^\]]*)?\]\s*){2,}", "$1")]),
    "repeated_embedded_v1": ("[Embedded Image", [(r"(?U)(\[Embedded Image(?: Removed)?\]\s*){2,}", "$1")]),
    "repeated_missing": ("[Missing Image", [(r"(?U)(\[Missing Image Source(?: Removed|: [^\]]*)?\]\s*){2,}", "$1")]),
    "repeated_images": ("[Image placeholder]", [(r"(?U)(\[Image placeholder\]\s*){2,}", "$1")]),
    "reference_marks": ("[", [(r"(?U)\s\[\d+\](?!\()", "")]),
    "link_definitions": ("]:", [(r"(?mdU)^\s*\[[^\]]+\]:\s+.*$", "")]),
}


def apply_rule(text: Column | str, name: str) -> Column:
    present, rules = RULES[name]

    def change(value: Column) -> Column:
        for pattern, replacement in rules:
            value = F.regexp_replace(value, pattern, replacement)
        return value

    return only_if(as_col(text), has(present), change)


def drop_invisible(text: Column | str) -> Column:
    return F.replace(F.replace(as_col(text), F.lit(ZERO_WIDTH), F.lit("")), F.lit(ZERO_WIDTH_MOJIBAKE), F.lit(""))


def plain_spaces(text: Column | str) -> Column:
    """Zero-width characters off, no-break spaces to blanks."""
    return F.replace(drop_invisible(text), F.lit(NO_BREAK_SPACE), F.lit(" "))


def trim_lines(text: Column | str) -> Column:
    """Every line end becomes a line feed, every line is trimmed, the last line end goes."""
    rare = [c for c in "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"]

    def any_rare(value: Column) -> Column:
        found = value.contains(rare[0])
        for char in rare[1:]:
            found = found | value.contains(char)
        return found

    unified = only_if(as_col(text), any_rare, lambda v: F.regexp_replace(v, LINE_END, "\n"))
    open_ended = only_if(unified, lambda v: v.endswith("\n"), lambda v: F.left(v, F.length(v) - 1))
    return F.array_join(F.transform(F.split(open_ended, "\n"), strip_space), "\n")


def drop_symbol_lines(text: Column | str) -> Column:
    """Lines of symbols only go; rules, fences and blank lines stay."""
    def keep_rare(line: Column) -> Column:
        return (
            (line == "")
            | line.rlike(r"^(?:-{3,}|_{3,}|\*{3,}|```.*)$")
            | (line.rlike(r"[!#*\[\]()_]") & ~line.rlike(r"(?U)^[^a-zA-Z0-9\s]+$"))
        )
    return F.array_join(F.filter(F.split(as_col(text), "\n"), lambda line: F.when(
        line.rlike("[a-zA-Z0-9]"), True).otherwise(let(strip_space(line), keep_rare))), "\n")


def finish(text: Column | str) -> Column:
    return F.concat(strip_space(as_col(text)), F.lit("\n"))


def strip_leftover_tags(text: Column | str) -> Column:
    """Layout, form and media tags off, empty elements whole."""
    names = "|".join(LEFTOVER_TAGS)

    def change(value: Column) -> Column:
        emptied = F.regexp_replace(value, rf"(?isU)<({names})(?![\w\-]){ATTRS}>\s*</\1\s*>", "")
        return F.regexp_replace(emptied, rf"(?is)</?(?:{names})(?![\w\-]){ATTRS}>", "")

    return only_if(as_col(text), has("<"), change)


def rewrite_images_v2(text: Column | str) -> Column:
    """Image tags left in Markdown."""
    pattern = rf"(?is)^<img(?![\w\-])({ATTRS})>"

    def change(piece: Column) -> Column:
        inside = F.regexp_extract(piece, pattern, 1)
        named = inside.rlike(r"(?i)(?:^|\s)alt\s*=")
        parsed = F.struct(attribute(inside, "src").alias("src"), F.when(
            named, strip_space(attribute(inside, "alt"))).otherwise("Image").alias("alt"))
        shown = let(parsed, lambda img: (
            F.when((img["src"] != "") & ~img["src"].startswith("data:"),
                   F.concat(F.lit("!["), img["alt"], F.lit("]("), img["src"], F.lit(")")))
            .when(img["alt"] != "", F.concat(F.lit("[Image: "), img["alt"], F.lit("]")))
            .otherwise("[Image placeholder]")))
        return F.when(piece.rlike(pattern), F.concat(shown, F.regexp_replace(piece, pattern, ""))).otherwise(piece)

    return only_if(as_col(text), has("<"), lambda v: _map_pieces(v, r"(?i)(?=<img[\s/>])", change))


def rewrite_links_v2(text: Column | str) -> Column:
    """Link tags left in Markdown; scripts give their text only."""
    def build(attrs: Column, inner: Column, _piece: Column) -> Column:
        def render(link: Column) -> Column:
            last = F.regexp_extract(urls.path(link["href"]), r"([^/]*)$", 1)
            label = F.when(link["text"] != "", link["text"]).when(last != "", last).otherwise("link")
            usable = (link["href"] != "") & ~link["href"].startswith("javascript:")
            return F.when(usable, F.concat(F.lit("["), label, F.lit("]("), link["href"], F.lit(")"))).otherwise(
                link["text"])
        return let(F.struct(attribute(attrs, "href").alias("href"),
                            strip_space(F.regexp_replace(inner, ANY_TAG, "")).alias("text")), render)

    return only_if(as_col(text), has("<"), lambda v: _map_closed(v, "a", build))


def drop_empty_links(text: Column | str) -> Column:
    return only_if(as_col(text), has("<"), lambda v: F.regexp_replace(
        v, rf"(?isU)<a(?![\w\-]){ATTRS}>\s*</a\s*>", ""))


def _image_v1(img: Column) -> Column:
    """Markdown for one image tag; NULL drops a decorative one."""
    linked = (img["src"] != "") & ~img["src"].startswith("data:image")
    meaningful = F.length(img["src"]) > DECORATIVE_MAX_SRC
    for word in DECORATIVE:
        meaningful = meaningful & ~F.lower(img["src"]).contains(word)
    return (
        F.when(linked & (img["alt"] != ""), F.concat(F.lit("!["), img["alt"], F.lit("]("), img["src"], F.lit(")")))
        .when(linked & meaningful, F.concat(F.lit("![Image]("), img["src"], F.lit(")")))
        .when(~linked & (img["alt"] != ""), F.concat(F.lit("[Image: "), img["alt"], F.lit("]")))
    )


def rewrite_images_v1(text: Column | str) -> Column:
    """Image tags left in Markdown; an image alone in a link gives the link its text."""
    single = rf"(?isU)^<a(?![\w\-])({ATTRS})>\s*<img(?![\w\-])({ATTRS})>\s*</a>$"
    image = rf"(?is)^<img(?![\w\-])({ATTRS})>"

    def parsed(inside: Column, link: Column | None = None) -> Column:
        fields = [attribute(inside, "src").alias("src"), strip_space(attribute(inside, "alt")).alias("alt")]
        if link is not None:
            fields += [attribute(link, "href").alias("href"), strip_space(attribute(link, "aria-label")).alias("aria"),
                       link.rlike(r"(?i)(?:^|\s)aria-label\s*=").alias("labelled")]
        return F.struct(*fields)

    def linked(row: Column) -> Column:
        shown = F.coalesce(_image_v1(row), F.lit(""))
        words = strip_space(F.when(row["labelled"], row["aria"]).when(row["alt"] != "", row["alt"]).otherwise(shown))
        label = F.when(words != "", words).otherwise("link")
        usable = (row["href"] != "") & ~row["href"].startswith("data:")
        return (
            F.when(usable, F.concat(F.lit("["), label, F.lit("]("), row["href"], F.lit(")")))
            .when((label != "link") | (shown != ""), label)
            .otherwise("")
        )

    def change(value: Column) -> Column:
        in_links = _map_pieces(value, r"(?i)(?=<a[\s>])|(?<=</a>)", lambda p: F.when(p.rlike(single), let(parsed(
            F.regexp_extract(p, single, 2), F.regexp_extract(p, single, 1)), linked)).otherwise(p))
        return _map_pieces(in_links, r"(?i)(?=<img[\s/>])", lambda p: F.when(p.rlike(image), F.concat(
            F.coalesce(let(parsed(F.regexp_extract(p, image, 1)), _image_v1), F.lit("")),
            F.regexp_replace(p, image, ""))).otherwise(p))

    return only_if(as_col(text), has("<"), change)


def unwrap_v1(text: Column | str) -> Column:
    return only_if(as_col(text), has("<"), lambda v: F.regexp_replace(
        v, rf"(?is)</?(?:{'|'.join(UNWRAP_V1)})(?![\w\-]){ATTRS}>", ""))


Step = Callable[[Column], Column]


def _rule(name: str) -> Step:
    return lambda text: apply_rule(text, name)


ARTIFACTS_V2: list[Step] = [_rule(n) for n in (
    "colon_lines", "class_braces", "bracket_braces", "odd_separators", "empty_attributes", "double_brackets")]
ARTIFACTS_V1: list[Step] = [_rule(n) for n in ("colon_lines", "class_braces_v1", "odd_separators")]

PRETTIFY_V2: list[Step] = [
    plain_spaces, *[_rule(n) for n in ("space_before_hash", "hash_at_end", "quote_space")],
    strip_leftover_tags, rewrite_images_v2, rewrite_links_v2,
    *[_rule(n) for n in (
        "attribute_braces", "bracket_braces", "colon_fences", "code_fences", "comments", "blank_comments", "heading_bang",
        "marker_bang", "line_bang", "blank_links", "symbol_links", "data_images", "newline_runs")],
    trim_lines, _rule("newline_runs"), drop_invisible,
    *[_rule(n) for n in ("repeated_embedded", "repeated_missing", "repeated_images", "reference_marks", "link_definitions")],
    drop_symbol_lines, _rule("newline_runs"), finish,
]
PRETTIFY_V1: list[Step] = [
    drop_invisible, rewrite_images_v1, unwrap_v1, drop_empty_links,
    *[_rule(n) for n in ("data_images", "newline_runs", "blank_lines")],
    drop_invisible, _rule("repeated_embedded_v1"), finish,
]


def chain(text: Column | str, steps: list[Step]) -> Column:
    value = as_col(text)
    for step in steps:
        value = step(value)
    return value


def _tables(text: Column) -> Column:
    return only_if(text, has("<"), tables_to_md)


def clean_v2(text: Column | str) -> Column:
    return chain(text, [_tables, *ARTIFACTS_V2, *PRETTIFY_V2])


def clean_v1(text: Column | str) -> Column:
    return chain(text, [_tables, *ARTIFACTS_V1, *PRETTIFY_V1])


def frontmatter_v2(title: Column | str, url: Column | str, generated: Column | str) -> Column:
    escaped = F.replace(as_col(title), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('---\ntitle: "'), escaped, F.lit('"\nsource_url: '), as_col(url),
                    F.lit("\ndate_generated: "), as_col(generated), F.lit("\n---\n\n"))


def frontmatter_v1(title: Column | str, url: Column | str, generated: Column | str) -> Column:
    escaped = F.replace(as_col(title), F.lit('"'), F.lit("'"))
    return F.concat(F.lit('---\ntitle: "'), escaped, F.lit('"\nsource_url: "'), as_col(url),
                    F.lit('"\ndate: "'), as_col(generated), F.lit('Z"\n---\n\n'))


def strip_frontmatter(text: Column | str) -> Column:
    """Only at the very start, up to the next rule anywhere."""
    return F.regexp_replace(as_col(text), r"(?U)\A---\s*[\s\S]*?---\s*", "")
