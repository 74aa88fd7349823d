"""Heading text, slugs and anchors."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import types as T

from inkweave.functions import as_col, blank_to_null, has, let, only_if, strip_space
from inkweave.functions.scope import LINE_END


def _latin_marks() -> tuple[str, str]:
    """Letters below U+0250 and U+1E00-1EFF whose decomposition is one base letter plus marks."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        bare = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if bare != chr(code) and len(bare) == 1:
            source.append(chr(code))
            target.append(bare)
    return "".join(source), "".join(target)


LATIN_FROM, LATIN_TO = _latin_marks()
# Patterns for ASCII text name each character: such a class is a table, a class of ranges or of all scripts is not.
_ASCII_SIGNS = "[" + "".join(f"\\x{c:02x}" for c in range(128) if not (chr(c).isalnum() or chr(c) in "_- \t\n\x0b\x0c\r")) + "]+"
_ASCII_BREAKS = "\t\n\x0b\x0c\r"
_RARE_LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def _wide(text: Column) -> Column:
    """Not ASCII: more bytes than characters."""
    return F.octet_length(text) != F.length(text)


def _any_of(signs: str) -> Callable[[Column], Column]:
    """A byte search for each sign."""
    return lambda text: reduce(lambda hit, sign: hit | text.contains(sign), signs[1:], text.contains(signs[0]))


def _filled(text: Column, default: Column) -> Column:
    """``default`` for NULL and the empty text. The text is worked out once, which ``nullif`` does not do inside an array."""
    return let(text, lambda t: F.when(t != "", t).otherwise(default))


def _bare(text: str | None) -> str | None:
    return None if text is None else "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


@F.pandas_udf(T.StringType())
def _strip_marks_any(texts: pd.Series) -> pd.Series:
    """Full Unicode decomposition, which no built-in function offers."""
    return texts.map(_bare)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _strip_marks_each(texts: pd.Series) -> pd.Series:
    return texts.map(lambda many: None if many is None else [_bare(t) for t in many])


def strip_marks(text: Column | str, full_unicode: bool = False) -> Column:
    """Diacritics off. Latin letters stay in the JVM; other scripts need ``full_unicode``."""
    if full_unicode:
        return _strip_marks_any(as_col(text))
    # ASCII text has no marks
    plain = only_if(as_col(text), _wide, lambda t: F.translate(t, LATIN_FROM, LATIN_TO))
    return only_if(plain, _wide, lambda t: F.regexp_replace(t, r"\p{Mn}+", ""))


def _ascii_dashed(text: Column) -> Column:
    words = F.replace(F.regexp_replace(text, _ASCII_SIGNS, ""), F.lit(" "), F.lit("-"))
    joined = only_if(words, _any_of(_ASCII_BREAKS), lambda t: F.regexp_replace(t, f"[{_ASCII_BREAKS}]", "-"))
    return only_if(joined, has("--"), lambda t: F.regexp_replace(t, "--+", "-"))


def _dashed(text: Column) -> Column:
    dashes = let(text, lambda t: F.when(_wide(t), F.regexp_replace(
        F.regexp_replace(t, r"(?U)[^\w\s\-]", ""), r"(?U)[\s\-]+", "-")).otherwise(_ascii_dashed(t)))
    return F.btrim(dashes, F.lit("-"))


def _slug(bare: Column) -> Column:
    return _filled(_dashed(F.lower(bare)), F.lit("section"))


def slug(text: Column | str, full_unicode: bool = False) -> Column:
    return _slug(strip_marks(text, full_unicode))


def slug_each(texts: Column | str, full_unicode: bool = False) -> Column:
    """:func:`slug` of every text of an array."""
    if full_unicode:
        return F.transform(_strip_marks_each(as_col(texts)), _slug)
    return F.transform(as_col(texts), lambda t: slug(t))


def file_anchor(filename: Column | str, index: Column | str, full_unicode: bool = False) -> Column:
    stem = F.lower(F.regexp_replace(as_col(filename), r"(?<=.)\.[^./]*$", ""))
    return _filled(_dashed(strip_marks(stem, full_unicode)), F.concat(F.lit("file-"), as_col(index).cast("string")))


def repeated(names: Column | str) -> Column:
    """Whether an array holds a name twice."""
    return F.size(F.array_distinct(as_col(names))) < F.size(as_col(names))


def counted(names: Column | str) -> Column:
    """An array of names whose second ``a`` is ``a-1``, the third ``a-2``. Sorting brings equal names together."""
    def by_run(rows: Column) -> Column:
        starts = F.filter(F.transform(rows, lambda row, n: F.when((n == 0) | (F.get(rows, n - 1)["name"] != row["name"]), n)),
                          lambda n: n.isNotNull())
        return let(starts, lambda firsts: F.flatten(F.transform(firsts, lambda first, k: F.transform(
            F.sequence(first, F.coalesce(F.get(firsts, k + 1), F.size(rows)) - 1),
            lambda n: numbered(F.get(rows, n), n - first)))))

    def numbered(row: Column, seen: Column) -> Column:
        return F.struct(row["at"].alias("at"), F.when(seen == 0, row["name"]).otherwise(
            F.concat(row["name"], F.lit("-"), seen.cast("string"))).alias("name"))

    together = F.sort_array(F.transform(as_col(names), lambda name, n: F.struct(name.alias("name"), n.alias("at"))))
    return F.transform(F.sort_array(let(together, by_run)), lambda row: row["name"])


@F.udf(returnType=T.ArrayType(T.StringType()), useArrow=True)
def _unique(names):
    """Needed only where a counted name meets another heading's own name; linear by the set of taken names."""
    if names is None:
        return None
    taken, tried, out = set(), {}, []
    for stem in names:
        name = stem
        if name in taken:
            n = tried.get(stem, 1)
            while f"{stem}-{n}" in taken:
                n += 1
            name, tried[stem] = f"{stem}-{n}", n + 1
        taken.add(name)
        out.append(name)
    return out


def unique_slugs(names: Column | str) -> Column:
    """Sequential uniqueness in one file: a taken slug gets the first free number.

    ``a, a, a-1`` gives ``a, a-1, a-1-1``. A number that was taken stays taken, so the numbers
    tried for a slug start behind the last one it got. NULL stays NULL.
    """
    return _unique(as_col(names))


def display_text(text: Column | str) -> Column:
    """Heading text for a table of contents."""
    # what is taken out is not ASCII
    cleaned = only_if(as_col(text), _wide, lambda w: F.replace(F.replace(
        only_if(w, has("ðŸ"), lambda t: F.regexp_replace(t, "(?U)ðŸ[^\\s\\w]{1,3}\\S?", "")),
        F.lit("\ufe0f"), F.lit("")), F.lit("\u200b"), F.lit("")))
    return _filled(strip_space(cleaned), F.lit("Untitled Section"))


def lines(text: Column | str) -> Column:
    """Nearly every text ends its lines by line feeds alone, which need no regular expression."""
    return let(as_col(text), lambda t: F.when(_any_of(_RARE_LINE_ENDS)(t), F.split(t, LINE_END)).otherwise(F.split(t, "\n")))


def heading_level(line: Column | str) -> Column:
    """1 or 2; 0 for any other line."""
    return F.length(F.regexp_extract(as_col(line), r"(?U)^(#{1,2})\s+.", 1))


def heading_text(line: Column | str) -> Column:
    return strip_space(F.regexp_extract(as_col(line), r"(?U)^#{1,2}\s+(.+)$", 1))


def title_anchor(title: Column | str) -> Column:
    dashed = F.regexp_replace(F.lower(as_col(title)), "[^a-z0-9_]+", "-")
    return F.coalesce(blank_to_null(F.regexp_replace(dashed, "^-+|-+$", "")), F.lit("page"))
