"""Which URLs belong to a job, and how a request becomes scope columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkweave.functions import as_col, strip_space
from inkweave.functions import urls

SCOPE_DEPTH = 2
# Fixed value: the line ends of a text, as the request parser counts them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_NO_STRINGS = "cast(array() as array<string>)"


def given(values: Column | str) -> Column:
    """NULL and the empty list both mean "no restriction"."""
    return F.coalesce(F.size(as_col(values)), F.lit(0)) > 0


def split_prefixes(text: Column | str) -> Column:
    """Comma list of path prefixes: trimmed, blanks dropped, leading slash added."""
    parts = F.transform(F.split(F.coalesce(as_col(text), F.lit("")), ","), strip_space)
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.regexp_replace(p, r"^(?!/)", "/"))


def split_regexes(text: Column | str, use_regex: Column | str) -> Column:
    """Line list of patterns, only when the request turns patterns on."""
    lines = F.transform(
        F.split(F.coalesce(as_col(text), F.lit("")), LINE_END), strip_space)
    kept = F.transform(F.filter(lines, lambda p: p != ""), java_pattern)
    return F.when(F.coalesce(as_col(use_regex), F.lit(False)), kept).otherwise(F.expr(_NO_STRINGS))


def java_pattern(pattern: Column) -> Column:
    """Named groups are the one common spelling that differs between the two dialects."""
    return F.regexp_replace(F.regexp_replace(pattern, r"\(\?P<", "(?<"), r"\(\?P=(\w+)\)", r"\\k<$1>")


def joined_prefixes(includes: Column | str) -> Column:
    """The list form of a request as the comma form; an empty list gives NULL."""
    return F.when(given(includes), F.array_join(as_col(includes), ","))


def joined_regexes(excludes: Column | str) -> Column:
    return F.when(given(excludes), F.array_join(as_col(excludes), "\n"))


def patterns_compile(patterns: Column | str) -> Column:
    """Whether the engine's own dialect takes every pattern, so a bad one fails its job and not the whole query."""
    compiled = lambda p: F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), p).isNotNull()
    return F.coalesce(F.forall(as_col(patterns), lambda p: p.isNotNull() & compiled(p)), F.lit(True))


def seed_prefixes_v2(seed_url: Column | str, includes: Column | str) -> Column:
    """Own two-segment prefix and every shorter parent; an include list puts its first entry instead."""
    seed = as_col(seed_url)
    parts = urls.segments(seed)
    own = F.slice(parts, 1, SCOPE_DEPTH)
    parents = F.when(
        F.size(parts) > 1,
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
                    lambda i: F.slice(parts, 1, F.least(F.lit(SCOPE_DEPTH), i))),
    ).otherwise(F.expr("cast(array() as array<array<string>>)"))
    included = F.array(urls.prefix_parts(urls.join(seed, F.get(as_col(includes), F.lit(0))), SCOPE_DEPTH))
    return F.when(given(includes), included).otherwise(F.array_distinct(F.concat(F.array(own), parents)))


def include_hit(path: Column, includes: Column | str) -> Column:
    """Whole-segment prefix match: ``/docs`` takes ``/docs`` and ``/docs/x`` but not ``/docsx``."""
    return F.exists(as_col(includes), lambda p: F.when(p.endswith("/"), path.startswith(p)).otherwise(
        (path == p) | path.startswith(F.concat(p, F.lit("/")))))


def excluded(url: Column, path: Column, excludes: Column | str) -> Column:
    return F.coalesce(F.exists(as_col(excludes), lambda r: F.rlike(url, r) | F.rlike(path, r)), F.lit(False))


def in_scope_v1(url: Column | str, seed_host: Column | str, seed_prefix: Column | str,
                includes: Column | str, excludes: Column | str) -> Column:
    """Host, raw include prefix, URL patterns and seed prefix must all hold."""
    u, prefix, page_path = as_col(url), as_col(seed_prefix), urls.path(url)
    included = ~given(includes) | F.coalesce(
        F.exists(as_col(includes), lambda p: page_path.startswith(p)), F.lit(False))
    hit = F.coalesce(F.exists(as_col(excludes), lambda r: F.rlike(u, r)), F.lit(False))
    under = F.slice(urls.segments(u, keep_inner_blanks=False), 1, F.size(prefix)) == prefix
    return F.coalesce((urls.host(u) == as_col(seed_host)) & included & ~hit
                      & ((F.size(prefix) == 0) | under), F.lit(False))


def in_scope_v2(url: Column | str, seed_host: Column | str, seed_prefixes: Column | str,
                includes: Column | str, excludes: Column | str) -> Column:
    """Host, then excludes, then includes if any are given, else any seed prefix."""
    u, page_path = as_col(url), urls.path(url)
    parts = urls.segments(u)
    under = F.exists(as_col(seed_prefixes),
                     lambda p: (F.size(p) == 0) | (F.slice(parts, 1, F.greatest(F.size(p), F.lit(1))) == p))
    chosen = F.when(given(includes), include_hit(page_path, includes)).otherwise(under)
    return F.coalesce((urls.host(u) == as_col(seed_host)) & ~excluded(u, page_path, excludes) & chosen,
                      F.lit(False))
