"""URL parts, reference resolution, page-type tests and file names.

One anchored regular expression splits a URL. ``parse_url`` is not used: it raises in ANSI
mode, and its lenient form loses hosts with an underscore and paths with a blank.
"""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkweave.functions import as_col, blank_to_null, let, only_if

_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_HOST = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#]*)"

# Extensions the command-line profile takes as non-HTML.
NON_HTML_EXTENSIONS = [
    ".zip", ".pdf", ".tar", ".bz2", ".gz", ".rar", ".7z", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".bmp", ".ico",
    ".mp3", ".mp4", ".avi", ".mov", ".ogg", ".webm", ".exe", ".msi", ".dmg", ".deb", ".rpm", ".whl", ".txt", ".csv", ".json",
    ".xml", ".yaml", ".yml", ".css", ".js", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".odt",
]
# Extensions and content types the job profile decides on.
HTML_EXTENSIONS = ["", ".html", ".htm", ".asp", ".aspx", ".php", ".jsp"]
NON_HTML_TYPES = [
    "application/pdf", "image/", "application/zip", "text/plain", "text/css",
    "application/javascript", "application/json", "application/xml",
]
# Extensions the standard registry maps to a text type other than plain text.
_REGISTRY = mimetypes.MimeTypes(filenames=())
TEXT_EXTENSIONS = sorted(
    ext for ext, kind in _REGISTRY.types_map[True].items()
    if kind.startswith("text/") and kind != "text/plain"
)
ENCODING_EXTENSIONS = sorted(ext.lower() for ext in _REGISTRY.encodings_map)


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(as_col(url), _SPLIT, 1))


def netloc(url: Column | str) -> Column:
    return F.regexp_extract(as_col(url), _SPLIT, 2)


def path(url: Column | str) -> Column:
    return F.regexp_extract(as_col(url), _SPLIT, 3)


def query(url: Column | str) -> Column:
    return F.regexp_extract(as_col(url), _SPLIT, 4)


def fragment(url: Column | str) -> Column:
    return F.regexp_extract(as_col(url), _SPLIT, 5)


def host(url: Column | str) -> Column:
    """Lower-cased host name without user info and port; NULL when absent."""
    return blank_to_null(F.lower(F.regexp_extract(as_col(url), _HOST, 1)))


def strip_fragment(url: Column | str) -> Column:
    return F.regexp_replace(as_col(url), r"(?s)#.*$", "")


def _normal_path(base_path: Column, href_path: Column) -> Column:
    """Merge and remove dot segments; ``href_path`` is non-empty."""
    rooted = href_path.startswith("/")
    base = F.split(base_path, "/")
    kept = F.when(F.element_at(base, -1) == "", base).otherwise(
        F.slice(base, 1, F.greatest(F.size(base) - 1, F.lit(0))))
    merged = F.concat(kept, F.split(href_path, "/"))
    # Redundant inner slashes vanish on a merge, but stay in a rooted reference.
    squeezed = F.filter(merged, lambda seg, i: (seg != "") | (i == 0) | (i == F.size(merged) - 1))
    segments = F.when(rooted, F.split(href_path, "/")).otherwise(squeezed)

    def resolve(parts: Column) -> Column:
        walked = F.aggregate(
            parts,
            F.expr("cast(array() as array<string>)"),
            lambda acc, seg: F.when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(seg == ".", acc)
            .otherwise(F.concat(acc, F.array(seg))),
        )
        tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
            F.expr("cast(array() as array<string>)"))
        return F.array_join(F.concat(walked, tail), "/")

    joined = let(segments, resolve)
    return F.regexp_replace(F.regexp_replace(joined, r"^$", "/"), r"^([^/])", "/$1")


def clean_href(href: Column) -> Column:
    """Line ends and tabs go, as do blanks and control characters at both ends."""
    inner = only_if(href, lambda h: h.rlike(r"[\t\n\r]"), lambda h: F.regexp_replace(h, r"[\t\n\r]", ""))
    return only_if(inner, lambda h: h.rlike(r"^[\x00-\x20]|[\x00-\x20]$"), lambda h: F.regexp_replace(h, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))


def join(base: Column | str, href: Column | str) -> Column:
    """Resolve a reference against its page, as browsers and RFC 3986 do."""
    base, href = as_col(base), clean_href(as_col(href))

    def resolved(pair: Column) -> Column:
        b, h = pair["b"], pair["h"]
        origin = F.concat(scheme(b), F.lit("://"), netloc(b))
        tail = F.regexp_extract(h, r"(?s)^[^?#]*(.*)$", 1)
        return (
            F.when(h == "", b)
            .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
            .when(h.startswith("//"), F.concat(scheme(b), F.lit(":"), h))
            .when(h.startswith("#"), F.concat(strip_fragment(b), h))
            .when(h.startswith("?"), F.concat(origin, path(b), h))
            .when(h.startswith("/") & ~h.contains("/."), F.concat(origin, h))
            .otherwise(F.concat(origin, _normal_path(path(b), path(h)), tail))
        )

    return let(F.struct(base.alias("b"), href.alias("h")), resolved)


def skipped_href(href: Column | str) -> Column:
    """References that never lead to a page."""
    return as_col(href).rlike(r"^(?:$|#|mailto:|tel:|javascript:)")


def fetchable(url: Column | str) -> Column:
    """Resolved to something with a scheme and a host."""
    return (scheme(url) != "") & (netloc(url) != "")


def segments(url: Column | str, keep_inner_blanks: bool = True) -> Column:
    """Path segments; root gives an empty array. The command-line profile drops inner blanks."""
    trimmed = F.regexp_replace(path(url), r"^/+|/+$", "")
    parts = F.split(trimmed, "/")
    if keep_inner_blanks:
        return let(parts, lambda p: F.when(p[0] == "", F.slice(p, 1, 0)).otherwise(p))
    return F.filter(parts, lambda seg: seg != "")


def prefix_parts(url: Column | str, depth: int = 2, keep_inner_blanks: bool = True) -> Column:
    return F.slice(segments(url, keep_inner_blanks), 1, depth)


def extension(url_path: Column) -> Column:
    """Last extension of the last segment; a leading dot does not count."""
    return F.lower(F.regexp_extract(url_path, r"(?s)(?:^|/)\.*[^./][^/]*?(\.[^./]*)$", 1))


def is_html_v1(url: Column | str) -> Column:
    """By path only, against the deny list."""
    return ~let(F.lower(path(url)), extension).isin(NON_HTML_EXTENSIONS)


def is_html_v2(url: Column | str, content_type: Column | str | None = None) -> Column:
    """Content type first, then path, then the type registry."""
    kind = F.lit("") if content_type is None else F.coalesce(F.lower(as_col(content_type)), F.lit(""))

    def decide(row: Column) -> Column:
        p, ext, ctype = row["p"], row["ext"], row["ctype"]
        listed = F.lit(False)
        for name in NON_HTML_TYPES:
            listed = listed | ctype.contains(name)
        inner = extension(F.regexp_replace(p, r"\.[^./]*$", ""))
        guessed = F.when(ext.isin(ENCODING_EXTENSIONS), inner).otherwise(ext)
        return (
            F.when(ctype.contains("text/html"), True)
            .when((p == "") | p.endswith("/"), True)
            .when(listed, False)
            .when(ext.isin(HTML_EXTENSIONS), True)
            .otherwise(guessed.isin(TEXT_EXTENSIONS))
        )

    page_path = path(url)
    return let(
        F.struct(page_path.alias("p"), extension(page_path).alias("ext"), kind.alias("ctype")), decide)


def filename_v1(url: Column | str) -> Column:
    flat = F.replace(F.regexp_replace(path(url), r"^/+|/+$", ""), F.lit("/"), F.lit("_"))
    return F.concat(F.coalesce(blank_to_null(flat), F.lit("index")), F.lit(".md"))


def _safe_segments(url: Column | str) -> Column:
    """Percent-decoded segments limited to file-name characters, 50 each."""
    def safe(seg: Column) -> Column:
        escaped = F.regexp_replace(seg, r"%(?![0-9A-Fa-f]{2})", "%25")
        decoded = F.coalesce(F.try_url_decode(escaped), seg)
        return F.left(F.regexp_replace(decoded, r"[^a-zA-Z0-9_.\-]", "_"), F.lit(50))

    return F.transform(segments(url, keep_inner_blanks=False), safe)


def filename_v2_flat(url: Column | str) -> Column:
    joined = F.left(F.array_join(_safe_segments(url), "_"), F.lit(150))
    return F.concat(F.coalesce(blank_to_null(joined), F.lit("index")), F.lit(".md"))


def filename_v2_nested(url: Column | str) -> Column:
    joined = F.array_join(_safe_segments(url), "/")
    return F.concat(F.coalesce(blank_to_null(joined), F.lit("index")), F.lit(".md"))


def object_key(job_id: Column | str, artifact: Column | str) -> Column:
    return F.concat_ws("/", as_col(job_id), as_col(artifact))


def public_url(domain: Column | str, key: Column | str) -> Column:
    def bare(value: Column) -> Column:
        return F.regexp_replace(value, r"^/+|/+$", "")
    return F.concat(F.lit("https://"), bare(as_col(domain)), F.lit("/"),
                    F.regexp_replace(as_col(key), r"^/+", ""))


def export_name(created: Column | str, prefix: str = "docs_export_") -> Column:
    """Bundle name stamped with whole epoch seconds of ``created``."""
    return F.concat(F.lit(prefix), F.unix_timestamp(as_col(created)).cast("string"), F.lit(".zip"))


def attachment_name(disposition: Column | str, key: Column | str, job_id: Column | str,
                    output_format: Column | str, prefix: str = "docs_export_") -> Column:
    """Name in the header, else the base name of the key, else a generated one."""
    named = blank_to_null(F.regexp_extract(as_col(disposition), r'filename="([^"]+)"', 1))
    base = blank_to_null(F.regexp_extract(as_col(key), r"([^/]*)$", 1))
    suffix = F.when(as_col(output_format) == "single_md", ".md").otherwise(".zip")
    return F.coalesce(named, base, F.concat(F.lit(prefix), as_col(job_id), suffix))
