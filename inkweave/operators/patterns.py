"""Many scope patterns against many addresses, by equi-joins instead of testing each pattern on each address.

Path prefixes: an address has few prefixes that a pattern can name, so these are exploded and
joined with the patterns, a trie as a table. Regular expressions: a text that every match must
contain is taken out of the pattern; its rarest part is joined with the parts of the address, and
only what meets is tested, first for the whole text, then by the expression. Parts are as long as
the text allows (of a few lengths), so that patterns by the thousand do not share theirs.
Expressions without such a text are tested on the addresses of their host. Spark broadcasts the
pattern side while its bytes allow it and shuffles beyond; either way the work follows the hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.functions import let, urls
from inkweave.operators.joins import salted_join

#: Signs of a trigger part: the most that the text has.
PARTS = (3, 6, 9, 12, 18, 24, 36)
PART = PARTS[0]
# Escaped signs stand as these private ones while the syntax around them is taken away.
_ESCAPED = "./-_?+*()[]{}^$|&=,:;#%~@!\"' "
_HELD = "".join(chr(0xE100 + i) for i in range(len(_ESCAPED)))


def path_prefixes(path: Column) -> Column:
    """What an include pattern may be to take the path: the path, and each part before or through a slash."""
    def cuts(parts: Column) -> Column:
        before = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        return F.when(F.size(parts) > 1, F.concat(before, F.transform(before, lambda p: F.concat(p, F.lit("/"))))).otherwise(F.expr("cast(array() as array<string>)"))

    return let(path, lambda p: F.array_distinct(F.concat(F.array(p), let(F.split(p, "/"), cuts))))


def include_matches(addresses: DataFrame, patterns: DataFrame) -> DataFrame:
    """(url, job_id) once for each address that a job's include list takes.

    ``addresses(url)``, ``patterns(job_id, host, prefix)``; a pattern holds on its host only, by whole
    segments, as :func:`inkweave.functions.scope.include_hit` tests one by one.
    """
    ways = addresses.select("url", urls.host("url").alias("host"), F.explode(path_prefixes(urls.path("url"))).alias("prefix"))
    return salted_join(ways, patterns.select("job_id", "host", "prefix").distinct(), ["host", "prefix"], F.col("url")).select("url", "job_id").distinct()


def required_text(pattern: Column) -> Column:
    """The longest text that every match of the expression holds; empty when none is certain.

    Alternatives outside of groups, flags, look-around and quotations give none. Groups (with the
    alternatives in them), classes, quantified signs and anchors only end a text.
    """
    quantifier = r"(?:[?*+]|\{[^}]*\})[?+]?"
    held = pattern
    # what stands between angle brackets goes with the sign before them, an alternative in it with it
    hidden = pattern.rlike(r"\\[A-Za-z0-9]<[^>]*\|")
    for sign, private in zip(_ESCAPED, _HELD, strict=True):
        held = F.replace(held, F.lit("\\" + sign), F.lit(private))
    steps = [
        (rf"\\[A-Za-z0-9](?:<[^>]*>|\{{[^}}]*\}})?(?:{quantifier})?", "\n"),
        (rf"\[\^?\]?[^\]]*\](?:{quantifier})?", "\n"),
        *[(rf"\([^()]*\)(?:{quantifier})?", "\n")] * 4,
        (r"(.)\+[?+]?", "$1\n"),
        (rf".{quantifier}", "\n"),
        (r"[\^$.]", "\n"),
    ]
    for old, new in steps:
        held = F.regexp_replace(held, old, new)
    sure = ~held.contains("|") & ~hidden & ~pattern.rlike(r"\(\?(?!:)") & ~pattern.rlike(r"\\[QE]") & ~pattern.contains("\\\\") & ~held.rlike(r"[()\[\]{}\\]")
    pieces = F.transform(F.split(F.translate(held, _HELD, _ESCAPED), "\n"), lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))
    return F.when(sure, F.array_max(pieces)["t"]).otherwise("")


def _parts(text: Column, signs: Column) -> Column:
    """The parts of a text that have ``signs`` signs; none of a shorter text."""
    starts = lambda t: F.filter(F.sequence(F.lit(1), F.greatest(F.length(t) - signs + 1, F.lit(1))), lambda i: i + signs - 1 <= F.length(t))
    return let(text, lambda t: F.array_distinct(F.transform(starts(t), lambda i: F.substr(t, i, signs))))


def exclude_matches(addresses: DataFrame, patterns: DataFrame) -> DataFrame:
    """(url, job_id) once for each address that one of a job's expressions excludes.

    ``addresses(url)``, ``patterns(job_id, host, pattern)``; an expression is searched in the address
    and in its path, on its host only. Every expression must compile (see ``scope.patterns_compile``).
    """
    needs = patterns.select("job_id", "host", "pattern", required_text(F.col("pattern")).alias("text")).distinct()
    fitting = F.array_max(F.filter(F.array(*[F.lit(n) for n in PARTS]), lambda n: n <= F.length("text")))
    triggered = needs.where(F.length("text") >= PART).withColumn("signs", fitting)
    # the part that fewest patterns have: a word all patterns share does not bring them all in
    parts = triggered.select("host", "job_id", "pattern", "text", F.explode(_parts(F.col("text"), F.col("signs"))).alias("part"))
    many = parts.groupBy("host", "part").agg(F.count("*").alias("n"))
    rarest = parts.join(many, ["host", "part"]).groupBy("host", "job_id", "pattern", "text").agg(F.min(F.struct("n", "part"))["part"].alias("part"))
    known = addresses.select("url", urls.host("url").alias("host"))
    # only parts of a length that some pattern of the host has
    lengths = triggered.groupBy("host").agg(F.collect_set("signs").alias("lengths"))
    cut = salted_join(known, lengths, ["host"], F.col("url")).select("url", "host", F.explode("lengths").alias("signs"))
    ways = cut.select("url", "host", F.explode(_parts(F.col("url"), F.col("signs"))).alias("part"))
    found = salted_join(ways, rarest, ["host", "part"], F.col("url")).where(F.col("url").contains(F.col("text")))
    rest = salted_join(known, needs.where(F.length("text") < PART), ["host"], F.col("url"))
    both = found.select("url", "job_id", "pattern").unionByName(rest.select("url", "job_id", "pattern"))
    return both.where(F.rlike(F.col("url"), F.col("pattern")) | F.rlike(urls.path("url"), F.col("pattern"))).select("url", "job_id").distinct()
