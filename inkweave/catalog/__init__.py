"""Registered queries, each next to the SQL that checks it.

Every entry reads the given tables whole. Where the captured pages lack a feature (they hold no
tables, images or resolvable links), the feature is written into every page from its own columns,
on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
Entry = tuple[Query, str | None]


def entries() -> dict[str, Entry]:
    from inkweave.catalog import cleaning, content, crawling, documents, links, outputs, state, urls

    found: dict[str, Entry] = {}
    for module in (urls, links, crawling, content, cleaning, documents, outputs, state):
        for name, entry in module.ENTRIES.items():
            assert name not in found, name
            found[name] = entry
    return found
