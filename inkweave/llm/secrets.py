"""Secret scan with ownership: a value that many owners hold is an example, one owner's value looks live."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.text import raw, steps
from inkweave.session import stage

KINDS = ["assign", "access", "hex", "blob"]
#: A value that so many owners hold is a copied example.
COPIED_OWNERS = 3
#: Length and bits a character of an opaque value without a keyword.
BLOB_LENGTH, BLOB_BITS = 24, 4.0

# No pattern can match a line end, so the rows of a step are searched as one text.
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_BLOB = re.compile(rb"[A-Za-z0-9+/_-]{%d,}" % BLOB_LENGTH)
_HEX = np.array([chr(b) in "0123456789abcdef" for b in range(256)])
_BLOB_BYTE = np.array([b < 128 and (chr(b).isalnum() or chr(b) in "+/_-") for b in range(256)])
_POINT = np.array([b & 0xC0 != 0x80 for b in range(256)])


def _runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= least
    return start[long], end[long]


def _opaque(value: bytes) -> bool:
    """Upper and lower case letters and digits, without order."""
    if not (re.search(rb"[0-9]", value) and re.search(rb"[a-z]", value) and re.search(rb"[A-Z]", value)):
        return False
    share = np.bincount(np.frombuffer(value, np.uint8))
    share = share[share > 0] / len(value)
    return float(-(share * np.log2(share)).sum()) >= min(BLOB_BITS, 0.8 * np.log2(len(value)))


def _find(text: pa.Array) -> list[list[tuple[int, int, int, bytes]]]:
    """Per row: (kind, start, end, value hash), places in code points."""
    data, offsets = raw(text)
    shifted = offsets + np.arange(len(offsets))  # a line end after every row
    joined = np.full(len(data) + len(text), 10, np.uint8)
    put = np.ones(len(joined), bool)
    put[shifted[1:] - 1] = False
    joined[put] = data
    whole = joined.tobytes()
    hits: list[tuple[int, int, int, bytes]] = []
    for m in _ASSIGN.finditer(whole):
        if len(m[2]) >= 12:
            hits.append((m.start(), 0, m.end(), m[2]))
    for m in _ACCESS.finditer(whole):
        if len(m[0]) >= 18:
            hits.append((m.start(), 1, m.end(), m[0]))
    for a, b in zip(*map(np.ndarray.tolist, _runs(_HEX[joined], 16)), strict=True):
        hits.append((a, 2, b, whole[a:b]))
    hits.sort(key=lambda x: x[:2])
    taken = sorted((a, b) for a, _, b, _ in hits)
    starts, reach = np.array([a for a, _ in taken], np.int64), np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else np.zeros(0, np.int64)
    for a, b in zip(*map(np.ndarray.tolist, _runs(_BLOB_BYTE[joined], BLOB_LENGTH)), strict=True):
        at = np.searchsorted(starts, b) - 1
        if (at < 0 or reach[at] <= a) and _opaque(whole[a:b]):
            hits.append((a, 3, b, whole[a:b]))
    hits.sort(key=lambda x: x[:2])
    out: list[list[tuple[int, int, int, bytes]]] = [[] for _ in range(len(text))]
    if hits:
        points = np.concatenate([[0], np.cumsum(_POINT[joined])])
        for a, kind, b, value in hits:
            row = int(np.searchsorted(shifted, a, "right")) - 1
            base = points[shifted[row]]
            out[row].append((kind, int(points[a] - base), int(points[b] - base), hashlib.blake2b(value, digest_size=16).digest()))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """Every row's ``spans`` (array of kind, start, end, value, n_repos, n_owners, verdict), by start and kind, under ``id_col``.

    ``value`` is the hash of the secret, ``n_repos`` the number of rows that hold it, ``n_owners``
    that of distinct owners (null is one owner). Verdict: ``copied`` from COPIED_OWNERS owners on,
    ``live`` for one owner, else ``shared``. Spans of kind ``blob`` (opaque values without keyword)
    are kept only if live. A row without finding, with null or empty text has an empty array.
    Repeated rows and null ids stay rows of their own; other columns are ignored.

    A value in a third of all rows is counted by partial sums; its rows meet the one row of counts
    in a join that splits large partitions.
    """
    source = docs.select(id_col, text_col, owner_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.binary())])
        for batch in steps(batches):
            found = [[dict(zip(("kind", "start", "end", "value"), x, strict=True)) for x in row] for row in _find(batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(found)), pa.int64()), batch.column(0), batch.column(2), pa.array(found, pa.list_(span))], ["row", "key", "owner", "found"])
            at += len(found)

    kinds = [f.dataType.simpleString() for f in source.schema]
    rows = stage(source.mapInArrow(run, f"row long, key {kinds[0]}, owner {kinds[2]}, found array<struct<kind:int,start:long,end:long,value:binary>>"))
    each = rows.select("row", "owner", F.explode("found").alias("x")).select("row", "owner", "x.*")
    held = each.select("value", "row", "owner").distinct().groupBy("value", "owner").agg(F.count("*").alias("n"))
    counts = held.groupBy("value").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))
    verdict = F.when(F.col("n_owners") >= COPIED_OWNERS, "copied").when(F.col("n_owners") == 1, "live").otherwise("shared")
    judged = each.join(counts, "value").withColumn("verdict", verdict).where((F.col("kind") < 3) | (F.col("verdict") == "live"))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    spans = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", F.col("kind").alias("order"), "end", name.alias("kind"), "value", "n_repos", "n_owners", "verdict"))).alias("spans"))
    return rows.join(spans, "row", "left").select(F.col("key").alias(id_col), F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))
