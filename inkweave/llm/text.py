"""Words of whole texts as flat arrays: the shared base of the operators that work in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of an Arrow operator works on; a longer text is a step of its own.
STEP = 2 << 20

_RANDOM = np.random.default_rng(20240229)
_LETTER = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_FOLDED = _LETTER.copy()
_FOLDED[65:91] = _LETTER[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)


def bounded(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches in rows and bytes, whatever the length of a text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table."""
    return bounded(spark).read.parquet(f"{sf_dir}/documents.parquet")


def steps(batches: Iterable[pa.RecordBatch], limit: int = STEP) -> Iterator[pa.RecordBatch]:
    """Cut batches, whose second column is the text, into runs of rows with about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()  # a worker that waits for other tasks keeps nothing


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, one after another, and the rows' offsets; a null is an empty text."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hash of each byte span (ascending, disjoint); ``fold`` lower-cases A-Z."""
    table, out, at = _FOLDED if fold else _LETTER, np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + STEP, "right")))
        low, high = int(starts[at]), int(ends[stop - 1])
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(table[data[low:high]] * powers(_BASE, high - low), out=total[1:])
        back = powers(_BASE_INVERSE, high - low)[starts[at:stop] - low]
        out[at:stop] = mix((total[ends[at:stop] - low] - total[starts[at:stop] - low]) * back)
        at = stop
    return out


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a step: byte spans, row of each word, first word of each row."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    first: np.ndarray

    def hashes(self, fold: bool = False) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, fold)


def words(text: pa.Array) -> Words:
    data, offsets = raw(text)
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = _SPACE[data]
    edges = offsets[1:-1]
    begins, finishes = ~blank[1:-1] & blank[:-2], ~blank[1:-1] & blank[2:]
    inner = edges[(edges > 0) & (edges < len(data))]
    begins[inner] = ~blank[inner + 1]
    finishes[inner - 1] = ~blank[inner]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    first = np.searchsorted(starts, offsets)
    rows = np.repeat(np.arange(len(text)), np.diff(first))
    return Words(data, starts, ends, rows, first)


def grams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n consecutive words of one row, and the index of their first word."""
    if len(hashes) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    count = len(hashes) - n + 1
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(_BASE) + hashes[i : i + count])
    whole = np.flatnonzero(rows[:count] == rows[n - 1 :])
    return out[whole], whole


def listed(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Flat values as one list per row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def buckets_for(docs: DataFrame, text_col: str = "text", each: int = 4 << 20) -> int:
    """Number of hash buckets for ``each`` bytes of text a bucket, from the text that is there."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("n")).first()["n"]
    return max(64, -(-(total or 0) // each))
