"""Line dedup with levelled sorted runs of line hashes.

A task sorts the line hashes of its text in batches of some million and deals each batch to hash
buckets. In a bucket what comes in is put together to batches of BATCH hashes, so the work follows the
hashes and not the number of tasks. Each new batch is merge-anti-joined with the runs that are
there: hashes met before add to their counts, the others become a run of their own. FANOUT runs of
a level are compacted into one run of the next level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.text import buckets_for, steps
from inkweave.session import stage

FANOUT = 4
#: Hashes that a task sends at once, and hashes that a bucket merges at once.
SENT, BATCH = 1 << 20, 1 << 16
#: Code points of the shortest key that counts, and documents from which on it is dropped.
LEAST_POINTS, LEAST_DOCS = 20, 3
STRIPPED = " \t\n\v\f\r"
#: Stands for a null id; smaller than any other.
NO_ID = -(2**63)

RUN = "bucket int, level int, batch long, high binary, low binary, docs binary, top binary"


def line_key(line: str) -> bytes | None:
    """128-bit hash of a line's key (ends stripped, A-Z lower-cased); None for a short one."""
    key = line.strip(STRIPPED)
    return hashlib.blake2b(key.encode().lower(), digest_size=16).digest() if len(key) >= LEAST_POINTS else None


@dataclass
class Run:
    """Distinct line hashes in order, the number of documents of each and the largest id."""

    high: np.ndarray
    low: np.ndarray
    docs: np.ndarray
    top: np.ndarray

    @classmethod
    def of(cls, parts: list[Run]) -> Run:
        """One sorted run of several."""
        high, low, docs, top = (np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(cls))
        order = np.lexsort((low, high))
        high, low, docs, top = high[order], low[order], docs[order], top[order]
        heads = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])) if len(high) else np.zeros(0, np.int64)
        return cls(high[heads], low[heads], np.add.reduceat(docs, heads) if len(heads) else docs, np.maximum.reduceat(top, heads) if len(heads) else top)

    def take(self, which: np.ndarray) -> Run:
        return Run(*(getattr(self, f.name)[which] for f in fields(self)))

    def find(self, other: Run) -> np.ndarray:
        """Place of each of the other run's hashes here, -1 if it is new."""
        if not len(self.high):
            return np.full(len(other.high), -1)
        at = np.searchsorted(self.high, other.high)
        out, todo = np.full(len(other.high), -1), np.arange(len(other.high))
        while len(todo):
            todo = todo[at[todo] < len(self.high)]
            todo = todo[self.high[at[todo]] == other.high[todo]]
            good = self.low[at[todo]] == other.low[todo]
            out[todo[good]] = at[todo[good]]
            todo = todo[~good]
            at[todo] += 1
        return out

    def packed(self) -> list[bytes]:
        return [getattr(self, f.name).tobytes() for f in fields(self)]

    @classmethod
    def unpacked(cls, high: bytes, low: bytes, docs: bytes, top: bytes) -> Run:
        return cls(np.frombuffer(high, np.uint64), np.frombuffer(low, np.uint64), np.frombuffer(docs, np.int64).copy(), np.frombuffer(top, np.int64).copy())


class Levels:
    """The runs of one bucket."""

    def __init__(self) -> None:
        self.levels: list[list[Run]] = []

    def add(self, batch: Run) -> Run:
        """Merge-anti-join a batch with all runs and keep what is new as a run; returns the new part."""
        fresh = np.ones(len(batch.high), bool)
        for run in (r for level in self.levels for r in level):
            at = run.find(batch)
            hit = at >= 0
            run.docs[at[hit]] += batch.docs[hit]
            run.top[at[hit]] = np.maximum(run.top[at[hit]], batch.top[hit])
            fresh &= ~hit
        own = batch.take(fresh)
        self.put(0, own)
        return own

    def put(self, level: int, run: Run) -> None:
        """Add a run to a level; a full level becomes one run of the next."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == FANOUT:
            whole, self.levels[level] = Run.of(self.levels[level]), []
            self.put(level + 1, whole)


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, row) pairs of a step as 16-byte keys and rows."""
    keys, rows = [], []
    for row, text in enumerate(batch.column(1).to_pylist()):
        found = {k for k in map(line_key, text.split("\n")) if k} if text else ()
        keys.extend(found)
        rows.extend([row] * len(found))
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2), np.array(rows, np.int64)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def line_runs(docs: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text", earlier: DataFrame | None = None) -> DataFrame:
    """The runs of all line hashes of ``docs`` (columns of RUN), continuing ``earlier`` runs of the same number of buckets.

    A batch of a task sends each hash once, whatever the number of its lines that share it.
    """
    names = ["bucket", "level", "batch", "high", "low", "docs", "top"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]

    def rows_of(out: list[tuple]) -> list[pa.Array]:
        return [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)]

    def dealt(run: Run, number: int) -> pa.RecordBatch:
        of = (run.high % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")  # hashes stay in order inside a bucket
        cuts = np.flatnonzero(np.diff(of[order], prepend=-1))
        return pa.RecordBatch.from_arrays(rows_of([(int(of[part[0]]), -1, number, *run.take(part).packed()) for part in np.split(order, cuts[1:])]), names)

    def batched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in steps(batches):
            keys, rows = _keys(batch)
            if len(rows):
                parts.append(Run.of([Run(keys[:, 0], keys[:, 1], np.ones(len(rows), np.int64), _ids(batch)[rows])]))
                size += len(parts[-1].high)
            if size >= SENT:
                yield dealt(Run.of(parts), number)
                number, parts, size = number + 1, [], 0
        if parts:
            yield dealt(Run.of(parts), number)

    def fold(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (-r["level"] if r["level"] >= 0 else 1, r["batch"]))
        all_levels, parts, size = Levels(), [], 0
        for i, r in enumerate(rows):
            run = Run.unpacked(r["high"], r["low"], r["docs"], r["top"])
            if r["level"] >= 0:
                all_levels.put(r["level"], run)
            else:
                parts.append(run)
                size += len(run.high)
            if parts and (size >= BATCH or i == len(rows) - 1):
                all_levels.add(Run.of(parts))
                parts, size = [], 0
        out = [(rows[0]["bucket"], level, i, *run.packed()) for level, runs in enumerate(all_levels.levels) for i, run in enumerate(runs) if len(run.high)]
        return pa.table(rows_of(out), names=names)

    new = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(batched, RUN)
    return (new.unionByName(earlier) if earlier is not None else new).groupBy("bucket").applyInArrow(fold, RUN)


def frequent(runs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """``key``, ``top`` of the hashes that ``least`` documents hold. A hash stands in one run of its bucket."""
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                run = Run.unpacked(r["high"], r["low"], r["docs"], r["top"])
                run = run.take(run.docs >= least)
                keys = np.stack([run.high, run.low], axis=1).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([keys[i : i + 16] for i in range(0, len(keys), 16)], pa.binary()), pa.array(run.top)], ["key", "top"])

    return runs.mapInArrow(read, "key binary, top long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_DOCS, keep: list[str] | None = None) -> DataFrame:
    """``id_col``, ``keep`` columns, ``kept`` (text without the dropped lines), n_lines, n_dropped of every row.

    A line whose key (at least LEAST_POINTS code points) stands in ``least`` rows is dropped unless
    its row has the largest id among them. Ids are integers; a null id is smaller than all others.
    Repeated rows count each and, if they share the largest id, all keep the line. A null or empty
    text is one empty line. Columns not named are ignored; an empty table gives an empty result.

    A line in a third of all rows meets one row of counts, in a join that splits large partitions.
    """
    common = stage(frequent(line_runs(docs, buckets_for(docs, text_col), id_col, text_col), least))

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            keys, rows = _keys(batch)
            data = keys.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([data[i : i + 16] for i in range(0, len(data), 16)], pa.binary()), pa.array(_ids(batch)[rows]), batch.column(2).take(pa.array(rows))], ["key", "holder", "which"])

    # Rows that share an id are told apart by a hash of their text, so no id gathers the lines of many rows.
    held = docs.select(F.col(id_col).cast("long"), text_col, F.xxhash64(F.col(text_col))).mapInArrow(pairs, "key binary, holder long, which long")
    drops = held.join(common, "key").where(F.col("holder") < F.col("top")).groupBy("holder", "which").agg(F.collect_set("key").alias("keys"))
    keep = keep or []
    rest = [f"__{i}" for i in range(len(keep))]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(r) for c, r in zip(keep, rest, strict=True)])
    holder = F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)) == F.col("holder")
    joined = source.join(drops, holder & (F.xxhash64("text") == F.col("which")), "left").select("id", "text", "keys", *rest)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            texts, counts, dropped = [], [], []
            for text, keys in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                gone = set(keys or ())
                kept = [x for x in lines if line_key(x) not in gone] if gone else lines
                texts.append("\n".join(kept))
                counts.append(len(lines))
                dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[3:], pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], ["id", *rest, "kept", "n_lines", "n_dropped"])

    kinds = "".join(f"{c} {joined.schema[c].dataType.simpleString()}, " for c in ("id", *rest))
    return joined.mapInArrow(cut, f"{kinds}kept string, n_lines long, n_dropped long").toDF(id_col, *keep, "kept", "n_lines", "n_dropped")
