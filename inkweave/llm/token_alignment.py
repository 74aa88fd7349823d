"""Two tokenizers' tokens of one text, aligned by byte places, and how often their ids meet in the corpus.

Both sides cover the same bytes. For each batch pandas ``merge_asof``, keyed by document, finds the
token of the other side that covers each token's start; both directions together give all
overlaps. A token that starts where its covering token starts begins a group (both sides ended
there). Links are the pairs of A and B tokens of a group; a group is taken as its distinct ids with
their numbers, so long groups cost their distinct ids.

Corpus counts: a task takes some megabytes of text as one bucket and keeps its distinct id pairs as
a list; documents refer to places in it. Buckets are written once. Each pair of a bucket is one row
that is summed (with map-side sums) and joined with the total, so a pair that is everywhere has a
row for each bucket, not for each document.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.sentencepiece_codec import Encoder, PieceModel
from inkweave.llm.text import STEP, listed, raw, steps
from inkweave.session import stage

#: Bytes of text of one bucket of pairs; a longer text is a bucket of its own.
BUCKET = 8 << 20
#: Runs of white space that the fast encoder's pattern matcher has no stack for; such texts go to the tokenizers library.
LONG_BLANK = re.compile(r"\s{2000}")
# The split pattern of byte-level BPE, and the bytes that stand for themselves in its vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]


class ByteSide:
    """Byte-level BPE from a tokenizer's JSON text; special tokens' strings are plain text."""

    def __init__(self, text: str):
        import tiktoken

        self.json, self.slow = text, None
        model = json.loads(text)["model"]
        hidden = (b for b in range(256) if b not in SHOWN)
        byte = {chr(b): b for b in SHOWN} | {chr(256 + k): b for k, b in enumerate(hidden)}
        self.tokens = {i: bytes(byte[c] for c in token) for token, i in model["vocab"].items() if all(c in byte for c in token)}
        ranks = {b: i for i, b in self.tokens.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        if made != sorted(made) or len(made) + 256 != len(ranks):
            raise ValueError("ids of merged tokens must follow the order of merges")
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [self._library(t) if len(t) >= 2000 and LONG_BLANK.search(t) else self.fast.encode_ordinary(t) for t in texts]
        counts = np.array([len(r) for r in rows], np.int64)
        return np.fromiter((i for r in rows for i in r), np.int64, int(counts.sum())), counts

    def _library(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_str(self.json)
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids


class Sides:
    """Both encoders of a Python worker and the bytes of their tokens."""

    def __init__(self, a_json: str, b_model: PieceModel):
        self.a, self.b = ByteSide(a_json), Encoder(b_model)
        a_bytes = [self.a.tokens.get(i, b"") for i in range(max(self.a.tokens) + 1)]
        b_bytes = [b_model.pool[o : o + n].tobytes() for o, n in zip(b_model.offsets.tolist(), b_model.lengths.tolist(), strict=True)]
        self.bytes = [pa.array(x, pa.large_binary()) for x in (a_bytes, b_bytes)]
        self.sizes = [np.array([len(t) for t in x], np.int64) for x in (a_bytes, b_bytes)]

    def spell(self, side: int, ids: np.ndarray) -> np.ndarray:
        """Bytes of tokens, one after another."""
        return raw_bytes(self.bytes[side].take(pa.array(ids)))


def raw_bytes(values: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(values) else np.empty(0, np.uint8)


_sides: dict[int, Sides] = {}


def worker_sides(shared: Broadcast) -> Sides:
    """The encoders of this Python worker; those of earlier tokenizers are dropped."""
    both = shared.value
    if id(both) not in _sides:
        _sides.clear()
        _sides[id(both)] = Sides(*both)
    return _sides[id(both)]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


@dataclass
class Aligned:
    """Tokens of a step: ids, tokens of each row, group of each token (over all rows), covering tokens of each start."""

    ids: list[np.ndarray]
    counts: list[np.ndarray]
    groups: list[np.ndarray]
    covers: list[np.ndarray]

    def rows(self, side: int) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts[side])), self.counts[side])

    def overlaps(self) -> np.ndarray:
        """All pairs (place of A token, place of B token) that share a byte, ascending: the union of both directions."""
        ahead = np.arange(len(self.ids[0])) << 32 | self.covers[0]
        back = self.covers[1] << 32 | np.arange(len(self.ids[1]))
        return np.union1d(ahead, back)


def align_step(sides: Sides, text: pa.Array) -> Aligned:
    """Align the texts of a step. Rows that are null, empty or not spelled by both sides have no tokens."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string()))
    data, offsets = raw(spaced)
    want = np.diff(offsets)
    good = want > 1
    both = [sides.a.encode(spaced.to_pylist()), sides.b.encode(text)]
    for side, (ids, counts) in enumerate(both):
        good &= _sums(sides.sizes[side][ids], counts) == want
    for _ in range(2):  # once to find rows spelled otherwise, once to leave them out
        both = [(ids[np.repeat(good, counts)], counts * good) for ids, counts in both]
        rest, ends = data[np.repeat(good, want)], np.cumsum(want * good)
        wrong = [np.searchsorted(ends, np.flatnonzero(rest != sides.spell(side, ids)), "right") for side, (ids, _) in enumerate(both)]
        if not any(map(len, wrong)):
            break
        want = want * good
        good = good.copy()
        good[np.unique(np.concatenate(wrong))] = False
        data, want = rest[np.repeat(good, want)], want * good
    ids, counts = [x for x, _ in both], [n for _, n in both]
    ends = [np.cumsum(sides.sizes[side][x]) for side, x in enumerate(ids)]
    starts = [e - sides.sizes[side][x] for side, (e, x) in enumerate(zip(ends, ids, strict=True))]
    frames = [pd.DataFrame({"at": s, "row": np.repeat(np.arange(len(n)), n), "token": np.arange(len(s))}) for s, n in zip(starts, counts, strict=True)]
    covers = [pd.merge_asof(frames[k][["at", "row"]], frames[1 - k], on="at", by="row")["token"].to_numpy(np.int64) for k in (0, 1)]
    groups = [np.cumsum(starts[k] == starts[1 - k][covers[k]]) - 1 for k in (0, 1)]
    return Aligned(ids, counts, groups, covers)


def _distinct(groups: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of each group and how often they stand in it."""
    keys, times = np.unique(groups * size + ids, return_counts=True)
    return keys // size, keys % size, times


def pairs(found: Aligned, sizes: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct id pairs (A << 32 | B) of a step; then row, place of the pair and number of links of each row's pairs."""
    ga, a, ta = _distinct(found.groups[0], found.ids[0], sizes[0])
    gb, b, tb = _distinct(found.groups[1], found.ids[1], sizes[1])
    n = int(found.groups[0][-1]) + 1 if len(found.ids[0]) else 0
    each = np.bincount(gb, minlength=n)
    first = np.cumsum(each) - each
    more = each[ga]
    left = np.repeat(np.arange(len(a)), more)
    right = np.repeat(first[ga] - (np.cumsum(more) - more), more) + np.arange(len(left))
    known, place = np.unique(a[left].astype(np.int64) << 32 | b[right], return_inverse=True)
    begins = np.flatnonzero(np.diff(found.groups[0], prepend=-1))
    row = found.rows(0)[begins][ga[left]]
    keys, where = np.unique(row * max(len(known), 1) + place, return_inverse=True)
    times = np.bincount(where, weights=(ta[left] * tb[right]).astype(float), minlength=len(keys)).astype(np.int64)
    return known, keys // max(len(known), 1), keys % max(len(known), 1), times


def group_texts(found: Aligned) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each row."""
    parts = []
    for side in (0, 1):
        ids = pa.array(found.ids[side]).cast(pa.string())
        begins = np.flatnonzero(np.diff(found.groups[side], prepend=-1))
        parts.append(pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.append(begins, len(ids)), pa.int64()), ids), ","))
    groups = pc.binary_join_element_wise(parts[0], parts[1], "|")
    ends = np.concatenate([[0], np.cumsum(n_groups(found))])
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), groups), ";").to_pylist()


def n_groups(found: Aligned) -> np.ndarray:
    begins = np.diff(found.groups[0], prepend=-1).astype(np.int64)
    return _sums(begins, found.counts[0])


class _Bucket:
    """Documents of some megabytes of text and the pairs they hold."""

    def __init__(self):
        self.size, self.keys, self.numbers, self.digests, self.known, self.uses, self.rows = 0, [], [], [], [], [], 0

    def add(self, keys: pa.Array, found: Aligned, sizes: tuple[int, int], size: int) -> None:
        known, row, place, times = pairs(found, sizes)
        held = np.bincount(row, minlength=len(keys)).astype(np.int64)
        links = _sums(times, held)
        self.numbers.append(np.stack([found.counts[0], found.counts[1], n_groups(found), links, held]))
        self.digests += [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in group_texts(found)]
        self.keys.append(keys)
        self.known.append(known)
        self.uses.append((place, times))
        self.size += size

    def row(self, number: int) -> pa.RecordBatch:
        known = np.unique(np.concatenate(self.known))
        place = np.concatenate([np.searchsorted(known, k)[p] for k, (p, _) in zip(self.known, self.uses, strict=True)])
        times = np.concatenate([t for _, t in self.uses])
        numbers = np.concatenate(self.numbers, axis=1)
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        columns = {"bucket": pa.array([number], pa.int64()), "key": pa.ListArray.from_arrays(pa.array([0, sum(map(len, self.keys))], pa.int32()), pa.concat_arrays(self.keys)),
                   **{name: one(values, pa.int64()) for name, values in zip(NUMBERS, numbers, strict=True)}, "digest": one(self.digests, pa.string()),
                   "pair": one(known, pa.int64()), "pair_docs": one(np.bincount(place, minlength=len(known)), pa.int64()),
                   "use_pair": pa.array([place.astype("<u4").tobytes()], pa.binary()), "use_times": pa.array([times.astype("<u4").tobytes()], pa.binary())}
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_pairs"]


def _shared(docs: DataFrame, a_path: str, b_path: str) -> Broadcast:
    with open(a_path, encoding="utf-8") as file:
        return docs.sparkSession.sparkContext.broadcast((file.read(), PieceModel(b_path)))  # as large as the vocabularies


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of both sides of every row, with groups and overlaps.

    Columns ``id_col``, ``a_ids``, ``b_ids`` (arrays of int), ``a_groups``, ``b_groups`` (group of each
    token, from 0), ``overlap_a``, ``overlap_b`` (places of tokens that share a byte). A row whose text
    is null, empty, or spelled otherwise by a side has empty arrays. Rows are independent, so null or
    repeated ids stay; other columns are ignored; an empty table gives an empty result.
    """
    shared, source = _shared(docs, a_path, b_path), docs.select(id_col, F.col(text_col).cast("string"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = worker_sides(shared)
        for batch in steps(batches, STEP // 2):
            found = align_step(sides, batch.column(1))
            over = found.overlaps()
            a, b = over >> 32, over & (2**32 - 1)
            row, each = found.rows(0)[a], n_groups(found)
            base, many = np.cumsum(each) - each, np.bincount(row, minlength=batch.num_rows)
            first = [np.cumsum(n) - n for n in found.counts]
            out = [listed(x, n, pa.int32()) for x, n in zip(found.ids, found.counts, strict=True)]
            out += [listed(g - base[found.rows(k)], found.counts[k], pa.int32()) for k, g in enumerate(found.groups)]
            out += [listed(x - first[k][row], many, pa.int32()) for k, x in enumerate((a, b))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], ["key", *ARRAYS])

    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, ", ".join([f"key {kind}", *(f"{name} array<int>" for name in ARRAYS)])).withColumnRenamed("key", id_col)


ARRAYS = ["a_ids", "b_ids", "a_groups", "b_groups", "overlap_a", "overlap_b"]


def bucketed(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written buckets of documents: their numbers and digests, distinct pairs, and which pairs each document holds how often."""
    shared, source = _shared(docs, a_path, b_path), docs.select(id_col, F.col(text_col).cast("string"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, bucket, number = worker_sides(shared), _Bucket(), TaskContext.get().partitionId() << 32
        vocabulary = len(sides.sizes[0]), len(sides.sizes[1])
        for batch in steps(batches, STEP // 2):
            found = align_step(sides, batch.column(1))
            bucket.add(batch.column(0), found, vocabulary, pc.sum(pc.binary_length(batch.column(1))).as_py() or 0)
            if bucket.size >= BUCKET:
                yield bucket.row(number)
                bucket, number = _Bucket(), number + 1
        if bucket.keys:
            yield bucket.row(number)

    kind = source.schema[0].dataType.simpleString()
    columns = ["bucket long", f"key array<{kind}>", *(f"{name} array<long>" for name in NUMBERS), "digest array<string>", "pair array<long>", "pair_docs array<long>", "use_pair binary", "use_times binary"]
    return stage(source.mapInArrow(run, ", ".join(columns)))


def pair_counts(buckets: DataFrame) -> DataFrame:
    """``pair`` (A id << 32 | B id), ``n_docs`` and ``best`` (the highest of its A id, ties included) of all linked id pairs."""
    total = _requests(buckets).groupBy("pair").agg(F.sum("pair_docs").alias("n_docs")).withColumn("a", F.shiftright("pair", 32))
    top = F.broadcast(total.groupBy("a").agg(F.max("n_docs").alias("top")))  # one row per id of A's vocabulary
    return total.join(top, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("top")).alias("best"))


def _requests(buckets: DataFrame) -> DataFrame:
    both = F.posexplode(F.arrays_zip("pair", "pair_docs")).alias("place", "x")
    return buckets.select("bucket", both).select("bucket", "place", F.col("x.pair").alias("pair"), F.col("x.pair_docs").alias("pair_docs"))


def links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Numbers of tokens, groups and links of every row, and what its links count in the whole table.

    Columns ``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``. A row counts once
    for an id pair that it holds linked. A row whose text is null, empty, or spelled otherwise by a
    side has zeros and ''. Null or repeated ids stay as rows of their own; an empty table gives none.
    """
    buckets = bucketed(docs, a_path, b_path, id_col, text_col)
    counts = pair_counts(buckets)
    answers = _requests(buckets).join(counts, "pair").groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("place", "n_docs", "best"))).alias("x"))
    answers = answers.select("bucket", F.col("x.n_docs").alias("n_docs"), F.col("x.best").alias("best"))  # a list as long as the bucket's pairs
    kind = buckets.schema["key"].dataType.elementType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part = {name: batch.column(name)[k] for name in batch.schema.names}
                lists = {name: part[name].values for name in ("key", *NUMBERS, "digest")}
                n_docs, best = (part[name].values.to_numpy(zero_copy_only=False) if part[name].is_valid else np.empty(0, np.int64) for name in ("n_docs", "best"))
                place, times = (np.frombuffer(part[name].as_py(), "<u4").astype(np.int64) for name in ("use_pair", "use_times"))
                held = lists["n_pairs"].to_numpy(zero_copy_only=False)
                n_best, total = _sums(times * best[place].astype(np.int64), held), _sums(times * n_docs[place], held)
                yield pa.RecordBatch.from_arrays([lists["key"], *(lists[name] for name in NUMBERS[:4]), pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), lists["digest"]],
                                                 ["key", *NUMBERS[:4], "n_best", "count_sum", "groups_sha256"])

    wide = buckets.select("bucket", "key", *NUMBERS, "digest", "use_pair", "use_times").join(answers, "bucket", "left").drop("bucket")
    out = wide.mapInArrow(run, f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("key", id_col)
