"""Substring dedup by super-k-mers.

A window is WINDOW consecutive words; its minimiser is the least hash of the GRAM-word runs in it.
Consecutive windows with one minimiser travel as one packed string of words to the minimiser's
bucket, equal strings once. There the words get exact codes, the windows of all strings are sorted,
and each learns the least id that holds it. The answer for a string is joined with its holders.

Two fixed-size bitmaps of minimisers come first. One spares windows whose minimiser only one
document has: they cannot repeat. The other marks minimisers that more than HOT documents share:
their windows travel one by one, dealt by the whole window, so that no bucket holds them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.text import buckets_for, grams, mix, powers, steps, words

WINDOW, GRAM = 50, 8
#: Documents with one minimiser beyond which its windows are dealt one by one.
HOT = 50_000
#: Bits of each bitmap (8 MB whatever the data).
BITS = 1 << 26
#: Stands for a null id; smaller than any other.
NO_ID = -(2**63)
_R = 0xD6E8FEB86659FD93


def minimisers(hashes: np.ndarray, rows: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimiser of each whole window, and the index of the window's first word."""
    if len(hashes) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    runs = np.zeros(len(hashes) - gram + 1, np.uint64)
    for i in range(gram):
        runs = mix(runs * np.uint64(31) + hashes[i : i + len(runs)])
    wide, least, span = window - gram + 1, runs, 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = wide - span
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    whole = np.flatnonzero(rows[: len(hashes) - window + 1] == rows[window - 1 :])
    return least[whole], whole


def _spot(values: np.ndarray) -> np.ndarray:
    return (values % np.uint64(BITS)).astype(np.int64)


def _bitmaps(docs: DataFrame, window: int, gram: int, hot: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the minimisers of several documents, and of those of more than ``hot``."""
    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = words(batch.column(1))
            least, at = minimisers(found.hashes(), found.rows, window, gram)
            row = found.rows[at].astype(np.uint64)
            new = np.ones(len(least), bool)
            new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
            least, row = least[new], row[new]
            order = np.lexsort((row, least))
            least, row = least[order], row[order]
            new = np.ones(len(least), bool)
            new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
            value, docs_ = np.unique(least[new], return_counts=True)
            of = (value % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            names, cuts = np.unique(of[order], return_index=True)
            if len(names):
                parts = np.split(order, cuts[1:])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([value[x].tobytes() for x in parts], pa.binary()), pa.array([docs_[x].astype(np.int32).tobytes() for x in parts], pa.binary())],
                                                 ["bucket", "minimisers", "docs"])

    def count(table: pa.Table) -> pa.Table:
        value = np.frombuffer(b"".join(table["minimisers"].to_pylist()), np.uint64)
        value, which = np.unique(value, return_inverse=True)
        total = np.bincount(which, np.frombuffer(b"".join(table["docs"].to_pylist()), np.int32), len(value))
        keep = total > 1
        return pa.table({"spot": pa.array(_spot(value[keep])), "hot": pa.array(total[keep] > hot)})

    sent = docs.select("id", "text").mapInArrow(send, "bucket int, minimisers binary, docs binary")
    spots = sent.groupBy("bucket").applyInArrow(count, "spot long, hot boolean").withColumn("spot", F.col("spot") + 1)
    maps = spots.groupBy(F.bitmap_bucket_number("spot").alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("shared"), F.bitmap_construct_agg(F.when(F.col("hot"), F.bitmap_bit_position("spot"))).alias("hot"))
    shared, often = np.zeros(BITS // 8, np.uint8), np.zeros(BITS // 8, np.uint8)
    for r in maps.toLocalIterator():  # at most BITS / 32768 maps of 4 KB
        at = slice((r["k"] - 1) * 4096, r["k"] * 4096)
        shared[at], often[at] = np.frombuffer(bytes(r["shared"]), np.uint8), np.frombuffer(bytes(r["hot"]), np.uint8)
    return shared, often


def _has(bitmap: np.ndarray, spot: np.ndarray) -> np.ndarray:
    return (bitmap[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)


def _pieces(text: pa.Array, shared: np.ndarray, often: np.ndarray, window: int, gram: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The super-k-mers of a step that travel: packed words, hash of their bucket's key, row, first word within the row."""
    found = words(text)
    least, at = minimisers(found.hashes(), found.rows, window, gram)
    spot = _spot(least)
    travels = _has(shared, spot)
    least, at, hot = least[travels], at[travels], _has(often, spot[travels])
    if not len(at):
        return [], np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    row = found.rows[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | hot[1:]
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(at)) - 1
    size = found.ends - found.starts
    packed_ends = np.cumsum(size + 1) - 1
    packed_starts = packed_ends - size
    source = np.repeat(found.starts - packed_starts, size + 1) + np.arange(int((size + 1).sum()))
    packed = found.data[np.minimum(source, len(found.data) - 1)]
    packed[packed_ends] = 32
    data = packed.tobytes()
    first, last = at[heads], at[tails] + window - 1
    out = [data[a:b] for a, b in zip(packed_starts[first].tolist(), packed_ends[last].tolist(), strict=True)]
    key = least[heads]
    if hot.any():
        digest = np.array([int.from_bytes(hashlib.blake2b(out[i], digest_size=8).digest(), "little") for i in np.flatnonzero(hot[heads])], np.uint64)
        key = key.copy()
        key[hot[heads]] = digest
    return out, key, row[heads], first - found.first[row[heads]]


def first_holders(strings: pa.Array, ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each string (words parted by one space) the least id of a string that holds it; windows of each string."""
    found = words(strings)
    size = found.ends - found.starts
    solid = np.repeat(found.starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    data = found.data[solid]
    exact = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode().indices.to_numpy().astype(np.int64)
    counts = np.diff(found.first) - window + 1
    starts = np.repeat(found.first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(exact.astype(np.uint64)) * powers(_R, len(exact)), dtype=np.uint64)])
    hashed = (total[starts + window] - total[starts]) * powers(pow(_R, -1, 2**64), len(exact))[starts]
    order = np.argsort(hashed, kind="stable")
    ranked, holder = starts[order], np.repeat(ids, counts)[order]
    same = hashed[order][1:] == hashed[order][:-1]
    for i in range(window):  # equal hashes are compared word by word
        pairs = np.flatnonzero(same)
        if not np.array_equal(exact[ranked[pairs] + i], exact[ranked[pairs + 1] + i]):
            whole = np.stack([exact[starts + j] for j in range(window)], axis=1)
            order = np.lexsort(whole.T[::-1])
            ranked, holder = starts[order], np.repeat(ids, counts)[order]
            same = (whole[order][1:] == whole[order][:-1]).all(axis=1)
            break
    heads = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.zeros(0, np.int64)
    out = np.empty(len(order), np.int64)
    if len(order):
        out[order] = np.repeat(np.minimum.reduceat(holder, heads), np.diff(np.append(heads, len(order))))
    return out, counts


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``id_col``, ``kept`` (kept words joined by one space), n_words, n_removed of every row.

    A word is removed if a window of ``window`` words that covers it also starts in a row with a
    smaller id; windows are those of the input. Ids are integers; a null id is smaller than all
    others. Rows with one id do not remove each other's words. A null text or one without words
    keeps nothing; a text with fewer words than a window loses nothing. Other columns are ignored;
    an empty table gives an empty result.
    """
    buckets = buckets_for(docs, text_col)
    named = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(_bitmaps(named, window, gram, hot, buckets))

    def strings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            pieces, key, row, _ = _pieces(batch.column(1), *shared.value, window, gram)
            ids = batch.column(0).to_numpy()[row] if len(row) else np.empty(0, np.int64)
            low: dict[bytes, tuple[int, int, int]] = {}
            for p, k, i in zip(pieces, (key % np.uint64(buckets)).tolist(), ids.tolist(), strict=True):
                known = low.get(p)
                low[p] = (k, i, i) if known is None else (k, min(i, known[1]), max(i, known[2]))
            if low:
                k, a, b = zip(*low.values(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(list(low), pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["bucket", "piece", "low", "high"])

    def sort(table: pa.Table) -> pa.Table:
        pieces, low, high = table["piece"].combine_chunks(), table["low"].to_numpy(), table["high"].to_numpy()
        pieces = pieces.chunk(0) if isinstance(pieces, pa.ChunkedArray) else pieces
        first, counts = first_holders(pieces.cast(pa.large_string()), low, window)
        # a string tells nothing if its only holder is the first of all its windows
        ends = np.cumsum(counts)
        of = np.repeat(np.arange(len(counts)), counts)
        tells = (low != high) | (np.bincount(of, first < low[of], len(counts)) > 0)
        keep = np.repeat(tells, counts)
        names = [hashlib.blake2b(p, digest_size=16).digest() for p in pc.filter(pieces, pa.array(tells)).to_pylist()]
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts[tells])]).astype(np.int32))
        assert ends[-1] == len(first)
        return pa.table({"name": pa.array(names, pa.binary()), "first": pa.ListArray.from_arrays(offsets, pa.array(first[keep]))})

    def holders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            pieces, _, row, start = _pieces(batch.column(1), *shared.value, window, gram)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(p, digest_size=16).digest() for p in pieces], pa.binary()), batch.column(0).take(take), batch.column(2).take(take), pa.array(start, pa.int32())],
                                             ["name", "id", "body", "start"])

    once = named.mapInArrow(strings, "bucket int, piece binary, low long, high long").groupBy("bucket", "piece").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    answers = once.groupBy("bucket").applyInArrow(sort, "name binary, first array<long>")
    bodied = named.withColumn("body", F.xxhash64("text"))
    held = bodied.mapInArrow(holders, "name binary, id long, body long, start int").join(answers, "name")
    again = F.array_compact(F.transform("first", lambda x, i: F.when(x < F.col("id"), F.col("start") + i)))
    removed = held.select("id", "body", again.alias("at")).where(F.size("at") > 0).groupBy("id", "body").agg(F.flatten(F.collect_set("at")).alias("at"))
    source = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).withColumn("id", F.coalesce(F.col("key").cast("long"), F.lit(NO_ID))).withColumn("body", F.xxhash64("text"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = words(batch.column(1))
            n = len(found.starts)
            cover = np.zeros(n + 1, np.int64)
            at = batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(at), 0).to_numpy(zero_copy_only=False))
            begin = found.first[row] + at.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + window, -1)
            stays = np.cumsum(cover[:-1]) == 0
            total = np.diff(found.first)
            left = np.concatenate([[0], np.cumsum(stays)])[found.first]
            kept = np.diff(left)
            size = found.ends[stays] - found.starts[stays]
            ends = np.cumsum(size + 1)
            source_at = np.repeat(found.starts[stays] - (ends - size - 1), size + 1) + np.arange(ends[-1] if len(ends) else 0)
            data = found.data[np.minimum(source_at, max(len(found.data) - 1, 0))] if len(ends) else np.zeros(0, np.uint8)
            if len(ends):
                data[ends - 1] = 32
            bounds = np.concatenate([[0], ends])[left]
            whole = data.tobytes()
            texts = [whole[a : max(a, b - 1)].decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(total - kept, pa.int64())], ["key", "kept", "n_words", "n_removed"])

    kind = source.schema["key"].dataType.simpleString()
    joined = source.join(removed, (source["id"] == removed["id"]) & source["body"].eqNullSafe(removed["body"]), "left").select("key", "text", "at")
    return joined.mapInArrow(cut, f"key {kind}, kept string, n_words long, n_removed long").withColumnRenamed("key", id_col)
