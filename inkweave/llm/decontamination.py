"""Benchmark decontamination by the q-gram lemma.

An occurrence of an item of m bytes with at most k edits keeps m - q + 1 - k q of the item's q-grams,
all on k + 1 neighbouring diagonals (place in the text less place in the item). So the shared
q-grams are counted in diagonal bands that overlap by k, bands below the bound are dropped, and
the others are verified by an alignment within the band. Texts and items are compared with A-Z
lower-cased and white space as one space.

With a ``passage`` length, any so many consecutive bytes of an item are searched for too, by the
same bound and the same edits for each byte: q-grams are counted within windows of the item.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from inkweave.llm.text import raw, steps

Q = 12
#: Edits allowed for each byte of an item.
RATE = 0.07
#: Bytes of an item that are a match by themselves where passages are searched for.
PASSAGE = 50
#: Pieces of items that are aligned at once.
PIECES = 4096
#: Bytes of items that one pass over the documents searches for; more items take more passes.
BLOCK = 16 << 20
_BITS = 1 << 24
_R = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[_SPACE] = 32
_POINT = np.array([b & 0xC0 != 0x80 for b in range(256)])


def normal(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes of all rows, the rows' offsets, where each byte stood, and the raw bytes and offsets."""
    data, offsets = raw(text)
    blank = _SPACE[data]
    before = np.ones(len(data), bool)
    before[1:] = blank[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True  # no space at the start of a row
    at = np.flatnonzero(~(blank & before))
    return _LOWER[data[at]], np.searchsorted(at, offsets), at, data, offsets


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q (at least 8) bytes from each place on."""
    n = len(data) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    data, out = np.ascontiguousarray(data), np.zeros(n, np.uint64)
    # numbers of eight bytes, the last of which may overlap the one before
    for i in sorted({*range(0, q - 7, 8), q - 8}):
        out = (out ^ np.ndarray((n,), "<u8", data, offset=i, strides=(1,))) * np.uint64(_R)
        out ^= out >> np.uint64(29)
    return out


@dataclass
class Items:
    """A block of items: their normalised bytes, edit budgets and bounds, and the index of their q-grams."""

    ids: list
    texts: list[bytes]
    edits: np.ndarray
    least: np.ndarray
    grams: np.ndarray
    heads: np.ndarray
    item: np.ndarray
    place: np.ndarray
    spots: np.ndarray
    size: np.ndarray
    passage: int
    piece_edits: int

    @classmethod
    def of(cls, ids: list, texts: list[str], q: int, rate: float, passage: int = 0) -> Items:
        if 0 < passage < q:
            raise ValueError(f"a passage has {q} bytes at least")
        data, offsets, _, _, _ = normal(pa.array(texts, pa.string()))
        every = [data[a:b].tobytes().rstrip(b" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        long = [i for i, t in enumerate(every) if len(t) >= q]
        ids, every = [ids[i] for i in long], [every[i] for i in long]
        size = np.array([len(t) for t in every], np.int64)
        edits = np.minimum((size * rate).astype(np.int64), (size - q) // q)
        hashes = [gram_hashes(np.frombuffer(t, np.uint8), q) for t in every]
        item = np.repeat(np.arange(len(every)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        grams, heads = np.unique(flat[order], return_index=True)
        spots = np.zeros(_BITS // 8, np.uint8)
        at = (grams % np.uint64(_BITS)).astype(np.int64)
        np.bitwise_or.at(spots, at >> 3, (1 << (at & 7)).astype(np.uint8))
        piece_edits = min(int(passage * rate), (passage - q) // q) if passage else 0
        return cls(ids, every, edits, size - q + 1 - edits * q, grams, np.append(heads, len(flat)), item[order], place[order], spots, size, passage, piece_edits)

    def find(self, text: pa.Array, q: int) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start, end, edits) of the best occurrence of each item, or else passage of it, in each row; places in code points."""
        data, offsets, at, source, source_offsets = normal(text)
        hashes = gram_hashes(data, q)
        if not len(hashes) or not len(self.grams):
            return []
        spot = (hashes & np.uint64(_BITS - 1)).astype(np.int32)
        where = np.flatnonzero(self.spots[spot >> 3] >> (spot & 7).astype(np.uint8) & 1)
        gram = np.minimum(np.searchsorted(self.grams, hashes[where]), len(self.grams) - 1)
        real = self.grams[gram] == hashes[where]
        where, gram = where[real], gram[real]
        row = np.searchsorted(offsets, where, "right") - 1
        real = where + q <= offsets[row + 1]
        where, gram, row = where[real], gram[real], row[real]
        # rows with fewer shared places than any item's bound are out
        floor = int(self.least.min())
        if self.passage and self.size.max() > self.passage:
            floor = min(floor, self.passage - q + 1 - self.piece_edits * q)
        enough = np.bincount(row, minlength=len(text))[row] >= floor
        where, gram, row = where[enough], gram[enough], row[enough]
        if not len(where):
            return []
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        count = self.heads[gram + 1] - self.heads[gram]
        ends = np.cumsum(count)
        start = 0
        while start < len(where):  # whole rows, a bounded number of hits at a time or one row
            stop = max(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (1 << 21), "right")), start + 1)
            stop = int(np.searchsorted(row, row[stop - 1], "right"))
            hits = where[start:stop], gram[start:stop], row[start:stop], offsets
            found = {}
            for r, i, edits, a, b in self._verified(self._bands(*hits), data, offsets):
                if (r, i) not in found or (edits, a) < found[r, i][:2]:
                    found[r, i] = (edits, a, b)
            whole = set(found)
            for r, i, edits, a, b in self._passages(*hits, q, data, whole) if self.passage else ():
                if (r, i) not in found or (edits, a) < found[r, i][:2]:
                    found[r, i] = (edits, a, b)
            best |= found
            start = stop
        points = np.concatenate([[0], np.cumsum(_POINT[source])])
        place = lambda r, x: int(points[x] - points[source_offsets[r]])
        return [(r, i, place(r, at[a]), place(r, at[b - 1] + 1), edits) for (r, i), (edits, a, b) in sorted(best.items())]

    def _banded(self, where: np.ndarray, gram: np.ndarray, row: np.ndarray, offsets: np.ndarray, budget: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, item, first diagonal and place of the distinct places of each band in order, and where a band begins; ``budget``: edits of each item."""
        count = self.heads[gram + 1] - self.heads[gram]
        post = np.repeat(self.heads[gram] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        item, place, row = self.item[post], self.place[post], np.repeat(row, count)
        diagonal = np.repeat(where, count) - offsets[row] - place + self.size[item]  # not negative
        width = budget[item] + 16
        band = diagonal // width
        lower = np.flatnonzero((diagonal % width < budget[item]) & (band > 0))
        row, item, place, band = (np.concatenate([x, x[lower]]) for x in (row, item, place, band))
        band[len(band) - len(lower) :] -= 1
        order = np.lexsort((place, band, item, row))
        row, item, place, band = row[order], item[order], place[order], band[order]
        new_band = np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])])
        new = new_band | np.concatenate([[True], place[1:] != place[:-1]])
        row, item, place, band = row[new], item[new], place[new], band[new]
        return row, item, band * (budget[item] + 16) - self.size[item], place, new_band[new]

    def _bands(self, where: np.ndarray, gram: np.ndarray, row: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, first diagonal) of the bands that share enough q-grams."""
        row, item, first, _, new_band = self._banded(where, gram, row, offsets, self.edits)
        heads = np.flatnonzero(new_band)
        good = heads[np.diff(np.append(heads, len(row))) >= self.least[item[heads]]]
        return list(zip(row[good].tolist(), item[good].tolist(), first[good].tolist(), strict=True))

    def _passages(self, where: np.ndarray, gram: np.ndarray, row: np.ndarray, offsets: np.ndarray, q: int, data: np.ndarray, whole: set[tuple[int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, edits, start, end) of pieces of ``passage`` bytes, of items not found whole; places in the normalised bytes."""
        k, length = self.piece_edits, self.passage
        row, item, first, place, new_band = self._banded(where, gram, row, offsets, np.full(len(self.ids), k))
        least = length - q + 1 - k * q
        at = np.arange(max(len(row) - least + 1, 0))
        band = np.cumsum(new_band)
        last = at + least - 1
        # windows of the item that hold enough shared places lie around each run of that many
        at = at[(band[at] == band[last]) & (place[last] - place[at] <= length - q) & (self.size[item[at]] > length)]
        low, high = np.maximum(place[at + least - 1] + q - length, 0), np.minimum(place[at], self.size[item[at]] - length)
        same = np.flatnonzero(band[at[1:]] == band[at[:-1]]) + 1
        low[same] = np.maximum(low[same], high[same - 1] + 1)
        some = np.array([h >= s and pair not in whole for s, h, pair in zip(low, high, zip(row[at].tolist(), item[at].tolist(), strict=True), strict=True)], bool)
        at, low, high = at[some], low[some], high[some]
        count = high - low + 1
        ends = np.cumsum(count)
        width, start = 16 + 4 * k, 0
        while start < len(at):
            stop = max(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PIECES, "right")), start + 1)
            own = np.repeat(np.arange(start, stop), count[start:stop])
            begins = low[own] + np.arange(len(own)) - (ends - count)[own] + (ends - count)[start]
            own = at[own]
            pieces = np.stack([np.frombuffer(self.texts[i], np.uint8, length, s) for i, s in zip(item[own].tolist(), begins.tolist(), strict=True)])
            begin, end = offsets[row[own]], offsets[row[own] + 1]
            left = begin + first[own] + begins - k
            spot = left[:, None] + np.arange(length + width + 1)
            inside = (spot >= begin[:, None]) & (spot < end[:, None])
            text = np.where(inside, data[np.clip(spot, 0, len(data) - 1)].astype(np.int16), -1)  # -1 matches nothing
            edits, a, b = align_all(pieces, text, width)
            for j in np.flatnonzero(edits <= k).tolist():
                yield int(row[own[j]]), int(item[own[j]]), int(edits[j]), int(min(max(left[j] + a[j], begin[j]), end[j] - 1)), int(min(max(left[j] + b[j], begin[j] + 1), end[j]))
            start = stop

    def _verified(self, bands: list[tuple[int, int, int]], data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, edits, start, end) of bands with an alignment within the budget; places in the normalised bytes."""
        for row, item, first in bands:
            pattern, k = np.frombuffer(self.texts[item], np.uint8), int(self.edits[item])
            low, width = first - k, 16 + 4 * k
            begin, end = int(offsets[row]), int(offsets[row + 1])
            text = np.zeros(len(pattern) + width + 1, np.uint8)  # 0 matches nothing
            a, b = max(begin, begin + low), min(end, begin + low + len(text))
            if a < b:
                text[a - begin - low : b - begin - low] = data[a:b]
            exact = text.tobytes().find(self.texts[item])  # without edits the main diagonal is enough
            found = (0, exact, exact + len(pattern)) if exact >= 0 else align(pattern, text, width)
            if found and found[0] <= k:
                edits, start, stop = found
                yield row, item, edits, min(max(begin + low + start, begin), end - 1), min(max(begin + low + stop, begin + 1), end)


def align(pattern: np.ndarray, text: np.ndarray, width: int) -> tuple[int, int, int]:
    """Least edits, start and end of the pattern in the text, over alignments on the diagonals 0 to ``width``."""
    edits, start, end = align_all(pattern[None], text[None], width)
    return int(edits[0]), int(start[0]), int(end[0])


def align_all(patterns: np.ndarray, texts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``align`` of every pattern with its text, all of one length."""
    step = np.arange(width + 1)
    # edits and start in one number: fewer edits, then the later start
    unit = 1 << 32
    cost, slope, down = np.tile((unit >> 1) - step, (len(patterns), 1)), unit * step, np.full((len(patterns), width + 1), 1 << 61)
    for j in range(patterns.shape[1]):
        down[:, :-1] = cost[:, 1:] + unit
        cost = np.minimum(cost + unit * (texts[:, j : j + width + 1] != patterns[:, j, None]), down)
        cost = np.minimum.accumulate(cost - slope, axis=1) + slope
    best = cost.argmin(axis=1)
    cost = cost[np.arange(len(cost)), best]
    edits = (cost + unit // 4) // unit
    return edits, (unit >> 1) - (cost - edits * unit), patterns.shape[1] + best


def blocks(benchmark: DataFrame, item_col: str, text_col: str, q: int, rate: float, block: int = BLOCK, passage: int = 0) -> Iterator[Items]:
    """The items in blocks of about ``block`` bytes; null texts and items under q bytes cannot be searched for."""
    used = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    total = used.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // block))
    for i in range(count):
        rows = used.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == i).distinct().orderBy("item", "text").collect()
        yield Items.of([r["item"] for r in rows], [r["text"] for r in rows], q, rate, passage)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE, passage: int = 0) -> DataFrame:
    """``id_col``, ``item_col``, start_at, end_at (code points of the text), edits: the best place of every item in every row that holds it.

    Whole texts are searched; rows without a text or a match give nothing. Repeated rows give their
    matches again, null ids stay, an item id with several texts is searched for with each; other
    columns are ignored; an empty table on either side gives an empty result. With ``passage``, an
    item that a row does not hold whole gives its best ``passage`` consecutive bytes, if there.
    """
    source = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    key, item = source.schema["key"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    for items in blocks(benchmark, item_col, item_text, q, rate, passage=passage):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # at most about BLOCK bytes of items

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in steps(batches):
                found = shared.value.find(batch.column(1), q)
                if found:
                    row, which, start, end, edits = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([shared.value.ids[i] for i in which], item_type), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int32())],
                                                     ["key", "item", "start_at", "end_at", "edits"])

        part = source.mapInArrow(run, f"key {key}, item {item}, start_at long, end_at long, edits int")
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("key", id_col).withColumnRenamed("item", item_col)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE, passage: int = 0) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item, and with ``passage`` no so many consecutive bytes of one."""
    out = docs
    for items in blocks(benchmark, item_col, item_text, q, rate, passage=passage):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        place = docs.columns.index(text_col)

        def run(batches: Iterable[pa.RecordBatch], shared=shared, place=place) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                named = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(place)], ["i", "text"])
                keep = np.ones(batch.num_rows, bool)
                for part in steps([named]):
                    for row, *_ in shared.value.find(part.column(1), q):
                        keep[part.column(0)[row].as_py()] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
