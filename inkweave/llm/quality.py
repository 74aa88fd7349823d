"""Line-first quality rules: lines that fail are removed, then documents that lost too much are rejected."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkweave.llm.text import grams, mix, raw, span_hashes, steps, words

#: Phrases of a boilerplate line, lower case.
BOILERPLATE = ["all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "accept cookies", "enable javascript", "lorem ipsum",
               "subscribe to our newsletter", "sign in to continue", "click here"]
#: Signs that part the entries of a navigation line when they stand alone.
SEPARATORS = ["|", ">", "<", "»", "«", "•", "·", "/", "\\", "::", "->"]
#: Signs of running text; any other ASCII sign is odd.
PLAIN_SIGNS = ".,;:!?'\"()-"
#: Words of a line that may be separators, bytes that may be odd signs, words that may carry a doubled closing sign.
SEPARATOR_SHARE, ODD_SHARE, SHOUT_SHARE = 0.2, 0.1, 0.3
#: Words of a document that its failed lines may hold.
LOST_SHARE = 0.3

_SYMBOL = np.zeros(256, np.int8)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_LETTER = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)])
_ODD = np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) not in PLAIN_SIGNS for b in range(256)])
_POINT = np.array([b & 0xC0 != 0x80 for b in range(256)])
_CLOSE = np.array([chr(b) in "!?" for b in range(256)])


def _per(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring bounds."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _scan(text: pa.Array) -> dict[str, np.ndarray | pa.Array]:
    data, offsets = raw(text)
    found = words(text)
    n, rows = len(text), found.rows
    hashes = found.hashes()
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, found.starts, 1)
    np.add.at(inside, found.ends, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8)

    three, at = grams(hashes, rows, 3)
    _, which, times = np.unique(mix(three ^ mix(rows[at].astype(np.uint64))), return_inverse=True, return_counts=True)
    again = at[times[which] > 1] if len(at) else at
    covered = np.zeros(len(hashes), np.int8)
    for i in range(3):
        covered[again + i] = 1

    # lines: cut after every \n and at row ends
    cut = np.zeros(len(data) + 1, bool)
    cut[np.flatnonzero(data == 10) + 1] = True
    cut[offsets] = True
    heads = np.flatnonzero(cut[:-1]) if len(data) else np.zeros(0, np.int64)
    tails = np.append(heads[1:], len(data)) if len(heads) else heads
    line_row = np.searchsorted(offsets, heads, "right") - 1
    bounds = np.append(heads, len(data))
    word_bounds = np.searchsorted(found.starts, bounds)
    n_words = np.diff(word_bounds)

    real = np.flatnonzero(n_words)
    ends = tails - (data[np.maximum(tails - 1, 0)] == 10) if len(data) else tails
    line_hash = mix(span_hashes(data, heads[real], ends[real]) ^ mix(line_row[real].astype(np.uint64)))
    distinct, first = np.unique(line_hash, return_index=True)
    repeated = np.ones(len(real), np.int64)
    repeated[first] = 0

    size = found.ends - found.starts
    lone = np.zeros(len(size), bool)
    for sign in map(str.encode, SEPARATORS):
        same = np.flatnonzero(size == len(sign))
        for i, byte in enumerate(sign):
            same = same[data[found.starts[same] + i] == byte]
        lone[same] = True
    shouts = _CLOSE[data[found.ends - 1]] & (size > 2) & _CLOSE[data[np.maximum(found.ends - 2, 0)]] if len(size) else lone
    visible = _per(inside, bounds)
    boiler = np.zeros(len(heads), bool)
    for match in _BOILERPLATE.finditer(data.tobytes().lower()):
        boiler[np.searchsorted(heads, match.start(), "right") - 1] = True
    failed = (n_words > 0) & ((_per(_LETTER[data], bounds) == 0) | (_per(_ODD[data], bounds) > ODD_SHARE * visible)
                              | (_per(lone, word_bounds) > SEPARATOR_SHARE * n_words) | (_per(shouts, word_bounds) > SHOUT_SHARE * n_words) | boiler & (n_words <= 30))
    lost = np.bincount(line_row[failed], n_words[failed], n).astype(np.int64)
    keep = np.repeat(~failed, tails - heads)
    kept_bytes = _per(keep, offsets)
    ends_kept = np.concatenate([[0], np.cumsum(kept_bytes)])
    cleaned = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(ends_kept), pa.py_buffer(data[keep].copy())]).cast(pa.string())
    return {"n_words": np.diff(found.first), "word_chars": _per(inside * _POINT[data], offsets), "n_symbols": _per(_SYMBOL[data], offsets),
            "n_dup_lines": np.bincount(line_row[real], repeated, n).astype(np.int64), "n_repeat_words": _per(covered, found.first),
            "lost_words": lost, "failed_lines": np.bincount(line_row[failed], minlength=n), "cleaned": cleaned}


_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)).encode())
_LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words", "failed_lines"]


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, cleaned text and verdict of every row.

    Returns ``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_words,
    failed_lines (all long), ``cleaned`` (the text without its failed lines), ``base_failed`` and
    ``kept`` (false if base_failed or more than LOST_SHARE of the words stood in failed lines).
    A null or empty text has no words and fails. Rows are independent: repeated rows and null ids
    stay, other columns are ignored, an empty table gives an empty result.
    """
    source = docs.select(id_col, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            out = _scan(batch.column(1))
            count, repeat = out["n_words"], out["n_repeat_words"]
            failed = (count < 50) | (100 * repeat > 50 * count)
            kept = ~failed & (out["lost_words"] <= LOST_SHARE * count)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[c], pa.int64()) for c in _LONGS], out["cleaned"], pa.array(failed), pa.array(kept)],
                                             ["key", *_LONGS, "cleaned", "base_failed", "kept"])

    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, {', '.join(c + ' long' for c in _LONGS)}, cleaned string, base_failed boolean, kept boolean").withColumnRenamed("key", id_col)
