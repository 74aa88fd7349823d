"""Ids of words by the tokenizers library, each distinct word encoded once in a Python worker."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast

from inkweave.llm.text import span_hashes, words

#: Words kept with their ids; beyond it the memory starts anew.
KEPT_WORDS = 1_000_000

Learn = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def library(json: str, special_as_text: bool = False) -> Learn:
    """Encode strings by a tokenizer's JSON text, without special tokens around them."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(json)
    tokenizer.encode_special_tokens = special_as_text

    def learn(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.array([len(x) for x in rows], np.int64)
        return np.array([i for x in rows for i in x], np.int32), counts

    return learn


class WordMemory:
    """Ids of texts from the ids of their words ``[^\\x20\\x09-\\x0D]+``; for tokenizers that drop white space and never join words."""

    def __init__(self, learn: Learn):
        self.learn = learn
        self.known, self.place = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.ids, self.starts, self.counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each row; a null is an empty text."""
        found = words(text)
        if not len(found.starts):
            return self.ids[:0], np.zeros(len(text), np.int64)
        hashes, where, which = np.unique(found.hashes(), return_index=True, return_inverse=True)
        self._learn(found.data, found.starts[where], found.ends[where], hashes)
        which = self.place[np.searchsorted(self.known, hashes)][which]
        each = self.counts[which]
        last = np.cumsum(each)
        ids = self.ids[np.repeat(self.starts[which] - (last - each), each) + np.arange(last[-1])]
        total = np.concatenate([[0], last])
        return ids, np.diff(total[found.first])

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        if len(self.known) > KEPT_WORDS:
            self.__init__(self.learn)
        at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        fresh = np.flatnonzero(self.known[at] != hashes) if len(self.known) else np.arange(len(hashes))
        if not len(fresh):
            return
        ids, counts = self.learn([data[a:b].tobytes().decode() for a, b in zip(starts[fresh].tolist(), ends[fresh].tolist(), strict=True)])
        # Both lists are sorted: insert the fresh ones at their places.
        at = np.searchsorted(self.known, hashes[fresh])
        self.known, self.place = np.insert(self.known, at, hashes[fresh]), np.insert(self.place, at, len(self.counts) + np.arange(len(fresh)))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])


_memories: dict[int, WordMemory] = {}


def worker_memory(shared: Broadcast) -> WordMemory:
    """The memory of this Python worker, which serves many tasks; that of an earlier tokenizer is dropped."""
    json = shared.value
    if id(json) not in _memories:
        _memories.clear()
        _memories[id(json)] = WordMemory(library(json))
    return _memories[id(json)]
