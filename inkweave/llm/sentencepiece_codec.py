"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The symbols of all words of a step lie in one flat array. A round looks up the rank of every
adjacent pair, takes the smallest rank of each word, merges that word's leftmost pairs of this
rank at once, and closes the gaps; words without a mergeable pair leave. A merge whose new
neighbour pair would come before the word's next pair ends the word's round there, so the order
of merges is that of a sequential encoder. Words met before are not merged again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame

from inkweave.llm.text import STEP, listed, raw, span_hashes, steps

NONE = np.int32(2**31 - 1)
SPACE = "▁"
#: Words kept with their ids in one Python worker; beyond it the memory of words starts anew.
KEPT_WORDS = 300_000
#: Rounds after which a word (a run of thousands of equally ranked pairs) is merged pair by pair.
ROUNDS = 128


class PieceModel:
    """Pieces, pair ranks and byte pieces of a BPE model file with byte fallback, as arrays that a broadcast can carry."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        ids = range(self.size)
        normal = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.id_of = {model.id_to_piece(i): i for i in normal}
        if len(model.encode("  a")) and model.id_to_piece(model.encode("  a")[0])[:1] != SPACE:
            raise ValueError("only models with a dummy prefix and kept white space are supported")
        self.bytes_at = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        scores = {p: model.get_score(i) for p, i in self.id_of.items()}
        rank = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        keys, ranks, made = [], [], []
        for piece, i in self.id_of.items():
            for cut in range(1, len(piece)):
                left, right = self.symbol(piece[:cut]), self.symbol(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ranks.append(rank[scores[piece]])
                    made.append(i)
        self._fill(np.array(keys, np.int64), np.array(ranks, np.int32), np.array(made, np.int32))
        inner = {c for p in self.id_of if len(p) > 1 for c in p}
        #: Words start at a space after something else; characters of no longer piece stand alone.
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        self.kinds = np.zeros(256, np.int8)
        self.kinds[[b for b in range(32) if chr(b) not in inner]] = 2
        self.kinds[32] = 1
        self.control = np.array([model.is_control(i) for i in ids])
        self.byte = np.array([model.is_byte(i) for i in ids])
        shown = [b"" if self.control[i] else b" \xe2\x81\x87 " if model.is_unknown(i) else bytes([int(model.id_to_piece(i)[3:5], 16)]) if self.byte[i]
                 else model.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]
        self.blank = np.array([not self.byte[i] and model.id_to_piece(i)[:1] == SPACE for i in ids])
        self.lengths = np.array([len(x) for x in shown], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.pool = np.frombuffer(b"".join(shown), np.uint8)
        points = np.arange(0x110000, dtype=np.int32) + self.size
        for piece, i in self.id_of.items():
            if len(piece) == 1:
                points[ord(piece)] = i
        self.points = points[:0x10000]  # beyond it the few pieces are looked up one by one
        self.far = {ord(p): i for p, i in self.id_of.items() if len(p) == 1 and ord(p) >= 0x10000}

    def symbol(self, piece: str) -> int | None:
        """Id of a piece; a character that is no piece is a symbol above all ids."""
        return self.id_of.get(piece, self.size + ord(piece) if len(piece) == 1 else None)

    def _fill(self, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray) -> None:
        self.bits = max(10, int(len(keys) * 4).bit_length())
        self.keys, self.ranks, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32), np.zeros(1 << self.bits, np.int32)
        left, probe = np.arange(len(keys)), 0
        while len(left):
            at = (self._slot(keys[left]) + probe) & ((1 << self.bits) - 1)
            free = np.flatnonzero(self.keys[at] == -1)
            at_free, which = np.unique(at[free], return_index=True)
            put = left[free[which]]
            self.keys[at_free], self.ranks[at_free], self.made[at_free] = keys[put], ranks[put], made[put]
            left, probe = np.setdiff1d(left, put), probe + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair; rank NONE if the pair makes no piece."""
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        found, rank, made = self.keys[at], self.ranks[at], self.made[at]
        wrong = found != keys
        rank[wrong] = NONE
        todo = np.flatnonzero(wrong & (found != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[todo]]
            good = found == keys[todo]
            hit = todo[good]
            rank[hit], made[hit] = self.ranks[at[hit]], self.made[at[hit]]
            todo = todo[~good & (found != -1)]
        return rank, made

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int32)
        far = points >= 0x10000
        out = self.points[np.where(far, 0, points)]
        if far.any():
            out[far] = [self.far.get(int(c), self.size + int(c)) for c in points[far]]
        return out

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of ascending words until no pair is left."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for turn in range(ROUNDS + 1):
            if not len(symbols):
                break
            n = len(symbols)
            same = word[:-1] == word[1:]
            rank, made = np.full(n, NONE, np.int32), np.zeros(n, np.int32)
            inside = np.flatnonzero(same)
            rank[inside], made[inside] = self.pairs(symbols[inside], symbols[inside + 1])
            heads = np.concatenate([[0], np.flatnonzero(~same) + 1])
            sizes = np.diff(np.append(heads, n))
            low = np.minimum.reduceat(rank, heads)
            over = np.repeat(low == NONE, sizes)
            if over.any():
                done.append((symbols[over], word[over]))
                symbols, word, rank, made = symbols[~over], word[~over], rank[~over], made[~over]
                sizes, low = sizes[low != NONE], low[low != NONE]
                n = len(symbols)
                if not n:
                    break
            if turn == ROUNDS:
                cuts = np.cumsum(sizes)[:-1]
                for part, of in zip(np.split(symbols, cuts), np.split(word, cuts), strict=True):
                    part = self._one_by_one(part)
                    done.append((part, np.full(len(part), of[0])))
                break
            low = np.repeat(low, sizes)
            equal = rank == low
            # in a run of equal pairs every second one, from the left
            begins = equal & ~np.concatenate([[False], equal[:-1]])
            last = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
            chosen = np.flatnonzero(equal & ((np.arange(n) - last) % 2 == 0))
            new, picked = made[chosen], np.zeros(n, bool)
            picked[chosen] = True
            # what the merge would make a pair with, as a sequential encoder meets it
            before = np.maximum(chosen - 1, 0)
            merged_before = (chosen >= 2) & picked[np.maximum(chosen - 2, 0)] & (word[np.maximum(chosen - 2, 0)] == word[chosen])
            prior = np.where(merged_before, made[np.maximum(chosen - 2, 0)], symbols[before])
            after = np.minimum(chosen + 2, n - 1)
            sooner = np.zeros(len(chosen), bool)
            for side, others, first, second in ((before, (chosen > 0), prior, new), (after, (chosen + 2 < n), new, symbols[after])):
                real = np.flatnonzero(others & (word[side] == word[chosen]))
                sooner[real] |= self.pairs(first[real], second[real])[0] <= low[chosen[real]]
            if sooner.any():
                of = word[chosen]
                start = np.concatenate([[True], of[1:] != of[:-1]])
                seen = np.cumsum(sooner) - sooner
                keep = seen == np.repeat(seen[start], np.diff(np.append(np.flatnonzero(start), len(of))))
                chosen, new = chosen[keep], new[keep]
            symbols = symbols.copy()
            symbols[chosen] = new
            stays = np.ones(n, bool)
            stays[chosen + 1] = False
            symbols, word = symbols[stays], word[stays]
        if not done:
            return symbols, word
        symbols, word = np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _one_by_one(self, symbols: np.ndarray) -> np.ndarray:
        """The same merges from a heap, for one long run of equally ranked pairs."""
        n = len(symbols)
        value, following, prior, version = symbols.tolist(), [*range(1, n), -1], [*range(-1, n - 1)], [0] * n
        heap: list[tuple[int, int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            rank, made = self.pairs(np.array([value[i]]), np.array([value[j]]))
            if rank[0] != NONE:
                heapq.heappush(heap, (int(rank[0]), i, j, version[i], version[j], int(made[0])))

        ranks, _ = self.pairs(symbols[:-1], symbols[1:])
        for i in np.flatnonzero(ranks != NONE).tolist():
            offer(i, i + 1)
        while heap:
            _, i, j, at_i, at_j, made = heapq.heappop(heap)
            if version[i] != at_i or version[j] != at_j:
                continue
            value[i], version[i], version[j], following[i] = made, version[i] + 1, -1, following[j]
            if following[i] != -1:
                prior[following[i]] = i
                offer(i, following[i])
            if prior[i] != -1:
                offer(prior[i], i)
        return np.array([v for v, alive in zip(value, version, strict=True) if alive != -1], np.int32)

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and the number of ids of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols, word = self.merge(self.symbols("".join(words)), np.repeat(np.arange(len(words)), sizes))
        rare = symbols >= self.size
        if not rare.any():
            return symbols, np.bincount(word, minlength=len(words))
        spelled = {c: self.bytes_at[list(chr(c - self.size).encode())] for c in np.unique(symbols[rare]).tolist()}
        length = np.ones(len(symbols), np.int64)
        length[rare] = [len(spelled[c]) for c in symbols[rare].tolist()]
        out = np.repeat(symbols, length)
        out[np.repeat(rare, length)] = np.concatenate([spelled[c] for c in symbols[rare].tolist()])
        return out, np.bincount(np.repeat(word, length), minlength=len(words))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Text of each row of ids. Invalid bytes become U+FFFD one by one."""
        heads = np.cumsum(counts) - counts
        starts, lengths = self.offsets[ids], self.lengths[ids]
        seen = ~self.control[ids]
        place = np.flatnonzero(seen)
        at = np.searchsorted(place, heads)
        first = place[np.minimum(at, max(len(place) - 1, 0))] if len(place) else np.zeros(0, np.int64)
        if len(first):
            first = first[(at < len(place)) & (first < heads + counts)]
            first = first[self.blank[ids[first]]]
            starts[first] += 1
            lengths[first] -= 1
        ends = np.cumsum(lengths)
        data = self.pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        total = np.concatenate([[0], ends])
        cuts = total[np.concatenate([heads, [len(ids)]]).astype(np.int64)].astype(np.int64)
        out = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        try:
            return out.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            odd = np.repeat(np.where(self.byte[ids], np.cumsum(~self.byte[ids]) + 1, 0), lengths)  # the number of each run of byte pieces
            return pa.array([_spell(bytes(data[a:b]), odd[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.string())


def _spell(data: bytes, loose: np.ndarray) -> str:
    """Bytes of byte pieces are read character by character within their run; each invalid one is U+FFFD."""
    out, at = [], 0
    while at < len(data):
        stop = at + 1
        while stop < len(data) and loose[stop] == loose[at]:
            stop += 1
        part = data[at:stop]
        if not loose[at]:
            out.append(part.decode())
        else:
            i = 0
            while i < len(part):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(part[i : i + n].decode())
                        i += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    i += 1
        at = stop
    return "".join(out)


class Encoder:
    """Encodes texts in one Python worker and remembers words by their 64-bit hashes."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.known, self.place = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.ids, self.starts, self.counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of ids of each text."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), SPACE, " ")
        large = pa.scalar("", pa.large_string())
        texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, large))
        data, offsets = raw(texts)
        if not len(data):
            return self.ids[:0], np.zeros(len(texts), np.int64)
        kind = self.model.kinds[data]
        begins = np.ones(len(data), bool)
        begins[1:] = (kind[1:] == 2) | (kind[:-1] == 2) | (kind[1:] == 1) & (kind[:-1] == 0) if self.model.splits else False
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        hashes, where, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        self._learn(data, starts[where], ends[where], hashes)
        which = self.place[np.searchsorted(self.known, hashes)][which]
        each = self.counts[which]
        last = np.cumsum(each)
        ids = self.ids[np.repeat(self.starts[which] - (last - each), each) + np.arange(last[-1])]
        total = np.concatenate([[0], last])
        return ids, np.diff(total[np.searchsorted(starts, offsets)])

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Merge the words that are not known yet."""
        if len(self.known) > KEPT_WORDS:
            self.__init__(self.model)
        at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        fresh = np.flatnonzero(self.known[at] != hashes) if len(self.known) else np.arange(len(hashes))
        if not len(fresh):
            return
        words = [data[a:b].tobytes().decode().replace(" ", SPACE) for a, b in zip(starts[fresh].tolist(), ends[fresh].tolist(), strict=True)]
        ids, counts = self.model.word_ids(words)
        known, place = np.concatenate([self.known, hashes[fresh]]), np.concatenate([self.place, len(self.counts) + np.arange(len(fresh))])
        order = np.argsort(known)
        self.known, self.place = known[order], place[order]
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])


_encoders: dict[int, Encoder] = {}


def worker_encoder(shared: Broadcast) -> Encoder:
    """The encoder of this Python worker, which serves many tasks; that of an earlier model is dropped."""
    model = shared.value
    if id(model) not in _encoders:
        _encoders.clear()
        _encoders[id(model)] = Encoder(model)
    return _encoders[id(model)]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (array of int) and ``decoded`` (text of these ids) of every row.

    Texts of any length are encoded whole. A null text is an empty one: no ids, decoded ''. Rows
    are independent, so nulls in ``id_col``, ties and repeated rows stay as they are; other
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(PieceModel(model_path))  # as large as the vocabulary
    source = docs.select(id_col, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for batch in steps(batches, STEP // 2):
            ids, counts = encoder.encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), listed(ids, counts, pa.int32()), encoder.model.decode(ids, counts)], ["key", "ids", "decoded"])

    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", id_col)
