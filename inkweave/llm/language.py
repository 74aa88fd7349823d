"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit a binary classifier over hashed letter pairs and
triples tells languages with a 1 from those with a 0: its weights are the log ratios of the two
sides' mean n-gram shares. A text's language is the codeword with the least weighted loss.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.llm.text import mix, steps

#: Bytes of text of a step: each takes some 60 bytes of arrays.
STEP = 1 << 20
#: Hash buckets of n-grams.
BUCKETS = 1 << 15
#: Expected number of training rows of each language (a documented bound of the fit; prediction covers all rows).
SAMPLE = 2000
#: Score under which a prediction is ambiguous.
AMBIGUOUS = 0.5

_ALPHA = np.array([chr(c).isalpha() for c in range(0x10000)])


def codewords(n: int) -> np.ndarray:
    """+1/-1 matrix, a row for each language: all two-way splits up to 7 languages, else the best of seeded random codes."""
    if n <= 7:
        splits = range(1, 2 ** max(n - 1, 0)) if n > 1 else [0]
        return np.array([[1 if b >> i & 1 else -1 for b in splits] for i in range(n)])
    draw, best, width = np.random.default_rng(7), None, 0
    for _ in range(300):
        code = draw.choice([-1, 1], (n, max(15, int(np.ceil(10 * np.log2(n))))))
        code = code[:, abs(code.sum(axis=1 - 1)) < n]
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if apart > width:
            best, width = code, apart
    return best


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all letter pairs and triples, row by row, and the number of letters of each row (a row has two buckets a letter)."""
    text = pc.utf8_lower(pc.fill_null(text.cast(pa.large_string()), ""))
    sizes = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    far = points >= 0x10000
    letter = _ALPHA[np.where(far, 0, points).astype(np.int64)]
    if far.any():
        letter[far] = [chr(int(c)).isalpha() for c in points[far]]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    signs = np.zeros(len(points) + 2, np.uint64)
    signs[1:-1] = np.where(letter, points, 0)
    before, after = signs[:-2].copy(), signs[2:].copy()
    heads = bounds[:-1][sizes > 0]
    before[heads] = 0
    after[heads[1:] - 1] = 0
    at = np.flatnonzero(letter)
    pair = before[at] << np.uint64(21) | signs[1:-1][at]
    triple = pair << np.uint64(21) | after[at] | np.uint64(1 << 63)
    out = np.empty(2 * len(at), np.int32)
    out[0::2], out[1::2] = mix(pair) % np.uint64(BUCKETS), mix(triple) % np.uint64(BUCKETS)
    return out, np.diff(np.searchsorted(at, bounds))


@dataclass
class Codes:
    """The fitted classifiers: languages, code, weights of each bit and bucket, weight of each bit's loss."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    @classmethod
    def fit(cls, languages: list[str], counts: np.ndarray) -> Codes:
        code = codewords(len(languages))
        share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        weights, trust = [], []
        for bit in code.T:
            one, zero = share[bit > 0], share[bit < 0]
            if not len(one) or not len(zero):
                weights.append(np.zeros(counts.shape[1]))
                trust.append(0.0)
                continue
            w = np.log(one.mean(axis=0) / zero.mean(axis=0))
            means = share @ w  # what a text of each language gets on the average
            w = w - (means[bit > 0].min() + means[bit < 0].max()) / 2
            margin = (share @ w) * bit
            scale = max(float(np.abs(margin).mean()), 1e-9)
            weights.append(4 * w / scale)
            trust.append(max(float(margin.min()) / scale, 0.05))
        total = sum(trust)
        return cls(languages, code, np.array(weights, np.float32), np.array(trust) / total if total else np.array(trust))

    def predict(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language (-1: none), score, second best index of each row."""
        buckets, letters = features(text)
        n, ends = len(letters), 2 * np.cumsum(letters)
        loss = np.zeros((n, len(self.languages)))
        full = np.flatnonzero(letters)
        for bit, weight, trust in zip(self.code.T, self.weights, self.trust, strict=True):
            if len(full):
                total = np.add.reduceat(weight[buckets], (ends - 2 * letters)[full], dtype=np.float64)
                mean = total / (2 * letters[full])
                loss[full] += trust * np.logaddexp(0, -mean[:, None] * bit[None, :])
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0] if len(self.languages) else np.zeros(n, np.int64)
        chance = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
        score = 1 / chance.sum(axis=1)
        second = order[:, 1] if len(self.languages) > 1 else best
        return np.where(letters > 0, best, -1), np.where(letters > 0, score, 0.0), second


def held_out(id_col: str) -> Column:
    """Rows that are kept for measuring: crc32 of the id as text leaves 1 modulo 3; never a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Codes:
    """Fit on about ``sample`` rows of each language, chosen by a hash of their ids among rows that are not held out and have id, language and text."""
    usable = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), held_out(id_col).alias("out"))
    usable = usable.where(~F.col("out") & F.col("key").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # a row for each language goes to the driver, then BUCKETS numbers for each
    rows = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not rows:
        return Codes([], np.zeros((0, 0), int), np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    languages = sorted(rows)
    chance = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    limit = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, sample / rows[lang])))])
    chosen = usable.where(chance < limit[F.col("lang")]).select("lang", "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in steps(batches, STEP):
            buckets, letters = features(batch.column(1))
            of = batch.column(0).to_pylist()
            cuts = np.concatenate([[0], np.cumsum(2 * letters)])
            for i, lang in enumerate(of):
                sums[lang] = sums.get(lang, 0) + np.bincount(buckets[cuts[i] : cuts[i + 1]], minlength=BUCKETS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["lang", "bucket", "n"])

    summed = chosen.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), BUCKETS))
    where = {lang: i for i, lang in enumerate(languages)}
    counts[[where[x] for x in summed["lang"].to_pylist()], summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return Codes.fit(languages, counts)


def predict(docs: DataFrame, codes: Codes, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``id_col``, ``keep`` columns, lang_pred, score (0 to 1), lang_second, ambiguous of every row.

    A null text or one without a letter is ``und`` with score 0, as is every text if nothing was
    learned. Only the text decides. Rows are independent: repeated rows and null ids stay; columns
    not named are ignored; an empty table gives an empty result.
    """
    keep = keep or []
    shared = docs.sparkSession.sparkContext.broadcast(codes)  # languages x bits and bits x BUCKETS numbers
    source = docs.select(F.col(id_col).alias("__key"), F.col(text_col).alias("__text"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, "und"], object)
        for batch in steps(batches, STEP):
            n = batch.num_rows
            if model.languages:
                best, score, second = model.predict(batch.column(1))
            else:
                best, score, second = np.full(n, -1), np.zeros(n), np.full(n, -1)
            second = np.where(best < 0, -1, second)
            rest = [batch.column(i + 2) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rest, pa.array(names[best], pa.string()), pa.array(score), pa.array(names[second], pa.string()), pa.array(score < AMBIGUOUS)],
                                             ["__key", *[f"__{i}" for i in range(len(keep))], "lang_pred", "score", "lang_second", "ambiguous"])

    kinds = [f.dataType.simpleString() for f in source.schema]
    columns = ", ".join(["__key " + kinds[0], *[f"__{i} {kinds[i + 2]}" for i in range(len(keep))]])
    out = source.mapInArrow(run, f"{columns}, lang_pred string, score double, lang_second string, ambiguous boolean")
    return out.toDF(id_col, *keep, "lang_pred", "score", "lang_second", "ambiguous")


def accepted(docs: DataFrame, codes: Codes, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has a language that is not ambiguous."""
    shared, place = docs.sparkSession.sparkContext.broadcast(codes), docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(place)], ["i", "text"])
            keep = np.zeros(batch.num_rows, bool)
            for part in steps([named], STEP):
                if shared.value.languages:
                    best, score, _ = shared.value.predict(part.column(1))
                    keep[part.column(0).to_numpy()] = (best >= 0) & (score >= AMBIGUOUS)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
