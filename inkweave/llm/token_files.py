"""Token ids in binary files: each id in the least bits of the vocabulary, blocks with offsets, random access.

A file holds blocks of ``BLOCK`` ids, bit-packed from the low bit up, then a footer with the byte
offset of each block, the document ids and the place of each document's first id, then a trailer
of fixed size. A range of ids is read by the offsets of the blocks it touches and unpacked with
numpy at once. ``token_files`` is a Spark data source: one file a partition under a name of its
own, listed in the manifest only when all tasks have committed, so a lost executor leaves no half
file behind the manifest; a scan is split at document borders.
"""

from __future__ import annotations

import json
import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from inkweave.llm.text import listed, steps
from inkweave.llm.word_memory import worker_memory
from inkweave.session import width

MAGIC = b"INKBITS1"
#: Ids of a block, a multiple of 8 so that blocks end at a byte.
BLOCK = 1 << 16
#: Ids of one partition of a scan, and of one batch that it yields (a document is never cut).
SPLIT, BATCH = 8 << 20, 1 << 18
MANIFEST = "_manifest.json"
TRAILER = struct.Struct("<IIQQQQ8s")  # bits, block, ids, documents, blocks, place of the footer, magic


def bits_for(vocabulary: int) -> int:
    """Least bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` low bits of each id, one after another; the last byte is filled with zeros."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
    return np.packbits(each, bitorder="little").tobytes()


def unpack(data: bytes, bits: int, skip: int, count: int) -> np.ndarray:
    """``count`` ids from packed bytes, after ``skip`` others."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count, skip * (bits // 8)).astype(np.uint32)
    at = (np.arange(count, dtype=np.int64) + skip) * bits
    source = np.frombuffer(data + bytes(8), np.uint8)
    word = np.zeros(count, np.uint64)
    for k in range((bits + 14) // 8):  # an id begins at any bit of its first byte
        word |= source[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class TokenWriter:
    """Write documents to a stream, a block at a time."""

    def __init__(self, stream, bits: int, block: int = BLOCK):
        if block % 8:
            raise ValueError("a block needs a multiple of 8 ids")
        self.stream, self.bits, self.block = stream, bits, block
        self.stream.write(MAGIC)
        self.place, self.n_ids, self.rest = len(MAGIC), 0, np.empty(0, np.uint32)
        self.offsets: list[int] = []
        self.keys: list[np.ndarray] = []
        self.valid: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def add(self, keys: np.ndarray, valid: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents with the ids of all of them, one after another."""
        self.keys.append(keys)
        self.valid.append(valid)
        self.sizes.append(sizes)
        self.n_ids += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) - len(ids) % self.block
        for k in range(0, whole, self.block):
            self._block(ids[k : k + self.block])
        self.rest = ids[whole:]

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.place)
        self.stream.write(data)
        self.place += len(data)

    def close(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Write the footer; the documents' ids, which are not null, and their sizes."""
        if len(self.rest):
            self._block(self.rest)
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
        keys, valid, sizes = join(self.keys, "<i8"), join(self.valid, "u1"), join(self.sizes, "<i8")
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
        for part in (np.array([*self.offsets, self.place], "<i8"), keys, valid, starts):
            self.stream.write(part.tobytes())
        self.stream.write(TRAILER.pack(self.bits, self.block, self.n_ids, len(keys), len(self.offsets), self.place, MAGIC))
        return keys, valid, sizes


class TokenFile:
    """Random access to one file: the footer is read once, ids only where asked for."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.stream = fs.open_input_file(path)
        size = self.stream.size()
        if size < len(MAGIC) + TRAILER.size:
            raise ValueError(f"{path} is no token file")
        self.bits, self.block, self.n_ids, self.n_docs, blocks, footer, magic = TRAILER.unpack(self.stream.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        part = self.stream.read_at(size - TRAILER.size - footer, footer)
        a, b, c = 8 * (blocks + 1), 8 * (blocks + 1 + self.n_docs), 8 * (blocks + 1) + 9 * self.n_docs
        self.offsets, self.keys = np.frombuffer(part[:a], "<i8"), np.frombuffer(part[a:b], "<i8")
        self.valid, self.starts = np.frombuffer(part[b:c], "u1").astype(bool), np.frombuffer(part[c:], "<i8")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids at places ``start`` to ``stop`` of the file."""
        start, stop = max(start, 0), min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        begin = (start - first * self.block) // 8 * 8  # eight ids end at a byte
        low = int(self.offsets[first]) + begin * self.bits // 8
        high = int(self.offsets[last]) + ((stop - last * self.block) * self.bits + 7) // 8
        return unpack(self.stream.read_at(high - low, low), self.bits, start - first * self.block - begin, stop - start)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


@dataclass
class _Written(WriterCommitMessage):
    part: int
    name: str
    n_ids: int
    n_docs: int
    ends: tuple
    cuts: list


@dataclass
class _Range(InputPartition):
    name: str | None
    low: int
    high: int
    start: int


class _Sink(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.bits, self.block = options["path"], int(options["bits"]), int(options.get("block", BLOCK))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        part = TaskContext.get().partitionId()
        fs, folder = _open(self.path)
        fs.create_dir(folder, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.bits"
        with fs.open_output_stream(f"{folder}/{name}") as stream:
            out = TokenWriter(stream, self.bits, self.block)
            for batch in iterator:
                ids = batch.column(1)
                sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                key = batch.column(0).cast(pa.int64())
                out.add(key.fill_null(0).to_numpy(zero_copy_only=False), key.is_valid().to_numpy(zero_copy_only=False), sizes, ids.flatten().to_numpy(zero_copy_only=False).astype(np.uint32))
            keys, valid, sizes = out.close()
        starts = np.concatenate([[0], np.cumsum(sizes)])
        cuts = np.unique(np.searchsorted(starts[:-1], np.arange(0, max(out.n_ids, 1), SPLIT)))
        ends = tuple(None if not valid[k] else int(keys[k]) for k in (0, -1)) if len(keys) else ()
        return _Written(part, name, out.n_ids, len(keys), ends, [(int(k), int(starts[k])) for k in cuts if k < len(keys)])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = sorted((m for m in messages if m and m.n_docs), key=lambda m: m.part)
        order = [-(2**64) if end is None else end for m in files for end in m.ends]
        if order != sorted(order):
            raise ValueError("documents must come in ascending order of their ids over all partitions")
        fs, folder = _open(self.path)
        fs.create_dir(folder, recursive=True)
        listing = [{"name": m.name, "n_ids": m.n_ids, "n_docs": m.n_docs, "cuts": m.cuts} for m in files]
        with fs.open_output_stream(f"{folder}/{MANIFEST}") as stream:
            stream.write(json.dumps({"bits": self.bits, "files": listing}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Nothing to undo: without a manifest no file counts."""


class _Source(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.raw = options["path"], options.get("as", "ids") == "bytes"

    def partitions(self) -> list[InputPartition]:
        out, start = [], 0
        for file in manifest(self.path)["files"]:
            cuts = [*file["cuts"], (file["n_docs"], file["n_ids"])]
            out += [_Range(file["name"], low, high, start) for (low, _), (high, _) in zip(cuts, cuts[1:])]
            start += file["n_ids"]
        return out or [_Range(None, 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition.name is None:
            return
        fs, folder = _open(self.path)
        file = TokenFile(fs, f"{folder}/{partition.name}")
        low = partition.low
        while low < partition.high:
            high = min(partition.high, max(low + 1, int(np.searchsorted(file.starts, file.starts[low] + BATCH, "right")) - 1))
            ids = file.ids(int(file.starts[low]), int(file.starts[high]))
            place = file.starts[low : high + 1]
            keys = pa.array(file.keys[low:high], pa.int64(), mask=~file.valid[low:high])
            body = self._bytes(ids, place) if self.raw else listed(ids.astype(np.int32), np.diff(place), pa.int32())
            yield pa.RecordBatch.from_arrays([keys, pa.array(partition.start + place[:-1], pa.int64()), pa.array(np.diff(place), pa.int64()), body], ["doc_id", "start", "n_tokens", "ids"])
            low = high

    @staticmethod
    def _bytes(ids: np.ndarray, place: np.ndarray) -> pa.Array:
        offsets = pa.py_buffer((4 * (place - place[0])).astype(np.int32))
        return pa.Array.from_buffers(pa.binary(), len(place) - 1, [None, offsets, pa.py_buffer(ids.astype("<u4"))])


class TokenFiles(DataSource):
    """``token_files``: options ``path``, ``bits`` (writing), ``as`` = ``ids`` or ``bytes`` (reading: little-endian 32-bit ids)."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return f"doc_id bigint, start bigint, n_tokens bigint, ids {'binary' if self.options.get('as') == 'bytes' else 'array<int>'}"

    def reader(self, schema) -> DataSourceReader:
        return _Source(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Sink(self.options)


def manifest(path: str) -> dict:
    """Files of a finished write in the order of their ids."""
    fs, folder = _open(path)
    with fs.open_input_stream(f"{folder}/{MANIFEST}") as stream:
        return json.loads(stream.read())


def read_span(path: str, start: int, count: int) -> np.ndarray:
    """``count`` ids from place ``start`` of the whole output: random access without Spark; reads the blocks touched only."""
    fs, folder = _open(path)
    files = manifest(path)["files"]
    before = np.concatenate([[0], np.cumsum([f["n_ids"] for f in files])]).tolist()
    out, stop = [], min(start + count, before[-1])
    while start < stop:
        k = bisect_right(before, start) - 1
        out.append(TokenFile(fs, f"{folder}/{files[k]['name']}").ids(start - before[k], stop - before[k]))
        start = before[k + 1]
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def encode(docs: DataFrame, tokenizer_path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every row, in the order of the rows of each partition.

    Ids are those of the tokenizers library for the whole text, without special tokens around it.
    The tokenizer must drop white space and not join words over it, so distinct words are encoded
    once. A null text is an empty one; ``end_id`` follows every row.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())  # as large as the vocabulary
    source = docs.select(id_col, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = worker_memory(shared)
        for batch in steps(batches):
            ids, counts = memory.encode(batch.column(1))
            if end_id is not None:
                ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), listed(ids, counts, pa.int32())], ["key", "ids"])

    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", id_col)


def vocabulary(tokenizer_path: str) -> int:
    """One more than the largest id of a tokenizer file, special tokens included."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True).values()) + 1


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all rows into token files under ``path``, in ascending order of ``id_col`` (a whole number).

    Null ids come first; rows with one id follow each other by a hash of their text, so a key that
    many rows share is dealt over many files. Null texts count as empty. Other columns are ignored.
    An empty table gives a manifest without files. Texts move once, ids are written as they come.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenFiles)
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).repartitionByRange(width(spark), "doc_id", F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions("doc_id", F.xxhash64("text"))
    encode(ordered, tokenizer_path, end_id).write.format("token_files").option("bits", bits_for(vocabulary(tokenizer_path))).mode("append").save(path)


def read(spark: SparkSession, path: str, as_bytes: bool = False) -> DataFrame:
    """``doc_id``, ``start`` (ids before the document), ``n_tokens`` and ``ids`` of every document of a finished write."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").option("as", "bytes" if as_bytes else "ids").load(path)
