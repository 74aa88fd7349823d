import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkweave.llm import queries, token_files
from inkweave.session import shared_dir

WORDS = public_tokenizers.path("word_bpe_49k.json")
DATA = "/root/testdata/sf0.001"
ODD = [None, "", "  \n\t ", "x", "x", "\x00 é\U0001f600 é don't   ΣΑΣ 12ab", "a" * 30_000, "word " * 20_000, "\n" * 500, "<|endoftext|> it<|startoftext|>s"]


def expected(rows, end=2):
    """rows: (id, text) in ascending order -> (id, start, size, crc) by the library."""
    library, start, out = Tokenizer.from_file(WORDS), 0, []
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 9, 15, 16, 17, 24, 25, 31, 32])
def test_packing_round_trip_and_random_access(tmp_path, bits):
    rng = np.random.default_rng(bits)
    sizes = rng.integers(0, 40, 60)
    ids = rng.integers(0, 1 << bits, sizes.sum(), dtype=np.uint64).astype(np.uint32)
    assert len(token_files.pack(ids, bits)) == -(-len(ids) * bits // 8)
    path = str(tmp_path / "one.bits")
    with pafs.LocalFileSystem().open_output_stream(path) as stream:
        out, at = token_files.TokenWriter(stream, bits, block=64), 0
        for cut in (7, 20, 60):
            part = sizes[at:cut]
            low = sizes[:at].sum()
            out.add(np.arange(at, cut), np.ones(cut - at, bool), part, ids[low : low + part.sum()])
            at = cut
        out.close()
    file = token_files.TokenFile(pafs.LocalFileSystem(), path)
    assert file.ids(0, len(ids)).tolist() == ids.tolist()
    for _ in range(200):
        a, b = sorted(rng.integers(0, len(ids) + 5, 2))
        assert file.ids(a, b).tolist() == ids[a:b].tolist()
    ends = np.concatenate([[0], np.cumsum(sizes)])
    assert all(file.document(k).tolist() == ids[ends[k] : ends[k + 1]].tolist() for k in range(60))


def test_ids_beyond_the_width_are_refused():
    with pytest.raises(ValueError):
        token_files.pack(np.array([8]), 3)
    assert [token_files.bits_for(n) for n in (1, 2, 3, 256, 257, 49_408)] == [1, 1, 2, 8, 9, 16]


def test_query_equals_the_library(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    assert sorted(map(tuple, queries.op12_token_files(spark, DATA).collect())) == expected(rows)


def test_odd_rows_are_written_and_read(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BATCH", 50)
    r = random.Random(3)
    rows = [(r.choice([None, None, 5, 7, -3, k]), t) for k, t in enumerate(ODD * 3)]
    docs = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in rows], "doc_id long, text string, start string, n_tokens int, ids int").repartition(5)
    path = f"{shared_dir(spark)}/odd-{uuid.uuid4().hex}"
    token_files.write(docs, path, WORDS, 2)
    got = token_files.read(spark, path).orderBy("start").collect()
    assert [x["doc_id"] for x in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [x["start"] for x in got] == np.concatenate([[0], np.cumsum([len(x["ids"]) for x in got])])[:-1].tolist()
    library = Tokenizer.from_file(WORDS)
    want = sorted((str(i), [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows)
    assert sorted((str(x["doc_id"]), x["ids"]) for x in got) == want
    flat = [i for x in got for i in x["ids"]]
    assert token_files.read_span(path, 0, 10**9).tolist() == flat
    assert all(token_files.read_span(path, a, n).tolist() == flat[a : a + n] for a, n in ((0, 3), (11, 30_000), (len(flat) - 2, 9), (len(flat), 4)))
    both = token_files.read(spark, path, as_bytes=True).orderBy("start").select(F.crc32("ids")).collect()
    assert [x[0] for x in both] == [zlib.crc32(np.array(x["ids"], "<u4").tobytes()) for x in got]


def test_empty_table_and_unfinished_writes(spark):
    path = f"{shared_dir(spark)}/none-{uuid.uuid4().hex}"
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), path, WORDS)
    assert token_files.read(spark, path).collect() == [] and len(token_files.read_span(path, 0, 5)) == 0
    with pytest.raises(FileNotFoundError):
        token_files.manifest(f"{path}-unfinished")


def test_files_out_of_order_are_refused(spark):
    sink = token_files._Sink({"path": f"{shared_dir(spark)}/x-{uuid.uuid4().hex}", "bits": "8"})
    with pytest.raises(ValueError):
        sink.commit([token_files._Written(0, "a", 1, 1, (5, 5), [(0, 0)]), token_files._Written(1, "b", 1, 1, (3, 3), [(0, 0)])])
