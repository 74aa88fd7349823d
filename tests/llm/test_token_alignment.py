import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from inkweave.llm import queries, token_alignment
from inkweave.llm.sentencepiece_codec import PieceModel

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DATA = "/root/testdata/sf0.001"
SHOWN = {chr(b): b for b in token_alignment.SHOWN}
HIDDEN = {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in SHOWN.values())}
ODD = [None, "", " ", "x", "x", "\x00 é\U0001f600 x", "▁ a", "a▁b", "a" * 30_000, "word " * 5000, "\n" * 500, " " * 3000 + "z", "ab" * 3000, "don't 漢字かな <|endoftext|> </s> <0x41> 12345"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def expected(rows, libraries):
    """rows: texts -> (n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each, by plain loops."""
    a_library, b_library = libraries
    done = []
    for text in rows:
        ia = a_library.encode(" " + (text or ""), add_special_tokens=False)
        ib = b_library.encode(text or "")
        ta = [bytes((SHOWN | HIDDEN)[c] for c in x) for x in ia.tokens]
        tb = [bytes([int(p[3:5], 16)]) if b_library.is_byte(i) else p.replace("▁", " ").encode() for i in ib for p in [b_library.id_to_piece(i)]]
        if not text or b"".join(ta) != (" " + text).encode() or b"".join(tb) != (" " + text).encode():
            done.append(([], 0, 0, ""))
            continue
        ea, eb = np.cumsum([len(x) for x in ta]).tolist(), np.cumsum([len(x) for x in tb]).tolist()
        both, groups, i, j = sorted(set(ea) & set(eb)), [], 0, 0
        for end in both:
            m, n = ea.index(end, i) + 1, eb.index(end, j) + 1
            groups.append((ia.ids[i:m], ib[j:n]))
            i, j = m, n
        done.append((groups, len(ta), len(tb), ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)))
    links = [Counter((x, y) for xs, ys in groups for x in xs for y in ys) for groups, *_ in done]
    docs = Counter(p for c in links for p in c)
    best = defaultdict(int)
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    return [(na, nb, len(groups), sum(c.values()), sum(n for p, n in c.items() if docs[p] == best[p[0]]), sum(n * docs[p] for p, n in c.items()), hashlib.sha256(t.encode()).hexdigest() if t else "")
            for (groups, na, nb, t), c in zip(done, links, strict=True)]


def test_fast_encoder_equals_the_library(libraries):
    side, r = token_alignment.ByteSide(open(A, encoding="utf-8").read()), random.Random(1)
    signs = "abcDE  \n\t\r\x85  　;(){}éßñ’'s't▁😀漢字\x00᠎﻿0123½² _-"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(3000)] + [" " * 5000 + "x", "\n" * 1_000_000, "a" * 100_000]
    ids, counts = side.encode(texts)
    assert ids.tolist() == [i for t in texts for i in libraries[0].encode(t, add_special_tokens=False).ids]
    assert len(counts) == len(texts)


def test_query_equals_plain_loops(spark, libraries, monkeypatch):
    rows = sorted((x["doc_id"], x["text"]) for x in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    got = sorted(map(tuple, queries.op11_token_alignment(spark, DATA).collect()))
    assert got == [(i, *x) for (i, _), x in zip(rows, expected([t for _, t in rows], libraries), strict=True)]


def test_odd_rows_and_many_buckets(spark, libraries, monkeypatch):
    monkeypatch.setattr(token_alignment, "BUCKET", 1)
    r = random.Random(2)
    texts = [*ODD, *("".join(r.choice("abcdef  \n漢é'1") for _ in range(r.randint(1, 80))) for _ in range(150))]
    docs = spark.createDataFrame([(k % 50 if k % 7 else None, t, "x", 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, pair string, bucket int, n_a int").repartition(3)
    got = sorted(map(str, map(tuple, token_alignment.links(docs, A, B).collect())))
    assert got == sorted(str((k % 50 if k % 7 else None, *x)) for k, x in enumerate(expected(texts, libraries)))
    assert token_alignment.links(docs.limit(0), A, B).collect() == []


def test_groups_and_overlaps_of_each_token(spark, libraries):
    texts = [t for t in ODD if t is None or len(t) < 4000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for x in token_alignment.align(docs, A, B).collect():
        text = " " + (texts[x["doc_id"]] or "")
        want = expected([texts[x["doc_id"]]], libraries)[0]
        assert (len(x["a_ids"]), len(x["b_ids"]), len(set(x["a_groups"]))) == want[:3] and set(x["a_groups"]) == set(x["b_groups"])
        if not x["a_ids"]:
            assert x["overlap_a"] == x["overlap_b"] == []
            continue
        sides = token_alignment.Sides(open(A, encoding="utf-8").read(), PieceModel(B))
        spans = []
        for side, ids in enumerate((x["a_ids"], x["b_ids"])):
            ends = np.cumsum(sides.sizes[side][ids])
            spans.append(list(zip((ends - sides.sizes[side][ids]).tolist(), ends.tolist(), strict=True)))
            assert ends[-1] == len(text.encode())
        want = {(i, j) for i, (a, b) in enumerate(spans[0]) for j, (c, d) in enumerate(spans[1]) if a < d and c < b}
        assert set(zip(x["overlap_a"], x["overlap_b"], strict=True)) == want
        assert all(x["a_groups"][i] == x["b_groups"][j] for i, j in want)


def test_rows_spelled_otherwise_in_one_step():
    sides = token_alignment.Sides(open(A, encoding="utf-8").read(), PieceModel(B))
    found = token_alignment.align_step(sides, pa.array(["a b", "▁", "x▁y z", None, "", "c", "q▁"]))
    assert (found.counts[0] > 0).tolist() == [True, False, False, False, False, True, False]
