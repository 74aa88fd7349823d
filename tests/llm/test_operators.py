import random
import re

import numpy as np
import plain
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from inkweave.llm import decontamination, jaccard_join, language, licenses, line_dedup, quality, queries, secrets, sentencepiece_codec, sharding, substring_dedup
from inkweave.llm.text import documents, span_hashes, words

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string"
DATA = "/root/testdata/sf0.001"
#: Nulls, blanks, repeated rows, one very long word and text, signs outside the BMP.
ODD = [None, "", "  \n\t ", "x", "x", "\x00 é\U0001f600 ▁", "a" * 30_000, "word " * 20_000, "\n" * 500]


def letters(r, n, alphabet="abcdefgh"):
    return ["".join(r.choice(alphabet) for _ in range(4)) for _ in range(n)]


def table(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, DATA)


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def test_sentencepiece_matches_the_library(spark):
    library, r = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(1)
    signs = "abcdefghijklmnop  \n\t\r;(){}éß▁😀漢字\x00<>0x1_ "
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(300, 31000)]
    sample = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(500)] + ["".join(r.choice(pieces) for _ in range(r.randint(1, 30))) for _ in range(1000)]
    sample += ODD + ["    " * 100 + "return x", " " * 3000, "ab" * 3000]
    got = sorted(sentencepiece_codec.encode_decode(table(spark, sample), PIECES).collect())
    for (i, ids, decoded), text in zip(got, sample, strict=True):
        want = library.encode(text or "")
        assert ids == want, (i, text)
        assert decoded == library.decode(want)


def test_sentencepiece_decodes_any_ids():
    library, model, r = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepiece_codec.PieceModel(PIECES), random.Random(2)
    rows = [[r.randrange(low) for _ in range(r.randint(0, 8))] for low in (262, 32000) for _ in range(1500)]
    got = model.decode(np.array([x for row in rows for x in row], np.int64), np.array([len(row) for row in rows])).to_pylist()
    assert got == [library.decode(row) for row in rows]


@pytest.mark.parametrize(("rare", "cluster"), [(3, 6_000_000), (32, 6_000_000), (3, 2000)])
def test_jaccard_join(spark, rare, cluster):
    r = random.Random(3)
    base, hot, pool = letters(r, 200), letters(r, 60), [letters(r, 30) for _ in range(8)]
    rows = []
    for _ in range(60):
        near = list(base)
        for _ in range(r.choice([1, 2, 3, 5, 6, 8, 9])):
            near[r.randrange(200)] = "".join(letters(r, 2))
        rows.append(" ".join(near))
    rows += [" ".join(letters(r, r.choice([4, 10, 20, 60])) + hot + letters(r, r.choice([0, 3, 5]))) for _ in range(60)]
    rows += [" ".join(sum(r.sample(pool, r.choice([2, 3, 4, 5])), [])) for _ in range(50)]
    rows += [" ".join(base[: r.choice([1, 2, 4, 5, 6, 8, 10, 12, 30])]) for _ in range(30)] + ["A b", "a B", *ODD]
    r.shuffle(rows)
    named = [(i, t) for i, t in enumerate(rows)]
    got = {x[0]: (x[1], x[2]) for x in jaccard_join.join(table(spark, rows), rare=rare, cluster_tokens=cluster).collect()}
    assert got == {i: x for (i, _), x in zip(named, plain.components(named), strict=True)}


@pytest.mark.parametrize(("percent", "more"), [(60, 50), (40, 120)])
def test_jaccard_join_links_sets_of_other_sizes(spark, percent, more):
    r = random.Random(7)
    base, tail = letters(r, 100), letters(r, more)
    rows = [" ".join(base + letters(r, 2)) for _ in range(10)] + [" ".join(base + tail + letters(r, 2)) for _ in range(10)]
    named = list(enumerate(rows))
    want = {i: x for (i, _), x in zip(named, plain.components(named, percent=percent), strict=True)}
    assert {c for _, c in want.values()} == {0}
    assert {x[0]: (x[1], x[2]) for x in jaccard_join.join(table(spark, rows), percent=percent, rare=3).collect()} == want
    assert all(jaccard_join.parts(n, 80) == sorted({max(1, (1 << x.bit_length() - 1) // 4) for x in (n, n * 5 // 4)}) for n in range(1, 3000))


def test_jaccard_join_of_the_table(docs, texts):
    rows = sorted(texts.items())
    got = {x[0]: (x[1], x[2]) for x in jaccard_join.join(docs).collect()}
    assert got == {i: x for (i, _), x in zip(rows, plain.components(rows), strict=True)}


def test_line_dedup(spark):
    r = random.Random(4)
    common = ["a line that many documents share", "É NOTHER LINE, twenty é", "short line", "exactly twenty chars"]
    rows = ["\n".join(r.choice([*common, " " + common[0].upper() + "\t", " ".join(letters(r, 6))]) for _ in range(r.randint(0, 6))) for _ in range(60)]
    rows += ODD
    got = {x["doc_id"]: (x["n_lines"], x["n_dropped"], x["kept"]) for x in line_dedup.dedup(table(spark, rows)).collect()}
    assert got == plain.drop_lines(list(enumerate(rows)))


def test_line_runs_continue(spark):
    rows = ["\n".join(f"line number {j} of the second kind" for j in range(i % 7 + 1)) for i in range(40)]
    whole = table(spark, rows)
    first = line_dedup.line_runs(whole.where("doc_id < 25"), 4)
    both = line_dedup.line_runs(whole.where("doc_id >= 25"), 4, earlier=first)
    assert sorted(map(tuple, line_dedup.frequent(both, 3).collect())) == sorted(map(tuple, line_dedup.frequent(line_dedup.line_runs(whole, 4), 3).collect()))
    runs, rng = line_dedup.Levels(), np.random.default_rng(1)
    for _ in range(21):
        key = rng.integers(0, 50, 10).astype(np.uint64)
        runs.add(line_dedup.Run.of([line_dedup.Run(key, key, np.ones(10, np.int64), np.arange(10))]))
    assert [len(x) for x in runs.levels] == [1, 1, 1]
    merged = line_dedup.Run.of([x for level in runs.levels for x in level])
    assert merged.docs.sum() == 210 and sum(len(x.high) for level in runs.levels for x in level) == len(merged.high)


def test_sharding(spark, docs):
    rows = sharding.measured(docs)
    sizes = sharding.slot_sizes(rows)
    one = sharding.first_map(sizes, 8)
    out = sharding.placed(rows, one).toPandas()
    load = out.groupby("shard")["size"].sum()
    assert len(out) == docs.count() and len(load) == 8 and load.max() - load.min() <= out["size"].max()
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    two = sharding.rebalance(one, sizes, 9)
    moved = one.alias("a").join(two.alias("b"), "virtual_slot").where("a.shard <> b.shard").agg(F.sum("b.bytes"), F.count("*")).first()
    load = two.groupBy("shard").agg(F.sum("bytes").alias("n")).toPandas()["n"]
    assert two.select("version").distinct().first()[0] == 2 and len(load) == 9
    assert moved[0] <= 2 * load.sum() / 9 and load.max() - load.min() <= out["size"].max()


def test_sharding_stores_versions(spark, docs, tmp_path):
    sizes = sharding.slot_sizes(sharding.measured(docs), sharding.SLOTS)
    one = sharding.first_map(sizes, 4)
    sharding.store_map(one, str(tmp_path / "map"))
    stored = sharding.load_map(spark, str(tmp_path / "map"), 1)
    sharding.store_map(sharding.rebalance(stored, sizes, 5), str(tmp_path / "map"))
    assert stored.count() == sharding.SLOTS
    assert sharding.load_map(spark, str(tmp_path / "map"), 2).agg(F.max("shard")).first()[0] == 4


def test_language(spark):
    full = documents(spark, "/root/testdata/sf0.01")
    out = queries.op5_language(spark, "/root/testdata/sf0.01").join(full.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and out.score.between(0, 1).all()
    odd = language.predict(table(spark, [None, "", "12 !!", "ñ"]), language.fit(full)).orderBy("doc_id").collect()
    assert [x["lang_pred"] == "und" for x in odd] == [True, True, True, False]
    for n in (2, 5, 12):
        code = language.codewords(n)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= (1 if n == 2 else 3)
    assert language.predict(table(spark, ["a b"]), language.fit(table(spark, ["a b"]))).first()["lang_pred"] == "und"


def test_quality(spark, docs, texts):
    for frame, rows in ((docs, texts), (table(spark, ODD + ["a b\na b\n\na b", "x y z x y z x y"]), dict(enumerate(ODD + ["a b\na b\n\na b", "x y z x y z x y"])))):
        for r in quality.clean_lines(frame).collect():
            want = plain.quality(rows[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])
    text = "\n".join(["A plain line of words that ends well."] * 20 + ["Home | About | Login | Help", "Copyright, all rights reserved.", "BUY!! NOW!! HERE!!"])
    got = quality.clean_lines(table(spark, [text])).first()
    assert got["failed_lines"] == 3 and got["cleaned"].rstrip("\n") == "\n".join(text.split("\n")[:20])


def test_quality_tells_labelled_junk(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op6_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert (got.kept == (got.quality == 1)).mean() > 0.97


def test_secrets(spark, docs, texts):
    odd = ODD + ["token = token = longer_value_12", "API-key api_key:'abcdef.123456-x' passwd=short", "é AKIA" + "A1" * 9, "0123456789abcdef" * 2, "ſecret=abcdefghijklmnop"]
    rows = list(texts.values()) + odd
    frame = table(spark, rows)
    for r in secrets.scan(frame).collect():
        assert ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in r["spans"] if x["order"] < 3) == plain.secret_spans(rows[r["doc_id"]])


def test_secret_owners(spark):
    value, own, blob = "secret=copiedexample1", "secret=onlyoneowner12", "Zk3vQ8tY1mX7cB5nW2pL9rD4"
    rows = [(i, f"{value} {own if i == 3 else ''} {blob if i in (3, 4) else ''}", None, f"owner{i % 4}") for i in range(12)]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    first = got[3][0]
    assert (first["n_repos"], first["n_owners"], first["verdict"]) == (12, 4, "copied")
    assert [(x["kind"], x["verdict"]) for x in got[3]][1:] == [("assign", "live")]
    alone = spark.createDataFrame([(1, blob, None, "o")], SCHEMA)
    assert [(x["kind"], x["verdict"]) for x in secrets.scan(alone).first()["spans"]] == [("blob", "live")]


def test_licenses(spark, docs, texts):
    rows = list(texts.values()) + ODD + ["CC-BY cc/by ccby", "All rights reserved. all RIGHTS, reserved", "the GNU General Public License", "licensed under the Apache License, Version 2.0", "MIT licenses", "rights all reserved by cc", "ALL RIGHTS RESERVEDé"]
    for r in licenses.scan(table(spark, rows)).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain.licence_places(rows[r["doc_id"]]), rows[r["doc_id"]][:80]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    got = licenses.scan(table(spark, ["x Licensed under the Apache License, Version 2.0.", "Apache License"])).orderBy("doc_id").collect()
    assert [(x["labels"], x["score"]) for x in got] == [("apache-2.0", 1.0), ("", 0.0)]


@pytest.mark.parametrize(("window", "gram", "hot"), [(50, 8, 50_000), (50, 8, 5), (12, 4, 50_000)])
def test_substring_dedup(spark, window, gram, hot):
    r = random.Random(6)
    passage, rows = letters(r, 80), []
    for _ in range(120):
        w = letters(r, r.choice([0, 3, 40, 100]))
        if r.random() < 0.5:
            w += passage[r.randrange(10) : 80 - r.randrange(10)] + letters(r, r.choice([0, 5, 60]))
        if r.random() < 0.2:
            w += ["x"] * r.choice([10, 49, 50, 51, 120])
        rows.append(r.choice([" ", "\n", "  "]).join(w * r.choice([1, 1, 2])))
    rows += ODD[:6] + [rows[5], rows[6]]
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept"]) for x in substring_dedup.dedup(table(spark, rows), window=window, gram=gram, hot=hot).collect()}
    assert got == plain.drop_windows(list(enumerate(rows)), window)


def test_window_hash_collisions_are_compared(monkeypatch):
    monkeypatch.setattr(substring_dedup, "mix", lambda x: x * np.uint64(0))
    first, counts = substring_dedup.first_holders(pa.array(["a b c d", "x b c y", "b c z"]), np.array([5, 3, 9]), 2)
    assert counts.tolist() == [3, 3, 2] and first.tolist() == [5, 3, 5, 3, 3, 3, 3, 9]


def test_decontamination(spark):
    r = random.Random(5)
    items = [" ".join("".join(r.choice("abcdeé") for _ in range(r.randint(2, 7))) for _ in range(r.randint(4, 25))) for _ in range(12)] + ["short", "", None]
    rows = []
    for _ in range(60):
        x = list(r.choice(items[:12]))
        for _ in range(r.randint(0, 8)):
            at = r.randrange(len(x))
            x[at] = r.choice([r.choice("xyz"), x[at] + "z", ""]) or " "
        x = "".join(x)
        rows.append(" ".join(letters(r, r.randint(0, 20))) + r.choice([" ", "\n"]) + r.choice([x, x.upper(), x.replace(" ", "\n ")]) + " " + " ".join(letters(r, r.randint(0, 9))))
    rows += ODD[:6]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    frame = table(spark, rows)
    got = {(x["doc_id"], x["item_id"]): x for x in decontamination.matches(frame, bench).collect()}
    seen = 0
    for i, item in enumerate(items[:12]):
        p = plain.normal(item)
        budget = min(int(len(p) * decontamination.RATE), (len(p) - decontamination.Q) // decontamination.Q)
        for d, text in enumerate(rows):
            edits = plain.least_edits(p, plain.normal(text)) if text else 99
            assert (edits <= budget) == ((d, i) in got)
            if edits <= budget:
                x, seen = got[d, i], seen + 1
                assert x["edits"] == edits and plain.least_edits(p, plain.normal(text[x["start_at"] : x["end_at"]])) == edits
    assert seen > 10
    assert {x["doc_id"] for x in decontamination.clean(frame, bench).collect()} == set(range(len(rows))) - {d for d, _ in got}


def test_passages_of_items(spark):
    r = random.Random(6)
    items = [" ".join("".join(r.choice("abcdeé") for _ in range(r.randint(2, 7))) for _ in range(r.randint(8, 30))) for _ in range(8)]
    rows = []
    for n in range(60):
        x = r.choice(items)
        start = r.randrange(len(x))
        x = list(x[start : start + r.randint(30, 70)])
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(x))
            x[at] = r.choice(["x", x[at] + "z", ""]) or " "
        rows.append(" ".join(letters(r, n % 9)) + "".join(x) + " ".join(letters(r, r.randint(0, 9))))
    rows += items[:2] + ODD[:6]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    frame, length = table(spark, rows), decontamination.PASSAGE
    got = {(x["doc_id"], x["item_id"]): x for x in decontamination.matches(frame, bench, passage=length).collect()}
    whole = {(x["doc_id"], x["item_id"]) for x in decontamination.matches(frame, bench).collect()}
    seen = 0
    for i, item in enumerate(items):
        p = plain.normal(item)
        pieces = [p[s : s + length] for s in range(len(p) - length + 1)]
        for d, text in enumerate(rows):
            if (d, i) in whole:
                assert (d, i) in got
                continue
            # three edits cut 50 bytes into four parts, one of which has 11 bytes or more
            near = [x for x in pieces if any(x[s : s + 8] in plain.normal(text) for s in range(length - 8))]
            edits = min((plain.least_edits(x, plain.normal(text)) for x in near), default=99)
            assert (edits <= int(length * decontamination.RATE)) == ((d, i) in got)
            if (d, i) in got:
                assert got[d, i]["edits"] == edits
                seen += 1
    assert seen > 10 and len(whole) >= 2
    assert {x["doc_id"] for x in decontamination.clean(frame, bench, passage=length).collect()} == set(range(len(rows))) - {d for d, _ in got}


def test_blocks_of_items_cover_all(spark, docs):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    parts = list(decontamination.blocks(bench, "item_id", "text", 12, 0.04, block=3000))
    assert len(parts) > 1 and sorted(i for p in parts for i in p.ids) == sorted(r[0] for r in bench.select("item_id").collect())


def test_words_of_a_step():
    rows = ["a bb", None, "", " c\td ", "ÉE e"]
    found = words(pa.array(rows))
    assert [found.data[a:b].tobytes().decode() for a, b in zip(found.starts, found.ends, strict=True)] == [w for t in rows for w in plain.WORD.findall(t or "")]
    assert found.rows.tolist() == [0, 0, 3, 3, 4, 4] and found.first.tolist() == [0, 2, 2, 2, 4, 6]
    assert span_hashes(found.data, found.starts, found.ends, True)[4] != found.hashes()[4]


OPERATORS = {
    "sentencepiece": lambda d: sentencepiece_codec.encode_decode(d, PIECES), "jaccard": jaccard_join.join, "lines": line_dedup.dedup, "sharding": lambda d: sharding.placed(sharding.measured(d), sharding.first_map(sharding.slot_sizes(sharding.measured(d)), 4)),
    "language": lambda d: language.predict(d, language.fit(d)), "quality": quality.clean_lines, "secrets": secrets.scan, "licenses": licenses.scan, "substring": substring_dedup.dedup,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_columns(spark, name):
    """Null ids, repeated rows, null languages and owners, columns named like results; one row out for each row in."""
    clash = ["ids", "node", "tokens", "keys", "kept", "size", "shard", "slot", "score", "lang_pred", "row", "key", "body", "id", "n", "label", "spans", "bytes"]
    rows = [(None if i % 4 == 3 else i // 2, t, "en" if i % 2 else None, None) for i, t in enumerate(ODD + ["word " * 60, "word " * 60, None])]
    frame = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in clash])
    assert OPERATORS[name](frame).count() == len(rows)
    assert OPERATORS[name](frame.limit(0)).count() == 0


def test_decontamination_of_odd_tables(spark):
    frame = spark.createDataFrame([(None, t, None, None) for t in ODD], SCHEMA)
    bench = spark.createDataFrame([(None, "word word word word word"), (1, None)], "item_id int, text string")
    assert decontamination.matches(frame, bench).count() == 1
    assert decontamination.matches(frame.limit(0), bench).count() == 0 and decontamination.matches(frame, bench.limit(0)).count() == 0


def test_registered_queries_return_the_contracts_columns(spark):
    want = {
        "op1": "doc_id n_tokens ids_sha256 decoded_sha256", "op2": "doc_id n_shingles component_id", "op3": "doc_id n_lines n_dropped kept_sha256",
        "op4": "doc_id size text_crc32 law shard slot grown_shard", "op5": "doc_id held_out lang_pred score", "op6": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op7": "doc_id n_assign n_access n_hex base_sha256 spans", "op8": "doc_id n_words n_base first_word last_word base_labels labels score", "op9": "doc_id n_words n_removed kept_sha256", "op10": "doc_id item_id",
        "op11": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256", "op12": "doc_id start n_tokens ids_crc32",
        "op13": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    }
    for name, (query, _) in queries.QUERIES.items():
        got = query(spark, DATA)
        assert set(want[re.match(r"op\d+", name)[0]].split()) <= set(got.columns), name
