import corpus_pipeline
import plain
import sentencepiece
from pyspark.sql import functions as F

from inkweave.session import stage

DATA = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, DATA))
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "sentencepiece":
            assert docs.columns == columns, name
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert set(kept["language_id"]) == {i for i, t in texts.items() if t and any(map(str.isalpha, t))}
    lines = plain.drop_lines([(i, r["text"]) for i, r in kept["language_id"].items()])
    had = {i: bool(plain.WORD.search(r["text"] or "")) for i, r in kept["language_id"].items()}
    assert {i: r["text"] for i, r in kept["line_dedup"].items()} == {i: x[2] for i, x in lines.items() if plain.WORD.search(x[2]) or not had[i]}
    assert all(r["n_chars"] == len(r["text"]) for r in kept["line_dedup"].values())
    rows = [(i, r["text"]) for i, r in kept["line_dedup"].items()]
    first = {i for (i, _), (n, c) in zip(rows, plain.components(rows), strict=True) if c == i}
    assert set(kept["near_duplicates"]) == first
    items = [plain.normal(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    holds = {i for i, r in kept["near_duplicates"].items() if any(x in plain.normal(r["text"]) for x in items)}
    assert set(kept["decontamination"]) == first - holds and holds
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECES)
    for i, r in kept["sentencepiece"].items():
        assert r["ids"] == library.encode(kept["decontamination"][i]["text"]) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == plain.sha(library.decode(r["ids"]))
    assert set(kept["sentencepiece"]) == set(kept["decontamination"])
    assert all(r["n_tokens"] for r in kept["sentencepiece"].values())
    assert corpus_pipeline.run(spark, DATA).count() == len(kept["sentencepiece"])


def test_items_torn_by_line_dedup_are_found(spark, tmp_path):
    first = "which of the rivers of the north carries the most water in spring and why"
    item = f"{first}\ndoes it freeze before the others of the land do\ngive the name"
    texts = [f"{i} boats {item} {i} end" for i in range(3)] + [f"3 boats {first[:40]} and more"] + [f"4 boats {first.replace('north', 'nOrrh').replace('most', 'mst')} 4 end"]
    kinds = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").schema
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], kinds)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    torn = stage(corpus_pipeline.dedup_lines(spark, docs, str(tmp_path)))
    assert [plain.normal(item) in plain.normal(r["text"]) for r in torn.orderBy("doc_id").collect()] == [False, False, True, False, False]
    assert [r["doc_id"] for r in corpus_pipeline.benchmark_free(spark, torn, str(tmp_path)).collect()] == [3]


def test_stages_on_odd_tables(spark, tmp_path):
    line = "a line of some length that many documents hold"
    words = " ".join(f"word{k}" for k in range(60))
    texts = [(None, line), (1, f"{line}\nown words of one"), (2, line), (2, None), (3, ""), (4, " \n\t"), (5, words), (5, words), (6, words + " more"), (None, words), (7, line), (8, "x" * 200_000)]
    names = ["kept", "doc_id", "n_lines", "__key", "text", "keys", "id", "component_id", "least"]
    docs = spark.createDataFrame([(str(k), i, k, k, t, "k", k, k, k) for k, (i, t) in enumerate(texts)],
                                 "kept string, doc_id long, n_lines long, __key long, text string, keys string, id long, component_id long, least long").repartition(3)
    spark.createDataFrame([(0, "an item of the benchmark that no document of this table holds anywhere")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    deduped = stage(corpus_pipeline.dedup_lines(spark, docs, str(tmp_path)))
    assert deduped.columns == names
    # a common line stays in its largest holders; rows that held nothing else go
    assert {(r["n_lines"], r["text"]) for r in deduped.collect()} == {
        (1, "own words of one"), (3, ""), (4, ""), (5, " \n\t"), (6, words), (7, words), (8, words + " more"), (10, line), (11, "x" * 200_000)}
    near = stage(corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)))
    assert near.columns == names and {r["kept"] for r in near.collect()} == {"1", "2", "3", "4", "5", "6", "7", "11"}
    free = corpus_pipeline.benchmark_free(spark, docs, str(tmp_path))
    assert free.columns == names and free.count() == len(texts)
    done = corpus_pipeline.tokens(spark, docs, str(tmp_path))
    assert done.count() == len(texts)
    for _, function in corpus_pipeline.STAGES[1:]:
        assert function(spark, docs.limit(0), str(tmp_path)).collect() == []
    languages = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, languages, str(tmp_path)).collect() == []
