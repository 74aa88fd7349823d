"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.llm import decontamination, jaccard_join, language, line_dedup, sentencepiece_codec
from inkweave.llm.text import bounded, documents
from inkweave.session import stage

#: The vocabulary file of the last stage; a parameter.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: A word of a text.
WORD = r"[^\x20\x09-\x0D]"
#: Stands for a null id.
NO_ID = -(2**63)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter and ambiguous ones go, null and empty texts among them.

    Only the text decides, whole and of any length; null or repeated ids and repeated rows stay as
    they are; all columns stay, whatever their names; an empty table, or one without a ``lang`` to
    learn from, gives an empty result.
    """
    bounded(spark)
    return language.accepted(docs, language.fit(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in the last one only; n_chars, where there is one, follows the text.

    A document that loses its last word this way goes: all it said stands in others. One that had no
    word before (null, empty or blank text) stays. Null ids count as the least id, repeated rows each;
    texts of any length are taken whole; other columns stay, whatever their names; an empty table
    gives an empty result.
    """
    bounded(spark)
    private = {c: f"__column_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    had = F.col("text").rlike(WORD)
    named = docs.select("doc_id", "text", F.coalesce(had, F.lit(False)).alias("__had"), *[F.col(f"`{c}`").alias(p) for c, p in private.items()])
    out = line_dedup.dedup(named, keep=["__had", *private.values()]).where(~F.col("__had") | F.col("kept").rlike(WORD))
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept"), **{c: F.col(p) for c, p in private.items()}}
    if "n_chars" in private:
        columns["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return out.select(*[columns[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies.

    Rows with one id count as one document, and so do rows without an id. Null, empty and blank
    texts are like no other and stay; equal texts are near copies, so of ties the least id stays.
    Texts of any length are compared whole; all columns stay, whatever their names; an empty table
    gives an empty result.
    """
    bounded(spark)
    groups = jaccard_join.join(docs.select("doc_id", "text"))
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("least")).distinct()
    rows, kept = docs.alias("rows"), first.alias("kept")
    return rows.join(kept, F.coalesce(F.col("rows.doc_id").cast("long"), F.lit(NO_ID)) == F.col("kept.least"), "left_semi")


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item or a long passage of one: line dedup takes common lines out of items before.

    Texts are searched whole, whatever their length; null and empty ones stay, as do null or repeated
    ids and repeated rows without an item. All columns stay, whatever their names; an empty table
    gives an empty result, and an empty benchmark takes nothing away.
    """
    bounded(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), passage=decontamination.PASSAGE)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and digests of them and of the text that they decode to.

    A null text is an empty one; null or repeated ids and repeated rows give a row each; other columns
    are ignored; an empty table gives an empty result.
    """
    bounded(spark)
    out = sentencepiece_codec.encode_decode(docs, PIECES)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_free),
    ("sentencepiece", tokens),
]

#: Merge rounds, learned weights and edit distances are beyond SQL; tests hold the run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
