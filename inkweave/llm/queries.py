"""The registered query of each operator over its whole table, with the SQL that checks it where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.llm import conversation_repair, decontamination, jaccard_join, language, licenses, line_dedup, quality, secrets, sentencepiece_codec, sharding, substring_dedup, token_alignment, token_files
from inkweave.llm.text import bounded, documents
from inkweave.session import shared_dir

#: The vocabulary file of operator 1; a parameter of the operator.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: The other tokenizer of operator 11.
BYTE_TOKENS = public_tokenizers.path("byte_bpe_50k.json")
#: The tokenizer of operator 12 and the id that ends a document; parameters of the operator.
WORD_TOKENS, END_ID = public_tokenizers.path("word_bpe_49k.json"), 2


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text of these ids, as digests."""
    out = sentencepiece_codec.encode_decode(documents(spark, sf_dir), PIECES)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes, by version 1 of a stored slot map."""
    rows = sharding.measured(documents(spark, sf_dir))
    path = f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    sharding.store_map(sharding.first_map(sharding.slot_sizes(rows), 40), path)
    out = sharding.placed(rows, sharding.load_map(spark, path, 1))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = documents(spark, sf_dir)
    out = language.predict(docs, language.fit(docs))
    return out.withColumn("held_out", language.held_out("doc_id"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the line-first rules for every document."""
    return quality.clean_lines(documents(spark, sf_dir)).drop("cleaned")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with the verdicts of their owners' counts."""
    found = secrets.scan(documents(spark, sf_dir))
    base = F.filter("spans", lambda x: x["order"] < 3)
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    many = lambda name, value: F.size(F.filter("spans", lambda x: x[name] == value)).cast("long")
    return found.select("doc_id", many("order", 0).alias("n_assign"), many("order", 1).alias("n_access"), many("order", 2).alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"),
                        text(F.col("spans")).alias("spans"), many("verdict", "live").alias("n_live"), many("verdict", "copied").alias("n_copied"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    return licenses.scan(documents(spark, sf_dir))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return jaccard_join.join(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that three or more documents share, but for the last holder."""
    out = line_dedup.dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 50-word windows that an earlier document holds."""
    out = substring_dedup.dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in documents, with up to 7 edits for each 100 bytes."""
    return decontamination.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers aligned in every document, with corpus-wide counts of linked ids."""
    return token_alignment.links(documents(spark, sf_dir), BYTE_TOKENS, PIECES)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed token files of all documents, read back: place, size and checksum of each document."""
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(documents(spark, sf_dir), path, WORD_TOKENS, END_ID)
    out = token_files.read(spark, path, as_bytes=True)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after the contract's damage."""
    turns = bounded(spark).read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_repair.summary(conversation_repair.damaged(turns), F.col("present"))


SQL_LINES = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), common AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.doc_id, line, pos, common.k IS NOT NULL AND keyed.doc_id < top AS gone FROM keyed LEFT JOIN common ON keyed.k = common.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

SQL_SHINGLES = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM texts WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM texts WHERE len(w) BETWEEN 1 AND 4
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON a = r
)
SELECT reach.doc_id, coalesce(min(n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY reach.doc_id
"""

SQL_WINDOWS = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM texts
), windows AS (
  SELECT doc_id, pos, md5(array_to_string(w[pos:pos + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS pos FROM texts WHERE len(w) >= 50)
), firsts AS (
  SELECT h, min(doc_id) AS f FROM windows GROUP BY h
), again AS (
  SELECT doc_id, pos FROM windows JOIN firsts USING (h) WHERE f < doc_id
), marked AS (
  SELECT words.doc_id, word, words.pos, count(again.pos) OVER (PARTITION BY words.doc_id ORDER BY words.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM words LEFT JOIN again ON again.doc_id = words.doc_id AND again.pos = words.pos
), kept AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS g, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS t FROM marked GROUP BY doc_id
)
SELECT documents.doc_id, coalesce(n, 0) AS n_words, coalesce(g, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)
"""

SQL_CONVERSATIONS = r"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
      list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT),
      lambda c, b: list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(c, b)), 4294967295), 4294967295) % 20 AS kind
  FROM conversations
), hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded CROSS JOIN range(2) AS copy(n) WHERE n < CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS again FROM hurt
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i FROM seen
), marked AS (
  SELECT *, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS p, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN again > 1 THEN 2
    WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 3 ELSE 0 END AS fault FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
    count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE p || r NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM marked GROUP BY conv_id
), walk AS (
  SELECT conv_id, 0 AS i, {'c': 0::BIGINT, 'a': '', 't': ''} AS e, {'c': 1000000000::BIGINT, 'a': '', 't': ''} AS s,
    {'c': 2::BIGINT, 'a': 'I', 't': chr(10) || 'user:'} AS u, {'c': 4::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} AS a FROM counted
  UNION ALL
  SELECT conv_id, i, e, s, u, list_min([a, {'c': u.c + 2, 'a': u.a || 'I', 't': u.t || chr(10) || 'assistant:'}]) FROM (
    SELECT conv_id, i, e, s, a, list_min([u, {'c': e.c + 2, 'a': e.a || 'I', 't': e.t || chr(10) || 'user:'}, {'c': s.c + 2, 'a': s.a || 'I', 't': s.t || chr(10) || 'user:'},
      {'c': a.c + 2, 'a': a.a || 'I', 't': a.t || chr(10) || 'user:'}]) AS u FROM (
      SELECT conv_id, i, {'c': e.c + 3, 'a': e.a || 'D', 't': e.t} AS e,
        list_min([{'c': s.c + 3, 'a': s.a || 'D', 't': s.t}, {'c': e.c + keep + CASE r WHEN 's' THEN 0 ELSE 1000000000::BIGINT END, 'a': e.a || 'K', 't': e.t || kept}]) AS s,
        list_min([{'c': u.c + 3, 'a': u.a || 'D', 't': u.t}, {'c': e.c + as_user, 'a': e.a || 'K', 't': e.t || kept}, {'c': s.c + as_user, 'a': s.a || 'K', 't': s.t || kept},
          {'c': a.c + as_user, 'a': a.a || 'K', 't': a.t || kept}, {'c': e.c + keep + 2, 'a': e.a || 'R', 't': e.t || chr(10) || 'user:' || text},
          {'c': s.c + keep + 2, 'a': s.a || 'R', 't': s.t || chr(10) || 'user:' || text}, {'c': a.c + keep + 2, 'a': a.a || 'R', 't': a.t || chr(10) || 'user:' || text}]) AS u,
        list_min([{'c': a.c + 3, 'a': a.a || 'D', 't': a.t}, {'c': u.c + keep + CASE r WHEN 'a' THEN 0 ELSE 1000000000::BIGINT END, 'a': u.a || 'K', 't': u.t || kept},
          {'c': u.c + keep + 2, 'a': u.a || 'R', 't': u.t || chr(10) || 'assistant:' || text}]) AS a
      FROM (
        SELECT walk.conv_id, marked.i, e, s, u, a, text, r, chr(10) || role || ':' || text AS kept, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 1 ELSE 1000000000::BIGINT END AS keep,
          CASE fault WHEN 0 THEN 0 WHEN 3 THEN 1 ELSE 1000000000::BIGINT END + CASE r WHEN 'u' THEN 0 ELSE 1000000000::BIGINT END AS as_user
        FROM walk JOIN marked ON walk.conv_id IS NOT DISTINCT FROM marked.conv_id AND marked.i = walk.i + 1)))
), done AS (
  SELECT walk.conv_id, list_min([e, walk.a]) AS best FROM walk JOIN counted ON walk.conv_id IS NOT DISTINCT FROM counted.conv_id AND walk.i = counted.n
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted ON o.conv_id IS NOT DISTINCT FROM counted.conv_id LEFT JOIN done ON o.conv_id IS NOT DISTINCT FROM done.conv_id
"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_sentencepiece": (op1_sentencepiece, None),
    "op2_jaccard_join": (op2_jaccard_join, SQL_SHINGLES),
    "op3_line_dedup": (op3_line_dedup, SQL_LINES),
    "op5_language": (op5_language, None),
    "op8_licenses": (op8_licenses, None),
    "op6_quality": (op6_quality, None),
    "op7_secrets": (op7_secrets, None),
    "op9_substring_dedup": (op9_substring_dedup, SQL_WINDOWS),
    "op10_decontamination": (op10_decontamination, None),
    "op4_sharding": (op4_sharding, None),
    "op11_token_alignment": (op11_token_alignment, None),
    "op12_token_files": (op12_token_files, None),
    "op13_conversation_repair": (op13_conversation_repair, SQL_CONVERSATIONS),
}
