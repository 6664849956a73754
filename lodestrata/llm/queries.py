"""The numbered queries over the documents and conversations tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, language_id, lz_fingerprint, mixing, near_dedup, phrases, pii, prefix_trie, quality, sentencepiece, suffix_dedup, token_counts
from .shared import fold


#: The public model that the queries encode with; the operator takes any path.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.membership(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    back = chat.read_back(chat.windows(turns.unionByName(extra)))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select("conv_id", "n_turns", sha(chat.turns_text(F.col("turns"))).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"), sha(F.col("loss_text")).alias("loss_sha256"), "formatted_chars")


def op4_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.chained(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.train(docs))
    return found.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode_documents(table(spark, sf_dir, "documents"), sentencepiece.load(MODEL))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.MergeModel.load(public_tokenizers.path("word_bpe_49k.json")))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = (op1_simhash_near_dedup, op2_exact_dedup, op3_chat_formatting, op4_lz_fingerprints, op5_suffix_dedup, op6_pii, op7_language_id, op8_sentencepiece, op9_quality_classifier, op10_mixing, op11_prefix_trie, op12_token_counts, op13_phrase_mining)
    return {f.__name__: f for f in numbered}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op11_prefix_trie": OP11_SQL, "op13_phrase_mining": OP13_SQL}


OP2_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC) = 1 AS kept,
       text_sha256
FROM d
"""

OP11_SQL = """
WITH crc AS (SELECT list_transform(range(256), lambda x : list_reduce(list_prepend(x, range(8)), lambda c, k : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
own AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS seq
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT c, seq, c - c % 100 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x : ascii(x)::BIGINT)), lambda v, b : xor(v >> 8, t[(xor(v, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM own, crc),
conv AS (SELECT h.c, coalesce(b.seq[1:h], []) || h.seq[h + 1:] AS seq FROM h LEFT JOIN own b ON b.c = h.base),
member AS (SELECT c, unnest(range(len(seq) + 1)) AS depth, seq FROM conv),
node AS (
  SELECT seq[1:depth] AS k, depth, min(c) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(seq) = depth), '') AS ends
  FROM member GROUP BY 1, 2),
linked AS (SELECT n.*, p.conv_id AS parent_conv_id, (n.n_convs - 1) * coalesce(length(n.k[n.depth].t), 0) AS saves FROM node n LEFT JOIN node p ON p.depth = n.depth - 1 AND p.k = n.k[1:n.depth - 1]),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY 1, 2),
full_node AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN kids USING (conv_id, depth)),
above AS (SELECT k, depth, saves, n_children, unnest(range(depth + 1)) AS up FROM full_node),
below AS (SELECT k[1:up] AS k, up AS depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saves)::BIGINT AS saved_tokens FROM above GROUP BY 1, 2)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256
FROM full_node JOIN below USING (k, depth)
"""

OP13_SQL = """
WITH piece AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p
  FROM documents),
word AS (SELECT lang, piece, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM piece)),
spot AS (SELECT lang, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM word WINDOW o AS (PARTITION BY piece ORDER BY i)),
f AS (
  SELECT lang, [x] AS g, count(*) AS f FROM spot GROUP BY lang, x
  UNION ALL SELECT lang, [x, y], count(*) FROM spot WHERE y IS NOT NULL GROUP BY lang, x, y HAVING count(*) >= 10
  UNION ALL SELECT lang, [x, y, z], count(*) FROM spot WHERE z IS NOT NULL GROUP BY lang, x, y, z HAVING count(*) >= 10),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(g) = 1 GROUP BY 1),
cand AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1 AND f >= 10),
cut AS (
  SELECT c.lang, c.g, c.a, k, x.f AS l, y.f AS r, 1000000 * c.a::HUGEINT * c.a // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM cand) c
  JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
longer AS (SELECT lang, g, max(a) AS longer FROM (SELECT lang, unnest([g[1:2], g[2:3]]) AS g, a FROM cand WHERE len(g) = 3) GROUP BY 1, 2),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.g = b.g WHERE o.longer IS NULL OR 100 * o.longer < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN total USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) <= 2000
"""
