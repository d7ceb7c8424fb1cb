"""Queries over the whole synthetic tables, one for each operator, and their SQL where it can be written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import binary_store, chat, distinct_bpe, minhash, packing, pii, quality, secret_scan, substring, topk
from .common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS k FROM words, unnest(range(1, len(w) - 11)) AS r(i) WHERE len(w) >= 13),
least_of AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS place FROM windows JOIN least_of USING (k), range(0, 13) AS o(j) WHERE first < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM words),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS t FROM each ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


def op5_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapsed(table(spark, sf_dir, "conversations"))


OP5_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, string_agg(length(role) || ':' || length(text) || ':' || role || text, '|') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM t),
f AS (SELECT conv_id, n, prefix FROM p WHERE pos = n),
kept AS (SELECT conv_id FROM f WHERE NOT EXISTS (
  SELECT 1 FROM p WHERE p.pos = f.n AND p.prefix = f.prefix AND (p.n > f.n OR p.n = f.n AND p.conv_id < f.conv_id)))
SELECT conv_id, (pos - 1) // 64 AS part, max(n) AS n_turns,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM t JOIN kept USING (conv_id) GROUP BY conv_id, (pos - 1) // 64
"""


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM words, unnest(range(1, len(w) - 3)) AS r(i) WHERE len(w) >= 5
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT node, b FROM reach JOIN edges ON a = seen),
least_of AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least_of ON node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON c.row <> q.row WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_store.store(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return distinct_bpe.encode(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_quality": op1_quality, "op2_packing": op2_packing, "op3_secret_scan": op3_secret_scan, "op4_substring_dedup": op4_substring_dedup, "op5_chat_collapse": op5_chat_collapse, "op6_minhash": op6_minhash, "op7_exact_topk": op7_exact_topk, "op8_token_store": op8_token_store, "op9_byte_bpe": op9_byte_bpe, "op10_pii_surrogates": op10_pii_surrogates}


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": OP4_SQL, "op5_chat_collapse": OP5_SQL, "op6_minhash": OP6_SQL, "op7_exact_topk": OP7_SQL}
