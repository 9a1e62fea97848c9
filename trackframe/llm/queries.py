"""The queries of the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackframe.llm import bpe_count, decontaminate, kd_search, mixing, ngram_lm, quality, recompression, secret_scan, simhash, suffix_dedup
from trackframe.llm.common import configure


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op2_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.digest(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_documents(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_count.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(_table(spark, sf_dir, "documents")))


def op9_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = kd_search.usable(_table(spark, sf_dir, "embeddings"))
    return kd_search.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_recompression": op2_recompression,
    "op3_decontaminate": op3_decontaminate,
    "op4_kneser_ney": op4_kneser_ney,
    "op5_quality": op5_quality,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_mixing": op8_mixing,
    "op9_kd_search": op9_kd_search,
    "op10_simhash": op10_simhash,
}

ORACLES: dict[str, str] = {
    "op2_recompression": """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), windows AS (
  SELECT doc_id, i AS start, array_to_string(words[i : i + 19], ' ') AS seq FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w)
), later AS (
  SELECT doc_id, start FROM windows QUALIFY row_number() OVER (PARTITION BY seq ORDER BY doc_id, start) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS i FROM later
), each AS (
  SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w
), kept AS (
  SELECT e.doc_id, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN word END, ' ' ORDER BY e.i) AS rest
  FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
""",
    "op6_suffix_dedup": """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents
), windows AS (
  SELECT doc_id, i, md5(substr(hx, 2 * i + 1, 400)) AS seq FROM (SELECT doc_id, hx, unnest(range(0, len(hx) // 2 - 199)) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY seq) > 1
), runs AS (
  SELECT doc_id, i, sum(CASE WHEN i - before <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM twice)
), spans AS (
  SELECT doc_id, min(i) AS s, max(i) + 200 AS e FROM runs GROUP BY doc_id, run
), kept AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS b FROM spans
  UNION ALL SELECT doc_id, max(e) AS a, NULL AS b FROM spans GROUP BY doc_id
  UNION ALL SELECT doc_id, 0 AS a, NULL AS b FROM d WHERE doc_id NOT IN (SELECT doc_id FROM spans)
), rest AS (
  SELECT d.doc_id, string_agg(substr(hx, 2 * a + 1, 2 * (coalesce(b, len(hx) // 2) - a)), '' ORDER BY a) AS hx FROM kept JOIN d ON d.doc_id = kept.doc_id GROUP BY d.doc_id
)
SELECT d.doc_id, len(d.hx) // 2 AS n_bytes, (len(d.hx) - len(rest.hx)) // 2 AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(rest.hx)) AS kept_sha256
FROM d JOIN rest ON rest.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id) c ON c.doc_id = d.doc_id
""",
    "op9_kd_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
}
