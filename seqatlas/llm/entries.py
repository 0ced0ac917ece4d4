"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqatlas.llm import (
    bit_clusters, decontaminate, fingerprint, html_text, language, licenses, near_duplicates, packing, suffix_dedup, token_counts, tool_calls,
    vector_codes, wavelet,
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_read(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.neighbour_fingerprints(_read(spark, sf_dir, "documents"))


def op3_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.label_documents(_read(spark, sf_dir, "documents"))


def op4_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_read(spark, sf_dir, "documents")).drop("key", "keeps")


def op5_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op6_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_files(wavelet.write_files(_read(spark, sf_dir, "documents")))


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link_conversations(_read(spark, sf_dir, "conversations"))


def op8_benchmark_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.hit_words(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return hits.drop("item_ids", "spans")


def op9_sorted_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Passages of over fifty words, as the pipeline cuts them, can be shorter than the 400 bytes of the contract's columns.
    return suffix_dedup.repeated_bytes(_read(spark, sf_dir, "documents"), gram=80, passage=250)


def op10_boosted_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_text.main_texts(_read(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op11_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"))


def op12_resident_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded_vectors(_read(spark, sf_dir, "embeddings"))


def op13_bit_plane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_clusters.cluster_vectors(_read(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_pattern_packing, op2_multiset_fingerprints, op3_language_codes, op4_weighted_minhash, op5_license_join,
        op6_wavelet_tokens, op7_tool_calls, op8_benchmark_automaton, op9_sorted_suffixes, op10_boosted_extraction,
        op11_merge_counts, op12_resident_codes, op13_bit_plane_clusters, pipeline,
    )
}

TOOL_CALLS_SQL = """
WITH RECURSIVE c AS (
  SELECT conv_id, turn, role, text, 'call_' || conv_id || '_' || turn AS call_id FROM conversations WHERE role IN ('user', 'system')),
k AS (SELECT c.*, coalesce(a.call_id, b.call_id) AS parent_id
      FROM c LEFT JOIN c a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 LEFT JOIN c b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2),
v(call_id, level) AS (SELECT call_id, 0 FROM k WHERE parent_id IS NULL UNION ALL SELECT k.call_id, level + 1 FROM k JOIN v ON k.parent_id = v.call_id),
r AS (SELECT conv_id, turn, text, 'call_' || conv_id || '_' || (turn - 1) AS call_id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS nth, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM conversations WHERE role = 'assistant'),
j AS (SELECT k.*, CASE role WHEN 'user' THEN 'ask' ELSE 'configure' END AS name, v.level, r.turn AS result_turn, r.text AS content, coalesce(r.n, 0) AS n_results
      FROM k JOIN v USING (call_id) LEFT JOIN r ON r.call_id = k.call_id AND r.nth = 1),
e AS (SELECT *, concat_ws('; ', CASE WHEN text IS NULL THEN 'text is missing' END, CASE WHEN text = '' THEN 'text is too small' END,
      CASE WHEN name = 'configure' AND turn > 0 THEN 'turn is too large' END, CASE WHEN length(text) > 4000 THEN 'chars is too large' END,
      CASE WHEN result_turn IS NULL THEN 'no result' END) AS errors FROM j)
SELECT conv_id, call_id, name, turn, parent_id, CAST(level AS BIGINT) AS level, result_turn, n_results,
  errors = '' AS valid, errors,
  CAST(json_object('arguments', json_object('chars', length(text), 'text', text, 'turn', turn), 'id', call_id, 'name', name, 'parent', parent_id, 'result', content) AS VARCHAR) AS canonical
FROM e
UNION ALL
SELECT conv_id, call_id, NULL, NULL, NULL, NULL, turn, 1, false, 'no call',
  CAST(json_object('arguments', NULL, 'id', call_id, 'name', NULL, 'parent', NULL, 'result', text) AS VARCHAR)
FROM r WHERE call_id NOT IN (SELECT call_id FROM c)
UNION ALL
SELECT conv_id, call_id, NULL, NULL, NULL, NULL, turn, 1, false, 'further result',
  CAST(json_object('arguments', NULL, 'id', call_id, 'name', NULL, 'parent', NULL, 'result', text) AS VARCHAR)
FROM r WHERE nth > 1 AND call_id IN (SELECT call_id FROM c)
UNION ALL
SELECT conv_id, NULL, NULL, turn, NULL, NULL, NULL, 0, false, 'unknown role',
  CAST(json_object('arguments', json_object('chars', length(text), 'role', role, 'text', text, 'turn', turn), 'id', NULL, 'name', NULL, 'parent', NULL, 'result', NULL) AS VARCHAR)
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'system', 'assistant')"""

ORACLE = {
    "op5_license_join": licenses.scan_sql(), "op7_tool_calls": TOOL_CALLS_SQL,
    "op12_resident_codes": vector_codes.codes_sql(), "op13_bit_plane_clusters": bit_clusters.clusters_sql(),
}
