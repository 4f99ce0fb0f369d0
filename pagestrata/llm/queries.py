"""Queries of this subpackage, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, jaccard_join, line_dedup, lm, packing, pii, quality, sharding, sstable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cgk_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(_table(spark, sf_dir, "documents"), 8)


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(_table(spark, sf_dir, "documents").select("doc_id", "text"), "example key, not a secret")


def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op6_prefix_tree_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), 4, 85, 100)


def op7_winnowed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.roundtrip(_table(spark, sf_dir, "documents"))


def op9_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op10_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_cgk_decontaminate, op2_jump_shards, op3_feistel_pseudonyms, op4_rule_ensemble, op5_vector_best_fit, op6_prefix_tree_jaccard, op7_winnowed_lines, op8_sstable, op9_anisotropic_search, op10_backoff_automaton)}
ORACLE_SQL: dict[str, str] = {
    "op6_prefix_tree_jaccard": r"""WITH RECURSIVE
  w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 4) q
    UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 3),
  n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
  inter AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
  links AS (SELECT x, y FROM inter JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
  twoway AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
  reach AS (SELECT x AS a, x AS b FROM twoway UNION SELECT a, y FROM reach JOIN twoway ON b = x),
  least AS (SELECT a, MIN(b) AS c FROM reach GROUP BY 1)
  SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, COALESCE(least.c, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.a = d.doc_id""",
}
