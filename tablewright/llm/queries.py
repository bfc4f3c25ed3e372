"""The operators as registered queries, over their whole tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import langid, licenses, linededup, merkle, mixing, neardup, negatives, packing, quality, sharding, simhash, suffix, topk
from tablewright.llm.common import table

LINES_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), m AS (
  SELECT k.*, f.first_doc IS NOT NULL AND k.doc_id > f.first_doc AS gone FROM k LEFT JOIN f USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Lines, dropped lines and digest of every document."""
    docs = table(spark, folder, "documents")
    out = linededup.kept_lines(docs, linededup.keep_bitmaps(docs))
    return out.select(
        "doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"),
        F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": langid.op1,
    "op2_simhash_near_dedup": simhash.op2,
    "op3_line_dedup": op3,
    "op4_quality_classifier": quality.op4,
    "op5_embedding_near_dedup": neardup.op5,
    "op6_sharding": sharding.op6,
    "op7_source_mixing": mixing.op7,
    "op8_exact_top_k": topk.op8,
    "op9_best_fit_packing": packing.op9,
    "op10_suffix_dedup": suffix.op10,
    "op11_license_scan": licenses.op11,
    "op12_merkle_manifest": merkle.op12,
    "op13_hard_negatives": negatives.op13,
}
CHECKS: dict[str, str] = {
    "op3_line_dedup": LINES_SQL, "op8_exact_top_k": topk.SQL, "op12_merkle_manifest": merkle.SQL, "op13_hard_negatives": negatives.SQL,
}
