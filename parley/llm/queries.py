"""The queries of this subpackage, and the SQL of those that have some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, licenses, matroska, minhash, mixing, negatives, quality, resampling, separators, simhash, substrings, toxicity, warczip


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_matroska": matroska.op1_matroska,
    "op2_simhash": simhash.op2_simhash,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_separators": separators.op4_separators,
    "op5_bpe": bpe.op5_bpe,
    "op6_mixing": mixing.op6_mixing,
    "op7_substrings": substrings.op7_substrings,
    "op8_licenses": licenses.op8_licenses,
    "op9_warc": warczip.op9_warc,
    "op10_quality": quality.op10_quality,
    "op11_resampling": resampling.op11_resampling,
    "op12_negatives": negatives.op12_negatives,
    "op13_minhash": minhash.op13_minhash,
    "pipeline": pipeline,
}

OP9_SQL = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS digest FROM p),
k AS (SELECT digest, max(page_id) AS kept FROM d WHERE n >= 1000 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
 CASE WHEN kept IS NOT NULL AND kept IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN kept IS DISTINCT FROM page_id THEN kept END AS refers_to
FROM d LEFT JOIN k ON d.digest = k.digest AND n >= 1000"""

SQL: dict[str, str] = {"op6_mixing": mixing.oracle(), "op7_substrings": substrings.oracle(), "op9_warc": OP9_SQL, "op10_quality": quality.oracle(), "op11_resampling": resampling.oracle(), "op12_negatives": negatives.oracle(), "op13_minhash": minhash.oracle()}
