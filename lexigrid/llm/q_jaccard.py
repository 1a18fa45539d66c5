"""Query op5_jaccard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import jaccard


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id AND a.n * 100 >= b.n * 70 AND b.n * 100 >= a.n * 70 GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 70 * (na + nb - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CAST((SELECT count(*) FROM links l WHERE l.a = s.doc_id) AS BIGINT) AS n_similar,
       least(s.doc_id, coalesce((SELECT min(r.b) FROM reach r WHERE r.a = s.doc_id), s.doc_id)) AS component_id
FROM sets s
"""

QUERIES, ORACLES = {"op5_jaccard": op5_jaccard}, {"op5_jaccard": SQL}
