"""Query op4_warc."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, warc


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.shared_dir(spark, "archive")
    index = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder)
    return warc.read(index, folder, payloads=False).drop("payload", "url")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM m
"""

QUERIES, ORACLES = {"op4_warc": op4_warc}, {"op4_warc": SQL}
