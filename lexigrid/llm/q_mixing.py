"""Query op9_mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import mixing


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return mixing.taken(found).select("doc_id", "size", "source_size", "target", "taken", "pieces", "first_slot")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS sid FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST(sid % 3 + 1 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM per),
filled AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS capped,
            sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM weighed),
level AS (
  SELECT (total - capped) / open AS level FROM filled WHERE (total - capped) / open * weight <= cap ORDER BY cap / weight, sid LIMIT 1),
target AS (
  SELECT sid, source, source_size, least(coalesce((SELECT level FROM level) * weight, cap), cap) AS target FROM filled),
placed AS (
  SELECT row_number() OVER () AS rid, s.doc_id, s.size, t.sid, t.source_size, t.target, least(CAST(round(t.target) AS BIGINT), 3 * t.source_size) AS take,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY t.sid ORDER BY s.h, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN target t ON s.source IS NOT DISTINCT FROM t.source),
blocks AS (SELECT sid, CAST(ceil(least(round(target), 3 * source_size) / 1024.0) AS BIGINT) AS blocks FROM target),
total AS (SELECT CAST(sum(blocks) AS BIGINT) AS slots FROM blocks),
spans AS (
  SELECT sid, blocks, hi / greatest(slots, 1)::DOUBLE AS hi, (hi - blocks) / greatest(slots, 1)::DOUBLE AS lo
  FROM (SELECT sid, blocks, CAST(sum(blocks) OVER (ORDER BY sid) AS BIGINT) AS hi FROM blocks), total),
points AS (SELECT k AS slot, k * 0.6180339887498949::DOUBLE + 0.5::DOUBLE - floor(k * 0.6180339887498949::DOUBLE + 0.5::DOUBLE) AS u FROM (SELECT unnest(range(slots)) AS k FROM total)),
hits AS (SELECT slot, sid, blocks, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS block FROM points JOIN spans ON u >= lo AND u < hi),
reached AS (SELECT b.sid, b.blocks, count(h.slot) AS got FROM blocks b LEFT JOIN hits h ON h.sid = b.sid GROUP BY ALL),
late AS (SELECT sid, unnest(range(got, blocks)) AS block FROM reached WHERE got < blocks),
schedule AS (
  SELECT slot, sid, block FROM hits WHERE block < blocks
  UNION ALL SELECT slots + row_number() OVER (ORDER BY block, sid) - 1, sid, block FROM late, total),
laid AS (
  SELECT rid, sid, lo, least(lo + size, take) AS hi FROM (SELECT rid, sid, size, take, start + e * source_size AS lo FROM placed, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0) WHERE lo < take),
cut AS (SELECT rid, sid, lo, hi, unnest(range(lo // 1024, (hi - 1) // 1024 + 1)) AS block FROM laid),
pieces AS (SELECT rid, slot, least(hi, (block + 1) * 1024) - greatest(lo, block * 1024) AS n FROM cut JOIN schedule USING (sid, block)),
words AS (SELECT rid, CAST(sum(n) AS BIGINT) AS taken, count(*) AS pieces, CAST(min(slot) AS BIGINT) AS first_slot FROM pieces GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, coalesce(pieces, 0) AS pieces, first_slot
FROM placed LEFT JOIN words USING (rid)
"""

QUERIES, ORACLES = {"op9_mixing": op9_mixing}, {"op9_mixing": SQL}
