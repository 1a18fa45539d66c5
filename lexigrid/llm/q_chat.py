"""Query op6_chat: every conversation against itself with another conversation's last answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    chosen = common.table(chat.positions(turns), common.shared_dir(spark, "chat"), "chosen")
    return chat.format_pairs(chosen, chat.swapped_answers(chosen))


SQL = r"""
WITH turns AS (SELECT DISTINCT conv_id AS pair_id, turn, role, text FROM conversations),
chosen AS (
  SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos, role, text FROM turns),
last AS (
  SELECT pair_id, max(pos) AS last, arg_max(coalesce(text, ''), pos) AS answer FROM chosen WHERE role = 'assistant' AND pair_id IS NOT NULL GROUP BY pair_id),
rejected AS (
  SELECT c.pair_id, c.pos, c.role, CASE WHEN c.pos = l.last THEN coalesce(o.answer, '') ELSE c.text END AS text
  FROM chosen c LEFT JOIN last l ON l.pair_id = c.pair_id LEFT JOIN last o ON o.pair_id = c.pair_id + 1
  WHERE l.last IS NULL OR c.pos <= l.last),
both_sides AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.pos, b.pos) AS pos, a.pos IS NOT NULL AS has_a, b.pos IS NOT NULL AS has_b,
         a.role AS role_a, a.text AS text_a, b.role AS role_b, b.text AS text_b
  FROM chosen a FULL OUTER JOIN rejected b ON a.pair_id IS NOT DISTINCT FROM b.pair_id AND a.pos = b.pos),
ends AS (
  SELECT *, min(CASE WHEN NOT (has_a AND has_b AND role_a IS NOT DISTINCT FROM role_b AND text_a IS NOT DISTINCT FROM text_b) THEN pos END) OVER (PARTITION BY pair_id) AS stop
  FROM both_sides),
rendered AS (
  SELECT *, stop IS NULL OR pos < stop AS shared, '<|im_start|>' || coalesce(role_a, 'user') || chr(10) AS head_a, '<|im_start|>' || coalesce(role_b, 'user') || chr(10) AS head_b,
         '<|im_start|>' || coalesce(role_a, 'user') || chr(10) || coalesce(text_a, '') || '<|im_end|>' || chr(10) AS turn_a,
         '<|im_start|>' || coalesce(role_b, 'user') || chr(10) || coalesce(text_b, '') || '<|im_end|>' || chr(10) AS turn_b FROM ends),
sides AS (
  SELECT pair_id, pos, CASE WHEN shared THEN turn_a END AS prompt, CASE WHEN NOT shared AND has_a THEN turn_a END AS chosen, CASE WHEN NOT shared AND has_b THEN turn_b END AS rejected,
         length(head_a) AS head_a, length(head_b) AS head_b, role_a = 'assistant' AS train_a, role_b = 'assistant' AS train_b FROM rendered),
placed AS (
  SELECT *, CASE WHEN prompt IS NOT NULL THEN CAST(coalesce(sum(length(prompt)) OVER w, 0) AS BIGINT) END AS prompt_start,
         CASE WHEN chosen IS NOT NULL THEN CAST(coalesce(sum(length(chosen)) OVER w, 0) AS BIGINT) END AS chosen_start,
         CASE WHEN rejected IS NOT NULL THEN CAST(coalesce(sum(length(rejected)) OVER w, 0) AS BIGINT) END AS rejected_start
  FROM sides WINDOW w AS (PARTITION BY pair_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT pair_id, CAST(pos AS BIGINT) AS pos, prompt, prompt_start, chosen, chosen_start, CASE WHEN train_a THEN chosen_start + CAST(head_a AS BIGINT) END AS chosen_mask_start,
       CASE WHEN train_a THEN chosen_start + CAST(length(chosen) AS BIGINT) - 1 END AS chosen_mask_end, rejected, rejected_start,
       CASE WHEN train_b THEN rejected_start + CAST(head_b AS BIGINT) END AS rejected_mask_start, CASE WHEN train_b THEN rejected_start + CAST(length(rejected) AS BIGINT) - 1 END AS rejected_mask_end
FROM placed
"""

QUERIES, ORACLES = {"op6_chat": op6_chat}, {"op6_chat": SQL}
