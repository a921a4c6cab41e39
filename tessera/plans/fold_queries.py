"""Queries whose rows depend on the rows before them: requests to the state machine."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import lifecycle
from tessera.plans.registry import query
from tessera.sources import tables

# The states and the 37 ways between them, written out again so that a wrong constant of the operator shows.
_NAMES = "['DRAFT','PENDING','PULLING_CODE','PARSING_CODE','SPLITTING_TASK','AI_ANALYZING','GENERATING_DOC','PENDING_REVIEW','REVIEWING','CONFIRMED','PUSHING','PUSHED','FAILED','CANCELLED','ARCHIVED']"
_EDGES = """e(a, b) AS (VALUES ('DRAFT','PENDING'), ('DRAFT','CANCELLED'), ('PENDING','PULLING_CODE'), ('PENDING','CANCELLED'), ('PENDING','FAILED'),
  ('PULLING_CODE','PARSING_CODE'), ('PULLING_CODE','FAILED'), ('PULLING_CODE','CANCELLED'), ('PARSING_CODE','SPLITTING_TASK'), ('PARSING_CODE','FAILED'), ('PARSING_CODE','CANCELLED'),
  ('SPLITTING_TASK','AI_ANALYZING'), ('SPLITTING_TASK','FAILED'), ('SPLITTING_TASK','CANCELLED'), ('AI_ANALYZING','GENERATING_DOC'), ('AI_ANALYZING','FAILED'), ('AI_ANALYZING','CANCELLED'),
  ('GENERATING_DOC','PENDING_REVIEW'), ('GENERATING_DOC','FAILED'), ('GENERATING_DOC','CANCELLED'), ('PENDING_REVIEW','REVIEWING'), ('PENDING_REVIEW','CONFIRMED'), ('PENDING_REVIEW','FAILED'), ('PENDING_REVIEW','CANCELLED'),
  ('REVIEWING','CONFIRMED'), ('REVIEWING','PENDING_REVIEW'), ('REVIEWING','CANCELLED'), ('CONFIRMED','PUSHING'), ('CONFIRMED','ARCHIVED'), ('CONFIRMED','CANCELLED'),
  ('PUSHING','PUSHED'), ('PUSHING','FAILED'), ('PUSHING','CANCELLED'), ('FAILED','PENDING'), ('FAILED','ARCHIVED'), ('CANCELLED','PENDING'), ('CANCELLED','ARCHIVED'))"""


@query(f"""WITH RECURSIVE {_EDGES}, r AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_custkey % 400 END AS task_id, o_orderdate AS "at",
    CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE {_NAMES}[CAST((o_orderkey + o_custkey) % 15 AS INTEGER) + 1] END AS target, CASE WHEN o_orderkey % 2 = 0 THEN 'e' || o_orderkey END AS reason FROM orders
), n AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY "at", id) AS k FROM r), s AS (
  SELECT task_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BOOLEAN) AS accepted, CAST(NULL AS VARCHAR) AS state_before, 'DRAFT' AS state_after, 0 AS progress,
    CAST(NULL AS TIMESTAMP) AS started_at, CAST(NULL AS TIMESTAMP) AS ended_at, CAST(NULL AS BIGINT) AS duration_ms, CAST(NULL AS VARCHAR) AS error_reason, CAST(NULL AS VARCHAR) AS error FROM (SELECT DISTINCT task_id FROM r)
  UNION ALL
  SELECT n.task_id, n.k, n.id, v.ok, s.state_after, CASE WHEN v.ok THEN n.target ELSE s.state_after END,
    CASE WHEN NOT v.ok THEN s.progress WHEN n.target = 'PENDING' THEN 0 WHEN n.target = 'PULLING_CODE' THEN 10 WHEN n.target = 'PARSING_CODE' THEN 30 WHEN n.target = 'SPLITTING_TASK' THEN 50 WHEN n.target = 'AI_ANALYZING' THEN 70
      WHEN n.target = 'GENERATING_DOC' THEN 90 WHEN n.target IN ('PENDING_REVIEW', 'CONFIRMED', 'PUSHED') THEN 100 ELSE s.progress END,
    CASE WHEN v.ok AND n.target IN ('PENDING', 'PULLING_CODE') THEN coalesce(s.started_at, n."at") ELSE s.started_at END,
    CASE WHEN v.ok AND n.target IN ('FAILED', 'PUSHED', 'CANCELLED', 'ARCHIVED') THEN n."at" ELSE s.ended_at END,
    CASE WHEN v.ok AND n.target IN ('FAILED', 'PUSHED', 'CANCELLED', 'ARCHIVED') AND s.started_at IS NOT NULL THEN CAST(date_diff('millisecond', s.started_at, n."at") AS BIGINT) ELSE s.duration_ms END,
    CASE WHEN v.ok AND n.target IN ('PENDING', 'PULLING_CODE') THEN NULL WHEN v.ok AND n.target = 'FAILED' AND n.reason IS NOT NULL THEN n.reason ELSE s.error_reason END,
    CASE WHEN NOT v.ok THEN '非法的状态流转: ' || s.state_after || ' -> ' || coalesce(n.target, 'null') END
  FROM s JOIN n ON n.task_id = s.task_id AND n.k = s.k + 1, LATERAL (SELECT coalesce(n.target = s.state_after OR EXISTS (SELECT 1 FROM e WHERE a = s.state_after AND b = n.target), false) AS ok) v
)
SELECT id, accepted, state_before, state_after, progress, started_at, ended_at, duration_ms, error_reason, error FROM s WHERE k > 0""")
def task_requests(spark, sf):
    o = tables.read(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    names = F.array(*[F.lit(s) for s in lifecycle.STATES])
    r = o.select(
        k.alias("id"), F.when(k % 5 == 0, 0).otherwise(c % 400).alias("task_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"), F.when(k % 97 != 0, F.get(names, ((k + c) % 15).cast("int"))).alias("target"),
        F.when(k % 2 == 0, F.concat(F.lit("e"), k.cast("string"))).alias("reason"),
    )
    return lifecycle.requested(r).select("id", "accepted", "state_before", "state_after", "progress", "started_at", "ended_at", "duration_ms", "error_reason", "error")
