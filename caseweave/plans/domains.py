"""Mappings from the given tables to the domain tables (see ``registry``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import prior, time_chunk
from .registry import duck, domain, table

_EVENT_TYPE = ("CASE event_type WHEN 'view' THEN 'retrieval_result' WHEN 'click' THEN 'tool_call' "
               "WHEN 'signup' THEN 'memory_write' WHEN 'purchase' THEN 'consequence' "
               "WHEN 'error' THEN 'containment' END")


def base_events(d):
    """One agentic event per row of ``events``, without its causal references."""
    return f"""
    SELECT CAST(event_id AS STRING) AS event_id, event_id AS ord, ts, {_EVENT_TYPE} AS event_type,
           'agent-' || CAST(user_id AS STRING) AS actor_id, user_id,
           CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS session_id,
           'T' || CAST(user_id % 4 AS STRING) AS tenant_id,
           {d.sha('props')} AS content_sha256,
           (event_type = 'view' AND value > 120) AS untrusted,
           CAST({d.jstr('props', 'k')} AS BIGINT) AS k, value
    FROM {{events}}"""


def agentic_events(spark: SparkSession, sf: str) -> DataFrame:
    """Agentic events with parent (previous event of the session) and cross-session causes."""
    e = domain(spark, sf, base_events)
    e = prior(e, ["session_id"], ["ts", "ord"], {"parent_event_id": ("last", "event_id")},
              time_chunk("ts", 6 * 3600))
    cause = e.select(F.col("ord").alias("c_ord"), F.col("event_id").alias("c_id"),
                     F.to_date("ts").alias("c_day"))
    e = e.join(cause, (F.col("ord") - 37 == F.col("c_ord")) & (F.col("ord") % 10 == 0)
               & (F.to_date("ts") == F.col("c_day")), "left")
    return e.withColumn(
        "cause_event_ids",
        F.when(F.col("c_id").isNotNull(), F.array("c_id")).otherwise(F.array().cast("array<string>"))
    ).drop("c_ord", "c_id", "c_day")


AGENTIC_SQL = f"""
e0 AS ({duck(base_events)}),
ae AS (SELECT e0.*, lag(event_id) OVER (PARTITION BY session_id ORDER BY ts, ord) AS parent_event_id,
              CASE WHEN ord % 10 = 0 AND EXISTS (SELECT 1 FROM e0 c WHERE c.ord = e0.ord - 37
                        AND CAST(c.ts AS DATE) = CAST(e0.ts AS DATE))
                   THEN CAST(ord - 37 AS VARCHAR) END AS cause_event_id
       FROM e0),
edges AS (SELECT parent_event_id AS src, event_id AS dst FROM ae WHERE parent_event_id IS NOT NULL
          UNION ALL SELECT cause_event_id, event_id FROM ae WHERE cause_event_id IS NOT NULL)"""
