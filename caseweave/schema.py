"""Shared column contracts: agentic events and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Severity scores.
SEVERITY_SCORE = {"info": 10, "low": 20, "medium": 30, "high": 40, "critical": 50}

# Event types of the normalized agent trace.
EVENT_TYPES = [
    "human_input", "model_input", "model_output", "retrieval_query", "retrieval_result",
    "memory_read", "memory_write", "memory_update", "memory_delete",
    "tool_discovery", "tool_call", "tool_result", "mcp_request", "mcp_response",
    "delegation", "agent_message", "approval_request", "approval_decision",
    "identity_issue", "identity_use", "policy_decision", "code_execution",
    "network_action", "data_access", "data_write", "consequence", "containment",
    "harness_event", "prompt_assembly", "middleware_event", "stop_requested", "cancel_requested",
    "session_created", "session_owner", "session_access", "session_transfer",
    "task_created", "task_update", "task_cancel", "task_complete",
    "browser_navigation", "browser_action", "browser_network", "browser_render",
    "a2a_message", "a2a_task", "a2a_agent_card",
    "cache_read", "cache_write", "cache_invalidate", "router_resolution",
    "workspace_instruction", "render_output",
]

AGENTIC_EVENT = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("ts_raw", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("actor_id", T.StringType()),
    T.StructField("target_id", T.StringType()),
    T.StructField("parent_event_id", T.StringType()),
    T.StructField("cause_event_ids", T.ArrayType(T.StringType())),
    T.StructField("correlation_ids", T.ArrayType(T.StringType())),
    T.StructField("content_sha256", T.StringType()),
    T.StructField("authority_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("trace_id", T.StringType()),
    T.StructField("tenant_id", T.StringType()),
    T.StructField("metadata", T.VariantType()),
    T.StructField("ord", T.LongType()),
])

FINDING_COLUMNS = [
    "analyzer", "type", "severity", "severity_score", "subject_kind", "subject_id",
    "event_id", "tenant_id", "detail",
]


def severity_score(severity: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in SEVERITY_SCORE.items() for x in kv])
    return F.coalesce(mapping[severity], F.lit(0))


def ensure(df: DataFrame, ddl: str) -> DataFrame:
    """Add the columns of ``ddl`` that ``df`` lacks, as typed NULLs.

    A field a log never carried is unknown, so each check sees NULL.
    """
    present = set(df.columns)
    missing = {
        f.name: F.lit(None).cast(f.dataType)
        for f in T.StructType.fromDDL(ddl).fields if f.name not in present
    }
    return df.withColumns(missing) if missing else df


def _text(value) -> Column:
    if value is None:
        return F.lit(None).cast("string")
    if isinstance(value, str):
        value = F.col(value)
    return value.cast("string")


class Rule:
    """One finding type of a detector: a condition plus what to report."""

    def __init__(self, type, severity, when, *, detail=None, subject=None, kind=None):
        self.type = F.lit(type) if isinstance(type, str) else type
        self.severity = F.lit(severity) if isinstance(severity, str) else severity
        self.when, self.detail, self.subject, self.kind = when, detail, subject, kind


def detect(df: DataFrame, analyzer: str, rules: list[Rule], *, kind: str,
           subject, event_id=None, tenant=None) -> DataFrame:
    """Evaluate row-local rules in one projection and explode the hits.

    Stateless: the same call works on a batch or a streaming DataFrame.
    """
    hits = [
        F.when(r.when, F.struct(
            r.type.alias("type"), r.severity.alias("severity"),
            F.lit(r.kind or kind).alias("subject_kind"),
            _text(r.subject if r.subject is not None else subject).alias("subject_id"),
            _text(r.detail).alias("detail")))
        for r in rules
    ]
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    flat = df.select(
        _text(event_id).alias("event_id"), _text(tenant).alias("tenant_id"),
        F.explode(found).alias("f"))
    return flat.select(
        F.lit(analyzer).alias("analyzer"), "f.type", "f.severity",
        severity_score(F.col("f.severity")).alias("severity_score"),
        "f.subject_kind", "f.subject_id", "event_id", "tenant_id", "f.detail")


def as_findings(df: DataFrame, analyzer: str, type, severity, *, kind: str, subject,
                event_id=None, tenant=None, detail=None) -> DataFrame:
    """Turn every row of ``df`` into one finding."""
    return detect(df, analyzer, [Rule(type, severity, F.lit(True), detail=detail)],
                  kind=kind, subject=subject, event_id=event_id, tenant=tenant)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
