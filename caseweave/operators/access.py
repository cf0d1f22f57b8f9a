"""Tenant, role and classification authorisation of access rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Actions per tenant role, permissions and clearance per enterprise role, classification levels.
TENANT_ROLE_ACTIONS = {
    "collector": ["evidence:create", "task:read", "task:complete"],
    "investigator": ["case:read", "evidence:read", "evidence:annotate", "report:generate", "task:create"],
    "reviewer": ["case:read", "evidence:read", "review:approve", "review:reject", "report:read"],
    "case_admin": ["case:read", "case:write", "evidence:read", "evidence:hold", "task:create",
                   "report:generate", "review:approve"],
    "platform_admin": ["*"],
}
ROLE_PERMISSIONS = {
    "viewer": ["case.read", "evidence.metadata.read", "report.read"],
    "analyst": ["case.read", "case.create", "case.update", "evidence.metadata.read", "evidence.read",
                "evidence.ingest", "annotation.create", "report.read", "report.generate", "search.execute"],
    "senior_analyst": ["case.read", "case.create", "case.update", "case.transition", "evidence.metadata.read",
                       "evidence.read", "evidence.ingest", "annotation.create", "report.read", "report.generate",
                       "search.execute", "containment.plan", "evidence.export"],
    "incident_commander": ["case.read", "case.create", "case.update", "case.transition", "case.assign",
                           "evidence.metadata.read", "evidence.read", "evidence.ingest", "annotation.create",
                           "report.read", "report.generate", "search.execute", "containment.plan",
                           "containment.approve", "recovery.approve", "evidence.export", "legal_hold.request"],
    "evidence_custodian": ["case.read", "evidence.metadata.read", "evidence.read", "evidence.ingest",
                           "evidence.export", "evidence.verify", "legal_hold.create", "legal_hold.release",
                           "retention.plan", "repository.verify"],
    "auditor": ["case.read", "evidence.metadata.read", "audit.read", "report.read", "repository.verify",
                "legal_hold.read"],
    "admin": ["*"],
}
CLASSIFICATION_LEVEL = {"public": 0, "internal": 1, "confidential": 2, "restricted": 3, "secret": 4}
ROLE_CLEARANCE = {"viewer": 1, "analyst": 2, "senior_analyst": 3, "incident_commander": 4,
                  "evidence_custodian": 4, "auditor": 3, "admin": 4}


def _literal_map(values: dict):
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def tenant_access(requests: DataFrame) -> DataFrame:
    """Decision per request: principal tenants, roles (arrays), tenant_id, action."""
    actions = _literal_map({k: v for k, v in TENANT_ROLE_ACTIONS.items()})
    roles = F.coalesce("roles", F.array().cast("array<string>"))
    member = F.coalesce(F.array_contains("tenant_ids", F.col("tenant_id")), F.lit(False))
    grants = F.exists(roles, lambda r: F.coalesce(
        F.array_contains(actions[r], "*") | F.array_contains(actions[r], F.col("action")), F.lit(False)))
    foreign = ~member & ~F.array_contains(roles, "platform_admin")
    return requests.select("request_id", (~foreign & grants).alias("allowed"),
                           F.when(foreign, "cross_tenant_denied").when(grants, "role_allowed").otherwise("role_denied").alias("reason"))


def role_access(requests: DataFrame) -> DataFrame:
    """Permission and classification clearance of one role per request."""
    perms = F.coalesce(_literal_map(ROLE_PERMISSIONS)[F.col("role")], F.array().cast("array<string>"))
    allowed = F.array_contains(perms, "*") | F.array_contains(perms, F.col("permission"))
    cleared = F.coalesce(_literal_map(ROLE_CLEARANCE)[F.col("role")], F.lit(-1)) >= F.coalesce(
        _literal_map(CLASSIFICATION_LEVEL)[F.col("classification")], F.lit(999))
    return requests.select("request_id", allowed.alias("allowed"), cleared.alias("cleared"))
