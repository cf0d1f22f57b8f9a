"""Row-local policy detectors.

Each detector is one projection over its log: every finding type is one rule
and the hits of a row are exploded.  Detectors hold no state, so they run
unchanged on streams.  Allow-lists are policy documents passed as Python
lists; an empty list switches its check off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.scalars import (blank, contains_any, entropy, hostname, origin, present, registrable,
                                 truthy)
from ..schema import EVENT_TYPES, Rule, as_findings, detect, ensure, union_all



def never() -> Column:
    return F.lit(False)


# Fixed values.
EVENT_SCHEMA = r"^[a-z0-9-]+/agentic-event/v(?:0\.9|1\.1)$"
BROWSER_ACTIONS = ["click", "keyboard", "upload", "download", "script_eval", "navigation",
                   "form_submit", "browser_tool_call"]
CATALOG_TYPES = ["tools", "prompts", "resources"]
CATALOG_METHODS = ["tools/list", "prompts/list", "resources/list", "resources/read"]
CACHE_SCOPES = ["private", "shared", "tenant", "session", "none"]
SENSITIVE_BEHAVIOR = ["credential_access_attempt", "identity_file_write", "memory_write"]
# Exact-hash checks of a fleet node: field, finding, severity.
FLEET_CHECKS = [
    ("model_manifest_sha256", "MODEL_MANIFEST_DRIFT", "critical"),
    ("model_tree_content_sha256", "MODEL_CONTENT_TREE_DRIFT", "critical"),
    ("fingerprint_sha256", "FINGERPRINT_DRIFT", "critical"),
    ("approved_activations_sha256", "ACTIVATION_REFERENCE_DRIFT", "high"),
    ("runtime_inventory_sha256", "RUNTIME_INVENTORY_DRIFT", "high"),
    ("container_image_digest", "CONTAINER_IMAGE_DRIFT", "high"),
    ("chat_template_sha256", "CHAT_TEMPLATE_DRIFT", "high"),
    ("tokenizer_sha256", "TOKENIZER_DRIFT", "high"),
    ("authority_policy_sha256", "DELEGATED_AUTHORITY_DRIFT", "critical"),
    ("tool_schema_sha256", "TOOL_SCHEMA_DRIFT", "high"),
    ("retrieval_config_sha256", "RETRIEVAL_CONFIG_DRIFT", "high"),
]
# Words and characters of adversarial path names, and execution-related keys.
PATH_WORDS = ["ignore", "follow", "read", "execute", "run", "approve", "instructions", "system",
              "prompt", "immediately", "secret", "token"]
PATH_INVISIBLE = r"[\x{202A}\x{202B}\x{202D}\x{202E}\x{2066}-\x{2069}\x{200B}-\x{200D}\x{2060}\x{FEFF}]"
SENSITIVE_KEYS = ["command", "executable", "path", "server", "languageServer", "mcp", "autoApprove",
                  "approval", "shell", "terminal", "env", "url", "endpoint", "args"]
# Archive member names that agents load, and nested archive suffixes.
CONTROL_NAMES = ["claude.md", "claude.local.md", "agents.md", ".mcp.json", "package.json", "makefile"]
CONTROL_DIRS = [".cursor", ".claude", ".vscode", ".devcontainer", "skills", "tools"]
NESTED_SUFFIXES = [".zip", ".tar", ".tgz", ".gz", ".bz2", ".xz", ".7z", ".rar", ".jar", ".whl", ".vsix"]
# Agentic risks, their names and the explicit signals that raise them.
AGENTIC_RISKS = [
    ("ASI01", "Agent Goal Hijack", ["goal_changed_without_approval", "untrusted_instruction_influenced_goal"]),
    ("ASI02", "Tool Misuse & Exploitation", ["tool_policy_violation", "unsafe_tool_invocation"]),
    ("ASI03", "Identity & Privilege Abuse", ["authority_exceeded", "delegated_identity_misused"]),
    ("ASI04", "Agentic Supply Chain Vulnerabilities", ["component_integrity_failed", "tool_schema_untrusted"]),
    ("ASI05", "Unexpected Code Execution (RCE)", ["unexpected_code_execution", "sandbox_escape_observed"]),
    ("ASI06", "Memory & Context Poisoning", ["memory_integrity_failed", "untrusted_context_persisted"]),
    ("ASI07", "Insecure Inter-Agent Communication", ["inter_agent_authentication_failed", "spoofed_agent_message"]),
    ("ASI08", "Cascading Failures", ["cascading_failure", "downstream_automation_amplified_error"]),
    ("ASI09", "Human-Agent Trust Exploitation",
     ["human_approval_induced_by_untrusted_content", "misleading_agent_explanation_observed"]),
    ("ASI10", "Rogue Agents", ["agent_policy_evasion", "self_directed_action_outside_goal"]),
]
# Fields and values of a classifier verdict.
VERDICTS = ["benign", "suspicious", "malicious", "unknown"]
VERDICT_KEYS = ["schema", "source_sha256", "verdict", "confidence", "categories", "classifier",
                "classifier_version", "analysis_id", "notes", "timestamp_utc"]
VERDICT_FORBIDDEN = ["tool_calls", "commands", "code", "raw_source", "prompt", "system_prompt",
                     "instructions", "actions"]
VERDICT_MAX_NOTES = 4000


def outside(value: Column, allowed: list | None) -> Column:
    """Value not in a non-empty allow-list; a missing value is outside too."""
    return ~F.coalesce(value.isin(list(allowed)), F.lit(False)) if allowed else never()


def event_validation(events: DataFrame) -> DataFrame:
    e = ensure(events, "schema string, timestamp_utc string, cause_event_ids array<string>")
    return detect(e, "event_validation", [
        Rule("schema", "high", ~F.coalesce(F.col("schema").rlike(EVENT_SCHEMA), F.lit(False))),
        Rule("event_type", "high", outside(F.col("event_type"), EVENT_TYPES)),
        Rule("event_id", "high", blank("event_id")),
        Rule("timestamp_utc", "high", blank("timestamp_utc")),
        Rule("actor_id", "high", blank("actor_id")),
        Rule("self_cause", "high", F.array_contains("cause_event_ids", F.col("event_id"))),
    ], kind="event", subject="event_id", event_id="event_id")


def model_routing(events: DataFrame, policy: dict) -> DataFrame:
    e = ensure(events, "requested_model string, resolved_model string, provider string, region string, "
                       "safety_profile string, fallback_approved boolean, router_policy_sha256 string")
    order = policy.get("safety_profile_order") or []
    minimum = policy.get("minimum_safety_profile")
    if minimum and order:
        rank = F.coalesce(F.array_position(F.lit(order), F.col("safety_profile")), F.lit(0)) - 1
        below = rank < F.lit(order.index(minimum) if minimum in order else 999)
    else:
        below = never()
    pinned = policy.get("router_policy_sha256")
    return detect(e, "model_routing", [
        Rule("unapproved_model_resolution", "critical", outside(F.col("resolved_model"), policy.get("allowed_models"))),
        Rule("unapproved_provider", "critical", outside(F.col("provider"), policy.get("allowed_providers"))),
        Rule("unapproved_model_region", "high", outside(F.col("region"), policy.get("allowed_regions"))),
        Rule("unapproved_model_failover", "critical",
             present("requested_model") & present("resolved_model")
             & (F.col("requested_model") != F.col("resolved_model")) & ~truthy("fallback_approved")),
        Rule("safety_policy_downgrade", "critical", below),
        Rule("router_policy_drift", "critical",
             present("router_policy_sha256") & (F.col("router_policy_sha256") != F.lit(pinned)) if pinned else never()),
    ], kind="request", subject="request_id", event_id="request_id")


def cache_rows(records: DataFrame, now: Column) -> DataFrame:
    r = ensure(records, "writer_trust string, event string, expires_utc timestamp, invalidated_utc timestamp, "
                        "expected_content_sha256 string, content_sha256 string")
    read = F.col("event") == "read"
    return detect(r, "cache", [
        Rule("cache_written_by_untrusted_source", "high", F.col("writer_trust") == "untrusted"),
        Rule("expired_cache_entry_read", "high", read & (F.col("expires_utc") < now)),
        Rule("cache_content_mismatch", "critical", present("expected_content_sha256")
             & ~F.col("content_sha256").eqNullSafe(F.col("expected_content_sha256"))),
        Rule("invalidated_cache_entry_reused", "critical", read & F.col("invalidated_utc").isNotNull()),
    ], kind="cache_entry", subject="cache_key", event_id="record_id", tenant="tenant_id")


def cache_source_staleness(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Cache entries whose recorded source hashes differ from the current source manifest.

    ``records`` has ``record_id, source_ids, source_hashes``; sources without a
    current hash are left out, and an entry with none is not judged.
    """
    current = (records.select("record_id", F.explode("source_ids").alias("source_id"))
               .join(manifest.filter("sha256 <> ''").select("source_id", "sha256"), "source_id")
               .groupBy("record_id").agg(F.array_sort(F.collect_list("sha256")).alias("current")))
    stale = records.join(current, "record_id").filter(
        F.array_sort(F.coalesce("source_hashes", F.array().cast("array<string>"))) != F.col("current"))
    return as_findings(stale, "cache", "cache_source_hash_stale", "high", kind="cache_entry",
                       subject="cache_key", event_id="record_id", tenant="tenant_id")


def spiffe_trust_domain(identity: Column, given: Column) -> Column:
    from_id = F.regexp_extract(identity, r"^spiffe://([^/]*)", 1)
    return F.when(present(given), given).when(identity.startswith("spiffe://"), from_id)


def identity_status(ts: Column, nb: Column, ex: Column, rev: Column) -> Column:
    """Status at the event's own time; the last applicable rule wins."""
    return (F.when(ts >= rev, "REVOKED").when(ts >= ex, "EXPIRED").when(ts < nb, "NOT_YET_VALID").otherwise("VALID"))


def workload_identity(events: DataFrame, trust_domains: list | None = None, identities: list | None = None) -> DataFrame:
    e = ensure(events, "trust_domain string, not_before timestamp, expires timestamp, revoked timestamp, "
                       "selectors array<string>, expected_selectors array<string>")
    domain = spiffe_trust_domain(F.col("spiffe_id"), F.col("trust_domain"))
    lacking = F.array_except(F.col("expected_selectors"),
                             F.coalesce("selectors", F.array().cast("array<string>")))
    ts = F.col("ts")
    return detect(e, "workload_identity", [
        Rule("workload_identity_not_yet_valid", "critical", ts < F.col("not_before")),
        Rule("workload_identity_used_after_expiry", "critical", ts >= F.col("expires")),
        Rule("workload_identity_used_after_revocation", "critical", ts >= F.col("revoked")),
        Rule("unapproved_spiffe_trust_domain", "critical", outside(domain, trust_domains), detail=domain),
        Rule("unapproved_workload_identity", "critical", outside(F.col("spiffe_id"), identities)),
        Rule("workload_attestation_selector_mismatch", "critical", F.size(lacking) > 0,
             detail=F.array_join(lacking, ",")),
    ], kind="workload", subject="spiffe_id", event_id="event_id")


def browser_activity(events: DataFrame, origins: list | None = None, ws_origins: list | None = None) -> DataFrame:
    e = ensure(events, "url string, approval_required boolean, approval_event_id string, approved boolean, "
                       "source string, hidden_instruction_detected boolean, outside_workspace_root boolean")
    et, o = F.col("event_type"), origin("url")
    known = o.isNotNull()
    return detect(e, "browser", [
        Rule("browser_action_without_required_approval", "critical",
             et.isin(BROWSER_ACTIONS) & truthy("approval_required") & blank("approval_event_id")),
        Rule("unapproved_browser_script_eval", "critical", (et == "script_eval") & ~truthy("approved")),
        Rule("browser_unapproved_network_origin", "high",
             (et == "network_request") & known & outside(o, origins), detail=o),
        Rule("rendered_output_external_request", "high",
             (et == "network_request") & known & (F.col("source") == "rendered_model_output"), detail=o),
        Rule("browser_unapproved_websocket_origin", "critical",
             (et == "websocket_connect") & known & outside(o, ws_origins), detail=o),
        Rule("hidden_dom_instruction", "high", (et == "dom_snapshot") & truthy("hidden_instruction_detected")),
        Rule("browser_workspace_root_escape", "critical",
             (et == "workspace_file_access") & truthy("outside_workspace_root")),
    ], kind="session", subject="session_id", event_id="event_id")


MCP_COLUMNS = (
    "headers map<string,string>, mcp_method string, method string, mcp_name string, tool_name string, "
    "body_method string, extensions array<string>, negotiated_extensions array<string>, catalog_type string, "
    "ttlMs string, cacheScope string, event string, cache_expired boolean, tenant_id string, "
    "cached_tenant_id string, authorization string, issuer string, oauth string, expected_issuer string, "
    "issuer_validation_failed boolean, pkce_method string, protected_resource_metadata_required boolean, "
    "protected_resource_metadata_present boolean, client_registration string, credential_issuer string, "
    "task_id string, state string, status string, task_owner string, principal string, mrtr_id string, "
    "round_trip_id string, input_required boolean, human_or_client_response_event_id string, "
    "resource_uri string, ui_uri string, app_content_sha256 string, app_external_urls array<string>, "
    "app_host_rpc_method string, app_host_rpc_approved boolean, server_id string, result_sha256 string")


def first_present(*cols) -> Column:
    """First non-empty value."""
    return F.coalesce(*[F.when(present(x), x if isinstance(x, Column) else F.col(x)) for x in cols])


def mcp_method() -> Column:
    return first_present("mcp_method", F.col("headers")["Mcp-Method"], "method")


def mcp_name() -> Column:
    return first_present("mcp_name", F.col("headers")["Mcp-Name"], "tool_name")


def mcp_events(events: DataFrame, app_origins: list | None = None, extensions: list | None = None) -> DataFrame:
    e = ensure(events, MCP_COLUMNS).withColumns({"_method": mcp_method(), "_name": mcp_name()})
    method, header = F.col("_method"), F.col("headers")["Mcp-Method"]
    negotiated = F.coalesce(F.when(F.size("extensions") > 0, F.col("extensions")), "negotiated_extensions")
    catalog = (F.coalesce(F.col("catalog_type").isin(CATALOG_TYPES), F.lit(False))
               | F.coalesce(method.isin(CATALOG_METHODS), F.lit(False)))
    ttl = F.expr("try_cast(ttlMs AS DOUBLE)")
    auth = present("authorization") | present("issuer") | present("oauth")
    uri = first_present("resource_uri", "ui_uri")
    app = uri.startswith("ui://")
    mrtr = first_present("mrtr_id", "round_trip_id").isNotNull()
    rules = [
        Rule("mcp_missing_method_header_or_field", "high", method.isNull()),
        Rule("mcp_missing_name_for_tool_call", "critical", (method == "tools/call") & F.col("_name").isNull()),
        Rule("mcp_header_body_method_mismatch", "critical",
             present(header) & present("body_method") & (header != F.col("body_method"))),
        Rule("mcp_unapproved_extension_negotiated", "critical",
             F.size(F.array_except(negotiated, F.lit(list(extensions)))) > 0 if extensions else never()),
        Rule("mcp_invalid_cache_ttl", "high", catalog & F.col("ttlMs").isNotNull() & (ttl.isNull() | (ttl < 0))),
        Rule("mcp_unknown_cache_scope", "high", catalog & ~F.col("cacheScope").isin(CACHE_SCOPES)),
        Rule("mcp_expired_catalog_cache_read", "high",
             catalog & (F.col("event") == "cache_read") & truthy("cache_expired")),
        Rule("mcp_cross_tenant_catalog_cache", "critical",
             catalog & (F.col("cacheScope") == "shared") & present("tenant_id")
             & (F.col("cached_tenant_id") != F.col("tenant_id"))),
        Rule("mcp_authorization_issuer_mismatch", "critical",
             auth & present("expected_issuer") & ~F.col("issuer").eqNullSafe(F.col("expected_issuer"))),
        Rule("mcp_authorization_issuer_validation_failed", "critical", auth & truthy("issuer_validation_failed")),
        Rule("mcp_pkce_not_s256", "critical", auth & present("pkce_method") & (F.upper("pkce_method") != "S256")),
        Rule("mcp_protected_resource_metadata_missing", "critical",
             auth & truthy("protected_resource_metadata_required") & ~truthy("protected_resource_metadata_present")),
        Rule("mcp_deprecated_dynamic_client_registration_observed", "medium",
             auth & (F.col("client_registration") == "DCR")),
        Rule("mcp_credential_issuer_binding_mismatch", "critical",
             auth & present("credential_issuer") & present("issuer") & (F.col("credential_issuer") != F.col("issuer"))),
        Rule("mcp_task_principal_mismatch", "critical",
             present("task_id") & present("task_owner") & present("principal")
             & (F.col("task_owner") != F.col("principal")), subject="task_id", kind="task"),
        Rule("mcp_mrtr_input_required_without_response_link", "high",
             mrtr & truthy("input_required") & blank("human_or_client_response_event_id")),
        Rule("mcp_app_missing_content_hash", "high", app & blank("app_content_sha256")),
        Rule("mcp_app_unapproved_host_rpc", "critical",
             app & present("app_host_rpc_method") & ~truthy("app_host_rpc_approved")),
    ]
    found = detect(e, "mcp", rules, kind="mcp_event", subject="event_id", event_id="event_id", tenant="tenant_id")
    if not app_origins:
        return found
    external = e.filter(app).withColumn("_url", F.explode("app_external_urls"))
    return found.unionByName(detect(external, "mcp", [
        Rule("mcp_app_unapproved_external_origin", "critical", outside(origin("_url"), app_origins),
             detail=origin("_url"))],
        kind="mcp_event", subject="event_id", event_id="event_id", tenant="tenant_id"))


def mcp_boundary(events: DataFrame, roots: list | None = None) -> DataFrame:
    """Routing, authorization, root-boundary and catalog-cache checks on normalised logged paths."""
    e = ensure(events, MCP_COLUMNS + ", resolved_path string, cache_scope string")
    inside = F.lit(False)
    for r in roots or []:
        base = r.rstrip("/")
        inside = inside | (F.col("resolved_path") == base) | F.col("resolved_path").startswith(base + "/")
    catalog = F.col("catalog_type").isin(CATALOG_TYPES)
    return detect(e, "mcp_boundary", [
        Rule("mcp_missing_routing_name", "high", (mcp_method() == "tools/call") & mcp_name().isNull()),
        Rule("mcp_authorization_issuer_validation_failed", "critical", truthy("issuer_validation_failed")),
        Rule("mcp_root_boundary_escape", "critical", present("resolved_path") & ~inside if roots else never(),
             detail="resolved_path"),
        Rule("mcp_expired_catalog_cache_read", "high",
             catalog & (F.col("event") == "cache_read") & truthy("cache_expired")),
        Rule("mcp_cross_tenant_catalog_cache", "critical",
             catalog & (F.col("cache_scope") == "shared") & present("tenant_id")
             & (F.col("cached_tenant_id") != F.col("tenant_id"))),
    ], kind="mcp_event", subject="event_id", event_id="event_id", tenant="tenant_id")


def a2a_events(events: DataFrame, push_hosts: list | None = None) -> DataFrame:
    e = ensure(events, "expected_principal string, principal string, expected_context_id string, "
                       "context_id string, push_notification_url string, signature_valid boolean")
    et, host = F.col("event_type"), hostname("push_notification_url")
    return detect(e, "a2a", [
        Rule("a2a_task_owner_mismatch", "critical", (et == "task_access") & present("expected_principal")
             & ~F.col("principal").eqNullSafe(F.col("expected_principal"))),
        Rule("a2a_context_hijack", "critical", (et == "context_access") & present("expected_context_id")
             & ~F.col("context_id").eqNullSafe(F.col("expected_context_id"))),
        Rule("a2a_unapproved_push_notification_host", "critical",
             present("push_notification_url") & outside(host, push_hosts), detail=host),
        Rule("a2a_agent_card_signature_invalid", "critical",
             (et == "agent_card_used") & (F.col("signature_valid") == F.lit(False))),
    ], kind="task", subject="task_id", event_id="event_id")


def a2a_binding(events: DataFrame, verification: dict) -> DataFrame:
    """Events against the verified agent card they claim to run under."""
    e = ensure(events, "agent_card_sha256 string, skill_id string, tenant string, callback_url string, "
                       "callback_role string, authority_before array<string>, authority_after array<string>, "
                       "authority_elevation_approved boolean")
    card = verification.get("card_identity") or {}
    skills, interfaces = card.get("skills") or [], card.get("interfaces") or []
    tenants = sorted({i["tenant"] for i in interfaces if i.get("tenant") is not None})
    hosts = [i["url"].split("/", 3)[:3] for i in interfaces if "://" in i.get("url", "")]
    interface_origins = sorted({"/".join(h) for h in hosts})
    expected = verification.get("canonical_payload_sha256")
    trusted = bool(verification.get("policy_satisfied") and verification.get("trusted"))
    none = F.array().cast("array<string>")
    gained = F.array_except(F.coalesce("authority_after", none), F.coalesce("authority_before", none))
    return detect(e, "a2a_binding", [
        Rule("a2a_execution_bound_to_untrusted_agent_card", "critical", F.lit(not trusted)),
        Rule("a2a_execution_card_hash_mismatch", "critical",
             present("agent_card_sha256") & (F.col("agent_card_sha256") != F.lit(expected)) if expected else never()),
        Rule("a2a_undeclared_skill_invoked", "critical",
             present("skill_id") & (~F.col("skill_id").isin(skills) if skills else F.lit(True)), detail="skill_id"),
        Rule("a2a_tenant_binding_mismatch", "critical", outside(F.col("tenant"), tenants), detail="tenant"),
        Rule("a2a_callback_points_to_agent_interface", "high",
             origin("callback_url").isin(interface_origins) & (F.col("callback_role") == "client")
             if interface_origins else never(), detail="callback_url"),
        Rule("a2a_unapproved_authority_escalation", "critical",
             (F.size(gained) > 0) & ~truthy("authority_elevation_approved"),
             detail=F.array_join(F.array_sort(gained), ",")),
    ], kind="task", subject="task_id", event_id="event_id", tenant="tenant")


def approval_integrity(approvals: DataFrame, files: DataFrame) -> DataFrame:
    """Approvals against the current hash and resolved path of the file they approved."""
    r = ensure(approvals, "approved_sha256 string, approved_realpath string, approval_scope string").join(
        files.select(F.col("path").alias("resource_path"), F.col("sha256").alias("current_sha256"),
                     F.col("realpath").alias("current_realpath")), "resource_path", "left")
    return detect(r, "approval", [
        Rule("approval_toctou_content_changed", "critical",
             F.col("approval_scope").isin("path", "name") & present("approved_sha256")
             & (F.col("approved_sha256") != F.col("current_sha256"))),
        Rule("approval_target_changed_via_path_resolution", "critical",
             present("approved_realpath") & (F.col("approved_realpath") != F.col("current_realpath"))),
        Rule("approval_not_bound_to_content_hash", "high", blank("approved_sha256")),
    ], kind="file", subject="resource_path", event_id="approval_id")


def declared_vs_observed(events: DataFrame, declared: dict) -> DataFrame:
    """Observed sandbox behaviour outside what an artifact declared."""
    e = ensure(events, "path string, hostname string, domain string")
    caps = declared.get("capabilities") or []
    host = first_present("hostname", "domain")
    rows = detect(e, "behavior", [
        Rule("sandbox_undeclared_file_access", "high",
             present("path") & outside(F.col("path"), declared.get("file_paths")), detail="path"),
        Rule("sandbox_undeclared_network_destination", "critical",
             host.isNotNull() & outside(host, declared.get("network_domains")), detail=host),
        Rule("sandbox_undeclared_sensitive_behavior", "critical",
             F.col("event_type").isin(SENSITIVE_BEHAVIOR) & (outside(F.col("event_type"), caps) if caps else F.lit(True))),
    ], kind="behavior", subject="event_type", event_id="event_id")
    # One finding per undeclared type, so the types of a long run are never listed in one row.
    extra = e.filter(present("event_type") & (outside(F.col("event_type"), caps) if caps else F.lit(True))).select("event_type").distinct()
    return rows.unionByName(as_findings(
        extra, "behavior", "sandbox_declared_observed_capability_mismatch", "high", kind="behavior",
        subject="event_type", detail="event_type"))


def fleet_policy(heartbeats: DataFrame, policies: DataFrame) -> DataFrame:
    """Heartbeats against their node's approved state.

    ``policies``: node_id, ``approved`` (map), allowed_adapters,
    approved_hook_fingerprints, critical_robust_z, high_robust_z,
    require_hardware_attestation.  ``heartbeats``: node_id, seq, ``observed``
    (map), active_adapters, hook_fingerprints, robust_z, chain_valid,
    hardware_status, hardware_result, metadata_tree_changed.
    """
    h = heartbeats.join(policies, "node_id")
    none = F.array().cast("array<string>")
    adapters = F.array_except(F.coalesce("active_adapters", none), F.coalesce("allowed_adapters", none))
    hooks = F.array_except(F.coalesce("hook_fingerprints", none), F.coalesce("approved_hook_fingerprints", none))
    z = F.col("robust_z")
    finite = z.isNotNull() & ~F.isnan(z) & (F.abs(z) < float("inf"))
    crit = F.coalesce("critical_robust_z", F.lit(10.0))
    high = F.coalesce("high_robust_z", F.lit(5.0))
    needed = truthy("require_hardware_attestation")
    verified = F.coalesce(F.col("hardware_status") == "verified", F.lit(False))
    rules = [Rule(code, sev, F.col("approved")[f].isNotNull()
                  & ~F.col("observed")[f].eqNullSafe(F.col("approved")[f]), detail=F.lit(f))
             for f, code, sev in FLEET_CHECKS] + [
        Rule("UNEXPECTED_ADAPTER", "critical", F.size(adapters) > 0, detail=F.array_join(F.array_sort(adapters), ",")),
        Rule("UNEXPECTED_RUNTIME_HOOK", "critical", F.size(hooks) > 0, detail=F.array_join(F.array_sort(hooks), ",")),
        Rule("ACTIVATION_DRIFT_CRITICAL", "critical", finite & (z >= crit)),
        Rule("ACTIVATION_DRIFT_HIGH", "high", finite & (z >= high) & (z < crit)),
        Rule("ATTESTATION_CHAIN_INVALID", "critical", F.col("chain_valid") == F.lit(False)),
        Rule("HARDWARE_ATTESTATION_NOT_VERIFIED", "high", needed & ~verified),
        Rule("HARDWARE_ATTESTATION_FAILED", "critical", needed & verified & ~truthy("hardware_result")),
        Rule("MODEL_TREE_METADATA_CHANGED", "medium", truthy("metadata_tree_changed")),
    ]
    return detect(h, "fleet", rules, kind="node", subject="node_id", event_id=F.col("seq").cast("string"))


def network_exfil(events: DataFrame, approved_domains: list | None = None) -> DataFrame:
    e = ensure(events, "hostname string, query_name string, url string, source string, channel string, "
                       "contains_sensitive_source_hash boolean")
    e = e.withColumn("_host", F.lower(F.rtrim(F.coalesce(
        first_present("hostname", "query_name"), hostname("url")), F.lit(".")))).filter("_host <> ''")
    host = F.col("_host")
    approved = F.lit(False)
    for d in approved_domains or []:
        approved = approved | (host == d.lower()) | host.endswith("." + d.lower())
    parts = F.split(host, r"\.")
    long = F.filter(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: F.length(x) >= 24)
    # One pass: a host comes once without a label, for its own rules, and once for each long label.
    e = e.withColumn("_label", F.explode(F.concat(F.array(F.lit(None).cast("string")), long)))
    lab = F.col("_label")
    whole = lab.isNull()
    encoded = lab.rlike("^[0-9a-fA-F]{20,}$") | lab.rlike("(?i)^[A-Z2-7]{20,}$") | lab.rlike("^[A-Za-z0-9_-]{24,}$")
    return detect(e, "network", [
        Rule("agent_network_to_unapproved_domain", "high",
             whole & ~approved & F.col("source").isin("agent", "tool", "rendered_output") if approved_domains else never()),
        Rule("dns_query_correlated_with_sensitive_source", "critical",
             whole & (F.col("channel") == "dns") & truthy("contains_sensitive_source_hash")),
        Rule("dns_data_like_subdomain_label", "high", ~whole & (encoded | (entropy(lab) >= 3.6)),
             detail=F.round(entropy(lab), 3)),
    ], kind="host", subject="_host", event_id="event_id")


def dns_fanout(events: DataFrame, threshold: int = 20) -> DataFrame:
    """Base domains with many distinct hosts; distinct first, so a hot domain is spread over its hosts."""
    host = F.lower(F.rtrim(F.coalesce("hostname", "query_name"), F.lit(".")))
    hosts = events.select(host.alias("host")).filter("host <> ''").distinct()
    base = hosts.groupBy(registrable("host").alias("base_domain")).agg(F.count("*").alias("unique_hosts"))
    return base.filter(F.col("unique_hosts") >= threshold)


def render_layers(layers: DataFrame) -> DataFrame:
    """Raw, sanitized and rendered text of one output: what survived, what the renderer added."""
    active = F.filter(F.array(*[F.when(F.col("sanitized").rlike(p), F.lit(n)) for n, p in X.ACTIVE_CONTENT.items()]),
                      lambda x: x.isNotNull())
    new = F.array_except(X.render_urls("rendered"), X.render_urls("sanitized"))
    return detect(layers.withColumns({"_active": active, "_new": new}), "render", [
        Rule("active_content_survived_sanitization", "critical", F.size("_active") > 0,
             detail=F.array_join("_active", ",")),
        Rule("renderer_introduced_external_url", "high", F.size("_new") > 0, detail=F.array_join("_new", ",")),
    ], kind="output", subject="output_id", event_id="output_id")


def render_requests(events: DataFrame, origins: list | None = None) -> DataFrame:
    e = ensure(events, "url string, session_token_access boolean")
    o = origin("url")
    return detect(e, "render", [
        Rule("rendered_content_unapproved_network_request", "high", o.isNotNull() & outside(o, origins), detail=o),
        Rule("rendered_content_session_token_access", "critical", truthy("session_token_access")),
    ], kind="origin", subject=o, event_id="event_id")


def markup(docs: DataFrame) -> DataFrame:
    """Hidden regions and external resources per document: ``doc_id, type, severity, n``."""
    text = F.col("text")
    urls = F.concat(F.regexp_extract_all(text, F.lit(X.MARKDOWN_IMAGE), F.lit(1)),
                    F.regexp_extract_all(text, F.lit(X.HTML_RESOURCE), F.lit(1)))
    external = F.filter(urls, lambda u: u.rlike("(?i)^(?:https?|wss?):"))
    counts = [F.struct(F.lit(n).alias("type"), F.lit("critical" if n in X.MARKUP_CRITICAL else "high").alias("severity"),
                       X.count(text, p).alias("n")) for n, p in X.MARKUP_PATTERNS.items()]
    counts.append(F.struct(F.lit("renderable_external_resources").alias("type"), F.lit("medium").alias("severity"),
                           F.size(external).cast("bigint").alias("n")))
    hits = F.filter(F.array(*counts), lambda x: x["n"] > 0)
    return docs.select("doc_id", F.explode(hits).alias("f")).select("doc_id", "f.type", "f.severity", "f.n")


def entity_decoding(docs: DataFrame) -> DataFrame:
    """Documents whose text changes when HTML entities are decoded."""
    maybe = docs.filter(F.contains("text", F.lit("&"))).withColumn("_decoded", X.unescape_html("text"))
    changed = maybe.filter(F.col("_decoded") != F.col("text"))
    return changed.select("doc_id", F.lit("html_entity_decoding_delta").alias("type"), F.lit("medium").alias("severity"),
                          F.sha2("_decoded", 256).alias("decoded_sha256"))


def unicode_smuggling(docs: DataFrame) -> DataFrame:
    """Invisible, direction-changing and confusable characters: ``doc_id, type, severity, n``."""
    # All classes lie outside ASCII: one pass strips the rest, the counts run on what is left.
    docs = docs.select("doc_id", F.regexp_replace("text", r"[\x00-\x7F]+", "").alias("text")).filter("text <> ''")
    text = F.col("text")
    counts = [F.struct(F.lit(f"unicode_{n}").alias("type"),
                       F.lit("critical" if n in ("tag", "bidi") else "high").alias("severity"),
                       X.count(text, p).alias("n")) for n, p in X.UNICODE_CLASSES.items()]
    counts.append(F.struct(F.lit("unicode_confusable_characters").alias("type"), F.lit("high").alias("severity"),
                           X.count(text, f"[{X.CONFUSABLE}]").alias("n")))
    hits = F.filter(F.array(*counts), lambda x: x["n"] > 0)
    return docs.select("doc_id", F.explode(hits).alias("f")).select("doc_id", "f.type", "f.severity", "f.n")


def unicode_normalization(docs: DataFrame) -> DataFrame:
    """Texts that NFKC changes and words that mix scripts."""
    odd = docs.filter(F.col("text").rlike(r"[^\x00-\x7F]")).withColumns({
        "_nfkc": X.nfkc("text"), "_mixed": X.mixed_script_tokens("text")})
    return detect(odd, "unicode", [
        Rule("unicode_nfkc_normalization_delta", "medium", F.col("_nfkc") != F.col("text"), detail=F.sha2("_nfkc", 256)),
        Rule("mixed_script_tokens", "high", F.size("_mixed") > 0,
             detail=F.concat(F.size("_mixed").cast("string"), F.lit(": "), F.array_join(F.slice("_mixed", 1, 20), ","))),
    ], kind="document", subject="doc_id")


def terminal_controls(docs: DataFrame) -> DataFrame:
    """Terminal control sequences: ``doc_id, type, severity, n``."""
    text = F.col("text")
    d = docs.withColumns({
        "_csi": X.count(text, X.CSI_ANY), "_display": X.count(text, X.CSI_DISPLAY),
        "_codes": F.regexp_extract_all(text, F.lit(X.OSC), F.lit(1))})
    n_of = lambda cond: F.size(F.filter("_codes", cond)).cast("bigint")
    title = ["0", "1", "2"]
    counts = [
        ("terminal_cursor_or_display_control", "high", F.col("_display")),
        ("terminal_osc8_hyperlink", "high", n_of(lambda x: x == "8")),
        ("terminal_osc52_clipboard_control", "critical", n_of(lambda x: x == "52")),
        ("terminal_title_control", "medium", n_of(lambda x: x.isin(title))),
        ("terminal_osc_sequence", "medium", n_of(lambda x: ~x.isin(title + ["8", "52"]))),
        ("unparsed_terminal_escape_sequence", "medium", F.when(
            F.contains(text, F.lit("\x1b")) & (F.col("_csi") == 0) & (F.size("_codes") == 0), 1).otherwise(0).cast("bigint")),
    ]
    hits = F.filter(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"), n.alias("n"))
                              for t, s, n in counts]), lambda x: x["n"] > 0)
    return d.select("doc_id", F.explode(hits).alias("f")).select("doc_id", "f.type", "f.severity", "f.n")


def path_names(paths: DataFrame) -> DataFrame:
    base = F.lower(F.regexp_extract("path", r"([^/]*)/?$", 1))
    hits = sum((F.contains(base, F.lit(w)).cast("int") for w in PATH_WORDS), F.lit(0))
    return detect(paths, "workspace", [
        Rule("workspace_path_invisible_or_bidi_characters", "critical", F.col("path").rlike(PATH_INVISIBLE)),
        Rule("adversarial_instruction_like_path_name", "high", (F.length(base) >= 60) & (hits >= 2), detail=hits),
    ], kind="file", subject="path")


def config_keys(files: DataFrame) -> DataFrame:
    """Execution-related keys and auto-approval in JSON configuration text."""
    text = F.col("text")
    valid = F.try_parse_json(text).isNotNull()
    rules = [Rule("workspace_sensitive_execution_key", "medium", valid & text.rlike(rf'(?i)"[^"]*{k}[^"]*"\s*:'),
                  detail=F.lit(k)) for k in SENSITIVE_KEYS]
    rules.append(Rule("workspace_autoapproval_setting", "critical",
                      valid & text.rlike(r'(?i)"[^"]*autoApprove[^"]*"\s*:\s*(?:true|"[^"]+")')))
    return detect(files, "workspace", rules, kind="file", subject="path")


def _path_parts(name: Column):
    clean = F.replace(name, F.lit("\\"), F.lit("/"))
    return clean, F.split(clean, "/")


def _escapes(name: Column) -> Column:
    clean, parts = _path_parts(name)
    return clean.startswith("/") | clean.rlike("^[A-Za-z]:") | F.array_contains(parts, "..")


def _ambiguous(name: Column) -> Column:
    clean, parts = _path_parts(name)
    inner = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return ((clean == "") | clean.rlike(r"[\x00-\x1F\x7F]") | F.exists(inner, lambda p: p.isin("", "."))
            | F.exists(parts, lambda p: p.rlike("[. ]$"))
            | F.exists(parts, lambda p: F.lower(p).rlike(r"^(?:con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\..*)?$")))


def archive_members(members: DataFrame) -> DataFrame:
    """Risks of archive members from the member table (nothing is extracted)."""
    m = ensure(members, "link_target string, is_symlink boolean, is_hardlink boolean, special_type string, "
                        "encrypted boolean, compression_ratio double, size bigint")
    name = F.col("name")
    clean, parts = _path_parts(name)
    low = F.lower(clean)
    folded = F.transform(parts, lambda p: F.lower(p))
    control = (F.element_at(folded, -1).isin(CONTROL_NAMES) | F.exists(folded, lambda p: p.isin(CONTROL_DIRS))
               | F.contains(low, F.lit(".github/workflows/")) | F.contains(low, F.lit(".git/hooks/"))
               | low.endswith(".github/copilot-instructions.md"))
    nested = F.lit(False)
    for s in NESTED_SUFFIXES:
        nested = nested | low.endswith(s)
    link = F.col("link_target")
    return detect(m, "archive", [
        Rule("archive_path_escape", "critical", _escapes(name)),
        Rule("archive_ambiguous_member_path", "high", _ambiguous(name)),
        Rule("archive_symlink_member", "high", truthy("is_symlink") | truthy("is_hardlink")),
        Rule("archive_link_target_escape_or_ambiguity", "critical", _escapes(link) | _ambiguous(link)),
        Rule("archive_special_member", "high", present("special_type")),
        Rule("archive_encrypted_member", "high", truthy("encrypted")),
        Rule("archive_extreme_compression_ratio", "high",
             (F.col("compression_ratio") >= 100) & (F.col("size") >= 1024 * 1024)),
        Rule("archive_contains_agent_autoload_control", "high", control),
        Rule("archive_contains_nested_archive", "medium", nested),
    ], kind="archive_member", subject="name", event_id="archive_id")


def skill_text(files: DataFrame) -> DataFrame:
    """URLs, capability words and sensitive paths of skill files."""
    low = F.lower("text")
    caps = F.filter(F.array(*[F.when(contains_any(low, words), F.lit(cap))
                              for cap, words in sorted(X.SKILL_CAPABILITIES.items())]), lambda x: x.isNotNull())
    sens = F.filter(F.array(*[F.when(F.contains(low, F.lit(s)), F.lit(s)) for s in X.SKILL_SENSITIVE]),
                    lambda x: x.isNotNull())
    urls = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(X.SKILL_URL), F.lit(0))))
    return files.select("path", urls.alias("urls"), caps.alias("capabilities"), sens.alias("sensitive"))


def agentic_risks(nodes: DataFrame) -> DataFrame:
    """Risks raised only by explicit true signals in a node's attributes (map of booleans)."""
    attrs = F.col("attributes")
    hits = [F.when(F.size(m) > 0, F.struct(F.lit(r).alias("risk_id"), F.lit(n).alias("risk_name"), m.alias("signals")))
            for r, n, signals in AGENTIC_RISKS
            for m in [F.filter(F.array(*[F.when(truthy(attrs[s]), F.lit(s)) for s in signals]), lambda x: x.isNotNull())]]
    flat = nodes.select("node_id", "evidence_refs", F.explode(
        F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("r"))
    return flat.select(
        "node_id", "r.risk_id", "r.risk_name", F.array_join("r.signals", ",").alias("signals"),
        F.when(F.size("evidence_refs") > 0, "observed-signal").otherwise("signal-without-bound-evidence").alias("confidence"))


def service_slo(probes: DataFrame, policies: DataFrame, default: dict | None = None) -> DataFrame:
    """Service probes against their own or the default objectives."""
    d = default or {}
    p = probes.join(policies.withColumn("_own", F.lit(True)), "service", "left")

    def goal(name, fallback):
        # A service with its own policy row takes missing goals from the built-in values.
        return F.when(truthy("_own"), F.coalesce(name, F.lit(float(fallback)))).otherwise(
            F.lit(float(d.get(name, fallback))))

    lag = F.coalesce("ingest_lag_seconds", F.lit(1e9))
    return detect(p, "slo", [
        Rule("slo_availability_breach", "critical",
             F.coalesce("availability_percent", F.lit(0.0)) < goal("min_availability_percent", 99.0)),
        Rule("slo_ingest_lag_breach", "critical", lag > goal("max_ingest_lag_seconds", 300)),
        Rule("slo_error_rate_breach", "high",
             F.coalesce("error_percent", F.lit(100.0)) > goal("max_error_percent", 1.0)),
    ], kind="service", subject="service")


def verdict_ingest(verdicts: DataFrame, sources: DataFrame) -> DataFrame:
    """Classifier verdicts: allowed fields only, bound to the exact source hash."""
    v = verdicts.join(sources.select("source_id", F.col("sha256").alias("source_digest")), "source_id", "left")
    keys = F.json_object_keys("body")
    extra = F.array_except(keys, F.lit(VERDICT_KEYS))
    bad = F.array_intersect(extra, F.lit(VERDICT_FORBIDDEN))
    get = lambda k: F.get_json_object("body", f"$.{k}")
    conf, num = get("confidence"), F.expr("try_cast(get_json_object(body, '$.confidence') AS DOUBLE)")
    return detect(v, "semantic_verdict", [
        Rule("semantic_verdict_contains_executable_fields", "critical", F.size(bad) > 0,
             detail=F.array_join(F.array_sort(bad), ",")),
        Rule("semantic_verdict_unrecognized_fields", "medium", F.size(F.array_except(extra, bad)) > 0),
        Rule("semantic_verdict_source_hash_mismatch", "critical", ~get("source_sha256").eqNullSafe(F.col("source_digest"))),
        Rule("semantic_verdict_invalid_value", "high", ~F.lower(F.coalesce(get("verdict"), F.lit("unknown"))).isin(VERDICTS)),
        Rule("semantic_verdict_invalid_confidence", "high", conf.isNotNull() & (num.isNull() | (num < 0) | (num > 1))),
        Rule("semantic_verdict_notes_too_long", "medium", F.length(get("notes")) > VERDICT_MAX_NOTES),
    ], kind="source", subject="source_id", event_id="source_id")
