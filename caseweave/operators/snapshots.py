"""Approved-versus-suspect snapshot diffs: one full outer join, one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import union_all


def snapshot_diff(approved: DataFrame, suspect: DataFrame, keys: list[str], fields: dict, *,
                  added: tuple | None = None, removed: tuple | None = None) -> DataFrame:
    """Added, removed and changed entities.

    ``fields`` maps a field to ``(finding type, severity)``; ``added`` and
    ``removed`` are such pairs too.  A severity may be a Column over the struct
    columns ``a`` (approved) and ``s`` (suspect).  Keys are unique per snapshot.
    """
    cols = [c for c in suspect.columns if c not in keys]
    a = approved.select(*keys, F.struct(*cols, F.lit(True).alias("__in")).alias("a"))
    s = suspect.select(*keys, F.struct(*cols, F.lit(True).alias("__in")).alias("s"))
    both = a.join(s, keys, "full_outer")

    def hit(cond, kind, severity, field, old, new):
        severity = severity if isinstance(severity, Column) else F.lit(severity)
        return F.when(cond, F.struct(F.lit(kind).alias("type"), severity.alias("severity"),
                                     F.lit(field).cast("string").alias("field"),
                                     old.cast("string").alias("approved"), new.cast("string").alias("suspect")))

    nothing = F.lit(None)
    in_a, in_s = F.col("a").isNotNull(), F.col("s").isNotNull()
    hits = [hit(in_a & in_s & ~F.col(f"a.{f}").eqNullSafe(F.col(f"s.{f}")), kind, sev, f,
                F.col(f"a.{f}"), F.col(f"s.{f}")) for f, (kind, sev) in fields.items()]
    if added:
        hits.append(hit(~in_a & in_s, *added, None, nothing, nothing))
    if removed:
        hits.append(hit(in_a & ~in_s, *removed, None, nothing, nothing))
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return both.select(*keys, F.explode(found).alias("f")).select(*keys, "f.*")


def severe_if(cond: Column, then: str = "critical", otherwise: str = "high") -> Column:
    return F.when(cond, then).otherwise(otherwise)


def rag_corpus(approved, suspect):
    """Documents keyed by ``document_id`` with sha256, acl_sha256, metadata_sha256."""
    return snapshot_diff(approved, suspect, ["document_id"], {
        "sha256": ("rag_sha256_changed", "critical"), "acl_sha256": ("rag_acl_sha256_changed", "high"),
        "metadata_sha256": ("rag_metadata_sha256_changed", "high"),
    }, added=("rag_document_added", "high"), removed=("rag_document_removed", "medium"))


def mcp_servers(approved, suspect):
    sev = {"url": "high", "protocol_version": "medium", "authorization_issuer": "critical", "client_id": "high",
           "prompts_sha256": "high", "resources_sha256": "high"}
    return snapshot_diff(approved, suspect, ["server_id"], {f: (f"mcp_{f}_changed", s) for f, s in sev.items()},
                         added=("unexpected_mcp_server", "critical"), removed=("missing_approved_mcp_server", "medium"))


def mcp_tools(approved, suspect):
    """Tools of servers present in both inventories; a removed tool is no finding."""
    servers = approved.select("server_id").intersect(suspect.select("server_id"))
    keep = lambda t: t.join(servers, "server_id", "left_semi")
    fields = ["description_sha256", "input_schema_sha256", "output_schema_sha256"]
    return snapshot_diff(keep(approved), keep(suspect), ["server_id", "tool_name"],
                         {f: ("mcp_tool_schema_changed", "critical") for f in fields},
                         added=("unexpected_mcp_tool", "critical"))


def a2a_cards(approved, suspect):
    sev = {"version": "high", "provider": "critical", "supported_interfaces_sha256": "critical",
           "security_schemes_sha256": "critical", "capabilities_sha256": "high", "extensions_sha256": "high"}
    return snapshot_diff(approved, suspect, ["agent_id"], {f: (f"a2a_{f}_changed", s) for f, s in sev.items()})


def a2a_skills(approved, suspect):
    """Skills keyed by (agent_id, skill_id) with one digest over their normalized attributes."""
    return snapshot_diff(approved, suspect, ["agent_id", "skill_id"], {"skill_sha256": ("a2a_skill_changed", "critical")},
                         added=("a2a_unexpected_skill", "critical"))


def skill_files(approved, suspect):
    """Files keyed by (skill_id, path) with sha256 and executable."""
    by_exec = severe_if(F.col("s.executable"))
    return snapshot_diff(approved, suspect, ["skill_id", "path"], {"sha256": ("skill_file_changed", by_exec)},
                         added=("skill_file_added", by_exec), removed=("skill_file_removed", "medium"))


def skill_signals(approved, suspect):
    """URLs and capabilities new in a skill.  Rows: (skill_id, kind, value), kind url, capability or sensitive."""
    new = suspect.select("skill_id", "kind", "value").distinct().join(
        approved.select("skill_id", "kind", "value"), ["skill_id", "kind", "value"], "left_anti")
    drift = new.filter(F.col("kind").isin("url", "capability")).groupBy("skill_id", "kind").agg(
        F.count("*").alias("n")).select(
        "skill_id", F.when(F.col("kind") == "url", "skill_external_instruction_or_endpoint_drift")
        .otherwise("skill_capability_expansion").alias("type"), F.lit("critical").alias("severity"), "n")
    sensitive = suspect.filter("kind = 'sensitive'").groupBy("skill_id").agg(F.count("*").alias("n")).select(
        "skill_id", F.lit("skill_sensitive_identity_or_memory_access_signal").alias("type"),
        F.lit("high").alias("severity"), "n")
    return drift.unionByName(sensitive)


def workspace_files(approved, suspect):
    """Control files keyed by path; any attribute change counts once."""
    by_type = severe_if(F.col("s.control_type") == "executable_or_automation")
    attrs = [c for c in suspect.columns if c != "path"]
    digest = lambda t: t.withColumn("record", F.to_json(F.struct(*attrs)))
    diff = snapshot_diff(digest(approved), digest(suspect), ["path"],
                         {"record": ("workspace_control_file_changed", by_type)},
                         added=("workspace_control_file_added", by_type),
                         removed=("workspace_control_file_removed", "medium")).select("path", "type", "severity")
    links = suspect.filter("is_symlink").select(
        "path", F.lit("workspace_control_symlink").alias("type"), F.lit("high").alias("severity"))
    return diff.unionByName(links)


def ide_surface(approved, suspect):
    """IDE control files keyed by path with sha256 and categories (array)."""
    risky = F.arrays_overlap(F.col("s.categories"), F.lit(
        ["mcp_config", "lsp_config", "hooks", "tools_skills", "automation"]))
    return snapshot_diff(approved, suspect, ["path"], {"sha256": ("ide_control_surface_changed", "critical")},
                         added=("ide_control_surface_added", severe_if(risky)))


# Harness fields and the severity of a change.
HARNESS_FIELDS = {
    "package": "critical", "version": "high", "binary_sha256": "critical", "container_digest": "critical",
    "prompt_assembly_sha256": "critical", "middleware_sha256": "critical", "hooks_sha256": "critical",
    "tool_policy_sha256": "critical", "approval_policy_sha256": "critical", "memory_strategy_sha256": "high",
    "stop_policy_sha256": "critical", "context_priority_sha256": "critical", "dynamic_imports_sha256": "critical",
    "plugin_registry_sha256": "critical", "skill_registry_sha256": "critical",
}


def harness(approved, suspect):
    fields = {f: (f"harness_{f}_changed", s) for f, s in HARNESS_FIELDS.items() if f in suspect.columns}
    return snapshot_diff(approved, suspect, ["harness_id"], fields)


def harness_members(approved, suspect):
    """New dynamic imports, plugins and skills.  Rows: (harness_id, kind, value)."""
    new = suspect.select("harness_id", "kind", "value").distinct().join(
        approved.select("harness_id", "kind", "value"), ["harness_id", "kind", "value"], "left_anti")
    return new.select("harness_id", F.concat(F.lit("unexpected_harness_"), "kind").alias("type"),
                      F.lit("critical").alias("severity"), "value")


def runtime_hooks(approved, suspect):
    """Hooks keyed by node, module, kind, source hash and qualified name."""
    keys = ["node_id", "module_name", "hook_kind", "source_sha256", "qualname"]
    tag = lambda t: t.select(*keys, F.lit(1).alias("present")).distinct()
    return snapshot_diff(tag(approved), tag(suspect), keys, {},
                         added=("unexpected_hook", "high"), removed=("missing_approved_hook", "medium"))


def runtime_adapters(approved, suspect):
    """Adapter configurations keyed by (node_id, name)."""
    return snapshot_diff(approved, suspect, ["node_id", "name"], {"config_sha256": ("adapter_config_changed", "high")},
                         added=("unexpected_adapter_config", "high"))


def model_files(reference: DataFrame, suspect: DataFrame) -> DataFrame:
    """Status of every model file: identical, different, reference_only or suspect_only."""
    r = reference.select("path", F.col("sha256").alias("reference_sha256"), F.lit(True).alias("_r"))
    s = suspect.select("path", F.col("sha256").alias("suspect_sha256"), F.lit(True).alias("_s"))
    return r.join(s, "path", "full_outer").select(
        "path", F.when(F.col("_r").isNull(), "suspect_only").when(F.col("_s").isNull(), "reference_only")
        .when(F.col("reference_sha256").eqNullSafe(F.col("suspect_sha256")), "identical").otherwise("different").alias("status"),
        "reference_sha256", "suspect_sha256")


BOM_FIELDS = ["kind", "name", "version", "sha256", "source", "properties"]


def bom_components(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Component drift of two inventories of one system: missing, unexpected or modified."""
    e = expected.select("component_id", F.struct(*BOM_FIELDS).alias("e"))
    o = observed.select("component_id", F.struct(*BOM_FIELDS).alias("o"))
    changed = F.filter(F.array(*[
        F.when(~F.col(f"e.{f}").eqNullSafe(F.col(f"o.{f}")), F.lit(f)) for f in BOM_FIELDS]), lambda x: x.isNotNull())
    kind = (F.when(F.col("o").isNull(), "missing").when(F.col("e").isNull(), "unexpected")
            .when(F.size("changed") > 0, "modified"))
    none = F.array().cast("array<string>")
    return (e.join(o, "component_id", "full_outer")
            .withColumn("changed", F.when(F.col("e").isNotNull() & F.col("o").isNotNull(), changed).otherwise(none))
            .select("component_id", kind.alias("change_type"), F.array_join("changed", ",").alias("changed_fields"))
            .filter("change_type IS NOT NULL"))


def bom_dependencies(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Dependency pairs on one side only, each once; repeated rows count as one.

    Both sides meet in one aggregate with two flags a pair, so a task holds a pair once.
    """
    side = lambda df, wanted: df.select("source", "target", F.lit(wanted).alias("__e"), F.lit(not wanted).alias("__o"))
    known = union_all([side(expected, True), side(observed, False)]).groupBy("source", "target").agg(
        F.bool_or("__e").alias("__e"), F.bool_or("__o").alias("__o"))
    return known.filter("__e <> __o").select("source", "target", F.when(F.col("__o"), "added").otherwise("removed").alias("change"))
