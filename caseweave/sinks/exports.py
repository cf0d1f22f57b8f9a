"""Export projections and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import epoch_ms

# OCSF status and severity ids.
STATUS_ID = {"OPEN": 1, "TRIAGE": 2, "INVESTIGATING": 2, "CONTAINED": 2, "RECOVERING": 2, "CLOSED": 5, "ARCHIVED": 5}
SEVERITY_ID = {"low": 2, "medium": 3, "high": 4, "critical": 5}
OCSF_VERSION = "1.8.0"
RELATIVE_L2, EXACT_COSINE = "relative_l2_to_exact_approved_activation", "cosine_to_exact_approved_activation"


def _lookup(values: dict, key: Column, default: int) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key], F.lit(default))


def ocsf_process_activity(attestations: DataFrame, model: dict | None = None) -> DataFrame:
    """Process Activity events with the worst relative L2 and cosine over all depths of an attestation."""
    m = model or {}
    depths = F.map_values("measurements")
    pick = lambda name: F.filter(F.transform(depths, lambda d: d[name]), lambda x: x.isNotNull())
    a = attestations.filter("event_type = 'activation_attestation'")
    return a.select(
        F.lit(1).alias("category_uid"), F.lit(1007).alias("class_uid"), F.lit(99).alias("activity_id"), F.lit(100799).alias("type_uid"),
        epoch_ms("ts").alias("time"), F.lit(1).alias("severity_id"),
        F.struct(F.lit(OCSF_VERSION).alias("version"), F.array(F.lit("ai_operation")).alias("profiles")).alias("metadata"),
        F.struct(F.col("pid").alias("pid"), F.lit("model-inference-worker").alias("name")).alias("process"),
        F.struct(F.lit(m.get("name")).cast("string").alias("name"), F.lit(m.get("provider")).cast("string").alias("ai_provider"),
                 F.coalesce(F.lit(m.get("version")).cast("string"), "model_revision").alias("version")).alias("ai_model"),
        F.struct(F.col("request_id").alias("session_uid")).alias("message_context"),
        F.struct("prompt_sha256", F.array_max(pick(RELATIVE_L2)).alias("max_relative_l2"),
                 F.array_min(pick(EXACT_COSINE)).alias("min_exact_activation_cosine")).alias("unmapped"))


def ocsf_incident(cases: DataFrame) -> DataFrame:
    """Incident Finding (class 2005) per case; closed cases export as Close, the rest as Update."""
    closing = F.col("status").isin("CLOSED", "ARCHIVED")
    activity = F.when(closing, 3).otherwise(2)
    return cases.select(
        F.lit(2).alias("category_uid"), F.lit(2005).alias("class_uid"), activity.alias("activity_id"), (F.lit(200500) + activity).alias("type_uid"),
        F.when(closing, "Close").otherwise("Update").alias("activity_name"), epoch_ms("created").alias("time"),
        _lookup(SEVERITY_ID, F.lower("severity"), 1).alias("severity_id"), _lookup(STATUS_ID, F.col("status"), 2).alias("status_id"), "status",
        F.struct(F.lit(OCSF_VERSION).alias("version"), F.array(F.lit("incident")).alias("profiles")).alias("metadata"),
        F.array(F.struct(F.col("case_id").alias("uid"), "title", F.array(F.lit("AI Incident Response")).alias("types"))).alias("finding_info_list"),
        F.col("summary").alias("desc"), F.struct(F.coalesce(F.when(F.col("owner") != "", F.col("owner")), F.lit("unassigned")).alias("name")).alias("assignee"),
        F.struct("case_id", "tenant_id", "tags").alias("unmapped"))


def splunk_hec(events: DataFrame, host: str, source: str) -> DataFrame:
    """HEC envelopes around exported incidents."""
    return events.select((F.col("time") / 1000).alias("time"), F.lit(host).alias("host"), F.lit(source).alias("source"), F.lit("_json").alias("sourcetype"),
                         F.struct(*events.columns).alias("event"), F.struct("unmapped.case_id", "unmapped.tenant_id").alias("fields"))


def ecs(findings: DataFrame, dataset: str) -> DataFrame:
    return findings.select(
        F.lit("alert").alias("event.kind"), F.array(F.lit("intrusion_detection")).alias("event.category"), F.array(F.lit("info")).alias("event.type"),
        F.lit(dataset).alias("event.dataset"), F.col("type").alias("rule.name"), F.col("severity").alias("event.severity"),
        F.col("analyzer").alias("domain"), F.to_json(F.struct("type", "severity", "subject_id", "event_id", "detail")).alias("message"))


def stix_notes(findings: DataFrame, created: Column, label: str) -> DataFrame:
    """STIX 2.1 notes; ids derive from the finding, so a re-run exports the same ids."""
    body = F.to_json(F.struct("type", "severity", "subject_id", "event_id", "detail"))
    h = F.md5(body)
    uid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
                      F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return findings.select(F.lit("note").alias("type"), F.lit("2.1").alias("spec_version"), F.concat(F.lit("note--"), uid).alias("id"),
                           created.alias("created"), created.alias("modified"), F.col("type").alias("abstract"), body.alias("content"),
                           F.array(F.lit(label), F.col("severity")).alias("labels"))


def otel_fleet(view: DataFrame, now_nanos: Column, service: str) -> DataFrame:
    """One gauge row per node state."""
    return view.select(
        F.struct(F.lit(service).alias("service.name"), F.col("node_id").alias("service.instance.id")).alias("resource"),
        F.struct(F.lit("fleet.node.state").alias("name"), now_nanos.alias("time_unix_nano"), F.lit(1).alias("value"),
                 F.struct("node_id", "state", "stale", "age_seconds").alias("attributes")).alias("metric"))


def case_graph(artifacts: DataFrame, relationships: DataFrame) -> DataFrame:
    """CASE/UCO nodes: each artifact with its content facet and hash, and the lineage between artifacts.

    ``artifacts``: case_id, artifact_id, sha256, size, path.  Output: case_id, id, type, body (JSON-LD).
    """
    nid = lambda kind, x: F.concat(F.lit("urn:node:"), F.substring(F.sha2(F.concat_ws("|", "case_id", F.lit(kind), x), 256), 1, 32))
    obj, facet, hsh = (nid(k, F.col("artifact_id")) for k in ("artifact", "facet", "sha256"))
    ref = lambda x: F.struct(x.alias("@id"))
    row = lambda ident, kind, body: F.struct(ident.alias("id"), F.lit(kind).alias("type"), F.to_json(body).alias("body"))
    nodes = artifacts.select("case_id", F.explode(F.array(
        row(obj, "uco-observable:ObservableObject", F.struct(obj.alias("@id"), F.lit("uco-observable:ObservableObject").alias("@type"),
            F.array(ref(facet)).alias("uco-core:hasFacet"), F.col("artifact_id").alias("uco-core:name"), F.col("path").alias("path"))),
        row(facet, "uco-observable:ContentDataFacet", F.struct(facet.alias("@id"), F.lit("uco-observable:ContentDataFacet").alias("@type"),
            F.col("size").alias("uco-observable:sizeInBytes"), F.array(ref(hsh)).alias("uco-observable:hash"))),
        row(hsh, "uco-types:Hash", F.struct(hsh.alias("@id"), F.lit("uco-types:Hash").alias("@type"), F.lit("SHA256").alias("uco-types:hashMethod"),
            F.col("sha256").alias("uco-types:hashValue"))))).alias("__n")).select("case_id", "__n.*")
    child, parent = nid("artifact", F.col("child_artifact_id")), nid("artifact", F.col("parent_artifact_id"))
    rid = nid("relationship", F.concat_ws(">", "parent_artifact_id", "child_artifact_id"))
    edges = relationships.select("case_id", rid.alias("id"), F.lit("uco-core:Relationship").alias("type"), F.to_json(F.struct(
        rid.alias("@id"), F.lit("uco-core:Relationship").alias("@type"), F.array(ref(child)).alias("uco-core:source"),
        ref(parent).alias("uco-core:target"), F.lit(True).alias("uco-core:isDirectional"))).alias("body"))
    return nodes.unionByName(edges)


def cyclonedx_components(components: DataFrame) -> DataFrame:
    """CycloneDX 1.7 component JSON; models are machine-learning components, the rest applications."""
    kind = F.when(F.col("kind").isin("model", "embedding-model"), "machine-learning-model").otherwise("application")
    props = F.array_compact(F.array(F.struct(F.lit("kind").alias("name"), F.col("kind").alias("value")),
                                    F.when(F.col("source") != "", F.struct(F.lit("source").alias("name"), F.col("source").alias("value")))))
    hashes = F.when(F.col("sha256") != "", F.array(F.struct(F.lit("SHA-256").alias("alg"), F.col("sha256").alias("content"))))
    return components.select("component_id", F.to_json(F.struct(
        kind.alias("type"), F.col("component_id").alias("bom-ref"), "name", "version", hashes.alias("hashes"), props.alias("properties"))).alias("component"))


def write_lake(findings: DataFrame, path: str, per_file_rows: int = 1_000_000) -> None:
    """Findings as parquet partitioned by tenant and analyzer, for pruning by either."""
    (findings.write.mode("append").option("maxRecordsPerFile", per_file_rows)
     .partitionBy("tenant_id", "analyzer").parquet(path))


def write_findings(findings: DataFrame, path: str, fmt: str = "json", codec: str | None = None) -> None:
    """JSON lines, CSV, parquet, or a Markdown table as text parts, each with the table's head.

    ``codec`` compresses the parts other than the session's default does.
    """
    packed = {"compression": codec} if codec else {}
    if fmt == "markdown":
        cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in findings.columns]), F.lit(" |"))
        head = f"| {' | '.join(findings.columns)} |\n{'|---' * len(findings.columns)}|"
        # A part starts with the head: the first row of each partition carries it.
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
        findings.select(F.when(first, F.concat(F.lit(head + "\n"), line)).otherwise(line).alias("value")).write.mode("overwrite").options(**packed).text(path)
    elif fmt == "csv":
        findings.write.mode("overwrite").options(**packed).option("header", True).csv(path)
    else:
        findings.write.mode("overwrite").options(**packed).format(fmt).save(path)
