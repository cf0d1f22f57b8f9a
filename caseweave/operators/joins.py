"""Join-shaped operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import present
from ..runtime import materialize
from ..schema import union_all
from .ordered import prior

MEMORY_WRITES = ["memory_write", "memory_update", "memory_upsert", "memory_create"]
MEMORY_DELETES = ["memory_delete", "memory_tombstone"]
MEMORY_READS = ["memory_read", "search_memory", "retrieval"]


def missing_references(events: DataFrame, known: DataFrame) -> DataFrame:
    """Parent and cause references to events that are not recorded (a warning, not an error)."""
    refs = events.select("event_id", F.explode(F.concat(
        F.array("parent_event_id"), F.coalesce("cause_event_ids", F.array().cast("array<string>")))).alias("ref"))
    return (refs.filter("ref <> ''")
            .join(known.select(F.col("event_id").alias("ref")), "ref", "left_anti")
            .select("event_id", F.col("ref").alias("missing_reference")))


def memory_integrity(events: DataFrame, chunk: Column, trusted: list | None = None,
                     baseline: DataFrame | None = None) -> DataFrame:
    """As-of join of memory operations to the latest version at their own time.

    ``events``: event_id, event_type, ts, ord, tenant_id, memory_id, version,
    content_sha256, expected_content_sha256, source_event_id, expires,
    embedding_model, actor_id, has_cause.  ``baseline`` adds earlier records
    with the columns of a write.  A read that its tenant never wrote falls back
    to the record of the tenant whose key was created last before the read.
    """
    kind = (F.when(F.col("event_type").isin(MEMORY_WRITES), "write")
            .when(F.col("event_type").isin(MEMORY_DELETES), "delete")
            .when(F.col("event_type").isin(MEMORY_READS), "read"))
    e = events.withColumn("_op", kind).filter("_op IS NOT NULL AND memory_id <> ''").withColumn("_chunk0", chunk)
    if baseline is not None:
        base = baseline.withColumns({"_op": F.lit("write"), "_baseline": F.lit(True), "_chunk0": F.lit(-(2 ** 61))})
        e = e.withColumn("_baseline", F.lit(False)).unionByName(base, allowMissingColumns=True)
    else:
        e = e.withColumn("_baseline", F.lit(False))
    written = F.when(F.col("_op") == "write", F.struct(
        "tenant_id", "version", "content_sha256", "expires", "embedding_model",
        F.col("ts").alias("created")))
    key, order = ["tenant_id", "memory_id"], ["_chunk0", "ts", "ord"]
    e = prior(e, key, order, {
        "_rec": ("last", written),
        "_tomb": ("last", F.when(F.col("_op") == "delete", F.struct(F.col("ts").alias("at")))),
        "_tomb_at": ("max", F.when(F.col("_op") == "delete", F.struct(*order))),
        "_write_at": ("max", F.when(F.col("_op") == "write", F.struct(*order))),
    }, F.col("_chunk0"))
    # A tombstone counts until the next write of the same key; one without any
    # earlier write leaves a bare record of that key.
    dead = F.col("_tomb_at").isNotNull() & (F.col("_write_at").isNull() | (F.col("_tomb_at") > F.col("_write_at")))
    e = e.withColumns({"_tombstoned": F.when(dead, F.col("_tomb.at")),
                       "_known": F.col("_rec").isNotNull() | dead})
    # The fallback below reads this stage several times: write it once.
    e = materialize(e)

    # Cross-tenant fallback: the key (tenant) of this memory id created last
    # before the read, and that key's latest record.
    first = (F.col("_op") != "read") & ~F.col("_known")
    created = F.when(first, F.struct(F.col("tenant_id").alias("owner")))
    e = prior(e, ["memory_id"], order, {"_last_key": ("last", created)}, F.col("_chunk0"))
    e = e.withColumn("_owner", F.when((F.col("_op") == "read") & ~F.col("_known"), F.col("_last_key.owner")))
    orphans = (e.filter("_op = 'read' AND NOT _known AND _last_key IS NOT NULL")
               .select("event_id", "memory_id", F.col("_last_key.owner").alias("tenant_id"), *order))
    states = e.filter("_op <> 'read'").select(
        F.lit(None).cast("string").alias("event_id"), "memory_id", "tenant_id", *order,
        written.alias("w"), F.when(F.col("_op") == "delete", F.struct(F.col("ts").alias("at"))).alias("d"))
    looked = prior(states.unionByName(orphans, allowMissingColumns=True), key, order, {
        "_frec": ("last", "w"), "_fdel": ("last", F.when(F.col("d").isNotNull(), F.struct(*order, F.col("d.at").alias("at")))),
        "_fwr": ("max", F.when(F.col("w").isNotNull(), F.struct(*order))),
    }, F.col("_chunk0")).filter("event_id IS NOT NULL").select(
        "event_id", "_frec", F.when(F.col("_fwr").isNull() | (F.struct(*[F.col(f"_fdel.{o}") for o in order]) > F.col("_fwr")),
                                    F.col("_fdel.at")).alias("_fdead"))
    e = e.filter("NOT _baseline").join(looked, "event_id", "left")
    rec = F.coalesce("_rec", "_frec")
    ts, read, write = F.col("ts"), F.col("_op") == "read", F.col("_op") == "write"
    lost = read & ~F.col("_known") & F.col("_last_key").isNull()
    seen = read & ~lost
    rules = [
        ("memory_version_regression_or_replay", "critical", write & (F.col("version") <= F.col("_rec.version"))),
        ("memory_untrusted_writer", "critical", write & ~F.col("actor_id").isin(trusted) if trusted else F.lit(False)),
        ("memory_missing_source_provenance", "high", write & ~present("source_event_id") & ~F.col("has_cause")),
        ("memory_cross_tenant_read", "critical", read & ~F.col("_known") & F.col("_last_key").isNotNull()),
        ("memory_read_without_version_evidence", "high", lost),
        ("memory_read_after_expiry", "critical", seen & (ts >= rec["expires"])),
        ("memory_read_after_tombstone", "critical", seen & (ts >= F.coalesce("_tombstoned", "_fdead"))),
        ("memory_read_content_hash_mismatch", "critical", seen & present("expected_content_sha256")
         & ~F.col("expected_content_sha256").eqNullSafe(rec["content_sha256"])),
        ("memory_embedding_model_drift", "high", seen & present("embedding_model") & present(rec["embedding_model"])
         & (F.col("embedding_model") != rec["embedding_model"])),
    ]
    hits = F.filter(F.array(*[F.when(c, F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"))) for t, s, c in rules]),
                    lambda x: x.isNotNull())
    return e.select("event_id", "memory_id", "tenant_id", F.explode(hits).alias("f")).select(
        "f.type", "f.severity", "memory_id", "tenant_id", "event_id")


def poisoned_sessions(events: DataFrame, poisoned: DataFrame) -> DataFrame:
    """Sessions that included a poisoned chunk in a prompt, with what followed in them."""
    bad = (events.filter("event_type = 'retrieval_result' AND included_in_prompt")
           .join(poisoned.select(F.col("sha256").alias("content_sha256")).distinct(), "content_sha256", "left_semi")
           .groupBy("session_id").agg(F.count("*").alias("poisoned_context")))
    rollup = (events.filter(F.col("event_type").isin("tool_call", "consequence")).groupBy("session_id").agg(
        F.count_if(F.col("event_type") == "tool_call").alias("downstream_tool_calls"),
        F.count_if(F.col("event_type") == "consequence").alias("consequences")))
    zero = F.lit(0).cast("bigint")
    return bad.join(rollup, "session_id", "left").select(
        "session_id", "poisoned_context", F.coalesce("downstream_tool_calls", zero).alias("downstream_tool_calls"),
        F.coalesce("consequences", zero).alias("consequences"))


def collector_health(expectations: DataFrame, observations: DataFrame, start: Column | None = None,
                     end: Column | None = None) -> DataFrame:
    """Status per expected source; the last applicable rule wins, no observation means MISSING.

    ``expectations``: source_id, mandatory, expected_events, min_event_ratio,
    max_clock_uncertainty_ms.  ``observations``: source_id, enabled,
    collected_events, last_error, coverage_start, coverage_end,
    retention_gap_seconds, clock_uncertainty_ms.
    """
    j = expectations.join(observations.withColumn("_seen", F.lit(True)), "source_id", "left")
    short = (F.col("expected_events") > 0) & (
        F.col("collected_events") / F.col("expected_events") < F.coalesce("min_event_ratio", F.lit(0.95)))
    no = F.lit(False)
    late = (F.col("coverage_start").isNull() | (F.col("coverage_start") > start)) if start is not None else no
    early = (F.col("coverage_end").isNull() | (F.col("coverage_end") < end)) if end is not None else no
    gap = F.coalesce("retention_gap_seconds", F.lit(0.0)) > 0
    clock = F.coalesce("clock_uncertainty_ms", F.lit(0.0)) > F.coalesce(
        F.when(F.col("max_clock_uncertainty_ms") > 0, F.col("max_clock_uncertainty_ms")), F.lit(60000.0))
    status = (F.when(F.col("_seen").isNull(), "MISSING").when(clock, "DEGRADED")
              .when(gap | early | late | short, "INCOMPLETE")
              .when(present("last_error"), "DEGRADED").when(~F.coalesce("enabled", F.lit(True)), "DISABLED")
              .otherwise("AVAILABLE"))
    return j.select("source_id", F.coalesce("mandatory", no).alias("mandatory"), status.alias("status"))


def collector_findings(health: DataFrame) -> DataFrame:
    return health.filter("status <> 'AVAILABLE'").select(
        F.when(F.col("mandatory"), "mandatory_evidence_source_unavailable").otherwise("evidence_source_degraded").alias("type"),
        F.when(F.col("mandatory"), "critical").otherwise("high").alias("severity"), "source_id", "status")


def complete_mandatory(health: DataFrame) -> DataFrame:
    """One row: are all mandatory sources available?"""
    return health.agg(F.coalesce(F.bool_and(~F.col("mandatory") | (F.col("status") == "AVAILABLE")), F.lit(True))
                      .alias("complete_mandatory"))


def unknown_sources(expectations: DataFrame, observations: DataFrame) -> DataFrame:
    return observations.select("source_id").distinct().join(expectations, "source_id", "left_anti").select("source_id")


def provider_gaps(profile: DataFrame, available: DataFrame, unavailable: DataFrame) -> DataFrame:
    """Expected provider sources: PRESENT, UNAVAILABLE, MISSING or NOT_COLLECTED.

    ``profile``: provider, source, requirement (mandatory or conditional).
    """
    key = ["provider", "source"]
    j = (profile.join(available.select(*key).distinct().withColumn("_have", F.lit(True)), key, "left")
         .join(unavailable.select(*key, "reason").withColumn("_lack", F.lit(True)), key, "left"))
    mandatory = F.col("requirement") == "mandatory"
    return j.select(*key, "requirement", F.when(F.col("_have"), "PRESENT").when(F.col("_lack"), "UNAVAILABLE")
                    .when(mandatory, "MISSING").otherwise("NOT_COLLECTED").alias("status"), "reason")


def tool_shadowing(tools: DataFrame) -> DataFrame:
    """Tool names behind which more than one identity stands."""
    return (tools.select("tool_name", "tool_identity_sha256").distinct().groupBy("tool_name")
            .agg(F.count("*").alias("identities")).filter("identities > 1"))


def tool_executions(executions: DataFrame, approved: DataFrame) -> DataFrame:
    """Executions without an identity, or with one that is not approved."""
    unclear = executions.filter(~present("tool_identity_sha256") | F.col("tool_identity_sha256").isNull()).select(
        F.lit("tool_execution_identity_ambiguous").alias("type"), F.lit("high").alias("severity"), "event_id")
    foreign = executions.filter(present("tool_identity_sha256")).join(
        approved.select("tool_identity_sha256").distinct(), "tool_identity_sha256", "left_anti").select(
        F.lit("unapproved_tool_identity_executed").alias("type"), F.lit("critical").alias("severity"), "event_id")
    return unclear.unionByName(foreign)


def agent_lifecycle(births: DataFrame, deaths: DataFrame, observed: DataFrame) -> DataFrame:
    """Agents without birth record, missing or forbidding parents, and work left open at death."""
    def rows(df, kind, severity, subject="agent_id"):
        return df.select(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.col(subject).alias("agent_id"))

    known = births.select("agent_id").distinct()
    orphan = observed.select("agent_id").distinct().join(known, "agent_id", "left_anti")
    children = births.filter("parent_agent_id <> ''").select("agent_id", "parent_agent_id")
    parents = births.select(F.col("agent_id").alias("parent_agent_id"), "children_allowed")
    return union_all([
        rows(orphan, "agent_without_birth_certificate", "critical"),
        rows(children.join(parents, "parent_agent_id", "left_anti"), "agent_parent_certificate_missing", "high"),
        rows(children.join(parents, "parent_agent_id").filter("NOT coalesce(children_allowed, false)"),
             "unauthorized_child_agent", "critical"),
        rows(deaths.filter("open_children > 0"), "terminated_agent_has_open_children", "critical"),
        rows(deaths.filter("open_consequences > 0"), "terminated_agent_has_open_consequences", "high"),
    ])


def acquisition_binding(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Bind case files to acquisition entries: exact path, else unique base name.

    More than one candidate at the deciding level makes the binding ambiguous.
    ``files``: file_id, path.  ``entries``: entry_id, relative_path, logical_name.
    """
    base = lambda x: F.substring_index(x, "/", -1)
    names = entries.select("entry_id", F.explode(F.array_distinct(F.array_compact(F.array(
        "relative_path", "logical_name")))).alias("name")).filter("name <> ''")
    # Count candidates per name first: a name shared by many entries joins as one row.
    by_path = names.groupBy(F.col("name").alias("path")).agg(
        F.count("*").alias("exact_n"), F.min("entry_id").alias("exact_id"))
    by_base = names.select("entry_id", base("name").alias("base")).distinct().groupBy("base").agg(
        F.count("*").alias("base_n"), F.min("entry_id").alias("base_id"))
    j = (files.withColumn("base", base("path")).join(by_path, "path", "left").join(by_base, "base", "left"))
    status = (F.when(F.col("exact_n") == 1, "exact").when(F.col("exact_n") > 1, "ambiguous_exact")
              .when(F.col("base_n") == 1, "basename").when(F.col("base_n") > 1, "ambiguous_basename").otherwise("unbound"))
    return j.select("file_id", "path", status.alias("binding"),
                    F.when(F.col("exact_n") == 1, F.col("exact_id"))
                    .when(F.col("exact_n").isNull() & (F.col("base_n") == 1), F.col("base_id")).alias("entry_id"))


def retention_disposition(evidence: DataFrame, holds: DataFrame, now: Column) -> DataFrame:
    """Expired evidence, split by active case or evidence holds; nothing is deleted."""
    live = holds.filter("released IS NULL")
    cases = live.filter("evidence_id IS NULL").select("case_id", F.lit(True).alias("_case")).distinct()
    items = live.filter("evidence_id IS NOT NULL").select("evidence_id", F.lit(True).alias("_item")).distinct()
    return (evidence.filter(F.col("retention_until") <= now).join(cases, "case_id", "left").join(items, "evidence_id", "left")
            .select("evidence_id", "case_id", F.when(F.col("_case"), "case legal hold")
                    .when(F.col("_item"), "evidence legal hold").alias("blocked_by")))


def content_verdicts(findings: DataFrame, items: DataFrame) -> DataFrame:
    """PASS, REVIEW or QUARANTINE per content item from the worst severity found."""
    worst = findings.groupBy("item_id").agg(
        F.bool_or(F.lower("severity") == "critical").alias("c"), F.bool_or(F.lower("severity") == "high").alias("h"),
        F.count("*").alias("findings"))
    return items.select("item_id").join(worst, "item_id", "left").select(
        "item_id", F.when(F.col("c"), "QUARANTINE").when(F.col("h"), "REVIEW").otherwise("PASS").alias("verdict"),
        F.coalesce("findings", F.lit(0)).alias("findings"))


def changed_tensors(metrics: DataFrame, screen: DataFrame, k: int = 250) -> DataFrame:
    """Top ``k`` changed tensors by relative delta, with their low-rank screen."""
    return (metrics.filter("status = 'compared' AND relative_fro_delta > 0")
            .join(screen.select("tensor", "top1_energy_ratio", "effective_rank"), "tensor", "left")
            .orderBy(F.desc("relative_fro_delta"), "tensor").limit(k))


def recorded_comparisons(pairs: DataFrame, records: DataFrame, refs: DataFrame) -> DataFrame:
    """Same configuration, same referenced inputs, same output (unknown when a digest is missing).

    ``records``: record_id, provider, model, model_version, policy_config_id,
    output_sha256.  ``refs``: record_id, kind, ordinal, sha256.
    """
    conf = F.struct("provider", "model", "model_version", "policy_config_id")
    side = lambda p: records.select(F.col("record_id").alias(p), conf.alias(f"{p}_conf"), F.col("output_sha256").alias(f"{p}_out"))
    j = pairs.join(side("original"), "original").join(side("comparison"), "comparison")
    wanted = pairs.select(F.explode(F.array("original", "comparison")).alias("record_id")).distinct()
    inputs = refs.join(wanted, "record_id", "left_semi")
    a = pairs.select("pair_id", F.col("original").alias("record_id")).join(inputs, "record_id")
    b = pairs.select("pair_id", F.col("comparison").alias("record_id")).join(inputs, "record_id")
    key = ["pair_id", "kind", "ordinal"]
    differ = (a.select(*key, F.col("sha256").alias("x")).join(b.select(*key, F.col("sha256").alias("y")), key, "full_outer")
              .filter("NOT (x <=> y)").select("pair_id").distinct().withColumn("_differ", F.lit(True)))
    return j.join(differ, "pair_id", "left").select(
        "pair_id", F.col("original_conf").eqNullSafe(F.col("comparison_conf")).alias("same_configuration"),
        F.col("_differ").isNull().alias("same_inputs"),
        (F.col("original_out") == F.col("comparison_out")).alias("same_output"))


def card_history(cards: DataFrame, chunk: Column) -> DataFrame:
    """Each observed agent card against the previous one of the same agent.

    ``cards``: agent_id, ts, ord, canonical_sha256, version, skills, kids
    (arrays), interfaces_sha256, schemes_sha256, capabilities_sha256.
    """
    state = F.struct("canonical_sha256", "version", "skills", "kids", "interfaces_sha256", "schemes_sha256",
                     "capabilities_sha256")
    c = prior(cards, ["agent_id"], ["ts", "ord"], {"p": ("last", state)}, chunk).filter("p IS NOT NULL")
    none = F.array().cast("array<string>")
    gained = lambda f: F.size(F.array_except(F.coalesce(f, none), F.coalesce(F.col(f"p.{f}"), none))) > 0
    lost = lambda f: F.size(F.array_except(F.coalesce(F.col(f"p.{f}"), none), F.coalesce(f, none))) > 0
    differs = lambda f: ~F.col(f).eqNullSafe(F.col(f"p.{f}"))
    rules = [
        ("a2a_card_content_changed_without_version_change", "critical",
         differs("canonical_sha256") & F.col("version").eqNullSafe(F.col("p.version"))),
        ("a2a_card_skill_expansion", "high", gained("skills")), ("a2a_card_skill_removed", "medium", lost("skills")),
        ("a2a_card_interface_changed", "critical", differs("interfaces_sha256")),
        ("a2a_card_security_scheme_changed", "critical", differs("schemes_sha256")),
        ("a2a_card_capabilities_changed", "high", differs("capabilities_sha256")),
        ("a2a_card_signing_key_rotation", "medium", gained("kids")),
        ("a2a_card_signing_key_full_replacement", "high", (F.size("kids") > 0) & (F.size("p.kids") > 0)
         & ~F.arrays_overlap("kids", "p.kids")),
    ]
    hits = F.filter(F.array(*[F.when(cond, F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity")))
                              for t, s, cond in rules]), lambda x: x.isNotNull())
    return c.select("agent_id", "ord", F.explode(hits).alias("f")).select("f.type", "f.severity", "agent_id", "ord")


# Environments and the controls they must not share.
ENVIRONMENTS = ["lab", "staging", "production"]
SEPARATED_CONTROLS = ["spiffe_trust_domain", "metadata_dsn", "object_store_bucket", "kms_key_id", "oidc_audience"]


def environment_reuse(controls: DataFrame) -> DataFrame:
    """Control values used by more than one environment.  Rows: (system, environment, control, value)."""
    return (controls.filter(F.col("environment").isin(ENVIRONMENTS) & F.col("control").isin(SEPARATED_CONTROLS)
                            & present("value")).select("system", "control", "value", "environment").distinct()
            .groupBy("system", "control", "value").agg(F.array_join(F.array_sort(F.collect_set("environment")), ",")
                                                       .alias("environments"), F.count("*").alias("n"))
            .filter("n > 1").drop("n"))


def environment_gaps(environments: DataFrame, systems: DataFrame) -> DataFrame:
    """Missing environments and unsafe production settings.

    ``environments``: system, environment, allows_test_execution, default_egress.
    """
    wanted = systems.select("system", F.explode(F.lit(ENVIRONMENTS)).alias("environment"))
    missing = wanted.join(environments, ["system", "environment"], "left_anti").select(
        "system", F.lit("environment_missing").alias("type"), "environment")
    prod = environments.filter("environment = 'production'")
    absent_prod = missing.filter("environment = 'production'").select("system")
    return union_all([
        missing,
        prod.filter("allows_test_execution").select(
            "system", F.lit("production_allows_test_execution").alias("type"), "environment"),
        prod.filter("NOT (default_egress <=> 'deny')").select("system").union(absent_prod).select(
            "system", F.lit("production_egress_not_deny_by_default").alias("type"), F.lit("production").alias("environment")),
    ])


def provenance_integrity(artifacts: DataFrame, records: DataFrame, refs: DataFrame, relationships: DataFrame) -> DataFrame:
    """Dangling references, duplicate ids and paths, wrong case, self lineage.

    ``artifacts``: artifact_id, case_id, path.  ``records``: record_id, case_id.
    ``refs``: record_id, artifact_id.  ``relationships``: parent_artifact_id, child_artifact_id, case_id.
    """
    known = artifacts.select("artifact_id").distinct()
    ids = artifacts.select(F.col("artifact_id").alias("id")).unionByName(records.select(F.col("record_id").alias("id")))
    row = lambda df, kind, ident: df.select(F.lit(kind).alias("type"), F.col(ident).alias("id"))
    dup = lambda df, c: df.groupBy(c).agg(F.count("*").alias("n")).filter("n > 1")
    ends = relationships.select(F.explode(F.array("parent_artifact_id", "child_artifact_id")).alias("artifact_id"))
    cases = artifacts.select("case_id").distinct()
    return union_all([
        row(refs.join(known, "artifact_id", "left_anti"), "dangling_evidence_reference", "record_id"),
        row(ends.join(known, "artifact_id", "left_anti"), "dangling_lineage_reference", "artifact_id"),
        row(relationships.filter("parent_artifact_id = child_artifact_id"), "self_lineage", "child_artifact_id"),
        row(dup(ids, "id"), "duplicate_record_identifier", "id"),
        row(dup(artifacts, "path"), "duplicate_evidence_path", "path"),
        row(records.join(cases, "case_id", "left_anti"), "record_case_mismatch", "record_id"),
    ])


def logs_to_spans(logs: DataFrame, spans: DataFrame) -> DataFrame:
    """Log rows with the span they name by (trace, span); unlinked logs stay."""
    return logs.join(spans.select("trace_id", "span_id", "span_name"), ["trace_id", "span_id"], "left")
