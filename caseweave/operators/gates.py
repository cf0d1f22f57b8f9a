"""Rules, evidence sufficiency, control gates and closure over finding tables.

Missing evidence is unknown, never clean: an absent control is MISSING and an
empty requirement list follows the pack's own logic.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize
from ..schema import union_all
from .containment import SIGNED, classes_of, contained_classes, expand, representatives, signature

ANCHORS = (8, 4, 2, 1)  # lengths of the beginnings by which contained terms are looked up
# Evidence quality scale and the states that never satisfy a gate.
QUALITY = {"MISSING": 0, "PRESENT_UNVALIDATED": 1, "VALIDATED": 2, "CORRELATED": 3, "AUTHORITATIVE": 4,
           "CONFLICTING": -1, "STALE": -1, "INCOMPLETE": -1}
# Platform controls with kind and severity, drills, certification tests, readiness evidence.
PLATFORM_CONTROLS = [
    ("metadata_ha", "postgresql-ha", "critical"), ("immutable_storage", "immutable-storage", "critical"),
    ("kms", "kms-hsm", "critical"), ("user_identity", "user-identity", "critical"),
    ("service_identity", "service-identity", "critical"), ("collector_health", "collector-health", "critical"),
    ("provider_health", "provider-health", "critical"), ("clock", "clock-integrity", "critical"),
    ("backup_restore", "backup-restore", "critical"), ("transparency", "transparency", "high"),
    ("release_integrity", "release-integrity", "critical"), ("tenant_isolation", "tenant-isolation", "critical"),
    ("network_segmentation", "network-segmentation", "critical"), ("admission_policy", "admission-policy", "high"),
    ("analyst_audit", "analyst-audit", "high"), ("peer_review", "peer-review", "high"),
]
CHAOS_SCENARIOS = ["database_primary_loss", "collector_worker_loss", "provider_api_outage",
                   "object_store_transient_failure", "kms_unavailable", "identity_provider_outage", "clock_skew"]
UPGRADE_STEPS = ["pre_upgrade_backup_verified", "migration_applied", "post_upgrade_integrity_verified",
                 "rollback_tested", "rollback_integrity_verified"]
CERTIFICATION_TESTS = ["authentication", "pagination", "rate_limit_recovery", "time_window",
                       "schema_normalization", "evidence_gap_reporting", "negative_permission_case"]
READINESS_DAYS = {"enterprise_controls": 30, "platform_assurance": 1, "environment_separation": 30,
                  "chaos_validation": 90, "release_integrity": 30, "security_assurance": 365,
                  "upgrade_assurance": 180, "network_policy_validation": 30, "provider_certifications": 1,
                  "service_slo": 7, "production_scale_benchmark": 90}


EVERY = "*"  # stands for every case or principal


def quality_score(quality: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in QUALITY.items() for x in kv])
    return F.coalesce(mapping[quality], F.lit(-1))


def evaluate_rules(rules: DataFrame, signals: DataFrame) -> DataFrame:
    """Rules whose required signals all occur and whose alternatives occur at least once.

    ``rules``: rule_id, requires_signals, any_signals, requires_event_types,
    any_event_types (arrays).  ``signals``: case_id, kind (signal or
    event_type), name.  A rule meets the cases of its rarest required term, or, with
    alternatives only, those of its rarer group of alternatives; the other terms
    are checked on the pairs that are left.  Cases with very many signals are never
    gathered into one array.  Rules without conditions come once, with case_id ``*``.
    """
    item = ["kind", "name"]

    def named(required, kind):
        terms = F.coalesce(F.array_distinct(required), F.array().cast("array<string>"))
        return F.transform(terms, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))

    both = lambda prefix: F.concat(named(f"{prefix}_signals", "signal"), named(f"{prefix}_event_types", "event_type"))
    known = materialize(rules.select(F.col("rule_id").alias("id"), both("requires").alias("needed"), both("any").alias("choices")))
    # Cases that hold the same of the rules' terms, and rules with equal terms, are evaluated once.
    terms = known.select(F.explode(F.concat("needed", "choices")).alias("e")).select("e.*").distinct()
    held = materialize(signals.select(F.col("case_id").alias("owner"), "kind", "name").distinct().join(terms, item, "left_semi"))
    owners = classes_of(signature(held, ["owner"], item), "owner", SIGNED)
    ids = classes_of(known.select("id", F.sort_array("needed").alias("needed"), F.sort_array("choices").alias("choices")), "id", ["needed", "choices"])
    every, known = known, materialize(representatives(known, "id", ids))
    held = materialize(representatives(held, "owner", owners))
    needed = known.select("id", F.explode("needed").alias("e")).select("id", "e.*")
    pairs = contained_classes(held, needed, item)

    # Rules with alternatives only: each pair shares a term of the group that fewer cases have.
    choices = known.select("id", F.explode("choices").alias("e"), F.array_contains("needed", F.col("e")).alias("also"),
                           (F.size("needed") == 0).alias("free")).select("id", "e.*", "also", "free")
    common = held.groupBy(*item).agg(F.count("*").alias("owners"))
    group = (choices.filter("free").join(common, item, "left").groupBy("id", "kind")
             .agg(F.coalesce(F.sum("owners"), F.lit(0)).alias("owners")))
    rarer = group.groupBy("id").agg(F.min_by("kind", F.struct("owners", "kind")).alias("kind"))
    loose = held.join(choices.filter("free").join(rarer, ["id", "kind"]), item).select("owner", "id").distinct()

    size = lambda column, kind: F.size(F.filter(column, lambda x: x["kind"] == kind)).cast("long")
    counts = known.select("id", *[size(c, k).alias(f"{c}_{k}") for c in ("needed", "choices") for k in ("signal", "event_type")])
    sized = pairs.unionByName(loose).join(counts, "id")
    plain = sized.filter("choices_signal + choices_event_type = 0").select(
        "owner", "id", F.col("needed_signal").alias("matched_signals"), F.col("needed_event_type").alias("matched_event_types"))
    # What a pair's alternatives hit; those that are required as well are counted there.
    hit = lambda kind: F.count_if(F.col("kind") == kind)
    extra = lambda kind: F.count_if((F.col("kind") == kind) & ~F.col("also"))
    chosen = (sized.filter("choices_signal + choices_event_type > 0").join(choices, "id").join(held, ["owner", *item])
              .groupBy("owner", "id", *[c for c in counts.columns if c != "id"])
              .agg(hit("signal").alias("hs"), hit("event_type").alias("he"), extra("signal").alias("xs"), extra("event_type").alias("xe"))
              .filter("(choices_signal = 0 OR hs > 0) AND (choices_event_type = 0 OR he > 0)")
              .select("owner", "id", (F.col("needed_signal") + F.col("xs")).alias("matched_signals"),
                      (F.col("needed_event_type") + F.col("xe")).alias("matched_event_types")))
    # A rule without any condition holds for every case: one row, not one per case.
    none = F.lit(0).cast("long")
    always = every.filter(F.size("needed") + F.size("choices") == 0).select(
        F.lit(EVERY).alias("owner"), "id", none.alias("matched_signals"), none.alias("matched_event_types"))
    found = expand(plain.unionByName(chosen), [("id", ids), ("owner", owners)])
    return found.unionByName(always).withColumnsRenamed({"owner": "case_id", "id": "rule_id"})


def attach_packs(rule_signals: DataFrame, signals: DataFrame) -> DataFrame:
    """Evidence packs per case from the signals seen.  ``rule_signals``: signal, pack_id."""
    return (signals.select("case_id", F.col("name").alias("signal")).distinct()
            .join(rule_signals.select("signal", "pack_id").distinct(), "signal")
            .select("case_id", "pack_id").distinct())


def _grams(text: Column) -> Column:
    """All distinct pieces of a text of the lengths that ``_anchor`` uses."""
    def cut(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
        return F.when(F.length(text) >= n, every).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(F.array(F.lit("")), *map(cut, ANCHORS)))


def _anchor(term: Column) -> Column:
    """The longest beginning of a term that has one of the anchor lengths."""
    return F.coalesce(*[F.when(F.length(term) >= n, F.substring(term, 1, n)) for n in ANCHORS], F.lit(""))


def contained(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``(text, term)`` where the text contains the term: an equi join on the term's anchor, then verified."""
    pieces = texts.select("text").distinct().withColumn("gram", F.explode(_grams(F.col("text"))))
    anchors = terms.select("term").distinct().withColumn("gram", _anchor(F.col("term")))
    return pieces.join(anchors, "gram").filter(F.contains("text", "term")).select("text", "term")


def resolve_packs(alerts: DataFrame, packs: DataFrame) -> DataFrame:
    """Weighted pack matches per alert, ranked.

    ``alerts``: alert_key, alert_id, alert_title, platform, incident_type,
    agent.  ``packs``: pack_id, alert_ids, alert_titles, platforms,
    incident_types, agents, detection_families (arrays).  Equal terms meet in
    one join on kind and term, contained ones through ``contained`` on distinct
    titles; only pairs that match somewhere are formed.  ``alert_key`` and
    ``pack_id`` name one alert and one pack; several rows of one name count as one.
    """
    norm = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    # kind of term, alert column, pack column, weight of an equal term
    kinds = [("id", F.col("alert_id"), F.col("alert_ids"), 100),
             ("title", norm(F.col("alert_title")), F.transform("alert_titles", norm), 80),
             ("platform", norm(F.col("platform")), F.transform("platforms", norm), 30),
             ("incident", norm(F.col("incident_type")), F.transform("incident_types", norm), 35),
             ("agent", norm(F.col("agent")), F.transform("agents", norm), 25)]
    said = alerts.select("alert_key", F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), own.alias("term"), F.lit(w).alias("weight")) for k, own, _, w in kinds])).alias("s"))
    said = said.select("alert_key", "s.*").filter("kind = 'id' OR term <> ''")
    empty = F.array().cast("array<string>")
    named = lambda k, terms: F.transform(F.coalesce(terms, empty), lambda x: F.struct(F.lit(k).alias("kind"), x.alias("term")))
    wanted = packs.select("pack_id", F.explode(F.concat(*[named(k, terms) for k, _, terms, _ in kinds])).alias("p"))
    wanted = wanted.select("pack_id", "p.*").distinct()
    equal = said.join(wanted, ["kind", "term"]).select("alert_key", "pack_id", "kind", "weight")

    titled = said.filter("kind = 'title'").select("alert_key", F.col("term").alias("text"))
    titles = wanted.filter("kind = 'title'").select("pack_id", "term")
    families = packs.select("pack_id", F.explode(F.transform("detection_families", norm)).alias("term"))
    longer = contained(titles.select(F.col("term").alias("text")), titled.select(F.col("text").alias("term")))
    found = union_all([
        contained(titled, titles).join(titles, "term").select("text", "pack_id", F.lit("title").alias("kind"), F.lit(50).alias("weight")),
        longer.select(F.col("text").alias("term"), F.col("term").alias("text")).join(titles, "term")
        .select("text", "pack_id", F.lit("title").alias("kind"), F.lit(50).alias("weight")),
        contained(titled, families).join(families, "term")
        .select("text", "pack_id", F.lit("family").alias("kind"), F.lit(20).alias("weight"))]).distinct()
    partly = titled.join(found, "text").select("alert_key", "pack_id", "kind", "weight")

    best = [F.coalesce(F.max(F.when(F.col("kind") == k, F.col("weight"))), F.lit(0)) for k in
            ("id", "title", "platform", "incident", "agent", "family")]
    s = equal.unionByName(partly).groupBy("alert_key", "pack_id").agg(reduce(add, best).alias("score"))
    w = Window.partitionBy("alert_key").orderBy(F.desc("score"), F.desc("pack_id"))
    return s.withColumn("rank", F.row_number().over(w))


def artifact_quality(artifacts: DataFrame, matches: DataFrame) -> DataFrame:
    """Best quality per artifact; conflicting, stale and incomplete matches never win by score.

    ``artifacts``: case_id, pack_id, artifact_id, priority.  ``matches``: case_id,
    pack_id, artifact_id, ord, validated, authoritative, corroborated, trusted,
    conflicting, stale, incomplete.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    quality = (F.when(flag("conflicting"), "CONFLICTING").when(flag("stale"), "STALE").when(flag("incomplete"), "INCOMPLETE")
               .when(flag("validated") & flag("trusted") & flag("authoritative"), "AUTHORITATIVE")
               .when(flag("validated") & flag("trusted") & flag("corroborated") & ~flag("authoritative"), "CORRELATED")
               .when(flag("validated"), "VALIDATED").otherwise("PRESENT_UNVALIDATED"))
    m = matches.withColumn("quality", quality).withColumn("q", quality_score(F.col("quality")))
    key = ["case_id", "pack_id", "artifact_id"]
    best = m.groupBy(*key).agg(
        F.max_by("quality", F.when(F.col("q") >= 0, F.struct("q", -F.col("ord")))).alias("good"),
        F.min_by("quality", "ord").alias("first"), F.count("*").alias("matches"))
    return artifacts.join(best, key, "left").select(
        *key, "priority", F.coalesce("good", "first", F.lit("MISSING")).alias("quality"),
        F.coalesce("matches", F.lit(0)).alias("matches"))


def satisfies(actual: Column, required: Column) -> Column:
    need = F.coalesce(F.create_map(*[F.lit(x) for kv in QUALITY.items() for x in kv])[required], F.lit(999))
    return ~actual.isin("CONFLICTING", "STALE", "INCOMPLETE") & (quality_score(actual) >= need)


def conclusion_gates(requirements: DataFrame, gates: DataFrame, quality: DataFrame) -> DataFrame:
    """Which conclusions the recorded evidence quality supports.

    ``gates``: pack_id, gate_id, logic (any or all).  ``requirements``: pack_id,
    gate_id, requirement, candidate (the artifact or an alias), required_quality.
    A gate that requires nothing is supported under ``all``.
    """
    # Cases of a pack with equal qualities, and its gates with equal logic and
    # requirements, are judged once; their members come in at the end.
    pack = ["pack_id"]
    quality = materialize(quality.select("case_id", "pack_id", F.col("artifact_id").alias("candidate"), "quality").distinct())
    cases = classes_of(signature(quality, ["pack_id", "case_id"], ["candidate", "quality"]), "case_id", pack + SIGNED, keep=pack)
    asked = materialize(requirements.select("pack_id", "gate_id", "requirement", "candidate", "required_quality").distinct())
    signed = signature(asked, ["pack_id", "gate_id"], ["requirement", "candidate", "required_quality"])
    defined = gates.select("pack_id", "gate_id", "logic").join(signed, ["pack_id", "gate_id"], "left")
    gates = classes_of(defined, "gate_id", ["pack_id", "logic", *SIGNED], keep=["pack_id", "logic"])
    one = lambda members, name, *more: members.select("pack_id", F.col("cls").alias(name), *more).distinct()
    case, gate = one(cases, "case_id"), one(gates, "gate_id", "logic")
    # One row per candidate; a requirement is met when any candidate is good enough.
    j = case.join(asked.join(gate.select("pack_id", "gate_id").distinct(), ["pack_id", "gate_id"], "left_semi"), "pack_id").join(
        quality, ["case_id", "pack_id", "candidate"], "left")
    ok = F.col("quality").isNotNull() & satisfies(F.col("quality"), F.col("required_quality"))
    per_req = j.groupBy("case_id", "pack_id", "gate_id", "requirement").agg(
        F.bool_or(F.coalesce(ok, F.lit(False))).alias("met"),
        F.bool_or(F.coalesce(F.col("quality") != "MISSING", F.lit(False))).alias("seen"))
    per_gate = per_req.groupBy("case_id", "pack_id", "gate_id").agg(
        F.count_if("met").alias("hits"), F.count("*").alias("required"),
        F.count_if(~F.col("met") & F.col("seen")).alias("insufficient_quality"),
        F.count_if(~F.col("met") & ~F.col("seen")).alias("missing"))
    g = case.join(gate, "pack_id").join(per_gate, ["case_id", "pack_id", "gate_id"], "left").fillna(
        0, ["hits", "required", "insufficient_quality", "missing"])
    good = F.when(F.col("logic") == "any", F.col("hits") > 0).otherwise(F.col("hits") == F.col("required"))
    judged = g.select("case_id", "pack_id", "gate_id", "logic", F.when(good, "supported").otherwise("not_supported").alias("status"),
                      "missing", "insufficient_quality")
    return expand(judged, [("case_id", cases, pack), ("gate_id", gates, ["pack_id", "logic"])]).drop("logic")


def mandatory_coverage(quality: DataFrame, minimum: str = "VALIDATED") -> DataFrame:
    must = F.col("priority") == "mandatory"
    good = must & satisfies(F.col("quality"), F.lit(minimum))
    return quality.groupBy("case_id", "pack_id").agg(
        F.count_if(good).alias("qualified"), F.count_if(must).alias("total")).withColumn(
        "percent", F.round(F.when(F.col("total") > 0, 100.0 * F.col("qualified") / F.col("total")).otherwise(100.0), 1))


def confidence_level(signals: DataFrame) -> DataFrame:
    """Evidence confidence 0-4 and attribution per case from its signals (case_id, signal)."""
    has = lambda s: F.coalesce(F.bool_or(F.col("signal") == s), F.lit(False))
    g = signals.groupBy("case_id").agg(*[has(s).alias(s) for s in (
        "activation_divergence", "behavioral_anomaly", "checkpoint_tensor_changes", "unexpected_runtime_intervention",
        "repeated_low_rank_delta_signature", "signed_provenance_bundle_present", "timeline_correlation")])
    c = F.col
    artifact = c("checkpoint_tensor_changes") | c("unexpected_runtime_intervention")
    both = c("activation_divergence") & artifact
    level = (F.when(both & c("signed_provenance_bundle_present") & c("timeline_correlation"), 4).when(both, 3)
             .when(artifact, 2).when(c("activation_divergence") | c("behavioral_anomaly"), 1).otherwise(0))
    strong = level >= 3
    return g.select("case_id", level.alias("confidence_level"), F.when(
        strong & c("unexpected_runtime_intervention") & ~c("checkpoint_tensor_changes"), "runtime-only model-behavior intervention")
        .when(strong & c("repeated_low_rank_delta_signature"),
              "directional model-modification pattern consistent with low-dimensional editing")
        .otherwise("model-integrity anomaly").alias("finding"))


def case_severity(levels: DataFrame, executions: DataFrame) -> DataFrame:
    """Case severity from the confidence level, else from a containment result."""
    j = levels.join(executions, "case_id", "full_outer")
    lv = F.col("confidence_level")
    return j.select("case_id", F.when(lv.isNotNull(), F.coalesce(F.try_element_at(
        F.lit(["unknown", "low", "medium", "high", "critical"]), (lv + 1).cast("int")), F.lit("unknown")))
        .when(F.col("status").startswith("CONTAINED"), "high").otherwise("unknown").alias("severity"))


def peer_review(conclusions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Distinct independent approvals per conclusion: two for critical and high, else one."""
    valid = (reviews.filter(F.col("decision").isin("approve", "concur") & F.col("evidence_reviewed"))
             .join(conclusions.select("conclusion_id", "author"), "conclusion_id")
             .filter("NOT (reviewer <=> author)").select("conclusion_id", "reviewer").distinct()
             .groupBy("conclusion_id").agg(F.count("*").alias("n")))
    need = F.coalesce("required_independent_reviews",
                      F.when(F.col("severity").isin("critical", "high"), 2).otherwise(1)).cast("bigint")
    c = conclusions.join(valid, "conclusion_id", "left").withColumns({
        "required_reviews": need, "independent_approvals": F.coalesce("n", F.lit(0))})
    return c.select("conclusion_id", "severity", "required_reviews", "independent_approvals",
                    (F.col("independent_approvals") >= F.col("required_reviews")).alias("ready"))


def control_gate(required: DataFrame, evidence: DataFrame, now: Column, keys: list[str]) -> DataFrame:
    """State of each required control: HEALTHY, STALE, FAILED or MISSING.

    ``required``: keys, control, severity, max_age_hours.  ``evidence``: keys,
    control, passed, validated.
    """
    j = required.join(evidence.withColumn("_have", F.lit(True)), [*keys, "control"], "left")
    age = (F.unix_micros(now) - F.unix_micros("validated")) / 3.6e9
    fresh = F.coalesce(age <= F.col("max_age_hours"), F.lit(False))
    ok = F.coalesce("passed", F.lit(False))
    state = F.when(ok & fresh, "HEALTHY").when(ok, "STALE").when(F.col("_have"), "FAILED").otherwise("MISSING")
    return j.select(*keys, "control", "severity", state.alias("state"))


def overall_status(controls: DataFrame, keys: list[str]) -> DataFrame:
    bad = F.col("state") != "HEALTHY"
    return controls.groupBy(*keys).agg(
        F.when(F.bool_or(bad & (F.col("severity") == "critical")), "CRITICAL")
        .when(F.bool_or(bad & (F.col("severity") == "high")), "DEGRADED").otherwise("HEALTHY").alias("status"),
        F.count_if(~bad).alias("healthy"), F.count("*").alias("controls"))


def required_controls(subjects: DataFrame, controls: list[tuple]) -> DataFrame:
    """Expand subjects by a fixed control list [(control, severity, max_age_hours)]."""
    rows = F.array(*[F.struct(F.lit(c).alias("control"), F.lit(s).alias("severity"), F.lit(float(h)).alias("max_age_hours"))
                     for c, s, h in controls])
    return subjects.select("*", F.explode(rows).alias("__c")).select(*subjects.columns, "__c.*")


def certification(controls: DataFrame, versions: DataFrame) -> DataFrame:
    """Certified providers: all tests pass and are fresh, and the API version was tested.

    ``controls``: output of ``control_gate`` keyed by provider.  ``versions``:
    provider, api_version (expected), tested_versions (array).
    """
    g = controls.groupBy("provider").agg(
        F.count_if(F.col("state").isin("FAILED", "MISSING")).alias("failed"), F.count_if(F.col("state") == "STALE").alias("stale"))
    off = (F.col("api_version") != "") & (F.size("tested_versions") > 0) & ~F.array_contains("tested_versions", F.col("api_version"))
    return g.join(versions, "provider").select(
        "provider", "failed", "stale", F.coalesce(off, F.lit(False)).alias("version_mismatch"),
        ((F.col("failed") == 0) & (F.col("stale") == 0) & ~F.coalesce(off, F.lit(False))).alias("certified"))


def chaos_gate(results: DataFrame, policy: DataFrame, systems: DataFrame) -> DataFrame:
    """Drill results against recovery and data-loss limits; a drill not run fails."""
    need = systems.select("system", F.explode(F.lit(CHAOS_SCENARIOS)).alias("scenario"))
    j = need.join(results, ["system", "scenario"], "left").join(policy, "scenario", "left")
    within = lambda limit, value: F.col(limit).isNull() | F.coalesce(F.col(value) <= F.col(limit), F.lit(False))
    ok = (F.coalesce("passed", F.lit(False)) & within("max_recovery_seconds", "recovery_seconds")
          & within("max_data_loss_events", "data_loss_events"))
    return j.select("system", "scenario", ok.alias("pass"))


def security_gate(reports: DataFrame, now: Column, required_scope: list[str], max_age_days: int = 365,
                  max_critical: int = 0, max_high: int = 0) -> DataFrame:
    """Independent assessment metadata: assessor, freshness, unresolved findings, scope."""
    age = F.datediff(now, F.col("completed"))
    missing = F.array_except(F.lit(required_scope), F.coalesce("scope", F.array().cast("array<string>")))
    late = F.coalesce((F.unix_micros(now) - F.unix_micros("completed")) > max_age_days * 86_400_000_000, F.lit(True))
    rules = [("independent_assessor_missing", F.coalesce(F.col("independent_assessor") == "", F.lit(True))),
             ("security_assessment_stale", late),
             ("unresolved_critical_findings_exceed_policy", F.col("unresolved_critical") > max_critical),
             ("unresolved_high_findings_exceed_policy", F.col("unresolved_high") > max_high),
             ("security_assessment_scope_missing", F.size(missing) > 0)]
    hits = F.filter(F.array(*[F.when(c, F.lit(t)) for t, c in rules]), lambda x: x.isNotNull())
    return reports.select("system", F.explode(hits).alias("type"))


def closure(cases: DataFrame, blockers: list[tuple[str, DataFrame]], warnings: list[tuple[str, DataFrame]]) -> DataFrame:
    """Closure readiness: no case may close while any domain blocks it.

    Each blocker or warning is (type, DataFrame with case_id and n).
    """
    def tagged(parts, level):
        return [df.select("case_id", F.lit(t).alias("type"), F.lit(level).alias("level"), F.col("n").cast("bigint").alias("n"))
                for t, df in parts]

    issues = union_all(tagged(blockers, "blocker") + tagged(warnings, "warning")).filter("n > 0")
    g = issues.groupBy("case_id").agg(
        F.count_if(F.col("level") == "blocker").alias("blockers"), F.count_if(F.col("level") == "warning").alias("warnings"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("level") == "blocker", F.col("type")))), ",").alias("blocker_types"))
    return cases.select("case_id").join(g, "case_id", "left").select(
        "case_id", (F.coalesce("blockers", F.lit(0)) == 0).alias("ready"), F.coalesce("blockers", F.lit(0)).alias("blockers"),
        F.coalesce("warnings", F.lit(0)).alias("warnings"), F.coalesce("blocker_types", F.lit("")).alias("blocker_types"))


def evidence_tasks(quality: DataFrame, existing: DataFrame) -> DataFrame:
    """New collection tasks for artifacts that are missing or not validated."""
    good = F.col("quality").isin("VALIDATED", "CORRELATED", "AUTHORITATIVE")
    key = ["case_id", "pack_id", "artifact_id"]
    return (quality.filter(~good).join(existing.select(*key).distinct(), key, "left_anti").select(
        *key, "priority", F.when(F.col("quality") == "MISSING", "REQUESTED").otherwise("VALIDATION_REQUIRED").alias("status"),
        F.concat(F.lit("TASK-"), F.substring(F.sha2(F.concat_ws("|", *key), 256), 1, 32)).alias("task_id")))
