"""Rules, packs, evidence gates, controls and closure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access as AC
from ..operators import authority as A
from ..operators import gates as G
from ..operators import joins as J
from ..operators import rollups as R
from .domains import base_events
from ..schema import union_all
from .registry import FINDING_QUERIES, ORACLE, QUERIES, domain, duck, query, table


# J16, J17 -----------------------------------------------------------------
def rules(d):
    s = lambda x: f"'sig' || CAST({x} AS STRING)"
    return f"""SELECT 'rule-' || CAST(p_partkey AS STRING) AS rule_id,
      CASE WHEN p_partkey % 17 = 0 THEN {d.arr()} ELSE {d.arr(s('p_partkey * 11 % 3000'), s('(p_size * 17 + p_partkey) % 3000'))} END AS requires_signals,
      CASE WHEN p_partkey % 3 = 0 THEN {d.arr(s('p_partkey % 3000'), s('(p_partkey + 1) % 3000'))} ELSE {d.arr()} END AS any_signals,
      CASE WHEN p_partkey % 4 = 0 THEN {d.arr("'et' || CAST(p_size % 6 AS STRING)")} ELSE {d.arr()} END AS requires_event_types,
      CASE WHEN p_partkey % 5 = 0 THEN {d.arr("'et1'", "'et2'")} ELSE {d.arr()} END AS any_event_types FROM {{part}}"""


def case_signals(d):
    return """SELECT 'case-' || CAST(l_suppkey AS STRING) AS case_id, CASE WHEN l_linenumber % 2 = 0 THEN 'signal' ELSE 'event_type' END AS kind,
      CASE WHEN l_linenumber % 2 = 0 THEN 'sig' || CAST((l_partkey * 7 + l_suppkey * 13) % 3000 AS STRING) ELSE 'et' || CAST(l_partkey * 3 % 80 AS STRING) END AS name FROM {lineitem}"""


@query("j16_rule_evaluation", f"""WITH r AS ({duck(rules)}), s AS (SELECT DISTINCT * FROM ({duck(case_signals)})),
c AS (SELECT case_id, coalesce(list(name) FILTER (kind = 'signal'), []) AS sg, coalesce(list(name) FILTER (kind = 'event_type'), []) AS et FROM s GROUP BY 1)
SELECT case_id, rule_id, len(list_intersect(sg, list_distinct(list_concat(requires_signals, any_signals)))) AS matched_signals, len(list_intersect(et, list_distinct(list_concat(requires_event_types, any_event_types)))) AS matched_event_types
FROM c, r WHERE len(list_concat(requires_signals, any_signals, requires_event_types, any_event_types)) > 0 AND list_has_all(sg, requires_signals) AND (len(any_signals) = 0 OR list_has_any(sg, any_signals)) AND list_has_all(et, requires_event_types) AND (len(any_event_types) = 0 OR list_has_any(et, any_event_types))
UNION ALL SELECT '*', rule_id, 0, 0 FROM r WHERE len(list_concat(requires_signals, any_signals, requires_event_types, any_event_types)) = 0""")
def j16(spark, sf):
    return G.evaluate_rules(domain(spark, sf, rules), domain(spark, sf, case_signals))


@query("j17_pack_attachment", f"""WITH s AS (SELECT DISTINCT case_id, name FROM ({duck(case_signals)})), p AS (SELECT DISTINCT 'sig' || (n_nationkey % 9) AS signal, 'pack-' || n_regionkey AS pack_id FROM nation)
SELECT DISTINCT case_id, pack_id FROM s JOIN p ON name = signal""")
def j17(spark, sf):
    p = table(spark, sf, "nation").select(F.concat(F.lit("sig"), F.col("n_nationkey") % 9).alias("signal"), F.concat(F.lit("pack-"), "n_regionkey").alias("pack_id"))
    return G.attach_packs(p, domain(spark, sf, case_signals))


# J18 ----------------------------------------------------------------------
def packs(d):
    return f"""SELECT 'pack-' || CAST(n_nationkey AS STRING) AS pack_id, {d.arr("'a' || CAST(n_nationkey AS STRING)")} AS alert_ids, {d.arr("'Alert ' || n_name")} AS alert_titles,
      {d.arr("'Plat' || CAST(n_regionkey AS STRING)")} AS platforms, {d.arr("'inc' || CAST(n_nationkey % 4 AS STRING)")} AS incident_types, {d.arr("'agent' || CAST(n_nationkey % 3 AS STRING)")} AS agents,
      {d.arr("'fam' || CAST(n_nationkey % 6 AS STRING)")} AS detection_families FROM {{nation}}"""


def alerts(d):
    return """SELECT CAST(c_custkey AS STRING) AS alert_key, 'a' || CAST(c_custkey % 60 AS STRING) AS alert_id,
      CASE WHEN c_custkey % 3 = 0 THEN 'alert ' || lower(n_name) WHEN c_custkey % 3 = 1 THEN 'Big Alert ' || n_name || ' fam' || CAST(c_custkey % 10 AS STRING) END AS alert_title,
      CASE WHEN c_custkey % 2 = 0 THEN 'plat' || CAST(c_custkey % 7 AS STRING) END AS platform, CASE WHEN c_custkey % 5 = 0 THEN 'INC' || CAST(c_custkey % 6 AS STRING) END AS incident_type,
      CASE WHEN c_custkey % 7 = 0 THEN 'agent1' END AS agent FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""


@query("j18_pack_resolution", f"""WITH p AS ({duck(packs)}), a AS (SELECT *, lower(trim(coalesce(alert_title, ''))) AS t FROM ({duck(alerts)})),
s AS (SELECT alert_key, pack_id, CASE WHEN alert_ids[1] = alert_id THEN 100 ELSE 0 END
 + CASE WHEN t = '' THEN 0 WHEN t = lower(alert_titles[1]) THEN 80 WHEN contains(t, lower(alert_titles[1])) OR contains(lower(alert_titles[1]), t) THEN 50 ELSE 0 END
 + CASE WHEN lower(platforms[1]) = platform THEN 30 ELSE 0 END + CASE WHEN lower(incident_type) = incident_types[1] THEN 35 ELSE 0 END
 + CASE WHEN agent = agents[1] THEN 25 ELSE 0 END + CASE WHEN t <> '' AND contains(t, detection_families[1]) THEN 20 ELSE 0 END AS score FROM a, p)
SELECT alert_key, pack_id, score, row_number() OVER (PARTITION BY alert_key ORDER BY score DESC, pack_id DESC) AS rank FROM s WHERE score > 0""")
def j18(spark, sf):
    return G.resolve_packs(domain(spark, sf, alerts), domain(spark, sf, packs))


# G18, G19, V4 --------------------------------------------------------------
def artifacts(d):
    return """SELECT 'case-' || CAST(s_suppkey AS STRING) AS case_id, 'pack-' || CAST(s_suppkey % 300 AS STRING) AS pack_id, 'art-' || CAST(n_nationkey AS STRING) AS artifact_id,
      CASE n_nationkey % 3 WHEN 0 THEN 'mandatory' WHEN 1 THEN 'conditional' ELSE 'optional' END AS priority FROM {supplier} JOIN {nation} ON s_suppkey % 5 = n_regionkey"""


def matches(d):
    return """SELECT 'case-' || CAST(l_suppkey AS STRING) AS case_id, 'pack-' || CAST(l_suppkey % 300 AS STRING) AS pack_id, 'art-' || CAST(l_partkey % 500 AS STRING) AS artifact_id,
      l_orderkey * 10000 + l_partkey AS ord, (l_quantity > 20) AS validated, (l_discount > 0.08) AS authoritative, (l_discount < 0.02) AS corroborated, (l_tax > 0.02) AS trusted,
      (l_tax > 0.077) AS conflicting, (l_quantity = 3) AS stale, (l_quantity = 4) AS incomplete FROM {lineitem}"""


QUALITY_SQL = f"""WITH a AS ({duck(artifacts)}), m AS (SELECT *, CASE WHEN conflicting THEN 'CONFLICTING' WHEN stale THEN 'STALE' WHEN incomplete THEN 'INCOMPLETE' WHEN validated AND trusted AND authoritative THEN 'AUTHORITATIVE'
  WHEN validated AND trusted AND corroborated THEN 'CORRELATED' WHEN validated THEN 'VALIDATED' ELSE 'PRESENT_UNVALIDATED' END AS quality FROM ({duck(matches)})),
k AS (SELECT *, CASE quality WHEN 'AUTHORITATIVE' THEN 4 WHEN 'CORRELATED' THEN 3 WHEN 'VALIDATED' THEN 2 WHEN 'PRESENT_UNVALIDATED' THEN 1 ELSE -1 END AS qs FROM m),
b AS (SELECT case_id, pack_id, artifact_id, arg_max(quality, (qs, -ord)) FILTER (qs >= 0) AS good, arg_min(quality, ord) AS frst, count(*) AS matches FROM k GROUP BY 1, 2, 3),
q AS (SELECT a.case_id, a.pack_id, a.artifact_id, priority, coalesce(good, frst, 'MISSING') AS quality, coalesce(matches, 0) AS matches FROM a LEFT JOIN b USING (case_id, pack_id, artifact_id)),
qq AS (SELECT *, CASE quality WHEN 'AUTHORITATIVE' THEN 4 WHEN 'CORRELATED' THEN 3 WHEN 'VALIDATED' THEN 2 WHEN 'PRESENT_UNVALIDATED' THEN 1 WHEN 'MISSING' THEN 0 ELSE -1 END AS qs FROM q)"""


def _quality(spark, sf):
    return G.artifact_quality(domain(spark, sf, artifacts), domain(spark, sf, matches))


@query("g18_artifact_quality", QUALITY_SQL + " SELECT * FROM q")
def g18(spark, sf):
    return _quality(spark, sf)


@query("g19_mandatory_coverage", QUALITY_SQL + """ SELECT case_id, pack_id, count(*) FILTER (priority = 'mandatory' AND qs >= 2) AS qualified, count(*) FILTER (priority = 'mandatory') AS total,
 CASE WHEN count(*) FILTER (priority = 'mandatory') = 0 THEN 100.0 ELSE round(100.0 * count(*) FILTER (priority = 'mandatory' AND qs >= 2) / count(*) FILTER (priority = 'mandatory'), 1) END AS percent FROM qq GROUP BY 1, 2""")
def g19_mandatory(spark, sf):
    return G.mandatory_coverage(_quality(spark, sf))


def gate_defs(d):
    return """SELECT 'pack-' || CAST(p_partkey % 300 AS STRING) AS pack_id, 'gate-' || CAST(p_partkey AS STRING) AS gate_id, CASE WHEN p_partkey % 2 = 0 THEN 'any' ELSE 'all' END AS logic FROM {part}"""


def gate_reqs(d):
    # Two candidates per requirement: the artifact itself and one alias.
    one = lambda alias: f"""SELECT 'pack-' || CAST(p_partkey % 300 AS STRING) AS pack_id, 'gate-' || CAST(p_partkey AS STRING) AS gate_id, 'art-' || CAST(n_nationkey AS STRING) AS requirement,
      'art-' || CAST((n_nationkey + {alias}) % 25 AS STRING) AS candidate, CASE WHEN p_partkey % 5 = 0 THEN 'CORRELATED' WHEN p_partkey % 5 = 1 THEN 'PRESENT_UNVALIDATED' ELSE 'VALIDATED' END AS required_quality
      FROM {{part}} JOIN {{nation}} ON n_nationkey % 10 = p_partkey % 10 WHERE p_partkey % 9 <> 4"""
    return f"{one(0)} UNION ALL {one(1)}"


@query("g19_conclusion_gates", QUALITY_SQL + f""", g AS ({duck(gate_defs)}), rq AS ({duck(gate_reqs)}), cs AS (SELECT DISTINCT case_id, pack_id FROM q),
pr AS (SELECT cs.case_id, cs.pack_id, gate_id, requirement, bool_or(coalesce(qs >= CASE required_quality WHEN 'CORRELATED' THEN 3 WHEN 'VALIDATED' THEN 2 ELSE 1 END, false)) AS met, bool_or(coalesce(quality <> 'MISSING', false)) AS seen
  FROM cs JOIN rq USING (pack_id) LEFT JOIN qq ON qq.case_id = cs.case_id AND qq.pack_id = cs.pack_id AND qq.artifact_id = candidate GROUP BY ALL),
pg AS (SELECT case_id, pack_id, gate_id, count(*) FILTER (met) AS hits, count(*) AS req, count(*) FILTER (NOT met AND seen) AS low, count(*) FILTER (NOT met AND NOT seen) AS mis FROM pr GROUP BY 1, 2, 3)
SELECT cs.case_id, cs.pack_id, g.gate_id, CASE WHEN (logic = 'any' AND coalesce(hits, 0) > 0) OR (logic = 'all' AND coalesce(hits, 0) = coalesce(req, 0)) THEN 'supported' ELSE 'not_supported' END AS status,
  coalesce(mis, 0) AS missing, coalesce(low, 0) AS insufficient_quality FROM cs JOIN g USING (pack_id) LEFT JOIN pg ON pg.case_id = cs.case_id AND pg.pack_id = cs.pack_id AND pg.gate_id = g.gate_id""")
def g19_gates(spark, sf):
    return G.conclusion_gates(domain(spark, sf, gate_reqs), domain(spark, sf, gate_defs), _quality(spark, sf))


@query("v4_evidence_tasks", QUALITY_SQL + """ SELECT case_id, pack_id, artifact_id, priority, CASE WHEN quality = 'MISSING' THEN 'REQUESTED' ELSE 'VALIDATION_REQUIRED' END AS status,
 'TASK-' || substr(sha256(case_id || '|' || pack_id || '|' || artifact_id), 1, 32) AS task_id FROM qq WHERE qs < 2 AND artifact_id <> 'art-3'""")
def v4(spark, sf):
    existing = domain(spark, sf, artifacts).filter("artifact_id = 'art-3'")
    return G.evidence_tasks(_quality(spark, sf), existing)


# G21, G38 -----------------------------------------------------------------
def evidence_signals(d):
    names = ["activation_divergence", "behavioral_anomaly", "checkpoint_tensor_changes", "unexpected_runtime_intervention",
             "repeated_low_rank_delta_signature", "signed_provenance_bundle_present", "timeline_correlation", "other"]
    case = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"SELECT 'case-' || CAST(o_custkey AS STRING) AS case_id, CASE o_orderkey % 8 {case} END AS signal FROM {{orders}}"


CONF_SQL = f"""WITH s AS ({duck(evidence_signals)}), g AS (SELECT case_id, bool_or(signal = 'activation_divergence') AS ad, bool_or(signal = 'behavioral_anomaly') AS ba, bool_or(signal = 'checkpoint_tensor_changes') AS ct,
 bool_or(signal = 'unexpected_runtime_intervention') AS ri, bool_or(signal = 'repeated_low_rank_delta_signature') AS lr, bool_or(signal = 'signed_provenance_bundle_present') AS pv, bool_or(signal = 'timeline_correlation') AS tc FROM s GROUP BY 1),
l AS (SELECT *, CASE WHEN ad AND (ct OR ri) AND pv AND tc THEN 4 WHEN ad AND (ct OR ri) THEN 3 WHEN ct OR ri THEN 2 WHEN ad OR ba THEN 1 ELSE 0 END AS confidence_level FROM g)"""


@query("g21_confidence_level", CONF_SQL + """ SELECT case_id, confidence_level, CASE WHEN confidence_level >= 3 AND ri AND NOT ct THEN 'runtime-only model-behavior intervention'
 WHEN confidence_level >= 3 AND lr THEN 'directional model-modification pattern consistent with low-dimensional editing' ELSE 'model-integrity anomaly' END AS finding FROM l""")
def g21(spark, sf):
    return G.confidence_level(domain(spark, sf, evidence_signals))


@query("g38_case_severity", CONF_SQL + """, x AS (SELECT 'case-' || c_custkey AS case_id, CASE WHEN c_custkey % 2 = 0 THEN 'CONTAINED_OK' ELSE 'FAILED' END AS status FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(l.case_id, x.case_id) AS case_id, CASE WHEN confidence_level IS NOT NULL THEN (['unknown', 'low', 'medium', 'high', 'critical'])[confidence_level + 1] WHEN status = 'CONTAINED_OK' THEN 'high' ELSE 'unknown' END AS severity
FROM l FULL JOIN x ON l.case_id = x.case_id""")
def g38(spark, sf):
    ex = table(spark, sf, "customer").filter("c_custkey % 3 = 0").select(
        F.concat(F.lit("case-"), "c_custkey").alias("case_id"), F.when(F.col("c_custkey") % 2 == 0, "CONTAINED_OK").otherwise("FAILED").alias("status"))
    return G.case_severity(G.confidence_level(domain(spark, sf, evidence_signals)), ex)


# G24 ----------------------------------------------------------------------
def conclusions(d):
    return """SELECT CAST(o_orderkey AS STRING) AS conclusion_id, CASE o_orderstatus WHEN 'F' THEN 'critical' WHEN 'O' THEN 'high' ELSE 'low' END AS severity, 'r' || CAST(o_custkey % 5 AS STRING) AS author,
      CASE WHEN o_orderkey % 10 = 0 THEN 3 END AS required_independent_reviews FROM {orders}"""


def reviews(d):
    return """SELECT CAST(l_orderkey AS STRING) AS conclusion_id, 'r' || CAST(l_suppkey % 5 AS STRING) AS reviewer, CASE l_returnflag WHEN 'A' THEN 'approve' WHEN 'N' THEN 'concur' ELSE 'reject' END AS decision,
      (l_quantity > 10) AS evidence_reviewed FROM {lineitem}"""


@query("g24_peer_review", f"""WITH c AS ({duck(conclusions)}), r AS ({duck(reviews)}), v AS (SELECT conclusion_id, count(DISTINCT reviewer) AS n FROM r JOIN c USING (conclusion_id) WHERE decision <> 'reject' AND evidence_reviewed AND reviewer <> author GROUP BY 1)
SELECT conclusion_id, severity, coalesce(required_independent_reviews, CASE WHEN severity = 'low' THEN 1 ELSE 2 END) AS required_reviews, coalesce(n, 0) AS independent_approvals,
 coalesce(n, 0) >= coalesce(required_independent_reviews, CASE WHEN severity = 'low' THEN 1 ELSE 2 END) AS ready FROM c LEFT JOIN v USING (conclusion_id)""")
def g24(spark, sf):
    return G.peer_review(domain(spark, sf, conclusions), domain(spark, sf, reviews))


# G25 - G27 ----------------------------------------------------------------
NOW = "2001-01-01 00:00:00"
_PLATFORM = [(c, s, 24.0 * 900) for c, _, s in G.PLATFORM_CONTROLS]


def control_evidence(d):
    names = " ".join(f"WHEN {i} THEN '{c}'" for i, (c, _, _) in enumerate(G.PLATFORM_CONTROLS))
    return f"""SELECT 'sys-' || CAST(o_custkey % 30 AS STRING) AS system, CASE CAST(floor(o_custkey / 30) AS BIGINT) % 17 {names} ELSE 'other' END AS control,
      o_orderkey, o_orderstatus, CAST(o_orderdate AS TIMESTAMP) AS validated FROM {{orders}}"""


CONTROL_SQL = f"""WITH e AS (SELECT system, control, arg_max(o_orderstatus <> 'P', (validated, o_orderkey)) AS passed, arg_max(validated, (validated, o_orderkey)) AS validated FROM ({duck(control_evidence)}) GROUP BY 1, 2),
r AS (SELECT * FROM (SELECT DISTINCT system FROM e) s, (VALUES {", ".join(f"('{c}', '{s}', {h})" for c, s, h in _PLATFORM)}) v(control, severity, max_age_hours)),
g AS (SELECT system, control, severity, CASE WHEN passed AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(validated) <= max_age_hours * 3600000000 THEN 'HEALTHY' WHEN passed THEN 'STALE' WHEN passed IS NOT NULL THEN 'FAILED' ELSE 'MISSING' END AS state FROM r LEFT JOIN e USING (system, control))"""


def _controls(spark, sf):
    from ..operators.windows import latest_state
    e = domain(spark, sf, control_evidence).withColumn("key", F.concat_ws("|", "system", "control"))
    latest = latest_state(e, "key", ["validated", "o_orderkey"]).select("system", "control", (F.col("o_orderstatus") != "P").alias("passed"), "validated")
    req = G.required_controls(e.select("system").distinct(), _PLATFORM)
    return G.control_gate(req, latest, F.lit(NOW).cast("timestamp"), ["system"])


@query("g25_platform_controls", CONTROL_SQL + " SELECT * FROM g")
def g25(spark, sf):
    return _controls(spark, sf)


@query("g25_platform_status", CONTROL_SQL + """ SELECT system, CASE WHEN bool_or(state <> 'HEALTHY' AND severity = 'critical') THEN 'CRITICAL' WHEN bool_or(state <> 'HEALTHY') THEN 'DEGRADED' ELSE 'HEALTHY' END AS status,
 count(*) FILTER (state = 'HEALTHY') AS healthy, count(*) AS controls FROM g GROUP BY 1""")
def g25_status(spark, sf):
    return G.overall_status(_controls(spark, sf), ["system"])


def test_receipts(d):
    names = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(G.CERTIFICATION_TESTS))
    return f"""SELECT 'prov-' || CAST(c_nationkey AS STRING) AS provider, CASE c_custkey % 8 {names} ELSE 'extra' END AS control, bool_and(c_acctbal > -950) AS passed,
      CAST(TIMESTAMP '2000-06-01 00:00:00' AS TIMESTAMP) AS validated, CAST(max(c_custkey % 3) AS STRING) AS api_version FROM {{customer}} WHERE c_nationkey % 7 <> 2 OR c_custkey % 8 <> 3 GROUP BY 1, 2"""


@query("g26_provider_certification", f"""WITH e AS ({duck(test_receipts)}), p AS (SELECT DISTINCT provider FROM e),
r AS (SELECT provider, control FROM p, (SELECT unnest([{", ".join(repr(t) for t in G.CERTIFICATION_TESTS)}]) AS control) t),
g AS (SELECT provider, count(*) FILTER (NOT coalesce(passed, false)) AS failed, count(*) FILTER (passed AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(validated) > 250::BIGINT * 86400000000) AS stale FROM r LEFT JOIN e USING (provider, control) GROUP BY 1),
v AS (SELECT provider, list_contains(list(DISTINCT api_version), '2') AS ok FROM e GROUP BY 1)
SELECT provider, failed, stale, NOT ok AS version_mismatch, failed = 0 AND stale = 0 AND ok AS certified FROM g JOIN v USING (provider)""")
def g26(spark, sf):
    e = domain(spark, sf, test_receipts)
    req = G.required_controls(e.select("provider").distinct(), [(t, "critical", 24.0 * 250) for t in G.CERTIFICATION_TESTS])
    versions = e.groupBy("provider").agg(F.collect_set("api_version").alias("tested_versions")).withColumn("api_version", F.lit("2"))
    return G.certification(G.control_gate(req, e, F.lit(NOW).cast("timestamp"), ["provider"]), versions)


def drills(d):
    names = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(G.CHAOS_SCENARIOS))
    return f"""SELECT 'sys-' || CAST(s_nationkey AS STRING) AS system, CASE s_suppkey % 7 {names} END AS scenario, bool_and(s_acctbal > 0) AS passed, CAST(max(s_suppkey) AS DOUBLE) AS recovery_seconds,
      CAST(min(s_suppkey % 4) AS BIGINT) AS data_loss_events FROM {{supplier}} GROUP BY 1, 2"""


@query("g27_chaos_gate", f"""WITH e AS ({duck(drills)}), s AS (SELECT DISTINCT system FROM e), n AS (SELECT system, scenario FROM s, (SELECT unnest([{", ".join(repr(t) for t in G.CHAOS_SCENARIOS)}]) AS scenario) x)
SELECT system, scenario, coalesce(passed, false) AND (scenario <> 'clock_skew' OR coalesce(recovery_seconds <= 60, false)) AND (scenario <> 'kms_unavailable' OR coalesce(data_loss_events <= 1, false)) AS pass FROM n LEFT JOIN e USING (system, scenario)""")
def g27_chaos(spark, sf):
    e = domain(spark, sf, drills)
    name = F.explode(F.lit(["clock_skew", "kms_unavailable"]))
    policy = table(spark, sf, "region").filter("r_regionkey = 0").select(name.alias("scenario")).select(
        "scenario", F.when(F.col("scenario") == "clock_skew", 60.0).alias("max_recovery_seconds"),
        F.when(F.col("scenario") == "kms_unavailable", 1).alias("max_data_loss_events"))
    return G.chaos_gate(e, policy, e.select("system").distinct())


def upgrades(d):
    names = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(G.UPGRADE_STEPS))
    return f"""SELECT 'sys-' || CAST(l_suppkey AS STRING) AS system, CASE l_linenumber {names} ELSE 'extra' END AS control, bool_and(l_quantity > 1) AS passed,
      CAST(max(l_shipdate) AS TIMESTAMP) AS validated FROM {{lineitem}} GROUP BY 1, 2"""


@query("g27_upgrade_gate", f"""WITH e AS ({duck(upgrades)}), n AS (SELECT system, control FROM (SELECT DISTINCT system FROM e) s, (SELECT unnest([{", ".join(repr(t) for t in G.UPGRADE_STEPS)}]) AS control) x)
SELECT system, control, 'critical' AS severity, CASE WHEN passed THEN 'HEALTHY' WHEN passed IS NOT NULL THEN 'FAILED' ELSE 'MISSING' END AS state FROM n LEFT JOIN e USING (system, control)""")
def g27_upgrade(spark, sf):
    e = domain(spark, sf, upgrades)
    req = G.required_controls(e.select("system").distinct(), [(t, "critical", 1e9) for t in G.UPGRADE_STEPS])
    return G.control_gate(req, e, F.lit(NOW).cast("timestamp"), ["system"])


def assessments(d):
    return f"""SELECT 'sys-' || CAST(c_custkey AS STRING) AS system, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'assessor' END AS independent_assessor,
      CAST({d.ts_add("TIMESTAMP '2000-12-31 00:00:00'", '-(c_custkey % 500)', 'DAY')} AS TIMESTAMP) AS completed, c_custkey % 3 - 1 AS unresolved_critical, CAST(floor(c_acctbal / 1000) AS INT) AS unresolved_high,
      CASE WHEN c_custkey % 4 = 0 THEN {d.arr("'api'")} ELSE {d.arr("'api'", "'storage'")} END AS scope FROM {{customer}}"""


@query("g27_security_gate", f"""WITH t AS ({duck(assessments)}) SELECT system, 'independent_assessor_missing' AS type FROM t WHERE independent_assessor IS NULL
UNION ALL SELECT system, 'security_assessment_stale' FROM t WHERE epoch_us(TIMESTAMP '{NOW}') - epoch_us(completed) > 365::BIGINT * 86400000000
UNION ALL SELECT system, 'unresolved_critical_findings_exceed_policy' FROM t WHERE unresolved_critical > 0 UNION ALL SELECT system, 'unresolved_high_findings_exceed_policy' FROM t WHERE unresolved_high > 5
UNION ALL SELECT system, 'security_assessment_scope_missing' FROM t WHERE len(scope) = 1""")
def g27_security(spark, sf):
    return G.security_gate(domain(spark, sf, assessments), F.lit(NOW).cast("timestamp"), ["api", "storage"], max_high=5)


@query("g27_readiness_gate", f"""WITH e AS (SELECT 'sys-' || (o_custkey % 40) AS system, CASE (o_custkey // 40) % 12 {" ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(G.READINESS_DAYS))} ELSE 'x' END AS control,
 bool_and(o_orderkey % 50 <> 0) AS passed, max(o_orderdate) AS validated FROM orders GROUP BY 1, 2),
n AS (SELECT * FROM (SELECT DISTINCT system FROM e) s, (VALUES {", ".join(f"('{c}', {d * 24 * 10}.0)" for c, d in G.READINESS_DAYS.items())}) v(control, h))
SELECT system, control, 'critical' AS severity, CASE WHEN passed AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(validated) <= h * 3600000000 THEN 'HEALTHY' WHEN passed THEN 'STALE' WHEN passed IS NOT NULL THEN 'FAILED' ELSE 'MISSING' END AS state FROM n LEFT JOIN e USING (system, control)""")
def g27_readiness(spark, sf):
    o = table(spark, sf, "orders")
    i = F.floor(F.col("o_custkey") / 40) % 12
    control = F.coalesce(*[F.when(i == n, F.lit(c)) for n, c in enumerate(G.READINESS_DAYS)], F.lit("x"))
    e = o.groupBy(F.concat(F.lit("sys-"), F.col("o_custkey") % 40).alias("system"), control.alias("control")).agg(
        F.bool_and(F.col("o_orderkey") % 50 != 0).alias("passed"), F.max("o_orderdate").cast("timestamp").alias("validated"))
    req = G.required_controls(e.select("system").distinct(), [(c, "critical", d * 24.0 * 10) for c, d in G.READINESS_DAYS.items()])
    return G.control_gate(req, e, F.lit(NOW).cast("timestamp"), ["system"])


# F26 ----------------------------------------------------------------------
def access_rows(d):
    return f"""SELECT CAST(o_orderkey AS STRING) AS request_id, {d.arr("'t' || CAST(o_custkey % 4 AS STRING)")} AS tenant_ids, 't' || CAST(o_orderkey % 4 AS STRING) AS tenant_id,
      CASE o_orderkey % 5 WHEN 0 THEN {d.arr("'collector'", "'reviewer'")} WHEN 1 THEN {d.arr("'platform_admin'")} WHEN 2 THEN {d.arr("'investigator'")} WHEN 3 THEN {d.arr("'nobody'")} ELSE {d.arr("'case_admin'")} END AS roles,
      CASE o_custkey % 3 WHEN 0 THEN 'case:read' WHEN 1 THEN 'evidence:create' ELSE 'evidence:hold' END AS action,
      CASE o_orderkey % 4 WHEN 0 THEN 'viewer' WHEN 1 THEN 'auditor' WHEN 2 THEN 'admin' ELSE 'ghost' END AS role, CASE o_custkey % 2 WHEN 0 THEN 'report.read' ELSE 'audit.read' END AS permission,
      CASE o_custkey % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'restricted' WHEN 2 THEN 'secret' ELSE 'odd' END AS classification FROM {{orders}}"""


@query("f26_tenant_access", f"""WITH t AS (SELECT *, tenant_ids[1] <> tenant_id AND roles[1] <> 'platform_admin' AS foreign_tenant, CASE roles[1] WHEN 'platform_admin' THEN true WHEN 'collector' THEN action IN ('evidence:create', 'case:read') WHEN 'investigator' THEN action = 'case:read' WHEN 'case_admin' THEN action IN ('case:read', 'evidence:hold') ELSE false END AS g FROM ({duck(access_rows)}))
SELECT request_id, NOT foreign_tenant AND g AS allowed, CASE WHEN foreign_tenant THEN 'cross_tenant_denied' WHEN g THEN 'role_allowed' ELSE 'role_denied' END AS reason FROM t""")
def f26_tenant(spark, sf):
    return AC.tenant_access(domain(spark, sf, access_rows))


@query("f26_role_access", f"""SELECT request_id, CASE role WHEN 'admin' THEN true WHEN 'viewer' THEN permission = 'report.read' WHEN 'auditor' THEN true ELSE false END AS allowed,
 CASE classification WHEN 'public' THEN role <> 'ghost' WHEN 'restricted' THEN role IN ('auditor', 'admin') WHEN 'secret' THEN role = 'admin' ELSE false END AS cleared FROM ({duck(access_rows)})""")
def f26_role(spark, sf):
    return AC.role_access(domain(spark, sf, access_rows))


# Findings of all detectors, G23, G28, G29, G36, U3, T5, T6 -------------------
# Every registered detector whose rows have the four finding columns.
ANALYZERS = ["f1_", "f2_", "f3_", "f5_", "f6_mcp", "f7_", "f8_", "f9_", "f10_", "f11_", "f12_", "f13_", "f14_render_requests",
             "f18_", "f19_", "f20_", "f21_", "f24_"]
_COLUMNS = ["type", "severity", "subject_id", "event_id"]


def _analyzers():
    """Registered queries with SQL of the families above, in name order."""
    return [n for n in sorted(QUERIES) if n in ORACLE and any(n.startswith(p) for p in ANALYZERS) and n in FINDING_QUERIES]


def all_findings(spark, sf):
    """One table of all detectors' findings; each detector keeps its own scan."""
    return union_all([QUERIES[n](spark, sf).select(F.lit(n).alias("analyzer"), *_COLUMNS) for n in _analyzers()])


def tenant_findings(spark, sf):
    """All findings with the tenant their event belongs to, and a detail."""
    event = F.coalesce("event_id", F.lit(""))
    return all_findings(spark, sf).withColumns({"tenant_id": F.concat(F.lit("T"), F.length(event) % 4), "detail": F.lit(None).cast("string")})


ALL_SQL = "WITH f AS (" + " UNION ALL ".join(f"SELECT '{n}' AS analyzer, {', '.join(_COLUMNS)} FROM ({ORACLE[n]}) x" for n in _analyzers()) + ")"


TENANT_SQL = ALL_SQL + ", ft AS (SELECT *, 'T' || length(coalesce(event_id, '')) % 4 AS tenant_id FROM f)"


@query("g36_finding_cube", TENANT_SQL + " SELECT analyzer, severity, tenant_id, count(*) AS n, CAST(grouping(analyzer, severity, tenant_id) AS BIGINT) AS level FROM ft GROUP BY CUBE (analyzer, severity, tenant_id)")
def g36(spark, sf):
    return R.finding_cube(tenant_findings(spark, sf)).withColumn("level", F.col("level").cast("bigint"))


@query("t6_finding_examples", ALL_SQL + """ SELECT analyzer, type, count(*) AS total, array_to_string(list(coalesce(event_id, subject_id) ORDER BY coalesce(event_id, subject_id))[1:20], ',') AS examples FROM f GROUP BY 1, 2""")
def t6(spark, sf):
    return R.capped_examples(all_findings(spark, sf).withColumn("example", F.coalesce("event_id", "subject_id")), ["analyzer", "type"], "example", 20).withColumn("examples", F.array_join("examples", ","))


@query("g36_analyzer_cube", ALL_SQL + " SELECT analyzer, severity, type, count(*) AS n, CAST(grouping(analyzer, severity, type) AS BIGINT) AS level FROM f GROUP BY CUBE (analyzer, severity, type)")
def g36_all(spark, sf):
    return R.finding_cube(all_findings(spark, sf), ["analyzer", "severity", "type"]).withColumn("level", F.col("level").cast("bigint"))


@query("g28_severity_counts", ALL_SQL + " SELECT severity, count(*) AS n FROM f GROUP BY 1")
def g28(spark, sf):
    return R.severity_counts(all_findings(spark, sf))


@query("u3_signal_union", ALL_SQL + " SELECT analyzer, type, severity, subject_id, event_id FROM f")
def u3(spark, sf):
    return all_findings(spark, sf)


@query("t5_worst_findings", ALL_SQL + """ SELECT type, analyzer, event_id, CASE severity WHEN 'critical' THEN 50 WHEN 'high' THEN 40 WHEN 'medium' THEN 30 WHEN 'low' THEN 20 ELSE 10 END AS severity_score FROM f
ORDER BY severity_score DESC, type, analyzer, event_id LIMIT 500""")
def t5(spark, sf):
    score = F.coalesce(*[F.when(F.col("severity") == s, n) for s, n in (("critical", 50), ("high", 40), ("medium", 30), ("low", 20))], F.lit(10))
    return (all_findings(spark, sf).withColumn("severity_score", score).orderBy(F.desc("severity_score"), "type", "analyzer", "event_id").limit(500)
            .select("type", "analyzer", "event_id", "severity_score"))


@query("g29_content_verdicts", """WITH f AS (SELECT CAST(l_orderkey AS VARCHAR) AS item_id, CASE WHEN l_quantity = 50 THEN 'CRITICAL' WHEN l_quantity > 45 THEN 'high' ELSE 'low' END AS severity FROM lineitem)
SELECT CAST(o_orderkey AS VARCHAR) AS item_id, CASE WHEN bool_or(severity = 'CRITICAL') THEN 'QUARANTINE' WHEN bool_or(severity = 'high') THEN 'REVIEW' ELSE 'PASS' END AS verdict, count(severity) AS findings
FROM orders LEFT JOIN f ON CAST(o_orderkey AS VARCHAR) = item_id GROUP BY 1""")
def g29(spark, sf):
    q = F.col("l_quantity")
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("item_id"), F.when(q == 50, "CRITICAL").when(q > 45, "high").otherwise("low").alias("severity"))
    return J.content_verdicts(f, table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("item_id")))


@query("g23_closure_readiness", QUALITY_SQL + f""", c AS (SELECT DISTINCT case_id FROM a),
b1 AS (SELECT case_id, count(*) FILTER (priority = 'mandatory' AND qs < 2) AS n FROM qq GROUP BY 1), b2 AS (SELECT case_id, count(*) FILTER (priority = 'mandatory' AND quality = 'CONFLICTING') AS n FROM q GROUP BY 1),
b3 AS (SELECT 'case-' || (user_id % 100) AS case_id, count(*) AS n FROM ({duck(base_events)}) WHERE event_type = 'consequence' AND k < 4 GROUP BY 1),
w1 AS (SELECT case_id, count(*) FILTER (priority = 'conditional' AND quality = 'MISSING') AS n FROM q GROUP BY 1),
i AS (SELECT case_id, 'mandatory_evidence_missing' AS type, 'b' AS l FROM b1 WHERE n > 0 UNION ALL SELECT case_id, 'conflicting_mandatory_evidence', 'b' FROM b2 WHERE n > 0 UNION ALL SELECT case_id, 'open_consequences', 'b' FROM b3
  UNION ALL SELECT case_id, 'unsupported_conclusions', 'w' FROM w1 WHERE n > 0)
SELECT c.case_id, count(*) FILTER (l = 'b') = 0 AS ready, count(*) FILTER (l = 'b') AS blockers, count(*) FILTER (l = 'w') AS warnings, coalesce(string_agg(CASE WHEN l = 'b' THEN type END, ',' ORDER BY type), '') AS blocker_types FROM c LEFT JOIN i ON c.case_id = i.case_id GROUP BY 1""")
def g23(spark, sf):
    q = _quality(spark, sf)
    must = F.col("priority") == "mandatory"
    good = G.satisfies(F.col("quality"), F.lit("VALIDATED"))
    per_case = lambda cond: q.groupBy("case_id").agg(F.count_if(cond).alias("n"))
    e = domain(spark, sf, base_events).filter("event_type = 'consequence' AND k < 4")
    opened = e.groupBy(F.concat(F.lit("case-"), F.col("user_id") % 100).alias("case_id")).agg(F.count("*").alias("n"))
    return G.closure(domain(spark, sf, artifacts).select("case_id").distinct(), [
        ("mandatory_evidence_missing", per_case(must & ~good)),
        ("conflicting_mandatory_evidence", per_case(must & (F.col("quality") == "CONFLICTING"))),
        ("open_consequences", opened)],
        [("unsupported_conclusions", per_case((F.col("priority") == "conditional") & (F.col("quality") == "MISSING")))])
