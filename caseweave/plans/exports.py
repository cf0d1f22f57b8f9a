"""Export projections over findings and cases."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..runtime import checkpoint_dir, materialize
from ..schema import union_all
from ..sinks import exports as K
from .gates import ALL_SQL, TENANT_SQL, all_findings, tenant_findings
from .joins import bom
from .registry import domain, duck, query, table


@query("k1_k8_finding_lake", TENANT_SQL + " SELECT tenant_id, analyzer, type, severity, subject_id, event_id FROM ft")
def lake(spark, sf):
    path = f"{checkpoint_dir(spark)}/lake-{uuid.uuid4().hex}"
    f = tenant_findings(spark, sf)
    K.write_lake(f, path)
    return spark.read.schema(f.schema).parquet(path).select("tenant_id", "analyzer", "type", "severity", "subject_id", "event_id")


@query("k1_finding_files", ALL_SQL + """, x AS (SELECT *, coalesce(subject_id, '') AS s, coalesce(event_id, '') AS e FROM f)
SELECT 'json' AS fmt, analyzer, type, severity, s AS subject_id, e AS event_id FROM x UNION ALL SELECT 'csv', analyzer, type, severity, s, e FROM x
UNION ALL SELECT 'markdown', analyzer, type, severity, s, e FROM x""")
def files(spark, sf):
    """The findings written in each format, compressed, and read back; a missing cell is an empty one."""
    columns = ["analyzer", "type", "severity", "subject_id", "event_id"]
    f = materialize(all_findings(spark, sf).select(*columns))
    back = []
    for fmt in ("json", "csv", "markdown"):
        path = f"{checkpoint_dir(spark)}/findings-{fmt}-{uuid.uuid4().hex}"
        K.write_findings(f, path, fmt, codec="gzip")
        if fmt == "markdown":
            inner = F.substring(F.col("value"), F.lit(3), F.length("value") - 4)
            cells = F.split(F.replace(inner, F.lit("\\|"), F.lit("\x01")), r" \| ", -1)
            rows = spark.read.text(path).filter("value NOT LIKE '|---%' AND value <> '| analyzer | type | severity | subject_id | event_id |'").select(
                *[F.replace(cells[i], F.lit("\x01"), F.lit("|")).alias(c) for i, c in enumerate(columns)])
        else:
            rows = spark.read.schema(f.schema).option("header", True).format(fmt).load(path)
        back.append(rows.select(F.lit(fmt).alias("fmt"), "analyzer", "type", "severity",
                                *[F.coalesce(c, F.lit("")).alias(c) for c in ("subject_id", "event_id")]))
    return union_all(back)


@query("k2_process_activity", """SELECT CAST(o_orderkey AS VARCHAR) AS session_uid, epoch_ms(o_orderdate) AS time, greatest(o_totalprice, o_custkey::DOUBLE) AS max_relative_l2, o_custkey % 10 / 10.0::DOUBLE AS min_cosine FROM orders""")
def k2(spark, sf):
    depth = lambda rel, cos: F.create_map(F.lit(K.RELATIVE_L2), rel, F.lit(K.EXACT_COSINE), cos)
    key = F.col("o_custkey")
    a = table(spark, sf, "orders").select(
        F.lit("activation_attestation").alias("event_type"), F.col("o_orderkey").cast("string").alias("request_id"), F.col("o_orderdate").alias("ts"), F.lit(1).alias("pid"), F.lit("r").alias("model_revision"),
        F.lit("p").alias("prompt_sha256"), F.create_map(F.lit("8"), depth(F.col("o_totalprice"), key % 10 / 10), F.lit("16"), depth(key.cast("double"), F.lit(0.95))).alias("measurements"))
    t = K.ocsf_process_activity(a)
    return t.select(F.col("message_context.session_uid").alias("session_uid"), "time", F.col("unmapped.max_relative_l2").alias("max_relative_l2"),
                    F.col("unmapped.min_exact_activation_cosine").alias("min_cosine"))


def cases(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.concat(F.lit("case-"), "o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("title"), F.lit(None).cast("string").alias("summary"), F.when(F.col("o_custkey") % 2 == 0, "ann").alias("owner"),
                    F.element_at(F.lit(["OPEN", "CONTAINED", "CLOSED", "ARCHIVED"]), (F.col("o_custkey") % 4 + 1).cast("int")).alias("status"), F.element_at(F.lit(["low", "HIGH", "critical"]), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("severity"),
                    F.lit("T1").alias("tenant_id"), F.array(F.lit("x")).alias("tags"), F.col("o_orderdate").alias("created"))


@query("k3_incident_findings", """SELECT 'case-' || o_orderkey AS case_id, CASE WHEN o_custkey % 4 > 1 THEN 200503 ELSE 200502 END AS type_uid, epoch_ms(o_orderdate) AS time, (ARRAY[2, 4, 5])[o_orderkey % 3 + 1] AS severity_id,
 (ARRAY[1, 2, 5, 5])[o_custkey % 4 + 1] AS status_id, CASE WHEN o_custkey % 2 = 0 THEN 'ann' ELSE 'unassigned' END AS assignee FROM orders""")
def k3(spark, sf):
    t = K.splunk_hec(K.ocsf_incident(cases(spark, sf)), "collector", "cases")
    return t.select(F.col("fields.case_id").alias("case_id"), "event.type_uid", "event.time", "event.severity_id", "event.status_id", F.col("event.assignee.name").alias("assignee"))


@query("k4_finding_notes", ALL_SQL + " SELECT type AS abstract, severity, subject_id, event_id FROM f")
def k4(spark, sf):
    t = K.stix_notes(tenant_findings(spark, sf), F.lit("2024-01-01T00:00:00Z"), "incident")
    said = lambda field: F.get_json_object("content", f"$.{field}").alias(field)
    return t.select("abstract", F.col("labels")[1].alias("severity"), said("subject_id"), said("event_id"))


@query("k4_ecs_events", ALL_SQL + " SELECT 'alert' AS kind, type AS rule, analyzer AS domain, severity, subject_id, event_id FROM f")
def k4_ecs(spark, sf):
    t = K.ecs(tenant_findings(spark, sf), "cases")
    said = lambda field: F.get_json_object("message", f"$.{field}").alias(field)
    return t.select(F.col("`event.kind`").alias("kind"), F.col("`rule.name`").alias("rule"), "domain", F.col("`event.severity`").alias("severity"),
                    said("subject_id"), said("event_id"))


@query("k5_fleet_metrics", """SELECT 'node-' || s_suppkey AS node_id, CASE WHEN s_suppkey % 3 = 0 THEN 'STALE' ELSE 'NORMAL' END AS state FROM supplier""")
def k5(spark, sf):
    s = F.col("s_suppkey")
    v = table(spark, sf, "supplier").select(F.concat(F.lit("node-"), s).alias("node_id"), F.when(s % 3 == 0, "STALE").otherwise("NORMAL").alias("state"), (s % 3 == 0).alias("stale"), F.lit(1.0).alias("age_seconds"))
    return K.otel_fleet(v, F.lit(1), "fleet").select("metric.attributes.node_id", "metric.attributes.state")


@query("k6_case_graph", """WITH n(kind, x, type, value) AS (
SELECT 'artifact', CAST(p_partkey AS VARCHAR), 'uco-observable:ObservableObject', p_name FROM part
UNION ALL SELECT 'facet', CAST(p_partkey AS VARCHAR), 'uco-observable:ContentDataFacet', CAST(p_size AS VARCHAR) FROM part
UNION ALL SELECT 'sha256', CAST(p_partkey AS VARCHAR), 'uco-types:Hash', sha256(p_name) FROM part
UNION ALL SELECT 'relationship', l_partkey || '>' || l_suppkey, 'uco-core:Relationship', 'urn:node:' || substr(sha256('c1|artifact|' || l_suppkey), 1, 32) FROM lineitem)
SELECT 'urn:node:' || substr(sha256('c1|' || kind || '|' || x), 1, 32) AS id, type, value FROM n""")
def k6(spark, sf):
    a = table(spark, sf, "part").select(F.lit("c1").alias("case_id"), F.col("p_partkey").cast("string").alias("artifact_id"), F.sha2("p_name", 256).alias("sha256"), F.col("p_size").alias("size"), F.col("p_name").alias("path"))
    r = table(spark, sf, "lineitem").select(F.lit("c1").alias("case_id"), F.col("l_partkey").cast("string").alias("parent_artifact_id"), F.col("l_suppkey").cast("string").alias("child_artifact_id"))
    body = lambda path: F.get_json_object("body", path)
    value = F.coalesce(body("$.path"), body("$['uco-observable:sizeInBytes']"), body("$['uco-types:hashValue']"), body("$['uco-core:source'][0]['@id']"))
    return K.case_graph(a, r).select("id", "type", value.alias("value"))


@query("k7_cyclonedx_components", f"""SELECT component_id, '{{{{"type":"application","bom-ref":"' || component_id || '","name":"' || name || '","version":"' || version || '","hashes":[{{{{"alg":"SHA-256","content":"' || sha256 || '"}}}}],"properties":[{{{{"name":"kind","value":"' || kind || '"}}}}'
 || CASE WHEN source = 'hub' THEN ',{{{{"name":"source","value":"hub"}}}}' ELSE '' END || ']}}}}' AS component FROM ({duck(bom(0))})""".replace("{{", "{").replace("}}", "}"))
def k7(spark, sf):
    return K.cyclonedx_components(domain(spark, sf, bom(0)))
