"""Source normalisers over JSON documents that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import integrity as I
from ..sources import agents as AG
from ..sources import cloud as C
from ..sources import files as FS
from ..sources import traces as TR
from ..sources import variants as V
from ..runtime import checkpoint_dir, materialize
from .domains import base_events
from .registry import domain, duck, query, table

BATCH = 20  # events per document


def events(spark, sf):
    return domain(spark, sf, base_events)


def batches(rows, item, prefix, suffix, key=None):
    """Documents of at most BATCH items: prefix + comma-separated items + suffix.  ``item`` is JSON text."""
    doc = key if key is not None else F.floor(F.col("ord") / BATCH)
    parts = rows.select(doc.cast("string").alias("source_id"), F.struct("ord", item.alias("j")).alias("x")).groupBy("source_id").agg(
        F.array_sort(F.collect_list("x")).alias("xs"))
    return parts.select("source_id", F.concat(F.lit(prefix), F.array_join(F.transform("xs", lambda x: x["j"]), ","), F.lit(suffix)).alias("raw"))


def js(**fields):
    return F.to_json(F.struct(*[v.alias(name) for name, v in fields.items()]))


E_SQL = f"WITH e AS ({duck(base_events)})"
ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"


def iso(ts="ts", pattern="yyyy-MM-dd'T'HH:mm:ss"):
    return F.date_format(ts, pattern)


# S1 - S5, S25, F28 -----------------------------------------------------------
def lines(spark, sf):
    return events(spark, sf).select("event_id", F.when(F.col("k") % 7 == 0, "").when(F.col("k") % 7 == 1, "{broken").when(F.col("k") % 7 == 2, '{"a":1,"a":2}')
                                    .otherwise(js(id=F.col("event_id"), t=F.col("event_type"))).alias("value"))


@query("s1_lenient_lines", E_SQL + " SELECT event_id, event_type FROM e WHERE k % 7 > 2")
def s1(spark, sf):
    t = FS.lenient_lines(lines(spark, sf))
    return t.select(V.text(F.col("doc"), "$.id").alias("event_id"), V.text(F.col("doc"), "$.t").alias("event_type"))


@query("s2_quarantined_lines", E_SQL + " SELECT event_id, 'json' AS error FROM e WHERE k % 7 IN (1, 2)")
def s2(spark, sf):
    return FS.strict_lines(lines(spark, sf))[1].select("event_id", "error")


@query("s3_enveloped_rows", E_SQL + " SELECT event_id, CAST(CASE WHEN ord // 20 % 3 = 2 THEN 0 ELSE ord % 20 END AS INT) AS ordinal FROM e")
def s3(spark, sf):
    e = events(spark, sf)
    item, mode = js(id=F.col("event_id")), F.floor(F.col("ord") / BATCH) % 3
    docs = batches(e.filter(mode == 0), item, '{"events":[', "]}").union(batches(e.filter(mode == 1), item, "[", "]")).union(
        e.filter(mode == 2).select("event_id", item))
    rows = FS.enveloped(docs.withColumn("doc", V.parse("raw")).drop("raw"), "events")
    return rows.select(V.text(F.col("row"), "$.id").alias("event_id"), "ordinal")


@query("s4_csv_rows", "SELECT n_nationkey, n_name FROM nation")
def s4(spark, sf):
    from ..runtime import checkpoint_dir, materialize
    import uuid
    path = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, sf, "nation").select("n_nationkey", "n_name").write.option("header", True).csv(path)
    return FS.read_csv(spark, path, "n_nationkey int, n_name string")


@query("s5_pack_file_matches", """SELECT path, a AS artifact_id FROM (SELECT 'case/' || p_type || '/' || p_name || CASE WHEN p_partkey % 3 = 0 THEN '.JSONL' ELSE '.txt' END || p_partkey AS path FROM part) t,
 (VALUES ('ring_jsonl', '*ring*.jsonl*'), ('bolts', '*bolt.txt?'), ('small', 'case/small/*')) v(a, p)
WHERE lower(path) GLOB p OR regexp_extract(lower(path), '[^/]*$', 0) GLOB p""")
def s5(spark, sf):
    path = F.concat(F.lit("case/"), "p_type", F.lit("/"), "p_name", F.when(F.col("p_partkey") % 3 == 0, ".JSONL").otherwise(".txt"), "p_partkey")
    return FS.match_files(table(spark, sf, "part").select(path.alias("path")), [("ring_jsonl", "*ring*.jsonl*"), ("bolts", "*bolt.txt?"), ("small", "case/small/*")])


FILES_A_TASK = 500


@query("s5_case_tree", """SELECT CAST(doc_id AS VARCHAR) AS doc_id, strlen(text) + 1 AS size, sha256(text || chr(10)) AS sha256, a AS artifact_id FROM documents
LEFT JOIN (VALUES ('english', 'en'), ('german', 'de'), ('text_file', NULL)) v(a, l) ON l IS NULL OR lang = l""")
def s5_tree(spark, sf):
    """Documents written as a tree of files, scanned, hashed and matched against presence patterns."""
    import uuid
    root = f"{checkpoint_dir(spark)}/case-{uuid.uuid4().hex}"
    d = table(spark, sf, "documents").select("lang", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # One small file a row: as many tasks as files call for, however few the input has, and each moves its own files.
    d.repartition(d.count() // FILES_A_TASK + 1, "doc_id").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("lang", "doc_id").text(root)
    files = FS.read_case_tree(spark, root).filter(F.contains(F.col("path"), F.lit("part-")))
    found = FS.with_artifacts(files, [("english", "lang=en/*"), ("german", "LANG=DE/*"), ("text_file", "part-*.txt")])
    doc = F.regexp_extract("path", "doc_id=([^/]+)/", 1)
    return found.select(doc.alias("doc_id"), "size", "sha256", "artifact_id")


@query("s25_receipts", """SELECT 'src-' || l_suppkey AS source, bool_and(l_quantity > 1) AS collection_complete, CAST(sum(l_linenumber) AS BIGINT) AS pages, count(*) AS receipts FROM lineitem GROUP BY 1""")
def s25(spark, sf):
    return FS.receipt_completeness(table(spark, sf, "lineitem").select(
        F.concat(F.lit("src-"), "l_suppkey").alias("source"), (F.col("l_quantity") > 1).alias("collection_complete"), F.col("l_linenumber").alias("page_count")))


@query("f28_text_search", """WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS path, text, unnest(string_split(text, chr(10))) AS ln, unnest(range(1, 1 + len(string_split(text, chr(10))))) AS n FROM documents)
SELECT path, n AS line, sha256(rtrim(ln, ' ')) AS line_sha256, sha256(text) AS sha256 FROM l WHERE contains(lower(ln), 'the th')""")
def f28(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", F.sha2("text", 256).alias("sha256"))
    return FS.search(d, "The TH").select("path", F.col("line").cast("bigint").alias("line"), F.sha2("text", 256).alias("line_sha256"), "sha256")


# S6, S7 ------------------------------------------------------------------------
@query("s6_made_events", E_SQL + """ SELECT event_id, CASE WHEN k % 3 = 0 THEN 'given' ELSE sha256('body ' || k) END AS content_sha256,
 array_to_string(list_sort(list_distinct(['b' || k % 3, 'a', 'b' || k % 2])), ',') AS cause_event_ids FROM e""")
def s6(spark, sf):
    e = events(spark, sf).select("event_id", F.when(F.col("k") % 3 == 0, "given").alias("content_sha256"), F.concat(F.lit("body "), "k").alias("content"),
                                 F.array(F.concat(F.lit("b"), F.col("k") % 3), F.lit("a"), F.concat(F.lit("b"), F.col("k") % 2)).alias("cause_event_ids"), F.lit(None).cast("array<string>").alias("correlation_ids"))
    return TR.make_events(e).select("event_id", "content_sha256", F.array_join("cause_event_ids", ",").alias("cause_event_ids"))


@query("s7_provider_events", E_SQL + """ SELECT CASE k % 2 WHEN 0 THEN 'openai' ELSE 'microsoft_copilot_foundry' END || ':' || CASE WHEN k % 10 IN (6, 7) THEN '0' ELSE event_id END AS event_id,
 CASE WHEN k % 10 IN (6, 7) THEN NULL ELSE event_id END AS request_id, CASE WHEN k % 2 = 0 THEN 'u' || user_id END AS actor_id, sha256('hello ' || k) AS prompt_sha256 FROM e""")
def s7(spark, sf):
    e = events(spark, sf)
    req = F.when(F.col("k") % 10 != 6, F.concat(F.lit('"request_id":"'), "event_id", F.lit('",'))).otherwise(F.lit('"request_id":null,"id":"shadowed",'))
    a = e.filter(F.col("k") % 2 == 0).select(F.lit("openai").alias("provider"), F.concat(F.lit("{"), req, F.lit('"user_id":"u'), "user_id", F.lit('","input":"hello '), "k", F.lit('"}')).alias("raw"))
    op = F.when(F.col("k") % 10 == 7, F.lit("")).otherwise(F.concat(F.lit('"operationId":"'), "event_id", F.lit('",')))
    b = e.filter(F.col("k") % 2 == 1).select(F.lit("microsoft_copilot_foundry").alias("provider"), F.concat(F.lit("{"), op, F.lit('"prompt":"hello '), "k", F.lit('"}')).alias("raw"))
    rows = a.union(b).select("provider", F.lit(0).alias("ordinal"), V.parse("raw").alias("row"))
    return C.provider_events(rows).select("event_id", "request_id", "actor_id", "prompt_sha256")


# S8 -------------------------------------------------------------------------------
def trail_record():
    version = F.when(F.col("k") % 50 == 1, "1.1").otherwise("1.09")
    ident = F.struct(F.lit("AssumedRole").alias("type"), F.concat(F.lit("arn:"), "actor_id").alias("arn"), F.struct(F.struct(
        F.lit("Role").alias("type"), F.lit("p1").alias("principalId")).alias("sessionIssuer")).alias("sessionContext"))
    return F.to_json(F.struct(version.alias("eventVersion"), F.col("event_id").alias("eventID"), F.concat(iso(), F.when(F.col("k") % 50 == 2, "+02:00").otherwise("Z")).alias("eventTime"),
                              F.lit("s3.amazonaws.com").alias("eventSource"), F.when(F.col("k") % 50 == 3, "").otherwise(F.concat(F.lit("Op"), F.col("k") % 5)).alias("eventName"), F.lit("eu-1").alias("awsRegion"),
                              F.when(F.col("k") % 50 == 4, "AwsCloudTrailInsight").otherwise("AwsApiCall").alias("eventType"), (F.col("k") % 2 == 0).alias("readOnly"), ident.alias("userIdentity"),
                              F.when(F.col("k") % 3 == 0, F.struct(F.concat(F.lit("b"), "k").alias("bucket"))).alias("requestParameters")))


TRAIL_REJECT = """CASE WHEN k % 50 = 3 THEN 'invalid_metadata' WHEN k % 50 = 1 THEN 'unsupported_version' WHEN k % 50 = 2 THEN 'event_time_not_utc' WHEN k % 50 = 4 THEN 'insight_event' """


@query("s8_cloudtrail_records", E_SQL + f""" SELECT CAST(ord // 20 AS VARCHAR) AS source_id, CAST(ord % 20 + 1 AS INT) AS ordinal, event_id, CASE WHEN k % 50 = 3 THEN '' ELSE 'Op' || k % 5 END AS event_name, k % 2 = 0 AS read_only,
 'arn:' || actor_id AS actor_arn, 'p1' AS issuer_principal, CASE WHEN k % 3 = 0 THEN 'present' ELSE 'absent' END AS request_state, CASE WHEN k % 3 = 0 THEN sha256('{{"bucket":"b' || k || '"}}') END AS request_sha256, {TRAIL_REJECT} END AS reject FROM e""".replace("{{", "{").replace("}}", "}"))
def s8(spark, sf):
    t = C.cloudtrail_events(batches(events(spark, sf), trail_record(), '{"Records":[', "]}"))
    return t.select("source_id", "ordinal", "event_id", "event_name", "read_only", F.col("actor.arn").alias("actor_arn"), F.col("session_issuer.principalId").alias("issuer_principal"),
                    F.col("payloads.requestParameters.state").alias("request_state"), F.col("payloads.requestParameters.sha256").alias("request_sha256"), "reject")


def trail_lookup(spark, sf):
    wrapper = js(EventId=F.when(F.col("k") % 50 == 5, "other").otherwise(F.col("event_id")), EventName=F.concat(F.lit("Op"), F.col("k") % 5),
                 ReadOnly=F.when(F.col("k") % 50 == 6, "false").otherwise((F.col("k") % 2 == 0).cast("string")),
                 EventTime=F.concat(F.when(F.col("k") % 50 == 7, "2000-01-01T00:00:00").otherwise(iso()), F.lit("+00:00")), CloudTrailEvent=trail_record())
    return batches(events(spark, sf), wrapper, '{"NextToken":"t1","Events":[', "]}")


@query("s8_cloudtrail_lookup", E_SQL + f""" SELECT event_id, {TRAIL_REJECT} WHEN k % 50 = 5 THEN 'lookup_identity_conflict' WHEN k % 50 = 6 THEN 'lookup_read_only_conflict' WHEN k % 50 = 7 THEN 'lookup_time_conflict' END AS reject FROM e""")
def s8_lookup(spark, sf):
    return C.cloudtrail_events(trail_lookup(spark, sf), lookup=True).select("event_id", "reject")


@query("s8_cloudtrail_documents", E_SQL + """ SELECT CAST(ord // 20 AS VARCHAR) AS source_id, count(*) AS event_count, true AS continuation_token_present, false AS collection_complete, CAST(NULL AS VARCHAR) AS reject FROM e GROUP BY 1""")
def s8_docs(spark, sf):
    return C.export_documents(trail_lookup(spark, sf), "Events", "NextToken", ["NextToken", "ResponseMetadata"]).drop("source_sha256")


# S9, S10 -----------------------------------------------------------------------------
@query("s9_azure_events", E_SQL + """ SELECT CAST(ord // 20 AS VARCHAR) AS source_id, CASE WHEN k % 40 = 1 THEN NULL ELSE event_id END AS event_data_id, CASE WHEN k % 40 = 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.1234567Z' END AS event_timestamp,
 CASE WHEN k % 40 <> 2 THEN 123456700 END AS nanos, 'op' || k % 4 AS operation, CASE WHEN k % 3 = 0 THEN 'absent' WHEN k % 3 = 1 THEN 'null' ELSE 'present' END AS status_state, 'app-' || user_id AS appid,
 CASE WHEN k % 40 = 1 THEN 'invalid_metadata' WHEN k % 40 = 2 THEN 'invalid_timestamp' END AS reject FROM e""")
def s9(spark, sf):
    status = F.when(F.col("k") % 3 == 0, '{"localizedValue":"x"}').when(F.col("k") % 3 == 1, '{"value":null}').otherwise('{"value":"Succeeded"}')
    item = F.concat(F.lit("{"), F.when(F.col("k") % 40 == 1, "").otherwise(F.concat(F.lit('"eventDataId":"'), "event_id", F.lit('",'))), F.lit('"eventTimestamp":"'), iso(),
                    F.when(F.col("k") % 40 == 2, "").otherwise(".1234567Z"), F.lit('","operationName":{"value":"op'), F.col("k") % 4, F.lit('"},"status":'), status, F.lit(',"claims":{"appid":"app-'), "user_id", F.lit('"}}'))
    e = events(spark, sf)
    docs = batches(e.filter(F.floor(F.col("ord") / BATCH) % 2 == 0), item, '{"value":[', "]}").union(batches(e.filter(F.floor(F.col("ord") / BATCH) % 2 == 1), item, "[", "]"))
    t = C.azure_events(docs)
    return t.select("source_id", "event_data_id", "event_timestamp", "nanos", F.col("operation_name.value").alias("operation"), F.col("status.value_state").alias("status_state"),
                    F.col("actor.claims")["appid"].alias("appid"), "reject")


def gcp_docs(spark, sf):
    log = F.when(F.col("k") % 40 == 1, "projects/p/logs/other").otherwise("projects/p-1/logs/cloudaudit.googleapis.com%2Fdata_access")
    deleg = F.when(F.col("k") % 4 == 0, '[{"firstPartyPrincipal":{"principalEmail":"a@x"}},{"principalSubject":"s"}]').when(
        F.col("k") % 40 == 2, '[{"firstPartyPrincipal":{},"thirdPartyPrincipal":{}}]').otherwise("[]")
    auths = F.when(F.col("k") % 5 == 0, '[{"resource":"r","permission":"p.get","granted":true},{"permission":"p.set"}]').otherwise("[]")
    item = F.concat(F.lit('{"logName":"'), log, F.lit('","resource":{"type":"t"},"insertId":"'), "event_id", F.lit('","timestamp":"'), iso(), F.lit('.123456789Z","severity":"NOTICE","protoPayload":{"@type":"'),
                    F.lit(C.GCP_AUDIT_TYPE), F.lit('","serviceName":"s","methodName":"m'), F.col("k") % 3, F.lit('","status":{"code":'), F.when(F.col("k") % 40 == 3, "1.5").otherwise((F.col("k") % 9).cast("string")),
                    F.lit('},"authenticationInfo":{"principalEmail":"u'), "user_id", F.lit('@x","serviceAccountDelegationInfo":'), deleg, F.lit('},"authorizationInfo":'), auths, F.lit("}}"))
    return batches(events(spark, sf), item, '{"entries":[', "]}")


@query("s10_gcp_entries", E_SQL + f""" SELECT event_id AS insert_id, CASE WHEN k % 40 = 1 THEN '' ELSE 'projects' END AS log_scope, CASE WHEN k % 40 = 1 THEN '' ELSE 'data_access' END AS audit_category, 123456789 AS nanos, 'm' || k % 3 AS method_name, 'u' || user_id || '@x' AS principal,
 CASE WHEN k % 40 = 1 THEN 'unsupported_log_name' WHEN k % 40 = 3 THEN 'invalid_status_code' WHEN k % 40 = 2 THEN 'ambiguous_delegation' END AS reject FROM e""")
def s10(spark, sf):
    t = C.gcp_entries(gcp_docs(spark, sf))
    return t.select("insert_id", "log_scope", "audit_category", "nanos", "method_name", F.col("actor.principalEmail").alias("principal"), "reject")


@query("s10_gcp_delegations", E_SQL + """ SELECT CAST(ord // 20 AS VARCHAR) AS source_id, CAST(ord % 20 + 1 AS INT) AS ordinal, d AS delegate, CASE WHEN d = 2 THEN 's' END AS principal_subject, CASE WHEN d = 1 THEN 'firstPartyPrincipal' END AS authority_kind, CASE WHEN d = 1 AND k % 4 = 0 THEN 'a@x' END AS first_party_email
 FROM e, (SELECT unnest([1, 2]) AS d) x WHERE k % 4 = 0 OR (k % 40 = 2 AND d = 1)""")
def s10_deleg(spark, sf):
    return C.gcp_delegations(C.gcp_entries(gcp_docs(spark, sf))).drop("record_sha256")


@query("s10_gcp_authorizations", E_SQL + """ SELECT CAST(ord // 20 AS VARCHAR) AS source_id, CAST(ord % 20 + 1 AS INT) AS ordinal, d AS check, CASE WHEN d = 1 THEN 'r' END AS resource, CASE WHEN d = 1 THEN 'p.get' ELSE 'p.set' END AS permission, CASE WHEN d = 1 THEN true END AS granted FROM e, (SELECT unnest([1, 2]) AS d) x WHERE k % 5 = 0""")
def s10_auth(spark, sf):
    return C.gcp_authorizations(C.gcp_entries(gcp_docs(spark, sf))).drop("record_sha256")


# S11, S12 -----------------------------------------------------------------------------
def la_docs(spark, sf, lossless=False):
    extra = ',{"name":"D","type":"decimal"}' if lossless else ""
    cols = '{"name":"B","type":"bool"},{"name":"I","type":"int"},{"name":"L","type":"long"},{"name":"R","type":"real"},{"name":"S","type":"string"},{"name":"T","type":"datetime"}' + extra
    dec = F.when(F.col("k") % 6 == 0, "79228162514264337593543950335").when(F.col("k") % 6 == 1, "79228162514264337593543950336").when(F.col("k") % 6 == 2, '"1.50"').when(F.col("k") % 6 == 3, "1e-29").when(F.col("k") % 6 == 4, "1200e3").otherwise("null")
    row = F.concat(F.lit("["), (F.col("k") % 2 == 0).cast("string"), F.lit(","), F.when(F.col("k") % 10 == 1, "3000000000").otherwise("7"), F.lit(","), "ord", F.lit(","), F.when(F.col("k") % 4 == 0, "null").otherwise("0.25"),
                   F.lit(',"s'), "k", F.lit('","'), iso(), F.when(F.col("k") % 10 == 2, "").otherwise(".1234567Z"), F.lit('"'), *([F.lit(","), dec] if lossless else []), F.lit("]"))
    suffix = ']}],"error":{"code":"PartialError"}}'
    return batches(events(spark, sf), row, '{"tables":[{"name":"PrimaryResult","columns":[' + cols + '],"rows":[', suffix)


@query("s11_result_cells", E_SQL + """ SELECT CAST(ord // 20 AS VARCHAR) AS source_id, 'PARTIAL' AS response_state, CAST(ord % 20 + 1 AS INT) AS row_ordinal, c AS column_name,
 CASE WHEN c = 'R' AND k % 4 = 0 THEN 'null' ELSE 'present' END AS state, CASE WHEN c = 'B' THEN 'boolean' WHEN c IN ('S', 'T') THEN 'string' WHEN c = 'R' AND k % 4 = 0 THEN 'null' ELSE 'number' END AS json_kind,
 CASE WHEN c = 'B' THEN k % 2 = 0 END AS v_bool, CASE WHEN c = 'I' AND k % 10 <> 1 THEN 7 WHEN c = 'L' THEN ord END AS v_long, CASE WHEN c = 'R' AND k % 4 <> 0 THEN 0.25::DOUBLE END AS v_double,
 CASE WHEN (c = 'I' AND k % 10 = 1) OR (c = 'T' AND k % 10 = 2) THEN 'cell_type_mismatch' END AS reject FROM e, (SELECT unnest(['B', 'I', 'L', 'R', 'S', 'T']) AS c) x""")
def s11(spark, sf):
    return C.result_cells(la_docs(spark, sf)).select("source_id", "response_state", "row_ordinal", "column_name", "state", "json_kind", "v_bool", "v_long", "v_double", "reject")


@query("s12_lossless_numbers", E_SQL + """, x AS (SELECT *, unnest(['B', 'I', 'L', 'R', 'S', 'T', 'D']) AS c FROM e),
y AS (SELECT *, (c = 'R' AND k % 4 = 0) OR (c = 'D' AND k % 6 = 5) AS missing FROM x)
SELECT CAST(ord // 20 AS VARCHAR) AS source_id, CAST(ord % 20 + 1 AS INT) AS row_ordinal, c AS column_name, CASE WHEN missing THEN 'null' ELSE 'present' END AS state,
 CASE WHEN missing THEN 'null' WHEN c = 'B' THEN 'boolean' WHEN c IN ('S', 'T') OR (c = 'D' AND k % 6 = 2) THEN 'string' ELSE 'number' END AS json_kind,
 CASE c WHEN 'I' THEN CASE WHEN k % 10 = 1 THEN '3000000000' ELSE '7' END WHEN 'L' THEN CAST(ord AS VARCHAR) WHEN 'R' THEN CASE WHEN k % 4 <> 0 THEN '0.25' END
   WHEN 'D' THEN (['79228162514264337593543950335', '79228162514264337593543950336', '1.50', '1e-29', '1200e3', NULL])[k % 6 + 1] END AS numeric_text,
 CASE WHEN c = 'B' THEN k % 2 = 0 END AS v_bool, CASE WHEN c = 'I' AND k % 10 <> 1 THEN 7 WHEN c = 'L' THEN ord END AS v_long, CASE WHEN c = 'R' AND k % 4 <> 0 THEN 0.25::DOUBLE END AS v_double,
 CASE WHEN (c = 'I' AND k % 10 = 1) OR (c = 'T' AND k % 10 = 2) OR (c = 'D' AND k % 6 IN (1, 3)) THEN 'cell_type_mismatch' END AS reject FROM y""")
def s12(spark, sf):
    t = C.result_cells(la_docs(spark, sf, True), lossless=True)
    return t.select("source_id", "row_ordinal", "column_name", "state", "json_kind", "numeric_text", "v_bool", "v_long", "v_double", "reject")


# S13 ------------------------------------------------------------------------------------
@query("s13_bound_contexts", """WITH r AS (SELECT o_orderkey, 'resp ' || o_orderkey AS raw FROM orders WHERE o_orderkey % 11 <> 0)
SELECT CAST(o.o_orderkey AS VARCHAR) AS context_id, CASE WHEN o.o_orderkey % 11 <> 0 THEN CAST(o.o_orderkey AS VARCHAR) END AS response_id, CASE WHEN o.o_orderkey % 9 = 4 THEN NULL ELSE sha256('Log | take ' || (o.o_orderkey % 50)) END AS query_sha256,
 CASE WHEN o.o_orderkey % 9 = 4 OR o.o_orderkey % 2 = 1 THEN NULL ELSE 'P1D' END AS timespan,
 CASE WHEN o.o_orderkey % 13 = 5 THEN 'http_status' WHEN o.o_orderkey % 11 = 0 THEN 'no_response_with_this_hash' WHEN o.o_orderkey % 17 = 3 THEN 'size_mismatch' WHEN o.o_orderkey % 9 = 4 THEN 'duplicate_parameter' END AS reject FROM orders o""")
def s13(spark, sf):
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    raw = F.concat(F.lit("resp "), key)
    responses = o.filter(key % 11 != 0).select(key.cast("string").alias("response_id"), raw.alias("raw"))
    q = F.concat(F.lit("Log+%7C+take+"), key % 50)
    url = F.concat(F.lit("https://api.example/v1/workspaces/w/query?query="), q, F.when(key % 9 == 4, "&query=again").otherwise(""), F.when(key % 2 == 0, "&timespan=P1D").otherwise(""))
    ctx = o.select(key.cast("string").alias("context_id"), F.lit("GET").alias("method"), url.alias("url"), F.lit(None).cast("string").alias("body"), F.when(key % 13 == 5, 500).otherwise(200).alias("status"),
                   F.sha2(raw, 256).alias("body_sha256"), (F.octet_length(raw) + F.when(key % 17 == 3, 1).otherwise(0)).alias("body_size_bytes"), F.lit(True).alias("form_encoded"))
    return C.bind_contexts(responses, ctx).select("context_id", "response_id", "query_sha256", "timespan", "reject")


# S14 - S17, S22, R8, J27 -------------------------------------------------------------------
def span_id(n):
    return F.lpad(F.hex(n), 16, "0")


def trace_id():
    return F.lpad(F.hex(F.floor(F.col("ord") / BATCH)), 32, "0")


OPS = ["execute_tool", "chat", "retrieval", "update_memory", "custom_op"]


def otlp_docs(spark, sf):
    op = F.element_at(F.lit(OPS), (F.col("k") % 5 + 1).cast("int"))
    parent = F.when(F.col("ord") % BATCH == 0, F.lit("")).otherwise(F.concat(F.lit(',"parentSpanId":"'), span_id(F.when(F.col("k") % 25 == 1, F.col("ord") + 100000).otherwise(F.col("ord") - 1)), F.lit('"')))
    attr = lambda key, val: F.concat(F.lit('{"key":"' + key + '","value":{"stringValue":"'), val, F.lit('"}}'))
    parts = F.array_compact(F.array(
        F.when(F.col("k") % 10 != 0, attr("gen_ai.operation.name", op)), F.when(F.col("k") % 3 == 0, attr("gen_ai.agent.id", F.col("actor_id"))), F.when(F.col("k") % 5 == 0, attr("gen_ai.tool.name", F.lit("search"))),
        F.when(F.col("k") % 4 == 0, attr("gen_ai.request.model", F.lit("m1"))), F.when(F.col("k") % 6 == 0, attr("gen_ai.custom", F.lit("x"))), F.when(F.col("k") % 50 == 7, attr("gen_ai.operation.name", F.lit("chat"))),
        F.lit('{"key":"n","value":{"intValue":"5"}}')))
    span = F.concat(F.lit('{"traceId":"'), trace_id(), F.lit('"'), F.when(F.col("k") % 45 == 9, "").otherwise(F.concat(F.lit(',"spanId":"'), span_id(F.col("ord")), F.lit('"'))), parent, F.lit(',"name":"'), "event_type",
                    F.lit('","startTimeUnixNano":"'), F.unix_micros(F.col("ts").cast("timestamp")), F.lit('123","attributes":['), F.array_join(parts, ","), F.lit("]}"))
    return batches(events(spark, sf), span, '{"resourceSpans":[{"resource":{"attributes":[]},"scopeSpans":[{"scope":{"name":"sc"},"spans":[', "]}]}]}")


SPAN_SQL = E_SQL + """, s AS (SELECT *, CAST(ord // 20 AS VARCHAR) AS source_id, lpad(printf('%X', ord // 20), 32, '0') AS trace_id, CASE WHEN k % 45 = 9 THEN NULL ELSE lpad(printf('%X', ord), 16, '0') END AS span_id,
 CASE WHEN ord % 20 = 0 THEN NULL WHEN k % 25 = 1 THEN lpad(printf('%X', ord + 100000), 16, '0') ELSE lpad(printf('%X', ord - 1), 16, '0') END AS parent_span_id,
 CASE WHEN k % 50 = 7 THEN NULL WHEN k % 10 <> 0 THEN (['execute_tool', 'chat', 'retrieval', 'update_memory', 'custom_op'])[k % 5 + 1] END AS op, k % 50 = 7 AS bad FROM e)"""


@query("s16_trace_spans", SPAN_SQL + """ SELECT source_id, CAST(ord % 20 AS INT) AS span_index, trace_id, span_id, parent_span_id, event_type AS span_name, 'sc' AS scope_name, epoch_us(ts) AS ts_us, CASE WHEN bad THEN 'duplicate_attribute_key' END AS reject FROM s""")
def s16(spark, sf):
    t = TR.trace_envelopes(otlp_docs(spark, sf))
    return t.select("source_id", "span_index", "trace_id", "span_id", "parent_span_id", "span_name", "scope_name", F.unix_micros("ts").alias("ts_us"), "reject")


@query("s15_adapted_attributes", SPAN_SQL + """ SELECT source_id, CAST(ord % 20 AS INT) AS span_index, CASE WHEN bad THEN '' ELSE concat_ws(';', CASE WHEN k % 3 = 0 THEN 'gen_ai.agent.id=' || actor_id END, CASE WHEN op IS NOT NULL THEN 'gen_ai.operation.name=' || op END,
 CASE WHEN k % 4 = 0 THEN 'gen_ai.request.model=m1' END, CASE WHEN k % 5 = 0 THEN 'gen_ai.tool.name=search' END) END AS genai, CASE WHEN k % 6 = 0 AND NOT bad THEN 'gen_ai.custom' ELSE '' END AS unmapped FROM s""")
def s15(spark, sf):
    t = TR.trace_envelopes(otlp_docs(spark, sf))
    kv = F.array_join(F.transform(F.array_sort(F.map_entries("genai")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return t.select("source_id", "span_index", kv.alias("genai"), F.array_join("unmapped", ",").alias("unmapped"))


@query("s16_envelope_diagnostics", SPAN_SQL + """ SELECT source_id, count(*) AS spans, count(DISTINCT trace_id) AS traces, 0 AS missing_trace_id, count(*) FILTER (span_id IS NULL) AS missing_span_id, count(*) FILTER (bad) AS rejected FROM s GROUP BY 1""")
def s16_diag(spark, sf):
    return TR.envelope_diagnostics(TR.trace_envelopes(otlp_docs(spark, sf)))


@query("s14_genai_events", SPAN_SQL + """ SELECT 'otel:' || trace_id || ':' || coalesce(span_id, 'None') AS event_id, CASE op WHEN 'execute_tool' THEN 'tool_call' WHEN 'chat' THEN 'model_inference' WHEN 'retrieval' THEN 'retrieval_result' WHEN 'update_memory' THEN 'memory_update' ELSE 'otel_genai_operation' END AS event_type,
 CASE WHEN k % 3 = 0 THEN actor_id END AS actor_id, CASE WHEN k % 5 = 0 THEN 'search' WHEN k % 4 = 0 THEN 'm1' END AS target_id, CASE WHEN parent_span_id IS NOT NULL THEN 'otel:' || trace_id || ':' || parent_span_id END AS parent_event_id FROM s WHERE op IS NOT NULL""")
def s14(spark, sf):
    return TR.genai_events(TR.trace_envelopes(otlp_docs(spark, sf))).select("event_id", "event_type", "actor_id", "target_id", "parent_event_id")


@query("s14_operation_coverage", SPAN_SQL + " SELECT op AS operation, count(*) AS n FROM s WHERE op IS NOT NULL GROUP BY 1")
def s14_cov(spark, sf):
    return TR.operation_coverage(TR.genai_events(TR.trace_envelopes(otlp_docs(spark, sf))))


@query("s14_coverage_gap", SPAN_SQL + """ SELECT source_id, event_type AS span_name, 'otel_genai_coverage_gap' AS type, 'high' AS severity FROM s GROUP BY 1, 2 HAVING count(op) = 0""")
def s14_gap(spark, sf):
    return TR.coverage_gap(TR.trace_envelopes(otlp_docs(spark, sf)), ["source_id", "span_name"])


def log_docs(spark, sf):
    rec = F.concat(F.lit('{"timeUnixNano":"'), F.unix_micros(F.col("ts").cast("timestamp")), F.lit('000","severityNumber":9,"severityText":"INFO","body":{"stringValue":"m'), "k", F.lit('"}'),
                   F.when(F.col("k") % 3 != 0, F.concat(F.lit(',"traceId":"'), trace_id(), F.lit('"'))).otherwise(""), F.when(F.col("k") % 3 == 1, F.concat(F.lit(',"spanId":"'), span_id(F.col("ord")), F.lit('"'))).otherwise(""), F.lit(',"attributes":{"a":1}}'))
    return batches(events(spark, sf), rec, '{"resourceLogs":[{"scopeLogs":[{"logRecords":[', "]}]}]}")


@query("s17_log_records", E_SQL + """ SELECT CAST(ord // 20 AS VARCHAR) AS source_id, CAST(ord % 20 AS INT) AS log_index, CASE WHEN k % 3 <> 0 THEN lpad(printf('%X', ord // 20), 32, '0') END AS trace_id, CASE WHEN k % 3 = 1 THEN lpad(printf('%X', ord), 16, '0') END AS span_id, 'm' || k AS body, 9 AS severity_number FROM e""")
def s17(spark, sf):
    return TR.log_envelopes(log_docs(spark, sf)).select("source_id", "log_index", "trace_id", "span_id", "body", "severity_number")


@query("s17_log_diagnostics", E_SQL + """ SELECT CAST(ord // 20 AS VARCHAR) AS source_id, count(*) AS log_records, count(*) FILTER (k % 3 <> 0) AS trace_linked, count(*) FILTER (k % 3 = 1) AS span_linked FROM e GROUP BY 1""")
def s17_diag(spark, sf):
    return TR.log_diagnostics(TR.log_envelopes(log_docs(spark, sf)))


@query("j27_logs_to_spans", SPAN_SQL + """ SELECT l.event_id AS body_event, s.event_type AS span_name FROM e l LEFT JOIN s ON l.k % 3 = 1 AND s.span_id = lpad(printf('%X', l.ord), 16, '0') AND s.trace_id = lpad(printf('%X', l.ord // 20), 32, '0')""")
def j27(spark, sf):
    from ..operators.joins import logs_to_spans
    e = events(spark, sf).select("event_id", F.concat(F.lit("x"), "ord").alias("o"), F.floor(F.col("ord") / BATCH).cast("string").alias("source_id"), (F.col("ord") % BATCH).cast("int").alias("log_index"))
    logs = TR.log_envelopes(log_docs(spark, sf)).join(e, ["source_id", "log_index"])
    return logs_to_spans(logs, TR.trace_envelopes(otlp_docs(spark, sf))).select(F.col("event_id").alias("body_event"), "span_name")


@query("s22_kernel_timeline", E_SQL + """, m AS (SELECT user_id, min(epoch_us(ts)) AS f FROM e GROUP BY 1) SELECT event_id, epoch_us(TIMESTAMP '2024-03-01') + epoch_us(ts) - f AS adjusted_us FROM e JOIN m USING (user_id)""")
def s22(spark, sf):
    e = events(spark, sf).select("event_id", F.col("user_id").alias("collector_id"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"))
    c = e.select("collector_id").distinct().withColumn("start", F.lit("2024-03-01").cast("timestamp"))
    return TR.kernel_timeline(e, c).select("event_id", F.unix_micros("adjusted").alias("adjusted_us"))


NODE_SQL = SPAN_SQL + """, g AS (SELECT *, 'otel-span:' || span_id AS base FROM s WHERE span_id IS NOT NULL)"""


@query("r8_trace_nodes", NODE_SQL.replace(" WHERE span_id IS NOT NULL", "").replace("'otel-span:' || span_id", "'otel-span:' || coalesce(span_id, 'missing')") + """ SELECT base AS node_id, CASE WHEN k % 3 = 0 AND NOT bad THEN 'agent' WHEN op IS NOT NULL THEN 'workflow' ELSE 'unknown' END AS kind FROM g
UNION ALL SELECT base || ':tool', 'tool' FROM g WHERE k % 5 = 0 AND NOT bad UNION ALL SELECT base || ':model', 'model' FROM g WHERE k % 4 = 0 AND NOT bad""")
def r8_nodes(spark, sf):
    n = TR.trace_nodes(TR.trace_envelopes(otlp_docs(spark, sf)))
    # Spans without an id are named by a hash of their place.
    return n.select(F.regexp_replace("node_id", ":missing-[0-9a-f]+", ":missing").alias("node_id"), "kind")


@query("r8_trace_edges", NODE_SQL + """ SELECT base AS src, base || ':tool' AS dst FROM g WHERE k % 5 = 0 AND NOT bad UNION ALL SELECT base, base || ':model' FROM g WHERE k % 4 = 0 AND NOT bad
UNION ALL SELECT 'otel-span:' || g.parent_span_id, g.base FROM g JOIN g p ON g.parent_span_id = p.span_id AND g.trace_id = p.trace_id""")
def r8_edges(spark, sf):
    # Edges need the spans three times; what they need of them is written once instead of parsed three times.
    unnamed = F.when(F.col("span_id").isNull(), F.col("span_sha256")).alias("span_sha256")
    spans = materialize(TR.trace_envelopes(otlp_docs(spark, sf)).select("trace_id", "span_id", "parent_span_id", "genai", unnamed))
    return TR.trace_edges(spans, TR.trace_nodes(spans)).select("src", "dst")


@query("r8_trace_problems", NODE_SQL + """ SELECT g.trace_id, g.span_id, 'orphan_parent' AS problem FROM g WHERE parent_span_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM g p WHERE p.span_id = g.parent_span_id AND p.trace_id = g.trace_id)""")
def r8_problems(spark, sf):
    return TR.trace_problems(TR.trace_envelopes(otlp_docs(spark, sf)))


@query("r8_trace_cycles", "SELECT CAST(o_orderkey % 3 AS INT) AS trace, CAST(o_orderkey AS VARCHAR) AS node FROM orders WHERE o_orderkey % 3000 < 12")
def r8_cycles(spark, sf):
    # Per trace: four-node cycles, and long chains that end without one.
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")
    i, t = F.floor(key / 3), key % 3
    up = F.when(i % 1000 < 4, i - i % 4 + (i + 1) % 4).when(i % 1000 == 4, None).otherwise(i - 1)
    return G.parent_cycles(o.select(t.cast("int").alias("trace"), key.cast("string").alias("node"), (up * 3 + t).cast("string").alias("parent")))


# S18 - S21, S31, R9, S24 ---------------------------------------------------------------------
@query("s18_mcp_exchanges", E_SQL + """ SELECT event_id AS exchange_id, CASE k % 3 WHEN 0 THEN 'tools/call' WHEN 1 THEN 'tasks/get' ELSE 'tools/list' END AS method, CASE WHEN k % 4 = 0 THEN 'search' WHEN k % 5 = 0 THEN 'hdr' END AS name, k % 3 = 1 AS task_extension,
 concat_ws(',', CASE WHEN k % 7 = 0 AND k % 3 <> 0 THEN 'mcp-method-header-does-not-match-jsonrpc-method' END, CASE WHEN k % 4 = 0 AND k % 5 = 0 THEN 'mcp-name-header-does-not-match-request-name' END) AS divergences, CASE WHEN k % 20 = 3 THEN 'response_not_json_rpc' END AS reject FROM e""")
def s18(spark, sf):
    method = F.when(F.col("k") % 3 == 0, "tools/call").when(F.col("k") % 3 == 1, "tasks/get").otherwise("tools/list")
    req = F.concat(F.lit('{"jsonrpc":"2.0","id":1,"method":"'), method, F.lit('","params":{'), F.when(F.col("k") % 4 == 0, '"name":"search"').otherwise(""), F.lit("}}"))
    heads = F.map_from_entries(F.array_compact(F.array(F.when(F.col("k") % 7 == 0, F.struct(F.lit("MCP-Method"), F.lit("tools/call"))), F.when(F.col("k") % 5 == 0, F.struct(F.lit("Mcp-Name"), F.lit("hdr"))))))
    rows = events(spark, sf).select(F.col("event_id").alias("exchange_id"), req.alias("request"), F.when(F.col("k") % 20 == 3, '{"jsonrpc":"1.0"}').otherwise('{"jsonrpc":"2.0","result":{}}').alias("response"), heads.alias("request_headers"))
    return AG.mcp_exchanges(rows).select("exchange_id", "method", "name", "task_extension", F.array_join("divergences", ",").alias("divergences"), "reject")


@query("s19_a2a_exchanges", E_SQL + """ SELECT event_id AS exchange_id, CASE WHEN k % 3 = 0 THEN '0.3' ELSE '1.0' END AS protocol_version, k % 3 = 0 AS version_missing, CASE WHEN k % 4 = 0 THEN 'a,b' ELSE '' END AS extensions,
 CASE k % 6 WHEN 0 THEN 'SendMessage' WHEN 1 THEN 'GetTask' WHEN 2 THEN 'CancelTask' WHEN 3 THEN 'ListTaskPushNotificationConfigs' WHEN 4 THEN NULL ELSE 'Strange' END AS operation, CASE WHEN k % 6 = 5 THEN false END AS method_known, CASE WHEN k % 9 = 0 THEN -32001 END AS error_code FROM e""")
def s19(spark, sf):
    m = F.when((F.col("k") % 6).isin(0, 2), "post").otherwise("GET")
    path = F.when(F.col("k") % 6 == 0, "/message:send").when(F.col("k") % 6 == 1, "/tasks/t1?x=1").when(F.col("k") % 6 == 2, "/tasks/t1:cancel").when(F.col("k") % 6 == 3, "/tasks/t1/pushNotificationConfigs").otherwise("/nothing")
    heads = F.map_from_entries(F.array_compact(F.array(F.when(F.col("k") % 3 != 0, F.struct(F.lit("A2A-Version"), F.lit("1.0"))), F.when(F.col("k") % 4 == 0, F.struct(F.lit("a2a-extensions"), F.lit("b, a,,b"))))))
    rows = events(spark, sf).select(F.col("event_id").alias("exchange_id"), F.when(F.col("k") % 6 == 5, "JSONRPC").otherwise("HTTP+JSON").alias("binding"), m.alias("http_method"), path.alias("path"), heads.alias("request_headers"),
                                    F.lit('{"jsonrpc":"2.0","method":"Strange"}').alias("request"), F.when(F.col("k") % 9 == 0, '{"error":{"code":-32001}}').otherwise("{}").alias("response"), F.lit(200).alias("status"))
    return AG.a2a_exchanges(rows).select("exchange_id", "protocol_version", "version_missing", F.array_join("extensions", ",").alias("extensions"), "operation", "method_known", "error_code")


@query("s20_sse_events", E_SQL + """ SELECT CAST(ord // 20 AS VARCHAR) AS stream_id, CAST(ord % 20 AS INT) AS sequence, CASE WHEN k % 10 = 5 THEN NULL WHEN k % 3 = 0 THEN 'task' WHEN k % 3 = 1 THEN 'statusUpdate' ELSE 'message' END AS event_type, CASE WHEN k % 10 = 5 THEN 'not_exactly_one_event' END AS reject FROM e""")
def s20(spark, sf):
    kind = F.when(F.col("k") % 3 == 0, "task").when(F.col("k") % 3 == 1, "statusUpdate").otherwise("message")
    body = F.concat(F.lit('{"'), kind, F.lit('":{"k":'), "k", F.lit("}"), F.when(F.col("k") % 10 == 5, ',"artifactUpdate":{}').otherwise(""), F.lit("}"))
    ev = F.struct("ord", F.concat(F.lit(": keepalive\ndata: "), body).alias("j"))
    streams = events(spark, sf).groupBy(F.floor(F.col("ord") / BATCH).cast("string").alias("stream_id")).agg(F.array_sort(F.collect_list(ev)).alias("x"))
    streams = streams.select("stream_id", F.lit("HTTP+JSON").alias("binding"), F.concat(F.array_join(F.transform("x", lambda x: x["j"]), "\r\n\r\n"), F.lit("\n\n")).alias("raw"))
    return AG.sse_events(streams).select("stream_id", "sequence", "event_type", "reject")


@query("s21_agent_cards", """SELECT 'agent-' || c_custkey AS agent_id, c_name AS name, 'v' || c_nationkey AS version, CAST(CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE 2 END AS INT) AS interfaces, CASE WHEN c_custkey % 2 = 0 THEN 'a,b' ELSE 'b' END AS skill_ids, CAST(c_custkey % 3 AS INT) AS signatures, CASE WHEN c_custkey % 6 = 0 THEN 'interfaces_missing' END AS reject FROM customer""")
def s21(spark, sf):
    c = F.col("c_custkey")
    raw = F.concat(F.lit('{"name":"'), "c_name", F.lit('","version":"v'), "c_nationkey", F.lit('","supportedInterfaces":'), F.when(c % 6 == 0, "[]").otherwise('[{"url":"u1"},{"url":"u2"}]'),
                   F.lit(',"skills":'), F.when(c % 2 == 0, '[{"id":"b"},{"id":"a"}]').otherwise('[{"id":"b"},{"name":"n"}]'), F.lit(',"signatures":'),
                   F.when(c % 3 == 0, "[]").when(c % 3 == 1, "[{}]").otherwise("[{},{}]"), F.lit("}"))
    cards = table(spark, sf, "customer").select(F.concat(F.lit("agent-"), c).alias("agent_id"), raw.alias("raw"))
    return AG.agent_cards(cards).drop("card_sha256")


def bodies(spark, sf):
    e = events(spark, sf)
    task = F.concat(F.lit('{"id":"t'), F.col("user_id"), F.lit('","contextId":"c'), F.col("user_id") % 10, F.lit('","status":{"state":"working","message":{"messageId":"m'), "event_id", F.lit('","role":"agent","parts":[]}},"artifacts":[{"artifactId":"a'), F.col("k") % 5, F.lit('","parts":[]}]}'))
    res = F.when(F.col("k") % 2 == 0, F.concat(F.lit('{"result":'), task, F.lit("}"))).otherwise(F.concat(F.lit('{"taskId":"t'), F.col("user_id"), F.lit('","contextId":"c1","status":{"state":"done"}}')))
    req = F.concat(F.lit('{"params":{"message":{"messageId":"q'), "event_id", F.lit('","role":"user","taskId":"t'), F.col("user_id"), F.lit('","parts":[{"text":"x"}]}}}'))
    base = e.select(F.col("event_id").alias("exchange_id"), F.explode(F.array(F.struct(F.lit("request").alias("direction"), req.alias("raw")), F.struct(F.lit("response").alias("direction"), res.alias("raw")))).alias("b"))
    return e, base.select("exchange_id", "b.*")


OBJ_SQL = E_SQL + """, o AS (SELECT event_id AS exchange_id, 'request' AS direction, 'message' AS kind, 'q' || event_id AS object_id, 't' || user_id AS task_id, CAST(NULL AS VARCHAR) AS context_id, '$.params.message' AS path FROM e
UNION ALL SELECT event_id, 'response', 'task', 't' || user_id, 't' || user_id, 'c' || user_id % 10, '$.result' FROM e WHERE k % 2 = 0 UNION ALL SELECT event_id, 'response', 'message', 'm' || event_id, NULL, NULL, '$.result.status.message' FROM e WHERE k % 2 = 0
UNION ALL SELECT event_id, 'response', 'artifact', 'a' || k % 5, NULL, NULL, '$.result.artifacts[0]' FROM e WHERE k % 2 = 0 UNION ALL SELECT event_id, 'response', 'task', 't' || user_id, 't' || user_id, 'c1', '$:status-update' FROM e WHERE k % 2 = 1)"""


@query("s31_body_objects", OBJ_SQL + " SELECT * FROM o")
def s31(spark, sf):
    return AG.body_objects(bodies(spark, sf)[1]).select("exchange_id", "direction", "kind", "object_id", "task_id", "context_id", "path")


def _graph(spark, sf):
    e, b = bodies(spark, sf)
    ex = e.select(F.col("event_id").alias("exchange_id"), F.col("actor_id").alias("client_agent_id"), F.concat(F.lit("srv-"), F.col("k") % 5).alias("server_agent_id"))
    return AG.exchange_graph(ex, AG.body_objects(b))


# The last part of an object's node id is the beginning of its digest, which is compared in s31.
R9_SQL = OBJ_SQL + """, x AS (SELECT event_id AS id, 'a2a-exchange:' || event_id AS proto, 'a2a-agent:' || actor_id AS client, 'a2a-agent:srv-' || k % 5 AS server FROM e),
d AS (SELECT DISTINCT exchange_id, direction, kind, object_id, task_id, context_id, 'a2a-exchange:' || exchange_id AS proto,
        'a2a-exchange:' || exchange_id || ':' || direction || ':' || kind || ':' || object_id AS n FROM o)"""


def _bare(node):
    return F.regexp_replace(node, ":[0-9a-f]{8}$", "")


@query("r9_exchange_nodes", R9_SQL + """ SELECT client AS node_id, 'agent' AS kind FROM x UNION SELECT server, 'agent' FROM x UNION SELECT proto, 'protocol' FROM x
 UNION SELECT n, kind FROM d UNION SELECT 'a2a-context:' || context_id, 'context' FROM d WHERE context_id IS NOT NULL""")
def r9_nodes(spark, sf):
    object_ = ~F.col("kind").isin("agent", "protocol", "context")
    return _graph(spark, sf)[0].select(F.when(object_, _bare("node_id")).otherwise(F.col("node_id")).alias("node_id"), "kind").distinct()


@query("r9_exchange_edges", R9_SQL + """ SELECT client AS src, proto AS dst, 'communicated_with' AS relationship FROM x UNION ALL SELECT proto, server, 'communicated_with' FROM x
 UNION ALL SELECT proto, n, CASE WHEN direction = 'request' AND kind = 'message' THEN 'provided_context' WHEN direction = 'response' AND kind IN ('message', 'artifact') THEN 'produced' ELSE 'observed' END FROM d
 UNION ALL SELECT n, 'a2a-context:' || context_id, 'correlated_with' FROM d WHERE context_id IS NOT NULL
 UNION ALL SELECT * FROM (SELECT lag(n) OVER (PARTITION BY task_id ORDER BY n) AS src, n AS dst, 'correlated_with' FROM d WHERE kind = 'task') WHERE src IS NOT NULL""")
def r9_edges(spark, sf):
    return _graph(spark, sf)[1].select(_bare("src").alias("src"), _bare("dst").alias("dst"), "relationship")


@query("s24_retrieval_documents", E_SQL + """ SELECT event_id AS retrieval_id, l AS list, CAST(p AS INT) AS pos, 'd' || ((k + p) % 7) AS document_id, sha256('chunk ' || ((k + p) % 7)) AS content_sha256 FROM e, (VALUES ('candidates', 0), ('candidates', 1), ('candidates', 2), ('returned', 0)) v(l, p)""")
def s24(spark, sf):
    d = lambda p: F.struct(F.concat(F.lit("d"), (F.col("k") + p) % 7).alias("document_id"), F.lit("c").alias("chunk_id"), F.concat(F.lit("chunk "), (F.col("k") + p) % 7).alias("content"), F.lit(0.5).alias("score"))
    r = events(spark, sf).select(F.col("event_id").alias("retrieval_id"), F.lit("q").alias("query"), F.array(d(0), d(1), d(2)).alias("candidates"), F.array(d(0)).alias("returned"))
    return AG.retrieval_documents(r).select("retrieval_id", "list", "pos", "document_id", "content_sha256")


@query("s24_memory_records", E_SQL + """ SELECT event_id AS memory_id, CASE k % 5 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'delete' WHEN 3 THEN 'expire' ELSE 'merge' END AS operation, sha256('after ' || k) AS after_sha256, CASE WHEN k % 5 = 4 THEN 'unsupported_operation' WHEN k % 8 = 0 THEN 'id_missing' END AS reject FROM e""")
def s24_mem(spark, sf):
    op = F.element_at(F.lit(["read", "write", "delete", "expire", "merge"]), (F.col("k") % 5 + 1).cast("int"))
    m = events(spark, sf).select(F.col("event_id").alias("memory_id"), op.alias("operation"), F.when(F.col("k") % 8 != 0, "x").alias("source_execution_id"), F.lit("b").alias("before"), F.lit("i").alias("input"), F.concat(F.lit("after "), "k").alias("after"))
    return AG.memory_records(m).select("memory_id", "operation", "after_sha256", "reject")


# S26 - S30, K7 ------------------------------------------------------------------------------
def inventory_docs(spark, sf):
    s = F.col("s_suppkey")
    tool = F.concat(F.lit('{"name":"t'), s % 3, F.lit('","description":"d'), s % 4, F.lit('","inputSchema":{"b":1,"a":'), s % 2, F.lit("}}"))
    raw = F.concat(F.lit('{"servers":[{'), F.when(s % 3 == 0, '"name":"').otherwise('"server_id":"'), F.lit("srv-"), s, F.lit('","url":"u'), s, F.lit('","issuer":"i","tools":['), tool, F.lit("]}]}"))
    return table(spark, sf, "supplier").select(F.lit("snap").alias("snapshot_id"), raw.alias("raw"))


@query("s26_mcp_servers", "SELECT 'srv-' || s_suppkey AS server_id, 'u' || s_suppkey AS url, 'i' AS authorization_issuer, sha256('[]') AS prompts_sha256 FROM supplier")
def s26(spark, sf):
    return AG.mcp_inventory(inventory_docs(spark, sf))[0].select("server_id", "url", "authorization_issuer", "prompts_sha256")


@query("s26_mcp_tools", """SELECT 'srv-' || s_suppkey AS server_id, 't' || s_suppkey % 3 AS tool_name, sha256('d' || s_suppkey % 4) AS description_sha256, sha256('{"a":' || s_suppkey % 2 || ',"b":1}') AS input_schema_sha256, sha256('{}') AS output_schema_sha256 FROM supplier""")
def s26_tools(spark, sf):
    return AG.mcp_inventory(inventory_docs(spark, sf))[1].drop("snapshot_id")


@query("s27_harness_fields", """SELECT 'h-' || s_suppkey AS harness_id, f AS field, CASE f WHEN 'package' THEN 'pkg' WHEN 'version' THEN 'v' || s_nationkey WHEN 'hooks_sha256' THEN sha256('{"x":' || s_suppkey % 4 || '}') ELSE CASE WHEN f LIKE '%_sha256' AND f <> 'binary_sha256' THEN sha256('{}') END END AS value
FROM supplier, (SELECT unnest(['package', 'version', 'binary_sha256', 'container_digest', 'prompt_assembly_sha256', 'middleware_sha256', 'hooks_sha256', 'tool_policy_sha256', 'approval_policy_sha256', 'memory_strategy_sha256', 'stop_policy_sha256', 'context_priority_sha256', 'dynamic_imports_sha256', 'plugins_sha256', 'skills_sha256']) AS f) x""")
def s27(spark, sf):
    raw = F.concat(F.lit('{"harness_id":"h-'), "s_suppkey", F.lit('","package":"pkg","version":"v'), "s_nationkey", F.lit('","hooks":{"x":'), F.col("s_suppkey") % 4, F.lit("}}"))
    return AG.harness_fields(table(spark, sf, "supplier").select(F.lit("a").alias("snapshot_id"), raw.alias("raw"))).drop("snapshot_id")


@query("s28_tool_identities", """SELECT p_partkey, sha256('{"authorization_context":null,"cert_fingerprint":null,"protocol":"mcp","schema_sha256":"' || p_brand || '","server_id":"s' || p_size || '","server_url":null,"tool_name":"' || p_name || '","version":"1"}') AS tool_identity_sha256 FROM part""")
def s28(spark, sf):
    none = F.lit(None).cast("string")
    t = table(spark, sf, "part").select("p_partkey", F.lit("mcp").alias("protocol"), F.concat(F.lit("s"), "p_size").alias("server_id"), none.alias("server_url"), none.alias("cert_fingerprint"),
                                        F.col("p_name").alias("tool_name"), F.col("p_brand").alias("schema_sha256"), F.lit("1").alias("version"), none.alias("authorization_context"))
    return AG.tool_identities(t).select("p_partkey", "tool_identity_sha256")


@query("s29_memory_snapshot", E_SQL + """, m AS (SELECT *, 'm' || k AS memory_id FROM e WHERE event_type = 'memory_write'),
j AS (SELECT tenant_id, memory_id, ord, '{"content_sha256":"' || content_sha256 || '","created_utc":"' || strftime(ts, '%Y-%m-%d') || '","embedding_model":"mü","embedding_version":null,"expires_utc":null,"memory_id":"' || memory_id
  || '","source_chunk_sha256":null,"source_event_id":"' || event_id || '","tenant_id":"' || tenant_id || '","tombstoned_utc":null,"vector_id":null,"version":' || (ord % 3) || ',"writer_id":"' || actor_id || '"}' AS t FROM m)
SELECT tenant_id, count(*) AS record_count, sha256('[' || string_agg(replace(t, 'ü', chr(92) || 'u00fc'), ',' ORDER BY memory_id, ord) || ']') AS snapshot_sha256 FROM j GROUP BY 1""")
def s29(spark, sf):
    m = events(spark, sf).filter("event_type = 'memory_write'").select(
        "tenant_id", F.concat(F.lit("m"), "k").alias("memory_id"), "ord", (F.col("ord") % 3).alias("version"), "content_sha256",
        F.col("event_id").alias("source_event_id"), F.col("actor_id").alias("writer_id"), F.lit("mü").alias("embedding_model"),
        F.date_format("ts", "yyyy-MM-dd").alias("created_utc"))
    return AG.memory_snapshot(m, ["tenant_id"])


def _bom(spark, sf):
    p, li = table(spark, sf, "part"), table(spark, sf, "lineitem")
    comp = p.filter("p_partkey % 9 <> 0").select(F.lit("sys").alias("system_id"), F.concat(F.lit("c"), F.when(F.col("p_partkey") % 50 == 1, F.col("p_partkey") + 1).otherwise(F.col("p_partkey"))).alias("component_id"), F.col("p_name").alias("name"))
    deps = li.select(F.lit("sys").alias("system_id"), F.concat(F.lit("c"), "l_partkey").alias("source"), F.concat(F.lit("c"), "l_suppkey").alias("target"))
    return AG.bom(comp, deps)


BOM_SQL = """WITH c AS (SELECT 'c' || CASE WHEN p_partkey % 50 = 1 THEN p_partkey + 1 ELSE p_partkey END AS id FROM part WHERE p_partkey % 9 <> 0), d AS (SELECT DISTINCT 'c' || l_partkey AS source, 'c' || l_suppkey AS target FROM lineitem)"""


@query("s30_bom_dependencies", BOM_SQL + " SELECT source, target FROM d WHERE source IN (SELECT id FROM c) AND target IN (SELECT id FROM c)")
def s30(spark, sf):
    return _bom(spark, sf)[1].select("source", "target")


@query("s30_bom_errors", BOM_SQL + """ SELECT 'duplicate_component' AS type, id FROM c GROUP BY id HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'dangling_dependency', x FROM (SELECT source AS x FROM d UNION SELECT target FROM d) WHERE x NOT IN (SELECT id FROM c)""")
def s30_errors(spark, sf):
    return _bom(spark, sf)[2].select("type", "id")


# G15 - G17, F27 ------------------------------------------------------------------------------
def records(spark, sf, new=False):
    e = events(spark, sf)
    extra = F.when(F.col("k") % 7 == 0, ',"list":[1,"a",{"z":null}]').otherwise("")
    add = F.when(F.col("k") % 3 == 0, ',"added":true').otherwise("") if new else F.lit("")
    val = F.when(F.col("k") % 11 == 0, '"text"').otherwise(F.col("k").cast("string")) if new else F.col("k").cast("string")
    raw = F.concat(F.lit('{"id":"'), "event_id", F.lit('","v":'), val, F.when(F.col("k") % 5 == 0, "").otherwise(',"opt":null'), extra, add, F.lit(',"nest":{"u":'), "user_id", F.lit("}}"))
    return e.select("event_id", F.when(F.col("ord") >= 0, "all").alias("source_id"), raw.alias("raw"))


@query("g15_field_profile", E_SQL + """, n AS (SELECT count(*) AS t FROM e) SELECT 'all' AS source_id, f AS field, c AS present_records, ks AS kinds, mm AS type_mismatch_records, CASE WHEN f IN ('id', 'opt') THEN t - c ELSE 0 END AS missing_required_records, f IN ('list', 'added', 'nest') AS unexpected FROM n, (
 SELECT 'id' AS f, count(*) AS c, 'string' AS ks, 0 AS mm FROM e UNION ALL SELECT 'v', count(*), 'number,string', count(*) FILTER (k % 11 = 0) FROM e UNION ALL SELECT 'opt', count(*), 'null', count(*) FROM e WHERE k % 5 <> 0
 UNION ALL SELECT 'list', count(*), 'array', 0 FROM e WHERE k % 7 = 0 UNION ALL SELECT 'added', count(*), 'boolean', 0 FROM e WHERE k % 3 = 0 UNION ALL SELECT 'nest', count(*), 'object', 0 FROM e)""")
def g15(spark, sf):
    from ..operators import shapes as SH
    return SH.field_profile(records(spark, sf, True), {"id": ["string"], "v": ["number"], "opt": ["number"]}, ["id", "opt"])


@query("g16_shape_profile", E_SQL + """ SELECT 'all' AS source_id, p AS path, c AS occurrences, r AS present_records, ks AS kinds FROM (SELECT '$' AS p, count(*) AS c, count(*) AS r, 'object:' || count(*) AS ks FROM e UNION ALL SELECT '$.id', count(*), count(*), 'string:' || count(*) FROM e UNION ALL SELECT '$.v', count(*), count(*), 'number:' || count(*) FROM e
 UNION ALL SELECT '$.opt', count(*), count(*), 'null:' || count(*) FROM e WHERE k % 5 <> 0 UNION ALL SELECT '$.list', count(*), count(*), 'array:' || count(*) FROM e WHERE k % 7 = 0 UNION ALL SELECT '$.list[]', 3 * count(*), count(*), 'number:' || count(*) || ',object:' || count(*) || ',string:' || count(*) FROM e WHERE k % 7 = 0
 UNION ALL SELECT '$.list[].z', count(*), count(*), 'null:' || count(*) FROM e WHERE k % 7 = 0 UNION ALL SELECT '$.nest', count(*), count(*), 'object:' || count(*) FROM e UNION ALL SELECT '$.nest.u', count(*), count(*), 'number:' || count(*) FROM e)""")
def g16(spark, sf):
    from ..operators import shapes as SH
    p = SH.shape_profile(records(spark, sf))
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("kind_occurrences")), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",")
    return p.select("source_id", "path", "occurrences", "present_records", kinds.alias("kinds"))


@query("g17_shape_drift", E_SQL + """ SELECT DISTINCT 'all' AS source_id, '$.added' AS path, 'added_path' AS change FROM e WHERE k % 3 = 0 UNION ALL SELECT 'all', '$.v', 'kind_change'""")
def g17(spark, sf):
    from ..operators import shapes as SH
    return SH.shape_drift(SH.shape_profile(records(spark, sf)), SH.shape_profile(records(spark, sf, True)))


@query("f27_raw_evidence_rules", """SELECT CAST(doc_id AS VARCHAR) AS evidence_id, doc_id % 7 <> 0 AS expected_digest_matches, strlen(text) BETWEEN 200 AND 3000 AS size_satisfies_rules, contains(text, 'the') AND contains(text, 'and') AS literal_text_satisfied FROM documents""")
def f27(spark, sf):
    from ..operators import shapes as SH
    d = table(spark, sf, "documents")
    ev = d.select(F.col("doc_id").cast("string").alias("evidence_id"), "text", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.sha2("text", 256)).alias("expected_sha256"))
    return SH.raw_evidence(ev, 200, 3000, ["the", "and"])
