"""Provider exports and cloud audit logs to typed rows.

Only selected metadata leaves the projection; payloads are carried as digests.
A record that breaks its profile keeps its row with a ``reject`` reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quote_numbers
from . import variants as V

# Field names per provider, in order of preference.
PROVIDER_FIELDS = {
    "microsoft_copilot_foundry": {"request": ["requestId", "operationId"], "model": ["model", "deployment"], "actor": ["userId", "principalId"],
                                  "tool": ["toolName"], "prompt": ["prompt", "input"], "response": ["response", "output"]},
    "openai": {"request": ["request_id", "id"], "model": ["model"], "actor": ["user_id"], "tool": ["tool_name"],
               "prompt": ["input", "messages"], "response": ["output"]},
    "anthropic": {"request": ["request_id", "id"], "model": ["model"], "actor": ["user_id"], "tool": ["tool_name"],
                  "prompt": ["messages"], "response": ["content"]},
    "google_vertex": {"request": ["request_id"], "model": ["model"], "actor": ["principal"], "tool": ["tool"],
                      "prompt": ["contents"], "response": ["candidates"]},
    "aws_bedrock": {"request": ["requestId"], "model": ["modelId"], "actor": ["principalArn"], "tool": ["toolName"],
                    "prompt": ["input"], "response": ["output"]},
    "github_copilot": {"request": ["request_id", "correlation_id"], "model": ["model"], "actor": ["user"], "tool": ["tool"],
                       "prompt": ["prompt"], "response": ["completion"]},
    "cursor": {"request": ["request_id"], "model": ["model"], "actor": ["user"], "tool": ["tool_name"],
               "prompt": ["prompt"], "response": ["response"]},
}
# CloudTrail text fields and payload fields.
CLOUDTRAIL_TEXT = {
    "event_version": "eventVersion", "event_id": "eventID", "timestamp": "eventTime", "event_source": "eventSource",
    "event_name": "eventName", "region": "awsRegion", "event_type": "eventType", "event_category": "eventCategory",
    "request_id": "requestID", "recipient_account_id": "recipientAccountId", "shared_event_id": "sharedEventID",
    "source_ip_address": "sourceIPAddress", "error_code": "errorCode"}
CLOUDTRAIL_REQUIRED = ["eventVersion", "eventID", "eventTime", "eventSource", "eventName", "awsRegion", "eventType"]
CLOUDTRAIL_PAYLOADS = ["requestParameters", "responseElements", "errorMessage", "resources", "additionalEventData",
                       "serviceEventDetails", "addendum", "userIdentity"]
CLOUDTRAIL_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?Z$"
# Azure activity fields.
AZURE_LOCALIZABLE = {"operation_name": "operationName", "event_name": "eventName", "category": "category",
                     "resource_provider_name": "resourceProviderName", "resource_type": "resourceType",
                     "status": "status", "sub_status": "subStatus"}
AZURE_CLAIMS = ["appid", "oid", "tid", "idtyp", "http://schemas.microsoft.com/identity/claims/objectidentifier",
                "http://schemas.microsoft.com/identity/claims/tenantid",
                "http://schemas.xmlsoap.org/ws/2005/05/identity/claims/nameidentifier"]
AZURE_PAYLOADS = ["authorization", "claims", "httpRequest", "properties", "description"]
RFC3339 = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?(Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)$"
# Google audit log names and payload fields.
GCP_LOG = r"^(projects|organizations|folders|billingAccounts)/[A-Za-z0-9_.:-]+/logs/cloudaudit\.googleapis\.com%2[Ff](activity|data_access|system_event|policy)$"
GCP_AUDIT_TYPE = "type.googleapis.com/google.cloud.audit.AuditLog"
GCP_PAYLOADS = ["request", "response", "metadata", "serviceData", "resourceOriginalState", "resourceLocation",
                "policyViolationInfo", "authenticationInfo", "authorizationInfo", "requestMetadata", "status"]
# Log Analytics column types.
LA_TYPES = ["bool", "datetime", "dynamic", "guid", "int", "long", "real", "string"]
LA_LOSSLESS_TYPES = LA_TYPES + ["decimal"]
GUID = r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
JSON_NUMBER = r"^-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?$"


def first_reason(*rules: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(cond, F.lit(why)) for cond, why in rules])


def timestamp_of(raw: Column) -> Column:
    """Microsecond timestamp of an RFC 3339 text; the text itself stays the exact value."""
    return F.when(raw.rlike(RFC3339), F.try_to_timestamp(raw))


def nanos_of(raw: Column) -> Column:
    """Nanoseconds within the second, kept exactly."""
    return F.when(raw.rlike(RFC3339), F.rpad(F.regexp_extract(raw, RFC3339, 2), 9, "0").cast("int"))


def provider_events(rows: DataFrame, provider: str | None = None, fields: dict | None = None,
                    include_content: bool = False) -> DataFrame:
    """Normalise provider exports by the first key that is present, even when its value is null.

    ``rows``: provider (unless given), ordinal, row (VARIANT).  Content is kept
    as SHA-256 unless asked for.
    """
    maps = fields or PROVIDER_FIELDS
    r = rows if provider is None else rows.withColumn("provider", F.lit(provider))
    r = r.withColumn("m", V.fields(F.col("row")))

    def pick(role: str) -> Column:
        out = None
        for name, roles in maps.items():
            value = None
            for key in roles.get(role, []):
                hit = F.map_contains_key("m", key)
                value = F.when(hit, F.col("m")[key]) if value is None else value.when(hit, F.col("m")[key])
            if value is None:
                continue
            cond = F.col("provider") == name
            out = F.when(cond, value) if out is None else out.when(cond, value)
        return out if out is not None else F.lit(None).cast("variant")

    def as_text(v: Column) -> Column:
        return F.when(v.isNull() | F.is_variant_null(v), None).when(
            F.schema_of_variant(v) == "STRING", V.at(v, "$", "string")).otherwise(F.to_json(v))

    req = as_text(pick("request"))
    prompt, response = as_text(pick("prompt")), as_text(pick("response"))
    doc = F.col("row")
    out = r.select(
        "provider", F.concat("provider", F.lit(":"), F.coalesce(F.when(req != "", req), F.col("ordinal").cast("string"))).alias("event_id"),
        F.coalesce(V.text(doc, "$.timestamp"), V.text(doc, "$.timestamp_utc"), V.text(doc, "$.time")).alias("timestamp_utc"),
        req.alias("request_id"), as_text(pick("model")).alias("model"), as_text(pick("actor")).alias("actor_id"),
        as_text(pick("tool")).alias("tool_name"), F.sha2(prompt, 256).alias("prompt_sha256"),
        F.sha2(response, 256).alias("response_sha256"), V.digest(doc).alias("raw_event_sha256"),
        *([prompt.alias("prompt"), response.alias("response")] if include_content else []))
    return out


def cloudtrail_events(docs: DataFrame, lookup: bool = False) -> DataFrame:
    """CloudTrail records (``Records``) or lookup results (``Events``), one row per event.

    ``docs``: source_id, raw.  Lookup wrappers are checked against the event
    they embed; a disagreement is a reject reason.
    """
    key = "Events" if lookup else "Records"
    d = docs.withColumn("doc", V.parse("raw")).filter(V.kind(V.at(F.col("doc"), f"$.{key}")) == "array")
    e = d.select("source_id", F.posexplode(V.items(F.col("doc"), f"$.{key}")).alias("pos", "entry"))
    if lookup:
        e = e.withColumns({"wrapper": F.col("entry"), "event": V.parse(V.text(F.col("entry"), "$.CloudTrailEvent"))})
    else:
        e = e.withColumns({"wrapper": F.lit(None).cast("variant"), "event": F.col("entry")})
    v, w = F.col("event"), F.col("wrapper")
    e = e.withColumn("m", V.fields(v))
    when = V.text(v, "$.eventTime")
    version = V.text(v, "$.eventVersion")
    differs = lambda outer, inner: V.at(w, f"$.{outer}").isNotNull() & ~V.text(w, f"$.{outer}").eqNullSafe(V.text(v, f"$.{inner}"))
    outer_time = V.at(w, "$.EventTime")
    numeric = F.timestamp_micros(F.round(V.at(w, "$.EventTime", "double") * 1e6).cast("bigint"))
    outer_ts = F.when(V.kind(outer_time) == "string", F.try_to_timestamp(V.at(w, "$.EventTime", "string"))).otherwise(numeric)
    ro = V.text(w, "$.ReadOnly")
    bad = F.lit(False)
    for f in CLOUDTRAIL_TEXT.values():
        bad = bad | V.bad_text(v, f"$.{f}", f in CLOUDTRAIL_REQUIRED)
    reject = first_reason(
        (v.isNull() | F.col("m").isNull(), "not_an_object"), (bad, "invalid_metadata"),
        (~(version.rlike(r"^1\.\d{1,3}$") & (F.substring_index(version, ".", -1).try_cast("int") >= 2)), "unsupported_version"),
        (~when.rlike(CLOUDTRAIL_TIME) | F.try_to_timestamp(when).isNull(), "event_time_not_utc"),
        ((V.text(v, "$.eventType") == "AwsCloudTrailInsight") | (V.text(v, "$.eventCategory") == "Insight")
         | F.map_contains_key("m", "insightDetails"), "insight_event"),
        (V.kind(V.at(v, "$.userIdentity")) != "object", "invalid_identity"),
        (V.at(v, "$.userIdentity").isNull(), "invalid_identity"),
        (differs("EventId", "eventID") | differs("EventName", "eventName") | differs("EventSource", "eventSource"), "lookup_identity_conflict"),
        (V.at(w, "$.ReadOnly").isNotNull() & ~((ro == "true") & V.flag(v, "$.readOnly") | (ro == "false") & ~V.flag(v, "$.readOnly")), "lookup_read_only_conflict"),
        (outer_time.isNotNull() & ~outer_ts.eqNullSafe(F.try_to_timestamp(when)), "lookup_time_conflict"),
    )
    actor = F.struct(*[V.text(v, f"$.userIdentity.{k}").alias(k) for k in ("type", "arn", "principalId", "accountId", "invokedBy")])
    issuer = F.struct(*[V.text(v, f"$.userIdentity.sessionContext.sessionIssuer.{k}").alias(k) for k in ("type", "arn", "principalId", "accountId")])
    return e.select(
        "source_id", (F.col("pos") + 1).alias("ordinal"), *[V.text(v, f"$.{f}").alias(n) for n, f in CLOUDTRAIL_TEXT.items()],
        F.try_to_timestamp(when).alias("ts"), V.flag(v, "$.readOnly").alias("read_only"), V.flag(v, "$.managementEvent").alias("management_event"),
        V.digest(v).alias("event_sha256"), V.digest(w).alias("lookup_wrapper_sha256"), actor.alias("actor"), issuer.alias("session_issuer"),
        F.struct(*[V.tri_state(F.col("m"), p).alias(p) for p in CLOUDTRAIL_PAYLOADS]).alias("payloads"), reject.alias("reject"))


def export_documents(docs: DataFrame, rows_key: str, token_key: str, allowed: list[str]) -> DataFrame:
    """Per document: source digest, row count, continuation token, and completeness.

    A continuation token proves that more pages exist; without one completeness stays unknown.
    """
    d = docs.withColumn("doc", V.parse("raw")).withColumn("m", V.fields(F.col("doc")))
    token = V.text(F.col("doc"), f"$.{token_key}")
    has = F.coalesce(token != "", F.lit(False))
    reject = first_reason(
        (F.col("m").isNull(), "not_an_object"),
        (F.size(F.array_except(F.map_keys("m"), F.lit([rows_key, *allowed]))) > 0, "mixed_envelope"),
        (V.kind(V.at(F.col("doc"), f"$.{rows_key}")) != "array", "invalid_rows"),
        (~F.map_contains_key("m", rows_key), "invalid_rows"))
    return d.select("source_id", F.sha2("raw", 256).alias("source_sha256"),
                    F.size(V.items(F.col("doc"), f"$.{rows_key}")).cast("bigint").alias("event_count"),
                    has.alias("continuation_token_present"), F.when(has, F.lit(False)).alias("collection_complete"), reject.alias("reject"))


def azure_events(docs: DataFrame) -> DataFrame:
    """Azure activity events from ``{"value": [...]}`` or a bare array.  Fractions stay as text."""
    d = docs.withColumn("doc", V.parse("raw"))
    rows = F.when(V.kind(F.col("doc")) == "array", V.items(F.col("doc"))).otherwise(V.items(F.col("doc"), "$.value"))
    e = d.select("source_id", F.posexplode(rows).alias("pos", "event")).withColumn("m", V.fields(F.col("event")))
    v = F.col("event")
    when = V.text(v, "$.eventTimestamp")
    claims = V.fields(v, "$.claims")

    def localizable(name: str) -> Column:
        m = V.fields(v, f"$.{name}")
        return F.struct(F.map_contains_key("m", name).alias("recorded"), V.text(v, f"$.{name}.value").alias("value"),
                        V.tri_state(m, "value")["state"].alias("value_state"), V.text(v, f"$.{name}.localizedValue").alias("localized_value"),
                        V.digest(V.at(v, f"$.{name}")).alias("record_sha256"))

    claim = lambda k: F.when(F.schema_of_variant(claims[k]) == "STRING", V.at(claims[k], "$", "string"))
    submitted = V.text(v, "$.submissionTimestamp")
    reject = first_reason(
        (F.col("m").isNull(), "not_an_object"), (V.bad_text(v, "$.eventDataId", True), "invalid_metadata"),
        (timestamp_of(when).isNull(), "invalid_timestamp"),
        (V.at(v, "$.submissionTimestamp").isNotNull() & timestamp_of(submitted).isNull(), "invalid_timestamp"),
        (V.bad_text(v, "$.operationName.value", True), "invalid_operation"))
    return e.select(
        "source_id", (F.col("pos") + 1).alias("ordinal"), V.digest(v).alias("event_sha256"), V.text(v, "$.eventDataId").alias("event_data_id"),
        when.alias("event_timestamp"), timestamp_of(when).alias("ts"), nanos_of(when).alias("nanos"), submitted.alias("submission_timestamp"),
        *[V.text(v, f"$.{k}").alias(n) for n, k in (("id", "id"), ("level", "level"), ("operation_id", "operationId"), ("correlation_id", "correlationId"),
          ("resource_id", "resourceId"), ("resource_group_name", "resourceGroupName"), ("subscription_id", "subscriptionId"), ("tenant_id", "tenantId"))],
        *[localizable(k).alias(n) for n, k in AZURE_LOCALIZABLE.items()],
        F.struct(V.text(v, "$.caller").alias("caller"), F.map_from_arrays(F.lit(AZURE_CLAIMS), F.array(*[claim(k) for k in AZURE_CLAIMS])).alias("claims")).alias("actor"),
        F.struct(*[V.text(v, f"$.authorization.{k}").alias(k) for k in ("action", "role", "scope")]).alias("authorization"),
        F.struct(V.text(v, "$.httpRequest.clientRequestId").alias("client_request_id"), V.text(v, "$.httpRequest.clientIpAddress").alias("client_ip_address"),
                 V.text(v, "$.httpRequest.method").alias("method"), V.tri_state(V.fields(v, "$.httpRequest"), "uri").alias("uri")).alias("http_request"),
        F.struct(*[V.tri_state(F.col("m"), p).alias(p) for p in AZURE_PAYLOADS]).alias("payloads"), reject.alias("reject"))


def gcp_entries(docs: DataFrame) -> DataFrame:
    """Google audit entries from ``{"entries": [...]}`` or a bare array."""
    d = docs.withColumn("doc", V.parse("raw"))
    rows = F.when(V.kind(F.col("doc")) == "array", V.items(F.col("doc"))).otherwise(V.items(F.col("doc"), "$.entries"))
    e = d.select("source_id", F.posexplode(rows).alias("pos", "entry")).withColumns(
        {"m": V.fields(F.col("entry")), "p": V.fields(F.col("entry"), "$.protoPayload")})
    v = F.col("entry")
    log, when = V.text(v, "$.logName"), V.text(v, "$.timestamp")
    code = V.at(v, "$.protoPayload.status.code")
    whole = V.at(v, "$.protoPayload.status.code", "double")
    reject = first_reason(
        (F.col("m").isNull(), "not_an_object"),
        (F.map_contains_key("m", "split") | F.map_contains_key("m", "jsonPayload") | F.map_contains_key("m", "textPayload"), "not_an_audit_payload"),
        (~F.coalesce(log.rlike(GCP_LOG), F.lit(False)), "unsupported_log_name"),
        (~F.coalesce(F.element_at(V.fields(v, "$.protoPayload"), "@type").cast("string") == GCP_AUDIT_TYPE, F.lit(False)), "unsupported_payload_type"),
        (V.bad_text(v, "$.protoPayload.serviceName", True) | V.bad_text(v, "$.protoPayload.methodName", True), "invalid_metadata"),
        (V.bad_text(v, "$.resource.type", True), "invalid_metadata"), (timestamp_of(when).isNull(), "invalid_timestamp"),
        (code.isNotNull() & ((V.kind(code) != "number") | (whole != F.floor(whole)) | (F.abs(whole) > 2147483648)), "invalid_status_code"),
        (F.exists(V.items(v, "$.protoPayload.authenticationInfo.serviceAccountDelegationInfo"),
                  lambda x: V.at(x, "$.firstPartyPrincipal").isNotNull() & V.at(x, "$.thirdPartyPrincipal").isNotNull()), "ambiguous_delegation"))
    return e.select(
        "source_id", (F.col("pos") + 1).alias("ordinal"), V.digest(v).alias("entry_sha256"), log.alias("log_name"),
        F.regexp_extract(log, GCP_LOG, 1).alias("log_scope"), F.regexp_extract(log, GCP_LOG, 2).alias("audit_category"),
        V.text(v, "$.insertId").alias("insert_id"), when.alias("timestamp"), timestamp_of(when).alias("ts"), nanos_of(when).alias("nanos"),
        V.text(v, "$.receiveTimestamp").alias("receive_timestamp"), V.text(v, "$.severity").alias("severity"),
        V.text(v, "$.protoPayload.serviceName").alias("service_name"), V.text(v, "$.protoPayload.methodName").alias("method_name"),
        V.text(v, "$.protoPayload.resourceName").alias("resource_name"), V.text(v, "$.resource.type").alias("monitored_resource_type"),
        F.struct(*[V.text(v, f"$.protoPayload.authenticationInfo.{k}").alias(k) for k in ("principalEmail", "principalSubject", "authoritySelector")]).alias("actor"),
        V.text(v, "$.protoPayload.requestMetadata.callerIp").alias("caller_ip"), F.map_contains_key("p", "status").alias("status_recorded"),
        V.at(v, "$.protoPayload.status.code", "int").alias("status_code"),
        F.struct(F.map_contains_key("m", "operation").alias("recorded"), V.text(v, "$.operation.id").alias("id"), V.text(v, "$.operation.producer").alias("producer"),
                 V.flag(v, "$.operation.first").alias("first"), V.flag(v, "$.operation.last").alias("last")).alias("operation"),
        V.text(v, "$.trace").alias("trace"), V.text(v, "$.spanId").alias("span_id"),
        F.struct(*[V.tri_state(F.col("p"), k).alias(k) for k in GCP_PAYLOADS]).alias("payloads"), reject.alias("reject"), v.alias("entry"))


def gcp_delegations(entries: DataFrame) -> DataFrame:
    """One row per service-account delegation, in recorded order."""
    x = entries.select("source_id", "ordinal", F.posexplode(
        V.items(F.col("entry"), "$.protoPayload.authenticationInfo.serviceAccountDelegationInfo")).alias("pos", "item"))
    v = F.col("item")
    return x.select("source_id", "ordinal", (F.col("pos") + 1).alias("delegate"), V.text(v, "$.principalSubject").alias("principal_subject"),
                    F.when(V.at(v, "$.firstPartyPrincipal").isNotNull(), "firstPartyPrincipal").when(
                        V.at(v, "$.thirdPartyPrincipal").isNotNull(), "thirdPartyPrincipal").alias("authority_kind"),
                    V.text(v, "$.firstPartyPrincipal.principalEmail").alias("first_party_email"), V.digest(v).alias("record_sha256"))


def gcp_authorizations(entries: DataFrame) -> DataFrame:
    """One row per recorded permission check."""
    x = entries.select("source_id", "ordinal", F.posexplode(V.items(F.col("entry"), "$.protoPayload.authorizationInfo")).alias("pos", "item"))
    v = F.col("item")
    return x.select("source_id", "ordinal", (F.col("pos") + 1).alias("check"), V.text(v, "$.resource").alias("resource"),
                    V.text(v, "$.permission").alias("permission"), V.flag(v, "$.granted").alias("granted"), V.digest(v).alias("record_sha256"))


def result_cells(docs: DataFrame, lossless: bool = False) -> DataFrame:
    """Log Analytics result tables as typed cells.

    ``docs``: source_id, raw.  Each cell carries its state, JSON kind, digest,
    typed value and a reject reason; every row its digest and the digest that
    binds it to the column list.  The lossless profile keeps number text and
    never converts through a double.
    """
    doc = F.col("doc")
    # VARIANT rewrites numbers (1e-29 becomes 1.0E-29); reading the cells as
    # strings, numbers quoted first, keeps the exact text for the lossless profile.
    exact = F.from_json(quote_numbers("raw"), "tables array<struct<rows:array<array<string>>>>") if lossless else F.lit(None).cast(
        "struct<tables:array<struct<rows:array<array<string>>>>>")
    d = docs.withColumns({"doc": V.parse("raw"), "exact": exact})
    partial = V.text(doc, "$.error.code") == "PartialError"
    t = d.select("source_id", "exact", F.when(partial, "PARTIAL").otherwise("NO_ERROR_RECORDED").alias("response_state"),
                 F.posexplode(V.items(doc, "$.tables")).alias("tpos", "table"))
    t = t.withColumns({"columns": V.at(F.col("table"), "$.columns", "array<struct<name:string,type:string>>"),
                       "table_name": V.text(F.col("table"), "$.name"), "rows": V.items(F.col("table"), "$.rows"),
                       "columns_json": F.to_json(V.at(F.col("table"), "$.columns")),
                       "exact_rows": F.get("exact.tables", F.col("tpos"))["rows"]})
    r = t.select("source_id", "response_state", "tpos", "table_name", "columns", "columns_json", "exact_rows", F.posexplode("rows").alias("rpos", "row"))
    r = r.withColumns({"cells": V.items(F.col("row")), "row_json": F.to_json("row"), "tokens": F.get("exact_rows", F.col("rpos"))})
    width_ok = F.size("cells") == F.size("columns")
    c = r.select("source_id", "response_state", (F.col("tpos") + 1).alias("table_ordinal"), "table_name", (F.col("rpos") + 1).alias("row_ordinal"),
                 F.sha2("row_json", 256).alias("row_sha256"),
                 F.sha2(F.concat(F.lit('{"columns":'), "columns_json", F.lit(',"row":'), "row_json", F.lit("}")), 256).alias("binding_sha256"),
                 width_ok.alias("width_ok"), "tokens", F.posexplode(F.arrays_zip("columns", "cells")).alias("cpos", "z"))
    x, kind = F.col("z.cells"), F.col("z.columns.type")
    null = x.isNull() | F.coalesce(F.is_variant_null(x), F.lit(False))
    jk = F.coalesce(V.kind(x), F.lit("null"))
    txt = F.to_json(x)
    s = F.when(jk == "string", V.at(x, "$", "string"))
    number = F.when(jk == "number", F.coalesce(F.get("tokens", F.col("cpos")), txt)).when(F.lit(lossless) & (jk == "string"), s)
    is_num = number.rlike(JSON_NUMBER)
    integer = number.rlike(r"^-?(?:0|[1-9]\d*)$")
    # A cast that fails costs an exception, so text is cast only where it can be what the column says.
    whole = F.when(integer & (F.length(number) <= 20), number.try_cast("bigint"))
    in_long = whole.isNotNull()
    in_int = in_long & whole.between(-2 ** 31, 2 ** 31 - 1)
    real = F.when((kind == "real") & is_num, number.try_cast("double"))
    nonzero = F.regexp_replace(number, "[eE].*$", "").rlike("[1-9]")
    real_ok = is_num & real.isNotNull() & ~F.isnan(real) & (F.abs(real) < float("inf")) & ~((real == 0) & nonzero)
    valid = (F.when(kind == "bool", jk == "boolean").when(kind == "int", in_int).when(kind == "long", in_long).when(kind == "real", real_ok)
             .when(kind == "decimal", is_num & decimal_in_range(number)).when(kind == "string", jk == "string")
             .when(kind == "guid", F.coalesce(s.rlike(GUID), F.lit(False))).when(kind == "datetime", timestamp_of(s).isNotNull())
             .when(kind == "dynamic", F.lit(True)).otherwise(F.lit(False)))
    kinds = LA_LOSSLESS_TYPES if lossless else LA_TYPES
    reject = first_reason((~F.col("width_ok"), "row_width"), (~F.coalesce(kind.isin(kinds), F.lit(False)), "unsupported_column_type"),
                          (~null & ~F.coalesce(valid, F.lit(False)), "cell_type_mismatch"))
    return c.select(
        "source_id", "response_state", "table_ordinal", "table_name", "row_ordinal", (F.col("cpos") + 1).alias("column_ordinal"),
        F.col("z.columns.name").alias("column_name"), kind.alias("type"), "row_sha256", "binding_sha256",
        F.when(null, "null").otherwise("present").alias("state"), jk.alias("json_kind"), F.sha2(F.coalesce(txt, F.lit("null")), 256).alias("sha256"),
        F.when((kind == "bool") & (jk == "boolean"), V.at(x, "$", "boolean")).alias("v_bool"),
        F.when(((kind == "int") & in_int) | ((kind == "long") & in_long), whole).alias("v_long"),
        F.when((kind == "real") & real_ok, real).alias("v_double"),
        F.when(kind.isin("int", "long", "real", "decimal") & is_num, number).alias("numeric_text"),
        F.when(kind == "datetime", s).alias("datetime_text"), reject.alias("reject"))


def decimal_in_range(number: Column) -> Column:
    """Does a JSON number fit a 96-bit coefficient with a scale of -28 to 28?

    Works on the digits as text: value = digits * 10^exponent after trailing
    zeros are dropped, and the coefficient may be scaled up by at most 10^28.
    """
    mantissa = F.regexp_replace(F.regexp_replace(number, "[eE].*$", ""), "^-", "")
    # A cast that fails costs an exception: only a number with an exponent is cast.
    power = F.when(number.rlike("[eE]"), F.coalesce(F.regexp_extract(number, "[eE]([+-]?\\d+)$", 1).try_cast("int"), F.lit(0))).otherwise(0)
    fraction = F.length(F.regexp_extract(mantissa, "\\.(\\d+)$", 1))
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "^0+", "")
    kept = F.regexp_replace(digits, "0+$", "")
    exponent = power - fraction + (F.length(digits) - F.length(kept))
    whole = F.when((exponent > 0) & (exponent <= 28), F.rpad(kept, (F.length(kept) + exponent).cast("int"), "0")).otherwise(kept)
    limit = F.lit(str(2 ** 96 - 1))
    fits = (F.length(whole) < 29) | ((F.length(whole) == 29) & (whole <= limit))
    return (kept == "") | (exponent.between(-28, 28) & fits)


def bind_contexts(responses: DataFrame, contexts: DataFrame) -> DataFrame:
    """Bind retained query responses to their request context by body hash and size.

    ``responses``: response_id, raw.  ``contexts``: context_id, method, url,
    body, status, body_sha256, body_size_bytes, form_encoded.  GET parameters
    come from the URL; ``+`` is a space only for form-encoded URLs.  Responses
    with one body, such as empty results, are one body: a context gets a single
    row with the smallest ``response_id`` and the number of such ``responses``.
    """
    r = responses.groupBy(F.sha2("raw", 256).alias("body_sha256"), F.octet_length("raw").alias("size")).agg(
        F.min("response_id").alias("response_id"), F.count("*").alias("responses"))
    c = contexts.join(r, "body_sha256", "left")
    query = F.when(F.contains("url", F.lit("?")), F.substring_index("url", "?", -1))
    plain = F.when(F.coalesce("form_encoded", F.lit(False)), query).otherwise(F.replace(query, F.lit("+"), F.lit("%2B")))
    pairs = F.filter(F.split(plain, "&"), lambda p: p != "")
    names = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
    values = F.transform(pairs, lambda p: F.try_url_decode(F.substring(p, F.instr(p, "=") + 1, F.length(p))))
    twice = F.size(F.array_distinct(names)) != F.size(names)
    params = F.when(~twice, F.map_from_arrays(names, values))
    body_query = F.get_json_object("body", "$.query")
    text = F.when(F.col("method") == "GET", params["query"]).otherwise(body_query)
    spaces = F.filter(F.split(params["workspaces"], ","), lambda w: w != "")
    reject = first_reason(
        (F.col("status") != 200, "http_status"), (F.col("response_id").isNull(), "no_response_with_this_hash"),
        (F.col("size") != F.col("body_size_bytes"), "size_mismatch"), ((F.col("method") == "GET") & twice, "duplicate_parameter"),
        (text.isNull() | (text == ""), "query_missing"),
        (F.exists(spaces, lambda w: ~w.rlike(GUID)), "invalid_workspace_list"))
    return c.select("context_id", "response_id", F.coalesce("responses", F.lit(0)).alias("responses"),
                    F.sha2(F.substring_index("url", "?", 1), 256).alias("endpoint_sha256"),
                    F.sha2(text, 256).alias("query_sha256"), F.octet_length(text).alias("query_size_bytes"), params["timespan"].alias("timespan"),
                    F.coalesce(F.size(spaces), F.lit(0)).alias("workspaces"), reject.isNull().alias("bound"), reject.alias("reject"))
