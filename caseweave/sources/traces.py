"""OpenTelemetry envelopes, agentic events and kernel traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import variants as V

# Operation names and the event types they become.
OPERATION_EVENTS = {
    "create_agent": "agent_birth", "invoke_agent": "agent_invoke", "invoke_workflow": "workflow_invoke", "plan": "plan",
    "execute_tool": "tool_call", "retrieval": "retrieval_result", "search_memory": "memory_read",
    "create_memory": "memory_write", "update_memory": "memory_update", "upsert_memory": "memory_upsert",
    "delete_memory": "memory_delete", "generate_content": "model_inference", "chat": "model_inference",
    "text_completion": "model_inference"}
# Generative-AI attributes that are retained.
GENAI_KEYS = [
    "gen_ai.agent.id", "gen_ai.agent.name", "gen_ai.agent.version", "gen_ai.agent.description",
    "gen_ai.conversation.id", "gen_ai.workflow.name", "gen_ai.operation.name", "gen_ai.provider.name",
    "gen_ai.request.model", "gen_ai.response.model", "gen_ai.system_instructions", "gen_ai.input.messages",
    "gen_ai.output.messages", "gen_ai.retrieval.query.text", "gen_ai.retrieval.documents", "gen_ai.tool.name",
    "gen_ai.tool.type"]


def make_events(rows: DataFrame) -> DataFrame:
    """Agentic events with sorted distinct reference lists and a content hash unless one is given."""
    none = F.array().cast("array<string>")
    refs = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, none)))
    return rows.withColumns({
        "cause_event_ids": refs("cause_event_ids"), "correlation_ids": refs("correlation_ids"),
        "content_sha256": F.coalesce(F.when(F.col("content_sha256") != "", F.col("content_sha256")), F.sha2("content", 256))})


def any_value(v: Column) -> Column:
    """Scalar of an OTLP AnyValue as text; arrays and key-value lists as JSON; plain values as they are."""
    keys = ["stringValue", "intValue", "doubleValue", "boolValue", "bytesValue"]
    scalar = F.coalesce(*[V.at(v, f"$.{k}", "string") for k in keys])
    nested = F.coalesce(F.to_json(V.at(v, "$.arrayValue")), F.to_json(V.at(v, "$.kvlistValue")))
    plain = F.when(F.schema_of_variant(v) == "STRING", V.at(v, "$", "string")).otherwise(F.to_json(v))
    return F.coalesce(scalar, nested, plain)


def attributes(v: Column) -> Column:
    """Struct (map, repeated): attributes of a span or log (array of key/value or object), and whether a key repeats."""
    # Arrays of one element name what lambdas would otherwise work out at every use.
    entries = F.transform(V.items(v), lambda p: F.named_struct(
        F.lit("key"), V.at(p, "$.key", "string"), F.lit("value"), any_value(V.at(p, "$.value"))))
    empty = F.create_map().cast("map<string,string>")

    def checked(e: Column) -> Column:
        keys = F.transform(e, lambda x: x["key"])
        repeated = (F.size(keys) != F.size(F.array_distinct(keys))) | F.exists(keys, lambda k: k.isNull())
        return F.transform(F.array(repeated), lambda twice: F.named_struct(
            F.lit("map"), F.when(twice, empty).otherwise(F.map_from_entries(e)), F.lit("repeated"), twice))[0]

    listed = F.transform(F.array(entries), checked)[0]
    as_object = F.transform_values(V.fields(v), lambda k, x: any_value(x))
    return F.coalesce(F.when(as_object.isNotNull(), F.named_struct(F.lit("map"), as_object, F.lit("repeated"), F.lit(False))), listed)


def trace_envelopes(docs: DataFrame) -> DataFrame:
    """Flatten resourceSpans -> scopeSpans -> spans, with indexes at every level.

    ``docs``: source_id, raw.  A span with repeated attribute keys or malformed
    ids keeps its row with a reject reason.
    """
    doc = F.col("doc")
    d = docs.withColumn("doc", V.parse("raw"))
    r = d.select("source_id", F.posexplode(V.items(doc, "$.resourceSpans")).alias("resource_index", "resource_group"))
    s = r.select("source_id", "resource_index", attributes(V.at(F.col("resource_group"), "$.resource.attributes"))["map"].alias("resource_attributes"),
                 F.posexplode(V.items(F.col("resource_group"), "$.scopeSpans")).alias("scope_index", "scope_group"))
    p = s.select("source_id", "resource_index", "resource_attributes", "scope_index", V.text(F.col("scope_group"), "$.scope.name").alias("scope_name"),
                 V.text(F.col("scope_group"), "$.scope.version").alias("scope_version"),
                 F.posexplode(V.items(F.col("scope_group"), "$.spans")).alias("span_index", "span"))
    return _span_columns(p)


def _spelled(v: Column, *names: str) -> Column:
    """The first member of these names that is a text and not empty."""
    return F.get(F.filter(F.array(*[V.text(v, f"$.{k}") for k in names]), lambda x: x != ""), F.lit(0))


def _span_columns(p: DataFrame) -> DataFrame:
    v = F.col("span")
    # Columns of their own, so that what depends on them does not work them out again.
    named = p.withColumns({"__a": attributes(V.at(v, "$.attributes")), "__trace": _spelled(v, "traceId", "trace_id"),
                           "__span": _spelled(v, "spanId", "span_id"), "__parent": _spelled(v, "parentSpanId", "parent_span_id")})
    repeated, trace, span, parent = F.col("__a.repeated"), F.col("__trace"), F.col("__span"), F.col("__parent")
    hexed = lambda x, n: x.isNull() | x.rlike(f"^[0-9a-fA-F]{{{n}}}$")
    reject = F.coalesce(F.when(repeated, "duplicate_attribute_key"), F.when(~hexed(trace, 32), "invalid_trace_id"),
                        F.when(~hexed(span, 16) | ~hexed(parent, 16), "invalid_span_id"))
    keys = F.lit(GENAI_KEYS)
    start = V.at(v, "$.startTimeUnixNano", "string")
    return named.withColumn("attrs", F.col("__a.map")).select(
        *[c for c in p.columns if c != "span"], trace.alias("trace_id"), span.alias("span_id"), parent.alias("parent_span_id"),
        V.text(v, "$.name").alias("span_name"), start.alias("start_unix_nano"),
        F.timestamp_micros(F.floor(start.try_cast("decimal(20,0)") / 1000).cast("bigint")).alias("ts"),
        F.map_filter("attrs", lambda k, x: F.array_contains(keys, k)).alias("genai"),
        F.array_sort(F.filter(F.map_keys("attrs"), lambda k: k.startswith("gen_ai.") & ~F.array_contains(keys, k))).alias("unmapped"),
        "attrs", F.sha2(F.to_json(v), 256).alias("span_sha256"), reject.alias("reject"))


def envelope_diagnostics(spans: DataFrame) -> DataFrame:
    """Span counts, distinct traces and missing ids per envelope."""
    return spans.groupBy("source_id").agg(
        F.count("*").alias("spans"), F.count_distinct("trace_id").alias("traces"),
        F.count_if(F.col("trace_id").isNull()).alias("missing_trace_id"), F.count_if(F.col("span_id").isNull()).alias("missing_span_id"),
        F.count_if(F.col("reject").isNotNull()).alias("rejected"))


def genai_events(spans: DataFrame) -> DataFrame:
    """Agentic events of spans that name a generative-AI operation."""
    a = F.col("attrs")
    op = F.coalesce(a["gen_ai.operation.name"], a["gen_ai.operation_name"], a["operation.name"])
    mapping = F.create_map(*[F.lit(x) for kv in OPERATION_EVENTS.items() for x in kv])
    content = F.coalesce(a["gen_ai.input.messages"], a["gen_ai.input"], a["gen_ai.output.messages"], a["gen_ai.output"])
    eid = lambda s: F.concat(F.lit("otel:"), F.coalesce("trace_id", F.lit("None")), F.lit(":"), F.coalesce(s, F.lit("None")))
    return spans.withColumn("operation", op).filter("operation <> ''").select(
        eid("span_id").alias("event_id"), F.coalesce(mapping[F.col("operation")], F.lit("otel_genai_operation")).alias("event_type"),
        F.coalesce(a["gen_ai.agent.id"], a["service.name"]).alias("actor_id"),
        F.coalesce(a["gen_ai.tool.name"], a["gen_ai.data_source.id"], a["gen_ai.request.model"]).alias("target_id"),
        F.col("start_unix_nano").alias("timestamp_utc"), F.when(F.col("parent_span_id").isNotNull(), eid("parent_span_id")).alias("parent_event_id"),
        F.array(F.concat(F.lit("trace:"), F.coalesce("trace_id", F.lit("None")))).alias("correlation_ids"),
        a["gen_ai.conversation.id"].alias("session_id"), F.sha2(content, 256).alias("content_sha256"), "operation")


def operation_coverage(events: DataFrame) -> DataFrame:
    return events.groupBy("operation").agg(F.count("*").alias("n"))


def coverage_gap(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Envelopes in which no span names a generative-AI operation."""
    a = F.col("attrs")
    op = F.coalesce(a["gen_ai.operation.name"], a["gen_ai.operation_name"], a["operation.name"])
    return spans.groupBy(*keys).agg(F.count_if(op != "").alias("n")).filter("n = 0").select(
        *keys, F.lit("otel_genai_coverage_gap").alias("type"), F.lit("high").alias("severity"))


def log_envelopes(docs: DataFrame) -> DataFrame:
    """Flatten resourceLogs -> scopeLogs -> logRecords."""
    doc = F.col("doc")
    d = docs.withColumn("doc", V.parse("raw"))
    r = d.select("source_id", F.posexplode(V.items(doc, "$.resourceLogs")).alias("resource_index", "g"))
    s = r.select("source_id", "resource_index", F.posexplode(V.items(F.col("g"), "$.scopeLogs")).alias("scope_index", "sg"))
    p = s.select("source_id", "resource_index", "scope_index", F.posexplode(V.items(F.col("sg"), "$.logRecords")).alias("log_index", "log"))
    v = F.col("log")
    return p.withColumn("__a", attributes(V.at(v, "$.attributes"))).select(
        "source_id", "resource_index", "scope_index", "log_index", _spelled(v, "traceId", "trace_id").alias("trace_id"), _spelled(v, "spanId", "span_id").alias("span_id"),
        V.at(v, "$.timeUnixNano", "string").alias("time_unix_nano"), V.at(v, "$.severityNumber", "int").alias("severity_number"),
        V.text(v, "$.severityText").alias("severity_text"), any_value(V.at(v, "$.body")).alias("body"), F.col("__a.map").alias("attrs"),
        F.sha2(F.to_json(v), 256).alias("log_sha256"), F.when(F.col("__a.repeated"), "duplicate_attribute_key").alias("reject"))


def log_diagnostics(logs: DataFrame) -> DataFrame:
    return logs.groupBy("source_id").agg(
        F.count("*").alias("log_records"), F.count_if(F.col("trace_id").isNotNull()).alias("trace_linked"),
        F.count_if(F.col("span_id").isNotNull()).alias("span_linked"))


def kernel_timeline(events: DataFrame, collectors: DataFrame) -> DataFrame:
    """Estimated UTC of kernel-trace rows: collector start plus time since its first event, one second uncertain.

    ``events``: collector_id, ts_ns, kind, summary.  ``collectors``: collector_id, start.
    """
    first = events.filter("ts_ns IS NOT NULL").groupBy("collector_id").agg(F.min("ts_ns").alias("first_ns"))
    # Whole-number division: nanoseconds of more than 104 days do not fit a double.
    us = F.unix_micros("start") + F.expr("(ts_ns - first_ns) div 1000")
    return (events.filter("ts_ns IS NOT NULL").join(first, "collector_id").join(collectors, "collector_id")
            .withColumns({"adjusted": F.timestamp_micros(us), "interval_start": F.timestamp_micros(us - 1_000_000),
                          "interval_end": F.timestamp_micros(us + 1_000_000), "timestamp_quality": F.lit("estimated")})
            .drop("start", "first_ns"))


def trace_nodes(spans: DataFrame) -> DataFrame:
    """Execution nodes of adapted spans: the span itself and its retrieval, tool and model observations."""
    g = F.col("genai")
    has = lambda *ks: sum((F.coalesce(F.map_contains_key("genai", k), F.lit(False)).cast("int") for k in ks), F.lit(0)) > 0
    sid = F.coalesce("span_id", F.concat(F.lit("missing-"), F.substring("span_sha256", 1, 16)))
    base = F.concat(F.lit("otel-span:"), sid)
    agent = F.coalesce(g["gen_ai.agent.id"] != "", F.lit(False)) | F.coalesce(g["gen_ai.agent.name"] != "", F.lit(False))
    flow = F.coalesce(g["gen_ai.workflow.name"] != "", F.lit(False)) | F.coalesce(g["gen_ai.operation.name"] != "", F.lit(False))
    node = lambda ident, kind: F.struct(ident.alias("node_id"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"))
    every = F.array(
        node(base, F.when(agent, "agent").when(flow, "workflow").otherwise("unknown")),
        F.when(has("gen_ai.retrieval.query.text", "gen_ai.retrieval.documents"), node(F.concat(base, F.lit(":retrieval")), "retrieval")),
        F.when(has("gen_ai.tool.name", "gen_ai.tool.type"), node(F.concat(base, F.lit(":tool")), "tool")),
        F.when(has("gen_ai.response.model", "gen_ai.request.model", "gen_ai.provider.name"), node(F.concat(base, F.lit(":model")), "model")))
    flat = spans.select("trace_id", base.alias("base"), F.explode(F.filter(every, lambda x: x.isNotNull())).alias("n"))
    return flat.select("trace_id", "n.node_id", "n.kind", "base")


def trace_edges(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """Observed correlations only: span to its observations, and recorded parent to child."""
    inner = nodes.filter("node_id <> base").select(
        "trace_id", F.col("base").alias("src"), F.col("node_id").alias("dst"), F.lit("correlated_with").alias("relationship"))
    ids = spans.filter("span_id IS NOT NULL").select("trace_id", F.col("span_id").alias("parent_span_id")).distinct()
    linked = spans.filter("span_id IS NOT NULL AND parent_span_id IS NOT NULL").join(ids, ["trace_id", "parent_span_id"], "left_semi")
    return inner.unionByName(linked.select(
        "trace_id", F.concat(F.lit("otel-span:"), "parent_span_id").alias("src"), F.concat(F.lit("otel-span:"), "span_id").alias("dst"),
        F.lit("correlated_with").alias("relationship")))


def trace_problems(spans: DataFrame) -> DataFrame:
    """Orphan parents and duplicate span ids per trace (cycles: ``graph.parent_cycles``)."""
    ids = spans.filter("span_id IS NOT NULL").select("trace_id", F.col("span_id").alias("parent_span_id")).distinct()
    orphan = spans.filter("span_id IS NOT NULL AND parent_span_id IS NOT NULL").join(ids, ["trace_id", "parent_span_id"], "left_anti").select(
        "trace_id", "span_id", F.lit("orphan_parent").alias("problem"))
    twice = spans.filter("span_id IS NOT NULL").groupBy("trace_id", "span_id").agg(F.count("*").alias("n")).filter("n > 1").select(
        "trace_id", "span_id", F.lit("duplicate_span_id").alias("problem"))
    return orphan.unionByName(twice)
