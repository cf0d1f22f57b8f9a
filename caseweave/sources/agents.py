"""MCP and A2A exchanges, agent cards, provenance records and inventories."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.ordered import prior
from ..runtime import materialize
from ..schema import union_all
from . import variants as V

# A2A operations by HTTP method and route, and JSON-RPC methods.
A2A_ROUTES = [
    ("POST", r"^/message:send$", "SendMessage"), ("POST", r"^/message:stream$", "SendStreamingMessage"),
    ("GET", r"^/tasks$", "ListTasks"), ("GET", r"^/tasks/[^/]+$", "GetTask"),
    ("POST", r"^/tasks/[^/]+:cancel$", "CancelTask"), ("POST", r"^/tasks/[^/]+:subscribe$", "SubscribeToTask"),
    ("POST", r"^/tasks/[^/]+/pushNotificationConfigs$", "CreateTaskPushNotificationConfig"),
    ("GET", r"^/tasks/[^/]+/pushNotificationConfigs$", "ListTaskPushNotificationConfigs"),
    ("GET", r"^/tasks/[^/]+/pushNotificationConfigs/[^/]+$", "GetTaskPushNotificationConfig"),
    ("DELETE", r"^/tasks/[^/]+/pushNotificationConfigs/[^/]+$", "DeleteTaskPushNotificationConfig"),
    ("GET", r"^/extendedAgentCard$", "GetExtendedAgentCard"),
]
A2A_METHODS = [op for _, _, op in A2A_ROUTES]
STREAM_EVENTS = ["task", "message", "statusUpdate", "artifactUpdate"]
MCP_SPEC = "2026-07-28"


def header(name: str, source: str = "request_headers") -> Column:
    """Header value by lower-case name from a map with any casing."""
    lowered = F.transform_keys(source, lambda k, v: F.lower(k))
    return lowered[name]


def mcp_exchanges(rows: DataFrame) -> DataFrame:
    """Request/response pairs: method, name, header-versus-body divergence, task extension.

    ``rows``: exchange_id, request, response (text), request_headers (map).
    """
    req, res = V.parse("request"), V.parse("response")
    method = V.text(req, "$.method")
    body_name = V.text(req, "$.params.name")
    hm, hn = header("mcp-method"), header("mcp-name")
    task = V.at(req, "$.params.task")
    divergences = F.filter(F.array(
        F.when((hm != "") & (hm != method), F.lit("mcp-method-header-does-not-match-jsonrpc-method")),
        F.when((hn != "") & (body_name != "") & (hn != body_name), F.lit("mcp-name-header-does-not-match-request-name"))),
        lambda x: x.isNotNull())
    reject = F.coalesce(F.when(~F.coalesce(V.text(req, "$.jsonrpc") == "2.0", F.lit(False)), "request_not_json_rpc"),
                        F.when(~F.coalesce(V.text(res, "$.jsonrpc") == "2.0", F.lit(False)), "response_not_json_rpc"),
                        F.when(V.bad_text(req, "$.method", True), "method_missing"))
    truthy_task = task.isNotNull() & ~F.is_variant_null(task) & ~F.to_json(task).isin("false", "0", '""', "{}", "[]")
    return rows.select(
        "exchange_id", F.coalesce(F.when(header("mcp-protocol-version") != "", header("mcp-protocol-version")), F.lit(MCP_SPEC)).alias("protocol_version"),
        method.alias("method"), F.coalesce(body_name, hn).alias("name"), F.sha2("request", 256).alias("request_sha256"),
        F.sha2("response", 256).alias("response_sha256"), (method.startswith("tasks/") | F.coalesce(truthy_task, F.lit(False))).alias("task_extension"),
        divergences.alias("divergences"), reject.alias("reject"))


def a2a_operation(method: Column, path: Column) -> Column:
    route = F.regexp_replace(path, r"[?#].*$", "")
    return F.coalesce(*[F.when((F.upper(method) == m) & route.rlike(p), F.lit(op)) for m, p, op in A2A_ROUTES])


def a2a_exchanges(rows: DataFrame) -> DataFrame:
    """A2A exchanges: protocol version (0.3 when none is sent), extensions, operation, error code.

    ``rows``: exchange_id, binding, http_method, path, request_headers (map), request, response (text), status.
    """
    version = header("a2a-version")
    sent = F.coalesce(version != "", F.lit(False))
    ext = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(header("a2a-extensions"), F.lit("")), ","),
                                                             lambda x: F.trim(x)), lambda x: x != "")))
    req, res = V.parse("request"), V.parse("response")
    rpc = F.col("binding") == "JSONRPC"
    op = F.when(rpc, V.text(req, "$.method")).otherwise(a2a_operation(F.col("http_method"), F.col("path")))
    reject = F.coalesce(
        F.when(~F.col("binding").isin("JSONRPC", "HTTP+JSON"), "unsupported_binding"), F.when(sent & ~version.rlike(r"^[0-9]+\.[0-9]+$"), "invalid_version"),
        F.when(~F.col("path").startswith("/"), "invalid_path"), F.when(~F.col("status").between(100, 599), "invalid_status"),
        F.when(rpc & ~F.coalesce(V.text(req, "$.jsonrpc") == "2.0", F.lit(False)), "request_not_json_rpc"))
    return rows.select(
        "exchange_id", "binding", F.when(sent, version).otherwise("0.3").alias("protocol_version"), (~sent).alias("version_missing"), ext.alias("extensions"),
        op.alias("operation"), F.when(rpc, op.isin(A2A_METHODS)).alias("method_known"), V.at(res, "$.error.code", "int").alias("error_code"),
        F.sha2("request", 256).alias("request_sha256"), F.sha2("response", 256).alias("response_sha256"), reject.alias("reject"))


def sse_events(streams: DataFrame) -> DataFrame:
    """Events of a server-sent-event stream, in sequence; each must carry exactly one event object.

    ``streams``: stream_id, binding, raw.
    """
    blocks = F.split(F.regexp_replace("raw", r"\r\n?", "\n"), r"\n\n+")
    e = streams.select("stream_id", "binding", F.posexplode(blocks).alias("block", "text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.startswith("data:"))
    data = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, "^data: ?", "")), "\n")
    e = e.withColumn("data", data).filter(F.size(lines) > 0).withColumn("doc", V.parse("data"))
    body = F.when(F.col("binding") == "JSONRPC", V.at(F.col("doc"), "$.result")).otherwise(F.col("doc"))
    e = e.withColumn("body", body)
    found = F.filter(F.array(*[F.when(V.at(F.col("body"), f"$.{k}").isNotNull(), F.lit(k)) for k in STREAM_EVENTS]), lambda x: x.isNotNull())
    from pyspark.sql import Window
    w = Window.partitionBy("stream_id").orderBy("block")
    return e.select("stream_id", (F.row_number().over(w) - 1).alias("sequence"), F.when(F.size(found) == 1, found[0]).alias("event_type"),
                    F.sha2("data", 256).alias("payload_sha256"), F.when(F.col("doc").isNull(), "invalid_json").when(F.size(found) != 1, "not_exactly_one_event").alias("reject"))


def agent_cards(cards: DataFrame) -> DataFrame:
    """Summary of agent cards (agent_id, raw)."""
    v = V.parse("raw")
    interfaces = V.items(v, "$.supportedInterfaces")
    ids = F.array_sort(F.filter(F.transform(V.items(v, "$.skills"), lambda s: V.at(s, "$.id", "string")), lambda x: x.isNotNull()))
    reject = F.coalesce(F.when(V.bad_text(v, "$.name", True) | V.bad_text(v, "$.version", True), "name_or_version_missing"),
                        F.when(F.size(interfaces) == 0, "interfaces_missing"))
    return cards.select(
        "agent_id", V.text(v, "$.name").alias("name"), V.text(v, "$.version").alias("version"), F.size(interfaces).alias("interfaces"),
        F.array_join(ids, ",").alias("skill_ids"), F.size(V.items(v, "$.signatures")).alias("signatures"), F.sha2("raw", 256).alias("card_sha256"), reject.alias("reject"))


def card_fields(cards: DataFrame) -> DataFrame:
    """Normalized card attributes for snapshot diffs."""
    v = V.parse("raw")
    part = lambda *names: F.coalesce(*[V.digest(V.at(v, f"$.{n}")) for n in names], F.sha2(F.lit("null"), 256))
    return cards.select("agent_id", V.text(v, "$.version").alias("version"), F.to_json(V.at(v, "$.provider")).alias("provider"),
                        part("supportedInterfaces", "supported_interfaces").alias("supported_interfaces_sha256"),
                        part("securitySchemes", "security_schemes").alias("security_schemes_sha256"), part("capabilities").alias("capabilities_sha256"),
                        part("extensions").alias("extensions_sha256"))


def body_objects(bodies: DataFrame) -> DataFrame:
    """Message, artifact and task objects at any depth of a body, with their JSON path.

    ``bodies``: exchange_id, direction, raw.
    """
    x = V.walk(bodies.select("exchange_id", "direction", V.parse("raw").alias("doc")), ["exchange_id", "direction"], F.col("doc"), indexed=True)
    v = F.col("v")
    t = lambda p: V.text(v, p)
    # Every object sought has one of these names; the other nodes go before any of the costlier looks.
    x = x.filter(F.coalesce(*[V.at(v, f"$.{name}") for name in ("messageId", "artifactId", "id", "taskId")]).isNotNull())
    has = lambda p: V.at(v, p).isNotNull() & ~F.coalesce(F.is_variant_null(V.at(v, p)), F.lit(True))
    kind_is = lambda p, k: V.kind(V.at(v, p)) == k
    obj = lambda kind, ident, task, ctx, suffix, value: F.struct(
        F.lit(kind).alias("kind"), ident.alias("object_id"), task.alias("task_id"), ctx.alias("context_id"),
        F.concat("path", F.lit(suffix)).alias("path"), V.digest(value).alias("object_sha256"))
    none = F.lit(None).cast("string")
    found = F.filter(F.array(
        F.when(t("$.messageId").isNotNull() & kind_is("$.parts", "array") & has("$.role"), obj("message", t("$.messageId"), t("$.taskId"), t("$.contextId"), "", v)),
        F.when(t("$.artifactId").isNotNull() & kind_is("$.parts", "array"), obj("artifact", t("$.artifactId"), none, none, "", v)),
        F.when(t("$.id").isNotNull() & has("$.status.state"), obj("task", t("$.id"), t("$.id"), t("$.contextId"), "", v)),
        F.when(t("$.taskId").isNotNull() & kind_is("$.status", "object") & has("$.contextId"), obj("task", t("$.taskId"), t("$.taskId"), t("$.contextId"), ":status-update", v)),
        F.when(t("$.taskId").isNotNull() & t("$.artifact.artifactId").isNotNull() & has("$.contextId"),
               obj("artifact", t("$.artifact.artifactId"), t("$.taskId"), t("$.contextId"), ":artifact-update", V.at(v, "$.artifact")))),
        lambda o: o.isNotNull())
    return x.select("exchange_id", "direction", F.explode(found).alias("o")).select("exchange_id", "direction", "o.*")


def exchange_graph(exchanges: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Execution graph of A2A exchanges: agents, contexts, protocol exchanges and observed objects.

    ``exchanges``: exchange_id, client_agent_id, server_agent_id.  Repeated
    observations of one task are linked without claiming causation.
    """
    agent = lambda c: F.concat(F.lit("a2a-agent:"), c)
    proto = F.concat(F.lit("a2a-exchange:"), "exchange_id")
    # Written once: nodes, edges, contexts and task chains all read it.
    o = materialize(objects.dropDuplicates(["exchange_id", "direction", "kind", "object_id", "object_sha256"]))
    onode = F.concat(proto, F.lit(":"), "direction", F.lit(":"), "kind", F.lit(":"), "object_id", F.lit(":"), F.substring("object_sha256", 1, 8))
    ctx = F.concat(F.lit("a2a-context:"), "context_id")
    node = lambda df, ident, kind: df.select(ident.alias("node_id"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"))
    nodes = union_all([
        node(exchanges, agent("client_agent_id"), "agent"), node(exchanges, agent("server_agent_id"), "agent"), node(exchanges, proto, "protocol"),
        node(o, onode, F.col("kind")), node(o.filter("context_id IS NOT NULL"), ctx, "context")]).distinct()
    edge = lambda df, s, d, r: df.select(s.alias("src"), d.alias("dst"), F.lit(r).alias("relationship") if isinstance(r, str) else r.alias("relationship"))
    rel = (F.when((F.col("direction") == "request") & (F.col("kind") == "message"), "provided_context")
           .when((F.col("direction") == "response") & F.col("kind").isin("message", "artifact"), "produced").otherwise("observed"))
    tasks = o.filter("kind = 'task'").select("task_id", onode.alias("n")).distinct()
    # Pieces by the beginning of the exchange id: a task that most exchanges mention is no single window.
    piece = F.substring("n", 1, len("a2a-exchange:") + 3)
    chain = prior(tasks, ["task_id"], ["n"], {"prev": ("last", "n")}, piece).filter("prev IS NOT NULL")
    edges = union_all([
        edge(exchanges, agent("client_agent_id"), proto, "communicated_with"), edge(exchanges, proto, agent("server_agent_id"), "communicated_with"),
        edge(o, proto, onode, rel), edge(o.filter("context_id IS NOT NULL"), onode, ctx, "correlated_with"),
        chain.select(F.col("prev").alias("src"), F.col("n").alias("dst"), F.lit("correlated_with").alias("relationship"))])
    return nodes, edges


def blob(content: Column) -> Column:
    return F.when(content.isNotNull(), F.struct(F.sha2(content, 256).alias("sha256"), F.octet_length(content).alias("size"),
                                                F.base64(content.cast("binary")).alias("base64")))


def retrieval_documents(records: DataFrame) -> DataFrame:
    """Candidate and returned documents of retrievals, in rank order.

    ``records``: retrieval_id, query, candidates, returned (arrays of struct document_id, chunk_id, content, score).
    """
    def side(name):
        return records.select("retrieval_id", F.sha2("query", 256).alias("query_sha256"), F.lit(name).alias("list"),
                              F.posexplode(name).alias("pos", "d")).select(
            "retrieval_id", "query_sha256", "list", "pos", "d.document_id", "d.chunk_id", F.sha2("d.content", 256).alias("content_sha256"), "d.score")
    return side("candidates").unionByName(side("returned"))


def memory_records(rows: DataFrame) -> DataFrame:
    """Memory operations with digests of content before, input and after; unknown operations are rejected."""
    return rows.select(
        "memory_id", "operation", "source_execution_id", F.sha2("before", 256).alias("before_sha256"), F.sha2("input", 256).alias("input_sha256"),
        F.sha2("after", 256).alias("after_sha256"), F.when(~F.col("operation").isin("read", "write", "delete", "expire"), "unsupported_operation")
        .when((F.coalesce("memory_id", F.lit("")) == "") | (F.coalesce("source_execution_id", F.lit("")) == ""), "id_missing").alias("reject"))


def mcp_inventory(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Servers and tools of exported inventories (snapshot_id, raw) with content digests."""
    from .files import enveloped
    s = enveloped(docs.withColumn("doc", V.parse("raw")).drop("raw"), "servers")
    v = F.col("row")
    first = lambda *names: F.coalesce(*[F.when(V.text(v, f"$.{n}") != "", V.text(v, f"$.{n}")) for n in names])
    empty = F.sha2(F.lit("[]"), 256)
    s = s.withColumn("server_id", first("server_id", "name", "url"))
    servers = s.select("snapshot_id", "server_id", V.text(v, "$.url").alias("url"), V.text(v, "$.protocol_version").alias("protocol_version"),
                       first("authorization_issuer", "issuer").alias("authorization_issuer"), V.text(v, "$.client_id").alias("client_id"),
                       F.coalesce(V.digest(V.at(v, "$.prompts")), empty).alias("prompts_sha256"), F.coalesce(V.digest(V.at(v, "$.resources")), empty).alias("resources_sha256"))
    t = s.select("snapshot_id", "server_id", F.explode(V.items(v, "$.tools")).alias("tool"))
    x = F.col("tool")
    schema = lambda *names: F.coalesce(*[V.digest(V.at(x, f"$.{n}")) for n in names], F.sha2(F.lit("{}"), 256))
    tools = t.select("snapshot_id", "server_id", V.text(x, "$.name").alias("tool_name"), F.sha2(F.coalesce(V.text(x, "$.description"), F.lit("")), 256).alias("description_sha256"),
                     schema("inputSchema", "input_schema").alias("input_schema_sha256"), schema("outputSchema", "output_schema").alias("output_schema_sha256"))
    return servers, tools


def harness_fields(docs: DataFrame) -> DataFrame:
    """Digest of each configuration section of a harness (snapshot_id, raw), in long form for diffs."""
    v = V.parse("raw")
    plain = ["package", "version", "binary_sha256", "container_digest"]
    hashed = ["prompt_assembly", "middleware", "hooks", "tool_policy", "approval_policy", "memory_strategy", "stop_policy",
              "context_priority", "dynamic_imports", "plugins", "skills"]
    rows = [F.struct(F.lit(p).alias("field"), V.text(v, f"$.{p}").alias("value")) for p in plain]
    rows += [F.struct(F.lit(f"{h}_sha256").alias("field"), F.coalesce(V.digest(V.at(v, f"$.{h}")), F.sha2(F.lit("{}"), 256)).alias("value")) for h in hashed]
    return docs.select("snapshot_id", F.coalesce(V.text(v, "$.harness_id"), V.text(v, "$.name")).alias("harness_id"), F.explode(F.array(*rows)).alias("f")).select(
        "snapshot_id", "harness_id", "f.field", "f.value")


TOOL_CORE = ["protocol", "server_id", "server_url", "cert_fingerprint", "tool_name", "schema_sha256", "version", "authorization_context"]


def tool_identities(tools: DataFrame) -> DataFrame:
    """Identity of a tool: hash over its eight core fields, nulls included."""
    core = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(TOOL_CORE)]), {"ignoreNullFields": "false"})
    return tools.withColumn("tool_identity_sha256", F.sha2(core, 256))


# The fields of a memory record in a snapshot.
MEMORY_FIELDS = ["memory_id", "tenant_id", "version", "content_sha256", "source_event_id", "source_chunk_sha256", "writer_id",
                 "embedding_model", "embedding_version", "vector_id", "created_utc", "expires_utc", "tombstoned_utc"]


def memory_snapshot(records: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, record_count, snapshot_sha256)``: SHA-256 of the sorted list of 13-field records, as compact JSON.

    Records are sorted by tenant, memory id and ``ord``; fields that ``records``
    lacks are null.  A hash over a list runs through it in order, so each key is one
    task's stream of sorted rows; nothing of it is held but the hash.
    """
    fields = sorted(MEMORY_FIELDS)
    value = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("string")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    ranked = records.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], text("tenant_id").alias("__tenant"),
                            text("memory_id").alias("__memory"), F.col("ord").alias("__ord"),
                            F.to_json(F.struct(*[value(c).alias(c) for c in fields]), {"ignoreNullFields": "false"}).alias("__row"))
    named = [f"__{i}" for i in range(len(keys))]
    dealt = (ranked.repartition(*named) if named else ranked.repartition(1)).sortWithinPartitions(*named, "__tenant", "__memory", "__ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, n = None, None, 0

        def out() -> pa.RecordBatch:
            digest.update(b"]")
            return pa.RecordBatch.from_pylist([{**dict(zip(keys, current)), "record_count": n, "snapshot_sha256": digest.hexdigest()}],
                                              schema=to_arrow_schema(schema))

        for b in batches:
            columns = [b.column(c).to_pylist() for c in named]
            for i, row in enumerate(b.column("__row").to_pylist()):
                key = tuple(c[i] for c in columns)
                if digest is None or key != current:
                    if digest is not None:
                        yield out()
                    current, digest, n = key, hashlib.sha256(b"["), 0
                # Non-ASCII characters are escaped, as in the exported snapshot.
                digest.update((b"," if n else b"") + json.dumps(json.loads(row), sort_keys=True, separators=(",", ":")).encode())
                n += 1
        if digest is not None:
            yield out()

    schema = StructType([records.schema[k] for k in keys] + [StructField("record_count", LongType()), StructField("snapshot_sha256", StringType())])
    return dealt.mapInArrow(run, schema)


def bom(components: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Unique components, deduplicated resolvable dependencies, and the errors of both."""
    counts = components.groupBy("system_id", "component_id").agg(F.count("*").alias("n"))
    dup = counts.filter("n > 1").select("system_id", F.lit("duplicate_component").alias("type"), F.col("component_id").alias("id"))
    deps = dependencies.select("system_id", "source", "target").distinct()
    known = counts.select("system_id", "component_id")
    ends = deps.select("system_id", "source", "target", F.explode(F.array("source", "target")).alias("component_id"))
    dangling = ends.join(known, ["system_id", "component_id"], "left_anti")
    good = deps.join(dangling.select("system_id", "source", "target").distinct(), ["system_id", "source", "target"], "left_anti")
    errors = dup.unionByName(dangling.select("system_id", F.lit("dangling_dependency").alias("type"), F.col("component_id").alias("id")).distinct())
    return components.dropDuplicates(["system_id", "component_id"]), good, errors
