"""Snapshot diffs, authority, as-of and anti joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import authority as A
from ..operators import joins as J
from ..operators import snapshots as S
from ..operators.ordered import time_chunk
from .domains import AGENTIC_SQL, agentic_events, base_events
from .registry import domain, duck, query, table


def diff_sql(a, s, keys, fields, added=None, removed=None, cols=""):
    """Oracle text of a snapshot diff; severities may be SQL over alias ``s``."""
    sev = lambda x: x if x.startswith("CASE") else f"'{x}'"
    ks = ", ".join(f"coalesce(s.{k}, a.{k}) AS {k}" for k in keys)
    on = f"USING ({', '.join(keys)})"
    out = [f"SELECT {ks}, '{t}' AS type, {sev(v)} AS severity, '{f}' AS field FROM a JOIN s {on} WHERE a.{f} IS DISTINCT FROM s.{f}"
           for f, (t, v) in fields.items()]
    k2 = ", ".join(keys)
    if added:
        out.append(f"SELECT {k2}, '{added[0]}' AS type, {sev(added[1])} AS severity, NULL AS field FROM s ANTI JOIN a {on}")
    if removed:
        out.append(f"SELECT {k2}, '{removed[0]}' AS type, {sev(removed[1])} AS severity, NULL AS field FROM a ANTI JOIN s {on}")
    return f"WITH a AS ({duck(a)}), s AS ({duck(s)}) " + " UNION ALL ".join(out)


def diff_query(name, a, s, op, keys, fields, added=None, removed=None):
    @query(name, diff_sql(a, s, keys, fields, added, removed))
    def run(spark, sf):
        return op(domain(spark, sf, a), domain(spark, sf, s)).select(*keys, "type", "severity", "field")
    return run


# J1: RAG corpus over documents
diff_query("j1_rag_corpus",
    lambda d: f"SELECT doc_id AS document_id, {d.sha('text')} AS sha256, lang AS acl_sha256, source AS metadata_sha256 FROM {{documents}} WHERE doc_id % 19 <> 0",
    lambda d: f"SELECT doc_id AS document_id, {d.sha('text || CASE WHEN doc_id % 11 = 0 THEN chr(32) ELSE lang END')} AS x, CASE WHEN doc_id % 11 = 0 THEN {d.sha('lang')} ELSE {d.sha('text')} END AS sha256, CASE WHEN doc_id % 13 = 0 THEN 'open' ELSE lang END AS acl_sha256, CASE WHEN doc_id % 17 = 0 THEN 'x' ELSE source END AS metadata_sha256 FROM {{documents}} WHERE doc_id % 23 <> 0".replace(f"{d.sha('text || CASE WHEN doc_id % 11 = 0 THEN chr(32) ELSE lang END')} AS x, ", ""),
    S.rag_corpus, ["document_id"],
    {"sha256": ("rag_sha256_changed", "critical"), "acl_sha256": ("rag_acl_sha256_changed", "high"),
     "metadata_sha256": ("rag_metadata_sha256_changed", "high")},
    ("rag_document_added", "high"), ("rag_document_removed", "medium"))


# J1: MCP servers over suppliers, MCP tools over parts
def servers(shift):
    return lambda d: f"""SELECT 'srv-' || CAST(s_suppkey AS STRING) AS server_id, 'https://h' || CAST(s_nationkey + CASE WHEN s_suppkey % 9 = {shift} THEN 1 ELSE 0 END AS STRING) AS url,
      'v' || CAST(s_suppkey % 2 AS STRING) AS protocol_version, 'iss' || CAST(CASE WHEN s_acctbal < {shift} * 1000 THEN 1 ELSE 0 END AS STRING) AS authorization_issuer,
      CASE WHEN s_suppkey % 5 = {shift} THEN NULL ELSE 'c' END AS client_id, 'p' AS prompts_sha256, 'r' || CAST((s_suppkey + {shift}) % 50 / 49 AS STRING) AS resources_sha256
      FROM {{supplier}} WHERE s_suppkey % 12 <> {shift}"""


_srv = {"url": "high", "protocol_version": "medium", "authorization_issuer": "critical", "client_id": "high", "prompts_sha256": "high"}


def _servers(shift):
    return lambda d: servers(shift)(d).replace(f", 'r' || CAST((s_suppkey + {shift}) % 50 / 49 AS STRING) AS resources_sha256", ", 'r' AS resources_sha256")


diff_query("j1_mcp_servers", _servers(0), _servers(1), S.mcp_servers, ["server_id"],
           {f: (f"mcp_{f}_changed", v) for f, v in _srv.items()},
           ("unexpected_mcp_server", "critical"), ("missing_approved_mcp_server", "medium"))


def tools(shift):
    return lambda d: f"""SELECT 'srv-' || CAST(p_partkey % 20 AS STRING) AS server_id, 'tool-' || CAST(p_partkey AS STRING) AS tool_name,
      p_name || CASE WHEN p_partkey % 31 = {shift} THEN '!' ELSE '' END AS description_sha256, p_type AS input_schema_sha256,
      CASE WHEN p_size > {40 + shift} THEN 'big' ELSE 'small' END AS output_schema_sha256 FROM {{part}} WHERE p_partkey % 14 <> {shift}"""


diff_query("j1_mcp_tools", tools(2), tools(5), S.mcp_tools, ["server_id", "tool_name"],
           {f: ("mcp_tool_schema_changed", "critical") for f in ("description_sha256", "input_schema_sha256", "output_schema_sha256")},
           ("unexpected_mcp_tool", "critical"))


# J1: A2A cards over customers, skills over (customer, segment)
def cards(shift):
    return lambda d: f"""SELECT 'agent-' || CAST(c_custkey AS STRING) AS agent_id, 'v' || CAST(c_custkey % 7 + CASE WHEN c_custkey % 17 = {shift} THEN 1 ELSE 0 END AS STRING) AS version,
      c_mktsegment AS provider, CAST(c_nationkey AS STRING) AS supported_interfaces_sha256, CASE WHEN c_acctbal < {shift * 500} THEN 'weak' ELSE 'strong' END AS security_schemes_sha256,
      'cap' AS capabilities_sha256, CASE WHEN c_custkey % 29 = {shift} THEN 'ext' END AS extensions_sha256 FROM {{customer}}"""


diff_query("j1_a2a_cards", cards(0), cards(1), S.a2a_cards, ["agent_id"],
           {"version": ("a2a_version_changed", "high"), "provider": ("a2a_provider_changed", "critical"),
            "supported_interfaces_sha256": ("a2a_supported_interfaces_sha256_changed", "critical"),
            "security_schemes_sha256": ("a2a_security_schemes_sha256_changed", "critical"),
            "extensions_sha256": ("a2a_extensions_sha256_changed", "high")})


def skills(shift):
    return lambda d: f"""SELECT DISTINCT 'agent-' || CAST(o_custkey AS STRING) AS agent_id, 'skill-' || o_orderpriority AS skill_id,
      CASE WHEN o_custkey % 21 = {shift} THEN 'new' ELSE 'old' END AS skill_sha256 FROM {{orders}} WHERE o_orderkey % 10 <> {shift}"""


diff_query("j1_a2a_skills", skills(3), skills(4), S.a2a_skills, ["agent_id", "skill_id"],
           {"skill_sha256": ("a2a_skill_changed", "critical")}, ("a2a_unexpected_skill", "critical"))


# J1: skill files, workspace and IDE files over parts
def files(shift):
    return lambda d: f"""SELECT 'skill-' || CAST(p_partkey % 40 AS STRING) AS skill_id, 'f' || CAST(p_partkey AS STRING) AS path,
      p_name || CASE WHEN p_partkey % 27 = {shift} THEN '!' ELSE '' END AS sha256, (p_size % 2 = 0) AS executable FROM {{part}} WHERE p_partkey % 16 <> {shift}"""


_exec = "CASE WHEN s.executable THEN 'critical' ELSE 'high' END"
diff_query("j1_skill_files", files(1), files(6), S.skill_files, ["skill_id", "path"], {"sha256": ("skill_file_changed", _exec)},
           ("skill_file_added", _exec), ("skill_file_removed", "medium"))


def ws_files(shift):
    return lambda d: f"""SELECT 'f' || CAST(p_partkey AS STRING) AS path, p_name || CASE WHEN p_partkey % 27 = {shift} THEN '!' ELSE '' END AS sha256,
      p_size AS size, (p_partkey % 37 = 0) AS is_symlink, CASE WHEN p_size % 3 = 0 THEN 'executable_or_automation' ELSE 'instruction_or_configuration' END AS control_type
      FROM {{part}} WHERE p_partkey % 16 <> {shift}"""


_ctl = "CASE WHEN s.control_type = 'executable_or_automation' THEN 'critical' ELSE 'high' END"


@query("j1_workspace_files", f"""WITH a AS ({duck(ws_files(1))}), s AS ({duck(ws_files(6))})
SELECT path, 'workspace_control_file_changed' AS type, {_ctl} AS severity FROM a JOIN s USING (path) WHERE a.sha256 <> s.sha256
UNION ALL SELECT path, 'workspace_control_file_added', {_ctl} FROM s ANTI JOIN a USING (path)
UNION ALL SELECT path, 'workspace_control_file_removed', 'medium' FROM a ANTI JOIN s USING (path)
UNION ALL SELECT path, 'workspace_control_symlink', 'high' FROM s WHERE is_symlink""")
def j1_ws(spark, sf):
    return S.workspace_files(domain(spark, sf, ws_files(1)), domain(spark, sf, ws_files(6)))


def ide_files(shift):
    return lambda d: f"""SELECT 'f' || CAST(p_partkey AS STRING) AS path, p_name || CASE WHEN p_partkey % 27 = {shift} THEN '!' ELSE '' END AS sha256,
      CASE WHEN p_size % 4 = 0 THEN {d.arr("'ide_config'", "'hooks'")} ELSE {d.arr("'ide_config'")} END AS categories FROM {{part}} WHERE p_partkey % 16 <> {shift}"""


diff_query("j1_ide_surface", ide_files(1), ide_files(6), S.ide_surface, ["path"], {"sha256": ("ide_control_surface_changed", "critical")},
           ("ide_control_surface_added", "CASE WHEN list_contains(s.categories, 'hooks') THEN 'critical' ELSE 'high' END"))


def harnesses(shift):
    return lambda d: f"""SELECT 'h-' || CAST(s_suppkey AS STRING) AS harness_id, 'pkg' AS package, 'v' || CAST(s_suppkey % 3 + CASE WHEN s_suppkey % 8 = {shift} THEN 1 ELSE 0 END AS STRING) AS version,
      CASE WHEN s_acctbal > {shift} * 4000 THEN 'x' ELSE 'y' END AS hooks_sha256, CASE WHEN s_nationkey = {shift} THEN 'q' ELSE 'r' END AS memory_strategy_sha256 FROM {{supplier}}"""


diff_query("j1_harness", harnesses(0), harnesses(1), S.harness, ["harness_id"],
           {f: (f"harness_{f}_changed", S.HARNESS_FIELDS[f]) for f in ("package", "version", "hooks_sha256", "memory_strategy_sha256")})


def adapters(shift):
    return lambda d: f"""SELECT 'n' || CAST(s_suppkey % 10 AS STRING) AS node_id, 'lora-' || CAST(s_suppkey AS STRING) AS name,
      CASE WHEN s_suppkey % 6 = {shift} THEN 'c2' ELSE 'c1' END AS config_sha256 FROM {{supplier}} WHERE s_suppkey % 9 <> {shift}"""


diff_query("j1_runtime_adapters", adapters(0), adapters(1), S.runtime_adapters, ["node_id", "name"],
           {"config_sha256": ("adapter_config_changed", "high")}, ("unexpected_adapter_config", "high"))


def hooks(shift):
    return lambda d: f"""SELECT 'n' || CAST(l_suppkey % 10 AS STRING) AS node_id, 'm' || CAST(l_partkey % 30 AS STRING) AS module_name, l_returnflag AS hook_kind,
      'h' || CAST(l_linenumber AS STRING) AS source_sha256, l_linestatus AS qualname FROM {{lineitem}} WHERE l_orderkey % 70 <> {shift}"""


@query("j1_runtime_hooks", f"""WITH a AS (SELECT DISTINCT * FROM ({duck(hooks(0))})), s AS (SELECT DISTINCT * FROM ({duck(hooks(1))}))
SELECT *, 'unexpected_hook' AS type FROM (SELECT * FROM s EXCEPT SELECT * FROM a)
UNION ALL SELECT *, 'missing_approved_hook' FROM (SELECT * FROM a EXCEPT SELECT * FROM s)""")
def j1_hooks(spark, sf):
    return S.runtime_hooks(domain(spark, sf, hooks(0)), domain(spark, sf, hooks(1))).select(
        "node_id", "module_name", "hook_kind", "source_sha256", "qualname", "type")


@query("j1_model_files", f"""WITH a AS ({duck(files(1))}), s AS ({duck(files(6))})
SELECT CASE WHEN a.path IS NULL THEN 'suspect_only' WHEN s.path IS NULL THEN 'reference_only' WHEN a.sha256 = s.sha256 THEN 'identical' ELSE 'different' END AS status,
       count(*) AS n FROM a FULL JOIN s ON a.path = s.path GROUP BY 1""")
def j1_model(spark, sf):
    return S.model_files(domain(spark, sf, files(1)), domain(spark, sf, files(6))).groupBy("status").agg(F.count("*").alias("n"))


def bom(shift):
    return lambda d: f"""SELECT 'c' || CAST(p_partkey AS STRING) AS component_id, p_type AS kind, p_name AS name, 'v' || CAST(p_size + CASE WHEN p_partkey % 18 = {shift} THEN 1 ELSE 0 END AS STRING) AS version,
      p_brand AS sha256, CASE WHEN p_partkey % 25 = {shift} THEN 'hub' END AS source, '' AS properties FROM {{part}} WHERE p_partkey % 33 <> {shift}"""


@query("j1_bom_components", f"""WITH a AS ({duck(bom(0))}), s AS ({duck(bom(1))})
SELECT coalesce(a.component_id, s.component_id) AS component_id, CASE WHEN s.component_id IS NULL THEN 'missing' WHEN a.component_id IS NULL THEN 'unexpected' ELSE 'modified' END AS change_type,
  CASE WHEN a.component_id IS NULL OR s.component_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.version <> s.version THEN 'version' END, CASE WHEN a.source IS DISTINCT FROM s.source THEN 'source' END) END AS changed_fields
FROM a FULL JOIN s ON a.component_id = s.component_id WHERE a.component_id IS NULL OR s.component_id IS NULL OR a.version <> s.version OR a.source IS DISTINCT FROM s.source""")
def j1_bom(spark, sf):
    return S.bom_components(domain(spark, sf, bom(0)), domain(spark, sf, bom(1)))


def deps(shift):
    return lambda d: f"SELECT DISTINCT 'c' || CAST(l_partkey AS STRING) AS source, 's' || CAST(l_suppkey AS STRING) AS target FROM {{lineitem}} WHERE l_linenumber <> {shift}"


@query("j1_bom_dependencies", f"""WITH a AS ({duck(deps(3))}), s AS ({duck(deps(4))})
SELECT source, target, 'added' AS change FROM (SELECT * FROM s EXCEPT SELECT * FROM a)
UNION ALL SELECT source, target, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM s)""")
def j1_deps(spark, sf):
    rows = lambda shift: lambda d: deps(shift)(d).replace("DISTINCT ", "")  # the operator counts a repeated pair once
    return S.bom_dependencies(domain(spark, sf, rows(3)), domain(spark, sf, rows(4)))


def members(shift):
    return lambda d: f"""SELECT 'h-' || CAST(l_suppkey AS STRING) AS harness_id, CASE l_returnflag WHEN 'A' THEN 'plugin' WHEN 'N' THEN 'skill' ELSE 'dynamic_import' END AS kind,
      'v' || CAST(l_partkey % 60 AS STRING) AS value FROM {{lineitem}} WHERE l_linenumber <> {shift}"""


@query("j1_harness_members", f"""SELECT harness_id, 'unexpected_harness_' || kind AS type, 'critical' AS severity, value FROM (
  SELECT * FROM ({duck(members(2))}) EXCEPT SELECT * FROM ({duck(members(1))}))""")
def j1_members(spark, sf):
    return S.harness_members(domain(spark, sf, members(1)), domain(spark, sf, members(2)))


def signals(shift):
    return lambda d: members(shift)(d).replace("harness_id", "skill_id").replace("'plugin'", "'url'").replace("'skill'", "'capability'").replace("'dynamic_import'", "'sensitive'")


@query("j1_skill_signals", f"""WITH a AS ({duck(signals(1))}), s AS (SELECT DISTINCT * FROM ({duck(signals(2))})), n AS (SELECT * FROM s EXCEPT SELECT * FROM a)
SELECT skill_id, CASE WHEN kind = 'url' THEN 'skill_external_instruction_or_endpoint_drift' ELSE 'skill_capability_expansion' END AS type, 'critical' AS severity, count(*) AS n
  FROM n WHERE kind <> 'sensitive' GROUP BY ALL
UNION ALL SELECT skill_id, 'skill_sensitive_identity_or_memory_access_signal', 'high', count(*) FROM s WHERE kind = 'sensitive' GROUP BY ALL""")
def j1_signals(spark, sf):
    return S.skill_signals(domain(spark, sf, signals(1)), domain(spark, sf, signals(2)).distinct())


# J2 -----------------------------------------------------------------------
def memory_log(d):
    return f"""
    SELECT event_id, ord, CAST(ts AS TIMESTAMP) AS ts, actor_id, tenant_id,
           CASE WHEN k % 100 IN (1, 2, 3, 4, 11, 12, 13, 21, 22, 23) THEN 'memory_write' WHEN k % 100 = 30 THEN 'memory_delete'
                WHEN k % 2 = 0 THEN 'memory_read' ELSE 'other' END AS event_type,
           CASE WHEN k % 100 = 22 OR k % 19 = 6 THEN 'rare-' || CAST(user_id AS STRING) ELSE 'm' || CAST(user_id % 37 AS STRING) END AS memory_id,
           k % 8 AS version, content_sha256, CASE WHEN k % 34 = 8 THEN 'expected' END AS expected_content_sha256,
           CASE WHEN k % 2 = 1 THEN 'src' END AS source_event_id, (k % 3 = 0) AS has_cause,
           CAST({d.ts_add('ts', 'k', 'HOUR')} AS TIMESTAMP) AS expires, 'emb' || CAST(k % 3 AS STRING) AS embedding_model
    FROM ({base_events(d)}) e"""


# The fallback looks at tenants' first operations on the memory id before the read.
J2_SQL = f"""WITH m AS (SELECT * FROM ({duck(memory_log)}) WHERE event_type <> 'other'),
o AS (SELECT *, CASE event_type WHEN 'memory_write' THEN 'w' WHEN 'memory_delete' THEN 'd' ELSE 'r' END AS op FROM m),
st AS (SELECT *,
  last_value(CASE WHEN op = 'w' THEN {{{{'version': version, 'h': content_sha256, 'x': expires, 'e': embedding_model, 'o': ord}}}} END IGNORE NULLS) OVER w AS rec,
  last_value(CASE WHEN op = 'd' THEN {{{{'t': ts, 'o': ord}}}} END IGNORE NULLS) OVER w AS del
  FROM o WINDOW w AS (PARTITION BY tenant_id, memory_id ORDER BY ts, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
born AS (SELECT memory_id, tenant_id AS owner, min(ord) AS born FROM o WHERE op <> 'r' GROUP BY ALL),
orph AS (SELECT event_id, st.memory_id, st.ord, arg_max(owner, born) AS owner FROM st JOIN born ON born.memory_id = st.memory_id AND born < st.ord
  WHERE op = 'r' AND rec IS NULL AND del IS NULL GROUP BY ALL),
fb AS (SELECT orph.event_id, any_value(owner) AS owner,
  arg_max({{{{'version': version, 'h': content_sha256, 'x': expires, 'e': embedding_model, 'o': o.ord}}}}, o.ord) FILTER (op = 'w') AS frec,
  arg_max({{{{'t': ts, 'o': o.ord}}}}, o.ord) FILTER (op = 'd') AS fdel
  FROM orph JOIN o ON o.memory_id = orph.memory_id AND o.tenant_id = orph.owner AND o.ord < orph.ord GROUP BY ALL),
t AS (SELECT st.*, owner, coalesce(rec, frec) AS r, coalesce(del, fdel) AS dl FROM st LEFT JOIN fb USING (event_id)),
z AS (SELECT *, r IS NULL AND dl IS NULL AS lost, CASE WHEN r IS NULL OR dl.o > r.o THEN dl.t END AS dead FROM t)
SELECT 'memory_version_regression_or_replay' AS type, 'critical' AS severity, memory_id, tenant_id, event_id FROM z WHERE op = 'w' AND version <= rec.version
UNION ALL SELECT 'memory_untrusted_writer', 'critical', memory_id, tenant_id, event_id FROM z WHERE op = 'w' AND actor_id NOT IN ('agent-1', 'agent-2', 'agent-3')
UNION ALL SELECT 'memory_missing_source_provenance', 'high', memory_id, tenant_id, event_id FROM z WHERE op = 'w' AND source_event_id IS NULL AND NOT has_cause
UNION ALL SELECT 'memory_cross_tenant_read', 'critical', memory_id, tenant_id, event_id FROM z WHERE op = 'r' AND owner IS NOT NULL
UNION ALL SELECT 'memory_read_without_version_evidence', 'high', memory_id, tenant_id, event_id FROM z WHERE op = 'r' AND lost
UNION ALL SELECT 'memory_read_after_expiry', 'critical', memory_id, tenant_id, event_id FROM z WHERE op = 'r' AND ts >= r.x
UNION ALL SELECT 'memory_read_after_tombstone', 'critical', memory_id, tenant_id, event_id FROM z WHERE op = 'r' AND ts >= dead
UNION ALL SELECT 'memory_read_content_hash_mismatch', 'critical', memory_id, tenant_id, event_id FROM z WHERE op = 'r' AND NOT lost AND expected_content_sha256 IS NOT NULL AND expected_content_sha256 IS DISTINCT FROM r.h
UNION ALL SELECT 'memory_embedding_model_drift', 'high', memory_id, tenant_id, event_id FROM z WHERE op = 'r' AND embedding_model <> r.e""".replace("{{", "{").replace("}}", "}")


@query("j2_memory_integrity", J2_SQL)
def j2(spark, sf):
    m = domain(spark, sf, memory_log)
    return J.memory_integrity(m, time_chunk("ts"), ["agent-1", "agent-2", "agent-3"])


# J3 - J6 ------------------------------------------------------------------
def grants(d):
    return f"""
    SELECT 'g' || CAST(o_orderkey AS STRING) AS grant_id, 'cust-' || CAST(o_custkey AS STRING) AS principal,
           {d.arr("'read'", "'scope-' || CAST(o_orderkey % 6 AS STRING)")} AS scopes,
           CASE WHEN o_orderkey % 5 = 0 THEN 'T' || CAST(o_custkey % 4 AS STRING) END AS tenant,
           CASE WHEN o_orderkey % 7 = 0 THEN '*' WHEN o_orderkey % 7 = 1 THEN 'res-1' END AS resource,
           CASE WHEN o_orderkey % 4 = 0 THEN {d.arr("'audit'", "'fix'")} ELSE {d.arr()} END AS purposes,
           CAST(o_orderdate AS TIMESTAMP) AS not_before, CAST({d.ts_add('o_orderdate', 90, 'DAY')} AS TIMESTAMP) AS expires,
           CASE WHEN o_orderstatus = 'F' THEN CAST({d.ts_add('o_orderdate', 30, 'DAY')} AS TIMESTAMP) END AS revoked,
           (o_orderkey % 29 = 0) AS disabled
    FROM {{orders}}"""


def denies(d):
    return f"""SELECT CASE WHEN c_custkey % 50 = 0 THEN '*' ELSE 'cust-' || CAST(c_custkey AS STRING) END AS principal,
           {d.arr("'scope-' || CAST(c_custkey % 6 AS STRING)")} AS scopes, CASE WHEN c_custkey % 50 = 0 THEN 'T' || CAST(c_custkey % 4 AS STRING) END AS tenant,
           CASE WHEN c_custkey % 3 = 0 THEN 'res-1' END AS resource, {d.arr()} AS purposes,
           CAST(TIMESTAMP '1996-01-01 00:00:00' AS TIMESTAMP) AS not_before, CAST(TIMESTAMP '1999-01-01 00:00:00' AS TIMESTAMP) AS expires,
           CAST(NULL AS TIMESTAMP) AS revoked, false AS disabled FROM {{customer}}"""


def actions(d):
    return f"""SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS action_id, 'cust-' || CAST(o_custkey AS STRING) AS principal,
           CAST(l_shipdate AS TIMESTAMP) AS ts, 'T' || CAST(o_custkey % 4 AS STRING) AS tenant, 'res-' || CAST(l_partkey % 3 AS STRING) AS resource,
           CASE l_returnflag WHEN 'A' THEN 'audit' WHEN 'N' THEN 'fix' END AS purpose, {d.arr("'read'", "'scope-' || CAST(l_orderkey % 6 AS STRING)")} AS required
    FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey"""


_ok = "(x.not_before IS NULL OR ts >= x.not_before) AND (x.expires IS NULL OR ts < x.expires) AND (x.revoked IS NULL OR ts < x.revoked) AND NOT x.disabled AND (x.tenant IS NULL OR x.tenant = a.tenant) AND (x.resource IS NULL OR x.resource = '*' OR x.resource = a.resource) AND (len(x.purposes) = 0 OR list_contains(x.purposes, a.purpose))"


_AUTHORITY = f"""WITH g AS ({duck(grants)}), d AS ({duck(denies)}), a AS ({duck(actions)}),
al AS (SELECT DISTINCT action_id, unnest(x.scopes) AS scope FROM a JOIN g x USING (principal) WHERE {_ok}),
de AS (SELECT DISTINCT action_id, unnest(x.scopes) AS scope FROM a JOIN d x ON x.principal IN (a.principal, '*') WHERE {_ok}),
sc AS (SELECT * FROM al EXCEPT SELECT * FROM de),
rq AS (SELECT DISTINCT action_id, unnest(required) AS scope FROM a),
mi AS (SELECT action_id, count(*) AS missing_scopes, min(scope) AS first_missing FROM (SELECT * FROM rq EXCEPT SELECT * FROM sc) GROUP BY action_id),
he AS (SELECT action_id, count(*) AS scopes FROM sc GROUP BY action_id)"""


@query("j3_temporal_authority", _AUTHORITY + """
SELECT action_id, principal, coalesce(scopes, 0) AS scopes, coalesce(missing_scopes, 0) AS missing_scopes, first_missing, first_missing IS NULL AS authorized
FROM a LEFT JOIN mi USING (action_id) LEFT JOIN he USING (action_id)""")
def j3(spark, sf):
    t = A.temporal_authority(domain(spark, sf, actions), domain(spark, sf, grants), domain(spark, sf, denies))
    return t.select("action_id", "principal", "scopes", "missing_scopes", "first_missing", "authorized")


@query("j3_action_findings", _AUTHORITY + """ SELECT 'action_exceeded_temporal_authority' AS type, 'critical' AS severity, principal AS subject_id, action_id AS event_id FROM a JOIN mi USING (action_id)
UNION ALL SELECT 'temporal_authority_missing_required_approval' AS type, 'critical' AS severity, principal AS subject_id, action_id AS event_id FROM a WHERE purpose = 'audit' AND resource = 'res-0'
UNION ALL SELECT 'authority_backed_by_expired_credential', 'critical', principal, action_id FROM a WHERE ts >= TIMESTAMP '1999-06-01'""")
def j3_findings(spark, sf):
    a = domain(spark, sf, actions).withColumns({
        "approval_required": F.col("purpose") == "audit", "approval_event_id": F.when(F.col("resource") != "res-0", "ok"),
        "credential_expires": F.lit("1999-06-01").cast("timestamp")})
    t = A.temporal_authority(a, domain(spark, sf, grants), domain(spark, sf, denies))
    return A.action_findings(t).select("type", "severity", "subject_id", "event_id")


def principals(extra):
    return lambda d: f"""SELECT 'cust-' || CAST(c_custkey AS STRING) AS principal, {d.arr("'role-' || CAST(c_nationkey AS STRING)")} AS roles,
      CASE WHEN c_custkey % 9 = {extra} THEN {d.arr("'scope-1'", "'scope-2'")} ELSE {d.arr("'scope-1'")} END AS direct_scopes FROM {{customer}}"""


def roles(d):
    return f"""SELECT 'role-' || CAST(n_nationkey AS STRING) AS role_id, {d.arr("'scope-' || CAST(n_regionkey + 2 AS STRING)")} AS scopes FROM {{nation}}"""


def delegations(extra):
    return lambda d: f"""SELECT 'cust-' || CAST(o_custkey AS STRING) AS from_principal, 'cust-' || CAST(o_custkey + 1 AS STRING) AS to_principal,
      {d.arr("'scope-' || CAST(o_orderkey % 400 AS STRING)")} AS scopes FROM {{orders}} WHERE o_orderkey % 40 <> {extra}"""


def tool_catalog(d):
    return f"""SELECT 'tool-' || CAST(p_partkey AS STRING) AS tool_id, (p_size % 2 = 0) AS mutating,
      CASE WHEN p_partkey % 15 = 0 THEN {d.arr()} WHEN p_partkey % 2 = 0 THEN {d.arr("'scope-1'", "'scope-' || CAST(p_partkey % 400 AS STRING)")}
           ELSE {d.arr("'scope-' || CAST(p_partkey % 400 AS STRING)", "'scope-' || CAST(p_partkey % 7 AS STRING)")} END AS requires_scopes FROM {{part}}"""


def _eff_sql(name, extra):
    return f"""{name}p AS ({duck(principals(extra))}), {name}d AS ({duck(delegations(extra))}),
{name} AS (SELECT principal, unnest(direct_scopes) AS scope, 'direct' AS source FROM {name}p
  UNION ALL SELECT principal, unnest(scopes), 'role:' || role_id FROM (SELECT principal, unnest(roles) AS role_id FROM {name}p) JOIN r USING (role_id)
  UNION ALL SELECT to_principal, unnest(scopes), 'delegated_by:' || from_principal FROM {name}d)"""


def _reach_sql(out, eff):
    return f"""{out} AS (SELECT principal, tool_id FROM (SELECT DISTINCT principal, scope FROM {eff}) p
  JOIN (SELECT tool_id, unnest(list_distinct(requires_scopes)) AS scope, len(list_distinct(requires_scopes)) AS needed FROM t) n USING (scope)
  GROUP BY principal, tool_id HAVING count(*) = any_value(needed) UNION ALL SELECT '*', tool_id FROM t WHERE len(requires_scopes) = 0)"""


def _eff(spark, sf, extra):
    return A.effective_scopes(domain(spark, sf, principals(extra)), domain(spark, sf, roles), domain(spark, sf, delegations(extra)))


@query("j5_effective_authority", f"WITH r AS ({duck(roles)}), {_eff_sql('e', 0)} SELECT * FROM e")
def j5(spark, sf):
    return _eff(spark, sf, 0)


_REACH_CTE = f"WITH t AS ({duck(tool_catalog)}), r AS ({duck(roles)}), {_eff_sql('e', 0)}, {_eff_sql('f', 1)}, {_reach_sql('ra', 'e')}, {_reach_sql('rb', 'f')}"


@query("j4_reachable_tools", _REACH_CTE + " SELECT * FROM ra")
def j4(spark, sf):
    e = _eff(spark, sf, 0)
    return A.reachable_tools(e, domain(spark, sf, tool_catalog))


@query("j6_authority_diff", _REACH_CTE + """
SELECT 'effective_authority_expanded' AS type, 'critical' AS severity, principal, NULL AS tool_id, count(*) AS n
  FROM (SELECT principal, scope FROM f EXCEPT SELECT principal, scope FROM e) GROUP BY principal
UNION ALL SELECT 'new_tool_reachability', CASE WHEN mutating THEN 'critical' ELSE 'high' END, principal, tool_id, 1
  FROM (SELECT * FROM rb EXCEPT SELECT * FROM ra) JOIN t USING (tool_id)""")
def j6(spark, sf):
    tools_ = domain(spark, sf, tool_catalog)
    e, f = _eff(spark, sf, 0), _eff(spark, sf, 1)
    return A.authority_diff(e, f, tools_)


# J9 - J11 -----------------------------------------------------------------
@query("j9_poisoned_sessions", f"""WITH {AGENTIC_SQL}, p AS (SELECT DISTINCT content_sha256 FROM ae WHERE k % 20 = 3),
b AS (SELECT session_id, count(*) AS poisoned_context FROM ae WHERE event_type = 'retrieval_result' AND value > 20 AND content_sha256 IN (SELECT content_sha256 FROM p) GROUP BY 1)
SELECT session_id, any_value(poisoned_context) AS poisoned_context, count(*) FILTER (event_type = 'tool_call') AS downstream_tool_calls, count(*) FILTER (event_type = 'consequence') AS consequences
FROM b JOIN ae USING (session_id) GROUP BY session_id""")
def j9(spark, sf):
    e = domain(spark, sf, base_events).withColumn("included_in_prompt", F.col("value") > 20)
    return J.poisoned_sessions(e, e.filter("k % 20 = 3").select(F.col("content_sha256").alias("sha256")))


def expectations(d):
    return """SELECT 'src-' || CAST(s_suppkey AS STRING) AS source_id, (s_suppkey % 2 = 0) AS mandatory, CAST(600 AS BIGINT) AS expected_events,
      CASE WHEN s_suppkey % 5 = 0 THEN CAST(0.5 AS DOUBLE) END AS min_event_ratio, CASE WHEN s_suppkey % 4 = 0 THEN CAST(100.0 AS DOUBLE) END AS max_clock_uncertainty_ms FROM {supplier}"""


def observations(d):
    return """SELECT 'src-' || CAST(l_suppkey + 3 AS STRING) AS source_id, (l_suppkey % 11 <> 0) AS enabled, CAST(count(*) AS BIGINT) AS collected_events,
      CASE WHEN l_suppkey % 13 = 0 THEN 'boom' END AS last_error, CAST(min(l_shipdate) AS TIMESTAMP) AS coverage_start, CAST(max(l_shipdate) AS TIMESTAMP) AS coverage_end,
      CAST(CASE WHEN l_suppkey % 17 = 0 THEN 60 ELSE 0 END AS DOUBLE) AS retention_gap_seconds, CAST(l_suppkey * 3 AS DOUBLE) AS clock_uncertainty_ms
      FROM {lineitem} GROUP BY l_suppkey"""


HEALTH_SQL = f"""WITH e AS ({duck(expectations)}), o AS ({duck(observations)}),
h AS (SELECT source_id, mandatory, CASE WHEN enabled IS NULL THEN 'MISSING' WHEN clock_uncertainty_ms > coalesce(max_clock_uncertainty_ms, 60000) THEN 'DEGRADED'
  WHEN retention_gap_seconds > 0 OR coverage_start > TIMESTAMP '1995-01-20' OR collected_events / expected_events < coalesce(min_event_ratio, 0.95) THEN 'INCOMPLETE'
  WHEN last_error IS NOT NULL THEN 'DEGRADED' WHEN NOT enabled THEN 'DISABLED' ELSE 'AVAILABLE' END AS status FROM e LEFT JOIN o USING (source_id))"""


def _health(spark, sf):
    return J.collector_health(domain(spark, sf, expectations), domain(spark, sf, observations),
                              start=F.lit("1995-01-20 00:00:00").cast("timestamp"))


@query("j10_collector_health", HEALTH_SQL + " SELECT * FROM h")
def j10(spark, sf):
    return _health(spark, sf)


@query("j10_collector_findings", HEALTH_SQL + """ SELECT CASE WHEN mandatory THEN 'mandatory_evidence_source_unavailable' ELSE 'evidence_source_degraded' END AS type,
CASE WHEN mandatory THEN 'critical' ELSE 'high' END AS severity, source_id, status FROM h WHERE status <> 'AVAILABLE'""")
def j10_findings(spark, sf):
    return J.collector_findings(_health(spark, sf))


@query("j10_complete_mandatory", HEALTH_SQL + " SELECT bool_and(NOT mandatory OR status = 'AVAILABLE') AS complete_mandatory FROM h")
def j10_complete(spark, sf):
    return J.complete_mandatory(_health(spark, sf))


@query("j10_unknown_sources", HEALTH_SQL + " SELECT DISTINCT source_id FROM o WHERE source_id NOT IN (SELECT source_id FROM e)")
def j10_unknown(spark, sf):
    return J.unknown_sources(domain(spark, sf, expectations), domain(spark, sf, observations))


def profile(d):
    return """SELECT 'prov-' || CAST(n_regionkey AS STRING) AS provider, n_name AS source, CASE WHEN n_nationkey % 3 = 0 THEN 'conditional' ELSE 'mandatory' END AS requirement, n_nationkey FROM {nation}"""


@query("j11_provider_gaps", f"""WITH p AS ({duck(profile)}), h AS (SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey % 4 <> 1), c AS (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey % 8 = 1)
SELECT provider, source, requirement, CASE WHEN n_nationkey IN (SELECT * FROM h) THEN 'PRESENT' WHEN n_nationkey IN (SELECT * FROM c) THEN 'UNAVAILABLE'
  WHEN requirement = 'mandatory' THEN 'MISSING' ELSE 'NOT_COLLECTED' END AS status, CASE WHEN n_nationkey IN (SELECT * FROM c) THEN 'export disabled' END AS reason FROM p""")
def j11(spark, sf):
    p = domain(spark, sf, profile)
    has = table(spark, sf, "supplier").filter("s_nationkey % 4 <> 1").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    lack = table(spark, sf, "customer").filter("c_nationkey % 8 = 1").select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    return J.provider_gaps(p, p.join(has, "n_nationkey"), p.join(lack, "n_nationkey").withColumn("reason", F.lit("export disabled")))


# J14, J15 -----------------------------------------------------------------
def tool_rows(d):
    return f"""SELECT 'tool-' || CAST(l_partkey % 300 AS STRING) AS tool_name, {d.sha("'id' || CAST(l_partkey % 300 AS STRING) || CASE WHEN l_discount > 0.09 THEN 'x' ELSE '' END")} AS tool_identity_sha256,
      CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) AS event_id, l_tax FROM {{lineitem}}"""


@query("j14_tool_shadowing", f"SELECT tool_name, count(DISTINCT tool_identity_sha256) AS identities FROM ({duck(tool_rows)}) GROUP BY 1 HAVING count(DISTINCT tool_identity_sha256) > 1")
def j14(spark, sf):
    return J.tool_shadowing(domain(spark, sf, tool_rows))


@query("j14_tool_executions", f"""WITH t AS (SELECT *, CASE WHEN l_tax > 0.07 THEN NULL ELSE tool_identity_sha256 END AS tid FROM ({duck(tool_rows)})),
ap AS (SELECT tool_identity_sha256 FROM t WHERE tool_name < 'tool-2' GROUP BY 1)
SELECT 'tool_execution_identity_ambiguous' AS type, 'high' AS severity, event_id FROM t WHERE tid IS NULL
UNION ALL SELECT 'unapproved_tool_identity_executed', 'critical', event_id FROM t WHERE tid IS NOT NULL AND tid NOT IN (SELECT * FROM ap)""")
def j14_exec(spark, sf):
    t = domain(spark, sf, tool_rows)
    approved = t.filter("tool_name < 'tool-2'").select("tool_identity_sha256")
    return J.tool_executions(t.withColumn("tool_identity_sha256", F.when(F.col("l_tax") > 0.07, None).otherwise(F.col("tool_identity_sha256"))), approved)


def births(d):
    return """SELECT 'agent-' || CAST(c_custkey AS STRING) AS agent_id, CASE WHEN c_custkey % 3 = 1 THEN 'agent-' || CAST(c_custkey * 2 AS STRING) END AS parent_agent_id,
      (c_acctbal > 4000) AS children_allowed FROM {customer} WHERE c_custkey % 11 <> 0"""


def deaths(d):
    return "SELECT 'agent-' || CAST(c_custkey AS STRING) AS agent_id, CAST(c_custkey % 5 - 2 AS INT) AS open_children, CAST(c_custkey % 7 - 4 AS INT) AS open_consequences FROM {customer} WHERE c_custkey % 4 = 0"


@query("j15_agent_lifecycle", f"""WITH b AS ({duck(births)}), d AS ({duck(deaths)}), o AS (SELECT DISTINCT 'agent-' || user_id AS agent_id FROM events)
SELECT 'agent_without_birth_certificate' AS type, 'critical' AS severity, agent_id FROM o ANTI JOIN b USING (agent_id)
UNION ALL SELECT 'agent_parent_certificate_missing', 'high', agent_id FROM b WHERE parent_agent_id IS NOT NULL AND parent_agent_id NOT IN (SELECT agent_id FROM b)
UNION ALL SELECT 'unauthorized_child_agent', 'critical', b.agent_id FROM b JOIN b p ON b.parent_agent_id = p.agent_id WHERE NOT p.children_allowed
UNION ALL SELECT 'terminated_agent_has_open_children', 'critical', agent_id FROM d WHERE open_children > 0
UNION ALL SELECT 'terminated_agent_has_open_consequences', 'high', agent_id FROM d WHERE open_consequences > 0""")
def j15(spark, sf):
    observed = table(spark, sf, "events").select(F.concat(F.lit("agent-"), "user_id").alias("agent_id"))
    return J.agent_lifecycle(domain(spark, sf, births), domain(spark, sf, deaths), observed)


# J19 - J26 ----------------------------------------------------------------
def case_files(d):
    return "SELECT CAST(o_orderkey AS STRING) AS file_id, CASE WHEN o_orderkey % 2 = 0 THEN 'a/' ELSE 'b/' END || 'f' || CAST(o_custkey AS STRING) || '.json' AS path FROM {orders}"


def acquisitions(d):
    return """SELECT CAST(c_custkey AS STRING) AS entry_id, CASE WHEN c_custkey % 3 = 0 THEN 'a/' ELSE 'c/' END || 'f' || CAST(c_custkey - c_custkey % 2 AS STRING) || '.json' AS relative_path,
      CASE WHEN c_custkey % 7 = 0 THEN 'b/f' || CAST(c_custkey AS STRING) || '.json' END AS logical_name FROM {customer}"""


@query("j19_acquisition_binding", f"""WITH f AS ({duck(case_files)}), e AS ({duck(acquisitions)}),
n AS (SELECT DISTINCT entry_id, name FROM (SELECT entry_id, relative_path AS name FROM e UNION ALL SELECT entry_id, logical_name FROM e) WHERE name IS NOT NULL),
x AS (SELECT name, count(*) AS exact_n, min(entry_id) AS exact_id FROM n GROUP BY 1),
b AS (SELECT base, count(*) AS base_n, min(entry_id) AS base_id FROM (SELECT DISTINCT entry_id, regexp_extract(name, '[^/]*$', 0) AS base FROM n) GROUP BY 1)
SELECT file_id, path, CASE WHEN exact_n = 1 THEN 'exact' WHEN exact_n > 1 THEN 'ambiguous_exact' WHEN base_n = 1 THEN 'basename' WHEN base_n > 1 THEN 'ambiguous_basename' ELSE 'unbound' END AS binding,
  CASE WHEN exact_n = 1 THEN exact_id WHEN exact_n IS NULL AND base_n = 1 THEN base_id END AS entry_id
FROM f LEFT JOIN x ON path = name LEFT JOIN b ON regexp_extract(path, '[^/]*$', 0) = base""")
def j19(spark, sf):
    return J.acquisition_binding(domain(spark, sf, case_files), domain(spark, sf, acquisitions))


def evidence_rows(d):
    return f"""SELECT CAST(o_orderkey AS STRING) AS evidence_id, 'case-' || CAST(o_custkey AS STRING) AS case_id,
      CASE WHEN o_orderkey % 6 <> 0 THEN CAST({d.ts_add('o_orderdate', 400, 'DAY')} AS TIMESTAMP) END AS retention_until FROM {{orders}}"""


def hold_rows(d):
    return """SELECT 'case-' || CAST(c_custkey AS STRING) AS case_id, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey * 3 AS STRING) END AS evidence_id,
      CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '2000-01-01 00:00:00' END AS released FROM {customer} WHERE c_custkey % 3 = 0"""


@query("j20_retention_disposition", f"""WITH e AS ({duck(evidence_rows)}), h AS (SELECT * FROM ({duck(hold_rows)}) WHERE released IS NULL)
SELECT evidence_id, case_id, CASE WHEN case_id IN (SELECT case_id FROM h WHERE evidence_id IS NULL) THEN 'case legal hold'
  WHEN evidence_id IN (SELECT evidence_id FROM h WHERE evidence_id IS NOT NULL) THEN 'evidence legal hold' END AS blocked_by FROM e WHERE retention_until <= TIMESTAMP '1998-06-01'""")
def j20(spark, sf):
    return J.retention_disposition(domain(spark, sf, evidence_rows), domain(spark, sf, hold_rows), F.lit("1998-06-01").cast("timestamp"))


def tensor_metrics(d):
    return """SELECT 'layers.' || CAST(p_size AS STRING) || '.w' || CAST(p_partkey AS STRING) AS tensor, CASE WHEN p_partkey % 20 = 0 THEN 'shape_mismatch' ELSE 'compared' END AS status,
      CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_retailprice END AS DOUBLE) AS relative_fro_delta, p_partkey FROM {part}"""


@query("j22_changed_tensors", f"""WITH t AS ({duck(tensor_metrics)}) SELECT tensor, relative_fro_delta, CASE WHEN p_partkey % 2 = 0 THEN 0.95 END AS top1_energy_ratio
FROM t WHERE status = 'compared' AND relative_fro_delta > 0 ORDER BY relative_fro_delta DESC, tensor LIMIT 250""")
def j22(spark, sf):
    t = domain(spark, sf, tensor_metrics)
    screen = t.filter("p_partkey % 2 = 0").select("tensor", F.lit(0.95).alias("top1_energy_ratio"), F.lit(2.0).alias("effective_rank"))
    return J.changed_tensors(t, screen).select("tensor", "relative_fro_delta", "top1_energy_ratio")


def ai_records(d):
    return """SELECT CAST(o_orderkey AS STRING) AS record_id, 'p' AS provider, 'm' || CAST(o_custkey % 3 AS STRING) AS model, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE 'v1' END AS model_version,
      o_orderstatus AS policy_config_id, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS output_sha256 FROM {orders}"""


@query("j23_recorded_comparisons", f"""WITH r AS ({duck(ai_records)}), pr AS (SELECT CAST(o_orderkey AS VARCHAR) AS pair_id, CAST(o_orderkey AS VARCHAR) AS original, CAST(o_orderkey + 3 AS VARCHAR) AS comparison FROM orders ),
i AS (SELECT CAST(l_orderkey AS VARCHAR) AS record_id, list(l_partkey % 2 ORDER BY l_linenumber, l_partkey, l_suppkey) AS xs FROM lineitem GROUP BY 1)
SELECT pair_id, (a.provider = b.provider AND a.model = b.model AND a.model_version IS NOT DISTINCT FROM b.model_version AND a.policy_config_id = b.policy_config_id) AS same_configuration,
  coalesce(ia.xs, []) IS NOT DISTINCT FROM coalesce(ib.xs, []) AS same_inputs, a.output_sha256 = b.output_sha256 AS same_output
FROM pr JOIN r a ON a.record_id = original JOIN r b ON b.record_id = comparison LEFT JOIN i ia ON ia.record_id = original LEFT JOIN i ib ON ib.record_id = comparison""")
def j23(spark, sf):
    from pyspark.sql import Window
    o = table(spark, sf, "orders")
    pairs = o.select(F.col("o_orderkey").cast("string").alias("pair_id"), F.col("o_orderkey").cast("string").alias("original"),
                     (F.col("o_orderkey") + 3).cast("string").alias("comparison"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    refs = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("record_id"), F.lit("evidence").alias("kind"),
        F.row_number().over(w).alias("ordinal"), (F.col("l_partkey") % 2).cast("string").alias("sha256"))
    return J.recorded_comparisons(pairs, domain(spark, sf, ai_records), refs)


def card_log(d):
    return f"""SELECT 'agent-' || CAST(user_id % 50 AS STRING) AS agent_id, CAST(ts AS TIMESTAMP) AS ts, ord, content_sha256 AS canonical_sha256, 'v' || CAST(k % 4 AS STRING) AS version,
      CASE WHEN k % 3 = 0 THEN {d.arr("'a'")} ELSE {d.arr("'a'", "'s' || CAST(k % 5 AS STRING)")} END AS skills, {d.arr("'kid' || CAST(k % 6 AS STRING)")} AS kids,
      'i' || CAST(k % 7 AS STRING) AS interfaces_sha256, 's' AS schemes_sha256, 'c' || CAST(k % 2 AS STRING) AS capabilities_sha256 FROM ({base_events(d)}) e"""


@query("j24_card_history", f"""WITH t AS (SELECT *, lag(canonical_sha256) OVER w AS ph, lag(version) OVER w AS pv, lag(skills) OVER w AS ps, lag(kids) OVER w AS pk, lag(interfaces_sha256) OVER w AS pi,
  lag(capabilities_sha256) OVER w AS pc FROM ({duck(card_log)}) WINDOW w AS (PARTITION BY agent_id ORDER BY ts, ord)), z AS (SELECT * FROM t WHERE ph IS NOT NULL)
SELECT 'a2a_card_content_changed_without_version_change' AS type, 'critical' AS severity, agent_id, ord FROM z WHERE ph <> canonical_sha256 AND pv = version
UNION ALL SELECT 'a2a_card_skill_expansion', 'high', agent_id, ord FROM z WHERE NOT list_has_all(ps, skills)
UNION ALL SELECT 'a2a_card_skill_removed', 'medium', agent_id, ord FROM z WHERE NOT list_has_all(skills, ps)
UNION ALL SELECT 'a2a_card_interface_changed', 'critical', agent_id, ord FROM z WHERE pi <> interfaces_sha256
UNION ALL SELECT 'a2a_card_capabilities_changed', 'high', agent_id, ord FROM z WHERE pc <> capabilities_sha256
UNION ALL SELECT 'a2a_card_signing_key_rotation', 'medium', agent_id, ord FROM z WHERE pk <> kids
UNION ALL SELECT 'a2a_card_signing_key_full_replacement', 'high', agent_id, ord FROM z WHERE pk <> kids""")
def j24(spark, sf):
    return J.card_history(domain(spark, sf, card_log), time_chunk("ts"))


def env_controls(d):
    return """SELECT 'sys-' || CAST(c_nationkey AS STRING) AS system, CASE c_custkey % 3 WHEN 0 THEN 'lab' WHEN 1 THEN 'staging' ELSE 'production' END AS environment,
      CASE c_custkey % 5 WHEN 0 THEN 'spiffe_trust_domain' WHEN 1 THEN 'metadata_dsn' WHEN 2 THEN 'object_store_bucket' WHEN 3 THEN 'kms_key_id' ELSE 'oidc_audience' END AS control,
      'v' || CAST(c_custkey % 40 AS STRING) AS value FROM {customer}"""


@query("j25_environment_reuse", f"""SELECT system, control, value, string_agg(DISTINCT environment, ',' ORDER BY environment) AS environments FROM ({duck(env_controls)})
GROUP BY 1, 2, 3 HAVING count(DISTINCT environment) > 1""")
def j25(spark, sf):
    return J.environment_reuse(domain(spark, sf, env_controls))


def environments(d):
    return """SELECT DISTINCT 'sys-' || CAST(s_suppkey AS STRING) AS system, CASE s_nationkey % 3 WHEN 0 THEN 'lab' WHEN 1 THEN 'staging' ELSE 'production' END AS environment,
      (s_suppkey % 4 = 0) AS allows_test_execution, CASE WHEN s_suppkey % 5 = 0 THEN 'allow' WHEN s_suppkey % 5 = 1 THEN NULL ELSE 'deny' END AS default_egress FROM {supplier}"""


@query("j25_environment_gaps", f"""WITH e AS ({duck(environments)}), w AS (SELECT system, x.environment FROM (SELECT DISTINCT system FROM e), (SELECT unnest(['lab','staging','production']) AS environment) x),
m AS (SELECT * FROM w ANTI JOIN e USING (system, environment))
SELECT system, 'environment_missing' AS type, environment FROM m
UNION ALL SELECT system, 'production_allows_test_execution', environment FROM e WHERE environment = 'production' AND allows_test_execution
UNION ALL SELECT system, 'production_egress_not_deny_by_default', 'production' FROM e WHERE environment = 'production' AND default_egress IS DISTINCT FROM 'deny'
UNION ALL SELECT system, 'production_egress_not_deny_by_default', 'production' FROM m WHERE environment = 'production'""")
def j25_gaps(spark, sf):
    e = domain(spark, sf, environments)
    return J.environment_gaps(e, e.select("system").distinct())


@query("j26_provenance_integrity", """WITH a AS (SELECT 'p' || p_partkey AS artifact_id, 'case-1' AS case_id, 'x/' || p_name || '/' || (p_partkey % 400) AS path FROM part WHERE p_partkey % 10 <> 0),
r AS (SELECT CASE WHEN o_orderkey % 500 = 0 THEN 'p' || (o_orderkey / 500 + 1)::INT ELSE 'r' || o_orderkey END AS record_id, CASE WHEN o_orderkey % 700 = 0 THEN 'case-2' ELSE 'case-1' END AS case_id FROM orders),
f AS (SELECT 'r' || l_orderkey AS record_id, 'p' || l_partkey AS artifact_id FROM lineitem),
l AS (SELECT 'p' || l_partkey AS parent_artifact_id, 'p' || CASE WHEN l_linenumber = 7 THEN l_partkey ELSE l_suppkey END AS child_artifact_id FROM lineitem),
ids AS (SELECT artifact_id AS id FROM a UNION ALL SELECT record_id FROM r)
SELECT 'dangling_evidence_reference' AS type, record_id AS id FROM f WHERE artifact_id NOT IN (SELECT artifact_id FROM a)
UNION ALL SELECT 'dangling_lineage_reference', x FROM (SELECT parent_artifact_id AS x FROM l UNION ALL SELECT child_artifact_id FROM l) WHERE x NOT IN (SELECT artifact_id FROM a)
UNION ALL SELECT 'self_lineage', child_artifact_id FROM l WHERE parent_artifact_id = child_artifact_id
UNION ALL SELECT 'duplicate_record_identifier', id FROM ids GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'duplicate_evidence_path', path FROM a GROUP BY path HAVING count(*) > 1
UNION ALL SELECT 'record_case_mismatch', record_id FROM r WHERE case_id = 'case-2'""")
def j26(spark, sf):
    p, o, li = (table(spark, sf, t) for t in ("part", "orders", "lineitem"))
    art = p.filter("p_partkey % 10 <> 0").select(F.concat(F.lit("p"), "p_partkey").alias("artifact_id"), F.when(F.col("p_partkey") >= 0, "case-1").alias("case_id"),
                                                 F.concat(F.lit("x/"), "p_name", F.lit("/"), F.col("p_partkey") % 400).alias("path"))
    rec = o.select(F.when(F.col("o_orderkey") % 500 == 0, F.concat(F.lit("p"), (F.col("o_orderkey") / 500 + 1).cast("int")))
                   .otherwise(F.concat(F.lit("r"), "o_orderkey")).alias("record_id"),
                   F.when(F.col("o_orderkey") % 700 == 0, "case-2").otherwise("case-1").alias("case_id"))
    refs = li.select(F.concat(F.lit("r"), "l_orderkey").alias("record_id"), F.concat(F.lit("p"), "l_partkey").alias("artifact_id"))
    rel = li.select(
        F.concat(F.lit("p"), "l_partkey").alias("parent_artifact_id"),
        F.concat(F.lit("p"), F.when(F.col("l_linenumber") == 7, F.col("l_partkey")).otherwise(F.col("l_suppkey"))).alias("child_artifact_id"))
    return J.provenance_integrity(art, rec, refs, rel)
