"""Order-dependent folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from .detectors import a2a_log, browser_events, cache_records, heartbeats, mcp_log, workload_events
from .domains import base_events
from .registry import domain, duck, query, table


def timeline_rows(d):
    return f"""
    SELECT event_id, ord, CAST(ts AS TIMESTAMP) AS ts, tenant_id, event_type,
           CAST(CASE WHEN k % 10 = 0 THEN k * 1000 ELSE 0 END AS DOUBLE) AS clock_offset_ms,
           CAST(CASE WHEN k % 5 = 0 THEN k * 3000 ELSE 0 END AS DOUBLE) AS clock_uncertainty_ms,
           CASE WHEN k % 33 = 7 THEN 'load LoRA adapter ' || CAST(k AS STRING) ELSE 'op ' || CAST(k AS STRING) END AS summary
    FROM ({base_events(d)}) e"""


TL_SQL = f"""WITH t AS (SELECT *, epoch_us(ts) + CAST(clock_offset_ms * 1000 AS BIGINT) AS adj,
  CAST(clock_uncertainty_ms * 1000 AS BIGINT) AS half FROM ({duck(timeline_rows)}))"""


@query("w2_adjusted_timeline", TL_SQL + """
SELECT event_id, adj AS adjusted_us, adj - half AS start_us, adj + half AS end_us,
       CASE WHEN half = 0 THEN 'observed' ELSE 'observed_with_uncertainty' END AS timestamp_quality FROM t""")
def w2(spark, sf):
    t = W.adjusted_timeline(domain(spark, sf, timeline_rows))
    return t.select("event_id", F.unix_micros("adjusted").alias("adjusted_us"), F.unix_micros("interval_start").alias("start_us"),
                    F.unix_micros("interval_end").alias("end_us"), "timestamp_quality")


@query("w1_ordering_ambiguity", TL_SQL + """
SELECT event_id, coalesce(adj - half <= lag(adj + half) OVER w, false) AS ambiguous_with_previous,
       coalesce(lead(adj - half) OVER w <= adj + half, false) AS ambiguous_with_next
FROM t WINDOW w AS (PARTITION BY tenant_id ORDER BY adj, ord)""")
def w1(spark, sf):
    t = W.adjusted_timeline(domain(spark, sf, timeline_rows))
    return W.ordering_ambiguity(t, ["tenant_id"]).select("event_id", "ambiguous_with_previous", "ambiguous_with_next")


def order_rows(d):
    return f"""SELECT 'order-' || CAST(o_orderkey AS STRING) AS event_id, 'T' || CAST(o_custkey % 4 AS STRING) AS tenant_id, o_orderkey AS ord,
      CAST({d.ts_add("TIMESTAMP '2024-01-01 00:00:00'", 'o_orderkey * 40', 'SECOND')} AS TIMESTAMP) AS ts, CAST(o_custkey % 7 AS DOUBLE) * 1000.0 AS clock_offset_ms,
      CASE WHEN o_custkey % 3 = 0 THEN 5000.0 ELSE 0.0 END AS clock_uncertainty_ms FROM {{orders}}"""


def kernel_rows(d):
    return f"""SELECT 'krn-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS event_id, l_suppkey % 4 AS collector_id,
      CAST(l_orderkey * 100000 + l_partkey AS BIGINT) * 1000000 AS ts_ns, ((CAST(l_orderkey AS BIGINT) * 8 + l_linenumber) * 1000 + l_partkey % 1000) * 1000 + l_suppkey % 1000 AS ord FROM {{lineitem}}"""


@query("u1_merged_timeline", f"""WITH e AS (SELECT 'events' AS source, tenant_id AS key, event_id, ord * 4 AS ord, epoch_us(ts) + CAST(clock_offset_ms * 1000 AS BIGINT) AS adj, CAST(clock_uncertainty_ms * 1000 AS BIGINT) AS half FROM ({duck(timeline_rows)})
 UNION ALL SELECT 'orders', tenant_id, event_id, ord * 4 + 1, epoch_us(ts) + CAST(clock_offset_ms * 1000 AS BIGINT), CAST(clock_uncertainty_ms * 1000 AS BIGINT) FROM ({duck(order_rows)})
 UNION ALL SELECT 'kernel', 'T' || collector_id, event_id, ord * 4 + 2, epoch_us(TIMESTAMP '2024-01-01') + (ts_ns - min(ts_ns) OVER (PARTITION BY collector_id)) // 1000, 1000000 FROM ({duck(kernel_rows)}))
SELECT source, event_id, adj AS adjusted_us, coalesce(adj - half <= lag(adj + half) OVER w, false) AS ambiguous_with_previous, coalesce(lead(adj - half) OVER w <= adj + half, false) AS ambiguous_with_next
FROM e WINDOW w AS (PARTITION BY key ORDER BY adj, ord)""")
def u1(spark, sf):
    from ..sources.traces import kernel_timeline
    adjusted = lambda n, name, rows: W.adjusted_timeline(rows).withColumns({"source": F.lit(name), "key": F.col("tenant_id"), "ord": F.col("ord").cast("bigint") * 4 + n})
    k = domain(spark, sf, kernel_rows)
    c = k.select("collector_id").distinct().withColumn("start", F.lit("2024-01-01").cast("timestamp"))
    kernel = kernel_timeline(k, c).withColumns({"source": F.lit("kernel"), "key": F.concat(F.lit("T"), "collector_id"), "ord": F.col("ord") * 4 + 2})
    t = W.merged_timeline(adjusted(0, "events", domain(spark, sf, timeline_rows)), adjusted(1, "orders", domain(spark, sf, order_rows)), kernel)
    return W.ordering_ambiguity(t, ["key"]).select("source", "event_id", F.unix_micros("adjusted").alias("adjusted_us"), "ambiguous_with_previous", "ambiguous_with_next")


@query("u5_activity_union", """SELECT 'process' AS kind, 'host-' || s_nationkey AS host_id, epoch_us(TIMESTAMP '2024-01-01') + s_suppkey * 1000000 AS us, s_name AS subject, CAST(s_suppkey AS VARCHAR) AS detail FROM supplier
UNION ALL SELECT 'file', 'host-' || p_size, epoch_us(TIMESTAMP '2024-01-01') + p_partkey * 1000000, p_name, p_brand FROM part
UNION ALL SELECT 'network', 'host-' || user_id, epoch_us(ts), 'https://s' || (user_id % 9), event_type FROM events""")
def u5(spark, sf):
    second = lambda n: F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + n)
    text = lambda c: F.col(c).cast("string")
    host = lambda c: F.concat(F.lit("host-"), c)
    p = table(spark, sf, "supplier").select(host("s_nationkey").alias("host_id"), second(F.col("s_suppkey")).alias("ts"), F.col("s_name").alias("subject"), text("s_suppkey").alias("detail"))
    f = table(spark, sf, "part").select(host("p_size").alias("host_id"), second(F.col("p_partkey")).alias("ts"), F.col("p_name").alias("subject"), F.col("p_brand").alias("detail"))
    n = table(spark, sf, "events").select(host("user_id").alias("host_id"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("https://s"), F.col("user_id") % 9).alias("subject"), F.col("event_type").alias("detail"))
    return W.activity_union(p, f, n).select("kind", "host_id", F.unix_micros("ts").alias("us"), "subject", "detail")


@query("w3_first_change_event", TL_SQL + """
SELECT tenant_id, event_id, event_type, summary FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY adj, ord) AS rn
  FROM t WHERE regexp_matches(lower(summary), 'adapter|lora')) WHERE rn = 1""")
def w3(spark, sf):
    return W.first_change_event(W.adjusted_timeline(domain(spark, sf, timeline_rows)), ["tenant_id"])


@query("t1_timeline_head", TL_SQL + " SELECT event_id, event_type FROM t ORDER BY adj, ord LIMIT 200")
def t1(spark, sf):
    t = W.adjusted_timeline(domain(spark, sf, timeline_rows))
    return t.orderBy("adjusted", "ord").limit(200).select("event_id", "event_type")


@query("w4_first_anomalous_run", """WITH d AS (SELECT l_suppkey, CAST(l_partkey % 48 AS INT) AS depth, max(l_quantity) >= 47 AS anomalous
  FROM lineitem GROUP BY ALL),
i AS (SELECT *, row_number() OVER w - sum(CAST(anomalous AS INT)) OVER w AS island FROM d WINDOW w AS (PARTITION BY l_suppkey ORDER BY depth)),
r AS (SELECT l_suppkey, min(depth) AS f, max(depth) AS l, count(*) AS n FROM i WHERE anomalous GROUP BY l_suppkey, island HAVING count(*) >= 2)
SELECT l_suppkey, f AS first_divergence_depth, l AS region_end, n AS region_depths FROM r
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY f) = 1""")
def w4(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 48).cast("int").alias("depth")).agg(
        (F.max("l_quantity") >= 47).alias("anomalous"))
    return W.first_anomalous_run(d, ["l_suppkey"])


@query("w5_cache_key_reuse", f"""WITH t AS (SELECT *, lag(tenant_id) OVER (PARTITION BY cache_type, cache_key ORDER BY ts, ord) AS p FROM ({duck(cache_records)}))
SELECT record_id, cache_type, cache_key, p AS previous_tenant, tenant_id FROM t WHERE p <> tenant_id""")
def w5(spark, sf):
    return W.cache_key_reuse(domain(spark, sf, cache_records))


@query("w6_identity_change", f"""WITH t AS (SELECT *, lag(spiffe_id) OVER (PARTITION BY host_id, process_id ORDER BY ts, ord) AS previous FROM ({duck(workload_events)}))
SELECT event_id, host_id, process_id, previous, spiffe_id FROM t WHERE previous <> spiffe_id""")
def w6(spark, sf):
    return W.workload_identity_change(domain(spark, sf, workload_events))


def session_log(d):
    return f"""
    SELECT event_id, ord, CAST(ts AS TIMESTAMP) AS ts, 's' || CAST(user_id % 30 AS STRING) AS session_id,
           CASE k % 6 WHEN 0 THEN 'session_owner' WHEN 1 THEN 'session_created' WHEN 2 THEN 'stop_requested' WHEN 3 THEN 'tool_call'
                WHEN 4 THEN 'containment' ELSE 'session_access' END AS event_type,
           'u' || CAST((user_id + k / 80) % 30 % 7 AS STRING) AS principal, (k % 24 = 5) AS delegated,
           'agent-' || CAST(user_id % 9 AS STRING) AS agent_id, 'task-' || CAST(user_id % 40 AS STRING) AS task_id,
           CASE k % 7 WHEN 0 THEN 'working' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' END AS state,
           CASE WHEN k % 9 = 0 THEN 'worker-' || CAST(k % 4 AS STRING) END AS executor,
           CASE WHEN k % 8 = 0 THEN true WHEN k % 8 = 1 THEN false END AS cancelable
    FROM ({base_events(d).replace("k / 80", "k")}) e"""


def _session(d):
    return session_log(d).replace("k / 80", "CAST(floor(k / 80) AS BIGINT)")


SESSION = duck(_session)


@query("w7_session_ownership", f"""WITH t AS (SELECT *, last_value(CASE WHEN event_type IN ('session_created', 'session_owner') THEN principal END IGNORE NULLS)
   OVER (PARTITION BY session_id ORDER BY ts, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS owner FROM ({SESSION}))
SELECT CASE WHEN event_type = 'session_access' THEN 'session_access_by_non_owner' ELSE 'session_owner_changed' END AS type, 'critical' AS severity,
  session_id, event_id, owner, principal FROM t
WHERE owner <> principal AND (event_type IN ('session_created', 'session_owner') OR (event_type = 'session_access' AND NOT delegated))""")
def w7(spark, sf):
    return W.session_ownership(domain(spark, sf, _session))


TASKS = f"""t AS ({SESSION}),
g AS (SELECT task_id, arg_min(agent_id, (ts, ord)) AS origin_agent, arg_max(state, (ts, ord)) FILTER (state IS NOT NULL) AS state,
  arg_max(executor, (ts, ord)) FILTER (executor IS NOT NULL) AS executor, arg_max(cancelable, (ts, ord)) FILTER (cancelable IS NOT NULL) AS cancelable
  FROM t GROUP BY task_id)"""


@query("g37_task_rollup", f"WITH {TASKS} SELECT * FROM g")
def g37(spark, sf):
    return W.task_rollup(domain(spark, sf, _session))


@query("w8_outstanding_after_containment", f"""WITH {TASKS},
c AS (SELECT agent_id AS origin_agent, arg_max(event_id, (ts, ord)) AS containment_event FROM t WHERE event_type = 'containment' GROUP BY agent_id)
SELECT task_id, origin_agent, state, containment_event FROM g JOIN c USING (origin_agent) WHERE coalesce(state, 'unknown') NOT IN ('completed', 'failed')""")
def w8(spark, sf):
    t = domain(spark, sf, _session)
    return W.outstanding_after_containment(W.task_rollup(t), t)


@query("w9_post_stop_activity", f"""WITH t AS (SELECT *, last_value(CASE WHEN event_type = 'stop_requested' THEN event_id END IGNORE NULLS)
   OVER (PARTITION BY session_id ORDER BY ts, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stop_event FROM ({SESSION}))
SELECT session_id, event_id, event_type, stop_event FROM t WHERE stop_event IS NOT NULL AND event_type = 'tool_call'""")
def w9(spark, sf):
    return W.post_stop_activity(domain(spark, sf, _session))


_CANCEL = "(mcp_method = 'tasks/cancel' AND state = 'cancelled')"
for _name, _methods in (("w10_task_activity_after_cancel", ["tasks/get", "tools/call"]),
                        ("w10_task_activity_after_cancel_updates", ["tasks/get", "tools/call", "tasks/update"])):
    query(_name, f"""WITH t AS (SELECT *, sum(CASE WHEN {_CANCEL} THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY ts, ord
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM ({duck(mcp_log)}) WHERE task_id IS NOT NULL)
SELECT task_id, event_id, mcp_method AS method FROM t WHERE c > 0 AND mcp_method IN ({", ".join(repr(m) for m in _methods)}) AND state NOT IN ('completed', 'cancelled')""")(
        lambda spark, sf, m=_methods: W.task_activity_after_cancel(domain(spark, sf, mcp_log), m))


@query("w11_round_trip_limit", f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY mrtr_id ORDER BY ts, ord) AS rounds FROM ({duck(mcp_log)}) WHERE mrtr_id IS NOT NULL)
SELECT mrtr_id, event_id, rounds FROM t WHERE rounds > 20""")
def w11(spark, sf):
    return W.round_trip_limit(domain(spark, sf, mcp_log))


@query("w12_cached_catalog_change", f"""WITH t AS (SELECT *, lag(result_sha256) OVER (PARTITION BY mcp_method, server_id, tenant_id ORDER BY ts, ord) AS p
  FROM ({duck(mcp_log)}) WHERE catalog_type IN ('tools', 'resources') OR mcp_method IN ('tools/list', 'resources/read'))
SELECT event_id, mcp_method AS method, server_id, tenant_id FROM t WHERE event = 'cache_read' AND p <> result_sha256""")
def w12(spark, sf):
    return W.cached_catalog_change(domain(spark, sf, mcp_log))


@query("w15_duplicate_ids", """WITH t AS (SELECT CAST(o_custkey AS VARCHAR) AS event_id, o_orderkey AS ord FROM orders)
SELECT event_id, ord FROM t QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ord) > 1""")
def w15(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("event_id"), F.col("o_orderkey").alias("ord"))
    return W.duplicate_ids(o)


def chained_beats(d):
    return f"""
    SELECT 'node-' || CAST(user_id % 25 AS STRING) AS node_id, CAST(ts AS TIMESTAMP) AS ts, ord,
           ord - CASE WHEN k % 30 = 7 THEN 10000000 ELSE 0 END AS seq, {d.sha("CAST(ord AS STRING)")} AS payload_sha256, k
    FROM ({base_events(d)}) e"""


CHAIN_SQL = f"""WITH RECURSIVE t AS (SELECT *, k % 40 <> 3 AND k % 30 <> 7 AS good FROM ({duck(chained_beats)})),
b AS (SELECT *, row_number() OVER w AS rn, CASE WHEN k % 40 = 3 THEN 'tampered' ELSE coalesce(last_value(CASE WHEN good THEN payload_sha256 END IGNORE NULLS) OVER
   (PARTITION BY node_id ORDER BY ts, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), repeat('0', 64)) END AS prev FROM t WINDOW w AS (PARTITION BY node_id ORDER BY ts, ord)),
s(node_id, rn, seq, verdict, last_seq, last_hash) AS (SELECT DISTINCT node_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), repeat('0', 64) FROM b
 UNION ALL SELECT b.node_id, b.rn, b.seq, CASE WHEN b.seq <= last_seq THEN 'replay' WHEN b.prev <> last_hash THEN 'chain_mismatch' ELSE 'accepted' END,
   CASE WHEN b.seq > last_seq AND b.prev = last_hash THEN b.seq ELSE last_seq END, CASE WHEN b.seq > last_seq AND b.prev = last_hash THEN payload_sha256 ELSE last_hash END
   FROM s JOIN b ON b.node_id = s.node_id AND b.rn = s.rn + 1)"""


def chained(spark, sf):
    """Heartbeats with the payload hash of the last good one before, or a tampered one."""
    from ..operators.ordered import prior, time_chunk
    b = domain(spark, sf, chained_beats)
    good = F.when((F.col("k") % 40 != 3) & (F.col("k") % 30 != 7), F.col("payload_sha256"))
    b = prior(b, ["node_id"], ["ts", "ord"], {"h": ("last", good)}, time_chunk("ts"))
    return b.withColumn("prev_hash", F.when(F.col("k") % 40 == 3, "tampered").otherwise(F.col("h")))


@query("w16_heartbeat_continuity", CHAIN_SQL + " SELECT node_id, seq, verdict FROM s WHERE rn > 0")
def w16(spark, sf):
    return W.heartbeat_continuity(chained(spark, sf))


@query("w17_latest_state", f"""SELECT node_id, arg_max(seq, (ts, seq)) AS seq, arg_max(hardware_status, (ts, seq)) AS hardware_status
FROM ({duck(heartbeats)}) GROUP BY node_id""")
def w17(spark, sf):
    h = domain(spark, sf, heartbeats).select("node_id", "ts", "seq", "hardware_status")
    return W.latest_state(h, "node_id", ["ts", "seq"]).select("node_id", "seq", "hardware_status")


@query("w18_node_history", f"""SELECT node_id, seq FROM ({duck(heartbeats)}) QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY seq DESC) <= 50""")
def w18(spark, sf):
    return W.top_k_per_key(domain(spark, sf, heartbeats), "node_id", F.desc("seq"), 50).select("node_id", "seq")


def _history(spark, sf):
    c = table(spark, sf, "conversations")
    lines = c.select("conv_id", (F.col("turn") + 1).alias("position"), F.sha2("text", 256).alias("sha256"))
    changed = (F.col("conv_id") % 5 == 0) & (F.col("turn") >= F.col("conv_id") % 3)
    current = c.filter("NOT (conv_id % 7 = 0 AND turn = 0)").select(
        "conv_id", (F.col("turn") + 1).alias("position"),
        F.when(changed, F.concat(F.lit("Consent: approved. "), "text")).otherwise(F.col("text")).alias("text"))
    return lines, current


HISTORY_SQL = """WITH b AS (SELECT conv_id, turn + 1 AS position, sha256(text) AS h FROM conversations),
cur AS (SELECT conv_id, turn + 1 AS position, CASE WHEN conv_id % 5 = 0 AND turn >= conv_id % 3 THEN 'Consent: approved. ' || text ELSE text END AS text
        FROM conversations WHERE NOT (conv_id % 7 = 0 AND turn = 0)),
j AS (SELECT conv_id, position, b.h AS b, sha256(cur.text) AS c FROM b FULL JOIN cur USING (conv_id, position)),
d AS (SELECT conv_id, min(CASE WHEN b IS DISTINCT FROM c THEN position END) - 1 AS common_prefix_lines, count(b) AS baseline_lines, count(c) AS current_lines
      FROM j GROUP BY conv_id HAVING min(CASE WHEN b IS DISTINCT FROM c THEN position END) IS NOT NULL)"""


@query("w20_history_divergence", HISTORY_SQL + " SELECT * FROM d")
def w20(spark, sf):
    base, cur = _history(spark, sf)
    return W.history_divergence(base, cur.withColumn("sha256", F.sha2("text", 256)), "conv_id")


@query("w20_consent_after_divergence", HISTORY_SQL + """ SELECT conv_id, position, sha256(text) AS sha256 FROM cur JOIN d USING (conv_id)
WHERE position > common_prefix_lines AND (contains(lower(text), 'approved') OR contains(lower(text), 'authorized') OR contains(lower(text), 'permission granted')
 OR contains(lower(text), 'consent') OR contains(lower(text), 'autoapprove'))""")
def w20_consent(spark, sf):
    base, cur = _history(spark, sf)
    div = W.history_divergence(base, cur.withColumn("sha256", F.sha2("text", 256)), "conv_id")
    return W.consent_after_divergence(cur, div, "conv_id")


def credentials(d):
    return f"""
    SELECT 'cred-' || CAST(c_custkey AS STRING) AS credential_id,
           CASE WHEN c_custkey % 3 > 0 THEN 'cred-' || CAST(c_custkey - c_custkey % 3 AS STRING) END AS parent_credential_id,
           'iss' || CAST(c_nationkey % 4 AS STRING) AS issuer, c_custkey, CAST(TIMESTAMP '2024-01-10 00:00:00' AS TIMESTAMP) AS expires,
           CASE WHEN c_acctbal < 0 THEN {d.arr("'read'", "'admin'")} ELSE {d.arr("'read'")} END AS scopes
    FROM {{customer}}"""


@query("w21_credential_lineage", f"""WITH c AS ({duck(credentials)}), u AS (SELECT event_id, 'cred-' || user_id AS credential_id, ts FROM ({duck(base_events)}))
SELECT 'credential_exchange_scope_expansion' AS type, 'critical' AS severity, c.credential_id, NULL AS event_id FROM c JOIN c p ON c.parent_credential_id = p.credential_id
  WHERE len(c.scopes) > len(p.scopes)
UNION ALL SELECT 'credential_used_after_expiry', 'critical', credential_id, event_id FROM u JOIN c USING (credential_id) WHERE ts >= expires
UNION ALL SELECT 'credential_unapproved_issuer', 'critical', credential_id, NULL FROM c WHERE issuer = 'iss3'""")
def w21(spark, sf):
    uses = domain(spark, sf, base_events).select(
        "event_id", F.concat(F.lit("cred-"), "user_id").alias("credential_id"), F.col("ts").cast("timestamp").alias("ts"))
    return W.credential_lineage(domain(spark, sf, credentials), uses, ["iss0", "iss1", "iss2"])
