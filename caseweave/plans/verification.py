"""Hash chains, Merkle roots, manifests, replay, custody and case records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import integrity as I
from ..operators.ordered import prior, seq_chunk, time_chunk
from ..sources import cloud as C
from .domains import base_events
from .feeds import batches, events, trail_record
from .registry import domain, duck, query, table


def chain(spark, sf):
    """Per order: its line items as a hash-chained log, with some rows tampered with."""
    from pyspark.sql import Window
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("log_id"), F.row_number().over(w).alias("seq"), F.col("l_partkey").cast("string").alias("payload"))
    li = li.withColumn("event_hash", F.sha2(F.concat_ws("|", "log_id", "seq", "payload"), 256))
    li = prior(li, ["log_id"], ["seq"], {"p": ("last", "event_hash")}, seq_chunk("seq"))
    cut = (F.col("log_id") % 50 == 7) & (F.col("seq") == 2)
    edited = (F.col("log_id") % 50 == 8) & (F.col("seq") == 3)
    return li.select("log_id", F.col("seq").cast("bigint").alias("seq"), F.when(edited, "edited").otherwise(F.col("payload")).alias("payload"),
                     F.when(cut, "0").otherwise(F.coalesce("p", F.lit(I.ZERO_HASH))).alias("prev_hash"), "event_hash")


@query("w14_hash_chain", """WITH c AS (SELECT l_orderkey AS log_id, count(*) AS events FROM lineitem GROUP BY 1)
SELECT log_id, events, NOT ((log_id % 50 = 7 AND events >= 2) OR (log_id % 50 = 8 AND events >= 3)) AS valid, CASE WHEN log_id % 50 = 7 AND events >= 2 THEN 2 WHEN log_id % 50 = 8 AND events >= 3 THEN 3 END AS first_bad_seq,
 CASE WHEN log_id % 50 = 7 AND events >= 2 THEN 'prev_hash_mismatch' WHEN log_id % 50 = 8 AND events >= 3 THEN 'event_hash_mismatch' END AS error FROM c""")
def w14(spark, sf):
    return I.hash_chain(chain(spark, sf), ["log_id"], F.sha2(F.concat_ws("|", "log_id", "seq", "payload"), 256))


@query("g34_merkle_roots", """WITH RECURSIVE t(k, h) AS (SELECT o_custkey, list(sha256(CAST(o_orderkey AS VARCHAR)) ORDER BY sha256(CAST(o_orderkey AS VARCHAR))) FROM orders GROUP BY 1
UNION ALL SELECT k, list_transform(range(1, (len(h) + 1) // 2 + 1), lambda i: sha256(unhex(h[2 * i - 1] || coalesce(h[2 * i], h[2 * i - 1])))) FROM t WHERE len(h) > 1)
SELECT k, h[1] AS root FROM t WHERE len(h) = 1""")
def g34(spark, sf):
    o = table(spark, sf, "orders")
    return I.merkle_roots(o.select(F.col("o_custkey").alias("k"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("leaf")), ["k"]).select("k", "root")


@query("g34_merkle_root_total", """WITH RECURSIVE l AS (SELECT sha256(concat_ws('|', l_orderkey, l_linenumber, l_partkey)) AS h FROM lineitem),
t(pos, h, n) AS (SELECT row_number() OVER (ORDER BY h) - 1, h, count(*) OVER () FROM l
  UNION ALL SELECT pos // 2, sha256(unhex(max(h) FILTER (pos % 2 = 0) || coalesce(max(h) FILTER (pos % 2 = 1), max(h) FILTER (pos % 2 = 0)))), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY pos // 2, n)
SELECT h AS root FROM t WHERE n = 1""")
def g34_total(spark, sf):
    return I.merkle_roots(table(spark, sf, "lineitem").select(F.sha2(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey"), 256).alias("leaf")), [])


@query("g35_history_roots", """WITH l AS (SELECT o_custkey AS k, sha256(unhex('00') || encode(CAST(o_orderkey AS VARCHAR))) AS h, o_orderkey FROM orders), a AS (SELECT k, list(h ORDER BY o_orderkey) AS h FROM l GROUP BY 1),
t(k, h) AS (SELECT k, h FROM a UNION ALL SELECT k, list_transform(range(1, (len(h) + 1) // 2 + 1), lambda i: CASE WHEN 2 * i <= len(h) THEN sha256(unhex('01' || h[2 * i - 1] || h[2 * i])) ELSE h[2 * i - 1] END) FROM t WHERE len(h) > 1)
SELECT k, h[1] AS root FROM t WHERE len(h) = 1""".replace("WITH l", "WITH RECURSIVE l"))
def g35(spark, sf):
    o = table(spark, sf, "orders")
    return I.history_roots(o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("data")), ["k"]).select("k", "root")


@query("g35_inclusion", """WITH RECURSIVE o AS (SELECT o_custkey AS k, o_orderkey AS data, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
a AS (SELECT k, list(sha256(unhex('00') || encode(CAST(data AS VARCHAR))) ORDER BY pos) AS h FROM o GROUP BY 1),
t(k, h) AS (SELECT k, h FROM a UNION ALL SELECT k, list_transform(range(1, (len(h) + 1) // 2 + 1), lambda i: CASE WHEN 2 * i <= len(h) THEN sha256(unhex('01' || h[2 * i - 1] || h[2 * i])) ELSE h[2 * i - 1] END) FROM t WHERE len(h) > 1),
x AS (SELECT k, data, pos + CASE WHEN data % 13 = 4 THEN 1 ELSE 0 END AS pos, n, data % 11 = 3 OR data % 13 = 4 AS forged FROM o),
p(k, data, place, w, steps) AS (SELECT k, data, pos, n, 0 FROM x WHERE pos < n
  UNION ALL SELECT k, data, place // 2, (w + 1) // 2, steps + CASE WHEN place % 2 = 1 OR place + 1 < w THEN 1 ELSE 0 END FROM p WHERE w > 1)
SELECT x.k, x.data AS entry, x.pos, r.h[1] AS root, p.steps AS path_length, NOT forged AS included
FROM x JOIN t r ON r.k = x.k AND len(r.h) = 1 LEFT JOIN p ON p.k = x.k AND p.data = x.data AND p.w = 1""")
def g35_inclusion(spark, sf):
    """Every order as an entry of its customer's log; some claims have other content, some another place."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("data"))
    pyramid = I.history_pyramid(o, ["k"])
    placed = prior(o, ["k"], ["seq"], {"pos": ("count", F.lit(True))}, seq_chunk("seq", 100_000))
    claims = placed.select("k", F.col("seq").alias("entry"), (F.col("pos") + (F.col("seq") % 13 == 4).cast("int")).alias("pos"),
                           F.when(F.col("seq") % 11 == 3, F.concat("data", F.lit("!"))).otherwise(F.col("data")).alias("data"))
    return I.inclusion(claims, pyramid, ["k"]).drop("data")


@query("v1_replay_check", f"""WITH e AS (SELECT DISTINCT ord // 20 AS s FROM ({duck(base_events)})) SELECT CAST(s AS VARCHAR) AS source_id, CASE WHEN s % 10 = 3 THEN 'FAIL' ELSE 'PASS' END AS status FROM e""")
def v1(spark, sf):
    docs = batches(events(spark, sf), trail_record(), '{"Records":[', "]}")
    project = lambda d: I.output_digest(C.cloudtrail_events(d), ["source_id"], ["ordinal", "event_id", "event_name", "event_sha256", "reject"])
    tampered = docs.withColumn("raw", F.when(F.col("source_id").cast("int") % 10 == 3, F.replace("raw", F.lit("eu-1"), F.lit("eu-2"))).otherwise(F.col("raw")))
    return I.replay_check(project(docs), project(tampered), ["source_id"])


@query("v2_manifest_check", """WITH m AS (SELECT p_partkey % 25 AS case_id, p_partkey AS path, p_name AS h FROM part WHERE p_partkey % 31 <> 0), f AS (SELECT p_partkey % 25 AS case_id, p_partkey AS path, CASE WHEN p_partkey % 97 = 0 THEN 'x' ELSE p_name END AS h FROM part WHERE p_partkey % 150 <> 7)
SELECT case_id, count(*) FILTER (m.h = f.h) AS verified, count(*) FILTER (m.h <> f.h) AS mismatch, count(*) FILTER (m.h IS NOT NULL AND f.h IS NULL) AS missing, count(*) FILTER (m.h IS NULL) AS extra,
 CASE WHEN count(*) FILTER (m.h <> f.h) = 0 AND count(*) FILTER (m.h IS NOT NULL AND f.h IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM m FULL JOIN f USING (case_id, path) GROUP BY 1""")
def v2(spark, sf):
    p, key = table(spark, sf, "part"), F.col("p_partkey")
    base = lambda h: [(key % 25).alias("case_id"), key.alias("path"), h.alias("sha256")]
    return I.manifest_check(p.filter(key % 31 != 0).select(*base(F.col("p_name"))),
                            p.filter(key % 150 != 7).select(*base(F.when(key % 97 == 0, "x").otherwise(F.col("p_name")))), ["case_id"])


@query("v3_custody", """SELECT doc_id AS artifact_id, CASE WHEN doc_id % 9 = 0 THEN 'invalid_base64' WHEN doc_id % 9 = 1 THEN 'size_mismatch' WHEN doc_id % 9 = 2 THEN 'hash_mismatch' ELSE 'ok' END AS status FROM documents""")
def v3(spark, sf):
    i = F.col("doc_id") % 9
    b64 = F.when(i == 0, "*bad*").otherwise(F.base64(F.col("text").cast("binary")))
    return I.custody(table(spark, sf, "documents").select(F.col("doc_id").alias("artifact_id"), b64.alias("base64"), (F.octet_length("text") + F.when(i == 1, 1).otherwise(0)).alias("size"),
                                                          F.when(i == 2, "x").otherwise(F.sha2("text", 256)).alias("sha256")))


def case_log(d):
    return f"""SELECT 'case-' || CAST(user_id AS STRING) AS case_id, CAST(ts AS TIMESTAMP) AS ts, ord,
      CASE k % 7 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'TRIAGE' WHEN 2 THEN 'INVESTIGATING' WHEN 3 THEN 'CONTAINED' WHEN 4 THEN 'RECOVERING' WHEN 5 THEN 'CLOSED' ELSE 'ARCHIVED' END AS status FROM ({base_events(d)}) e"""


_TRANS = " OR ".join(f"(p = '{a}' AND status IN ({', '.join(repr(x) for x in b)}))" for a, b in I.CASE_TRANSITIONS.items() if b)


@query("v5_invalid_transitions", f"""WITH t AS (SELECT *, lag(status) OVER (PARTITION BY case_id ORDER BY ts, ord) AS q FROM ({duck(case_log)})), u AS (SELECT *, coalesce(q, 'OPEN') AS p FROM t)
SELECT case_id, ord, p AS previous, status FROM u WHERE NOT ({_TRANS}) AND NOT (q IS NULL AND status = 'OPEN')""")
def v5(spark, sf):
    return I.invalid_transitions(domain(spark, sf, case_log), time_chunk("ts", 24 * 3600))


@query("v6_ledger_timeline", """SELECT 'case-' || l_orderkey % 50 AS case_id, l_orderkey AS sequence, CASE WHEN l_orderkey % 2 = 0 THEN 'rec-' || l_orderkey END AS record_id FROM (SELECT DISTINCT l_orderkey FROM lineitem)""")
def v6(spark, sf):
    o = table(spark, sf, "lineitem").select("l_orderkey").distinct()
    case = F.concat(F.lit("case-"), F.col("l_orderkey") % 50).alias("case_id")
    ledger = o.select(case, F.col("l_orderkey").alias("sequence"))
    rec = o.filter("l_orderkey % 2 = 0").select(case, F.col("l_orderkey").alias("ledger_sequence"), F.concat(F.lit("rec-"), "l_orderkey").alias("record_id"), F.lit("artifact").alias("record_type"))
    return I.ledger_timeline(ledger, rec).select("case_id", "sequence", "record_id")


@query("v7_hold_states", """SELECT CAST(o_orderkey AS VARCHAR) AS hold_id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 12 NOT IN (3, 6) THEN 'RELEASED' ELSE 'ACTIVE' END AS state,
 CASE WHEN o_orderkey % 12 = 3 THEN 'legal_hold_release_binding_mismatch' WHEN o_orderkey % 12 = 6 THEN 'legal_hold_release_hash_mismatch' END AS error FROM orders""")
def v7(spark, sf):
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")
    hold = o.select(key.cast("string").alias("hold_id"), F.lit("T").alias("tenant_id"), F.col("o_custkey").cast("string").alias("case_id"), F.sha2(key.cast("string"), 256).alias("hold_sha256"))
    rel = o.filter(key % 3 == 0).select(key.cast("string").alias("hold_id"), F.when(key % 12 == 3, "U").otherwise("T").alias("tenant_id"), F.col("o_custkey").cast("string").alias("case_id"),
                                        F.when(key % 12 == 6, "bad").otherwise(F.sha2(key.cast("string"), 256)).alias("hold_sha256"))
    return I.hold_states(hold, rel)


@query("r10_execution_record_errors", """WITH n AS (SELECT o_custkey AS record_id, 'n' || CASE WHEN o_orderkey % 40 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS node_id, CASE WHEN o_orderkey % 30 = 1 THEN 'ghost' ELSE 'agent' END AS kind FROM (SELECT o_orderkey, o_orderkey // 10 AS o_custkey FROM orders)),
e AS (SELECT o_orderkey // 10 AS record_id, 'e' || o_orderkey AS edge_id, 'n' || o_orderkey AS s, 'n' || (o_orderkey - o_orderkey % 10 + (o_orderkey + 3) % 10) AS t, CASE WHEN o_orderkey % 25 = 2 THEN 'liked' ELSE 'invoked' END AS r, CASE WHEN o_orderkey % 35 = 3 THEN 'sure' ELSE 'observed' END AS c FROM orders)
SELECT record_id, 'duplicate_node_id' AS error, node_id AS id FROM n GROUP BY 1, 3 HAVING count(*) > 1
UNION ALL SELECT record_id, 'missing_endpoint', edge_id FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.record_id = e.record_id AND n.node_id = e.s) OR NOT EXISTS (SELECT 1 FROM n WHERE n.record_id = e.record_id AND n.node_id = e.t)
UNION ALL SELECT record_id, 'unsupported_node_kind', node_id FROM n WHERE kind = 'ghost' UNION ALL SELECT record_id, 'unsupported_relationship', edge_id FROM e WHERE r = 'liked' UNION ALL SELECT record_id, 'unsupported_confidence', edge_id FROM e WHERE c = 'sure'""")
def r10(spark, sf):
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")
    rec = F.floor(key / 10).alias("record_id")
    n = lambda x: F.concat(F.lit("n"), x)
    nodes = o.select(rec, n(F.when(key % 40 == 0, key - 1).otherwise(key)).alias("node_id"), F.when(key % 30 == 1, "ghost").otherwise("agent").alias("kind"))
    edges = o.select(rec, F.concat(F.lit("e"), key).alias("edge_id"), n(key).alias("source_node"), n(key - key % 10 + (key + 3) % 10).alias("target_node"),
                     F.when(key % 25 == 2, "liked").otherwise("invoked").alias("relationship"), F.when(key % 35 == 3, "sure").otherwise("observed").alias("confidence"))
    return I.execution_record_errors(nodes, edges)
