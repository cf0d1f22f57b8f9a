"""Causal reachability, taint, traces and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import authority as A
from ..operators import graph as G
from ..runtime import materialize
from .domains import AGENTIC_SQL, agentic_events
from .registry import query, table

REACH_SQL = f"""WITH RECURSIVE {AGENTIC_SQL},
reach(seed, node) AS (
  SELECT event_id, dst FROM ae JOIN edges ON src = event_id WHERE untrusted
  UNION SELECT seed, dst FROM reach JOIN edges ON src = node)"""

CLOSES_SQL = """
closes AS (SELECT CASE WHEN k % 2 = 0 THEN parent_event_id END AS closes_event_id,
                  CASE WHEN k % 25 = 3 THEN content_sha256 END AS closes_content_sha256
           FROM ae WHERE event_type = 'containment')"""
OPEN_WHERE = """event_type = 'consequence'
  AND NOT EXISTS (SELECT 1 FROM closes WHERE closes_event_id = ae.event_id)
  AND NOT EXISTS (SELECT 1 FROM closes WHERE closes_content_sha256 = ae.content_sha256)"""


def with_closures(e):
    contained = F.col("event_type") == "containment"
    return e.withColumns({
        "closes_event_id": F.when(contained & (F.col("k") % 2 == 0), F.col("parent_event_id")),
        "closes_content_sha256": F.when(contained & (F.col("k") % 25 == 3), F.col("content_sha256")),
    })


def seeds(e):
    return e.filter("untrusted").select(F.col("event_id").alias("seed"), F.col("event_id").alias("node"))


@query("open_reachable_consequences", f"""{REACH_SQL}, {CLOSES_SQL}
SELECT ae.event_id, actor_id, tenant_id, session_id, count(DISTINCT seed) AS untrusted_sources
FROM ae JOIN reach ON node = ae.event_id WHERE {OPEN_WHERE}
GROUP BY ALL""")
def open_reachable_consequences(spark, sf):
    e = agentic_events(spark, sf)
    reached = G.seeds_per_node(G.reach_sets(G.causal_edges(e), seeds(e))).select(
        F.col("node").alias("event_id"), F.col("seeds").alias("untrusted_sources"))
    return A.open_consequences(with_closures(e)).join(reached, "event_id").select(
        "event_id", "actor_id", "tenant_id", "session_id", "untrusted_sources")


@query("j7_open_consequences", f"""WITH {AGENTIC_SQL}, {CLOSES_SQL}
SELECT event_id, actor_id, content_sha256 FROM ae WHERE {OPEN_WHERE}""")
def j7(spark, sf):
    return A.open_consequences(with_closures(agentic_events(spark, sf))).select(
        "event_id", "actor_id", "content_sha256")


@query("r1_relation_edges", f"""WITH {AGENTIC_SQL}
SELECT parent_event_id AS src, event_id AS dst, 'parent' AS relation, true AS causal FROM ae WHERE parent_event_id IS NOT NULL
UNION ALL SELECT cause_event_id, event_id, 'cause', true FROM ae WHERE cause_event_id IS NOT NULL
UNION ALL SELECT CAST(ord - 5 AS VARCHAR), event_id, 'correlation', false FROM ae WHERE k % 10 = 4""")
def r1(spark, sf):
    e = agentic_events(spark, sf).withColumn(
        "correlation_ids", F.when(F.col("k") % 10 == 4, F.array((F.col("ord") - 5).cast("string"))))
    return G.relation_edges(e)


def typed_events(spark, sf):
    """Agentic events whose metadata names other events, by the residue of ``k``."""
    e = agentic_events(spark, sf)
    back = lambda n: (F.col("ord") - n).cast("string")
    cols = {field: F.when(F.col("k") % 20 == i, back(i)) for i, field in enumerate(G.REFERENCE_EDGES, 1)}
    cols["correlation_ids"] = F.when(F.col("k") % 20 == 10, F.array(back(50)))
    cols["typed_edges"] = F.when(F.col("k") % 20 == 13, F.array(F.struct(
        back(3).alias("source"), F.lit(None).cast("string").alias("target"),
        F.when(F.col("ord") % 2 == 0, "contains_content_from").otherwise("influenced_by").alias("type"),
        F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("origin"))))
    return e.withColumns(cols)


TYPED_SQL = f"""WITH {AGENTIC_SQL},
raw AS (
  SELECT parent_event_id AS src, event_id AS dst, 'caused_by' AS type, 0.8 AS confidence, 'normalized_parent' AS origin FROM ae WHERE parent_event_id IS NOT NULL
  UNION ALL SELECT cause_event_id, event_id, 'caused_by', 1.0, 'explicit_cause' FROM ae WHERE cause_event_id IS NOT NULL
  UNION ALL SELECT CAST(ord - 50 AS VARCHAR), event_id, 'correlated_with', 0.3, 'explicit_correlation' FROM ae
            WHERE k % 20 = 10 AND EXISTS (SELECT 1 FROM e0 o WHERE o.ord = ae.ord - 50)
  """ + "".join(
    f"UNION ALL SELECT CAST(ord - {i} AS VARCHAR), event_id, '{kind}', 1.0, 'metadata' FROM ae WHERE k % 20 = {i}\n  "
    for i, kind in enumerate(G.REFERENCE_EDGES.values(), 1)) + """
  UNION ALL SELECT CAST(ord - 3 AS VARCHAR), event_id, CASE WHEN ord % 2 = 0 THEN 'contains_content_from' ELSE 'influenced_by' END, 0.5, 'event' FROM ae WHERE k % 20 = 13)"""


@query("r2_typed_edges", TYPED_SQL + """
SELECT src, dst, type, CAST(confidence AS DOUBLE) AS confidence, origin FROM raw WHERE type <> 'influenced_by'""")
def r2(spark, sf):
    return G.typed_edges(typed_events(spark, sf))[0]


@query("r2_unknown_edge_types", TYPED_SQL + " SELECT type, src, dst FROM raw WHERE type = 'influenced_by'")
def r2_unknown(spark, sf):
    return G.typed_edges(typed_events(spark, sf))[1]


RADIUS_SQL = f"""{REACH_SQL},
radius AS (SELECT seed, count(*) AS descendants, count(DISTINCT actor_id) AS affected_agents,
                  count(DISTINCT CASE WHEN event_type = 'tool_call' THEN 'tool-' || (k % 20) END) AS tools,
                  count(*) FILTER (event_type = 'consequence') AS consequences
           FROM reach JOIN ae ON node = ae.event_id GROUP BY seed)"""


def _radius(spark, sf):
    e = agentic_events(spark, sf).withColumn("target_id", F.concat(F.lit("tool-"), F.col("k") % 20))
    return G.blast_radius(e, G.causal_edges(e), seeds(e))


@query("r3_blast_radius", RADIUS_SQL + " SELECT * FROM radius")
def r3(spark, sf):
    return _radius(spark, sf)


@query("r7_cascade", RADIUS_SQL + """
SELECT seed, affected_agents, consequences FROM radius WHERE consequences > 0 AND affected_agents >= 2""")
def r7(spark, sf):
    return G.cascade(_radius(spark, sf))


@query("r4_shortest_causal_paths", f"""WITH RECURSIVE {AGENTIC_SQL},
walk(seed, node, path) AS (
  SELECT event_id, event_id, [ord] FROM ae WHERE untrusted
  UNION SELECT seed, dst, list_append(path, CAST(dst AS BIGINT)) FROM walk JOIN edges ON src = node),
ranked AS (SELECT seed, node, path, row_number() OVER (PARTITION BY seed, node ORDER BY len(path), path) AS rn
           FROM walk JOIN ae ON ae.event_id = node WHERE event_type = 'consequence' AND node <> seed)
SELECT seed, node, array_to_string(path, '>') AS path FROM ranked WHERE rn = 1""")
def r4(spark, sf):
    # Read as edges, order, seeds and targets: written once.
    e = materialize(agentic_events(spark, sf).select("event_id", "ord", "event_type", "untrusted", "parent_event_id", "cause_event_ids"))
    targets = e.filter("event_type = 'consequence'").select(F.col("event_id").alias("node"))
    paths = G.shortest_paths(G.causal_edges(e), e.select("event_id", "ord"), seeds(e), targets)
    return paths.select("seed", "node", F.array_join("path", ">").alias("path"))


@query("r5_claim_support", f"""WITH RECURSIVE {AGENTIC_SQL},
claims AS (SELECT s.event_id AS source, c.event_id AS target, s.event_id || '>' || c.event_id AS claim_id
           FROM ae s JOIN ae c ON c.user_id = s.user_id AND c.event_type = 'consequence'
             AND c.ord > s.ord AND c.ord - s.ord < 800 WHERE s.untrusted),
walk(claim_id, target, node, depth) AS (
  SELECT claim_id, target, source, 0 FROM claims
  UNION SELECT claim_id, target, dst, depth + 1 FROM walk JOIN edges ON src = node
  WHERE depth < 20 AND (node <> target OR depth = 0)),
hits AS (SELECT claim_id, count(*) AS n FROM walk JOIN edges ON src = node
         WHERE dst = target AND depth < 20 AND (node <> target OR depth = 0) GROUP BY claim_id)
SELECT c.claim_id, source, target, coalesce(n, 0) AS path_count, n IS NOT NULL AS supported
FROM claims c LEFT JOIN hits USING (claim_id)""")
def r5(spark, sf):
    e = agentic_events(spark, sf)
    s = e.filter("untrusted").select("user_id", F.col("ord").alias("s_ord"), F.col("event_id").alias("source"))
    c = e.filter("event_type = 'consequence'").select("user_id", "ord", F.col("event_id").alias("target"))
    near = (F.col("ord") > F.col("s_ord")) & (F.col("ord") - F.col("s_ord") < 800)
    claims = s.join(c, "user_id").filter(near).select(
        F.concat_ws(">", "source", "target").alias("claim_id"), "source", "target")
    return G.claim_support(G.causal_edges(e), claims)


TAINT_SQL = f"""{REACH_SQL},
labels AS (SELECT event_id, 'TAINT-' || substr(sha256(event_id || '|' || content_sha256), 1, 16) AS taint_id FROM ae WHERE untrusted),
tainted AS (SELECT event_id, taint_id FROM labels
            UNION SELECT node, taint_id FROM reach JOIN labels ON labels.event_id = seed)"""


def _taint(spark, sf):
    e = agentic_events(spark, sf)
    return G.taint(e, G.causal_edges(e), F.col("untrusted"))


@query("r6_taint_labels", TAINT_SQL + " SELECT event_id, taint_id FROM tainted")
def r6_labels(spark, sf):
    return G.taint_labels(_taint(spark, sf))


@query("r6_taint_lineage", TAINT_SQL + f"""
SELECT ae.event_id, event_type, actor_id, session_id, count(*) AS taints,
       event_type IN ({", ".join(repr(x) for x in G.SINK_TYPES)}) AS is_sink
FROM tainted JOIN ae USING (event_id) GROUP BY ALL""")
def r6(spark, sf):
    return G.taint_lineage(_taint(spark, sf))


@query("r6_taint_sinks", TAINT_SQL + f"""
SELECT event_type, taint_id, count(*) AS n FROM tainted JOIN ae USING (event_id)
WHERE event_type IN ({", ".join(repr(x) for x in G.SINK_TYPES)}) GROUP BY ALL""")
def r6_sinks(spark, sf):
    return G.taint_sinks(_taint(spark, sf))


@query("g13_taint_session_spread", TAINT_SQL + """
SELECT taint_id, count(DISTINCT session_id) AS session_count FROM tainted JOIN ae USING (event_id)
GROUP BY taint_id HAVING count(DISTINCT session_id) > 1""")
def g13(spark, sf):
    return G.taint_spread(_taint(spark, sf))


# Returned parts flow from the part to its supplier, all others from the supplier to the part.
@query("r11_lineage_cycles", """WITH RECURSIVE
ps AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R'),
sp AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag <> 'R'),
ss AS (SELECT DISTINCT sp.s AS a, ps.s AS b FROM sp JOIN ps USING (p)),
down(a, b) AS (SELECT a, b FROM ss UNION SELECT down.a, ss.b FROM down JOIN ss ON ss.a = down.b),
stay AS (SELECT DISTINCT b AS s FROM down WHERE a IN (SELECT a FROM down WHERE a = b))
SELECT 's' || s AS node FROM stay UNION SELECT 'p' || p FROM sp WHERE s IN (SELECT s FROM stay)""")
def r11(spark, sf):
    li = table(spark, sf, "lineitem")
    o, p, s = (F.concat(F.lit(c), F.col(f"l_{n}key")) for c, n in (("o", "order"), ("p", "part"), ("s", "supp")))
    back = F.col("l_returnflag") == "R"
    pair = F.struct(F.when(back, p).otherwise(s).alias("src"), F.when(back, s).otherwise(p).alias("dst"))
    order = F.struct(o.alias("src"), p.alias("dst"))
    return G.below_cycle(li.select(F.explode(F.array(order, pair)).alias("e")).select("e.*"))


AUTH_GRAPH_SQL = f"WITH {AGENTIC_SQL}, t AS (SELECT *, CASE WHEN k % 4 = 0 THEN 'grant-' || (k % 12) END AS authority_id FROM ae)"


def _authority_graph(spark, sf):
    return G.authority_graph(agentic_events(spark, sf).withColumn(
        "authority_id", F.when(F.col("k") % 4 == 0, F.concat(F.lit("grant-"), F.col("k") % 12))))


@query("r12_authority_nodes", AUTH_GRAPH_SQL + """
SELECT event_id AS id, event_type AS kind FROM t
UNION SELECT 'authority:' || authority_id, 'authority' FROM t WHERE authority_id IS NOT NULL""")
def r12_nodes(spark, sf):
    return _authority_graph(spark, sf)[0]


@query("r12_authority_edges", AUTH_GRAPH_SQL + """
SELECT parent_event_id AS src, event_id AS dst, 'parent' AS kind FROM t WHERE parent_event_id IS NOT NULL
UNION ALL SELECT 'authority:' || authority_id, event_id, 'authorizes' FROM t WHERE authority_id IS NOT NULL""")
def r12_edges(spark, sf):
    return _authority_graph(spark, sf)[1]


@query("j8_missing_references", f"""WITH {AGENTIC_SQL},
refs AS (SELECT event_id, parent_event_id AS ref FROM ae WHERE parent_event_id IS NOT NULL
         UNION ALL SELECT event_id, CAST(ord - 37 AS VARCHAR) FROM ae WHERE ord % 10 = 0 AND k % 2 = 0)
SELECT event_id, ref AS missing_reference FROM refs WHERE ref NOT IN (SELECT event_id FROM e0 WHERE event_type <> 'memory_write')""")
def j8(spark, sf):
    from ..operators import joins as J
    e = agentic_events(spark, sf).withColumn(
        "cause_event_ids", F.when((F.col("ord") % 10 == 0) & (F.col("k") % 2 == 0),
                                  F.array((F.col("ord") - 37).cast("string"))))
    return J.missing_references(e, e.filter("event_type <> 'memory_write'").select("event_id"))
