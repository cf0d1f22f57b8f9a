"""Baselines, scores, vectors, tensors and group aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranks as R
from ..operators import rollups as G
from ..operators import statistics as S
from .detectors import a2a_log, browser_events, mcp_log, workload_events
from .domains import base_events
from .registry import brief, domain, duck, query, table


def metric_rows(d):
    return """SELECT CAST(l_orderkey AS STRING) AS request_id, 'p' || CAST(l_partkey % 9 AS STRING) AS prompt_id, l_linenumber AS depth,
      l_returnflag AS metric, l_extendedprice AS value FROM {lineitem}"""


def _r(df, cols, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in cols})


BASE_SQL = f"""WITH t AS ({duck(metric_rows)}),
m AS (SELECT depth, metric, count(*) AS n, median(value) AS median, avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, 0.01) AS q01,
  quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.95) AS q95, quantile_cont(value, 0.99) AS q99, min(value) AS min, max(value) AS max FROM t GROUP BY 1, 2),
b AS (SELECT m.*, (SELECT median(abs(t.value - m.median)) FROM t WHERE t.depth = m.depth AND t.metric = m.metric) AS mad FROM m)"""
STATS = ["median", "mad", "mean", "std", "q01", "q05", "q95", "q99"]


def _baseline(spark, sf):
    return S.baseline(domain(spark, sf, metric_rows).select("depth", "metric", "value"), ["depth", "metric"])


@query("g1_baseline", BASE_SQL + " SELECT depth, metric, n, min, max, " + ", ".join(f"round({c}, 4) AS {c}" for c in STATS) + " FROM b")
def g1(spark, sf):
    return _r(_baseline(spark, sf), STATS).select("depth", "metric", "n", "min", "max", *STATS)


SCORE_SQL = BASE_SQL + """, s AS (SELECT request_id, depth, metric, value, (value - median) / (1.4826 * mad) AS z FROM t JOIN b USING (depth, metric))"""


@query("g3_scored_measurements", SCORE_SQL + """ SELECT depth, metric, count(*) AS n, round(avg(z), 4) AS mean_z, round(max(abs(z)), 4) AS max_abs_z,
 count(*) FILTER (abs(z) >= 1.5) AS anomalies FROM s GROUP BY 1, 2""")
def g3(spark, sf):
    s = S.score(domain(spark, sf, metric_rows), _baseline(spark, sf), ["depth", "metric"], threshold=1.5)
    return s.groupBy("depth", "metric").agg(
        F.count("*").alias("n"), F.round(F.avg("robust_z"), 4).alias("mean_z"), F.round(F.max("abs_robust_z"), 4).alias("max_abs_z"),
        F.count_if("anomalous").alias("anomalies"))


@query("g3_depth_maxima", SCORE_SQL + """ SELECT depth, round(max(abs(z)), 4) AS max_abs_z, arg_max(metric, (abs(z), metric)) AS metric_at_max FROM s GROUP BY depth""")
def g3_max(spark, sf):
    s = S.score(domain(spark, sf, metric_rows), _baseline(spark, sf), ["depth", "metric"], threshold=1.5)
    return _r(S.depth_maxima(s, ["depth"]), ["max_abs_z"]).select("depth", "max_abs_z", "metric_at_max")


@query("g2_robust_z", """WITH t AS (SELECT o_orderkey AS id, o_totalprice AS x, o_custkey % 5 * 1000.0 AS median, CASE WHEN o_custkey % 3 = 0 THEN 0.0 ELSE 500.0 END AS mad,
 CASE WHEN o_custkey % 2 = 0 THEN 0.0 ELSE 700.0 END AS std FROM orders)
SELECT id, CASE WHEN mad > 0 THEN 'mad' WHEN std > 0 THEN 'std' ELSE 'degenerate' END AS method,
 CASE WHEN mad > 0 THEN round((x - median) / (1.4826 * mad), 4) WHEN std > 0 THEN round((x - median) / std, 4) WHEN x = median THEN 0.0 ELSE sign(x - median) * 'inf'::DOUBLE END AS z FROM t""")
def g2(spark, sf):
    o = table(spark, sf, "orders")
    m = (F.col("o_custkey") % 5 * 1000.0)
    z, how = S.robust_z(F.col("o_totalprice"), m, F.when(F.col("o_custkey") % 3 == 0, 0.0).otherwise(500.0), m,
                        F.when(F.col("o_custkey") % 2 == 0, 0.0).otherwise(700.0))
    return o.select(F.col("o_orderkey").alias("id"), how.alias("method"), F.round(z, 4).alias("z"))


@query("g4_depth_summary", f"""WITH t AS ({duck(metric_rows)}) SELECT depth, metric, count(*) AS samples, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.05), 4) AS p05,
 round(median(value), 4) AS median, round(quantile_cont(value, 0.95), 4) AS p95 FROM t GROUP BY 1, 2""")
def g4(spark, sf):
    s = S.depth_summary(domain(spark, sf, metric_rows).select("depth", "metric", "value"), ["depth", "metric"])
    return _r(s, ["p05", "median", "p95"])


@query("t3_divergence_ranking", f"""WITH t AS ({duck(metric_rows)}) SELECT depth, metric, round(quantile_cont(value, 0.95), 4) AS p95 FROM t GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 15""")
def t3(spark, sf):
    s = S.depth_summary(domain(spark, sf, metric_rows).select("depth", "metric", "value"), ["depth", "metric"])
    return s.withColumn("p95", F.round("p95", 4)).orderBy(F.desc("p95"), "depth", "metric").limit(15).select("depth", "metric", "p95")


@query("s23_attestation_measurements", """SELECT CAST(o_orderkey AS VARCHAR) AS request_id, 'p' AS prompt_id, CAST(o_custkey % 3 * 8 AS INT) AS depth, m AS metric,
 CASE m WHEN 'cosine_to_exact_approved_activation' THEN 0.5 ELSE o_totalprice END AS value
FROM orders, (SELECT unnest(['cosine_to_exact_approved_activation', 'relative_l2_to_exact_approved_activation']) AS m) x WHERE o_orderkey % 2 = 0""")
def s23(spark, sf):
    o = table(spark, sf, "orders")
    inner = F.create_map(F.lit(S.TARGET_METRICS[0]), F.lit(0.5), F.lit(S.TARGET_METRICS[1]), F.col("o_totalprice"), F.lit("other"), F.lit(1.0))
    rows = o.select(F.col("o_orderkey").cast("string").alias("request_id"), F.lit("p").alias("prompt_id"),
                    F.when(F.col("o_orderkey") % 2 == 0, "ok").otherwise("failed").alias("status"), F.lit("activation_attestation").alias("event_type"),
                    F.create_map((F.col("o_custkey") % 3 * 8).cast("string"), inner).alias("measurements"))
    return S.measurements(rows)


# Vectors ------------------------------------------------------------------
def vectors(spark, sf, suspect=False):
    e = table(spark, sf, "embeddings")
    vec = F.transform("embedding", lambda x, i: x.cast("double") * F.when(i % 3 == 0, 0.8).otherwise(1.1)) if suspect else \
        F.transform("embedding", lambda x: x.cast("double"))
    return e.select(F.col("vec_id").alias("prompt_id"), (F.col("vec_id") % 4).cast("int").alias("depth"),
                    (F.col("label") < 5).alias("positive"), vec.alias("vec"))


VEC_SQL = """WITH v AS (SELECT vec_id, CAST(vec_id % 4 AS INT) AS depth, label < 5 AS positive, embedding FROM embeddings),
x AS (SELECT vec_id, depth, positive, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM v),
raw AS (SELECT depth, i, avg(x) FILTER (positive) - avg(x) FILTER (NOT positive) AS delta FROM x GROUP BY 1, 2),
nr AS (SELECT depth, sqrt(sum(delta * delta)) AS n FROM raw GROUP BY 1),
dir AS (SELECT depth, i, delta / (n + 1e-12) AS d FROM raw JOIN nr USING (depth)),
pa AS (SELECT vec_id, depth, positive, sum(x * d) AS p FROM x JOIN dir USING (depth, i) GROUP BY 1, 2, 3),
ps AS (SELECT vec_id, depth, positive, sum(x * d * CASE WHEN i % 3 = 0 THEN 0.8 ELSE 1.1 END) AS p FROM x JOIN dir USING (depth, i) GROUP BY 1, 2, 3)"""


def _pm(src):
    return f"""(SELECT depth, avg(p) FILTER (positive) - avg(p) FILTER (NOT positive) AS separation,
  (avg(p) FILTER (positive) - avg(p) FILTER (NOT positive)) / (sqrt(((count(*) FILTER (positive) - 1) * var_samp(p) FILTER (positive) + (count(*) FILTER (NOT positive) - 1) * var_samp(p) FILTER (NOT positive)) / (count(*) - 2)) + 1e-12) AS cohens_d,
  (SELECT avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) FROM {src} a, {src} b WHERE a.depth = o.depth AND b.depth = o.depth AND a.positive AND NOT b.positive) AS auc FROM {src} o GROUP BY depth)"""


@query("g30_activation_directions", VEC_SQL + " SELECT depth, i AS dim, round(d, 6) AS direction FROM dir")
def g30(spark, sf):
    d = S.directions(vectors(spark, sf))
    return d.select("depth", F.posexplode("direction").alias("dim", "direction")).select(
        "depth", F.col("dim").cast("bigint").alias("dim"), F.round("direction", 6).alias("direction"))


@query("g31_projection_metrics", VEC_SQL + f" SELECT depth, round(separation, 6) AS separation, round(cohens_d, 6) AS cohens_d, round(auc, 6) AS auc FROM {_pm('pa')}")
def g31(spark, sf):
    v = vectors(spark, sf)
    m = S.projection_metrics(S.projections(v, S.directions(v)))
    return _r(m, ["separation", "cohens_d", "auc"], 6).select("depth", "separation", "cohens_d", "auc")


@query("g31_metric_comparison", VEC_SQL + f""", a AS {_pm('pa')}, s AS {_pm('ps')}
SELECT depth, round(s.auc - a.auc, 6) AS auc_delta, round(s.cohens_d - a.cohens_d, 6) AS cohens_d_delta, round(s.separation / a.separation, 6) AS separation_ratio FROM a JOIN s USING (depth)""")
def g31_cmp(spark, sf):
    v = vectors(spark, sf)
    d = S.directions(v)
    a, s = S.projection_metrics(S.projections(v, d)), S.projection_metrics(S.projections(vectors(spark, sf, True), d))
    return _r(S.compare_metrics(a, s), ["auc_delta", "cohens_d_delta", "separation_ratio"], 6)


MATCH_SQL = """WITH x AS (SELECT vec_id, CAST(vec_id % 4 AS INT) AS depth, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS r FROM embeddings),
y AS (SELECT *, r * CASE WHEN i % 3 = 0 THEN 0.8 ELSE 1.1 END AS s FROM x),
m AS (SELECT vec_id, depth, sum(r * s) / (sqrt(sum(r * r)) * sqrt(sum(s * s))) AS c, sqrt(sum((s - r) * (s - r))) / sqrt(sum(r * r)) AS l FROM y GROUP BY 1, 2)"""


@query("g32_matched_delta", MATCH_SQL + """ SELECT depth, round(avg(c), 6) AS mean_cosine, round(min(c), 6) AS min_cosine, round(avg(l), 6) AS mean_relative_l2, round(max(l), 6) AS max_relative_l2 FROM m GROUP BY depth""")
def g32(spark, sf):
    m = S.matched_delta(vectors(spark, sf), vectors(spark, sf, True))
    return _r(m, ["mean_cosine", "min_cosine", "mean_relative_l2", "max_relative_l2"], 6)


@query("g32_curve_similarity", VEC_SQL + f""", a AS {_pm('pa')}, s AS {_pm('ps')}, c AS (SELECT a.separation AS a, s.separation AS s FROM a JOIN s USING (depth))
SELECT round(sum(a * s) / (sqrt(sum(a * a)) * sqrt(sum(s * s))), 6) AS curve_cosine, round(sqrt(sum((s - a) * (s - a))) / sqrt(sum(a * a)), 6) AS curve_relative_l2 FROM c""")
def g32_curve(spark, sf):
    v = vectors(spark, sf)
    d = S.directions(v)
    a, s = S.projection_metrics(S.projections(v, d)), S.projection_metrics(S.projections(vectors(spark, sf, True), d))
    c = a.select("depth", F.col("separation").alias("approved")).join(s.select("depth", F.col("separation").alias("suspect")), "depth")
    return _r(S.curve_similarity(c), ["curve_cosine", "curve_relative_l2"], 6)


def _chunks(spark, sf, suspect=False):
    v = vectors(spark, sf, suspect)
    return v.select(F.concat(F.lit("layers."), F.col("prompt_id") % 7, F.lit(".mlp.w")).alias("tensor"), F.col("prompt_id").alias("chunk_id"), F.col("vec").alias("values"))


@query("g33_tensor_delta", MATCH_SQL + """, t AS (SELECT 'layers.' || (vec_id % 7) || '.mlp.w' AS tensor, r, s - r AS d FROM y)
SELECT tensor, count(*) AS numel, round(sqrt(sum(d * d)), 6) AS delta_fro, round(sqrt(sum(r * r)), 6) AS reference_fro, round(sqrt(sum(d * d)) / sqrt(sum(r * r)), 6) AS relative_fro_delta,
 round(avg(abs(d)), 6) AS mean_abs_delta, round(max(abs(d)), 6) AS max_abs_delta, round(count(*) FILTER (abs(d) > 1e-6) * 1.0 / count(*), 6) AS changed_fraction FROM t GROUP BY tensor""")
def g33(spark, sf):
    t = S.tensor_delta(_chunks(spark, sf), _chunks(spark, sf, True))
    return _r(t, ["delta_fro", "reference_fro", "relative_fro_delta", "mean_abs_delta", "max_abs_delta", "changed_fraction"], 6)


def low_rank_screen(spark, sf):
    both = _chunks(spark, sf).withColumnRenamed("values", "r").join(_chunks(spark, sf, True).withColumnRenamed("values", "s"), ["tensor", "chunk_id"])
    cells = both.select("tensor", F.col("chunk_id").alias("row"), F.posexplode(F.zip_with("s", "r", lambda a, b: a - b)).alias("col", "delta"))
    return _r(S.low_rank_screen(S.sample_positions(cells)), ["sample_fro", "top1_energy_ratio", "top5_energy_ratio", "effective_rank"], 4)


@query("x14_tensor_names", """WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'model.layers.' || p_size || '.self_attn.q' WHEN 1 THEN 'layers.' || p_size || '.mlp.up' WHEN 2 THEN 'lm_head.weight'
 WHEN 3 THEN 'model.embed_tokens' WHEN 4 THEN 'layer.' || p_size || '.linear_attn' ELSE 'misc' END AS tensor FROM part)
SELECT p_partkey, tensor, CASE WHEN p_partkey % 6 IN (0, 1, 4) THEN CAST(regexp_extract(tensor, '[0-9]+', 0) AS INT) END AS layer,
 CASE p_partkey % 6 WHEN 0 THEN 'attention' WHEN 1 THEN 'mlp' WHEN 2 THEN 'lm_head' WHEN 3 THEN 'embedding' WHEN 4 THEN 'linear_attention' ELSE 'other' END AS component FROM t""")
def x14(spark, sf):
    from ..functions.scalars import tensor_component, tensor_layer
    k = F.col("p_partkey") % 6
    name = (F.when(k == 0, F.concat(F.lit("model.layers."), "p_size", F.lit(".self_attn.q"))).when(k == 1, F.concat(F.lit("layers."), "p_size", F.lit(".mlp.up")))
            .when(k == 2, "lm_head.weight").when(k == 3, "model.embed_tokens").when(k == 4, F.concat(F.lit("layer."), "p_size", F.lit(".linear_attn"))).otherwise("misc"))
    t = table(spark, sf, "part").select("p_partkey", name.alias("tensor"))
    return t.select("p_partkey", "tensor", tensor_layer("tensor").alias("layer"), tensor_component("tensor").alias("component"))


@query("g39_depth_transitions", """WITH d AS (SELECT l_suppkey, CAST(l_linenumber AS INT) AS depth, round(avg(l_discount), 6) AS cosine, round(avg(l_tax), 6) AS relative_l2 FROM lineitem GROUP BY 1, 2),
w AS (SELECT *, lag(depth) OVER w AS from_depth, round((relative_l2 - lag(relative_l2) OVER w) + (lag(cosine) OVER w - cosine), 9) AS j FROM d WINDOW w AS (PARTITION BY l_suppkey ORDER BY depth))
SELECT l_suppkey, arg_max(from_depth, (j, -depth)) FILTER (j IS NOT NULL) AS from_depth, arg_max(depth, (j, -depth)) FILTER (j IS NOT NULL) AS to_depth,
 arg_min(depth, (cosine, depth)) AS worst_cosine_depth, arg_max(depth, (relative_l2, depth)) AS max_relative_l2_depth FROM w GROUP BY 1""")
def g39(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_suppkey", F.col("l_linenumber").cast("int").alias("depth")).agg(
        S.exact_mean("l_discount", 6).alias("cosine"), S.exact_mean("l_tax", 6).alias("relative_l2"))
    return S.largest_transitions(d, ["l_suppkey"])


@query("w19_average_ranks", """SELECT l_returnflag, l_quantity, count(*) AS n, (sum(count(*)) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - count(*)) + (count(*) + 1) / 2.0 AS rank FROM lineitem GROUP BY 1, 2""")
def w19(spark, sf):
    r = R.average_ranks(table(spark, sf, "lineitem").select("l_returnflag", "l_quantity"), ["l_returnflag"], "l_quantity")
    return r.withColumn("rank", F.col("rank").cast("double"))


@query("x15_percentiles", """SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.1), 4) AS p10, round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.999), 4) AS p999 FROM orders GROUP BY 1""")
def x15(spark, sf):
    p = R.exact_percentiles(table(spark, sf, "orders").select("o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice",
                            {"p10": .1, "median": .5, "p999": .999})
    return _r(p, ["p10", "median", "p999"])


# Rollups ------------------------------------------------------------------
@query("g6_value_counts", f"""WITH t AS ({duck(mcp_log)}) SELECT 'mcp_method' AS field, mcp_method AS value, count(*) AS n FROM t WHERE mcp_method IS NOT NULL GROUP BY 2
UNION ALL SELECT 'mcp_name', mcp_name, count(*) FROM t WHERE mcp_name IS NOT NULL GROUP BY 2 UNION ALL SELECT 'issuer', issuer, count(*) FROM t WHERE issuer IS NOT NULL GROUP BY 2""")
def g6(spark, sf):
    return G.value_counts(domain(spark, sf, mcp_log), ["mcp_method", "mcp_name", "issuer"])


@query("g7_session_rollup", f"""SELECT session_id, count(*) AS events, count(*) FILTER (event_type IN ('click', 'script_eval', 'upload')) AS actions, count(*) FILTER (event_type = 'approval') AS approvals,
 count(url) AS urls, count(DISTINCT url) AS distinct_urls FROM ({duck(browser_events)}) GROUP BY 1""")
def g7(spark, sf):
    return G.session_rollup(domain(spark, sf, browser_events))


def memory_rows(d):
    return f"""SELECT event_id, ord, ts, actor_id, session_id, content_sha256, 'm' || CAST(user_id % 37 AS STRING) AS memory_id,
      CASE WHEN k % 4 = 0 THEN 'memory_write' WHEN k % 4 = 1 THEN 'memory_read' ELSE 'other' END AS event_type FROM ({base_events(d)}) e"""


LINEAGE_SQL = f"""WITH t AS ({duck(memory_rows)}),
w AS (SELECT memory_id, arg_max(event_id, (ts, ord)) AS write_event_id, arg_max(actor_id, (ts, ord)) AS writer, arg_max(session_id, (ts, ord)) AS write_session_id FROM t WHERE event_type = 'memory_write' GROUP BY 1),
l AS (SELECT w.*, count(r.event_id) AS read_count, count(DISTINCT CASE WHEN r.session_id <> write_session_id THEN r.session_id END) AS fanout
  FROM w LEFT JOIN (SELECT * FROM t WHERE event_type = 'memory_read') r USING (memory_id) GROUP BY ALL)"""


@query("g8_memory_lineage", LINEAGE_SQL + " SELECT * FROM l")
def g8(spark, sf):
    return G.memory_lineage(domain(spark, sf, memory_rows))


@query("g8_memory_propagation", LINEAGE_SQL + " SELECT 'memory_cross_session_propagation' AS type, 'high' AS severity, memory_id, fanout FROM l WHERE fanout >= 2")
def g8_findings(spark, sf):
    return G.memory_propagation(G.memory_lineage(domain(spark, sf, memory_rows)))


@query("g9_identity_rollup", f"""SELECT spiffe_id, count(*) AS events, count(DISTINCT host_id) AS hosts, count(DISTINCT process_id) AS processes, count(DISTINCT svid_sha256) AS fingerprints FROM ({duck(workload_events)}) GROUP BY 1""")
def g9(spark, sf):
    return G.identity_rollup(domain(spark, sf, workload_events))


def _mto(col, key, type_, sev):
    return f"SELECT '{type_}' AS type, '{sev}' AS severity, {key} AS subject_id, count(DISTINCT {col}) AS n FROM t GROUP BY {key} HAVING count(DISTINCT {col}) > 1"


@query("g10_task_owners_and_cards", f"WITH t AS ({duck(a2a_log)}) " + _mto("principal", "task_id", "a2a_task_multiple_owners", "critical")
       + " UNION ALL " + _mto("agent_card_sha256", "agent_id", "a2a_agent_card_changed_during_observation", "high"))
def g10(spark, sf):
    t = domain(spark, sf, a2a_log)
    return G.more_than_one(t, "task_id", "principal", "a2a_task_multiple_owners", "critical").unionByName(
        G.more_than_one(t, "agent_id", "agent_card_sha256", "a2a_agent_card_changed_during_observation", "high"))


@query("g10_context_tasks", f"SELECT context_id, count(DISTINCT task_id) AS tasks FROM ({duck(a2a_log)}) GROUP BY 1")
def g10_ctx(spark, sf):
    return G.context_tasks(domain(spark, sf, a2a_log))


@query("g11_task_drift", f"WITH t AS (SELECT *, 'ctx' || (ord % 3 * CAST(task_id = 'task-7' AS INT)) AS context2 FROM ({duck(a2a_log)})) " + _mto("context2", "task_id", "a2a_task_context_split", "critical")
       + " UNION ALL " + _mto("principal", "task_id", "a2a_task_principal_drift", "critical"))
def g11(spark, sf):
    t = domain(spark, sf, a2a_log).withColumn("context2", F.concat(F.lit("ctx"), F.col("ord") % 3 * (F.col("task_id") == "task-7").cast("int")))
    return G.more_than_one(t, "task_id", "context2", "a2a_task_context_split", "critical").unionByName(
        G.more_than_one(t, "task_id", "principal", "a2a_task_principal_drift", "critical"))


@query("g5_approved_contexts", """SELECT DISTINCT 'm' || (o_custkey % 4) AS model_ref, 'r' || (o_custkey % 3) AS model_revision, o_orderstatus AS fingerprint_sha256, o_orderpriority AS thinking FROM orders""")
def g5(spark, sf):
    o = table(spark, sf, "orders").select(F.concat(F.lit("m"), F.col("o_custkey") % 4).alias("model_ref"), F.concat(F.lit("r"), F.col("o_custkey") % 3).alias("model_revision"),
                                          F.col("o_orderstatus").alias("fingerprint_sha256"), F.col("o_orderpriority").alias("thinking"))
    return G.approved_contexts(o)


@query("g14_evidence_coverage", """WITH e AS (SELECT c_custkey AS case_id, item FROM customer, (SELECT unnest(['timeline', 'divergence', 'runtime']) AS item) x),
f AS (SELECT DISTINCT o_custkey AS case_id, CASE o_orderstatus WHEN 'F' THEN 'timeline' WHEN 'O' THEN 'divergence' ELSE 'runtime' END AS item FROM orders WHERE o_orderkey % 4 = 0)
SELECT case_id, count(f.item) AS present, count(*) AS total, round(100.0 * count(f.item) / count(*), 1) AS percent, coalesce(string_agg(CASE WHEN f.item IS NULL THEN e.item END, ',' ORDER BY e.item), '') AS missing
FROM e LEFT JOIN f USING (case_id, item) GROUP BY 1""")
def g14(spark, sf):
    exp = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), F.explode(F.lit(["timeline", "divergence", "runtime"])).alias("item"))
    found = table(spark, sf, "orders").filter("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("case_id"), F.when(F.col("o_orderstatus") == "F", "timeline")
                                                                           .when(F.col("o_orderstatus") == "O", "divergence").otherwise("runtime").alias("item"))
    return G.coverage(exp, found, ["case_id"])


@query("f25_refusal_rates", """SELECT conv_id % 2 = 0 AS expected_refusal, count(*) AS n, round(avg(CASE WHEN turn % 4 = 1 THEN 1.0 ELSE 0.0 END), 6) AS refusal_rate FROM conversations GROUP BY 1""")
def f25(spark, sf):
    c = table(spark, sf, "conversations").select((F.col("conv_id") % 2 == 0).alias("expected_refusal"),
                                                 F.when(F.col("turn") % 4 == 1, F.concat(F.lit("Sorry, I CANNOT HELP. "), "text")).otherwise(F.col("text")).alias("text"))
    return _r(G.refusal_rates(c), ["refusal_rate"], 6)


@query("g40_detection_quality", """WITH e AS (SELECT DISTINCT s_suppkey AS test_id, 'sig' || n_nationkey AS signal, CASE WHEN n_nationkey % 5 = 0 THEN 'forbidden' ELSE 'expected' END AS kind FROM supplier JOIN nation ON (s_suppkey + n_nationkey) % 4 = 0),
f AS (SELECT DISTINCT l_suppkey AS test_id, 'sig' || (l_partkey % 25) AS signal FROM lineitem)
SELECT test_id, count(*) FILTER (kind = 'expected' AND f.signal IS NOT NULL) AS tp, count(*) FILTER (kind = 'expected' AND f.signal IS NULL) AS fn, count(*) FILTER (kind = 'forbidden' AND f.signal IS NOT NULL) AS fp,
 count(*) FILTER (kind = 'expected' AND f.signal IS NULL) = 0 AND count(*) FILTER (kind = 'forbidden' AND f.signal IS NOT NULL) = 0 AS passed FROM e LEFT JOIN f USING (test_id, signal) GROUP BY 1""")
def g40(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    match = s.withColumn("r", F.col("s_suppkey") % 4).join(n.withColumn("r", (4 - F.col("n_nationkey") % 4) % 4), "r")
    exp = match.select(F.col("s_suppkey").alias("test_id"), F.concat(F.lit("sig"), "n_nationkey").alias("signal"),
                       F.when(F.col("n_nationkey") % 5 == 0, "forbidden").otherwise("expected").alias("kind"))
    found = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("test_id"), F.concat(F.lit("sig"), F.col("l_partkey") % 25).alias("signal"))
    return G.detection_quality(exp, found)


def run_rows(d):
    return """SELECT l_suppkey AS doc_id, l_orderkey AS run_ord, CASE WHEN l_suppkey % 3 = 0 THEN 'Doc 4' || CAST(l_partkey % 10 AS STRING) WHEN l_suppkey % 3 = 1 AND l_partkey % 9 = 0 THEN 'Hidden 0'
      ELSE 'Serif' || CAST(l_partkey % 3 AS STRING) END AS font, CASE WHEN l_linenumber = 1 THEN 'AB' ELSE 'A' END AS text FROM {lineitem}"""


@query("f23_font_runs", f"""WITH t AS ({duck(run_rows)}), x AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN chr(64 + CAST(right(font, 1) AS INT)) WHEN font = 'Hidden 0' THEN '' END AS v FROM t)
SELECT doc_id, count(*) AS runs, count(*) FILTER (length(text) = 1) AS one_char, CAST(sum(CASE WHEN v IS NOT NULL THEN length(text) ELSE 0 END) AS BIGINT) AS mapped, CAST(sum(CASE WHEN v = '' THEN length(text) ELSE 0 END) AS BIGINT) AS stealth,
 CAST(sum(CASE WHEN v <> '' THEN length(text) - (length(text) - length(replace(text, v, ''))) ELSE 0 END) AS BIGINT) AS mismatch, count(DISTINCT font) AS fonts, count(DISTINCT CASE WHEN v IS NOT NULL THEN font END) AS coded_fonts FROM x GROUP BY 1""")
def f23(spark, sf):
    return G.font_runs(domain(spark, sf, run_rows))


@query("f23_font_findings")
def f23_findings(spark, sf):
    return G.font_findings(G.font_runs(domain(spark, sf, run_rows)))


def glyph_rows(d):
    return f"""SELECT 'font-' || CAST(l_suppkey AS STRING) AS font_id, CAST(32 + l_partkey % 110 AS INT) AS codepoint,
      CASE WHEN l_suppkey % 4 = 0 AND l_discount > 0.01 THEN 'same' ELSE {d.sha("CAST(l_partkey AS STRING)")} END AS outline_sha256, CASE WHEN l_suppkey % 7 = 0 AND l_tax < 0.07 THEN 0 ELSE 5 END AS commands FROM {{lineitem}}"""


@query("g20_glyph_collapse", f"""WITH g AS (SELECT * FROM ({duck(glyph_rows)}) WHERE codepoint BETWEEN 32 AND 126), p AS (SELECT font_id, outline_sha256, count(*) AS c, count(*) FILTER (commands = 0) AS b FROM g GROUP BY 1, 2),
f AS (SELECT font_id, CAST(sum(c) AS BIGINT) AS n, max(c) AS largest, sum(b) AS blank FROM p GROUP BY 1)
SELECT font_id, n, largest, 'font_glyph_outline_collapse' AS type FROM f WHERE n >= 20 AND largest / n >= 0.7 UNION ALL SELECT font_id, n, largest, 'font_mass_blank_glyph_mapping' FROM f WHERE n >= 20 AND blank / n >= 0.7""")
def g20(spark, sf):
    return G.glyph_collapse(domain(spark, sf, glyph_rows))


@query("g22_alias_collisions", """WITH t AS (SELECT p_partkey % 20 AS archive_id, p_partkey AS ordinal, 'X/' || CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END || CASE WHEN p_partkey % 5 = 0 THEN ' . ' ELSE '' END AS name FROM part),
a AS (SELECT *, 'x/' || lower(rtrim(rtrim(substr(name, 3), ' .'), ' .')) AS alias FROM t)
SELECT archive_id, ordinal, name, alias FROM a QUALIFY row_number() OVER (PARTITION BY archive_id, alias ORDER BY ordinal) > 1""")
def g22(spark, sf):
    p = table(spark, sf, "part")
    name = F.concat(F.lit("X/"), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")), F.when(F.col("p_partkey") % 5 == 0, " . ").otherwise(""))
    return G.alias_collisions(p.select((F.col("p_partkey") % 20).alias("archive_id"), F.col("p_partkey").alias("ordinal"), name.alias("name")))


@query("st3_fleet_view", """WITH r AS (SELECT 'node-' || s_suppkey AS node_id, s_suppkey FROM supplier),
s AS (SELECT 'node-' || (user_id % 60) AS node_id, max(ts) AS last_seen FROM events WHERE user_id % 60 % 3 <> 0 OR ts < TIMESTAMP '2024-01-20' GROUP BY 1),
j AS (SELECT node_id, s_suppkey, last_seen, epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last_seen) AS age FROM r LEFT JOIN s USING (node_id))
SELECT node_id, CASE WHEN last_seen IS NULL THEN 'NEVER_SEEN' WHEN age / 1e6 > 2.5 * CASE WHEN s_suppkey % 2 = 0 THEN 86400.0 * 3 ELSE 300.0 END THEN 'STALE' ELSE 'NORMAL' END AS state,
 coalesce(age / 1e6 > 2.5 * CASE WHEN s_suppkey % 2 = 0 THEN 86400.0 * 3 ELSE 300.0 END, true) AS stale, round(age / 1e6, 1) AS age_seconds FROM j""")
def st3(spark, sf):
    reg = table(spark, sf, "supplier").select(F.concat(F.lit("node-"), "s_suppkey").alias("node_id"),
                                              F.when(F.col("s_suppkey") % 2 == 0, F.lit(86400.0 * 3)).alias("expected_seconds"))
    n = F.col("user_id") % 60
    states = table(spark, sf, "events").filter((n % 3 != 0) | (F.col("ts") < "2024-01-20")).groupBy(F.concat(F.lit("node-"), n).alias("node_id")).agg(
        F.max("ts").cast("timestamp").alias("last_seen")).withColumn("state", F.lit("NORMAL"))
    return G.fleet_view(reg, states, F.lit("2024-02-01").cast("timestamp"))
