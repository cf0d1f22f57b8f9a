"""Streaming jobs run to completion over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detectors as D
from ..streaming import jobs as J
from .registry import brief, query, table
from .windows import CHAIN_SQL, chained



def _k():
    return F.get_json_object("props", "$.k").cast("bigint")


def stream(spark, sf):
    return J.read_table(spark, sf, "events").withColumns({"ts": F.col("ts").cast("timestamp"), "k": _k()})


SCORE = "CASE WHEN k > 95 THEN 50 WHEN k > 90 THEN 40 WHEN k > 80 THEN 30 ELSE 0 END"
# Beats are expected every three hours, so 7.5 hours of silence are stale.
STALE_US = 27_000_000_000


@query("st1_fleet_states", CHAIN_SQL.replace("AS good FROM", f"AS good, {SCORE} AS score FROM").split("s(node_id")[0] + f"""
s AS (SELECT DISTINCT node_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS us, '' AS verdict, CAST(0 AS BIGINT) AS last_seq,
   repeat('0', 64) AS last_hash, 'NORMAL' AS state, 0 AS streak, CAST(NULL AS BIGINT) AS last_at, false AS said, false AS late, CAST(NULL AS BIGINT) AS due,
   CAST(0 AS BIGINT) AS seq_before, 0 AS streak_before FROM b
 UNION ALL SELECT node_id, rn, seq, us, verdict, CASE WHEN ok THEN seq ELSE last_seq END, CASE WHEN ok THEN payload_sha256 ELSE last_hash END,
   CASE WHEN NOT ok THEN state WHEN score >= 50 THEN 'CRITICAL' WHEN score >= 40 THEN 'ALERT' WHEN score >= 30 THEN 'OBSERVE'
        WHEN state NOT IN ('CRITICAL', 'ALERT', 'OBSERVE') THEN 'NORMAL' WHEN streak + 1 >= 3 THEN 'RECOVERED' ELSE state END,
   CASE WHEN NOT ok THEN streak WHEN score >= 30 OR state NOT IN ('CRITICAL', 'ALERT', 'OBSERVE') THEN 0 ELSE streak + 1 END,
   CASE WHEN ok THEN us ELSE last_at END, NOT ok AND (said OR late), late, last_at + {STALE_US}, last_seq, streak
 FROM (SELECT b.node_id, b.rn, b.seq, epoch_us(b.ts) AS us, b.payload_sha256, b.score, s.last_seq, s.last_hash, s.state, s.streak, s.last_at, s.said,
        coalesce(NOT s.said AND epoch_us(b.ts) > s.last_at + {STALE_US}, false) AS late, b.seq > s.last_seq AND b.prev = s.last_hash AS ok,
        CASE WHEN b.seq <= s.last_seq THEN 'replay' WHEN b.prev <> s.last_hash THEN 'chain_mismatch' ELSE 'accepted' END AS verdict
       FROM s JOIN b ON b.node_id = s.node_id AND b.rn = s.rn + 1))
SELECT node_id, seq, us AS at_us, verdict, state, streak AS recovery_streak FROM s WHERE rn > 0
UNION ALL SELECT node_id, seq_before, due, 'stale', 'STALE', streak_before FROM s WHERE late
UNION ALL SELECT node_id, last_seq, last_at + {STALE_US}, 'stale', 'STALE', streak FROM s
  WHERE rn = (SELECT max(rn) FROM b WHERE b.node_id = s.node_id) AND NOT said AND last_at + {STALE_US} <= (SELECT max(epoch_us(ts)) FROM b) - 3600000000""")
def st1(spark, sf):
    table_ = chained(spark, sf).withColumn("score", F.expr(SCORE))
    stream_ = J.replayed(table_.select("node_id", "ts", "ord", "seq", "payload_sha256", "prev_hash", "score"), "ts", 4)
    states = J.run_available(J.fleet_states(stream_.withWatermark("ts", "1 hour"), expected_seconds=3 * 3600))
    return states.withColumn("at_us", F.unix_micros("ts")).drop("ts")


@query("st4_alerts", """SELECT DISTINCT 'node-' || user_id % 25 AS node_id, event_id // 4 AS seq, 'code-' || event_id % 2 AS code FROM events WHERE event_type IN ('error', 'signup')""")
def st4(spark, sf):
    f = stream(spark, sf).select(F.concat(F.lit("node-"), F.col("user_id") % 25).alias("node_id"), F.floor(F.col("event_id") / 4).alias("seq"), F.concat(F.lit("code-"), F.col("event_id") % 2).alias("code"),
                                 F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "signup", "high").otherwise("low").alias("severity"), "ts")
    return J.run_available(J.alerts(f, "2 days").select("node_id", "seq", "code"))


@query("st5_responses", """SELECT DISTINCT event_id // 2 AS alert_id, CASE event_id // 2 % 5 WHEN 0 THEN 'quarantine' WHEN 1 THEN 'isolate' ELSE CASE event_id // 2 % 3 WHEN 0 THEN 'restrict' ELSE 'observe' END END AS action FROM events""")
def st5(spark, sf):
    i = F.floor(F.col("event_id") / 2)
    a = stream(spark, sf).select(i.alias("alert_id"), F.lit("n").alias("node_id"), F.concat(F.lit("c"), i % 5).alias("code"), F.when(i % 3 == 0, "critical").otherwise("high").alias("severity"), "ts")
    n = table(spark, sf, "nation")
    codes = n.filter("n_nationkey < 2").select(F.concat(F.lit("c"), "n_nationkey").alias("code"), F.when(F.col("n_nationkey") == 0, "quarantine").otherwise("isolate").alias("action"))
    sev = n.filter("n_nationkey = 0").select(F.lit("critical").alias("severity"), F.lit("restrict").alias("action"))
    return J.run_available(J.responses(a, codes, sev, delay="2 days").select("alert_id", "action"))


@query("st6_clock_skew", """SELECT event_id, 'clock_skew' AS verdict FROM events WHERE abs(epoch_us(TIMESTAMP '2024-01-10') - epoch_us(ts)) > 300::BIGINT * 86400 * 1000000 / 100""")
def st6(spark, sf):
    late = J.on_time(stream(spark, sf), F.lit("2024-01-10").cast("timestamp"), 300 * 864)[1]
    return J.run_available(late.select("event_id", "verdict"))


@query("st7_windowed_counts", """SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, user_id % 4 AS service, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, max(value) AS max_lag_seconds FROM events GROUP BY 1, 2 HAVING start_us + 3600000000 <= (SELECT epoch_us(max(ts)) - 600000000 FROM events)""")
def st7(spark, sf):
    e = stream(spark, sf).withColumns({"service": F.col("user_id") % 4, "lag_seconds": F.col("value")})
    t = J.run_available(J.windowed_counts(e, ["service"], "1 hour"))
    return t.select(F.unix_micros("w.start").alias("start_us"), "service", "events", "errors", "max_lag_seconds")


@query("st8_session_activity", """WITH g AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 7200000000 AS end_us, count(*) AS events, count(*) FILTER (event_type = 'signup') AS approvals
FROM s GROUP BY user_id, s HAVING epoch_us(max(ts)) + 7200000000 <= (SELECT epoch_us(max(ts)) - 600000000 FROM events)""")
def st8(spark, sf):
    e = stream(spark, sf).withColumn("event_type", F.when(F.col("event_type") == "signup", "approval").otherwise(F.col("event_type")))
    t = J.run_available(J.session_activity(e, "user_id", "2 hours"))
    return t.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "events", "approvals")


@query("st9_streaming_detector", """WITH t AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS s, event_id % 3 AS m, user_id % 5 AS o FROM events)
SELECT 'browser_unapproved_network_origin' AS type, 'high' AS severity, s AS subject_id, id AS event_id FROM t WHERE m = 0 AND o <> 0 UNION ALL SELECT 'unapproved_browser_script_eval', 'critical', s, id FROM t WHERE m = 1""")
def st9(spark, sf):
    n = F.col("event_id") % 3
    e = stream(spark, sf).select(F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("session_id"),
                                 F.when(n == 0, "network_request").when(n == 1, "script_eval").otherwise("other").alias("event_type"), F.concat(F.lit("https://s"), F.col("user_id") % 5, F.lit(".example/x")).alias("url"))
    return J.run_available(brief(D.browser_activity(e, ["https://s0.example"])))


@query("st10_bundle_gaps", """WITH d AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, 'src-' || user_id % 150 AS source_id FROM events),
lim AS (SELECT min(start) AS a, max(start) FILTER (epoch_us(start) + 86400000000 <= (SELECT epoch_us(max(ts)) - 600000000 FROM events)) AS z FROM d),
w AS (SELECT unnest(generate_series(a, z, INTERVAL 1 DAY)) AS start FROM lim),
x AS (SELECT 'src-' || s_suppkey AS source_id, 1 + s_nationkey AS expected, CASE WHEN s_suppkey % 4 = 0 THEN 0.5 ELSE 0.95 END AS ratio FROM supplier),
c AS (SELECT start, source_id, count(*) AS n FROM d GROUP BY ALL)
SELECT epoch_us(w.start) AS start_us, x.source_id, coalesce(n, 0) AS seen, coalesce(n, 0) / expected < ratio AS incomplete
FROM w CROSS JOIN x LEFT JOIN c ON c.start = w.start AND c.source_id = x.source_id""")
def st10(spark, sf):
    e = stream(spark, sf).withColumn("source_id", F.concat(F.lit("src-"), F.col("user_id") % 150))
    expected = table(spark, sf, "supplier").select(
        F.concat(F.lit("src-"), "s_suppkey").alias("source_id"), (F.col("s_nationkey") + 1).alias("expected_events"),
        F.when(F.col("s_suppkey") % 4 == 0, F.lit(0.5)).alias("min_event_ratio"))
    t = J.bundle_gaps(J.run_available(J.source_counts(e, "1 day")), expected, "1 day")
    return t.select(F.unix_micros("start").alias("start_us"), "source_id", "seen", "incomplete")
