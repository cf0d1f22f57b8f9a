"""Structured Streaming jobs over heartbeats and agent events."""

from __future__ import annotations

import sys
import uuid
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..runtime import checkpoint_dir, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Score limits of the drift states and the default heartbeat policy.
CRITICAL, ALERT, OBSERVE = 50, 40, 30
EXPECTED_SECONDS, STALE_FACTOR, MAX_SKEW_SECONDS = 300.0, 2.5, 300
ZERO_HASH = "0" * 64

STATE_ROWS = "node_id string, seq bigint, ts timestamp, verdict string, state string, recovery_streak int"
NODE_STATE = "last_seq bigint, last_hash string, state string, streak int, last_us bigint, said boolean"


def next_state(score: int, previous: str, streak: int, required: int = 3) -> tuple[str, int]:
    """Drift state after a heartbeat whose worst finding has ``score``."""
    if score >= OBSERVE:
        return ("CRITICAL" if score >= CRITICAL else "ALERT" if score >= ALERT else "OBSERVE"), 0
    if previous in ("CRITICAL", "ALERT", "OBSERVE"):
        return ("RECOVERED" if streak + 1 >= required else previous), streak + 1
    return "NORMAL", 0


class FleetNode(StatefulProcessor):
    """State of one node: what it last sent that was accepted, its drift state, and a timer for its silence."""

    def __init__(self, required: int, stale_us: int):
        self.required, self.stale_us = required, stale_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("node", NODE_STATE)

    def _rows(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["node_id", "seq", "ts", "verdict", "state", "recovery_streak"])

    def handleInputRows(self, key, rows, timerValues):
        last_seq, last_hash, current, streak, last_us, said = self.value.get() or (0, ZERO_HASH, "NORMAL", 0, None, False)
        before = None if last_us is None or said else last_us + self.stale_us
        # One node's beats of one micro-batch; the stream's rate limit bounds them.
        beats = sorted(beat for pdf in rows for beat in zip(
            pdf["ts"], pdf["ord"], pdf["seq"], pdf["payload_sha256"], pdf["prev_hash"].fillna(""), pdf["score"]))
        out = []
        for ts, _, seq, payload, prev, score in beats:
            us = ts.value // 1000
            if last_us is not None and not said and us > last_us + self.stale_us:
                out.append((int(last_seq), pd.Timestamp(last_us + self.stale_us, unit="us"), "stale", "STALE", int(streak)))
                said = True
            if seq <= last_seq:
                verdict = "replay"
            elif (prev or ZERO_HASH) != last_hash:
                verdict = "chain_mismatch"
            else:
                verdict = "accepted"
                current, streak = next_state(int(score), current, streak, self.required)
                last_seq, last_hash, last_us, said = int(seq), payload, us, False
            out.append((int(seq), ts, verdict, current, int(streak)))
        self.value.update((int(last_seq), last_hash, current, int(streak), last_us, said))
        due = None if last_us is None or said else last_us + self.stale_us
        if due != before:
            if before is not None:
                self.handle.deleteTimer(-(-before // 1000))
            if due is not None:
                self.handle.registerTimer(-(-due // 1000))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last_seq, last_hash, current, streak, last_us, said = self.value.get()
        if not said:
            self.value.update((last_seq, last_hash, current, streak, last_us, True))
            yield self._rows(key, [(last_seq, pd.Timestamp(last_us + self.stale_us, unit="us"), "stale", "STALE", streak)])

    def close(self) -> None:
        pass


def fleet_states(beats: DataFrame, required: int = 3, expected_seconds: float = EXPECTED_SECONDS) -> DataFrame:
    """Accept or reject heartbeats per node, track its drift state, and report silence.

    ``beats``: node_id, seq, ts (watermarked on a stream), ord, payload_sha256,
    prev_hash, score.  A rejected heartbeat changes nothing.  A node that has
    nothing accepted for 2.5 expected intervals has one STALE row for this silence,
    at the time it was due: from its event-time timer, or from the heartbeat that
    comes later than that.  Beats are judged in order of time within a
    micro-batch, and micro-batches as they come.  Run it through ``run_available``
    or with the state store of ``timed_state``.
    """
    stale_us = int(expected_seconds * STALE_FACTOR * 1_000_000)
    return beats.groupBy("node_id").transformWithStateInPandas(
        FleetNode(required, stale_us), STATE_ROWS, "append", "eventTime")


def side_outputs(states: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted heartbeats, rejected ones, and silences of ``fleet_states``."""
    verdict = F.col("verdict")
    return (states.filter(verdict == "accepted"), states.filter(verdict.isin("replay", "chain_mismatch")),
            states.filter(verdict == "stale"))


@contextmanager
def timed_state(spark: SparkSession):
    """Streams started within keep their state in RocksDB, which states with timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def on_time(beats: DataFrame, now: Column, max_skew: int = MAX_SKEW_SECONDS) -> tuple[DataFrame, DataFrame]:
    """Heartbeats within the allowed clock skew, and the rejected rest."""
    skew = F.abs(F.unix_micros(now) - F.unix_micros("ts")) / 1e6
    ok = skew <= max_skew
    return beats.filter(ok), beats.filter(~ok | skew.isNull()).withColumn("verdict", F.lit("clock_skew"))


def alerts(findings: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """High and critical findings, once per node, sequence number and code."""
    return (findings.filter(F.col("severity").isin("high", "critical")).withWatermark("ts", delay)
            .dropDuplicatesWithinWatermark(["node_id", "seq", "code"]))


def responses(alert_rows: DataFrame, by_code: DataFrame, by_severity: DataFrame, default: str = "observe",
              delay: str = "10 minutes") -> DataFrame:
    """Action per alert: code override, then severity, then the default; idempotent on the alert id.

    ``by_code``: code, action.  ``by_severity``: severity, action.
    """
    a = alert_rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["alert_id"])
    return (a.join(by_code.withColumnRenamed("action", "code_action"), "code", "left")
            .join(by_severity.withColumnRenamed("action", "severity_action"), "severity", "left")
            .select("alert_id", "node_id", "code", "severity", F.coalesce("code_action", "severity_action", F.lit(default)).alias("action")))


def windowed_counts(events: DataFrame, keys: list[str], length: str = "5 minutes", slide: str | None = None,
                    delay: str = "10 minutes") -> DataFrame:
    """Event, error and lag figures per time window."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", delay).groupBy(w.alias("w"), *keys).agg(
        F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"),
        F.max("lag_seconds").alias("max_lag_seconds"))


def session_activity(events: DataFrame, key: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Activity rollup per burst of events of one key."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), key).agg(
        F.count("*").alias("events"), F.count_if(F.col("event_type") == "approval").alias("approvals"))


def source_counts(events: DataFrame, length: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events per closed window and source."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", length).alias("w"), "source_id").agg(F.count("*").alias("seen"))


def bundle_gaps(counts: DataFrame, expectations: DataFrame, length: str = "1 hour") -> DataFrame:
    """Seen against expected events per expected source and closed window; a silent source has 0.

    ``counts``: the closed windows that ``source_counts`` wrote.  ``expectations``:
    source_id, expected_events, min_event_ratio (0.95).  Every expected source is
    laid out over the windows from the first to the last closed one, those between
    in which nothing came at all included, and joined to the counts.
    """
    closed = counts.agg(F.min("w.start").alias("first"), F.max("w.start").alias("last"))
    windows = F.sequence(closed.select("first").scalar(), closed.select("last").scalar(), F.expr(f"INTERVAL {length}"))
    due = expectations.select("source_id", "expected_events", F.coalesce("min_event_ratio", F.lit(0.95)).alias("ratio"),
                              F.explode(windows).alias("start"))
    came = counts.select("source_id", F.col("w.start").alias("start"), "seen")
    seen = F.coalesce("seen", F.lit(0).cast("long"))
    return due.join(came, ["source_id", "start"], "left").select(
        "start", "source_id", seen.alias("seen"), (seen / F.col("expected_events") < F.col("ratio")).alias("incomplete"))


def read_table(spark: SparkSession, folder: str, name: str, per_trigger: int | None = None) -> DataFrame:
    """Stream a parquet table of a folder."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.parquet(folder)


def replayed(table: DataFrame, time: str, slices: int, per_trigger: int = 1) -> DataFrame:
    """A written table as a stream: ``slices`` ranges of time, of equal rows, come one after the other.

    ``per_trigger`` files make a micro-batch, which bounds what one holds.
    """
    spark = table.sparkSession
    base = f"{checkpoint_dir(spark)}/replay-{uuid.uuid4().hex}"
    held = materialize(table)
    cuts = held.select(F.percentile_approx(time, F.array(*[F.lit(i / slices) for i in range(1, slices)]), 10_000)).first()[0] if slices > 1 else []
    bounds = [None, *cuts, None]
    for lo, hi in zip(bounds, bounds[1:]):
        later = F.lit(True) if lo is None else F.col(time) > F.lit(lo)
        part = held.filter(later if hi is None else later & (F.col(time) <= F.lit(hi)))
        part.repartition(1).write.mode("append").parquet(base)
    return spark.readStream.schema(held.schema).option("maxFilesPerTrigger", per_trigger).parquet(base)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is there now into a table of the shared folder and read it back.

    Each micro-batch is written under its id with overwrite, so a repeated
    batch replaces itself.  In complete mode the last batch is the result.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema
    ids = []

    def sink(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/batch={batch:06d}")
        ids.append(batch)

    with timed_state(spark):
        q = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/ckpt")
             .trigger(availableNow=True).foreachBatch(sink).start())
        q.awaitTermination()
    if not ids:
        return spark.createDataFrame([], schema)
    wanted = [max(ids)] if mode == "complete" else sorted(set(ids))
    return spark.read.schema(schema).parquet(*[f"{base}/out/batch={i:06d}" for i in wanted])
