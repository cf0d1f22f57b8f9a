"""Order-dependent folds over ``(ts, ord)``.

All of them look only at rows before the current one and go through
``ordered.prior``, so a hot session, task or cache key is split by time chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import present, truthy
from ..schema import ensure
from .detectors import MCP_COLUMNS, first_present, mcp_method
from ..schema import union_all
from ..runtime import materialize
from .ordered import nth_of_key, prior, time_chunk

ORDER = ["ts", "ord"]
# States in which a task no longer runs, and activities that must not follow a stop.
TERMINAL = ["completed", "failed", "cancelled", "canceled", "expired"]
SESSION_TERMINAL = TERMINAL + ["terminated"]
STOP_EVENTS = ["stop_requested", "cancel_requested", "containment_applied"]
AFTER_STOP = ["model_call", "tool_call", "delegation", "code_execution", "network_action"]
CHANGE_TERMS = ["adapter", "lora", "peft", "forward_hook", "control", "direction", "steering", "abliter",
                "uncensored", "safetensors"]
CONSENT_WORDS = ["approved", "authorized", "permission granted", "consent", "autoapprove"]


def adjusted_timeline(events: DataFrame) -> DataFrame:
    """Clock-adjusted time, uncertainty interval and quality label.

    ``events``: ts, clock_offset_ms, clock_uncertainty_ms plus the event's own columns.
    """
    e = ensure(events, "clock_offset_ms double, clock_uncertainty_ms double")
    offset = F.coalesce("clock_offset_ms", F.lit(0.0)).cast("double")
    unsure = F.coalesce("clock_uncertainty_ms", F.lit(0.0)).cast("double")
    us = F.unix_micros(F.col("ts").cast("timestamp")) + F.round(offset * 1000).cast("bigint")
    half = F.round(unsure * 1000).cast("bigint")
    return e.withColumns({
        "adjusted": F.timestamp_micros(us), "interval_start": F.timestamp_micros(us - half),
        "interval_end": F.timestamp_micros(us + half),
        "timestamp_quality": F.when(unsure == 0, "observed").otherwise("observed_with_uncertainty")})


def ordering_ambiguity(timeline: DataFrame, keys: list[str], chunk_seconds: int = 3600) -> DataFrame:
    """Mark neighbours of the adjusted timeline whose intervals touch.

    The next row's view is the previous-row fold run on the reversed order.
    """
    t = timeline.withColumn("_us", F.unix_micros("adjusted"))
    chunk = F.floor(F.col("_us") / (chunk_seconds * 1_000_000))
    t = prior(t, keys, ["_us", "ord"], {"_prev_end": ("last", "interval_end")}, chunk)
    back = t.withColumns({"_nus": -F.col("_us"), "_nord": -F.col("ord")})
    back = prior(back, keys, ["_nus", "_nord"], {"_next_start": ("last", "interval_start")},
                 F.floor(F.col("_nus") / (chunk_seconds * 1_000_000)))
    return back.withColumns({
        "ambiguous_with_previous": F.coalesce(F.col("interval_start") <= F.col("_prev_end"), F.lit(False)),
        "ambiguous_with_next": F.coalesce(F.col("_next_start") <= F.col("interval_end"), F.lit(False)),
    }).drop("_us", "_nus", "_nord", "_prev_end", "_next_start")


def merged_timeline(*sources: DataFrame) -> DataFrame:
    """One timeline from adjusted logs and kernel traces: ``source, key, event_id, ord`` and the adjusted interval.

    Ordering ambiguity then holds across sources, as rows of all of them stand in one order.
    """
    cols = ["source", "key", "event_id", "ord", "adjusted", "interval_start", "interval_end", "timestamp_quality"]
    return union_all([s.select(*cols) for s in sources])


def activity_union(processes: DataFrame, files: DataFrame, network: DataFrame) -> DataFrame:
    """Process, file and network observations of a host in one shape: ``kind, host_id, ts, subject, detail``."""
    cols = ["host_id", "ts", "subject", "detail"]
    return union_all([df.select(F.lit(kind).alias("kind"), *cols)
                      for kind, df in (("process", processes), ("file", files), ("network", network))])


def first_change_event(timeline: DataFrame, keys: list[str]) -> DataFrame:
    """Earliest event per case whose summary names a model-changing term."""
    hit = F.lower("summary").rlike("|".join(CHANGE_TERMS))
    return timeline.filter(hit).groupBy(*keys).agg(
        F.min_by(F.struct("event_id", "event_type", "summary"), F.struct("adjusted", "ord")).alias("__first")).select(*keys, "__first.*")


def first_anomalous_run(depths: DataFrame, keys: list[str], k: int = 2) -> DataFrame:
    """First run of at least ``k`` anomalous observed depths, up to the first normal one.

    ``depths``: keys, depth, anomalous.  Depths of one run are few (model layers).
    """
    w = Window.partitionBy(*keys).orderBy("depth")
    island = F.row_number().over(w) - F.sum(F.col("anomalous").cast("int")).over(w)
    runs = (depths.withColumn("_island", island).filter("anomalous").groupBy(*keys, "_island")
            .agg(F.min("depth").alias("first_depth"), F.count("*").alias("length"), F.max("depth").alias("last_depth"))
            .filter(F.col("length") >= k))
    return runs.groupBy(*keys).agg(F.min_by(F.struct("first_depth", "last_depth", "length"), "first_depth").alias("r")).select(
        *keys, F.col("r.first_depth").alias("first_divergence_depth"), F.col("r.last_depth").alias("region_end"),
        F.col("r.length").alias("region_depths"))


def cache_key_reuse(records: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Cache keys whose previous record belongs to another tenant."""
    r = prior(records, ["cache_type", "cache_key"], ORDER, {"p": ("last", F.struct("tenant_id"))},
              time_chunk("ts") if chunk is None else chunk)
    return r.filter("p IS NOT NULL AND NOT (p.tenant_id <=> tenant_id)").select(
        "record_id", "cache_type", "cache_key", F.col("p.tenant_id").alias("previous_tenant"), "tenant_id")


def workload_identity_change(events: DataFrame) -> DataFrame:
    """A process that presents another identity than before."""
    e = events.filter("spiffe_id <> '' AND (host_id IS NOT NULL OR process_id IS NOT NULL)")
    return prior(e, ["host_id", "process_id"], ORDER, {"previous": ("last", "spiffe_id")}, time_chunk("ts")).filter(
        "previous <> spiffe_id").select("event_id", "host_id", "process_id", "previous", "spiffe_id")


def session_ownership(events: DataFrame) -> DataFrame:
    """Owner changes and accesses by someone who is not the owner so far."""
    sets = F.col("event_type").isin("session_created", "session_owner")
    e = prior(ensure(events, "delegated boolean"), ["session_id"], ORDER,
              {"p": ("last", F.when(sets, F.struct("principal")))}, time_chunk("ts"))
    kind = (F.when(sets & F.col("p").isNotNull() & ~F.col("p.principal").eqNullSafe(F.col("principal")), "session_owner_changed")
            .when((F.col("event_type") == "session_access") & present("p.principal")
                  & ~F.col("principal").eqNullSafe(F.col("p.principal")) & ~truthy("delegated"), "session_access_by_non_owner"))
    return e.withColumn("type", kind).filter("type IS NOT NULL").select(
        "type", F.lit("critical").alias("severity"), "session_id", "event_id", F.col("p.principal").alias("owner"), "principal")


def task_rollup(events: DataFrame) -> DataFrame:
    """Per task: first origin, last stated state, last executor, last cancelable flag."""
    at = F.struct(*ORDER)
    last = lambda c: F.max_by(c, F.when(present(c), at))
    return events.filter("task_id <> ''").groupBy("task_id").agg(
        F.min_by("agent_id", at).alias("origin_agent"), last("state").alias("state"),
        last("executor").alias("executor"),
        F.max_by("cancelable", F.when(F.col("cancelable").isNotNull(), at)).alias("cancelable"))


def outstanding_after_containment(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Tasks not in a terminal state whose originating agent was contained."""
    stopped = events.filter(F.col("event_type").isin("containment", "agent_stop", "agent_terminated")).groupBy(
        F.col("agent_id").alias("origin_agent")).agg(F.max_by("event_id", F.struct(*ORDER)).alias("containment_event"))
    open_ = tasks.filter(~F.lower(F.coalesce("state", F.lit("unknown"))).isin(SESSION_TERMINAL))
    return open_.join(stopped, "origin_agent").select("task_id", "origin_agent", "state", "containment_event")


def post_stop_activity(events: DataFrame) -> DataFrame:
    """Listed activity after a stop request in the same session."""
    stop = F.col("event_type").isin(STOP_EVENTS)
    e = prior(events, ["session_id"], ORDER, {"stop_event": ("last", F.when(stop, F.col("event_id")))}, time_chunk("ts"))
    return e.filter(F.col("stop_event").isNotNull() & F.col("event_type").isin(AFTER_STOP)).select(
        "session_id", "event_id", "event_type", "stop_event")


def task_activity_after_cancel(events: DataFrame, methods: list[str]) -> DataFrame:
    """Task methods used after the task was cancelled; a cancelling row is no activity."""
    state = F.lower(F.coalesce(first_present("state", "status"), F.lit("")))
    e = ensure(events, MCP_COLUMNS).withColumns({"_method": mcp_method(), "_state": state}).filter("task_id <> ''")
    cancels = F.col("_method").isin("tasks/cancel", "tasks/update") & F.col("_state").isin("cancelled", "canceled")
    e = prior(e, ["task_id"], ORDER, {"_cancelled": ("count", cancels)}, time_chunk("ts"))
    return e.filter((F.col("_cancelled") > 0) & ~F.coalesce(cancels, F.lit(False)) & F.col("_method").isin(methods)
                    & ~F.col("_state").isin(TERMINAL)).select("task_id", "event_id", F.col("_method").alias("method"))


def round_trip_limit(events: DataFrame, default: int = 20) -> DataFrame:
    """Multi-round-trip requests that exceed their allowed number of rounds."""
    e = ensure(events, MCP_COLUMNS + ", max_round_trips int").withColumn("_rid", first_present("mrtr_id", "round_trip_id"))
    e = nth_of_key(e.filter("_rid IS NOT NULL"), ["_rid"], ORDER, time_chunk("ts"), "rounds")
    limit = F.coalesce(F.when(F.col("max_round_trips") > 0, F.col("max_round_trips")), F.lit(default))
    return e.filter(F.col("rounds") > limit).select(F.col("_rid").alias("mrtr_id"), "event_id", "rounds")


def cached_catalog_change(events: DataFrame) -> DataFrame:
    """Cache reads whose catalog content differs from the previous record of the key."""
    from .detectors import CATALOG_METHODS, CATALOG_TYPES
    e = ensure(events, MCP_COLUMNS).withColumn("_method", mcp_method())
    e = e.filter(F.coalesce(F.col("catalog_type").isin(CATALOG_TYPES), F.lit(False))
                 | F.coalesce(F.col("_method").isin(CATALOG_METHODS), F.lit(False)))
    e = prior(e, ["_method", "server_id", "tenant_id"], ORDER, {"p": ("last", F.struct("result_sha256"))}, time_chunk("ts"))
    return e.filter("event = 'cache_read' AND p.result_sha256 <> result_sha256 AND p.result_sha256 <> '' AND result_sha256 <> ''"
                    ).select("event_id", F.col("_method").alias("method"), "server_id", "tenant_id")


def duplicate_ids(events: DataFrame, chunk_rows: int = 1_000_000) -> DataFrame:
    """Second and later records of an event id."""
    first = events.groupBy("event_id").agg(F.min("ord").alias("first_ord"), F.count("*").alias("n")).filter("n > 1")
    return events.join(first, "event_id").filter("ord > first_ord").select("event_id", "ord")


def heartbeat_continuity(beats: DataFrame) -> DataFrame:
    """Verdict per heartbeat against the last accepted one of its node.

    A rejected heartbeat leaves the node's state untouched, so acceptance is a
    chain: from an accepted beat it goes to the first later one that names its
    payload and has a larger sequence number.  Successors come from one equi
    join on node and hash; pointer doubling then marks the chain from the start
    state in a logarithmic number of rounds.  Rows: node_id, ts, ord, seq,
    payload_sha256, prev_hash.
    """
    zero = F.lit("0" * 64)
    b = materialize(beats.select("node_id", F.struct(*ORDER).alias("pos"), *ORDER, "seq", "payload_sha256",
                                 F.coalesce(F.when(F.col("prev_hash") != "", F.col("prev_hash")), zero).alias("prev")))
    key = ["node_id", "pos"]
    after = b.select("node_id", F.col("prev").alias("payload_sha256"), F.col("pos").alias("next"), F.col("seq").alias("next_seq"))
    jump = materialize(b.join(after, ["node_id", "payload_sha256"]).filter((F.col("next") > F.col("pos")) & (F.col("next_seq") > F.col("seq")))
                       .groupBy(*key).agg(F.min("next").alias("next")))
    reached = materialize(b.filter((F.col("prev") == zero) & (F.col("seq") > 0)).groupBy("node_id").agg(F.min("pos").alias("pos")))
    known = reached.count()
    while True:
        step = reached.join(jump, key).select("node_id", F.col("next").alias("pos"))
        reached = materialize(reached.unionByName(step).distinct())
        now = reached.count()
        if now == known:
            break
        known = now
        far = jump.select("node_id", F.col("pos").alias("next"), F.col("next").alias("far"))
        jump = materialize(jump.join(far, ["node_id", "next"]).select("node_id", "pos", F.col("far").alias("next")))
    marked = b.join(reached.withColumn("accepted", F.lit(True)), key, "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    state = prior(marked, ["node_id"], ORDER, {"state_seq": ("max", F.when(F.col("accepted"), F.col("seq")))}, time_chunk("ts"))
    return state.withColumn("verdict", F.when(F.col("accepted"), "accepted").when(F.col("seq") <= F.coalesce("state_seq", F.lit(0)), "replay")
                            .otherwise("chain_mismatch")).select("node_id", "seq", "verdict")


def latest_state(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Whole latest row per key, by partial aggregation instead of a per-key sort."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__latest")).select(key, "__latest.*")


def top_k_per_key(rows: DataFrame, key: str, order: Column, k: int) -> DataFrame:
    """Top ``k`` rows per key: Spark limits each partition before the shuffle (window group limit)."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def history_divergence(baseline: DataFrame, current: DataFrame, key: str = "session_id") -> DataFrame:
    """Length of the common prefix of two line-hash histories per session.

    The prefix ends before the first position that differs: one minimum per
    session instead of an ordered scan.  Rows: key, position (1..n), sha256.
    """
    both = baseline.select(key, "position", F.col("sha256").alias("b")).join(
        current.select(key, "position", F.col("sha256").alias("c")), [key, "position"], "full_outer")
    g = both.groupBy(key).agg(
        F.min(F.when(~F.col("b").eqNullSafe(F.col("c")), F.col("position"))).alias("first_diff"),
        F.count("b").alias("baseline_lines"), F.count("c").alias("current_lines"))
    return g.filter("first_diff IS NOT NULL").select(
        key, (F.col("first_diff") - 1).alias("common_prefix_lines"), "baseline_lines", "current_lines")


def consent_after_divergence(lines: DataFrame, divergence: DataFrame, key: str = "session_id") -> DataFrame:
    """Approval words in the lines after the common prefix.  ``lines``: key, position, text."""
    low = F.lower("text")
    said = F.lit(False)
    for word in CONSENT_WORDS:
        said = said | F.contains(low, F.lit(word))
    return lines.join(divergence.select(key, "common_prefix_lines"), key).filter(
        (F.col("position") > F.col("common_prefix_lines")) & said).select(
        key, "position", F.sha2("text", 256).alias("sha256"))


def credential_lineage(credentials: DataFrame, uses: DataFrame, issuers: list | None = None) -> DataFrame:
    """Scope expansion over the parent, use after expiry, and unapproved issuers.

    ``credentials``: credential_id, parent_credential_id, issuer, scopes, expires.
    ``uses``: event_id, credential_id, ts.
    """
    def row(df, kind, subject, event=None):
        return df.select(F.lit(kind).alias("type"), F.lit("critical").alias("severity"),
                         F.col(subject).alias("credential_id"),
                         (F.col(event) if event else F.lit(None).cast("string")).alias("event_id"))

    parent = credentials.select(F.col("credential_id").alias("parent_credential_id"), F.col("scopes").alias("parent_scopes"))
    wider = credentials.join(parent, "parent_credential_id").filter(F.size(F.array_except("scopes", "parent_scopes")) > 0)
    late = uses.join(credentials.select("credential_id", "expires"), "credential_id").filter(F.col("ts") >= F.col("expires"))
    out = row(wider, "credential_exchange_scope_expansion", "credential_id").unionByName(
        row(late, "credential_used_after_expiry", "credential_id", "event_id"))
    if issuers:
        foreign = credentials.filter(~F.coalesce(F.col("issuer").isin(issuers), F.lit(False)))
        out = out.unionByName(row(foreign, "credential_unapproved_issuer", "credential_id"))
    return out
