"""Hash chains, Merkle roots, manifests, replay and custody checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from ..schema import union_all
from .ordered import prior, seq_chunk

ZERO_HASH = "0" * 64
RADIX_BITS = 8


def hash_chain(rows: DataFrame, keys: list[str], computed: Column, chunk_rows: int = 100_000) -> DataFrame:
    """First break per log: wrong previous hash, or an own hash that does not match the row.

    ``rows``: keys, seq, prev_hash, event_hash.  ``computed`` is the hash over
    the canonical row.  Rows after the first break are not judged.
    """
    # Whether its own hash fits is known from the row alone, so the computed hash need not move.
    r = prior(rows.withColumn("__own", F.col("event_hash").eqNullSafe(computed)), keys, ["seq"], {"__last": ("last", "event_hash")}, seq_chunk("seq", chunk_rows))
    bad = (F.when(~F.col("prev_hash").eqNullSafe(F.coalesce("__last", F.lit(ZERO_HASH))), "prev_hash_mismatch")
           .when(~F.col("__own"), "event_hash_mismatch"))
    g = r.withColumn("__bad", bad).groupBy(*keys).agg(
        F.count("*").alias("events"), F.min_by(F.struct("seq", "__bad"), F.when(F.col("__bad").isNotNull(), F.col("seq"))).alias("__f"))
    return g.select(*keys, "events", F.col("__f").isNull().alias("valid"), F.col("__f.seq").alias("first_bad_seq"), F.col("__f.__bad").alias("error"))


def _pair(left: Column, right: Column, prefix: bytes | None) -> Column:
    data = F.concat(F.unhex(left), F.unhex(right))
    if prefix is not None:
        data = F.concat(F.lit(bytearray(prefix)), data)
    return F.sha2(data, 256)


def _reduce(indexed: DataFrame, keys: list[str], duplicate_odd: bool, prefix: bytes | None) -> DataFrame:
    """Reduce (keys, pos, h, total) to one root per key, 2^RADIX_BITS nodes per step.

    Groups are runs of consecutive positions, so at most 256 hashes meet in one
    row, and every step shrinks the table 256-fold.
    """
    level = indexed.select(*keys, "pos", "h", "total")
    while True:
        most = level.agg(F.max("total")).first()[0]
        if most is None or most <= 1:
            return level.select(*keys, F.col("h").alias("root"))
        g = level.groupBy(*keys, "total", F.shiftright("pos", RADIX_BITS).alias("pos")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))), lambda s: s["h"]).alias("hs"))
        # (hashes, nodes on this level); a lone node is paired with itself or promoted.
        start = F.struct(F.col("hs").alias("hs"), F.col("total").alias("n"))

        def halve(acc, _):
            hs = acc["hs"]
            paired = F.transform(F.sequence(F.lit(0), F.ceil(F.size(hs) / 2).cast("int") - 1), lambda i: F.when(
                (2 * i + 1 >= F.size(hs)) & F.lit(not duplicate_odd), F.get(hs, 2 * i)).otherwise(
                _pair(F.get(hs, 2 * i), F.coalesce(F.get(hs, 2 * i + 1), F.get(hs, 2 * i)), prefix)))
            return F.struct(F.when(acc["n"] <= 1, hs).otherwise(paired).alias("hs"), F.ceil(acc["n"] / 2).cast("bigint").alias("n"))

        done = F.aggregate(F.sequence(F.lit(1), F.lit(RADIX_BITS)), start, halve)
        level = materialize(g.select(*keys, "pos", done.alias("d")).select(
            *keys, "pos", F.get("d.hs", F.lit(0)).alias("h"), F.col("d.n").alias("total")))


def _indexed(leaves: DataFrame, keys: list[str], order: list[str], chunk: Column) -> DataFrame:
    counts = leaves.groupBy(*keys).agg(F.count("*").alias("total")) if keys else leaves.agg(F.count("*").alias("total"))
    k = keys or ["__all"]
    if not keys:
        leaves, counts = leaves.withColumn("__all", F.lit(1)), counts.withColumn("__all", F.lit(1))
    placed = prior(leaves, k, order, {"pos": ("count", F.lit(True))}, chunk)
    return materialize(placed.join(counts, k).select(*k, F.col("pos").cast("bigint").alias("pos"), F.col("leaf").alias("h"), "total"))


def merkle_roots(leaves: DataFrame, keys: list[str], prefix_digits: int = 4) -> DataFrame:
    """Root over the sorted leaf hashes of each key; an odd node is paired with itself.

    ``leaves``: keys, leaf (hex SHA-256).  Positions come from counts per hash
    prefix, which are evenly sized: a key of n leaves is ranked in pieces of
    n / 16 ** ``prefix_digits``.
    """
    tagged = leaves.withColumn("__u", F.monotonically_increasing_id())
    i = _indexed(tagged, keys, ["leaf", "__u"], F.conv(F.substring("leaf", 1, prefix_digits), 16, 10).cast("int"))
    return _drop_all(_reduce(i, keys or ["__all"], True, None))


def history_roots(entries: DataFrame, keys: list[str], chunk_rows: int = 100_000) -> DataFrame:
    """Append-only log root: leaves hashed with 0x00, nodes with 0x01, split at the largest power of two.

    ``entries``: keys, seq, data (text).  Promoting the odd node of each level
    gives the same tree as splitting at the largest power of two.
    """
    leaf = F.sha2(F.concat(F.lit(bytearray(b"\x00")), F.col("data").cast("binary")), 256)
    i = _indexed(entries.withColumn("leaf", leaf), keys, ["seq"], seq_chunk("seq", chunk_rows))
    return _drop_all(_reduce(i, keys or ["__all"], False, b"\x01"))


def history_pyramid(entries: DataFrame, keys: list[str], chunk_rows: int = 100_000) -> DataFrame:
    """All nodes of the append-only log's trees: keys, level, pos, h, nodes (how many the level has).

    Level 0 are the leaves in order of ``seq``; the root is the only node of the
    last level.  Each level is one grouping of pairs of the level below.
    """
    leaf = F.sha2(F.concat(F.lit(bytearray(b"\x00")), F.col("data").cast("binary")), 256)
    level = _indexed(entries.withColumn("leaf", leaf), keys, ["seq"], seq_chunk("seq", chunk_rows))
    k = keys or ["__all"]
    levels, number = [], 0
    while True:
        level = materialize(level) if number else level
        levels.append(level.select(*k, F.lit(number).alias("level"), "pos", "h", F.col("total").alias("nodes")))
        open_ = level.filter("total > 1")
        if open_.isEmpty():
            return _drop_all(union_all(levels))
        side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("h")))
        level = (open_.groupBy(*k, F.shiftright("pos", 1).alias("up"), F.ceil(F.col("total") / 2).cast("bigint").alias("total"))
                 .agg(side(0).alias("left"), side(1).alias("right"))
                 .select(*k, F.col("up").alias("pos"), F.coalesce(_pair(F.col("left"), F.col("right"), b"\x01"), F.col("left")).alias("h"), "total"))
        number += 1


def inclusion(claims: DataFrame, pyramid: DataFrame, keys: list[str]) -> DataFrame:
    """``(claims' columns, root, path_length, included)``: is the claimed entry in the log at its place?

    ``claims``: keys, pos (from 0), data.  The claim's hash goes up the tree with its
    audit path, one equi join with the stored nodes per level, and must end at the
    stored root.  ``pyramid`` is read once per level, so it should be a written table,
    as ``history_pyramid`` returns it.  A claim of a place or a log that does not exist is not included.
    """
    leaf = F.sha2(F.concat(F.lit(bytearray(b"\x00")), F.col("data").cast("binary")), 256)
    size = pyramid.filter("level = 0").select(*keys, F.col("nodes").alias("__n")).distinct()
    root = pyramid.filter("nodes = 1").select(*keys, F.col("h").alias("root"))
    at = claims.withColumn("__id", F.monotonically_increasing_id())
    at = materialize(at.join(size, keys, "left").join(root, keys, "left"))
    climb = at.select("__id", *keys, F.col("pos").alias("__pos"), leaf.alias("__h"), "__n", F.lit(0).alias("__steps")).filter(
        "__pos >= 0 AND __pos < __n")
    highest = pyramid.agg(F.max("level")).first()[0] or 0
    for level in range(highest):
        nodes = pyramid.filter(F.col("level") == level).select(*keys, F.col("pos").alias("__sib"), F.col("h").alias("__other"))
        sibling = F.when(F.col("__pos") % 2 == 0, F.col("__pos") + 1).otherwise(F.col("__pos") - 1)
        both = climb.withColumn("__sib", sibling).join(nodes, [*keys, "__sib"], "left")
        up = F.when(F.col("__pos") % 2 == 0, _pair(F.col("__h"), F.col("__other"), b"\x01")).otherwise(
            _pair(F.col("__other"), F.col("__h"), b"\x01"))
        climb = materialize(both.select(
            "__id", *keys, F.shiftright("__pos", 1).alias("__pos"), F.coalesce(up, F.col("__h")).alias("__h"), "__n",
            (F.col("__steps") + F.col("__other").isNotNull().cast("int")).alias("__steps")))
    done = at.join(climb.select("__id", "__h", "__steps"), "__id", "left")
    return done.select(*claims.columns, "root", F.col("__steps").alias("path_length"),
                       F.coalesce(F.col("__h") == F.col("root"), F.lit(False)).alias("included"))


def _drop_all(df: DataFrame) -> DataFrame:
    return df.drop("__all")


def manifest_check(manifest: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Verified, mismatched, missing and extra files per manifest."""
    m = manifest.select(*keys, "path", F.col("sha256").alias("want"))
    f = files.select(*keys, "path", F.col("sha256").alias("got"))
    j = m.join(f, [*keys, "path"], "full_outer")
    same = F.lower("want") == F.lower("got")
    g = j.groupBy(*keys).agg(
        F.count_if(same).alias("verified"), F.count_if(F.col("want").isNotNull() & F.col("got").isNotNull() & ~same).alias("mismatch"),
        F.count_if(F.col("want").isNotNull() & F.col("got").isNull()).alias("missing"), F.count_if(F.col("want").isNull()).alias("extra"))
    return g.withColumn("status", F.when((F.col("mismatch") == 0) & (F.col("missing") == 0), "PASS").otherwise("FAIL"))


def replay_check(replayed: DataFrame, preserved: DataFrame, keys: list[str]) -> DataFrame:
    """PASS where the re-normalised output hashes to the preserved output hash."""
    r = replayed.select(*keys, F.col("output_sha256").alias("replayed"))
    p = preserved.select(*keys, F.col("output_sha256").alias("recorded"))
    return p.join(r, keys, "left").select(
        *keys, F.when(F.col("replayed").isNull(), "NOT_REPLAYED").when(F.col("replayed") == F.col("recorded"), "PASS").otherwise("FAIL").alias("status"))


def output_digest(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Order-independent digest of a projection per source."""
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    # Written once: the positions of the leaves read them three times, and the projection parses documents.
    return merkle_roots(materialize(rows.select(*keys, F.sha2(row, 256).alias("leaf"))), keys).withColumnRenamed("root", "output_sha256")


def custody(rows: DataFrame) -> DataFrame:
    """Retained blobs against their recorded size and hash.  Rows: artifact_id, base64, size, sha256."""
    raw = F.try_to_binary("base64", F.lit("base64"))
    return rows.select("artifact_id", F.when(raw.isNull(), "invalid_base64").when(F.octet_length(raw) != F.col("size"), "size_mismatch")
                       .when(F.sha2(raw, 256) != F.col("sha256"), "hash_mismatch").otherwise("ok").alias("status"))


# Case states and the transitions allowed between them.
CASE_TRANSITIONS = {
    "OPEN": ["TRIAGE", "INVESTIGATING", "CLOSED"], "TRIAGE": ["INVESTIGATING", "CLOSED"],
    "INVESTIGATING": ["CONTAINED", "RECOVERING", "CLOSED"], "CONTAINED": ["INVESTIGATING", "RECOVERING"],
    "RECOVERING": ["INVESTIGATING", "CLOSED"], "CLOSED": ["INVESTIGATING", "ARCHIVED"], "ARCHIVED": [],
}


def invalid_transitions(events: DataFrame, chunk: Column) -> DataFrame:
    """Recorded case status changes that the state machine does not allow.  Rows: case_id, ts, ord, status."""
    allowed = F.create_map(*[x for k, v in CASE_TRANSITIONS.items() for x in (F.lit(k), F.lit(v) if v else F.array().cast("array<string>"))])
    e = prior(events, ["case_id"], ["ts", "ord"], {"previous": ("last", "status")}, chunk)
    ok = F.coalesce(F.array_contains(allowed[F.coalesce("previous", F.lit("OPEN"))], F.col("status")), F.lit(False))
    return e.filter(~ok & ~(F.col("previous").isNull() & (F.col("status") == "OPEN"))).select(
        "case_id", "ord", F.coalesce("previous", F.lit("OPEN")).alias("previous"), "status")


def ledger_timeline(ledger: DataFrame, records: DataFrame) -> DataFrame:
    """Investigation timeline in ledger order, with the typed record each entry anchors."""
    return ledger.join(records.select("case_id", F.col("ledger_sequence").alias("sequence"), "record_id", "record_type"),
                       ["case_id", "sequence"], "left")


def hold_states(holds: DataFrame, releases: DataFrame) -> DataFrame:
    """ACTIVE or RELEASED: a release counts only if it names the same hold, tenant, case and hold hash."""
    r = releases.select("hold_id", F.col("tenant_id").alias("rt"), F.col("case_id").alias("rc"), F.col("hold_sha256").alias("rh"))
    j = holds.join(r, "hold_id", "left")
    bound = F.col("tenant_id").eqNullSafe(F.col("rt")) & F.col("case_id").eqNullSafe(F.col("rc"))
    error = F.when(F.col("rt").isNull() & F.col("rc").isNull() & F.col("rh").isNull(), None).when(
        ~bound, "legal_hold_release_binding_mismatch").when(~F.col("rh").eqNullSafe(F.col("hold_sha256")), "legal_hold_release_hash_mismatch")
    return j.select("hold_id", F.when(F.col("rh").isNotNull() & error.isNull(), "RELEASED").otherwise("ACTIVE").alias("state"), error.alias("error"))


# Node kinds, relationships and confidences of execution records.
NODE_KINDS = ["trigger", "human", "agent", "context", "retrieval", "memory", "policy", "identity", "model", "tool", "protocol",
              "action", "resource", "side_effect", "approval", "workflow", "task", "message", "artifact", "unknown"]
RELATIONSHIPS = ["triggered", "instructed", "provided_context", "retrieved", "read_memory", "wrote_memory", "evaluated_policy",
                 "approved", "denied", "delegated_authority", "selected_tool", "invoked", "communicated_with", "acted_on",
                 "changed", "produced", "observed", "derived_from", "correlated_with"]
CONFIDENCES = ["observed", "corroborated", "inferred", "unknown"]


def execution_record_errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Structural errors of execution records: duplicate ids, missing endpoints, unknown vocabulary.

    ``nodes``: record_id, node_id, kind.  ``edges``: record_id, edge_id, source_node, target_node, relationship, confidence.
    """
    out = lambda df, error, ident: df.select("record_id", F.lit(error).alias("error"), F.col(ident).alias("id"))
    dup = lambda df, c: df.groupBy("record_id", c).agg(F.count("*").alias("n")).filter("n > 1")
    ids = nodes.select("record_id", F.col("node_id").alias("end")).distinct()
    ends = edges.select("record_id", "edge_id", F.explode(F.array("source_node", "target_node")).alias("end"))
    outside = lambda c, values: ~F.coalesce(F.col(c).isin(values), F.lit(False))
    return union_all([
        out(dup(nodes, "node_id"), "duplicate_node_id", "node_id"), out(dup(edges, "edge_id"), "duplicate_edge_id", "edge_id"),
        out(ends.join(ids, ["record_id", "end"], "left_anti").select("record_id", "edge_id").distinct(), "missing_endpoint", "edge_id"),
        out(nodes.filter(outside("kind", NODE_KINDS)), "unsupported_node_kind", "node_id"),
        out(edges.filter(outside("relationship", RELATIONSHIPS)), "unsupported_relationship", "edge_id"),
        out(edges.filter(outside("confidence", CONFIDENCES)), "unsupported_confidence", "edge_id")])
