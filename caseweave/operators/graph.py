"""Causal, taint and lineage graphs as iterated joins.

Only parent and cause references are causal; correlation ids and timestamps
never are.  Each round joins the frontier with the edge table on the node id,
so the skew join of AQE splits a hub node; what a round found is written to the
shared folder, which keeps plans short and survives a lost executor.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, materialize, materialize_counted
from ..schema import union_all

# Typed-edge vocabulary, its causal part, and the metadata reference fields.
EDGE_TYPES = ["caused_by", "derived_from", "contains_content_from", "authorized_by", "delegated_by",
              "scheduled_by", "retrieved_from", "transformed_from", "routed_by", "executed_by",
              "correlated_with", "contradicts"]
CAUSAL_EDGE_TYPES = ["caused_by", "derived_from", "contains_content_from", "authorized_by",
                     "delegated_by", "scheduled_by", "retrieved_from", "transformed_from",
                     "routed_by", "executed_by"]
REFERENCE_EDGES = {
    "source_event_id": "derived_from", "authorization_event_id": "authorized_by",
    "delegation_event_id": "delegated_by", "scheduled_by_event_id": "scheduled_by",
    "retrieval_event_id": "retrieved_from", "transform_event_id": "transformed_from",
    "route_event_id": "routed_by", "executor_event_id": "executed_by",
}
# Event types that count as taint sinks.
SINK_TYPES = ["tool_call", "code_execution", "network_action", "data_write", "consequence",
              "memory_write", "delegation", "agent_message"]


def relation_edges(events: DataFrame) -> DataFrame:
    """Parent, cause and correlation edges ``(src, dst, relation, causal)``; one pass over events."""
    none = F.array().cast("array<struct<src:string,relation:string,causal:boolean>>")

    def tagged(refs, relation, causal):
        return F.coalesce(F.transform(refs, lambda r: F.struct(
            r.alias("src"), F.lit(relation).alias("relation"), F.lit(causal).alias("causal"))), none)

    parent = F.when(F.col("parent_event_id") != "", F.array("parent_event_id"))
    refs = [tagged(parent, "parent", True), tagged(F.col("cause_event_ids"), "cause", True)]
    if "correlation_ids" in events.columns:
        refs.append(tagged(F.col("correlation_ids"), "correlation", False))
    return (events.select(F.col("event_id").alias("dst"), F.explode(F.concat(*refs)).alias("e"))
            .select("e.src", "dst", "e.relation", "e.causal"))


def causal_edges(events: DataFrame) -> DataFrame:
    return relation_edges(events).filter("causal").select("src", "dst")


def typed_edges(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed, evidence-backed edges and the edges whose type is unknown.

    Expects the reference columns as plain columns plus ``typed_edges``
    (array of struct source, target, type, confidence, origin).  A correlation
    counts only when its other end is a recorded event.
    """
    def edge(src, dst, kind, confidence, origin):
        return F.struct(src.alias("src"), dst.alias("dst"), kind.alias("type"),
                        confidence.cast("double").alias("confidence"), origin.alias("origin"))

    eid = F.col("event_id")
    fixed = lambda refs, kind, conf, origin: F.transform(
        F.coalesce(refs, F.array().cast("array<string>")),
        lambda r: edge(r, eid, F.lit(kind), F.lit(conf), F.lit(origin)))
    groups = [
        fixed(F.array("parent_event_id"), "caused_by", 0.8, "normalized_parent"),
        fixed(F.col("cause_event_ids"), "caused_by", 1.0, "explicit_cause"),
        fixed(F.col("correlation_ids"), "correlated_with", 0.3, "explicit_correlation"),
    ]
    for field, kind in REFERENCE_EDGES.items():
        if field in events.columns:
            groups.append(fixed(F.array(field), kind, 1.0, "metadata"))
    if "typed_edges" in events.columns:
        groups.append(F.transform(
            F.coalesce("typed_edges", F.array().cast(events.schema["typed_edges"].dataType)),
            lambda x: edge(x["source"], F.coalesce(x["target"], eid), x["type"],
                           F.coalesce(x["confidence"], F.lit(1.0)), F.coalesce(x["origin"], F.lit("event")))))
    every = (events.select(F.explode(F.concat(*groups)).alias("e")).select("e.*")
             .filter((F.col("src") != "") & (F.col("dst") != "")))
    known = F.col("type").isin(EDGE_TYPES)
    correlated = (every.filter((F.col("type") == "correlated_with") & (F.col("origin") == "explicit_correlation"))
                  .join(events.select(eid.alias("src")).distinct(), "src", "left_semi"))
    rest = every.filter(known & ~((F.col("type") == "correlated_with")
                                  & (F.col("origin") == "explicit_correlation")))
    edges = rest.unionByName(correlated)
    unknown = every.filter(~F.coalesce(known, F.lit(False))).select("type", "src", "dst")
    return edges, unknown


def reach(edges: DataFrame, seeds: DataFrame, max_rounds: int | None = None, hops: int = 2) -> DataFrame:
    """All ``(seed, node, depth)`` with a directed path of at least one edge.

    ``seeds`` has ``seed`` (label) and ``node`` (where it starts).  A seed on a
    cycle reaches itself.  Semi-naive: only newly found pairs are expanded,
    ``hops`` edges per written round.
    """
    edges = materialize(edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    frontier = seeds.select("seed", "node").distinct()
    found: list[DataFrame] = []
    depth = 0
    while max_rounds is None or depth < max_rounds:
        layers, layer = [], frontier
        for _ in range(hops if max_rounds is None else min(hops, max_rounds - depth)):
            depth += 1
            layer = (layer.join(edges, F.col("node") == F.col("src"))
                     .select("seed", F.col("dst").alias("node")).distinct())
            layers.append(layer.withColumn("depth", F.lit(depth)))
        step = union_all(layers).groupBy("seed", "node").agg(F.min("depth").alias("depth"))
        if found:
            step = step.join(union_all(found).select("seed", "node"), ["seed", "node"], "left_anti")
        step = materialize(step)
        if step.isEmpty():
            break
        found.append(step)
        # Pairs found on the last hop still have unexplored children.
        frontier = step.filter(F.col("depth") == depth).select("seed", "node")
    if not found:
        return frontier.select("seed", "node", F.lit(0).alias("depth")).limit(0)
    return union_all(found)


class ReachSets(NamedTuple):
    """Which seeds reach which node, 64 seeds to a row.

    ``classes (node, class, own)``: all nodes reached from the same seeds share a
    class; ``own`` tells that they count the seeds that start at the class's node.
    ``sets (class, own, word, bits)``: the seeds of a class.  ``numbers (seed, word,
    bit)``: where a seed's bit is.  Nodes that no seed reaches are not listed.
    """

    classes: DataFrame
    sets: DataFrame
    numbers: DataFrame


_BITS = "explode(filter(sequence(0, 63), i -> getbit(bits, i) = 1)) AS bit"


def reach_sets(edges: DataFrame, seeds: DataFrame, include_starts: bool = False) -> ReachSets:
    """The seeds with a directed path of at least one edge to a node, as bit sets of contracted nodes.

    Chains of single parents contract to the seed or junction where they begin, so
    rounds and rows follow the junctions between the seeds and not the nodes.  With
    ``include_starts`` a seed also reaches the node it starts at.  ``seeds``: see
    ``reach``.
    """
    edges = materialize(edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    marks = seeds.select("seed", "node").distinct()
    # Seeds that start near each other get neighbouring bits; each range of them starts a new word.
    numbers = materialize(marks.groupBy("seed").agg(F.min("node").alias("at")).repartitionByRange("at", "seed")
                          .sortWithinPartitions("at", "seed").select("seed", F.monotonically_increasing_id().alias("n"))
                          .select("seed", F.expr("shiftright(n, 6)").alias("word"), F.expr("CAST(n & 63 AS INT)").alias("bit")))
    starts = materialize(marks.join(numbers, "seed").groupBy("node", "word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")))
    begun = starts.select("node").distinct()
    single = (edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("parent"))
              .filter("n = 1").join(begun, "node", "left_anti"))
    chains = chain_roots(single)
    # A circle of single parents has no way in, so no seed reaches it.
    core = materialize(contract(edges, chains.select("node", "root")))
    ahead = lambda rows: (rows.join(core, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node"), "word")
                          .agg(F.bit_or("bits").alias("bits")))
    none, reached, frontier, more = F.lit(0).cast("long"), None, starts, 1
    while more:
        # Two hops a round.  ``near`` are bits whose next edges have been followed, ``old`` those known before.
        near = ahead(frontier)
        step = [near.select("node", "word", "bits", F.col("bits").alias("near"), none.alias("old")),
                ahead(near).select("node", "word", "bits", none.alias("near"), none.alias("old"))]
        if reached is not None:
            step.append(reached.select("node", "word", "bits", F.col("bits").alias("near"), F.col("bits").alias("old")))
        step, more = materialize_counted(union_all(step).groupBy("node", "word").agg(
            *[F.bit_or(c).alias(c) for c in ("bits", "near", "old")]), F.col("bits") != F.col("near"))
        reached = step.select("node", "word", "bits")
        frontier = step.filter("bits <> near").select("node", "word", F.expr("bits & ~near").alias("bits"))
    own = materialize(reached.unionByName(starts).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")))
    sets = own.select(F.col("node").alias("class"), F.lit(True).alias("own"), "word", "bits")
    known = own.select("node").distinct()
    root = chains.filter("NOT endless").select("node", F.col("root").alias("class")).join(
        known.select(F.col("node").alias("class")), "class", "left_semi").select("node", "class", F.lit(True).alias("own"))
    if include_starts:
        return ReachSets(root.unionByName(known.select("node", F.col("node").alias("class"), F.lit(True).alias("own"))), sets, numbers)
    # A seed's own node counts only what comes back to it.
    back = reached.join(begun, "node", "left_semi")
    other = reached.join(begun, "node", "left_anti").select("node").distinct()
    classes = union_all([root, other.select("node", F.col("node").alias("class"), F.lit(True).alias("own")),
                         back.select("node").distinct().select("node", F.col("node").alias("class"), F.lit(False).alias("own"))])
    sets = sets.unionByName(back.select(F.col("node").alias("class"), F.lit(False).alias("own"), "word", "bits"))
    return ReachSets(classes, sets, numbers)


def seeds_per_node(sets: ReachSets) -> DataFrame:
    """``(node, seeds)``: by how many seeds a node is reached."""
    size = sets.sets.groupBy("class", "own").agg(F.sum(F.bit_count("bits")).alias("seeds"))
    return sets.classes.join(size, ["class", "own"]).select("node", "seeds")


def _per_seed(rows: DataFrame, sets: ReachSets, totals: list[str]) -> DataFrame:
    """Sums of ``totals`` over the rows (word, bits, ...) whose bits include a seed."""
    return (rows.select("word", *totals, F.expr(_BITS)).groupBy("word", "bit").agg(*[F.sum(c).alias(c) for c in totals])
            .join(sets.numbers, ["word", "bit"]).select("seed", *totals))


def distinct_per_seed(members: DataFrame, sets: ReachSets, column: str, name: str) -> DataFrame:
    """``(seed, name)``: how many distinct values of ``column`` the nodes have that a seed reaches.

    ``members``: class, own and the column.  Sets are united per value, so values
    and not nodes meet the seeds.
    """
    united = (members.filter(F.col(column).isNotNull()).select("class", "own", column).distinct()
              .join(sets.sets, ["class", "own"]).groupBy(column, "word").agg(F.bit_or("bits").alias("bits")))
    return _per_seed(united.withColumn(name, F.lit(1).cast("long")), sets, [name])


def totals_per_seed(members: DataFrame, sets: ReachSets, totals: dict[str, Column]) -> DataFrame:
    """``(seed, totals)``: sums over all nodes a seed reaches, summed by class first."""
    summed = members.groupBy("class", "own").agg(*[F.sum(c).alias(k) for k, c in totals.items()])
    return _per_seed(summed.join(sets.sets, ["class", "own"]), sets, list(totals))


def blast_radius(events: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(seed, descendants, affected_agents, tools, consequences)`` of all seeds that reach an event."""
    sets = reach_sets(edges, seeds)
    nodes = events.select(F.col("event_id").alias("node"), "event_type", "actor_id",
                          F.when(F.col("event_type") == "tool_call", F.col("target_id")).alias("tool"))
    members = materialize(nodes.join(sets.classes, "node").drop("node"))
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    sums = totals_per_seed(members, sets, {"descendants": F.lit(1).cast("long"),
                                           "consequences": one(F.coalesce(F.col("event_type") == "consequence", F.lit(False)))})
    agents = distinct_per_seed(members, sets, "actor_id", "affected_agents")
    tools = distinct_per_seed(members, sets, "tool", "tools")
    none = F.lit(0).cast("long")
    return (sums.join(agents, "seed", "left").join(tools, "seed", "left")
            .select("seed", "descendants", F.coalesce("affected_agents", none).alias("affected_agents"),
                    F.coalesce("tools", none).alias("tools"), "consequences"))


def shortest_paths(edges: DataFrame, order: DataFrame, seeds: DataFrame, targets: DataFrame) -> DataFrame:
    """One shortest causal path per (seed, reached target).

    Ties go to the path whose events come first in input order, which is the
    order a breadth-first search over the event list would find.  ``order`` maps
    ``event_id`` to ``ord``; ``targets`` has ``node``.
    """
    # Events are numbered in input order, so a path is a list of whole numbers that compares as its events do;
    # ids come back only for the paths that are results.
    numbers = materialize(order.groupBy("event_id").agg(F.min("ord").alias("ord")).repartitionByRange("ord", "event_id")
                          .sortWithinPartitions("ord", "event_id").select("event_id", F.monotonically_increasing_id().alias("n")))
    number = lambda name: numbers.select(F.col("event_id").alias(name), F.col("n").alias(f"{name}_n"))
    edges = materialize(edges.select("src", "dst").distinct().join(number("src"), "src").join(number("dst"), "dst")
                        .select(F.col("src_n").alias("src"), F.col("dst_n").alias("dst")))
    start = materialize(seeds.select("seed", "node").distinct().join(number("node"), "node")
                        .select("seed", F.col("node_n").alias("node"), F.array("node_n").alias("path")))
    found, frontier = [start], start
    while True:
        step = (frontier.join(edges, F.col("node") == F.col("src"))
                .select("seed", F.col("dst").alias("node"),
                        F.concat("path", F.array("dst")).alias("path"))
                .join(union_all(found).select("seed", "node"), ["seed", "node"], "left_anti")
                .groupBy("seed", "node").agg(F.min("path").alias("path")))
        step = materialize(step)
        if step.isEmpty():
            break
        found.append(step)
        frontier = step
    hits = union_all(found[1:]) if len(found) > 1 else start.limit(0)
    # Written, so that the few paths do not decide how many tasks sort all events.
    ends = materialize(targets.join(number("node"), "node").select(F.col("node_n").alias("node")).distinct())
    hits = hits.join(ends, "node", "left_semi")
    # The events on results are few beside all events, which therefore do not move to meet them.
    steps = materialize(hits.select("seed", "node", F.posexplode("path").alias("at", "n")))
    used = numbers.join(broadcast_if_small(steps.select("n").distinct()), "n", "left_semi")
    named = steps.join(used, "n").groupBy("seed", "node").agg(F.array_sort(F.collect_list(F.struct("at", "event_id"))).alias("path"))
    path = F.transform("path", lambda x: x["event_id"])
    return named.select("seed", F.element_at(path, -1).alias("node"), path.alias("path"))


def claim_support(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """Is each claim ``source -> target`` supported by a path, and by how many?

    ``edges`` has ``src, dst`` and optionally ``causal``; ``claims`` has
    ``claim_id, source, target`` and optionally ``causal_only, max_depth``
    (20).  Paths are counted as (node, depth) states with an edge into the
    target; the target itself is never expanded.
    """
    if "causal" not in edges.columns:
        edges = edges.withColumn("causal", F.lit(True))
    edges = materialize(edges.select("src", "dst", "causal"))
    claims = claims.withColumns({
        "causal_only": F.coalesce(F.col("causal_only"), F.lit(True)) if "causal_only" in claims.columns else F.lit(True),
        "max_depth": F.coalesce(F.col("max_depth"), F.lit(20)) if "max_depth" in claims.columns else F.lit(20),
    })
    claims = materialize(claims)
    frontier = claims.select("claim_id", "target", "causal_only", "max_depth", F.col("source").alias("node"))
    hits, depth = [], 0
    while True:
        step = (frontier.filter(F.col("max_depth") > depth)
                .join(edges, (F.col("node") == F.col("src")) & (F.col("causal") | ~F.col("causal_only")))
                .groupBy("claim_id", "target", "causal_only", "max_depth", F.col("dst").alias("node"))
                .agg(F.count("*").alias("n")))
        step = materialize(step)
        if step.isEmpty():
            break
        hits.append(step.filter(F.col("node") == F.col("target")).select("claim_id", "n"))
        frontier = step.filter(F.col("node") != F.col("target")).drop("n")
        depth += 1
    counted = (union_all(hits).groupBy("claim_id").agg(F.sum("n").alias("path_count")) if hits
               else claims.select("claim_id", F.lit(0).cast("bigint").alias("path_count")).limit(0))
    return claims.join(counted, "claim_id", "left").select(
        "claim_id", "source", "target", F.coalesce("path_count", F.lit(0)).alias("path_count"),
        F.col("path_count").isNotNull().alias("supported"))


def taint_id(event_id: Column, content_sha256: Column, given: Column | None = None) -> Column:
    text = F.concat_ws("|", F.coalesce(event_id, F.lit("None")), F.coalesce(content_sha256, F.lit("None")))
    made = F.concat(F.lit("TAINT-"), F.substring(F.sha2(text, 256), 1, 16))
    return F.coalesce(given, made) if given is not None else made


class Taint(NamedTuple):
    """Events with the class of their taints, and the sets of these classes."""

    events: DataFrame
    sets: ReachSets


def taint(events: DataFrame, edges: DataFrame, seeded: Column) -> Taint:
    """The taints that reach each event, a tainted source's own included."""
    sources = events.filter(seeded).select(
        taint_id(F.col("event_id"), F.col("content_sha256")).alias("seed"), F.col("event_id").alias("node"))
    sets = reach_sets(edges, sources, include_starts=True)
    tainted = events.join(sets.classes.withColumnRenamed("node", "event_id"), "event_id").select(
        "event_id", "event_type", "actor_id", "session_id", "class", "own")
    return Taint(materialize(tainted), sets)


def taint_labels(spread: Taint) -> DataFrame:
    """Every ``(event_id, taint_id)``: the one result that lists all pairs."""
    bits = spread.sets.sets.select("class", "own", "word", F.expr(_BITS)).join(spread.sets.numbers, ["word", "bit"])
    return spread.events.join(bits, ["class", "own"]).select("event_id", F.col("seed").alias("taint_id"))


def taint_lineage(spread: Taint) -> DataFrame:
    """Tainted events with the number of their taints."""
    size = spread.sets.sets.groupBy("class", "own").agg(F.sum(F.bit_count("bits")).alias("taints"))
    return spread.events.join(size, ["class", "own"]).select(
        "event_id", "event_type", "actor_id", "session_id", "taints",
        F.coalesce(F.col("event_type").isin(SINK_TYPES), F.lit(False)).alias("is_sink"))


def taint_sinks(spread: Taint) -> DataFrame:
    """``(event_type, taint_id, n)``: sinks a taint reaches, by their type."""
    per_class = (spread.events.filter(F.col("event_type").isin(SINK_TYPES))
                 .groupBy("class", "own", "event_type").agg(F.count("*").alias("n")))
    return (per_class.join(spread.sets.sets, ["class", "own"]).select("event_type", "n", "word", F.expr(_BITS))
            .groupBy("event_type", "word", "bit").agg(F.sum("n").alias("n"))
            .join(spread.sets.numbers, ["word", "bit"]).select("event_type", F.col("seed").alias("taint_id"), "n"))


def taint_spread(spread: Taint) -> DataFrame:
    """Taints seen in more than one session."""
    named = spread.events.filter("session_id <> ''")
    return distinct_per_seed(named, spread.sets, "session_id", "session_count").filter("session_count > 1").select(
        F.col("seed").alias("taint_id"), "session_count")


def cascade(radius: DataFrame) -> DataFrame:
    """Seeds with a causal consequence path and at least two affected agents."""
    return radius.filter("consequences > 0 AND affected_agents >= 2").select(
        "seed", "affected_agents", "consequences")


def below_cycle(edges: DataFrame) -> DataFrame:
    """Nodes that topological peeling cannot remove: on a cycle or below one.

    A node with one incoming edge shares the fate of where its chain of single
    parents begins, so whole chains contract at once; then sources go with their
    edges.  A chain of n nodes takes log2(n) rounds instead of n.  Without a
    source left, every node has an endless way back and stays.
    """
    live, left = materialize_counted(
        edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct(), F.lit(True))
    contracted = []
    while left:
        kept, remaining = materialize_counted(
            live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"), F.lit(True))
        if remaining in (0, left):
            live = kept
            break
        single = kept.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("parent"))
        chains = chain_roots(single.filter("n = 1")).filter("NOT endless").select("node", "root")
        live, left = materialize_counted(contract(kept, chains), F.lit(True))
        contracted.append(chains)
    nodes = live.select(F.col("dst").alias("node")).distinct()
    for chains in reversed(contracted):
        below = chains.join(nodes.select(F.col("node").alias("root")), "root", "left_semi").select("node")
        nodes = materialize(nodes.unionByName(below))
    return nodes


def chain_roots(single: DataFrame) -> DataFrame:
    """``(node, root, endless)``: where the chain of single parents of each node begins, by pointer doubling.

    ``single`` has ``node, parent``, one row a node.  The root is the first node up
    the chain without a row of its own.  A chain that runs into a circle has none
    and is endless.
    """
    def jump(rows: DataFrame) -> DataFrame:
        on = rows.select(F.col("node").alias("root"), F.col("root").alias("further"))
        return rows.join(on, "root", "left").select(
            "node", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))

    pointers = materialize(single.select("node", F.col("parent").alias("root")))
    moving = None
    while True:
        # Two jumps a round: four times as far.
        pointers, still = materialize_counted(jump(jump(pointers).drop("moved")), F.col("moved"))
        # A finite chain has nodes at every distance, so each round some of them arrive.
        if still in (0, moving):
            return pointers.select("node", "root", F.col("moved").alias("endless"))
        moving, pointers = still, pointers.drop("moved")


def contract(edges: DataFrame, chains: DataFrame) -> DataFrame:
    """Edges after each node of ``chains(node, root)`` is merged into its root."""
    root = chains.select(F.col("node").alias("src"), "root")
    return (edges.join(chains.select(F.col("node").alias("dst")), "dst", "left_anti").join(root, "src", "left")
            .select(F.coalesce("root", "src").alias("src"), "dst").distinct())


def parent_cycles(parents: DataFrame) -> DataFrame:
    """Nodes whose chain of single parents never ends, by pointer doubling.

    ``parents`` has ``trace, node, parent``.  After k rounds a pointer spans 2^k
    steps, so a chain of n nodes needs log2(n) rounds.  A chain that ends has nodes at
    every distance from its end: once no node goes, the rest is endless.
    """
    def nodes(rows: DataFrame) -> int:
        return rows.select("trace", "node").distinct().count()

    live, total = materialize_counted(parents.filter("parent IS NOT NULL").select("trace", "node", "parent"), F.lit(True))
    span, left = 1, total
    while left and span <= 2 * total:
        hop = live.select("trace", F.col("node").alias("parent"), F.col("parent").alias("up"))
        before, rows = live, left
        live, left = materialize_counted(
            live.join(hop, ["trace", "parent"]).select("trace", "node", F.col("up").alias("parent")), F.lit(True))
        # Where a node has several parents, rows may be as many by chance.
        if left == rows and nodes(live) == nodes(before):
            break
        span *= 2
    return live.select("trace", "node").distinct()


def authority_graph(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of events, their parents and the authorities they used.

    An id that is both an event and somebody's parent keeps its event kind.
    """
    aid = F.concat(F.lit("authority:"), "authority_id")
    seen = union_all([
        events.select(F.col("event_id").alias("id"), F.coalesce("event_type", F.lit("event")).alias("kind"),
                      F.lit(0).alias("rank")),
        events.filter("parent_event_id <> ''").select(
            F.col("parent_event_id").alias("id"), F.lit("parent").alias("kind"), F.lit(1).alias("rank")),
        events.filter("authority_id <> ''").select(
            aid.alias("id"), F.lit("authority").alias("kind"), F.lit(2).alias("rank")),
    ])
    nodes = seen.groupBy("id").agg(F.min_by("kind", "rank").alias("kind"))
    edges = union_all([
        events.filter("parent_event_id <> ''").select(
            F.col("parent_event_id").alias("src"), F.col("event_id").alias("dst"), F.lit("parent").alias("kind")),
        events.filter("authority_id <> ''").select(
            aid.alias("src"), F.col("event_id").alias("dst"), F.lit("authorizes").alias("kind")),
    ])
    return nodes, edges
