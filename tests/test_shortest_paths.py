"""Shortest causal paths against plain Python, and what they move."""

import random

from caseweave.operators import graph as G


def test_ties_go_to_input_order(spark):
    """Among equally short paths the one whose events come first; events of one place by their id."""
    rng = random.Random(4)
    nodes = [f"e{i}" for i in range(30)]
    place = {x: rng.randrange(12) for x in nodes}
    edges = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(70)})
    seeds, targets = nodes[:5], nodes[10:]
    want = {}
    for s in seeds:
        best, layer = {s: [(place[s], s)]}, {s: [(place[s], s)]}
        while layer:
            step = {}
            for a, b in edges:
                if a in layer and b not in best:
                    step[b] = min(step.get(b, [(99, "")]), [*layer[a], (place[b], b)])
            best |= step
            layer = step
        want |= {(s, t): [x for _, x in best[t]] for t in targets if t in best and t != s}
    out = G.shortest_paths(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(list(place.items()), "event_id string, ord int"),
                           spark.createDataFrame([(s, s) for s in seeds], "seed string, node string"), spark.createDataFrame([(t,) for t in targets], "node string"))
    got = {(r["seed"], r["node"]): r["path"] for r in out.collect()}
    assert len(want) > 30 and got == want


def test_paths_move_as_numbers(spark):
    """100 chains of 16 events with long ids: the ids of a path are not moved with every step."""
    e = spark.range(1600).selectExpr("sha2(string(id), 512) AS event_id", "id AS ord", "CASE WHEN id % 16 > 0 THEN sha2(string(id - 1), 512) END AS src")
    seeds = e.filter("ord % 16 = 0").selectExpr("string(ord) AS seed", "event_id AS node")
    ends = e.filter("ord % 16 = 15").selectExpr("event_id AS node")
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        before = _bytes(spark)
        got = G.shortest_paths(e.filter("src IS NOT NULL").selectExpr("src", "event_id AS dst"), e.select("event_id", "ord"), seeds, ends).collect()
        assert len(got) == 100 and all(len(r["path"]) == 16 and r["path"][-1] == r["node"] for r in got)
        assert _bytes(spark) - before < 4_000_000
    finally:
        for k in keys:
            spark.conf.unset(k)


def _bytes(spark):
    """Shuffle bytes written so far."""
    sc = spark.sparkContext
    empty = sc._jvm.java.util.ArrayList
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(empty(), False, False, sc._gateway.new_array(sc._jvm.double, 0), empty())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))
