"""Contracted graphs: lineage cycles, seeds per node, and taint totals against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from caseweave.operators import graph as G


def peeled(edges):
    left = set(edges)
    while True:
        heads = {b for _, b in left}
        kept = {(a, b) for a, b in left if a in heads}
        if kept == left:
            return {b for _, b in left}
        left = kept


def reached_from(edges, start):
    out, todo = set(), [start]
    while todo:
        at = todo.pop()
        for a, b in edges:
            if a == at and b not in out:
                out.add(b)
                todo.append(b)
    return out


def graphs():
    for seed in range(3):
        rng = random.Random(seed)
        n = rng.choice((12, 40))
        edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(int(n * rng.choice((0.7, 1.0, 1.6))))]
        edges += [(f"c{i}", f"c{i + 1}") for i in range(9)] + [("n0", "c0"), ("n1", "n1")]
        edges += [("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("r1", "t0"), ("t0", "t1")] * (seed % 2)
        yield edges


@pytest.mark.parametrize("edges", list(graphs()))
def test_nodes_below_cycles(spark, edges):
    df = spark.createDataFrame(edges + [(None, "x"), ("y", None)], "src string, dst string")
    assert {r.node for r in G.below_cycle(df).collect()} == peeled(edges)


def test_no_cycle_and_no_edge(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "src string, dst string")
    assert G.below_cycle(df).collect() == []
    assert G.below_cycle(df.limit(0)).collect() == []


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    keep = G.materialize
    monkeypatch.setattr(G, "materialize", lambda df: written.append(1) or keep(df))
    counted = G.materialize_counted
    monkeypatch.setattr(G, "materialize_counted", lambda df, rows: written.append(1) or counted(df, rows))
    chain = spark.range(10_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert G.below_cycle(chain).collect() == []
    assert len(written) <= 20
    written.clear()
    ring = chain.unionByName(spark.createDataFrame([(5000, 100), (700, 20_000)], "src long, dst long"))
    assert G.below_cycle(ring).count() == 10_000 - 100 + 1 + 1
    assert len(written) <= 60
    written.clear()
    sets = G.reach_sets(chain, spark.createDataFrame([("s", 10), ("t", 400)], "seed string, node long"))
    assert G.seeds_per_node(sets).agg(F.sum("seeds")).first()[0] == 9990 + 9600
    assert len(written) <= 25


@pytest.mark.parametrize("edges", list(graphs()))
def test_seeds_and_totals(spark, edges):
    nodes = sorted({x for e in edges for x in e})
    rng = random.Random(len(edges))
    starts = [(f"s{i}", rng.choice(nodes)) for i in range(90)] + [("s0", nodes[3]), ("s1", "absent")]
    df = spark.createDataFrame(edges, "src string, dst string")
    seeds = spark.createDataFrame(starts + starts[:2], "seed string, node string")
    want = {}
    for seed, node in set(starts):
        want.setdefault(seed, set()).update(reached_from(edges, node))
    per_node = {n: sum(n in w for w in want.values()) for n in nodes}
    got = {r.node: r.seeds for r in G.seeds_per_node(G.reach_sets(df, seeds)).collect()}
    assert got == {n: c for n, c in per_node.items() if c}

    kinds = ["tool_call", "consequence", "memory_write", None]
    rows = [(n, kinds[i % 4], None if i % 7 == 0 else f"a{i % 5}", f"t{i % 3}") for i, n in enumerate(nodes)]
    events = spark.createDataFrame(rows, "event_id string, event_type string, actor_id string, target_id string")
    out = {r.seed: tuple(r)[1:] for r in G.blast_radius(events, df, seeds).collect()}
    by_id = {r[0]: r for r in rows}
    for seed, w in want.items():
        mine = [by_id[n] for n in w]
        if mine:
            assert out.pop(seed) == (len(mine), len({r[2] for r in mine} - {None}),
                                     len({r[3] for r in mine if r[1] == "tool_call"}), sum(r[1] == "consequence" for r in mine))
    assert not out


def test_taints(spark):
    edges = list(graphs())[1]
    nodes = sorted({x for e in edges for x in e})
    rows = [(n, ["tool_call", "view"][i % 2], f"a{i}", f"s{i % 4}" if i % 5 else "", f"h{i}", i % 3 == 0) for i, n in enumerate(nodes)]
    events = spark.createDataFrame(rows, "event_id string, event_type string, actor_id string, session_id string, "
                                         "content_sha256 string, bad boolean")
    spread = G.taint(events, spark.createDataFrame(edges, "src string, dst string"), F.col("bad"))
    names = {r.event_id: r.id for r in events.select("event_id", G.taint_id(F.col("event_id"), F.col("content_sha256")).alias("id")).collect()}
    want = {names[r[0]]: reached_from(edges, r[0]) | {r[0]} for r in rows if r[5]}
    pairs = {(n, t) for t, w in want.items() for n in w}
    assert {tuple(r) for r in G.taint_labels(spread).collect()} == pairs
    counts = {n: sum(n == a for a, _ in pairs) for n in nodes}
    assert {r.event_id: r.taints for r in G.taint_lineage(spread).collect()} == {n: c for n, c in counts.items() if c}
    session = {r[0]: r[3] for r in rows}
    spans = {t: len({session[n] for n in w} - {""}) for t, w in want.items()}
    assert {r.taint_id: r.session_count for r in G.taint_spread(spread).collect()} == {t: c for t, c in spans.items() if c > 1}
