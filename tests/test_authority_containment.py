"""Containment by the rarest element, and denies for everyone, against plain Python."""

import random
from datetime import datetime, timedelta

import pytest

from caseweave.operators import authority as A
from caseweave.operators import gates as G
from caseweave.operators.containment import contains_all


def test_contains_all(spark):
    rng = random.Random(3)
    held = {f"o{i}": {f"x{min(rng.randrange(30), rng.randrange(30))}" for _ in range(rng.randrange(14))} for i in range(60)}
    wanted = {f"w{i}": {f"x{rng.randrange(12)}" for _ in range(1 + i % 5)} for i in range(40)} | {"none": {"absent", "x1"}, "x": {"x0"}}
    h = spark.createDataFrame([(o, x) for o, s in held.items() for x in s], "owner string, item string")
    w = spark.createDataFrame([(i, x) for i, s in wanted.items() for x in s], "id string, item string")
    got = [tuple(r) for r in contains_all(h, w, ["item"]).collect()]
    want = {(o, i) for o, s in held.items() for i, x in wanted.items() if x <= s}
    assert len(got) == len(set(got)) and set(got) == want


def test_rules(spark):
    rng = random.Random(6)
    pick = lambda n, m: [f"n{rng.randrange(m)}" for _ in range(rng.randrange(n))] or None
    rules = [(f"r{i}", pick(4, 9), pick(3, 9), pick(3, 5), pick(3, 5)) for i in range(80)] + [("all", None, [], None, None)]
    seen = [(f"c{i}", kind, f"n{rng.randrange(m)}") for i in range(25) for kind, m in (("signal", 9), ("event_type", 5)) for _ in range(6)]
    df = spark.createDataFrame(rules, "rule_id string, requires_signals array<string>, any_signals array<string>, "
                                      "requires_event_types array<string>, any_event_types array<string>")
    got = sorted(tuple(r) for r in G.evaluate_rules(df, spark.createDataFrame(seen + seen[:9], "case_id string, kind string, name string")).collect())
    want = [("*", r[0], 0, 0) for r in rules if not any(r[1:])]
    for case in {c for c, _, _ in seen}:
        have = {k: {n for c, kind, n in seen if c == case and kind == k} for k in ("signal", "event_type")}
        for rule, *groups in rules:
            rs, as_, re_, ae = (set(x or []) for x in groups)
            if not (rs | as_ | re_ | ae):
                continue
            if rs <= have["signal"] and re_ <= have["event_type"] and (not as_ or as_ & have["signal"]) and (not ae or ae & have["event_type"]):
                want.append((case, rule, len((rs | as_) & have["signal"]), len((re_ | ae) & have["event_type"])))
    assert got == sorted(want)


@pytest.mark.parametrize("most", [1, 7, 1_000_000])
def test_denies_for_everyone(spark, most):
    rng = random.Random(8)
    day = lambda: datetime(2024, 1, 1) + timedelta(days=rng.randrange(6), hours=rng.randrange(24))
    rule = lambda who: (who, [f"s{rng.randrange(3)}"], rng.choice([None, "T0"]), rng.choice([None, "*", "r1"]),
                        rng.choice([None, [], ["audit"]]), day(), day(), None, rng.random() < .1)
    grants = [rule(f"p{i % 5}") for i in range(60)]
    denies = [rule("*") for _ in range(8)] + [rule("p1") for _ in range(3)]
    actions = [(f"a{i}", f"p{rng.randrange(5)}", day(), rng.choice(["T0", "T1", None]), rng.choice(["r1", "r2", None]),
                rng.choice(["audit", None]), [f"s{rng.randrange(3)}", "s0"]) for i in range(150)]
    schema = ("principal string, scopes array<string>, tenant string, resource string, purposes array<string>, not_before timestamp, "
              "expires timestamp, revoked timestamp, disabled boolean")
    out = A.temporal_authority(
        spark.createDataFrame(actions, "action_id string, principal string, ts timestamp, tenant string, resource string, purpose string, required array<string>"),
        spark.createDataFrame(grants, schema), spark.createDataFrame(denies, schema), most=most)

    def fits(r, a):
        who, _, tenant, resource, purposes, start, end, _, off = r
        return (not off and who in ("*", a[1]) and start <= a[2] < end and tenant in (None, a[3]) and resource in (None, "*", a[4])
                and (not purposes or a[5] in purposes))

    want = {}
    for a in actions:
        scopes = {s for r in grants if fits(r, a) for s in r[1]} - {s for r in denies if fits(r, a) for s in r[1]}
        missing = sorted(set(a[6]) - scopes)
        want[a[0]] = (len(scopes), len(missing), missing[0] if missing else None, not missing)
    assert {r.action_id: (r.scopes, r.missing_scopes, r.first_missing, r.authorized) for r in out.collect()} == want


def test_shuffles_carry_classes_not_pairs(spark):
    """300 owners with one set and 300 equal wants make 90 000 pairs; what is matched and shuffled is one class of each."""
    h = spark.sql("SELECT concat('o', id) AS owner, i AS item FROM range(300), (SELECT explode(array('a', 'b', 'c')) AS i)")
    w = spark.sql("SELECT concat('w', id) AS id, i AS item FROM range(300), (SELECT explode(array('a', 'b')) AS i)")
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        before = _shuffled(spark)
        assert contains_all(h, w, ["item"]).count() == 90_000
        assert _shuffled(spark) - before < 20_000
    finally:
        for k in keys:
            spark.conf.unset(k)


def _shuffled(spark):
    """Shuffle records written so far."""
    sc = spark.sparkContext
    empty = sc._jvm.java.util.ArrayList
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(empty(), False, False, sc._gateway.new_array(sc._jvm.double, 0), empty())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_gates_of_equal_cases(spark):
    """Cases and gates of a class are judged once and all come out; equal gates with another logic are not one class."""
    quality = [(f"c{i}", f"p{i % 2}", a, q) for i in range(12) for a, q in (("a1", "VALIDATED"), ("a2", ["MISSING", "CORRELATED"][i % 3 == 0]))]
    gates = [(p, f"g{i}", ["any", "all"][i % 2]) for p in ("p0", "p1", "p9") for i in range(7)]
    needs = [(p, f"g{i}", f"r{k}", f"a{k}", "VALIDATED") for p in ("p0", "p1") for i in range(6) for k in ((1, 2) if i < 4 else (2,))]
    got = G.conclusion_gates(spark.createDataFrame(needs, "pack_id string, gate_id string, requirement string, candidate string, required_quality string"),
                             spark.createDataFrame(gates, "pack_id string, gate_id string, logic string"),
                             spark.createDataFrame(quality, "case_id string, pack_id string, artifact_id string, quality string"))
    want = set()
    for case, pack in {q[:2] for q in quality}:
        have = {a: q for c, p, a, q in quality if (c, p) == (case, pack)}
        for p, gate, logic in gates:
            if p != pack:
                continue
            asked = [a for q, g, _, a, _ in needs if (q, g) == (pack, gate)]
            hits = sum(have[a] != "MISSING" for a in asked)
            good = hits > 0 if logic == "any" else hits == len(asked)
            want.add((case, pack, gate, "supported" if good else "not_supported", len(asked) - hits, 0))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
