import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from caseweave.llm import mixing, sharding


def test_shards_hold_the_row_law(odd, odd_rows):
    rows = sharding.shard_rows(odd, 7).collect()
    assert len(rows) == len(odd_rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 7
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in odd_rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want


def test_shards_many_buckets_equal_the_plan(odd, monkeypatch):
    one = {(r.doc_id, r.text_crc32): r.shard for r in sharding.shard_rows(odd, 5).collect()}
    again = {(r.doc_id, r.text_crc32): r.shard for r in sharding.shard_rows(odd.repartition(5), 5).collect()}
    assert one == again
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 1)
    rows = sharding.shard_rows(odd, 5, virtual_nodes=2).collect()
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)


def test_no_rows_no_shards(none):
    assert sharding.shard_rows(none, 3).collect() == []
    assert mixing.mix(none, [1.0]).collect() == []


def test_ring_moves_few_keys():
    """With one more shard, keys of the unbounded ring only move to the new shard."""
    def owner(arcs):
        cells, at = [], 0
        for cell in range(sharding.CELLS):
            while at < len(arcs) and arcs[at][0] < cell:
                at += 1
            cells.append(arcs[at % len(arcs)][1])
        return cells
    before, after = owner(sharding.ring(24)), owner(sharding.ring(25))
    assert {b for a, b in zip(before, after) if a != b} == {24}


def test_place_fills_all_capacity():
    owners = [0, 1, 2, 0, 1, 2]
    pieces = sharding.place([50, 0, 1, 9, 0, 0], owners, [20, 20, 20])
    assert sum(hi - lo for _, lo, hi, _, _ in pieces) == 60
    load = Counter()
    for _, lo, hi, shard, slot in pieces:
        assert slot == load[shard]
        load[shard] += hi - lo
    assert set(load.values()) == {20}
    ranks = sorted((lo, hi) for arc, lo, hi, _, _ in pieces if arc == 0)
    assert ranks[0][0] == 0 and ranks[-1][1] == 50 and all(a[1] == b[0] for a, b in zip(ranks, ranks[1:]))


def targets(sizes, weights, share, cap):
    """By the rule itself: share out, stop what is above, share the excess again."""
    goal, full = share * sum(sizes.values()), {s: cap * n for s, n in sizes.items()}
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w, out = {s: weights[i % len(weights)] for i, s in enumerate(order)}, {}
    while True:
        open_ = [s for s in order if s not in out]
        left = goal - sum(out.values())
        trial = {s: left * w[s] / sum(w[o] for o in open_) for s in open_}
        over = [s for s in open_ if trial[s] > full[s]]
        if not over:
            return {**out, **trial}
        out.update({s: full[s] for s in over})


@pytest.mark.parametrize("block_rows", [1024, 4])
def test_mix_meets_targets(odd, odd_rows, block_rows):
    rows = mixing.mix(odd, [5.0, 2.0, 1.0], block_rows=block_rows).collect()
    assert len(rows) == len(odd_rows)
    sizes, largest = Counter(), Counter()
    for _, t, s in odd_rows:
        n = len((t or "").encode().split())
        sizes[s] += n
        largest[s] = max(largest[s], n)
    want, taken = targets(sizes, [5.0, 2.0, 1.0], 1.5, 2.0), Counter()
    for r in rows:
        assert r.taken == r.copies * r["size"] <= 2 * r["size"]
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s], s
    key = lambda r: (r.doc_id is None, r.doc_id, r["size"], r.copies)
    again = mixing.mix(odd.repartition(2), [5.0, 2.0, 1.0], block_rows=block_rows).collect()
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 40, 500):
        p, x = rng.random(n), np.floor(rng.lognormal(5, 1.3, n))
        q = mixing.flight(p, x, rng)
        assert abs((q - p).sum()) < 1e-7 and abs((q - p) @ x) < 1e-5 * x.sum()
        assert ((q > 0) & (q < 1)).sum() <= 2
    same = mixing.flight(np.full(11, 0.3), np.append(np.full(10, 5.0), 9.0), rng)
    assert ((same > 0) & (same < 1)).sum() <= 2


def test_flight_is_unbiased():
    rng = np.random.default_rng(3)
    p, x = np.array([0.2, 0.5, 0.7, 0.4, 0.6, 0.3]), np.array([9.0, 4.0, 3.0, 5.0, 2.0, 7.0])
    mean = np.mean([mixing.flight(p, x, rng) for _ in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.04
