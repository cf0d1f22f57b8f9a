"""SimHash, substring dedup and decontamination against brute force."""

import hashlib
import random
from itertools import combinations

import numpy as np
import xxhash

from caseweave.llm import decontamination, simhash, substring_dedup
from caseweave.llm.components import component_roots


def brute_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, errors=4):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= errors and label[i] != label[j]:
                    label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
                    changed = True
    return label


def test_simhash_groups(odd, odd_rows, none):
    rows = simhash.near_duplicates(odd).collect()
    fps = [brute_fingerprint(t) for _, t, _ in odd_rows]
    label, least = components(fps), {}
    for (i, _, _), c in zip(odd_rows, label):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted(str((i, f - (1 << 64) if f >> 63 else f, least.get(c))) for (i, _, _), f, c in zip(odd_rows, fps, label))
    assert sorted(str(tuple(r)) for r in rows) == want
    assert fps[[i for i, _, _ in odd_rows].index(105)] == 0
    assert simhash.near_duplicates(none).collect() == []


def test_keys_meet_for_every_error_pattern():
    rng = random.Random(1)
    golay = simhash.Golay()
    assert sorted(set(golay.count)) == [1, 6]
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.choice((1, 2, 3, 4, 4, 4))):
            b ^= 1 << bit
        keys = [set(simhash.compound_keys(golay, np.array([v], np.uint64))[0].tolist()) for v in (a, b)]
        assert keys[0] & keys[1]


def test_links_connect_a_dense_cloud(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    cloud = {centre}
    while len(cloud) < 400:
        v = rng.choice(sorted(cloud))
        for bit in rng.sample(range(64), rng.choice((1, 3, 5))):
            v ^= 1 << bit
        cloud.add(v)
    cloud |= {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(cloud)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {r.node: r.root for r in component_roots(simhash.links(df)).collect()}
    got, want = [found.get(f, f) for f in signed], components(fps)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_a_chain(spark):
    chain = list(range(200))
    random.Random(3).shuffle(chain)
    edges = spark.createDataFrame(list(zip(chain, chain[1:])) + [(500, 501)], "u long, v long")
    roots = {r.node: r.root for r in component_roots(edges).collect()}
    assert roots == {**{n: 0 for n in range(1, 200)}, 501: 500}


def brute_repeats(rows, window):
    """By the definition; repeated rows are one document, other texts of one id are not earlier than each other."""
    least, start, out = {}, {}, []
    for i, t in set(rows):
        words = (t or "").encode().split()
        for s in range(len(words) - window + 1):
            g = tuple(words[s:s + window])
            least[g] = min(least.get(g, (True, 1 << 62)), (i is None, i or 0))
            start[i, t, g] = min(start.get((i, t, g), s), s)
    for i, t in rows:
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            g = tuple(words[s:s + window])
            if least[g] < (i is None, i or 0) or start[i, t, g] < s:
                gone[s:s + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append(str((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def test_repeats_without_ids(spark):
    """Many texts without an id, and many of one id: clean ones stay whole."""
    rng = random.Random(21)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    passage = text(40)
    rows = [(None, text(60)) for _ in range(700)] + [(None, text(3) + " " + passage + " " + text(rng.randint(1, 20))) for _ in range(150)]
    rows += [(7, text(5) + " " + passage[: rng.randint(120, 200)] + " " + text(5)) for _ in range(60)]
    rows += [(9, passage + " x " + passage), (9, passage + " y"), (None, passage + " z " + passage), (None, passage + " z " + passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for part in (df, df.filter("doc_id IS NULL")):
        mine = [r for r in rows if part is df or r[0] is None]
        got = substring_dedup.remove_repeats(part).collect()
        assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got) == brute_repeats(mine, 20)


def test_repeats_equal_brute_force(odd, odd_rows, none):
    for window in (20, 8):
        rows = substring_dedup.remove_repeats(odd, window).collect()
        assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in rows) == \
            brute_repeats([(i, t) for i, t, _ in odd_rows], window)
        for r in rows:
            assert sum(s.hi - s.lo for s in r.spans) == r.n_removed
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    assert substring_dedup.remove_repeats(none).collect() == []


def test_repeats_in_periodic_text(spark):
    """Few distinct words: many windows share anchors."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(120))) for i in range(12)] + [(50, "a b " * 200), (51, "a " * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring_dedup.remove_repeats(df, 9).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got) == brute_repeats(rows, 9)


def brute_overlap(text, item, ratio=0.8, least=13):
    a, b = (text or "").lower().split(), (item or "").lower().split()
    best, ratio = None, ratio if len(b) >= least else 1.0
    for offset in range(-len(b), len(a)):
        same = [(0 <= i + offset < len(a)) and a[i + offset] == b[i] for i in range(len(b))]
        for lo in range(len(b)):
            for hi in range(lo + min(least, len(b)), len(b) + 1):
                if 0 <= lo + offset and hi + offset <= len(a) and same[lo] and same[hi - 1] \
                        and sum(same[lo:hi]) >= ratio * (hi - lo) - 1e-9:
                    best = max(best or 0, hi - lo)
    return best


def test_decontamination(spark, none):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((30, 20, 13, 9, 5))] + [(9, None), (10, "")]
    docs = []
    for k in range(40):
        body = [word() for _ in range(40)]
        item = items[k % 5][1].split()
        if k % 3:
            cut = item[rng.randrange(3):] if len(item) > 18 else item
            for j in rng.sample(range(len(cut)), len(cut) // 7):
                cut = cut[:j] + ["zz"] + cut[j + 1:]
            body[20:20] = cut
        docs.append((k, " ".join(body).upper() if k % 2 else "\n".join(body), 1))
    docs += [(90, None, 1), (91, "", 1), (92, items[0][1], 1), (92, items[0][1], 1), (None, items[1][1], 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.overlaps(df, bench).collect()
    want = sorted(str((i, k, n)) for i, t, _ in docs for k, x in items
                  if len((x or "").split()) >= 8 and (n := brute_overlap(t, x)))
    assert sorted(str((r.doc_id, r.item_id, r.overlap)) for r in rows) == want
    joined = decontamination.overlaps(df, bench, max_shared_words=0).collect()
    assert sorted(map(str, rows)) == sorted(map(str, joined))
    assert decontamination.overlaps(none, bench).collect() == []
    assert decontamination.overlaps(df, bench.limit(0)).collect() == []


def test_masks_hit_two_substitutions_in_thirteen():
    for a in range(13):
        for b in range(a):
            assert any(all(m == "0" or at + j not in (a, b) for j, m in enumerate(mask))
                       for mask in decontamination.MASKS for at in range(13 - len(mask) + 1))


def test_masks_hit_every_stretch_of_eighty_percent():
    """Lengths of 26 and more split into these; fewer substitutions are hit where more are."""
    for n in range(13, 26):
        gone = np.array([sum(1 << p for p in places) for places in combinations(range(n), n // 5)])
        hit = np.zeros(len(gone), bool)
        for mask in decontamination.MASKS:
            bits = sum(1 << j for j, bit in enumerate(mask) if bit == "1")
            for at in range(n - len(mask) + 1):
                hit |= gone & bits << at == 0
        assert hit.all()


def test_longest_match_by_brute_force():
    rng = random.Random(8)
    for _ in range(400):
        same = np.array([rng.random() < 0.75 for _ in range(rng.choice((8, 15, 30, 60)))])
        want = max((z - a for a in range(len(same)) for z in range(a + 1, len(same) + 1)
                    if same[a] and same[z - 1] and same[a:z].sum() >= 0.8 * (z - a) - 1e-9), default=0)
        a, z = decontamination.longest_match(same, 0.8)
        assert z - a == want and (z == a or same[a] and same[z - 1])


def test_altered_passages_of_more_than_two_substitutions(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items, docs = [], []
    for k, (n, places) in enumerate([(15, (2, 5, 7)), (20, (1, 8, 10, 12)), (18, (2, 5, 7)), (20, (3, 7, 11, 15))]):
        item = [word() for _ in range(n)]
        items.append((k, " ".join(item)))
        docs.append((k, " ".join([word() for _ in range(9)] + ["zz" if j in places else w for j, w in enumerate(item)]
                                 + [word() for _ in range(9)])))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, i, brute_overlap(t, items[i][1])) for i, t in docs)
    assert len(want) == 4 and all(n for *_, n in want)
    for limit in (1 << 20, 0):
        rows = decontamination.overlaps(df, bench, max_shared_words=limit).collect()
        assert sorted((r.doc_id, r.item_id, r.overlap) for r in rows) == want


def test_short_items_match_from_seven_words(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen".split()
    items = spark.createDataFrame([(n, " ".join(words[:n])) for n in (5, 6, 7, 8, 12)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x y " + " ".join(words)), (2, "x y " + " ".join(words).replace("four", "4"))], "doc_id long, text string")
    for shared in (1 << 20, 0):
        got = decontamination.overlaps(docs, items, max_shared_words=shared).collect()
        assert sorted((r.doc_id, r.item_id, r.matched) for r in got) == [(1, 7, 7), (1, 8, 8), (1, 12, 12)]
