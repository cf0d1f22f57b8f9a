"""Reversed search, spelling variants and suffix dedup against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from caseweave.llm import lexical_search, spelling, suffix_dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = 1 << 63
NO_CASES = "doc_id long, text string, item_id long, rank int, score double"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute_rank(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    holders = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        found = []
        for i, c in counted:
            m, score = 10 + 90 * c.total() * n_docs // n_terms, 0
            for t in set(terms(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders[t] + 1)))
                    score += w * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, LAST if i is None else i))
        out += [(item, r + 1, None if i == LAST else i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(map(str, out))


@pytest.mark.parametrize("blocks", [{}, {"block_items": 2}, {"block_bytes": 40}])
def test_rank(spark, odd, odd_rows, none, blocks):
    items = [(1, odd_rows[4][1]), (2, "The OF thon-ner étion"), (3, None), (4, ""), (5, "zzz nowhere"), (1, odd_rows[4][1]),
             (7, odd_rows[12][1]), (None, "of the"), (8, " ,;. "), (7, "another text of one id")]
    given = spark.createDataFrame([(i, t, 1, 2, 0.5) for i, t in items], "item_id long, text string, doc_id long, rank int, score double")
    want = brute_rank([(i, t) for i, t, _ in odd_rows], [x for x in items if x[1]])
    got = lexical_search.rank(odd, given, **blocks)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert lexical_search.rank(none, given).collect() == []
    assert lexical_search.rank(odd, given.limit(0)).collect() == []


def test_heaps_keep_the_best_over_many_pieces():
    rng = np.random.default_rng(3)
    heaps, seen = lexical_search.Heaps(5, 4), []
    for _ in range(40):
        ids, score = rng.integers(0, 1000, 7), rng.integers(0, 6, (7, 5))
        heaps.offer(ids, score)
        seen += [(i, -s, d) for d, row in zip(ids.tolist(), score.tolist()) for i, s in enumerate(row) if s]
    want = [x for i in range(5) for x in sorted(s for s in seen if s[0] == i)[:4]]
    assert sorted(zip(heaps.item.tolist(), (-heaps.score).tolist(), heaps.id.tolist())) == want


def test_long_text_is_counted_in_pieces():
    text = ("Ab-" * 700_000 + "tail").encode()
    assert lexical_search.term_counts(text) == {b"ab": 700_000, b"tail": 1}


def brute_words(rows, least=6, noise=199):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if noise and h % noise == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= least:
                n[w] += 1
    return n


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute_variants(rows, least_count=5, ratio=5, **more):
    n = {w: c for w, c in brute_words(rows, **more).items() if c >= least_count}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(map(str, out))


def test_variants(spark, odd, odd_rows, none):
    rng = random.Random(4)
    words = ["lantern", "Lanterne", "étaient", "étaiant", "übermut", "harbour", "harbor", "harbours", "aaaaaa", "aaaaaaa", "ÿÿÿÿÿÿ",
             "stepping", "stopping", "steppin", "xlantern", "lanter"]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", "", ".", "7"]) for _ in range(60))) for i in range(30)]
    rows += [(100, "lantern " * 900), (101, "lanter " * 6), (None, "HARBOUR " * 200), (None, "HARBOUR " * 200), (102, None), (103, ""),
             (104, "xlanter " * 5), (105, "q" * 50_000)] + [(i, t) for i, t, _ in odd_rows]
    df = spark.createDataFrame([(i, t, "n", 2, "r") for i, t in rows], "doc_id long, text string, word string, n int, root string")
    for noise in (199, 3, None):
        got = spelling.variants(df.repartition(5), noise=noise).collect()
        assert sorted(str(tuple(r)) for r in got) == brute_variants(rows, noise=noise)
    assert any(r.root != r.form and r.form for r in got)
    assert spelling.variants(none).collect() == []


def test_every_single_edit_is_found(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abé") for _ in range(11))
    words = {base}
    for i in range(len(base) + 1):
        for c in "abéz":
            words |= {base[:i] + c + base[i:], base[:i] + c + base[i + 1:], base[:i] + base[i + 1:]}
    words |= {"ab", "abc", "b", "a", "abab", "aba"}
    got = spelling.near_pairs(spark.createDataFrame([(w,) for w in words] + [(None,), (base,)], "word string")).collect()
    listed = sorted(w for w in words if len(w) > 1)
    want = {tuple(sorted((x, y), key=lambda w: (len(w), w))) for x in listed for y in listed if one_edit(x, y)}
    assert sorted(map(tuple, got)) == sorted(want)


def brute_bytes(rows, window=50):
    coded = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in coded:
        for a in range(len(t) - window + 1):
            first[t[a:a + window]] = min(i, first.get(t[a:a + window], i))
    out = []
    for i, t in coded:
        gone = [False] * len(t)
        for a in range(len(t) - window + 1):
            if first[t[a:a + window]] < i:
                gone[a:a + window] = [True] * window
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not before for g, before in zip(gone, [False] + gone))
        out.append((None if i == LAST else i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def byte_rows(odd_rows):
    rng = random.Random(8)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(40))
    rows = [(i, t) for i, t, _ in odd_rows]
    for i in range(60):  # pieces of one passage with different neighbours, from both sides
        lo = rng.randrange(len(passage) - 80)
        part = passage[lo: lo + rng.choice((49, 50, 51, 60, 80, 140))]
        rows.append((rng.choice((200 + i, 400 - i, 300)), rng.choice("xyz") * rng.randint(0, 60) + part + rng.choice("uvw") * rng.randint(0, 60)))
    rows += [(None, passage), (None, passage + " other"), (None, passage), (500, "\0" * 200), (501, "\0" * 120 + "a"), (502, "é" * 90),
             (503, "xé" * 90 + "é" * 60), (-5, passage[:120]), (-4, passage[30:200])]
    return rows


@pytest.mark.parametrize("bucket_bytes", [8 << 20, 3000, 400])
def test_byte_repeats(spark, odd_rows, none, monkeypatch, bucket_bytes):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bucket_bytes)
    rows = byte_rows(odd_rows)
    df = spark.createDataFrame([(i, t, 1, "f", 3) for i, t in rows], "doc_id long, text string, id int, f string, bits int")
    out = suffix_dedup.remove_repeats(df.repartition(6)).collect()
    assert sorted(str(tuple(r)[:5]) for r in out) == brute_bytes(rows)
    for r in out:
        assert sum(s.hi - s.lo for s in r.spans) == r.n_removed and hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    assert suffix_dedup.remove_repeats(none).collect() == []


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 700)
    rng = random.Random(10)
    long = "".join(rng.choice("abcd ") for _ in range(9000))
    rows = [(1, long), (2, long[333:5000] + "!" + long[5000:]), (3, long[4000:4049]), (4, long[4000:4050])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df, keep_bytes=False).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_bytes(rows)


def test_multikey_sort_and_buckets():
    rng = np.random.default_rng(2)
    words = [rng.integers(0, 3, 500).astype(np.uint64) for _ in range(4)]
    order, equal = suffix_dedup.multikey_sort(words)
    rows = [tuple(int(w[i]) for w in words) for i in range(500)]
    assert [rows[i] for i in order] == sorted(rows)
    for a, b, n in zip(order, order[1:], equal[1:]):
        assert rows[a][:n] == rows[b][:n] and (n == 4 or rows[a][n] != rows[b][n])
    cuts = sorted(set(rows))[::7]
    got = suffix_dedup.bucket_of([np.array(c, np.uint64) for c in zip(*cuts)], words)
    assert got.tolist() == [sum(c <= r for c in cuts) for r in rows]
