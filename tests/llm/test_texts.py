"""Language model, fingerprints, quality rules, URL and line filters."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseweave.llm import attention, fingerprint, line_dedup, lm_scoring, quality, url_filter

from tests.llm.conftest import make, prose, SCHEMA


def test_base_scores_and_counts(odd, odd_rows, none):
    learn = (F.crc32(F.col("doc_id").cast("string")) % 10) != 0
    rows = lm_scoring.score_documents(odd, learn).collect()
    own = [i is not None and zlib.crc32(str(i).encode()) % 10 != 0 for i, _, _ in odd_rows]
    tokens = [(t or "").encode().lower().split() + ["end"] for _, t, _ in odd_rows]
    count = Counter(w for ws, o in zip(tokens, own) if o for w in ws)
    n, v = sum(count.values()), len(count)
    want = [(i, not o, len(ws), sum(w in count for w in ws), n,
             round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 5))
            for (i, _, _), ws, o in zip(odd_rows, tokens, own)]
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert lm_scoring.score_documents(none, learn).collect() == []


def test_nothing_to_learn_from(odd):
    rows = lm_scoring.score_documents(odd, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in rows)


def test_model_beats_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learn = (F.crc32(F.col("doc_id").cast("string")) % 10) != 0
    out = lm_scoring.score_documents(docs, learn).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_subwords_of_words():
    with open(f"{lm_scoring.TOKENIZERS}/{lm_scoring.VOCABULARY}", "rb") as file:
        coder = lm_scoring.Subwords(file.read())
    words = [b"the", b"caf\xc3\xa9", b"a\xc2\xa0b", b"x\xe2\x80\x83", b"", b"can't", b"!!", b"\xff\xfe", b"12ab"]
    together = coder.each(words)
    assert [x.tolist() for x in together] == [coder.text([w]).tolist() for w in words]


def test_attention_windows_score_each_token_once():
    rng = np.random.default_rng(0)
    counts = np.round(1e5 / (1 + np.arange(2000)) ** 1.1)
    code = attention.coding(counts)
    shape = (code.rows, attention.CLASSES)
    bigram = attention.bigram_table(np.bincount(code.cls, counts, attention.CLASSES), rng.poisson(0.1, shape).astype(float))
    weights, table = attention.initial(code, bigram)
    count = np.array([1, 40, 0, 16, 17, 100])
    tokens = rng.integers(0, 2000, count.sum())
    begins = rng.random(2000) < 0.4
    got, begun = attention.Scorer(weights, table, code, end=7, windows=2, begins=begins).score(tokens, count)
    start = np.cumsum(count) - count
    for d in range(len(count)):
        mine = tokens[start[d]: start[d] + count[d]]
        inputs = np.concatenate([[7], mine[:-1]])
        for i in range(len(mine)):
            x = code.row[inputs[max(0, (i // 16 - 1) * 16): i + 1]][None]
            _, out = attention.attend(weights, x, attention._position_factor(weights["d"], 1, x.shape[1]))
            every = (table[x[0, -1]] @ attention.gate(weights, out)[0])[code.cls] * np.exp(code.within)
            assert abs(every.sum() - 1) < 1e-4
            assert abs(np.log(every[mine[i]]) - got[start[d] + i]) < 1e-4
            assert abs(np.log(every[begins].sum()) - begun[start[d] + i]) < 1e-4
    whole = np.exp(code.within) * bigram[3, code.cls]
    assert abs(whole.sum() - 1) < 1e-6


def test_gradients_by_difference():
    rng = np.random.default_rng(1)
    counts = np.round(1e5 / (1 + np.arange(1000)) ** 1.1)
    code = attention.coding(counts)
    bigram = attention.bigram_table(np.bincount(code.cls, counts, attention.CLASSES),
                                    np.zeros((code.rows, attention.CLASSES)))
    weights, table = attention.initial(code, bigram)
    x, y = rng.integers(0, 60, (3, 32)), rng.integers(0, 60, (3, 32))
    valid = rng.random((3, 32)) < 0.8
    _, grads, mine = attention.gradients(weights, table, x, y, valid)
    assert np.abs(mine.sum(1) - valid.ravel()).max() < 1e-4
    for name, g in grads.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        losses = []
        for change in (0.02, -0.02):
            moved = {k: w.copy() for k, w in weights.items()}
            moved[name][at] += change
            losses.append(attention.gradients(moved, table, x, y, valid)[0])
        assert abs((losses[0] - losses[1]) / 0.04 - g[at]) < 0.1 * abs(g[at]) + 2e-5, name


def test_fingerprints_of_edits(odd, odd_rows, none):
    rows = fingerprint.edit_probe(odd).collect()
    order = sorted(odd_rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [t or "" for _, t, _ in order]
    want = []
    for k, t in enumerate(texts):
        changed = t[: len(t) - len(t) // 2] + texts[(k + 1) % len(texts)][: len(t) // 2]
        want.append((order[k][0], len(t), hashlib.sha256(changed.encode()).hexdigest()))
    assert sorted(map(str, [(r.doc_id, r.n_chars, r.edited_sha256) for r in rows])) == sorted(map(str, want))
    by_text = {}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id is not None:
            by_text.setdefault({i: t or "" for i, t, _ in odd_rows}[r.doc_id], set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    assert by_text[""] == {""}
    long = [r for r in rows if r.n_chars > 500]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.2
    assert fingerprint.edit_probe(none).collect() == []


def test_lone_document_follows_itself(spark):
    df = spark.createDataFrame([(1, "abcdefg")], "doc_id long, text string")
    r = fingerprint.edit_probe(df).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdabc").hexdigest() and r.near_next == 1.0


def test_pair_counts_and_selection():
    rng = np.random.default_rng(0)
    buf = rng.integers(97, 103, 140_000).astype(np.uint8)
    counts = fingerprint.pair_counts(buf)
    w = fingerprint.WIDTH
    for i in (0, 1, 65_520, 65_535, 65_536, 131_071, len(buf) - w):
        part = buf[i: i + w]
        assert counts[i] == sum(part[a] == part[b] for a in range(w) for b in range(a))
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (0, 3, 15, 16, 17, 50, 400, 5000)]
    rank = fingerprint.precedence(rng.integers(0, 1000, fingerprint.LEVELS))
    together, alone = fingerprint.features(texts, rank), [fingerprint.features([t], rank)[0] for t in texts]
    assert all((a == b).all() for a, b in zip(together, alone))
    assert [len(f) > 0 for f in together] == [False] + [True] * 7
    a, b = fingerprint.digests([texts[7], texts[6]], rank)
    assert a.like(a) == 1.0 and a.like(b) == b.like(a) < 0.1


@pytest.fixture(scope="module")
def labelled(spark, odd):
    rng = random.Random(8)
    rows = [(1000 + k, prose(rng, 60) if k % 3 else " ".join(w.upper() + "!!" for w in prose(rng, 60).split()), "s")
            for k in range(240)]
    docs = spark.createDataFrame(make(rows), SCHEMA).unionByName(odd).persist()
    labels = [(i, int(t[-1] != "!"), 0) for i, t, _ in rows] + [(3, None, 0), (None, 1, 0), (5, 1, 0), (5, 1, 0), (9999, 0, 0)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_scores_are_the_rules_applied_by_hand(labelled):
    """Each text's statistics against the model's conditions and weights, in plain Python."""
    docs, labels = labelled
    model, stats = quality.learn(docs, labels)
    assert model.rules
    told = {}
    for r in stats.collect():
        x = r["__stats"]
        fired = sum(w for rule, w in model.rules if eval(re.sub(r"(\d)D\b", r"\1", rule).replace("$", "x").replace(" AND ", " and "), {"x": x}))
        told.setdefault(r.doc_id, set()).add(round(1 / (1 + math.exp(-(model.intercept + fired))), 9))
    rows = quality.classify(docs, labels).collect()
    assert len({round(r.score, 9) for r in rows}) > 1
    for r in rows:
        assert round(r.score, 9) in told[r.doc_id] and r.predicted == (r.score >= 0.3)


def test_quality_rules(labelled, odd, none):
    docs, labels = labelled
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    said = {r.doc_id: r.predicted for r in rows}
    truth = {r.doc_id: r.quality for r in labels.filter("doc_id >= 1000 AND doc_id < 9999").collect()}
    assert np.mean([said[i] == q for i, q in truth.items()]) > 0.97
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted for r in rows)
    assert quality.classify(none, labels).collect() == []
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}


def test_labels_of_held_out_rows_do_not_matter(labelled):
    docs, labels = labelled
    flipped = labels.withColumn("quality", F.when(quality.is_held_out(F.col("doc_id")), 1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    one = {(r.doc_id, round(r.score, 9)) for r in quality.classify(docs, labels).collect()}
    assert one == {(r.doc_id, round(r.score, 9)) for r in quality.classify(docs, flipped).collect()}


def test_lasso_leaves_few_weights():
    rng = np.random.default_rng(0)
    x = (rng.random((400, 12)) < 0.5).astype(float)
    p = 1 / (1 + np.exp(-(3 * x[:, 2] - 2 * x[:, 5] - 0.5)))
    n = np.full(400, 5.0)
    intercept, w = quality.lasso(x, n, rng.binomial(5, p).astype(float), 0.02)
    assert w[2] > 1 and w[5] < -0.5 and (np.abs(w) < 1e-9).sum() >= 5


URLS = ["http://A.Example.com/en/x?q", "https://www.example.com/en/", "http://example.com/english", "http://x.net/es/1",
        "http://x.net/fr", "http://net/fr/a", "http://badexample.com/en/", "ftp://com", "no scheme", "", None,
        "http://host:80/p#f", "http://com/", "x://y://z.com/a", "http://u.org/a/b", "http://" + "s." * 400 + "net/es/"]


def judged(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])]
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
    return (url, host, path, *rule)


def test_url_rules(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block"), ("org", "", "block"), ("u.org", "/a", "allow")]
    pages = spark.createDataFrame([(u, u, "h", "clash") for u in URLS + URLS[:2]], "page_id string, url string, html string, rule string")
    entries = spark.createDataFrame(rules + [(None, "/", "block"), ("com", "/", "block")], "host string, path string, verdict string")
    want = sorted(map(str, (judged(u, rules) for u in URLS + URLS[:2])))
    for limit in (url_filter.MAX_ARRAY_BYTES, 0):
        rows = url_filter.filter_urls(pages, entries, max_array_bytes=limit).collect()
        assert sorted(str(tuple(r)) for r in rows) == want
    assert url_filter.filter_urls(pages.limit(0), entries).collect() == []
    assert {r.verdict for r in url_filter.filter_urls(pages, entries.limit(0)).collect()} == {"allow"}


def test_digest_array_tells_colliding_keys_apart(monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda e: len(e))
    array = url_filter.DigestArray(["aa", "bb", "c"])
    assert array.probe([b"bb", b"aa", b"cc", b"c", b"dddd"]).tolist() == [1, 0, -1, 2, -1]


def test_boilerplate_lines(spark):
    page = lambda *lines: "<p>" + "</p><p>".join(lines) + "</p>"
    pages = [(k, f"http://h{k % 2}.org/{k}", page("menu", f"own {k}", "half" if k % 4 == 0 else "x" + str(k), "menu"), 1)
             for k in range(8)]
    pages += [(20, None, page("menu"), 1), (21, "http://solo.org/", page("only"), 1), (22, "http://h0.org/", None, 1),
              (23, "http://h0.org/", "", 1), (3, *pages[3][1:])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, row int")
    rows = line_dedup.drop_boilerplate(line_dedup.page_lines(df)).collect()
    want = []
    hosts = [(u or "://").split("://")[1].split("/")[0] for _, u, _, _ in pages]
    lines = [line_dedup.html_lines(h) for _, _, h, _ in pages]
    for (i, *_), host, own in zip(pages, hosts, lines):
        mates = [x for x, h in zip(lines, hosts) if h == host]
        n = Counter(x for m in mates for x in set(m))
        kept = [x for x in own if not (n[x] >= 3 and n[x] > 0.5 * len(mates))]
        want.append((i, host, len(own), len(own) - len(kept), kept))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in rows)
    assert line_dedup.drop_boilerplate(line_dedup.page_lines(df.limit(0))).collect() == []


def test_html_lines():
    html = "<html><head><title>T &amp; x</title><style>p{}</style><SCRIPT a='1'>if (a<b) c</SCRIPT></head><p>a <b>b</b>\n c<br/> d <!-- <p>no --></p>"
    assert line_dedup.html_lines(html) == ["T &amp; x", "a b", "c", "d"]


def test_texts_to_learn_from_teach_their_order(spark):
    words = ["river", "stone", "light", "garden", "winter", "copper", "silver", "table"]
    rows = [(i, " ".join(words[(i + j) % 8] for j in range(120))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = lm_scoring.score_documents(docs, F.col("doc_id") % 5 != 0)
    total = out.filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert total[0] > 0.6 * total[1]


def test_words_to_learn_from_reach_their_round_whole(spark, odd, odd_rows):
    with open(f"{lm_scoring.TOKENIZERS}/{lm_scoring.VOCABULARY}", "rb") as file:
        vocabulary = file.read()
    coder = lm_scoring.Subwords(vocabulary)
    rows = lm_scoring.encode(odd, vocabulary, "doc_id", "text", F.col("source").isNotNull()).filter("kind = 'doc'").collect()
    got = sorted(np.frombuffer(r.tokens, np.uint16).tolist() for r in rows if r.learn)
    end = lm_scoring.END
    want = sorted([end, *np.concatenate([[], *coder.each((t or "").lower().encode().split())]).astype(int).tolist(), end]
                  for _, t, source in odd_rows if source is not None)
    assert got == want and len(rows) == len(odd_rows)
    assert {r.round for r in rows if r.learn} == set(range(lm_scoring.ROUNDS))


def test_every_token_is_one_transition():
    rng = np.random.default_rng(3)
    code = attention.coding(np.round(1e5 / (1 + np.arange(2000)) ** 1.1))
    weights, table = attention.initial(code, np.full((code.rows, attention.CLASSES), 1 / attention.CLASSES))
    texts = [rng.integers(0, 2000, n) for n in (2, 1, 40, 33, 34, 5000)]
    trainer = attention.Trainer(weights, table, code, 0.02)
    trainer.learn(texts)
    want = sum(np.bincount(code.row[t[:-1]].astype(np.int64) * attention.CLASSES + code.cls[t[1:]],
                           minlength=code.rows * attention.CLASSES) for t in texts)
    assert np.abs(trainer.counts.sum(axis=1) - want).max() < 1e-3
    assert trainer.seen == want.sum()
