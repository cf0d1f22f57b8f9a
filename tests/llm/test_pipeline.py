"""The stages on a small corpus with planted cases, and the registered queries' columns."""

import random

import pytest

import __spark_entry__ as entrypoint
import corpus_pipeline as pipeline
from caseweave.llm import minhash, simhash

from tests.llm.conftest import make, prose, SCHEMA

COLUMNS = {
    "op1_attention_scores": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op2_ring_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op3_entropy_digests": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
                            "near_next"],
    "op4_rule_quality": ["doc_id", "held_out", "score", "predicted"],
    "op5_url_digests": ["page_id", "host", "path", "rule", "verdict"],
    "op6_host_lines": ["page_id", "host", "n_lines", "n_dropped", "kept_text"],
    "op7_golay_simhash": ["doc_id", "fingerprint", "component_id"],
    "op8_cube_mix": ["doc_id", "source", "size", "source_size", "target", "copies", "taken"],
    "op9_anchor_repeats": ["doc_id", "n_words", "n_removed", "kept_sha256", "n_spans"],
    "op10_spaced_seeds": ["doc_id", "item_id", "matched", "overlap", "doc_start", "item_start", "item_words"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_registered_columns(spark, sf, name):
    df = entrypoint.queries()[name](spark, sf)
    assert df.columns == COLUMNS[name]
    rows = {"op5": "pages", "op6": "pages"}.get(name.split("_")[0], "documents")
    if name != "op10_spaced_seeds":
        assert df.count() == spark.read.parquet(f"{sf}/{rows}.parquet").count()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory, odd_rows):
    rng = random.Random(9)
    folder = str(tmp_path_factory.mktemp("corpus"))
    junk = [(2000 + k, " ".join(w.upper() + "!!" for w in prose(rng, 60).split()), "s0") for k in range(60)]
    good = [(3000 + k, prose(rng, 70), f"s{k % 3}") for k in range(120)]
    copies = [(4000 + k, good[k][1], "s1") for k in range(10)]
    item = " ".join(f"{w}{k}" for k, w in enumerate(prose(rng, 30).split()))
    leaks = [(5000 + k, prose(rng, 40) + " " + item + " " + prose(rng, 40), "s2") for k in range(4)]
    leaks = [(i, t.replace("the", "the", 1), s) for i, t, s in leaks]
    rows = odd_rows + junk + good + copies + leaks
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    write(make(rows), SCHEMA, "documents")
    write([(i, 0, 0) for i, _, _ in junk] + [(i, 1, 0) for i, _, _ in good], "doc_id long, quality int, toxic int", "labels")
    write([(1, item), (2, None)], "item_id long, text string", "benchmark")
    return folder, {"junk": junk, "good": good, "copies": copies, "leaks": leaks, "rows": rows}


def test_stages(spark, corpus):
    folder, planted = corpus
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        docs = pipeline.materialize(stage(spark, docs, folder))
        seen.append(docs.collect())
        assert name == "sharding" or docs.columns == columns
    ids = [{r.doc_id for r in rows} for rows in seen]
    junk, good, copies, leaks = ({i for i, _, _ in planted[k]} for k in ("junk", "good", "copies", "leaks"))
    assert not ids[0] & junk and good | copies | leaks <= ids[0]
    assert not ids[1] & copies and good | leaks <= ids[1]
    assert sum(r.doc_id == 110 for r in seen[1]) <= 1
    assert not ids[2] & leaks and good <= ids[2]
    assert ids[3] <= ids[2] and len(seen[4]) == len(seen[3])
    shards = [sum(r.shard == s for r in seen[4]) for s in range(24)]
    assert max(shards) - min(shards) <= 1


def test_empty_corpus(spark, corpus):
    folder, _ = corpus
    for _, stage in pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), folder).collect() == []


def test_repeated_rows_in_the_mix(spark, corpus):
    folder, _ = corpus
    rows = [(1, "a b c d", "s")] * 6 + [(None, "e f g", "s")] * 4 + [(2, "h i j k l", "t")] * 2
    docs = spark.createDataFrame(make(rows), SCHEMA)
    out = pipeline.mixed(spark, docs, folder).collect()
    words = sum(len(r.text.split()) for r in out)
    assert abs(words - 1.5 * sum(len(t.split()) for _, t, _ in rows)) <= 10


def edited(rng, text, n):
    words = text.split()
    for k, at in enumerate(sorted(rng.sample(range(len(words)), n))):
        words[at] = f"edit{k}"
    return " ".join(words)


def jaccard(a, b, k=5):
    a, b = ({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if (w := (t or "").lower().split()) else set()
            for t in (a, b))
    return 1.0 if a == b else len(a & b) / len(a | b)


def brute_groups(texts, similarity=0.8):
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and jaccard(texts[i], texts[j]) >= similarity:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return label


def test_edited_copies_go(spark, corpus, odd_rows):
    """Copies with edits of a similarity around 0.8, and a cloud of more near-copies than a key pairs."""
    folder, _ = corpus
    rng = random.Random(12)
    good = [(k, prose(rng, rng.choice((60, 120, 240))), "s0") for k in range(40)]
    copies = [(1000 + 10 * k + n, edited(rng, t, n), "s1") for k, t, _ in good for n in (1, 2, 4)]
    cloud = [(5000, prose(rng, 300), "s2")]
    cloud += [(5001 + k, edited(rng, cloud[0][1], 1 + k % 6), "s2") for k in range(90)]
    rows = good + copies + cloud + [(9000 + n, t, s) for n, (_, t, s) in enumerate(odd_rows)]
    docs = spark.createDataFrame(make(rows), SCHEMA).repartition(3)
    label, least = brute_groups([t for _, t, _ in rows]), {}
    for (i, _, _), c in zip(rows, label):
        least[c] = min(i, least.get(c, i))
    got = pipeline.one_per_group(spark, docs, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(least.values())
    assert 40 < len(got) < len(rows) - 150


def test_rows_are_judged_by_id_and_text(spark, corpus):
    """A shared id does not take a clean row along; a contaminated row without an id goes."""
    folder, planted = corpus
    rng = random.Random(15)
    clean, other, body, extra = (prose(rng, n) for n in (70, 80, 90, 100))
    leak = planted["leaks"][0][1]
    rows = [(7, clean, "s0"), (7, leak, "s0"), (None, leak + " more", "s1"), (None, other, "s1"), (8, None, "s1")]
    docs = spark.createDataFrame(make(rows), SCHEMA).repartition(2)
    got = pipeline.uncontaminated(spark, docs, folder).collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(str((i, t)) for i, t, _ in (rows[0], rows[3], rows[4]))
    rows = [(3, body, "s0"), (5, body, "s0"), (5, clean, "s0"), (6, other, "s1"), (6, other + " end", "s1"),
            (None, body, "s1"), (9, None, "s1"), (9, leak, "s1"), (9, leak, "s1"), (10, None, "s1"),
            (None, extra, "s1"), (None, extra, "s1"), (None, extra + " end", "s2")]
    docs = spark.createDataFrame(make(rows), SCHEMA).repartition(2)
    got = pipeline.one_per_group(spark, docs, folder).collect()
    # A copy without an id goes; of three near-copies without ids, one stays, whichever hash is the smaller one.
    once = next(r for r in got if r.doc_id is None)
    assert once.text in (extra, extra + " end")
    assert sorted(str((r.doc_id, (r.text or "")[:40])) for r in got) == \
        sorted(str((i, (t or "")[:40])) for i, t, _ in (rows[0], rows[2], rows[3], rows[6], rows[7], (None, once.text, "")))


def test_simhash_links_are_candidates(spark, corpus, monkeypatch):
    """Without bands, SimHash finds the copies within 4 bits; near fingerprints of unlike texts are no copies."""
    folder, _ = corpus
    rng = random.Random(18)
    good = [prose(rng, 400) for _ in range(12)]
    rows = [(i, t, "s0") for i, t in enumerate(good)] + [(100 + i, edited(rng, t, 1), "s1") for i, t in enumerate(good)]
    loud = prose(rng, 9)  # an odd number of shingles, so no bit is halfway
    rows += [(200 + k, " ".join([loud] * 300 + [prose(rng, 30)]), "s2") for k in range(2)]
    fps = [simhash.fingerprint(t.lower().encode(), 5) for _, t, _ in rows]
    near = {100 + i for i in range(12) if (fps[i] ^ fps[12 + i]).bit_count() <= 4}
    assert near and (fps[24] ^ fps[25]).bit_count() <= 4 and jaccard(rows[24][1], rows[25][1]) < 0.8
    docs = spark.createDataFrame(make(rows), SCHEMA).repartition(2)
    monkeypatch.setattr(minhash, "_candidates", lambda nodes: spark.createDataFrame([], "g long, u long, v long"))
    got = {r.doc_id for r in pipeline.one_per_group(spark, docs, folder).collect()}
    assert got == {i for i, _, _ in rows} - near
