"""Document fingerprints: digests of improbable features in chained Bloom filters.

A feature is a window of 16 bytes.  Its entropy is the collision entropy of its
bytes, which follows from the number of equal byte pairs in the window; that
number slides along a text with a few vector operations.  A feature's rarity is
the share of all corpus windows with the same entropy, so the rarest levels come
first; windows of very low entropy (padding, runs) come last.  Of every 32
neighbouring features the rarest, leftmost on ties, gets a vote.  Features with
8 votes or more are selected, and the 16 with most votes in any case, so short
texts have a few.  Each sets five bits of a Bloom filter of 2048 bits; after 160
features the next filter of the chain starts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import RangeHash, as_bytes, pieces

WIDTH, NEIGHBOURS, VOTES, LEAST_FEATURES = 16, 32, 8, 16
FILTER_BITS, PER_FILTER, HASHES, HASH_BITS = 2048, 160, 5, 11
LEVELS = WIDTH * (WIDTH - 1) // 2 + 1
LOW_ENTROPY_PAIRS = 24  # (16 + 2 * 24) / 256 = 2 ^ -2: two bits of entropy or fewer
# Overlap that counts for nothing: this share of the span from chance to full overlap, and so many deviations of chance.
CUTOFF, DEVIATIONS = 0.1, 2.5
GAP = b"\0" * (NEIGHBOURS + 1)
BLOCK_BYTES = 8 << 20


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts with gaps, first byte and number of windows of each text."""
    buf = np.frombuffer(GAP.join([*texts, b""]), np.uint8)
    size = np.array([len(t) for t in texts])
    begin = np.concatenate([[0], np.cumsum(size + len(GAP))[:-1]])
    return buf, begin, np.maximum(size - WIDTH + 1, 0)


def pair_counts(buf: np.ndarray) -> np.ndarray:
    """Equal byte pairs inside every window of ``WIDTH`` bytes."""
    if len(buf) < WIDTH:
        return np.empty(0, np.int32)
    later, earlier = np.zeros(len(buf), np.uint8), np.zeros(len(buf), np.uint8)
    for lo in range(0, len(buf), 1 << 16):  # small blocks stay in the cache
        part = buf[lo: lo + (1 << 16) + WIDTH]
        own = min(1 << 16, len(buf) - lo)
        for k in range(1, WIDTH):
            same = part[k:] == part[:-k]
            later[lo: lo + min(own, len(same))] += same[:own]
            earlier[lo + k: lo + k + own][: len(same)] += same[:own]
    change = earlier[WIDTH:].astype(np.int32) - later[: len(buf) - WIDTH]
    return int(earlier[:WIDTH].sum(dtype=np.int64)) + np.concatenate([[0], np.cumsum(change)]).astype(np.int32)


def _windows(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Start of every window that lies within a text."""
    total = int(count.sum())
    shift = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return np.arange(total) + shift


def level_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many windows of all texts have each number of equal pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for b in batches:
            texts = as_bytes(b.column(0).to_pylist())
            for lo, hi in pieces([len(t) for t in texts]):
                buf, begin, count = _layout(texts[lo:hi])
                total += np.bincount(pair_counts(buf)[_windows(begin, count)], minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(total)], names=["level", "n"])

    rows = docs.select(text_col).mapInArrow(run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n"))
    total = np.zeros(LEVELS, np.int64)
    for level, n in rows.collect():  # one row per level
        total[level] = n
    return total


def precedence(counts: np.ndarray) -> np.ndarray:
    """Rank of each level: rare ones first, low entropy last."""
    level = np.arange(LEVELS)
    order = np.lexsort((level, counts, level >= LOW_ENTROPY_PAIRS))
    rank = np.empty(LEVELS, np.int64)
    rank[order] = level
    return rank


def features(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """Hashes of the selected features of each text, in order, each once.

    A text shorter than a window is one feature; an empty text has none.
    """
    buf, begin, count = _layout(texts)
    starts = _windows(begin, count)
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    hashes = RangeHash(buf.astype(np.uint64))
    short = np.array([i for i, t in enumerate(texts) if 0 < len(t) < WIDTH], np.int64)
    for i, h in zip(short, hashes.of(begin[short], begin[short] + [len(texts[i]) for i in short]) if len(short) else []):
        out[i] = np.array([h], np.uint64)
    if not len(starts):
        return out
    none = np.int64(1 << 62)
    key = np.full(len(buf) + NEIGHBOURS, none)
    key[starts] = (rank[pair_counts(buf)[starts]] << 40) | starts
    best, size = key, 1
    while size < NEIGHBOURS:  # the gaps are wide enough that no neighbourhood reaches the next text
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    winner = best[starts] & ((1 << 40) - 1)
    cut = np.flatnonzero(np.diff(winner, prepend=-1))
    place, votes = winner[cut], np.diff(cut, append=len(winner))
    doc = np.searchsorted(begin, place, "right") - 1
    # Rank of each feature by votes within its text, ties by place.
    by_votes = np.lexsort((place, -votes, doc))
    standing = np.empty(len(doc), np.int64)
    standing[by_votes] = np.arange(len(doc)) - np.searchsorted(doc, doc[by_votes])
    chosen = (votes >= VOTES) | (standing < LEAST_FEATURES)
    place, doc = place[chosen], doc[chosen]
    value = hashes.of(place, place + WIDTH)
    same = np.lexsort((place, value, doc))
    again = (value[same][1:] == value[same][:-1]) & (doc[same][1:] == doc[same][:-1])
    keep = np.ones(len(doc), bool)
    keep[same[1:][again]] = False
    value, doc = value[keep], doc[keep]
    edge = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
    for d in np.flatnonzero(np.diff(edge)):
        out[d] = value[edge[d]: edge[d + 1]]
    return out


_SHIFTS = np.arange(HASHES, dtype=np.uint64) * np.uint64(HASH_BITS)


def filters(values: np.ndarray) -> np.ndarray:
    """Chain of Bloom filters, one row of bits each."""
    chain = -(-len(values) // PER_FILTER)
    bits = np.zeros(chain * FILTER_BITS, bool)
    cell = (values[:, None] >> _SHIFTS) & np.uint64(FILTER_BITS - 1)
    bits[(cell.astype(np.int64) + (np.arange(len(values)) // PER_FILTER * FILTER_BITS)[:, None]).ravel()] = True
    return np.packbits(bits).reshape(chain, FILTER_BITS // 8)


def encode(n: int, chain: np.ndarray) -> str:
    """Number of features and the filters in base64; empty for a text without features."""
    return f"{n}:{base64.b64encode(chain.tobytes()).decode()}" if n else ""


def likeness(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> float:
    """Mean over the smaller chain of its best normalised overlap, weighted by features; 0 to 1.

    0 where no more bits agree than by chance.  Two empty fingerprints are alike
    (1), an empty and another one are not (0).
    """
    if not n_a or not n_b:
        return float(n_a == n_b)
    if n_b < n_a or (n_b == n_a and b.tobytes() < a.tobytes()):
        a, n_a, b, n_b = b, n_b, a, n_a
    a, b = a.view(np.uint64), b.view(np.uint64)
    set_a, set_b = np.bitwise_count(a).sum(1), np.bitwise_count(b).sum(1)
    total = 0.0
    for i in range(len(a)):
        both = np.bitwise_count(a[i] & b).sum(1).astype(float)
        full = np.minimum(set_a[i], set_b).astype(float)
        chance = set_a[i] * set_b.astype(float) / FILTER_BITS
        spread = np.sqrt(chance * (1 - set_a[i] / FILTER_BITS) * (1 - set_b / FILTER_BITS))
        least = np.minimum(chance + np.maximum(CUTOFF * (full - chance), DEVIATIONS * spread), full - 0.5)
        score = np.clip((both - least) / np.maximum(full - least, 1e-9), 0.0, 1.0)
        total += score.max() * min(PER_FILTER, n_a - i * PER_FILTER)
    return float(total / n_a)


class Digest:
    """Fingerprint of one text, by the ranks of one corpus."""

    def __init__(self, values: np.ndarray):
        self.n, self.chain = len(values), filters(values)

    def __str__(self) -> str:
        return encode(self.n, self.chain)

    def like(self, other: Digest) -> float:
        return likeness(self.chain, self.n, other.chain, other.n)


def digests(texts: list[bytes], rank: np.ndarray) -> list[Digest]:
    out = []
    for lo, hi in pieces([len(t) for t in texts], 1 << 18):
        out += [Digest(v) for v in features(texts[lo:hi], rank)]
    return out


def fingerprints(docs: DataFrame, rank: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)`` of every text; a null text counts as empty.  Other columns are not read."""
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [str(d) for d in digests(as_bytes(b.column("text").to_pylist()), rank)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(said, pa.string())],
                                             names=["id", "fingerprint"])

    out = picked.mapInArrow(run, f"id {dict(picked.dtypes)['id']}, fingerprint string")
    return out.withColumnRenamed("id", id_col)


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the start of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


NO_ID = -(1 << 63)  # stands for a null id, after all others in descending order


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited copy, and how alike they and the next text are.

    The next document is the one after it by descending id (the first after the
    last; rows of one id by text, null ids last).  Documents are dealt by id
    ranges of about equal bytes; each range also gets the first document of the
    following one.  A null text counts as empty; repeated rows follow each other;
    a lone document follows itself; an empty table gives no rows.  Other columns
    are not read.
    """
    rank = precedence(level_counts(docs, text_col))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 16 + size // BLOCK_BYTES
    bounds = sorted(set(texts.approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(bounds, np.float64)
        for b in batches:
            block = np.searchsorted(edges, b.column("id").to_numpy().astype(np.float64), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block)], names=["id", "text", "block"])

    dealt = texts.mapInArrow(deal, "id long, text string, block int")
    tops = dealt.groupBy("block").agg(F.max("id").alias("id")).collect()  # one row per range
    tops = sorted((r.block, r.id) for r in tops)
    # The first document of a range, by descending id, follows the last one of the next higher range.
    goes_to = {top: tops[(k + 1) % len(tops)][0] for k, (_, top) in enumerate(tops)}
    kind = "id long, to_block int"
    spark = docs.sparkSession
    routes = F.broadcast(spark.createDataFrame(list(goes_to.items()), kind))  # one row per range
    heads = (texts.join(routes, "id").groupBy("id", "to_block").agg(F.min("text").alias("text"))
             .select("id", "text", F.col("to_block").alias("block"), F.lit(True).alias("is_head")))

    def run(group: pa.Table) -> pa.Table:
        rows = list(zip(group.column("id").to_pylist(), group.column("text").to_pylist(),
                        group.column("is_head").to_pylist()))
        mine = sorted((r for r in rows if not r[2]), key=lambda r: (-r[0], r[1]))
        following = [r[1] for r in mine[1:]] + [r[1] for r in rows if r[2]]
        changed = [edited(r[1], t).encode("utf-8", "surrogatepass") for r, t in zip(mine, following)]
        own = digests(as_bytes([r[1] for r in mine] + following[-1:]), rank)
        new = digests(changed, rank)
        return pa.table({
            "id": pa.array([r[0] for r in mine], pa.int64()), "n_chars": pa.array([len(r[1]) for r in mine], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
            "fingerprint": pa.array([str(d) for d in own[:-1]], pa.string()),
            "edited_fingerprint": pa.array([str(d) for d in new], pa.string()),
            "near_edited": pa.array([a.like(b) for a, b in zip(own, new)], pa.float64()),
            "near_next": pa.array([a.like(b) for a, b in zip(own, own[1:])], pa.float64())})

    schema = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    out = (dealt.withColumn("is_head", F.lit(False)).unionByName(heads).groupBy("block").applyInArrow(run, schema))
    return out.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id"))).withColumnRenamed("id", id_col)
