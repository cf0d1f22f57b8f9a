"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits, cut into segments of 23, 23 and 18 bits.  The binary
Golay code is perfect: every 23-bit word lies within 3 bits of exactly one
codeword.  So two words that differ in up to 2 bits have a word between them
within 1 bit of both, whose codeword lies within 4 bits of both: the codewords
within 4 bits of a segment, one or six of them, are keys that such words share.

If two fingerprints differ in 4 bits or fewer, then either every segment has at
most 2 errors, and all three segments share a key; or one segment has 3 or more,
and of the other two one is equal and one shares a key.  Joining on those
compound keys (35 or 36 bits) therefore finds every link.

Texts with one fingerprint are one node.  Rows are sorted by key; within a key
only a spanning forest of the verified links is returned, never all pairs.
Connected components then give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import as_bytes
from caseweave.llm.components import component_roots
from caseweave.runtime import materialize

SEED = 42
MAX_ERRORS = 4
SEGMENTS = [(0, 23), (23, 23), (46, 18)]
GENERATOR = 0b110001110101  # of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
KEY_ROWS = 1 << 14  # fingerprints whose keys are made at once


def fingerprint(text: bytes, shingle: int) -> int:
    """Bit i is set where over half of the shingle hashes have it; 0 without words."""
    words = text.split()
    if not words:
        return 0
    line, size = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[size - 1:] - 1).tolist())], np.uint64)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 4) -> DataFrame:
    """``(id, fp)``: the fingerprint as a signed long.  A null text counts as empty."""
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in as_bytes(b.column("text").to_pylist(), lower=True)],
                          np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return picked.mapInArrow(run, f"id {dict(picked.dtypes)['id']}, fp long")


def _remainder(value: int) -> int:
    for bit in range(22, 10, -1):
        if value >> bit & 1:
            value ^= GENERATOR << (bit - 11)
    return value


class Golay:
    """Codewords within 4 bits of 23-bit words, by syndrome."""

    def __init__(self):
        self.low = np.array([_remainder(v) for v in range(1 << 12)], np.uint16)
        self.high = np.array([_remainder(v << 12) for v in range(1 << 11)], np.uint16)
        patterns: list[list[int]] = [[] for _ in range(1 << 11)]
        for weight in range(5):
            for bits in combinations(range(23), weight):
                error = sum(1 << b for b in bits)
                patterns[_remainder(error)].append(error)
        self.count = np.array([len(p) for p in patterns])
        self.patterns = np.array([p + [0] * (6 - len(p)) for p in patterns], np.uint32)

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Up to six 12-bit codeword numbers per word, and how many count."""
        syndrome = self.low[words & 0xFFF] ^ self.high[words >> 12]
        codewords = words[:, None] ^ self.patterns[syndrome]
        return (codewords >> 11).astype(np.uint64), self.count[syndrome]


def compound_keys(golay: Golay, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the fingerprints, and the row of each key."""
    raw = [((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.uint32) for at, width in SEGMENTS]
    coded = [golay.keys(r) for r in raw]
    valid = [np.arange(6) < n[:, None] for _, n in coded]
    (a, _), (b, _), (c, _) = coded
    key = (a[:, :, None, None] << np.uint64(24)) | (b[:, None, :, None] << np.uint64(12)) | c[:, None, None, :]
    use = valid[0][:, :, None, None] & valid[1][:, None, :, None] & valid[2][:, None, None, :]
    row, *_ = np.nonzero(use)
    keys, rows = [key[use]], [row]
    for tag, (i, j) in enumerate([(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)], 1):
        key = (np.uint64(tag) << np.uint64(40)) | (raw[i].astype(np.uint64)[:, None] << np.uint64(12)) | coded[j][0]
        row, _ = np.nonzero(valid[j])
        keys.append(key[valid[j]])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def spanning_links(fps: np.ndarray, errors: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints.

    Breadth first: a reached fingerprint is compared with those not reached yet,
    which a dense group exhausts after a few comparisons.
    """
    links, left = [], fps
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(left ^ at) <= errors
            if near.any():
                links += [(int(at), int(v)) for v in left[near]]
                frontier += list(left[near])
                left = left[~near]
    return links


def links(fps: DataFrame, errors: int = MAX_ERRORS) -> DataFrame:
    """``(u, v)`` links of distinct fingerprints ``fps(fp)`` that connect all within ``errors`` bits."""
    if not 0 <= errors <= MAX_ERRORS:
        raise ValueError(f"errors must lie between 0 and {MAX_ERRORS}")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for b in batches:
            values = b.column("fp").to_numpy().view(np.uint64)
            for lo in range(0, len(values), 512):
                part = values[lo: lo + 512]
                key, row = compound_keys(golay, part)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part[row].view(np.int64))],
                                                 names=["key", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = np.empty(0, np.int64), np.empty(0, np.uint64)
        done = False
        while not done:
            b = next(batches, None)
            done = b is None
            if not done:
                held_key = np.concatenate([held_key, b.column("key").to_numpy()])
                held = np.concatenate([held, b.column("fp").to_numpy().view(np.uint64)])
            if not len(held_key):
                continue
            # The last key may go on in the next batch.
            cut = len(held_key) if done else np.searchsorted(held_key, held_key[-1])
            key, fp, held_key, held = held_key[:cut], held[:cut], held_key[cut:], held[cut:]
            edge = np.flatnonzero(np.diff(key, prepend=key[:1] - 1, append=key[-1:] + 1)) if cut else np.empty(0, int)
            size = np.diff(edge)
            pairs = edge[:-1][size == 2]
            near = pairs[np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= errors]
            found = list(zip(fp[near].tolist(), fp[near + 1].tolist()))
            for k in np.flatnonzero(size > 2):
                found += spanning_links(fp[edge[k]: edge[k + 1]], errors)
            if found:
                uv = np.unique(np.sort(np.array(found, np.uint64), axis=1), axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(uv[:, 0].copy()), pa.array(uv[:, 1].copy())],
                                                 names=["u", "v"])

    keyed = fps.select("fp").mapInArrow(make, "key long, fp long")
    grouped = keyed.repartition("key").sortWithinPartitions("key")
    return grouped.mapInArrow(verify, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    errors: int = MAX_ERRORS) -> DataFrame:
    """``(id, fp, component_id)`` per row; a component is named by its smallest id.

    Words are runs of non-space bytes with A-Z lower-cased.  A text of fewer
    words than ``shingle`` is one shingle; empty and null texts have fingerprint
    0 and link like any other.  Repeated rows stay and share their component.
    A row with a null id belongs to its component but never names it, unless no
    row of the component has an id (then the name is null).  An empty table
    gives no rows.  Other columns are not read.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, shingle))
    nodes = materialize(marked.groupBy("fp").agg(F.min("id").alias("least")))
    roots = component_roots(links(nodes, errors))
    named = materialize(nodes.join(roots, nodes.fp == roots.node, "left")
                        .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    component = materialize(named.join(least, "root").select("fp", "component_id"))
    return marked.join(component, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
