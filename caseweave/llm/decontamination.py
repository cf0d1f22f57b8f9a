"""Benchmark decontamination with spaced seeds.

A seed mask reads six words and ignores those between, so a hash of the six
survives substitutions at the ignored places.  The masks together hit every
stretch of 13 to 25 aligned words of which 80 % agree, wherever the others are.
A longer stretch splits into pieces of such lengths, of which one has 80 % too.
Seeds of training texts
are joined with seeds of test items; every hit is verified by aligning both
texts at its offset and taking the longest stretch in which at least ``ratio``
of the words agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from caseweave.llm.common import as_bytes, mix, pieces, split_words, word_hashes
from caseweave.runtime import materialize

# The third has a span of seven words, so items of seven words that stand in a text whole are hit, shorter ones are not.
MASKS = ("11101011", "11001111", "1111011", "1100100001011")
# Test items are sent to every executor up to so many words in all; more are joined.
MAX_SHARED_WORDS = 1 << 20
FILTER_BITS = 22


def seeds(hashes: np.ndarray, doc: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Seed hashes and places by mask, at all places where the mask fits into the document."""
    found = []
    for number, mask in enumerate(MASKS):
        at = np.arange(len(hashes))
        at = at[at + len(mask) <= first[doc + 1]]
        total = np.full(len(at), number + 1, np.uint64)
        for j in (j for j, bit in enumerate(mask) if bit == "1"):
            total = mix(total ^ hashes[at + j]) if len(at) else total
        found.append((total, at))
    return found


def longest_match(same: np.ndarray, ratio: float) -> tuple[int, int]:
    """The longest stretch ``[a, z)`` with at least ``ratio`` true values, starting and ending on a true one."""
    score = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - ratio, -ratio))])
    low = np.minimum.accumulate(np.where(np.append(same, False), score, np.inf))
    begin = np.searchsorted(-low, -(score + 1e-9), side="left")
    length = np.where(np.append(False, same), np.arange(len(score)) - begin, 0)
    z = int(np.argmax(length))
    return (int(begin[z]), z) if length[z] > 0 else (0, 0)


class Items:
    """Word hashes of the test items, and their seeds sorted."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        words = split_words(as_bytes(texts, lower=True))
        hashes = word_hashes(words) if len(words.start) else np.empty(0, np.uint64)
        self.ids = ids
        self.hashes = [hashes[a:b] for a, b in zip(words.first, words.first[1:])]
        found = seeds(hashes, words.doc, words.first)
        key, place = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(key, kind="stable")
        self.key, place = key[order], place[order]
        self.item = words.doc[place] if len(place) else place
        self.at = place - words.first[self.item] if len(place) else place
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.key & np.uint64((1 << FILTER_BITS) - 1)] = True

    def hits(self, hashes: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct ``(document, item, offset)`` of equal seeds."""
        out = []
        for row, at in seeds(hashes, doc, first):
            may = np.flatnonzero(self.filter[row & np.uint64((1 << FILTER_BITS) - 1)])
            key, place = row[may], at[may]
            lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
            n = hi - lo
            which = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            place = np.repeat(place, n)
            d = doc[place]
            out.append(np.stack([d, self.item[which], place - first[d] - self.at[which]], axis=1))
        return np.unique(np.concatenate(out), axis=0)


def _verify(text: np.ndarray, item: np.ndarray, offset: int, ratio: float, least: int) -> tuple[int, ...] | None:
    """``(matched, words, place in text, place in item)`` of the stretch at an offset, if it is long enough."""
    a, z = max(0, -offset), min(len(item), len(text) - offset)
    same = text[a + offset: z + offset] == item[a:z]
    lo, hi = longest_match(same, ratio)
    matched = int(same[lo:hi].sum())
    if not matched or matched < min(hi - lo, len(item)) and len(item) < least or hi - lo < min(least, len(item)):
        return None
    return matched, hi - lo, a + lo + offset, a + lo


_FOUND = ["matched", "overlap", "doc_start", "item_start", "item_words"]


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_id_col: str = "item_id", item_text_col: str = "text", ratio: float = 0.8, least: int = 13,
             max_shared_words: int = MAX_SHARED_WORDS) -> DataFrame:
    """``(id, item id, matched, overlap, doc_start, item_start, item_words)``: the longest overlap per pair.

    An overlap is a stretch of ``least`` words or more of which at least ``ratio``
    agree after lower-casing A-Z; of an item shorter than that, all words must
    stand in the text in a row.  All of a text is searched.  Items of fewer words
    than the shortest mask reads, seven, prove nothing and match nothing, as do null
    and empty texts; repeated rows give repeated rows; null ids stay
    null; empty tables give no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    left = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    right = items.select(F.col(item_id_col).alias("item"), F.col(item_text_col).alias("item_text"))
    kind, item_kind = dict(left.dtypes)["id"], dict(right.dtypes)["item"]
    schema = f"id {kind}, item {item_kind}, " + ", ".join(f"{c} long" for c in _FOUND)
    size = right.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    if size <= max_shared_words * 2:  # a word and its space take two bytes at least
        listed = right.collect()  # bounded by max_shared_words
        batch_type = to_arrow_type(right.schema["item"].dataType)
        shared = spark.sparkContext.broadcast(([r.item for r in listed], [r.item_text for r in listed]))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Items(*shared.value)
            for b in batches:
                texts, rows, at = as_bytes(b.column("text").to_pylist(), lower=True), [], []
                for lo, hi in pieces([len(t) for t in texts]):
                    words = split_words(texts[lo:hi])
                    if not len(words.start):
                        continue
                    hashes = word_hashes(words)
                    best: dict[tuple[int, int], tuple] = {}
                    for d, item, offset in known.hits(hashes, words.doc, words.first).tolist():
                        mine = hashes[words.first[d]:words.first[d + 1]]
                        said = _verify(mine, known.hashes[item], offset, ratio, least)
                        if said and ((d, item) not in best or _better(said, best[d, item])):
                            best[d, item] = said
                    for (d, item), said in best.items():
                        at.append(lo + d)
                        rows.append((known.ids[item], *said, len(known.hashes[item])))
                columns = list(zip(*rows)) if rows else [[]] * (1 + len(_FOUND))
                out = [b.column("id").take(pa.array(at, pa.int64()))]
                out += [pa.array(columns[0], batch_type)] + [pa.array(c, pa.int64()) for c in columns[1:]]
                yield pa.RecordBatch.from_arrays(out, names=["id", "item", *_FOUND])

        found = left.mapInArrow(scan, schema)
    else:
        found = _joined(left, right, kind, ratio, least, schema)
    return found.withColumnsRenamed({"id": id_col, "item": item_id_col})


def _better(a: tuple, b: tuple) -> bool:
    """Longer overlaps first, then more matches, then the earlier place."""
    return (a[1], a[0], -a[2], -a[3]) > (b[1], b[0], -b[2], -b[3])


def _seed_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, seed, at)`` of all seeds."""
    picked = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded = as_bytes(b.column("text").to_pylist(), lower=True)
            for lo, hi in pieces([len(t) for t in coded]):
                words = split_words(coded[lo:hi])
                if not len(words.start):
                    continue
                for row, at in seeds(word_hashes(words), words.doc, words.first):
                    keys = b.column("key").take(pa.array(lo + words.doc[at]))
                    yield pa.RecordBatch.from_arrays(
                        [keys, pa.array(row.view(np.int64)), pa.array(at - words.first[words.doc[at]])],
                        names=["key", "seed", "at"])

    return picked.mapInArrow(run, "key long, seed long, at long")


def _joined(left: DataFrame, right: DataFrame, kind: str, ratio: float, least: int, schema: str) -> DataFrame:
    """The same result by equi joins, for test sets of any size."""
    docs = materialize(left.withColumn("row", F.monotonically_increasing_id()))
    items = materialize(right.withColumn("irow", F.monotonically_increasing_id()))
    mine = _seed_rows(docs, "row", "text").withColumnsRenamed({"key": "row"})
    test = _seed_rows(items, "irow", "item_text").withColumnsRenamed({"key": "irow", "at": "item_at"})
    offsets = (mine.join(test, "seed").select("row", "irow", (F.col("at") - F.col("item_at")).alias("offset"))
               .distinct().groupBy("row", "irow").agg(F.collect_list("offset").alias("offsets")))
    pairs = offsets.join(docs, "row").join(items, "irow").select("id", "item", "text", "item_text", "offsets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            both = zip(*(as_bytes(b.column(c).to_pylist(), lower=True) for c in ("text", "item_text")),
                       b.column("offsets").to_pylist())
            for i, (text, item, tried) in enumerate(both):
                words = split_words([text, item])
                hashes = word_hashes(words)
                mine, test = hashes[: words.first[1]], hashes[words.first[1]:]
                said = [s for s in (_verify(mine, test, o, ratio, least) for o in tried) if s]
                if said:
                    best = said[0]
                    for s in said[1:]:
                        best = s if _better(s, best) else best
                    at.append(i)
                    rows.append((*best, len(test)))
            columns = list(zip(*rows)) if rows else [[]] * len(_FOUND)
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(taken), b.column("item").take(taken)] + [pa.array(c, pa.int64()) for c in columns],
                names=["id", "item", *_FOUND])

    return pairs.mapInArrow(check, schema)
