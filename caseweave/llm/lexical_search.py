"""Ranked lexical search turned round: the items are indexed, the documents stream past.

The items' terms make a small inverted index, which every task gets.  Each
document's term counts run through it, so a document touches only the items it
shares a term with; per item a task keeps a heap of its best documents.  Heaps
are merged at the end, at most ``k`` rows of each task and item.

Items come in blocks of bounded size, so the index has a bound whatever the
number of items; each block is one more pass over the documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from caseweave.llm.common import CHUNK_BYTES, as_bytes, block_of
from caseweave.runtime import materialize

# Bytes of a term are digits, ASCII letters and all of non-ASCII characters; only A-Z are lower-cased.
_TERM_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_FOLD = bytes(b if b in _TERM_BYTES else 0x20 for b in range(256)).lower()

# An index block holds about so many bytes of item text and so many items; both bound what is sent to a task.
BLOCK_BYTES = 4 << 20
BLOCK_ITEMS = 1 << 14
SCORES = 1 << 22  # scores of one piece of documents by items, 8 bytes each
NO_ID = (1 << 63) - 1  # a null id ranks after all others


def term_counts(text: bytes) -> Counter:
    """Occurrences of each term, a piece of a long text at a time."""
    folded, found, at = text.translate(_FOLD), Counter(), 0
    while at < len(folded):
        end = folded.find(b" ", at + CHUNK_BYTES)
        end = len(folded) if end < 0 else end
        found.update(folded[at:end].split())
        at = end
    return found


class Index:
    """Inverted index of one block of items: ``lists[starts[t]:starts[t + 1]]`` are the items with term ``t``."""

    def __init__(self, texts: list[str | None]):
        by_term: dict[bytes, list[int]] = {}
        for i, text in enumerate(as_bytes(texts)):
            for term in term_counts(text):
                by_term.setdefault(term, []).append(i)
        self.term = {t: j for j, t in enumerate(by_term)}
        self.starts = np.cumsum([0] + [len(v) for v in by_term.values()])
        self.lists = np.array([i for v in by_term.values() for i in v], np.int64)
        self.items = len(texts)

    def weigh(self, holders: dict[int, int], documents: int) -> np.ndarray:
        """``floor(1000 ln((2N + 2) / (2 df + 1)))`` per term."""
        return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * holders.get(t, 0) + 1)))
                         for t in range(len(self.term))], np.int64)


def scores(index: Index, weight: np.ndarray, documents: int, terms_in_all: int, n: np.ndarray, doc: np.ndarray,
           term: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """Score of each document (rows) for each item; ``doc, term, tf`` are the documents' counts of indexed terms."""
    if len(n) and int(n.max()) * 90 * documents >= 1 << 62:
        m = np.array([10 + 90 * int(x) * documents // terms_in_all for x in n], np.int64)
    else:
        m = 10 + 90 * n * documents // terms_in_all
    part = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
    width = index.starts[term + 1] - index.starts[term]
    which = np.repeat(index.starts[term] - np.cumsum(width) + width, width) + np.arange(width.sum())
    cell = np.repeat(doc * index.items, width) + index.lists[which]
    # Sums stay below 2^53, so doubles hold them exactly.
    out = np.bincount(cell, weights=np.repeat(part, width), minlength=len(n) * index.items)
    return out.astype(np.int64).reshape(len(n), index.items)


class Heaps:
    """The ``k`` best ``(score, id)`` of every item: higher scores first, then smaller ids."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item, self.id, self.score = (np.empty(0, np.int64) for _ in range(3))
        self.least = np.ones(items, np.int64)  # what a document needs at least

    def offer(self, ids: np.ndarray, score: np.ndarray) -> None:
        row, item = np.nonzero(score >= self.least)
        if not len(row):
            return
        item = np.concatenate([self.item, item])
        ids = np.concatenate([self.id, ids[row]])
        score = np.concatenate([self.score, score[row, item[len(self.item):]]])
        order = np.lexsort((ids, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item, "left")
        keep = order[place < self.k]
        full = order[place == self.k - 1]
        last = item[place == self.k - 1]
        self.least[last] = score[full]
        self.item, self.id, self.score = item[place < self.k], ids[keep], score[keep]


def _counts(docs: DataFrame, index) -> DataFrame:
    """``(id, n, terms, tfs)`` of documents with at least one term; ``terms`` are those of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value.term
        for b in batches:
            at, n, ends, terms, tfs = [], [], [0], [], []
            for i, text in enumerate(as_bytes(b.column("text").to_pylist())):
                found = term_counts(text)
                if not found:
                    continue
                at.append(i)
                n.append(found.total())
                hits = found.keys() & known.keys()
                terms += [known[t] for t in hits]
                tfs += [found[t] for t in hits]
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(at, pa.int64())), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], names=["id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "id long, n long, terms array<int>, tfs array<long>")


def _best(counts: DataFrame, index, weight: np.ndarray, documents: int, terms_in_all: int, k: int) -> DataFrame:
    """``(item, id, score)``: each task's heaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        heaps = Heaps(known.items, k)
        step = max(1, SCORES // max(1, known.items))
        for b in batches:
            ids, n = b.column("id").to_numpy(), b.column("n").to_numpy()
            lists, tfs = b.column("terms"), b.column("tfs").values.to_numpy()
            ends, terms = lists.offsets.to_numpy(), lists.values.to_numpy()
            for lo in range(0, len(ids), step):
                hi = min(lo + step, len(ids))
                doc = np.repeat(np.arange(hi - lo), np.diff(ends[lo: hi + 1]))
                flat = slice(ends[lo], ends[hi])
                heaps.offer(ids[lo:hi], scores(known, weight, documents, terms_in_all, n[lo:hi], doc,
                                               terms[flat].astype(np.int64), tfs[flat]))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (heaps.item, heaps.id, heaps.score)],
                                         names=["item", "id", "score"])

    return counts.mapInArrow(run, "item long, id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
         item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
         block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``(item id, rank, id, score)``: each item's ``k`` best documents with a score above 0.

    Terms are runs of digits, ASCII letters and non-ASCII characters of the whole
    text, with A-Z lower-cased.  A rare term weighs more, more occurrences count
    less and less, and long documents count less (in whole numbers, so results
    are the same everywhere).  Equal scores rank by id, null ids last.

    A null or empty text has no terms: as a document it is not counted, as an
    item it has no result.  Repeated rows of documents are documents of their own
    and take ranks of their own; repeated rows of items (same id and text) are one
    item, other rows with one id are ranked apart.  An empty table on either side
    gives no rows.  Other columns are not read.  Document ids are whole numbers.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    wanted = (items.select(F.col(item_id_col).alias("item"), F.col(item_text_col).alias("text"))
              .filter(F.length("text") > 0).distinct())
    total, number = wanted.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n_blocks = max(1, -(-(total or 0) // block_bytes), -(-number // block_items))
    item_field = wanted.schema["item"]
    item_type, arrow_type = item_field.dataType.simpleString(), to_arrow_type(item_field.dataType)
    out = None
    for block in range(n_blocks):
        # About block_bytes of text and block_items items; a single longer item makes a longer block.
        listed = wanted.filter(block_of(n_blocks, F.col("item"), F.col("text")) == block).collect()
        index = spark.sparkContext.broadcast(Index([r["text"] for r in listed]))
        ids = spark.sparkContext.broadcast([r["item"] for r in listed])
        counts = materialize(_counts(texts, index))
        documents, terms_in_all = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        # One row per indexed term, so at most block_bytes / 2 rows come back.
        holders = dict(tuple(r) for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weight = index.value.weigh(holders, documents)
        best = _best(counts, index, weight, documents, terms_in_all, k)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), "id")
        ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

        def name(batches: Iterator[pa.RecordBatch], ids=ids) -> Iterator[pa.RecordBatch]:
            for b in batches:
                named = [ids.value[i] for i in b.column("item").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(named, arrow_type), *b.columns[1:]],
                                                 names=["item", "rank", "id", "score"])

        part = ranked.select("item", "rank", "id", "score").mapInArrow(
            name, f"item {item_type}, rank int, id long, score long")
        out = part if out is None else out.unionByName(part)
    return (out.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id")))
            .withColumnsRenamed({"item": item_id_col, "id": id_col}))
