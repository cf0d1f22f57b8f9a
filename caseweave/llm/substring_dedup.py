"""Removal of repeated passages by seed and extend.

Seeds are winnowed anchors: of the k-word hashes inside a window of ``window``
words the smallest (leftmost on ties) is the window's anchor, so equal windows
have equal anchors at equal places.  All windows that share one anchor
occurrence are judged together:

1. Occurrences are joined on the anchor.  Where the extended context, which
   spans all windows of the anchor, equals an earlier occurrence's, every one
   of its windows repeats.
2. Only anchors whose occurrences have different contexts are extended word by
   word, both ways, on their earliest occurrence per context: each window is
   compared by the hash of its words.

Windows marked so overlap and merge to the maximal repeats.  Occurrences are
first reduced inside each scan batch, where a later copy is settled at once, so
a passage that a third of all documents share sends a few rows per batch.
Sorted rows stream through the comparison; no group is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import RangeHash, as_bytes, mix, pieces, split_words, word_hashes
from caseweave.runtime import materialize

ANCHOR_WORDS = 5
NO_ID = (1 << 63) - 1  # stands for a null id, after all others
ROWS = "k long, f long, id long, h long, at long, settled boolean"


def anchors(hashes: np.ndarray, doc: np.ndarray, first: np.ndarray, window: int,
            k: int = ANCHOR_WORDS) -> tuple[np.ndarray, ...]:
    """``(anchor hash, context hash, first window, last window)`` of every anchor occurrence, as word indexes."""
    starts = np.arange(len(hashes))
    starts = starts[starts + window <= first[doc + 1]]
    if not len(starts):
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    ranges = RangeHash(hashes)
    at = np.arange(len(hashes) - k + 1)
    gram = ranges.of(at, at + k)
    width, size, least = window - k + 1, 1, gram
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[starts], least[starts + width - size])
    place = np.zeros(len(starts), np.int64)
    for offset in range(width - 1, -1, -1):
        place = np.where(gram[starts + offset] == least, starts + offset, place)
    cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(starts) != 1)) + 1
    lo, hi = starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])]
    place = place[np.concatenate([[0], cut])]
    shape = ((place - lo) * window + (hi - lo)).astype(np.uint64)
    return gram[place], mix(ranges.of(lo, hi + window) ^ mix(shape + np.uint64(1))), lo, hi


def _settle(k: np.ndarray, f: np.ndarray, ids: np.ndarray, h: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Reduce a batch: of equal (k, f) the earliest goes on, later ones are repeats for sure.

    Texts that share the smallest id are not earlier than each other, so each of
    them keeps its earliest row.  Settled rows need no comparison; their key is
    spread so that they don't meet in one task.
    """
    order = np.lexsort((at, h, ids, f, k))
    k, f, ids, h, at = k[order], f[order], ids[order], h[order], at[order]
    place = np.arange(len(k))
    context = np.concatenate([[True], (k[1:] != k[:-1]) | (f[1:] != f[:-1])]) if len(k) else np.empty(0, bool)
    least = ids[np.maximum.accumulate(np.where(context, place, 0))]
    new = context.copy()
    new[1:] |= (ids[1:] == least[1:]) & (h[1:] != h[:-1])
    head = np.maximum.accumulate(np.where(new, place, 0))
    # The same place of the same document (a repeated row) is not earlier than itself.
    settled = ~((ids == ids[head]) & (at >> 24 == at[head] >> 24))
    keep = settled | new
    spread = mix(ids.view(np.uint64) + h.view(np.uint64) + at.view(np.uint64)).view(np.int64)
    cols = [np.where(settled, spread, k), f, ids, h, at, settled]
    return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names=["k", "f", "id", "h", "at", "settled"])


def _compare(rows: DataFrame) -> DataFrame:
    """``(id, h, at, repeat)``: rows with an earlier equal (k, f), and the earliest rows of keys with several contexts.

    Several texts of the smallest id count as several contexts here; the windows
    they are extended to are compared exactly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (k, f, id, start, h) of the current context's last head; all heads of a context have its smallest id
        waiting = None  # the first head of the current key, until a second one shows
        for b in batches:
            k, f, ids, h, at = (b.column(c).to_numpy() for c in ("k", "f", "id", "h", "at"))
            settled = b.column("settled").to_numpy(zero_copy_only=False)
            out = [[ids[settled], h[settled], at[settled], np.ones(settled.sum(), bool)]]
            k, f, ids, h, at = (c[~settled] for c in (k, f, ids, h, at))
            if len(k):
                first = (k[0], f[0], ids[0], at[0] >> 24, h[0]) if last is None else last
                new_k = k != np.concatenate([[first[0]], k[:-1]])
                context = new_k | (f != np.concatenate([[first[1]], f[:-1]]))
                if last is None:
                    new_k[0] = context[0] = True
                place = np.arange(len(k))
                begun = np.maximum.accumulate(np.where(context, place, -1))
                least = np.where(begun < 0, first[2], ids[begun])
                other = h != np.concatenate([[first[4]], h[:-1]])
                new = context | ((ids == least) & other)
                head = np.maximum.accumulate(np.where(new, place, -1))
                old = head < 0  # goes on from the batch before
                head_id = np.where(old, first[2], ids[head])
                head_start = np.where(old, first[3], at[head] >> 24)
                repeat = ~new & ~((ids == head_id) & (at >> 24 == head_start))
                # All heads of one key, if there are two or more.
                heads = np.flatnonzero(new)
                more = np.zeros(len(k), bool)
                follows = ~new_k[heads]
                more[heads[follows]] = True
                before = np.flatnonzero(follows)
                more[heads[before[before > 0] - 1]] = True
                if waiting is not None and len(heads) and follows[0]:
                    out.append([np.array([x]) for x in (*waiting, False)])
                    waiting = None
                if len(heads):
                    j = heads[-1]
                    last = (k[j], f[j], ids[j], at[j] >> 24, h[j])
                    waiting = None if more[j] else (ids[j], h[j], at[j])
                for flag, said in ((repeat, True), (more, False)):
                    out.append([ids[flag], h[flag], at[flag], np.full(flag.sum(), said)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["id", "h", "at", "repeat"])

    dealt = rows.repartition("k").sortWithinPartitions("k", "f", "id", "h", "at")
    return dealt.mapInArrow(run, "id long, h long, at long, repeat boolean")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text, and the text's hash, which tells texts apart that share an id or have none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"),
                       F.xxhash64(text).alias("h"))


def _scan(docs: DataFrame, emit: Callable) -> DataFrame:
    """Rows of ``emit(words, hashes, rows of the batch)`` for pieces of each batch, settled per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column("text").to_pylist())
            found = []
            for lo, hi in pieces([len(t) for t in texts]):
                words = split_words(texts[lo:hi])
                if len(words.start):
                    found.append(emit(words, word_hashes(words), b.slice(lo, hi - lo)))
            if found:
                yield _settle(*(np.concatenate(c) for c in zip(*found)))

    return docs.mapInArrow(run, ROWS)


def _pack(start: np.ndarray, span: np.ndarray) -> np.ndarray:
    return (start << 24) | (span << 16)


def repeat_marks(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, h, lo, hi)``: words lo..hi-1 lie in windows that also start earlier (one or several windows a row)."""
    if not ANCHOR_WORDS < window <= 256:
        raise ValueError(f"window must lie between {ANCHOR_WORDS + 1} and 256 words")
    texts = _texts(docs, id_col, text_col)

    def seeds(words, hashes, rows):
        anchor, context, lo, hi = anchors(hashes, words.doc, words.first, window)
        d = words.doc[lo]
        ids, h = rows.column("id").to_numpy()[d], rows.column("h").to_numpy()[d]
        return anchor.view(np.int64), context.view(np.int64), ids, h, _pack(lo - words.first[d], hi - lo)

    seen = materialize(_compare(_scan(texts, seeds)))
    places = (seen.filter(~F.col("repeat"))
              .select("id", "h", F.shiftright("at", 24).alias("start"), F.expr("shiftright(at, 16) & 255").alias("span"))
              .groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct("start", "span"))).alias("places")))

    def extend(words, hashes, rows):
        starts, docs_ = [], []
        for d, places_ in enumerate(rows.column("places").to_pylist()):
            at = [s for p in places_ for s in range(p["start"], p["start"] + p["span"] + 1)]
            starts.append(np.unique(np.array(at, np.int64)))
            docs_.append(np.full(len(starts[-1]), d))
        start, d = np.concatenate(starts), np.concatenate(docs_)
        at = start + words.first[d]
        ranges = RangeHash(hashes)
        whole = ranges.of(at, at + window)
        # A second hash of the same words, from a second spread of them, makes 128 bits.
        other = RangeHash(mix(hashes ^ np.uint64(0x5851F42D4C957F2D))).of(at, at + window)
        ids, h = rows.column("id").to_numpy()[d], rows.column("h").to_numpy()[d]
        return whole.view(np.int64), other.view(np.int64), ids, h, _pack(start, np.zeros_like(start))

    joined = texts.join(places.hint("shuffle_hash"), ["id", "h"]).select("id", "h", "text", "places")
    extended = materialize(_compare(_scan(joined, extend)).filter("repeat"))
    start = F.shiftright("at", 24)
    return (seen.filter("repeat").select("id", "h", "at").unionByName(extended.select("id", "h", "at"))
            .select("id", "h", start.alias("lo"),
                    (start + F.expr("shiftright(at, 16) & 255") + window).alias("hi")))


def _merge(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(lo, kind="stable")
    out: list[list[int]] = []
    for a, b in zip(lo[order].tolist(), hi[order].tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text",
                   keep_text: bool = True) -> DataFrame:
    """``(id, n_words, n_removed, spans, kept_sha256[, kept_text])`` per row.

    Removes every word covered by a window of ``window`` consecutive words whose
    word sequence also starts earlier: in a document with a smaller id, or
    earlier in the same one.  ``spans`` are the merged maximal repeats, as word
    ranges ``lo..hi-1``; kept words are joined by one space.

    A null text has no words; texts below ``window`` words keep all.  A null id
    comes after all ids.  Repeated rows (same id and text) are one document, so
    neither repeats the other; rows that share an id, or have none, but differ in
    text are told apart by their text's hash and never repeat each other.  An empty
    table gives no rows.  Other columns are not read.  Ids are whole numbers.
    """
    marks = repeat_marks(docs, window, id_col, text_col)
    per = (marks.groupBy("id", "h").agg(F.collect_set(F.struct("lo", "hi")).alias("marks")))
    joined = _texts(docs, id_col, text_col).join(per.hint("shuffle_hash"), ["id", "h"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, rows = as_bytes(b.column("text").to_pylist()), []
            column = b.column("marks")
            offsets, flat = column.offsets.to_numpy(), column.values
            lo, hi = (flat.field(c).to_numpy() for c in ("lo", "hi"))
            for i, text in enumerate(texts):
                words = text.split()
                spans = _merge(lo[offsets[i]:offsets[i + 1]], hi[offsets[i]:offsets[i + 1]])
                kept, at = [], 0
                for a, z in spans:
                    kept += words[at:a]
                    at = z
                kept = b" ".join(kept + words[at:])
                rows.append((len(words), sum(z - a for a, z in spans), [{"lo": a, "hi": z} for a, z in spans],
                             hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if keep_text else None))
            n, gone, spans, sha, kept = zip(*rows) if rows else ((),) * 5
            out = [b.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                   pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
                   pa.array(sha, pa.string())] + [pa.array(kept, pa.string())] * keep_text
            yield pa.RecordBatch.from_arrays(out, names=["id", "n_words", "n_removed", "spans", "kept_sha256"]
                                             + ["kept_text"] * keep_text)

    schema = ("id long, n_words long, n_removed long, spans array<struct<lo: long, hi: long>>, kept_sha256 string"
              + ", kept_text string" * keep_text)
    out = joined.select("id", "text", "marks").mapInArrow(run, schema)
    return out.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id"))).withColumnRenamed("id", id_col)
