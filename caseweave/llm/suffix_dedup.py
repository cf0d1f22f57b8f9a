"""Removal of repeated byte strings with a distributed, sparse suffix array.

Suffixes start at token starts only.  A token start is the place, inside some
window of ``window`` bytes, whose ``LEAD`` bytes hash smallest (leftmost on
ties).  It depends on the window's bytes alone, so equal windows have equal token
starts at equal places, and a suffix and what precedes it stand for a run of
windows.  About one byte in eighteen starts a suffix.

1. *Leading bytes.*  Splitters, quantiles of a sample of suffixes, cut the order
   of suffixes into buckets of bounded size.  A bucket sorts its suffixes by
   multikey quicksort: by one eight-byte word after the other, going on only
   where words tie.  Neighbours with equal leading bytes are compared: suffixes
   whose context (all bytes of their windows) equals that of an earlier document
   repeat in all of their windows.  A suffix whose leading bytes no other context
   has repeats nowhere.  Leading bytes that a splitter cuts count as shared.
2. *Ties.*  The first suffix of each context among those that share leading bytes
   goes on with all of its bytes: it is sorted by the bytes that follow and by the
   bytes that precede, read backwards, both with common prefix lengths.  A window
   of ``L`` bytes before the token start is a pair of a stretch of suffixes that
   share ``window - L`` bytes and a stretch of prefixes that share ``L``, so equal
   windows are found without comparing pairs.  Windows that share their bytes
   with a splitter may go on in the next bucket; they are compared across
   boundaries by their hashes.

Rows of equal context are reduced in each scan batch before they are dealt out.
Suffixes travel as packed records, a row for each batch and bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import RangeHash, as_bytes, mix
from caseweave.runtime import materialize

LEAD = 16  # bytes: two words
NO_ID = (1 << 63) - 1  # stands for a null id, after all others
PART_BYTES = 1 << 18  # numpy works on parts of about so many bytes
HELD_BYTES = 1 << 24  # text whose suffixes a task holds before it deals them out
BUCKET_BYTES = 8 << 20  # records of a bucket
SAMPLE = 1 << 20  # sampled suffixes that give the splitters, at most
PER_BUCKET = 32  # sampled suffixes for each bucket
BYTES_PER_SUFFIX = 18

FIRST = np.dtype([("w0", "<u8"), ("w1", "<u8"), ("f", "<u8"), ("id", "<i8"), ("check", "<i4")])
DONE = np.dtype([("id", "<i8"), ("check", "<i4"), ("f", "<u8")])


def _second(window: int) -> np.dtype:
    return np.dtype([("r", "<u8", (-(-window // 8),)), ("l", "<u8", (-(-(window - LEAD) // 8),)), ("f", "<u8"),
                     ("id", "<i8"), ("check", "<i4"), ("least", "u1"), ("most", "u1")])


class Suffixes(NamedTuple):
    """Token starts of several parts in one buffer; windows ``lo`` to ``hi`` belong to the one at ``place``."""

    buf: np.ndarray
    part: np.ndarray
    place: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    w0: np.ndarray
    w1: np.ndarray
    f: np.ndarray


def _parts(texts: list[bytes], window: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of ``(text, offset, bytes)``.  Long texts are cut so that each window lies in one part."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - window + 1), PART_BYTES):
            held.append((i, at, text[at: at + PART_BYTES + window - 1]))
            size += len(held[-1][2])
            if size >= PART_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def suffixes(parts: list[bytes], window: int) -> Suffixes:
    """Token starts of all parts, with two words of leading bytes and the hash of their context."""
    buf = np.frombuffer(b"".join(parts), np.uint8)
    n, ends = len(buf), np.cumsum([len(p) for p in parts])
    if n < window:
        none = [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)] * 3
        return Suffixes(buf, *none)
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    word = np.ndarray((n + 8,), ">u8", padded, strides=(1,)).astype(np.uint64)
    key = (word[:n] + word[8:] * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    key = (key & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width, size, least = window - LEAD + 1, 1, key
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    count = n - window + 1
    least = np.minimum(least[:count], least[width - size: width - size + count])
    inside = np.ones(count, bool)
    cross = ends[:-1, None] - np.arange(1, window)
    inside[cross[(cross >= 0) & (cross < count)]] = False
    start = np.flatnonzero(inside)
    if not len(start):
        return suffixes([], window)
    place = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate([[True], (np.diff(place) != 0) | (np.diff(start) != 1)])
    head = np.flatnonzero(new)
    lo, hi = start[head], start[np.append(head[1:], len(start)) - 1]
    place = place[head]
    shape = ((place - lo) * window + (hi - lo)).astype(np.uint64)
    f = mix(RangeHash(buf.astype(np.uint64)).of(lo, hi + window) ^ mix(shape + np.uint64(1)))
    return Suffixes(buf, np.searchsorted(ends, lo, "right"), place, lo, hi, word[place], word[place + 8], f)


def multikey_sort(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``(order, equal)``: sorted order, and how many leading words each row shares with the row before.

    Multikey quicksort on whole words: a word is looked at only where all words before it tie.
    """
    order = np.argsort(words[0])
    equal = np.zeros(len(order), np.int64)
    first = words[0][order]
    equal[1:][first[1:] == first[:-1]] = 1
    for depth, word in enumerate(words[1:], 1):
        tie = equal == depth
        member = tie.copy()
        member[:-1] |= tie[1:]
        at = np.flatnonzero(member)
        if not len(at):
            break
        tie = tie[at]
        value = word[order[at]]
        inner = np.lexsort((value, np.cumsum(~tie)))
        order[at] = order[at][inner]
        value = value[inner]
        same = np.concatenate([[False], value[1:] == value[:-1]]) & tie
        equal[at[same]] = depth + 1
    return order, equal


def bucket_of(splitters: list[np.ndarray], words: list[np.ndarray]) -> np.ndarray:
    """How many splitters are smaller than or equal to each row, word by word."""
    lo = np.searchsorted(splitters[0], words[0], "left")
    hi = np.searchsorted(splitters[0], words[0], "right")
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) // 2
        less, same = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        for s, w in zip(splitters, words):
            less |= same & (s[mid] < w[open_])
            same &= s[mid] == w[open_]
        fits = less | same
        lo[open_[fits]] = mid[fits] + 1
        hi[open_[~fits]] = mid[~fits]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def _binary(records: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values: consecutive records up to each of ``ends``."""
    offsets = np.concatenate([[0], ends]).astype(np.int32) * np.int32(records.dtype.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(records.tobytes())])


def _records(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    found = []
    for chunk in column.chunks:
        if len(chunk):
            offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset: chunk.offset + len(chunk) + 1]
            data = chunk.buffers()[2]
            if data is not None and offsets[-1] > offsets[0]:
                found.append(np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]].view(kind))
    return np.concatenate(found) if found else np.empty(0, kind)


def _earliest(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(sorted records, repeats, words shared with the row before)``, one row per context, id and text."""
    order, equal = multikey_sort([rec["w0"], rec["w1"], rec["f"], rec["id"], rec["check"]])
    keep = equal < 5
    rec, equal = rec[order[keep]], equal[keep]
    head = np.maximum.accumulate(np.where(equal <= 2, np.arange(len(rec)), 0))
    return rec, rec["id"] > rec["id"][head], equal


def _deal(rec: np.ndarray, words: list[np.ndarray], splitters: list[np.ndarray], done: np.ndarray) -> pa.RecordBatch:
    """Rows ``(bucket, open, done)``; ``rec`` is sorted by ``words``.  Done records go to any bucket, evenly."""
    bucket = bucket_of(splitters, words)
    cut = np.flatnonzero(np.diff(bucket)) + 1
    ends = np.append(cut, len(rec))
    share = len(done) * np.arange(1, len(ends) + 1) // len(ends)
    return pa.RecordBatch.from_arrays([pa.array(bucket[ends - 1].astype(np.int32)), _binary(rec, ends), _binary(done, share)],
                                      names=["bucket", "open", "done"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text, and half of the text's hash: a group of rows without an id is split by it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"),
                       F.shiftright(F.xxhash64(text), 32).cast("int").alias("check"))


def _first_records(batch: pa.RecordBatch, window: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(bytes, records)`` of the suffixes of a batch, a part at a time."""
    ids, check = batch.column("id").to_numpy(), batch.column("check").to_numpy()
    for held in _parts(as_bytes(batch.column("text").to_pylist()), window):
        s = suffixes([p for _, _, p in held], window)
        text = np.array([i for i, _, _ in held])[s.part]
        rec = np.empty(len(s.f), FIRST)
        rec["w0"], rec["w1"], rec["f"], rec["id"], rec["check"] = s.w0, s.w1, s.f, ids[text], check[text]
        yield len(s.buf), rec


def _splitters(sample: DataFrame, columns: int, buckets: int) -> list[np.ndarray]:
    """Quantiles of sampled rows of words; at most ``SAMPLE`` rows come to the driver."""
    rows = sample.limit(SAMPLE).toArrow()
    words = [rows.column(f"w{j}").to_numpy().view(np.uint64) for j in range(columns)]
    order, _ = multikey_sort(words)
    picked = np.unique(len(order) * np.arange(1, buckets) // max(1, buckets)) if len(order) else order
    return [w[order[picked]] for w in words]


def _share(wanted: int, there: int, salt: int):
    """A filter that keeps about ``wanted`` of ``there`` rows, by a hash of the text."""
    millionths = max(1, min(1_000_000, 1_000_000 * wanted // max(1, there)))
    return F.pmod(F.xxhash64("check", F.lit(salt)), F.lit(1_000_000)) < millionths


def _words_schema(n: int) -> str:
    return ", ".join(f"w{j} long" for j in range(n))


def _word_batch(words: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(w).view(np.int64)) for w in words],
                                      names=[f"w{j}" for j in range(len(words))])


def _compare_leads(texts: DataFrame, window: int, total_bytes: int) -> DataFrame:
    """``(id, check, f, tied)``: contexts that repeat, and first contexts whose leading bytes others have."""
    spark = texts.sparkSession
    there = total_bytes // BYTES_PER_SUFFIX
    buckets = max(1, min(SAMPLE // PER_BUCKET * 4, there * FIRST.itemsize // BUCKET_BYTES))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, rec in _first_records(b, window):
                # Four of many suffixes of a sampled text are enough: its share is four times as large.
                rec = rec[mix(rec["f"]) % np.uint64(8) == 0]
                yield _word_batch([rec["w0"], rec["w1"], rec["f"]])

    wanted = min(SAMPLE, PER_BUCKET * buckets)
    splitters = [np.empty(0, np.uint64)] * 3 if buckets == 1 else _splitters(
        texts.filter(_share(8 * wanted, there, 1)).mapInArrow(draw, _words_schema(3)), 3, buckets)
    shared = spark.sparkContext.broadcast(splitters)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> pa.RecordBatch:
            rec, repeats, _ = _earliest(np.concatenate(held))
            done = np.empty(repeats.sum(), DONE)
            for name in DONE.names:
                done[name] = rec[name][repeats]
            rec = rec[~repeats]
            return _deal(rec, [rec["w0"], rec["w1"], rec["f"]], shared.value, done)

        for b in batches:
            for n, rec in _first_records(b, window):
                if len(rec):
                    held.append(rec)
                size += n
                if held and size >= HELD_BYTES:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()

    def compare(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        rec, repeats, equal = _earliest(_records(table.column("open"), FIRST))
        n = len(rec)
        new_lead, new_context = equal <= 1, equal <= 2
        lead = np.cumsum(new_lead) - 1
        several = np.bincount(lead, weights=new_context, minlength=1)[lead] > 1 if n else np.empty(0, bool)
        s0, s1, _ = shared.value
        for at in (bucket - 1, bucket):  # the splitters on both sides of the bucket
            if 0 <= at < len(s0):
                several |= (rec["w0"] == s0[at]) & (rec["w1"] == s1[at])
        keep = repeats | several
        done = _records(table.column("done"), DONE)
        out = [np.concatenate([rec[c][keep], done[c]]) for c in ("id", "check", "f")]
        tied = np.concatenate([~repeats[keep], np.zeros(len(done), bool)])
        return pa.table({"id": out[0], "check": out[1], "f": out[2].view(np.int64), "tied": tied})

    dealt = texts.mapInArrow(scan, "bucket int, open binary, done binary")
    return dealt.groupBy("bucket").applyInArrow(compare, "id long, check int, f long, tied boolean")


def _lists(column: pa.ListArray, name: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    values = column.values if name is None else column.values.field(name)
    return column.offsets.to_numpy(), values.to_numpy(zero_copy_only=False)


def _ranges(s: Suffixes, text: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(suffix, position in values)`` of equal context hashes, where ``values`` are listed per text."""
    own, at = [], []
    for t in np.unique(text):
        listed = values[offsets[t]:offsets[t + 1]]
        if not len(listed):
            continue
        order = np.argsort(listed, kind="stable")
        mine = np.flatnonzero(text == t) if len(text) else text
        lo, hi = np.searchsorted(listed[order], s.f[mine], "left"), np.searchsorted(listed[order], s.f[mine], "right")
        n = hi - lo
        own.append(np.repeat(mine, n))
        at.append(offsets[t] + order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())])
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (own, at))


def _second_records(batch: pa.RecordBatch, window: int) -> Iterator[np.ndarray]:
    """Records with all bytes of the tied suffixes of a batch."""
    kind = _second(window)
    ids, check = batch.column("id").to_numpy(), batch.column("check").to_numpy()
    offsets, listed = _lists(batch.column("tied"))
    right, left = 8 * kind["r"].shape[0], 8 * kind["l"].shape[0]
    for held in _parts(as_bytes(batch.column("text").to_pylist()), window):
        s = suffixes([p for _, _, p in held], window)
        text = np.array([i for i, _, _ in held])[s.part]
        own, _ = _ranges(s, text, offsets, listed.view(np.uint64))
        own = np.unique(own)
        if not len(own):
            continue
        place, least, most = s.place[own], (s.place - s.hi)[own], (s.place - s.lo)[own]
        padded = np.concatenate([np.zeros(left, np.uint8), s.buf, np.zeros(right, np.uint8)])
        rec = np.empty(len(own), kind)
        after = padded[left + place[:, None] + np.arange(right)]
        after[np.arange(right) >= (window - least)[:, None]] = 0
        before = padded[left + place[:, None] - 1 - np.arange(left)]
        before[np.arange(left) >= most[:, None]] = 0
        rec["r"] = after.view(">u8").astype(np.uint64)
        rec["l"] = before.view(">u8").astype(np.uint64)
        rec["f"], rec["id"], rec["check"], rec["least"], rec["most"] = s.f[own], ids[text[own]], check[text[own]], least, most
        yield rec


def _same_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows of words, in bytes."""
    differ = a != b
    word = np.where(differ.any(1), differ.argmax(1), a.shape[1])
    rows = np.arange(len(a))
    at = np.minimum(word, a.shape[1] - 1)
    x = a[rows, at] ^ (b[rows, at] if b.shape[0] == a.shape[0] else b[0, at])
    inner = sum(((x >> np.uint64(64 - 8 * j)) == 0).astype(np.int64) for j in range(1, 8))
    return np.where(word < a.shape[1], 8 * word + inner, 8 * a.shape[1])


def _cut(words: np.ndarray, n: int) -> np.ndarray:
    """Rows of words with all bytes after the first ``n`` set to 0."""
    out = words.copy()
    out[:, -(-n // 8):] = 0
    if n % 8:
        out[:, n // 8] &= np.uint64(((1 << 8 * (n % 8)) - 1) << (64 - 8 * (n % 8)))
    return out


def _compare_windows(rec: np.ndarray, window: int, edges: list[np.ndarray]) -> tuple[np.ndarray, list[tuple]]:
    """``(bits of repeated windows per record, open windows)``.

    Bit ``L`` is the window of ``L`` bytes before the token start.  Windows that
    share their bytes with one of ``edges`` may go on in another bucket:
    ``(record, L, hash, other hash)`` each.
    """
    n = len(rec)
    groups = []
    for words in (rec["r"], rec["l"]):
        order, _ = multikey_sort([words[:, j] for j in range(words.shape[1])])
        shared = np.zeros(n, np.int64)
        shared[1:] = _same_bytes(words[order[1:]], words[order[:-1]])
        groups.append((order, shared))
    edge = np.full(n, -1)
    for e in edges:
        edge = np.maximum(edge, _same_bytes(rec["r"], e[None, :]))
    bits, open_ = np.zeros(n, np.int64), []

    def number(which: int, length: int) -> np.ndarray:
        order, shared = groups[which]
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(shared < length)
        return out

    for before in range(window - LEAD + 1):
        there = (rec["least"] <= before) & (before <= rec["most"])
        outside = np.flatnonzero(there & (edge >= window - before))
        if len(outside):
            parts = np.concatenate([_cut(rec["r"][outside], window - before), _cut(rec["l"][outside], before)], 1)
            one, two = (np.full(len(outside), seed + before, np.uint64) for seed in (1, 1 << 32))
            for j in range(parts.shape[1]):
                one, two = mix(one ^ parts[:, j]), mix(two + parts[:, j] * np.uint64(0xBF58476D1CE4E5B9))
            open_.append((outside, before, one, two))
            there[outside] = False
        at = np.flatnonzero(there)
        if len(at) < 2:
            continue
        after = number(0, window - before)
        at = at[np.bincount(after[at], minlength=n + 1)[after[at]] > 1]
        if len(at) < 2:
            continue
        both = after[at] * (n + 1) + number(1, before)[at]
        order = np.lexsort((rec["id"][at], both))
        at, both = at[order], both[order]
        new = np.concatenate([[True], both[1:] != both[:-1]])
        head = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        bits[at[rec["id"][at] > rec["id"][at[head]]]] |= np.int64(1) << np.int64(before)
    return bits, open_


def _compare_ties(texts: DataFrame, leads: DataFrame, window: int) -> DataFrame:
    """``(id, check, f, bits)``: repeated windows of contexts that share leading bytes with others."""
    spark = texts.sparkSession
    kind = _second(window)
    n_words = kind["r"].shape[0]
    there = leads.filter("tied").count()
    tied = leads.filter("tied").groupBy("id", "check").agg(F.collect_list("f").alias("tied"))
    buckets = max(1, min(SAMPLE // PER_BUCKET * 4, there * kind.itemsize // BUCKET_BYTES))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rec in _second_records(b, window):
                rec = rec[mix(rec["f"]) % np.uint64(8) == 0]
                yield _word_batch([rec["r"][:, j] for j in range(n_words)])

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right.hint("shuffle_hash"), ["id", "check"]).select("id", "check", "text", "tied")

    splitters = [np.empty(0, np.uint64)] * n_words
    if buckets > 1:
        part = _share(8 * min(SAMPLE, PER_BUCKET * buckets), there, 2)
        drawn = joined(texts.filter(part), tied.filter(part)).mapInArrow(draw, _words_schema(n_words))
        splitters = _splitters(drawn, n_words, buckets)
    shared = spark.sparkContext.broadcast(splitters)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, DONE)
        for b in batches:
            for rec in _second_records(b, window):
                words = [rec["r"][:, j] for j in range(n_words)]
                order, _ = multikey_sort(words)
                yield _deal(rec[order], [w[order] for w in words], shared.value, none)

    def compare(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        rec = _records(table.column("open"), kind)
        edges = [np.array([w[at] for w in shared.value], np.uint64) for at in (bucket - 1, bucket)
                 if 0 <= at < len(shared.value[0])]
        bits, open_ = _compare_windows(rec, window, edges)
        local = np.flatnonzero(bits)
        at = np.concatenate([local] + [o[0] for o in open_])
        bits = np.concatenate([bits[local]] + [np.full(len(o[0]), np.int64(1) << np.int64(o[1])) for o in open_])
        hashes = [np.concatenate([np.zeros(len(local), np.uint64)] + [o[j] for o in open_]).view(np.int64) for j in (2, 3)]
        is_open = np.arange(len(at)) >= len(local)
        return pa.table({"id": rec["id"][at], "check": rec["check"][at], "f": rec["f"][at].view(np.int64), "bits": bits,
                         "open": is_open, "one": hashes[0], "two": hashes[1]})

    dealt = joined(texts, tied).mapInArrow(scan, "bucket int, open binary, done binary")
    found = materialize(dealt.groupBy("bucket").applyInArrow(
        compare, "id long, check int, f long, bits long, open boolean, one long, two long"))
    across = found.filter("open")
    first = across.groupBy("one", "two").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    later = across.join(first, ["one", "two"]).filter(F.col("id") > F.col("first"))
    return found.filter("NOT open").unionByName(later, allowMissingColumns=True).select("id", "check", "f", "bits")


def _cover(s: Suffixes, own: np.ndarray, bits: np.ndarray, window: int) -> np.ndarray:
    """Which bytes of the buffer lie in a repeated window."""
    edge = np.zeros(len(s.buf) + 1, np.int64)
    whole = own[bits == -1]
    np.add.at(edge, s.lo[whole], 1)
    np.add.at(edge, s.hi[whole] + window, -1)
    own, bits = own[bits != -1], bits[bits != -1]
    for before in range(window - LEAD + 1) if len(own) else ():
        start = s.place[own] - before
        said = ((bits >> np.int64(before)) & 1 == 1) & (s.lo[own] <= start) & (start <= s.hi[own])
        np.add.at(edge, start[said], 1)
        np.add.at(edge, start[said] + window, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text",
                   keep_bytes: bool = True) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256[, spans, kept])`` per row.

    Removes every byte covered by a string of ``window`` bytes that also starts in
    a document with a smaller id.  Texts are UTF-8; strings may overlap, do not
    cross documents and are judged on the input.  ``spans`` are the maximal
    removed runs as byte ranges ``lo..hi-1``; ``kept`` are the other bytes, binary
    since a run may begin inside a character.

    A null text is empty; texts below ``window`` bytes keep all.  A null id comes
    after all ids.  Rows with the same id, and rows without one, are not smaller
    than each other, so neither repeats the other; each row has a result of its
    own.  An empty table gives no rows.  Other columns are not read.  Ids are whole
    numbers; ``window`` lies between 17 and 78.
    """
    if not LEAD < window <= LEAD + 62:
        raise ValueError(f"window must lie between {LEAD + 1} and {LEAD + 62} bytes")
    texts = _texts(docs, id_col, text_col)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    leads = materialize(_compare_leads(texts, window, total))
    ties = materialize(_compare_ties(texts, leads, window))
    marks = (leads.filter("NOT tied").select("id", "check", "f", F.lit(-1).cast("long").alias("bits")).unionByName(ties)
             .groupBy("id", "check").agg(F.collect_list(F.struct("f", "bits")).alias("marks")))
    joined = texts.join(marks.hint("shuffle_hash"), ["id", "check"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column("text").to_pylist())
            offsets, f = _lists(b.column("marks"), "f")
            bits = _lists(b.column("marks"), "bits")[1]
            marked = np.diff(offsets) > 0
            covered: dict[int, np.ndarray] = {}
            touched = np.flatnonzero(marked)
            for held in _parts([texts[i] for i in touched], window):
                s = suffixes([p for _, _, p in held], window)
                text = touched[np.array([i for i, _, _ in held])][s.part]
                own, at = _ranges(s, text, offsets, f.view(np.uint64))
                cover, start = _cover(s, own, bits[at], window), 0
                for i, offset, part in held:
                    i, piece = int(touched[i]), cover[start: start + len(part)]
                    start += len(part)
                    if i not in covered:
                        covered[i] = piece if len(part) == len(texts[i]) else np.zeros(len(texts[i]), bool)
                    if len(part) < len(texts[i]):
                        covered[i][offset: offset + len(part)] |= piece
            rows = []
            for i, text in enumerate(texts):
                if i not in covered:
                    rows.append((len(text), 0, [], hashlib.sha256(text).hexdigest(), text))
                    continue
                edge = np.flatnonzero(np.diff(covered[i], prepend=False, append=False))
                kept = np.frombuffer(text, np.uint8)[~covered[i]].tobytes()
                spans = [{"lo": lo, "hi": hi} for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist())]
                rows.append((len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            n, gone, spans, sha, kept = zip(*rows) if rows else ((),) * 5
            out = [b.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                   pa.array([len(x) for x in spans], pa.int64()), pa.array(sha, pa.string())]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_bytes:
                out += [pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
                        pa.array(kept, pa.binary())]
                names += ["spans", "kept"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = ("id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
              + ", spans array<struct<lo: long, hi: long>>, kept binary" * keep_bytes)
    out = joined.select("id", "text", "marks").mapInArrow(run, schema)
    return out.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id"))).withColumnRenamed("id", id_col)
