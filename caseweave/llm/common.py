"""Shared helpers: word rules, vectorised word hashes, hash blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of bytes outside this class; the same rule holds in numpy, ``bytes.split`` and SQL.
SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Texts are handled in pieces of about so many bytes, so a task's memory follows its longest text, not its input.
CHUNK_BYTES = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def as_bytes(texts: Iterable[str | None], lower: bool = False) -> list[bytes]:
    out = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    return [t.lower() for t in out] if lower else out


def pieces(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about ``limit`` in sum; a larger item is a range of its own."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


class Words(NamedTuple):
    """Words of several texts, in order.  ``first[d]`` to ``first[d + 1]`` are the words of text ``d``."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def split_words(texts: list[bytes]) -> Words:
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = np.ones(256, np.int8)
    inside[list(SPACES)] = 0
    edge = np.diff(inside[buf], prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    doc = np.searchsorted(begin, start, "right") - 1
    first = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]).astype(np.int64)
    return Words(buf, start, end, doc, first)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (finaliser of the splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, p, np.uint64)]))
                      for p in (_MULTIPLIER, inverse)]
    return _POWERS[0], _POWERS[1]


class RangeHash:
    """64-bit hashes of any ranges of a value sequence, from one pass of prefix sums."""

    def __init__(self, values: np.ndarray):
        power, self.inverse = _powers(len(values) + 1)
        self.prefix = np.concatenate([np.zeros(1, np.uint64),
                                      np.cumsum((values + np.uint64(1)) * power[: len(values)], dtype=np.uint64)])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        raw = (self.prefix[hi] - self.prefix[lo]) * self.inverse[lo]
        return mix(raw + (hi - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash per word that depends on its bytes only."""
    return RangeHash(words.buf.astype(np.uint64)).of(words.start, words.end)


def block_of(n_blocks: int, *columns: Column) -> Column:
    """Hash block of a row; the same rows always share a block."""
    return F.pmod(F.xxhash64(*columns), F.lit(n_blocks)).cast("int")
