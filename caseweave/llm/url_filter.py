"""URL filters over a sorted digest array.

List entries are ``host`` + ``path prefix`` strings such as ``example.com/en/``.
Their 64-bit xxhash keys are sorted into one array that every Python worker
memory-maps.  A URL is looked up by all its host suffixes and all path prefixes
of the lengths that the list has, with one binary search per batch; the stored
strings are then compared, so a colliding key never matches.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import ascii_lower

# The array is sent to every executor only up to this many bytes; a longer list is joined.
MAX_ARRAY_BYTES = 256 << 20


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _suffixes(host: str) -> list[str]:
    out, at = [host], host.find(".")
    while at >= 0:
        out.append(host[at + 1:])
        at = host.find(".", at + 1)
    return out


class DigestArray:
    """Sorted 64-bit keys with their strings, in memory-mapped files of the running task."""

    def __init__(self, entries: list[str]):
        coded = [e.encode() for e in entries]
        keys = np.array([xxhash.xxh64_intdigest(e) for e in coded], np.uint64)
        order = np.argsort(keys, kind="stable")
        ends = np.cumsum([len(coded[i]) for i in order], dtype=np.int64)
        self.folder = tempfile.TemporaryDirectory()
        self.keys = self._mapped("keys", keys[order])
        self.order = self._mapped("order", order.astype(np.int64))
        self.ends = self._mapped("ends", ends)
        self.strings = self._mapped("strings", np.frombuffer(b"".join(coded[i] for i in order), np.uint8))

    def _mapped(self, name: str, values: np.ndarray) -> np.ndarray:
        if not len(values):
            return values
        path = os.path.join(self.folder.name, f"{name}.npy")
        np.save(path, values)
        return np.load(path, mmap_mode="r")

    def probe(self, candidates: list[bytes]) -> np.ndarray:
        """Index of each candidate in the list given, -1 where it is absent."""
        found = np.full(len(candidates), -1, np.int64)
        if not len(self.keys) or not candidates:
            return found
        keys = np.array([xxhash.xxh64_intdigest(c) for c in candidates], np.uint64)
        at = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys):
            j = at[i]
            while j < len(self.keys) and self.keys[j] == keys[i]:  # several strings may share a key
                lo = self.ends[j - 1] if j else 0
                if self.strings[lo:self.ends[j]].tobytes() == candidates[i]:
                    found[i] = self.order[j]
                    break
                j += 1
        return found


def _candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    prefixes = [path[:n] for n in lengths if n <= len(path)]
    return [s + p for s in _suffixes(host) for p in prefixes]


def _rank(entry: Column) -> Column:
    """Longer entries win; of equal length the smaller string."""
    return F.struct((-F.length(entry)).alias("n"), entry.alias("entry"))


def filter_urls(pages: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url",
                default: str = "allow", max_array_bytes: int = MAX_ARRAY_BYTES) -> DataFrame:
    """Verdict of the longest fitting list entry for every URL.

    ``entries(host, path, verdict)``: an entry fits its host and all its
    subdomains if the URL's path starts with its path.  Returns
    ``(id_col, host, path, rule, verdict)``, one row per input row.

    A null URL, or one without ``://``, has an empty host and path and gets
    ``default``, as does a URL that fits nothing.  Repeated rows each get their
    verdict; of entries with the same host and path the smaller verdict
    (``allow``) holds; entries with a null field are ignored; an empty list
    gives ``default`` everywhere.  Other columns of ``pages`` are not read.
    """
    spark = pages.sparkSession
    host, path = host_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    listed = (entries.filter("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
              .groupBy(ascii_lower(F.col("host")).alias("host"), "path").agg(F.min("verdict").alias("verdict"))
              .select(F.concat("host", "path").alias("entry"), "path", "verdict"))
    size = listed.agg(F.sum(F.octet_length("entry") + 32), F.collect_set(F.length("path"))).first()
    lengths = sorted(size[1])
    if (size[0] or 0) <= max_array_bytes:
        rows = [tuple(r) for r in listed.select("entry", "verdict").collect()]  # bounded by max_array_bytes
        shared = spark.sparkContext.broadcast(rows)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            array = DigestArray([e for e, _ in shared.value])
            for batch in batches:
                hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
                cands, owner = [], []
                for i, (h, p) in enumerate(zip(hosts, paths)):
                    mine = _candidates(h, p, lengths)
                    cands += mine
                    owner += [i] * len(mine)
                hit = array.probe([c.encode() for c in cands])
                rule, verdict = [None] * len(hosts), [default] * len(hosts)
                for k in np.flatnonzero(hit >= 0):
                    i, (entry, said) = owner[k], shared.value[hit[k]]
                    if rule[i] is None or (-len(entry), entry) < (-len(rule[i]), rule[i]):
                        rule[i], verdict[i] = entry, said
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()),
                     pa.array(verdict, pa.string())], names=["id", "host", "path", "rule", "verdict"])

        kind = dict(urls.dtypes)["id"]
        judged = urls.mapInArrow(judge, f"id {kind}, host string, path string, rule string, verdict string")
        return judged.withColumnRenamed("id", id_col)

    # A list beyond the bound: every distinct host and path is matched by equi joins on the entry string.
    parts = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(parts)),
                         lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    prefix = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")),
                         lambda n: F.substring(F.col("path"), F.lit(1), n))
    named = urls.select("host", "path").distinct()
    tried = (named.withColumn("s", F.explode(suffix)).withColumn("p", F.explode(prefix))
             .select("host", "path", F.concat("s", "p").alias("entry")))
    best = (tried.join(listed.select("entry", "verdict"), "entry").groupBy("host", "path")
            .agg(F.min_by(F.struct("entry", "verdict"), _rank(F.col("entry"))).alias("b")))
    return (urls.join(best, ["host", "path"], "left")
            .select(F.col("id").alias(id_col), "host", "path", F.col("b.entry").alias("rule"),
                    F.coalesce("b.verdict", F.lit(default)).alias("verdict")))
