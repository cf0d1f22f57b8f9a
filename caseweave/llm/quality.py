"""Quality classifier: a sparse ensemble of rules over text statistics.

A small forest is grown on labelled documents.  Every path from a root to a node
is a rule, a conjunction of comparisons of statistics.  A lasso logistic
regression weighs the rules and leaves few of them; those are compiled into one
Spark column expression, so scoring has no model object and no lookup.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.llm.common import SPACES, as_bytes
from caseweave.runtime import materialize

STATS = ["log_words", "word_bytes", "upper_share", "caps_words", "symbol_share", "symbol_words", "digit_share",
         "other_share", "distinct_words", "top_word", "repeated_lines", "stops_share", "line_words", "stutter"]
_UPPER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_LETTER = _UPPER + _UPPER.lower() + bytes(range(128, 256))
_STOP = b".,;:?'\"()-"
_SYMBOL = bytes(c for c in range(33, 127) if c not in _LETTER + _DIGIT + _STOP)
_NOT_SYMBOL = bytes(c for c in range(256) if c not in _SYMBOL + SPACES)
TREES, DEPTH, BINS, PENALTY = 12, 3, 64, 1e-3
# At most so many labelled rows are fitted, chosen by a hash of the id; all documents are scored.
MAX_LABELLED = 200_000


def text_stats(text: bytes) -> list[float]:
    """The statistics named in ``STATS``; all zero for a text without words."""
    words = text.split()
    if not words:
        return [0.0] * len(STATS)
    n, total = len(words), sum(map(len, words))

    def share(chars: bytes) -> float:
        return (len(text) - len(text.translate(None, chars))) / total

    symbols, counts = len(text.translate(None, _NOT_SYMBOL).split()), Counter(words)
    lines = [s for s in text.split(b"\n") if s.strip()]
    caps = sum(map(bytes.isupper, words))
    return [float(np.log1p(n)), total / n, share(_UPPER), caps / n, share(_SYMBOL), symbols / n, share(_DIGIT),
            share(bytes(range(128, 256))), len(counts) / n, max(counts.values()) / n,
            1 - len(set(lines)) / len(lines), share(_STOP), n / len(lines),
            sum(map(eq, words, words[1:])) / n]


def with_stats(docs: DataFrame, text_col: str = "text", name: str = "__stats") -> DataFrame:
    """All columns of ``docs`` and an array of its text's statistics."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [text_stats(t) for t in as_bytes(b.column(text_col).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(stats, pa.list_(pa.float64()))],
                                             names=[*b.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    return docs.mapInArrow(run, schema)


class Model(NamedTuple):
    """Kept rules as SQL conditions over the array of statistics, with their weights."""

    intercept: float
    rules: list[tuple[str, float]]

    def score(self, stats: str) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.expr(f"CASE WHEN {rule.replace('$', stats)} THEN {weight!r}D ELSE 0D END")
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[tuple[str, float]]:
        named = [(re.sub(r"\$\[(\d+)\]", lambda m: STATS[int(m[1])], r), w) for r, w in self.rules]
        return sorted(named, key=lambda x: -abs(x[1]))


def tree_rules(text: str) -> list[str]:
    """Paths to all nodes of a printed tree, as SQL conditions with ``$`` for the statistics."""
    rules, path = [], []
    for line in text.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\deE]+)\)", line)
        if found:
            level = len(found[1])
            path = [p for p in path if p[0] < level] + [(level, f"$[{found[2]}] {found[3]} {float(found[4])!r}D")]
            rules.append(" AND ".join(sorted({c for _, c in path})))
    return rules


def lasso(x: np.ndarray, n: np.ndarray, good: np.ndarray, penalty: float, steps: int = 3000) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on standardised columns, by accelerated proximal gradient steps.

    Row i of ``x`` stands for ``n[i]`` rows, ``good[i]`` of them of class 1.
    """
    share = n / n.sum()
    mean = share @ x
    spread = np.sqrt(np.maximum(share @ (x - mean) ** 2, 1e-12))
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / spread])
    step = 4.0 / np.linalg.eigvalsh(z.T @ (z * share[:, None]))[-1]
    w = ahead = np.zeros(z.shape[1])
    momentum = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ ahead, -50, 50)))
        moved = ahead - step * (z.T @ (share * p - good / n.sum()))
        moved[1:] = np.sign(moved[1:]) * np.maximum(np.abs(moved[1:]) - step * penalty, 0)
        following = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        ahead = moved + (momentum - 1) / following * (moved - w)
        w, momentum = moved, following
    weights = w[1:] / spread
    return float(w[0] - weights @ mean), weights


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
        max_labelled: int = MAX_LABELLED, seed: int = 7) -> Model:
    """Rules and weights from ``stats(id_col, __stats)`` and ``labels(id_col, label_col)``.

    Rows without a label, or labels without a document, are ignored; of several
    labels of one id the larger counts.  With one class only, or none, the score
    is that class's share (0.5 without labels).
    """
    said = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
            .groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("double").alias("label")))
    rows = (stats.select(F.col(id_col).alias("__id"), F.col("__stats").alias("stats")).join(said, "__id")
            .select("stats", "label", F.xxhash64("__id").alias("h")))
    n, good = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or good in (0, n):
        share = (good / n) if n else 0.5
        return Model(float(np.log((share + 1e-6) / (1 - share + 1e-6))), [])
    part = int((1 << 20) * min(1.0, max_labelled / n))
    rows = rows.filter(F.pmod("h", F.lit(1 << 20)) < part)
    rows = rows.orderBy("h").select("label", "stats", array_to_vector("stats").alias("features")).persist()
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH,
                                    maxBins=BINS, seed=seed, featureSubsetStrategy="onethird").fit(rows)
    rules = sorted({r for tree in forest.trees for r in tree_rules(tree.toDebugString)})
    if not rules:
        rows.unpersist()
        return Model(float(np.log(good / (n - good))), [])
    fired = F.concat(*[F.expr(f"CASE WHEN {r.replace('$', 'stats')} THEN '1' ELSE '0' END") for r in rules])
    # Rows that fire the same rules are one row here; there are at most max_labelled of them.
    seen = (rows.groupBy(fired.alias("fired")).agg(F.count("*").alias("n"), F.sum("label").alias("good"))
            .orderBy("fired").collect())
    rows.unpersist()
    matrix = np.array([[c == "1" for c in r.fired] for r in seen], float)
    intercept, weights = lasso(matrix, np.array([r.n for r in seen], float), np.array([r.good for r in seen], float),
                               PENALTY)
    return Model(intercept, [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6])


def is_held_out(id_column: Column, parts: int = 5) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string")), F.lit(parts)) == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", keep: list[str] | None = None) -> tuple[Model, DataFrame]:
    """Model from the labelled rows that are not held out, and the statistics of all rows beside columns to keep.

    The statistics are written once; labels meet them, never the texts.
    """
    names = list(dict.fromkeys([*(keep or []), id_col]))
    stats = materialize(with_stats(docs.select(*dict.fromkeys([*names, text_col])), text_col).select(*names, "__stats"))
    return fit(stats.filter(~is_held_out(F.col(id_col))), labels, id_col, label_col), stats


def _judged(stats: DataFrame, model: Model, names: list[str], threshold: float, id_col: str) -> DataFrame:
    scored = stats.withColumn("__held_out", is_held_out(F.col(id_col))).withColumn("__score", model.score("__stats"))
    return scored.select(*names, F.col("__held_out").alias("held_out"), F.col("__score").alias("score"),
                         (F.col("__score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id",
             text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``(id, held_out, score, predicted)`` of every row.

    Learns from labelled rows that are not held out; scores every whole text.
    Null and empty texts are scored like any text (all statistics are zero);
    repeated rows get equal scores; rows with a null id are scored, never
    learned from; an empty table gives no rows.  Other columns are not read.
    """
    model, stats = learn(docs, labels, id_col, text_col, label_col)
    return _judged(stats, model, [id_col], threshold, id_col)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id",
              text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``classify`` does not reject."""
    model, _ = learn(docs, labels, id_col, text_col, label_col)
    scored = with_stats(docs, text_col)
    return scored.filter(model.score("__stats") >= threshold).select(*docs.columns)
