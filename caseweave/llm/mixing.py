"""Mixing sources to target weights by balanced sampling with the cube method.

Every document has an expected number of copies: the target of its source over
the source's size.  The whole part is taken for sure.  The fractional part is
an inclusion probability, rounded to 0 or 1 by the cube method: probabilities
move through the null space of two constraints (documents and words of the
source stay constant) until they are decided.

The flight runs in hash blocks of one source.  A block leaves two undecided
documents at most; these meet in fewer blocks in the next round, until every
source has one block.  There the landing gives up the count of documents first,
then rounds the last one to where the words of the source come nearest to its
target.  Large documents are decided first, so what is left is small.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseweave.llm.common import as_bytes, block_of
from caseweave.runtime import materialize

BLOCK_ROWS = 1024
EPS = 1e-9


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, source, size, h)``: words of the whole text, and a hash that orders the rows."""
    picked = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                         F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(t.split()) for t in as_bytes(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("source"), pa.array(n, pa.int64()),
                                              b.column("h")], names=["id", "source", "size", "h"])

    return picked.mapInArrow(count, f"id {dict(picked.dtypes)['id']}, source string, size long, h long")


def source_targets(sized: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """``(source, source_no, source_size, n, target)`` per source.

    Sources are numbered by code point, null last, and get ``weights`` in turn.
    The total is ``share`` of all sizes.  No target exceeds ``cap`` times its
    source; the excess goes to the others by weight until none is above.  That
    fixed point fills sources in the order of ``cap * size / weight``: those
    below the common level are full.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    # One row per source from here on.
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("source_no", (F.row_number().over(by_name) - 1).cast("int"))
    per = (per.withColumn("w", F.element_at(turn, F.pmod("source_no", F.lit(len(weights))) + 1))
           .withColumn("full", F.lit(float(cap)) * F.col("source_size")))
    everything = Window.partitionBy(F.lit(1))
    by_level = Window.orderBy(F.col("full") / F.col("w"), "source_no")
    upto = by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = (per.withColumn("goal", F.lit(float(share)) * F.sum("source_size").over(everything))
           .withColumn("full_before", F.sum("full").over(upto) - F.col("full"))
           .withColumn("w_left", F.sum("w").over(everything) - F.sum("w").over(upto) + F.col("w"))
           .withColumn("level", (F.col("goal") - F.col("full_before")) / F.col("w_left"))
           .withColumn("is_full", F.col("level") * F.col("w") >= F.col("full")))
    # The level of the first source that is not full holds for all that follow it.
    level = F.first(F.when(~F.col("is_full"), F.col("level")), ignorenulls=True).over(
        by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.select("source", "source_no", "source_size", "n",
                      F.when(F.col("is_full"), F.col("full")).otherwise(F.least(F.col("full"), level * F.col("w")))
                      .alias("target"))


def _direction(q: np.ndarray, x: np.ndarray, words_only: bool) -> np.ndarray:
    """A null vector of the constraints that moves the first (largest) unit and spreads the balance over all others.

    The others share the opposite move in proportion to their distance from a
    decision, so the large unit is usually decided first and the small ones stay
    open to balance what follows.
    """
    u = np.zeros(len(q))
    u[0] = 1.0
    w, rest = np.minimum(q[1:], 1 - q[1:]), x[1:]
    n, wx, wxx = w.sum(), (w * rest).sum(), (w * rest * rest).sum()
    if words_only:
        u[1:] = -w * rest * (x[0] / wxx) if wxx > 0 else 0.0
    elif rest.min() == rest.max():
        # Units of one size exchange among themselves; a larger first unit stays as it is.
        u[0] = float(x[0] == rest[0])
        u[1:] = -w / n if u[0] else np.concatenate([[1.0], -w[1:] / w[1:].sum()])
    else:
        det = n * wxx - wx * wx
        u[1:] = w * ((-wxx + x[0] * wx) / det + rest * ((wx - x[0] * n) / det))
    return u


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator, words_only: bool = False) -> np.ndarray:
    """Move probabilities, keeping ``sum(p)`` and ``sum(p * x)``, until at most two are undecided.

    With ``words_only`` just ``sum(p * x)`` is kept, and one stays undecided.
    Every step goes up or down a null vector with the odds that keep the expected
    value, as far as the first unit that reaches 0 or 1.
    """
    p = np.where(p < EPS, 0.0, np.where(p > 1 - EPS, 1.0, p))
    order = np.argsort(-x, kind="stable")
    index = order[(p[order] > 0) & (p[order] < 1)]
    q, y = p[index], x[index]
    while len(q) > (1 if words_only else 2) or (len(q) == 2 and y[0] == y[1]):
        u = _direction(q, y, words_only)
        moves = np.abs(u) > 1e-15
        v, s = q[moves], u[moves]
        up = np.min(np.where(s > 0, 1 - v, v) / np.abs(s))
        down = np.min(np.where(s > 0, v, 1 - v) / np.abs(s))
        q = q + up * u if rng.random() * (up + down) < down else q - down * u
        done = (q < EPS) | (q > 1 - EPS)
        p[index[done]] = np.round(q[done])
        index, q, y = index[~done], q[~done], y[~done]
    p[index] = q
    return p


def land(p: np.ndarray, x: np.ndarray, short: float) -> np.ndarray:
    """Decide the last units so that their words come nearest to what is still short of the target."""
    left = np.flatnonzero((p > 0) & (p < 1))
    best = min(itertools.product((0.0, 1.0), repeat=len(left)),
               key=lambda s: (abs(float(np.dot(s, x[left])) - short), s))
    p = p.copy()
    p[left] = best
    return p


def _round(parts: DataFrame, last: bool) -> DataFrame:
    schema = parts.schema

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("h", "ascending"), ("size", "ascending")])
        p, x = group.column("p").to_numpy(), group.column("size").to_numpy().astype(float)
        seed = [int(group.column("source_no")[0].as_py()), int(group.column("block")[0].as_py()), len(p)]
        rng = np.random.default_rng(seed)
        moved = flight(p, x, rng)
        if last:
            moved = flight(moved, x, rng, words_only=True)
            still = (moved > 0) & (moved < 1)
            moved = land(moved, x, float(np.dot(p, x) - np.dot(np.where(still, 0.0, moved), x)))
        return group.set_column(group.column_names.index("p"), "p", pa.array(moved))

    return parts.groupBy("source_no", "block").applyInArrow(run, schema)


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(id, source, size, source_size, target, copies, taken, h)``, one row per input row.

    ``taken`` is ``copies * size``.  The words taken of a source differ from its
    target by half of one small document; no document is taken more
    than ``cap`` times (``cap`` a whole number).  Reruns agree: all choices
    follow from hashes of id and text.  A null text has size 0, a null source is
    the last one, a source without words has target 0; repeated rows are drawn
    each for itself; an empty table gives no rows.  Other columns are not read.
    """
    if cap != int(cap):
        raise ValueError("cap must be a whole number")
    sized = materialize(sizes(docs, id_col, text_col, source_col))
    targets = materialize(source_targets(sized, weights, share, cap))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # One row per source: Spark broadcasts it below its own threshold, and splits a hot source otherwise.
    joined = sized.withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    parts = (joined.withColumn("rate", rate).withColumn("sure", F.floor(F.col("rate") + EPS))
             .withColumn("p", F.greatest(F.col("rate") - F.col("sure"), F.lit(0.0)))
             .withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("long"))
             .withColumn("block", F.pmod("h", "blocks"))
             .select("id", "source", "source_no", "size", "source_size", "target", "sure", "p", "h", "block", "blocks"))
    done = []
    while True:
        wide = parts.agg(F.max("blocks")).first()[0] or 0
        if wide <= 1:
            done.append(_round(parts, last=True))
            break
        moved = materialize(_round(parts, last=False))
        open_ = F.col("p").between(EPS, 1 - EPS)
        done.append(moved.filter(~open_))
        # Two open rows a block at most, so the rows of the next round per source are bounded by its blocks.
        parts = (moved.filter(open_).withColumn("blocks", F.ceil(F.col("blocks") * 2 / block_rows).cast("long"))
                 .withColumn("block", F.pmod(F.shiftright("h", 20), "blocks")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("sure") + F.round("p")).cast("long")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
                      copies.alias("copies"), (copies * F.col("size")).alias("taken"), "h")
