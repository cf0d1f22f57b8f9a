"""Exact order statistics without gathering a group in one task.

Values are first counted per distinct value (partial aggregation), then ranked
by cumulative counts.  The running sum is split into value chunks whose bounds
come from a bounded-memory quantile sketch, so a group that holds a third of
all rows is still ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import prior

CHUNK_ROWS = 100_000  # about so many rows of a key share a value chunk
MOST_CHUNKS = 1024  # the sketch's steps; keys above CHUNK_ROWS * MOST_CHUNKS rows have longer chunks


def ranked_values(rows: DataFrame, keys: list[str], value: str, measures: dict[str, Column],
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per (keys, distinct value): each measure, its total over smaller values (``before_<name>``), the key's ``__rows``.

    A key is ranked in as many value chunks as its rows need: small keys in one,
    larger ones in up to ``MOST_CHUNKS``.
    """
    per_value = rows.groupBy(*keys, value).agg(*[m.alias(n) for n, m in measures.items()])
    steps = [i / MOST_CHUNKS for i in range(1, MOST_CHUNKS)]
    bounds = rows.groupBy(*keys).agg(F.percentile_approx(value, F.lit(steps), F.lit(8 * MOST_CHUNKS)).alias("__bounds"),
                                     F.count(F.lit(1)).alias("__rows"))
    stride = F.floor(MOST_CHUNKS / F.least(F.ceil(F.col("__rows") / chunk_rows), F.lit(MOST_CHUNKS)))
    bounds = bounds.withColumn("__bounds", F.filter("__bounds", lambda _, i: (i + 1) % stride == 0))
    if keys:
        v, limits = _join(per_value, bounds, keys), F.col("__bounds")
    else:
        v = per_value.withColumns({"__all": F.lit(1), "__rows": bounds.select("__rows").scalar()})
        limits = bounds.select("__bounds").scalar()
    chunk = F.size(F.filter(limits, lambda b: b < F.col(value)))
    v = prior(v, keys or ["__all"], [value], {f"before_{n}": ("sum", n) for n in measures}, chunk)
    return v.drop("__bounds", "__all")


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Equi join that also matches NULL keys."""
    r = right.select(*[F.col(k).alias(f"__j{i}") for i, k in enumerate(keys)],
                     *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__j{i}"))
    return left.join(r, cond).drop(*[f"__j{i}" for i in range(len(keys))])


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float],
                      chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Linearly interpolated percentiles per key, as ``percentile`` would return them."""
    rows = rows.filter(F.col(value).isNotNull())
    r = ranked_values(rows, keys, value, {"n": F.count(F.lit(1))}, chunk_rows)
    first, last = F.col("before_n"), F.col("before_n") + F.col("n")

    def at(position: Column) -> Column:
        return F.max(F.when((first <= position) & (position < last), F.col(value)))

    aggs = []
    for name, q in quantiles.items():
        pos = (F.col("__rows") - 1) * F.lit(float(q))
        aggs += [at(F.floor(pos)).alias(f"__lo_{name}"), at(F.ceil(pos)).alias(f"__hi_{name}"),
                 F.max(pos - F.floor(pos)).alias(f"__f_{name}")]
    g = r.groupBy(*keys).agg(*aggs)
    out = [(F.col(f"__lo_{n}") * (1 - F.col(f"__f_{n}")) + F.col(f"__hi_{n}") * F.col(f"__f_{n}")).alias(n)
           for n in quantiles]
    return g.select(*keys, *out)


def average_ranks(rows: DataFrame, keys: list[str], value: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Tie-averaged 1-based rank of every distinct value."""
    r = ranked_values(rows, keys, value, {"n": F.count(F.lit(1))}, chunk_rows)
    return r.select(*keys, value, "n", (F.col("before_n") + (F.col("n") + 1) / 2).alias("rank"))


def auc(rows: DataFrame, keys: list[str], score: str, positive: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Area under the ROC curve per key by rank sums; ties count one half."""
    is_pos = F.col(positive).cast("int")
    r = ranked_values(rows, keys, score, {"pos": F.sum(is_pos), "neg": F.sum(1 - is_pos)}, chunk_rows)
    return r.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("__wins"),
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")).select(
        *keys, "positives", "negatives",
        F.when((F.col("positives") > 0) & (F.col("negatives") > 0),
               F.col("__wins") / (F.col("positives") * F.col("negatives"))).alias("auc"))
