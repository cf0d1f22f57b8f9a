"""Ordered folds that do not pull a hot key into one task.

The values a row needs from the earlier rows of its key are split in two:
those inside its own time chunk (a window over ``keys + chunk``) and one
carried summary per earlier chunk (a partial aggregate, then a window over the
few chunk summaries of a key).  A key that holds a third of all rows is thus
spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_KEY, _CHUNK = "__key", "__chunk"


def time_chunk(ts: Column | str, seconds: int = 3600) -> Column:
    """Chunk number of a timestamp; monotone in ``ts``."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.coalesce(F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000)),
                      F.lit(-(2 ** 62)))


def seq_chunk(seq: Column | str, rows: int = 100_000) -> Column:
    """Chunk number of an integer sequence."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    return F.floor(seq / F.lit(rows))


def prior(df: DataFrame, keys: list[str], order: list[str], specs: dict, chunk: Column) -> DataFrame:
    """Add, per row, aggregates over the strictly earlier rows of its key.

    ``specs`` maps an output name to ``(kind, column)`` with kind
    ``last`` (last non-null), ``max``, ``min``, ``sum`` or ``count``
    (rows where the column is true).  ``chunk`` must never decrease along
    ``order``.  Sums and counts are 0 when nothing precedes.
    """
    exprs, source = {}, {}
    for name, (kind, column) in specs.items():
        # A plain column is read where it is, any other value is a column of its own.
        source[name] = column if isinstance(column, str) and column not in keys and kind != "count" else f"__v_{name}"
        column = F.col(column) if isinstance(column, str) else column
        exprs[name] = (kind, column if kind != "count" else F.when(column, F.lit(1)).otherwise(F.lit(0)))
    # One struct stands for the key: it is never null, so the join needs no null-safe comparison and reuses the
    # partitioning and the order of the window.  The rows move once, their key in the struct only; summaries are
    # aggregated before they move.
    tagged = df.withColumns({_KEY: F.struct(*keys), _CHUNK: chunk,
                             **{source[n]: c for n, (_, c) in exprs.items() if source[n] == f"__v_{n}"}}).drop(*keys)

    order = [c for c in order if c not in keys]
    inside = (Window.partitionBy(_KEY, _CHUNK).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    carried = (Window.partitionBy(_KEY).orderBy(_CHUNK)
               .rowsBetween(Window.unboundedPreceding, -1))
    position = F.struct(*order)
    per_chunk, carry, local = [], [], {}
    for name, (kind, _) in exprs.items():
        v, s = F.col(source[name]), f"__s_{name}"
        if kind == "last":
            per_chunk.append(F.max_by(v, F.when(v.isNotNull(), position)).alias(s))
            carry.append(F.last(s, ignorenulls=True).over(carried).alias(f"__c_{name}"))
            local[name] = F.last(v, ignorenulls=True).over(inside)
        else:
            agg = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.sum}[kind]
            per_chunk.append(agg(v).alias(s))
            carry.append(agg(s).over(carried).alias(f"__c_{name}"))
            local[name] = agg(v).over(inside)

    # Nothing is carried into the first chunk of a key, so only later ones meet the rows.
    later = (F.row_number().over(Window.partitionBy(_KEY).orderBy(_CHUNK)) > 1).alias("__later")
    summary = (tagged.groupBy(_KEY, _CHUNK).agg(*per_chunk).select(_KEY, _CHUNK, *carry, later)
               .filter("__later").drop("__later"))
    rows = tagged.withColumns({f"__l_{n}": c for n, c in local.items()})
    joined = rows.join(summary, [_KEY, _CHUNK], "left")

    out = [F.col(_KEY)[c].alias(c) if c in keys else F.col(c) for c in df.columns]
    for name, (kind, _) in exprs.items():
        here, before = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        if kind == "last":
            value = F.coalesce(here, before)
        elif kind in ("sum", "count"):
            value = F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
        else:
            value = (F.greatest if kind == "max" else F.least)(here, before)
        out.append(value.alias(name))
    return joined.select(*out)




def nth_of_key(df: DataFrame, keys: list[str], order: list[str], chunk: Column, name: str = "rn") -> DataFrame:
    """1-based position of each row within its key."""
    counted = prior(df, keys, order, {name: ("count", F.lit(True))}, chunk)
    return counted.withColumn(name, F.col(name) + 1)
