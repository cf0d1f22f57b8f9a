"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells; every shard owns the arcs before its
virtual nodes.  A key goes to the shard of its arc while that shard has room
and continues clockwise otherwise.  Loads are bounded by exact row capacities
(some shards take one row more than the others), so shard sizes differ by one
row at most, and only keys of overfull shards leave their arc.

Only the number of keys per arc comes to the driver (one number per virtual
node).  Keys themselves get their shard from their rank within the arc, counted
in hash buckets, with DataFrame functions alone.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseweave.llm.common import block_of
from caseweave.runtime import materialize

CELLS = 1 << 14
VIRTUAL_NODES = 64
# Rows ranked together in one task.
BUCKET_ROWS = 4096


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """``(last cell, shard)`` of every arc, clockwise.  A cell claimed twice goes to the smaller shard."""
    owner: dict[int, int] = {}
    for shard in range(shards):
        for k in range(virtual_nodes):
            cell = int.from_bytes(hashlib.blake2b(f"{shard}/{k}".encode(), digest_size=8).digest(), "big") % CELLS
            owner[cell] = min(shard, owner.get(cell, shard))
    return sorted(owner.items())


def place(arcs: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(arc, lo, hi, shard, slot)``: the keys of an arc ranked lo..hi-1 go to a shard from a slot on.

    Home keys come first, arc by arc clockwise; what a full shard cannot take is
    carried clockwise and fills the next shards with room, oldest first.  Two
    turns suffice, as the capacities hold all keys.
    """
    used, pieces, extra = [0] * len(capacity), [], []
    for arc, (count, shard) in enumerate(zip(arcs, owners)):
        kept = min(count, capacity[shard] - used[shard])
        if kept:
            pieces.append((arc, 0, kept, shard, used[shard]))
            used[shard] += kept
        extra.append((kept, count))
    carried: deque[tuple[int, int, int]] = deque()
    for turn in range(2):
        for arc, shard in enumerate(owners):
            if turn == 0 and extra[arc][0] < extra[arc][1]:
                carried.append((arc, *extra[arc]))
            while carried and used[shard] < capacity[shard]:
                source, lo, hi = carried.popleft()
                taken = min(hi - lo, capacity[shard] - used[shard])
                pieces.append((source, lo, lo + taken, shard, used[shard]))
                used[shard] += taken
                if lo + taken < hi:
                    carried.appendleft((source, lo + taken, hi))
    return pieces


def _inline(spark: SparkSession, rows: list[dict], fields: str) -> DataFrame:
    """A small table from a literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")))


def shard_rows(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
               virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` for every row.

    Law: the row counts of any two shards differ by at most one; slots run
    gapless from 0 within a shard.  The key is the id.  A null id is a key of its
    own, a null text counts as empty, an empty table gives no rows.  Rows with
    the same id and text are interchangeable, so they fill their slots in any
    order.  Other columns are not read.
    """
    spark = docs.sparkSession
    arcs = ring(shards, virtual_nodes)
    cells, last = [], -1
    for arc, (cell, _) in enumerate(arcs):
        cells.append({"arc": arc, "lo": last + 1, "hi": cell})
        last = cell
    if last < CELLS - 1:
        cells.append({"arc": 0, "lo": last + 1, "hi": CELLS - 1})  # past the last node the ring starts over
    # One row per ring cell: a constant number of rows, so it may be sent everywhere.
    cell_arc = F.broadcast(_inline(spark, cells, "arc int, lo int, hi int")
                           .select(F.explode(F.sequence("lo", "hi")).alias("cell"), "arc"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.xxhash64(F.col(id_col), text).alias("order"))
    keys = keys.withColumn("cell", block_of(CELLS, F.col("id"))).join(cell_arc, "cell").drop("cell")
    keys = materialize(keys)
    total = keys.count()
    buckets = 1 + total // (len(arcs) * BUCKET_ROWS)
    keys = keys.withColumn("bucket", F.pmod("order", F.lit(buckets)))
    counts = materialize(keys.groupBy("arc", "bucket").agg(F.count("*").alias("n")))

    per_arc = [0] * len(arcs)
    for arc, n in counts.groupBy("arc").agg(F.sum("n")).collect():  # one row per virtual node at most
        per_arc[arc] = n
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    pieces = [dict(zip(("arc", "lo", "hi", "shard", "slot"), p))
              for p in place(per_arc, [s for _, s in arcs], capacity)]
    # At most one piece per arc plus one per shard and turn: bounded by the ring.
    plan = F.broadcast(_inline(spark, pieces, "arc int, lo long, hi long, shard int, slot long")
                       .groupBy("arc").agg(F.collect_list(F.struct("lo", "hi", "shard", "slot")).alias("pieces")))

    before = Window.partitionBy("arc").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("arc", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("arc", "bucket").orderBy("order", "id", "text_crc32", "size")
    ranked = (keys.withColumn("k", F.row_number().over(within)).join(offsets, ["arc", "bucket"])
              .withColumn("rank", F.col("offset") + F.col("k") - 1).join(plan, "arc"))
    mine = F.filter("pieces", lambda p: (p["lo"] <= F.col("rank")) & (F.col("rank") < p["hi"]))[0]
    return (ranked.withColumn("p", mine)
            .select(F.col("id").alias(id_col), "size", "text_crc32", F.col("p.shard").alias("shard"),
                    (F.col("p.slot") + F.col("rank") - F.col("p.lo")).alias("slot")))
