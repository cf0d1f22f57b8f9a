"""Session helpers: cutting lineage and bounded broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


_WRITTEN: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates.

    The cluster names it in ``spark.checkpoint.dir``.  Where it is unset, as in
    tests, it is a folder of the warehouse, which all executors share as well.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/caseweave-stages").rstrip("/")


def clear_stages(spark: SparkSession) -> None:
    """Delete the intermediates this session wrote; call it when all results that read them are written."""
    jvm = spark.sparkContext._jvm
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, partition_by: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage of iterative jobs; a lost executor only re-reads files.
    ``codec`` compresses other than the session's default does.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if codec:
        writer = writer.option("compression", codec)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, rows: Column) -> tuple[DataFrame, int]:
    """``materialize``, and how many of the written rows satisfy ``rows``, counted by the same job."""
    seen = Observation()
    written = materialize(df.observe(seen, F.count_if(rows).alias("n")))
    return written, seen.get["n"]


# A policy or lookup table is broadcast only below this row count.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` when it provably has at most ``max_rows`` rows.

    Reads at most ``max_rows + 1`` rows to decide; a larger table is returned
    without a hint, so Spark picks a shuffled join.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
