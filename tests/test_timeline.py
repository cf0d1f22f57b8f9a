"""Timelines over long spans."""

from datetime import datetime

from pyspark.sql import functions as F

from caseweave.sources.traces import kernel_timeline


def test_kernel_time_far_from_the_first_event_is_exact(spark):
    first = 100_000_000
    later = first + 576_460_752_305_000_000  # as doubles, a microsecond less
    events = spark.createDataFrame([(1, first, "a"), (1, later, "b")], "collector_id int, ts_ns long, event_id string")
    collectors = spark.createDataFrame([(1, datetime(2024, 1, 1))], "collector_id int, start timestamp")
    rows = kernel_timeline(events, collectors).select("event_id", F.unix_micros("adjusted").alias("us")).collect()
    at = {r["event_id"]: r["us"] for r in rows}
    assert at["b"] - at["a"] == (later - first) // 1000
