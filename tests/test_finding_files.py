"""Finding files that are compressed."""

import glob

import pytest

from caseweave.sinks import exports as K

ROWS = [("f1", f"type-{i % 3}", "high", f"s|{i}" if i % 5 else None, f"e{i}") for i in range(3000)]


@pytest.mark.parametrize("fmt", ["json", "csv", "markdown"])
def test_packed_parts_hold_the_same(spark, tmp_path, fmt):
    df = spark.createDataFrame(ROWS, "analyzer string, type string, severity string, subject_id string, event_id string").repartition(3)
    lines = {}
    for codec in (None, "gzip"):
        K.write_findings(df, f"{tmp_path}/{codec}", fmt, codec)
        lines[codec] = sorted(r.value for r in spark.read.text(f"{tmp_path}/{codec}").collect())
    assert lines[None] == lines["gzip"] and len(lines[None]) == {"json": 3000, "csv": 3003, "markdown": 3006}[fmt]
    assert len(glob.glob(f"{tmp_path}/gzip/part-*.gz")) == 3 and not glob.glob(f"{tmp_path}/None/part-*.gz")
