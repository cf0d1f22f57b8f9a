"""The case tree: files written by many tasks, read once, matched in place."""

import re

from caseweave.plans import feeds
from caseweave.sources import files as FS


def test_files_are_written_by_many_tasks(spark, sf, monkeypatch):
    monkeypatch.setattr(feeds, "FILES_A_TASK", 20)
    seen = []
    read = FS.read_case_tree
    monkeypatch.setattr(FS, "read_case_tree", lambda s, root: seen.append(read(s, root)) or seen[0])
    feeds.s5_tree(spark, sf)
    tasks = {re.search(r"part-(\d+)", r.path)[1] for r in seen[0].select("path").collect() if "part-" in r.path}
    assert len(tasks) > 5


def test_with_artifacts(spark):
    files = spark.createDataFrame([("a/x.TXT", 1), ("b/y.bin", 2)], "path string, size long")
    got = {tuple(r) for r in FS.with_artifacts(files, [("text", "*.txt"), ("a", "a/*"), ("other", "z")]).collect()}
    assert got == {("a/x.TXT", 1, "text"), ("a/x.TXT", 1, "a"), ("b/y.bin", 2, None)}
