"""Snapshot comparisons on small data."""

from caseweave.operators import snapshots as S


def test_repeated_dependency_is_no_change(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "source string, target string")
    expected, observed = pairs([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x")]), pairs([("a", "x"), ("a", "x"), ("b", "x"), ("c", None)])
    got = {tuple(r) for r in S.bom_dependencies(expected, observed).collect()}
    assert got == {("a", "y", "removed"), ("c", None, "added")}
