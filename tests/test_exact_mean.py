"""Means that lie halfway between two rounded values."""

from caseweave.plans import load_all
from caseweave.plans.registry import QUERIES


def test_depth_transitions_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    """Depth 2 has the mean 0.0496875 and ties with depth 1 once rounded; a sum of doubles in this order falls short of it."""
    load_all()
    rows = [(1, 1, 0.049688, 0.0)] + [(1, 2, 0.05, 0.0)] * 63 + [(1, 2, 0.03, 0.0)]
    for name, part in (("up", rows), ("down", rows[::-1])):
        frame = spark.createDataFrame(part, "l_suppkey long, l_linenumber int, l_discount double, l_tax double")
        frame.coalesce(1).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        got = QUERIES["g39_depth_transitions"](spark, f"{tmp_path}/{name}").collect()
        assert [tuple(r) for r in got] == [(1, 1, 2, 1, 2)]
