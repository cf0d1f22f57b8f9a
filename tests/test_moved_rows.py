"""What moves in an ordered fold."""

from caseweave.operators.ordered import prior, seq_chunk
from tests.test_authority_containment import _shuffled


def test_nothing_is_carried_into_a_first_chunk(spark):
    """Keys of one chunk: rows move once, summaries twice; before, these moved once more to meet the rows."""
    n = 5000
    rows = spark.range(n).selectExpr("id AS k", "id % 2 AS seq", "concat('v', id) AS v")
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        before = _shuffled(spark)
        got = prior(rows, ["k"], ["seq"], {"p": ("last", "v")}, seq_chunk("seq")).collect()
        assert len(got) == n and all(r["p"] is None and r["v"] == f"v{r['k']}" for r in got)
        assert _shuffled(spark) - before < 3.5 * n
    finally:
        for k in keys:
            spark.conf.unset(k)


def test_a_key_may_order_and_be_folded(spark):
    rows = spark.createDataFrame([(k, i, None if i % 3 else i) for k in ("a", None) for i in range(12)], "k string, seq long, v long")
    got = prior(rows, ["k"], ["k", "seq"], {"key": ("last", "k"), "p": ("last", "v"), "n": ("sum", "seq")}, seq_chunk("seq", 5))
    want = {(k, i, k if i else None, (i - 1) // 3 * 3 if i else None, sum(range(i))) for k in ("a", None) for i in range(12)}
    assert {(r["k"], r["seq"], r["key"], r["p"], r["n"]) for r in got.collect()} == want
