"""Robust z of unknown values."""

import math

from pyspark.sql import functions as F

from caseweave.operators import statistics as S


def test_degenerate_z_of_an_unknown_value_is_unknown(spark):
    rows = [("none", None, 1.0), ("no median", 1.0, None), ("nan", math.nan, 1.0), ("below", 0.5, 1.0), ("above", 2.0, 1.0), ("same", 1.0, 1.0)]
    zero = F.lit(0.0)
    z, how = S.robust_z(F.col("x"), F.col("m"), zero, F.col("m"), zero)
    got = {r["id"]: r["z"] for r in spark.createDataFrame(rows, "id string, x double, m double").select("id", z.alias("z")).collect()}
    assert got["none"] is None and got["no median"] is None and math.isnan(got["nan"])
    assert (got["below"], got["above"], got["same"]) == (-math.inf, math.inf, 0.0)
