"""Baselines, robust scores, and vector and tensor comparisons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, materialize
from .ranks import _join, auc, exact_percentiles

# The attested metrics.
TARGET_METRICS = ["cosine_to_exact_approved_activation", "relative_l2_to_exact_approved_activation",
                  "projection_delta_from_exact_approved", "projection_on_approved_direction"]


def measurements(attestations: DataFrame) -> DataFrame:
    """Unpivot ``measurements`` (depth -> metric -> value) of successful attestations."""
    ok = attestations.filter("event_type = 'activation_attestation' AND status = 'ok'")
    by_depth = ok.select("request_id", "prompt_id", F.explode("measurements").alias("depth", "metrics"))
    return (by_depth.select("request_id", "prompt_id", F.col("depth").cast("int").alias("depth"),
                            F.explode("metrics").alias("metric", "value"))
            .filter(F.col("metric").isin(TARGET_METRICS) & F.col("value").isNotNull()))


def baseline(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """n, median, MAD, mean, sample deviation, tail quantiles, min and max per key."""
    rows = rows.filter(F.col(value).isNotNull())
    # One row per key: written once, because both the deviations and the result read it.
    q = materialize(exact_percentiles(rows, keys, value, {"median": .5, "q01": .01, "q05": .05, "q95": .95, "q99": .99}))
    deviations = _join(rows.select(*keys, value), q.select(*keys, "median"), keys).select(
        *keys, F.abs(F.col(value) - F.col("median")).alias("deviation"))
    mad = exact_percentiles(deviations, keys, "deviation", {"mad": .5})
    basic = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"),
        F.when(F.count("*") >= 2, F.stddev_samp(value)).otherwise(0.0).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    return _join(_join(basic, q, keys), mad, keys)


def robust_z(x: Column, median: Column, mad: Column, mean: Column, std: Column) -> tuple[Column, Column]:
    """Robust z and the scale it used: MAD, else standard deviation, else degenerate."""
    sigma = F.lit(1.4826) * F.coalesce(mad, F.lit(0.0))
    by_mad, by_std = sigma > 1e-12, F.coalesce(std, F.lit(0.0)) > 1e-12
    # Unknown stays unknown: a null gives null, NaN gives NaN.
    far = F.signum(x - median) * F.lit(math.inf)
    z = (F.when(by_mad, (x - median) / sigma).when(by_std, (x - mean) / std)
         .when(F.abs(x - median) <= 1e-12, F.lit(0.0)).otherwise(far))
    return z, F.when(by_mad, "mad").when(by_std, "std").otherwise("degenerate")


def score(rows: DataFrame, base: DataFrame, keys: list[str], value: str = "value", threshold: float = 5.0) -> DataFrame:
    """Every measurement against its baseline."""
    stats = broadcast_if_small(materialize(base.select(*keys, "median", "mad", "mean", "std")))
    z, method = robust_z(F.col(value), F.col("median"), F.col("mad"), F.col("mean"), F.col("std"))
    return (rows.join(stats, keys).withColumns({"robust_z": z, "scoring_method": method})
            .withColumn("abs_robust_z", F.abs("robust_z"))
            .withColumn("anomalous", F.col("abs_robust_z") >= threshold))


def depth_maxima(scored: DataFrame, keys: list[str], metric: str = "metric", threshold: float = 5.0) -> DataFrame:
    """Largest absolute z per depth and the metric it came from."""
    return scored.groupBy(*keys).agg(
        F.max("abs_robust_z").alias("max_abs_z"),
        F.max_by(metric, F.struct("abs_robust_z", metric)).alias("metric_at_max"),
        F.count_if("anomalous").alias("anomalies")).withColumn("anomalous", F.col("max_abs_z") >= threshold)


def depth_summary(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Median, tails and extremes per depth and metric; sort by the caller's ranking."""
    q = exact_percentiles(rows, keys, value, {"p05": .05, "median": .5, "p95": .95})
    basic = rows.groupBy(*keys).agg(F.count("*").alias("samples"), F.min(value).alias("min"), F.max(value).alias("max"))
    return _join(basic, q, keys)


# Vectors ------------------------------------------------------------------

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def directions(vectors: DataFrame) -> DataFrame:
    """Unit direction between the class means per depth.

    ``vectors``: depth, positive (boolean), vec.  Means are aggregated per
    dimension with map-side combine; only one vector per depth is reassembled.
    """
    dims = vectors.select("depth", "positive", F.posexplode("vec").alias("dim", "x"))
    x = F.col("x").cast("double")
    means = dims.groupBy("depth", "dim").agg(
        (F.avg(F.when(F.col("positive"), x)) - F.avg(F.when(~F.col("positive"), x))).alias("delta"))
    raw = means.groupBy("depth").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("dim", "delta"))), lambda s: s["delta"]).alias("raw"))
    raw = raw.withColumn("raw_norm", norm(F.col("raw")))
    return raw.select("depth", F.transform("raw", lambda v: v / (F.col("raw_norm") + 1e-12)).alias("direction"), "raw_norm")


def projections(vectors: DataFrame, dirs: DataFrame) -> DataFrame:
    return vectors.join(broadcast_if_small(materialize(dirs.select("depth", "direction"))), "depth").withColumn(
        "projection", dot(F.col("vec"), F.col("direction")))


def projection_metrics(projected: DataFrame) -> DataFrame:
    """AUC, Cohen's d and mean separation per depth."""
    p, q = F.when(F.col("positive"), F.col("projection")), F.when(~F.col("positive"), F.col("projection"))
    g = projected.groupBy("depth").agg(
        F.avg(p).alias("positive_mean"), F.avg(q).alias("negative_mean"), F.count(p).alias("np"), F.count(q).alias("nq"),
        F.var_samp(p).alias("vp"), F.var_samp(q).alias("vq"))
    pooled = F.sqrt(((F.col("np") - 1) * F.col("vp") + (F.col("nq") - 1) * F.col("vq")) / (F.col("np") + F.col("nq") - 2))
    separation = F.col("positive_mean") - F.col("negative_mean")
    d = F.when((F.col("np") >= 2) & (F.col("nq") >= 2), separation / (pooled + 1e-12))
    a = auc(projected.select("depth", "projection", "positive"), ["depth"], "projection", "positive")
    return g.join(a.select("depth", "auc"), "depth").select(
        "depth", "auc", d.alias("cohens_d"), separation.alias("separation"), "positive_mean", "negative_mean")


def compare_metrics(approved: DataFrame, suspect: DataFrame, k: int = 10) -> DataFrame:
    """Suspect against approved metrics per depth, ranked by the change of Cohen's d."""
    a = approved.select("depth", *[F.col(c).alias(f"approved_{c}") for c in ("auc", "cohens_d", "separation")])
    ratio = F.when(F.abs("approved_separation") > 1e-12, F.col("separation") / F.col("approved_separation"))
    return suspect.join(a, "depth").select(
        "depth", (F.col("auc") - F.col("approved_auc")).alias("auc_delta"),
        (F.col("cohens_d") - F.col("approved_cohens_d")).alias("cohens_d_delta"),
        ratio.alias("separation_ratio")).orderBy(F.desc(F.abs("cohens_d_delta")), "depth").limit(k)


def matched_delta(reference: DataFrame, suspect: DataFrame) -> DataFrame:
    """Cosine and relative L2 of matched vectors, per depth.  Rows: prompt_id, depth, vec."""
    r, s = F.col("rv"), F.col("sv")
    j = reference.select("prompt_id", "depth", F.col("vec").alias("rv")).join(
        suspect.select("prompt_id", "depth", F.col("vec").alias("sv")), ["prompt_id", "depth"])
    diff = F.zip_with(s, r, lambda x, y: x.cast("double") - y.cast("double"))
    j = j.withColumns({"cosine": dot(r, s) / F.greatest(norm(r) * norm(s), F.lit(1e-8)), "rel": norm(diff) / (norm(r) + 1e-12)})
    return j.groupBy("depth").agg(
        F.avg("cosine").alias("mean_cosine"), F.min("cosine").alias("min_cosine"),
        F.avg("rel").alias("mean_relative_l2"), F.max("rel").alias("max_relative_l2"))


def curve_similarity(curves: DataFrame) -> DataFrame:
    """Cosine and relative L2 of two curves given as rows (approved, suspect)."""
    a, s = F.col("approved"), F.col("suspect")
    g = curves.agg(F.sum(a * s).alias("as"), F.sum(a * a).alias("aa"), F.sum(s * s).alias("ss"), F.sum((s - a) * (s - a)).alias("dd"))
    return g.select((F.col("as") / F.greatest(F.sqrt("aa") * F.sqrt("ss"), F.lit(1e-8))).alias("curve_cosine"),
                    (F.sqrt("dd") / (F.sqrt("aa") + 1e-12)).alias("curve_relative_l2"))


def tensor_delta(reference: DataFrame, suspect: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Delta statistics per tensor from aligned chunks (tensor, chunk_id, values).

    Each chunk is reduced in place; only sums cross the shuffle.
    """
    j = reference.select("tensor", "chunk_id", F.col("values").alias("rv")).join(
        suspect.select("tensor", "chunk_id", F.col("values").alias("sv")), ["tensor", "chunk_id"])
    d = F.zip_with("sv", "rv", lambda x, y: x.cast("double") - y.cast("double"))
    total = lambda arr, f: F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + f(x))
    j = j.withColumn("d", d).select(
        "tensor", F.size("d").alias("n"), total("d", lambda x: x * x).alias("dd"),
        total("rv", lambda x: x.cast("double") * x.cast("double")).alias("rr"),
        total("d", F.abs).alias("ad"), F.array_max(F.transform("d", F.abs)).alias("mx"),
        F.size(F.filter("d", lambda x: F.abs(x) > tolerance)).alias("ch"))
    g = j.groupBy("tensor").agg(F.sum("n").alias("numel"), F.sum("dd").alias("dd"), F.sum("rr").alias("rr"),
                                F.sum("ad").alias("ad"), F.max("mx").alias("max_abs_delta"), F.sum("ch").alias("ch"))
    return g.select("tensor", "numel", F.sqrt("dd").alias("delta_fro"), F.sqrt("rr").alias("reference_fro"),
                    (F.sqrt("dd") / (F.sqrt("rr") + 1e-30)).alias("relative_fro_delta"),
                    (F.col("ad") / F.col("numel")).alias("mean_abs_delta"), "max_abs_delta",
                    (F.col("ch") / F.col("numel")).alias("changed_fraction"))


def exact_mean(column: str, digits: int) -> Column:
    """Mean of decimal fractions, rounded half up, the same in whatever order rows come.

    A sum of doubles keeps a trace of their order, which decides where the mean
    lies halfway between two results.  Values that are no such fractions (not
    finite, 10^10 or more) are averaged as doubles.
    """
    exact = F.col(column).try_cast("decimal(28,18)")
    mean = F.when(F.count(exact) == F.count(column), F.round(F.try_avg(exact), digits).cast("double"))
    return F.coalesce(mean, F.round(F.avg(column), digits))


def largest_transitions(depths: DataFrame, keys: list[str]) -> DataFrame:
    """Largest jump between adjacent depths, worst cosine and largest relative L2 per key.

    ``depths``: keys, depth, cosine, relative_l2; the depths of one key are model layers.
    """
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy("depth")
    j = depths.withColumns({"from_depth": F.lag("depth").over(w), "rel_jump": F.col("relative_l2") - F.lag("relative_l2").over(w),
                            "cos_drop": F.lag("cosine").over(w) - F.col("cosine")})
    size = F.when(F.col("from_depth").isNotNull(), F.struct(F.round(F.col("rel_jump") + F.col("cos_drop"), 9), -F.col("depth")))
    return j.groupBy(*keys).agg(
        F.max_by(F.struct("from_depth", "depth"), size).alias("t"),
        F.min_by("depth", F.struct("cosine", "depth")).alias("worst_cosine_depth"),
        F.max_by("depth", F.struct("relative_l2", "depth")).alias("max_relative_l2_depth")).select(
        *keys, "t.from_depth", F.col("t.depth").alias("to_depth"), "worst_cosine_depth", "max_relative_l2_depth")


def low_rank_screen(samples: DataFrame) -> DataFrame:
    """Singular-value energy of each tensor's sampled delta (at most 256 x 256 cells).

    ``samples``: tensor, row, col, delta.  The sample bounds the group, so one
    small matrix per tensor reaches a Python worker.
    """
    import numpy as np
    import pandas as pd

    def screen(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="row", columns="col", values="delta").fillna(0.0).to_numpy(dtype="float64")
        sv = np.linalg.svd(m, compute_uv=False)
        energy = sv * sv
        total = float(energy.sum())
        if total == 0.0:
            out = (0.0, 0.0, 0.0, 0.0)
        else:
            p = energy / (total + 1e-30)
            p = p[p > 0]
            out = (math.sqrt(total), float(energy[0] / total), float(energy[:5].sum() / total),
                   math.exp(float(-(p * np.log(p)).sum())))
        return pd.DataFrame([(pdf["tensor"].iloc[0], *out)],
                            columns=["tensor", "sample_fro", "top1_energy_ratio", "top5_energy_ratio", "effective_rank"])

    return samples.groupBy("tensor").applyInPandas(
        screen, "tensor string, sample_fro double, top1_energy_ratio double, top5_energy_ratio double, effective_rank double")


def sample_positions(values: DataFrame, rows: int = 256, cols: int = 256) -> DataFrame:
    """Deterministic sample of matrix cells: up to ``rows`` x ``cols`` positions chosen by hash per tensor.

    ``values``: tensor, row, col, plus the cell.  Position lists are distinct
    row and column numbers, ranked per tensor by their hash.
    """
    from pyspark.sql import Window

    def chosen(axis: str, k: int) -> DataFrame:
        h = F.xxhash64("tensor", F.lit(axis), axis)
        w = Window.partitionBy("tensor").orderBy(h, axis)
        return values.select("tensor", axis).distinct().withColumn("__rn", F.row_number().over(w)).filter(
            F.col("__rn") <= k).drop("__rn")

    return values.join(chosen("row", rows), ["tensor", "row"], "left_semi").join(
        chosen("col", cols), ["tensor", "col"], "left_semi")
