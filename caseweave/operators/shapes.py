"""Field and nested-shape profiles of JSON evidence, and their drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import union_all
from ..sources import variants as V


KINDS = ["object", "array", "string", "number", "boolean", "null"]


def field_profile(records: DataFrame, field_types: dict[str, list[str]], required: list[str]) -> DataFrame:
    """Per source and top-level field: presence, kinds, type mismatches, missing and unexpected.

    ``records``: source_id, raw.  Each member is one row, aggregated partially before the shuffle.
    """
    r = records.withColumn("m", V.fields(V.parse("raw")))
    n = r.groupBy("source_id").agg(F.count("*").alias("total"))
    x = r.select("source_id", F.explode("m").alias("field", "value")).withColumn("kind", V.kind(F.col("value")))
    allowed = F.create_map(*[c for k, v in field_types.items() for c in (F.lit(k), F.lit(v))])
    bad = F.map_contains_key(allowed, F.col("field")) & ~F.coalesce(F.array_contains(allowed[F.col("field")], F.col("kind")), F.lit(False))
    g = x.groupBy("source_id", "field").agg(
        F.count("*").alias("present_records"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"),
        F.count_if(bad).alias("type_mismatch_records"))
    absent = n.select("source_id", F.explode(F.lit(list(field_types))).alias("field")).join(g, ["source_id", "field"], "left_anti").select(
        "source_id", "field", F.lit(0).cast("bigint").alias("present_records"), F.lit("").alias("kinds"), F.lit(0).cast("bigint").alias("type_mismatch_records"))
    return g.unionByName(absent).join(n, "source_id").select(
        "source_id", "field", "present_records", "kinds", "type_mismatch_records",
        F.when(F.col("field").isin(required), F.col("total") - F.col("present_records")).otherwise(F.lit(0)).alias("missing_required_records"),
        (~F.col("field").isin(list(field_types))).alias("unexpected"))


def raw_evidence(evidence: DataFrame, min_size: int, max_size: int, required_text: list[str]) -> DataFrame:
    """Digest, size and required-text checks on whole raw evidence.  Rows: evidence_id, text, expected_sha256."""
    every = F.lit(True)
    for needle in required_text:
        every = every & F.contains("text", F.lit(needle))
    return evidence.select(
        "evidence_id", (F.sha2("text", 256) == F.col("expected_sha256")).alias("expected_digest_matches"),
        F.octet_length("text").between(min_size, max_size).alias("size_satisfies_rules"), every.alias("literal_text_satisfied"))


def shape_profile(records: DataFrame) -> DataFrame:
    """Occurrences, records and kinds of every nested path; array positions share one path.

    Counts are aggregated per (record, path) first, then per path.
    """
    x = V.walk(records.select("source_id", F.monotonically_increasing_id().alias("rid"), V.parse("raw").alias("doc")),
               ["source_id", "rid"], F.col("doc"), indexed=False)
    x = x.select("source_id", "rid", "path", V.kind(F.col("v")).alias("kind"))
    # All counts of a record come out of this one aggregate, so rid need not be stable across runs.
    per_record = x.groupBy("source_id", "path", "rid").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
    g = per_record.groupBy("source_id", "path").agg(
        *[F.sum(k).alias(k) for k in KINDS], F.count("*").alias("present_records"))
    counts = F.map_from_arrays(F.lit(KINDS), F.array(*[F.col(k) for k in KINDS]))
    return g.select("source_id", "path", sum((F.col(k) for k in KINDS), F.lit(0)).alias("occurrences"), "present_records",
                    F.map_filter(counts, lambda k, n: n > 0).alias("kind_occurrences"))


def shape_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Added and removed paths, changed kinds, and changed populations of two profiles."""
    side = lambda df, p: df.select("source_id", "path", F.struct(
        F.array_sort(F.map_keys("kind_occurrences")).alias("kinds"), "occurrences", "present_records",
        F.array_sort(F.map_entries("kind_occurrences")).alias("counts")).alias(p))
    j = side(baseline, "b").join(side(current, "c"), ["source_id", "path"], "full_outer")
    change = (F.when(F.col("b").isNull(), "added_path").when(F.col("c").isNull(), "removed_path")
              .when(F.col("b.kinds") != F.col("c.kinds"), "kind_change")
              .when(F.col("b") != F.col("c"), "population_change"))
    return j.select("source_id", "path", change.alias("change")).filter("change IS NOT NULL")
