"""Line, envelope, CSV and case-tree scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import variants as V


def lenient_lines(lines: DataFrame) -> DataFrame:
    """Parsed JSON lines; blank and unparseable ones are dropped.  ``lines`` has ``value``."""
    return lines.withColumn("doc", V.parse("value")).filter(F.col("doc").isNotNull())


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return lenient_lines(spark.read.text(path))


def strict_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed lines, and a quarantine of the ones that do not parse.

    Blank lines are skipped; every other column of ``lines`` (file, line
    number) is kept on both sides.
    """
    parsed = lines.filter(F.trim("value") != "").withColumn("doc", V.parse("value"))
    return (parsed.filter(F.col("doc").isNotNull()),
            parsed.filter(F.col("doc").isNull()).drop("doc").withColumn("error", F.lit("json")))


def read_typed_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed scan with the unparseable rest in ``_corrupt_record``; columns prune."""
    return spark.read.schema(f"{schema}, _corrupt_record STRING").json(
        path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def enveloped(docs: DataFrame, key: str) -> DataFrame:
    """Rows of ``{"<key>": [...]}``, of a bare array, or of an object that is itself one row.

    ``docs`` has ``doc`` (VARIANT); output adds ``ordinal`` (from 0) and ``row``.
    """
    doc = F.col("doc")
    kind = V.kind(doc)
    inner = V.at(doc, f"$.{key}")
    rows = (F.when(kind == "array", V.items(doc)).when(V.kind(inner) == "array", V.items(doc, f"$.{key}"))
            .when((kind == "object") & inner.isNull(), F.array(doc)).otherwise(F.array().cast("array<variant>")))
    return docs.select(*[c for c in docs.columns if c != "doc"], F.posexplode(rows).alias("ordinal", "row"))


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_case_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every file under a case folder: relative path, size, SHA-256 and content."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    path = F.regexp_replace("path", r"^file:(//)?", "")
    return files.select(F.replace(path, F.lit(base + "/"), F.lit("")).alias("path"), F.col("length").alias("size"),
                        F.sha2("content", 256).alias("sha256"), "content")


def glob_regex(pattern: Column) -> Column:
    """Shell pattern (``*``, ``?``) to an anchored regular expression."""
    literal = F.regexp_replace(F.lower(pattern), r"([.\\+^$|(){}\[\]])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(literal, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def _hits(patterns: list[tuple[str, str]]) -> Column:
    """The artifacts whose presence pattern matches the lower-case path or file name."""
    wanted = F.array(*[F.struct(F.lit(a).alias("artifact_id"), glob_regex(F.lit(p)).alias("rx")) for a, p in patterns])
    low = F.lower("path")
    name = F.substring_index(low, "/", -1)
    return F.array_distinct(F.transform(
        F.filter(wanted, lambda w: F.regexp(low, w["rx"]) | F.regexp(name, w["rx"])), lambda w: w["artifact_id"]))


def match_files(files: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """Artifacts whose presence pattern matches the lower-case path or file name.

    ``patterns`` is the bounded pack configuration [(artifact_id, pattern)]; it
    is attached as array, so files are scanned once and never shuffled.
    """
    return files.select("path", F.explode(_hits(patterns)).alias("artifact_id"))


def with_artifacts(files: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """``files`` with a row per artifact that matches, or one with a null ``artifact_id``; each file is read once."""
    return files.select("*", F.explode_outer(_hits(patterns)).alias("artifact_id"))


def search(files: DataFrame, query: str, regex: bool = False, case_sensitive: bool = False,
           max_hits: int | None = None) -> DataFrame:
    """Text search over file rows (path, text, sha256): line number and line of every hit.

    ``max_hits`` is the report's own limit; hits are ordered by path and line.
    """
    lines = files.select("path", "sha256", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    if regex:
        hit = F.col("line").rlike(query if case_sensitive else f"(?i){query}")
    else:
        hit = (F.contains("line", F.lit(query)) if case_sensitive
               else F.contains(F.lower("line"), F.lit(query.lower())))
    found = lines.filter(hit).select("path", (F.col("pos") + 1).alias("line"), F.rtrim("line").alias("text"), "sha256")
    return found.orderBy("path", "line").limit(max_hits) if max_hits else found


def receipt_completeness(receipts: DataFrame) -> DataFrame:
    """Pagination receipts per source: complete only if every receipt says so."""
    return receipts.groupBy("source").agg(
        F.bool_and(F.coalesce("collection_complete", F.lit(False))).alias("collection_complete"),
        F.sum("page_count").alias("pages"), F.count("*").alias("receipts"))
