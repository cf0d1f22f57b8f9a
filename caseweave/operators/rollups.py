"""Group aggregates over events, sessions, tasks and findings."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import looks_like_refusal, present
from .detectors import BROWSER_ACTIONS, first_present


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of the values of several columns in one pass: (field, value, n)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return (rows.select(F.explode(pairs).alias("p")).select("p.field", "p.value").filter(present("value"))
            .groupBy("field", "value").agg(F.count("*").alias("n")))


def session_rollup(events: DataFrame) -> DataFrame:
    """Events, actions, approvals and distinct URLs per browser session."""
    et = F.col("event_type")
    counts = events.groupBy("session_id").agg(
        F.count("*").alias("events"), F.count_if(et.isin(BROWSER_ACTIONS)).alias("actions"),
        F.count_if(et == "approval").alias("approvals"), F.count_if(present("url")).alias("urls"))
    distinct = events.filter(present("url")).select("session_id", "url").distinct().groupBy("session_id").agg(
        F.count("*").alias("distinct_urls"))
    return counts.join(distinct, "session_id", "left").withColumn("distinct_urls", F.coalesce("distinct_urls", F.lit(0)))


def memory_lineage(events: DataFrame) -> DataFrame:
    """Last write per memory object and the other sessions that read it."""
    writes = events.filter("event_type IN ('memory_write', 'memory_update') AND memory_id <> ''").groupBy("memory_id").agg(
        F.max_by(F.struct("event_id", "actor_id", "session_id", "content_sha256"), F.struct("ts", "ord")).alias("w")).select(
        "memory_id", F.col("w.event_id").alias("write_event_id"), F.col("w.actor_id").alias("writer"),
        F.col("w.session_id").alias("write_session_id"))
    # (memory, session) pairs first: a hot object is spread over its sessions.
    reads = events.filter("event_type = 'memory_read' AND memory_id <> ''").groupBy("memory_id", "session_id").agg(
        F.count("*").alias("reads"))
    j = writes.join(reads, "memory_id", "left")
    other = (F.col("session_id") != "") & ~F.col("session_id").eqNullSafe(F.col("write_session_id"))
    return j.groupBy("memory_id", "write_event_id", "writer", "write_session_id").agg(
        F.coalesce(F.sum("reads"), F.lit(0)).alias("read_count"), F.count_if(other).alias("fanout"))


def memory_propagation(lineage: DataFrame) -> DataFrame:
    return lineage.filter("fanout >= 2").select(
        F.lit("memory_cross_session_propagation").alias("type"), F.lit("high").alias("severity"), "memory_id", "fanout")


def distinct_counts(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Distinct non-null values of several columns per key.

    (key, column, value) triples are deduplicated first, which spreads a hot
    key over its values, unlike one distinct aggregate per column.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    triples = rows.filter(F.col(key).isNotNull()).select(key, F.explode(pairs).alias("p")).select(
        key, "p.field", "p.value").filter("value IS NOT NULL").distinct()
    g = triples.groupBy(key).agg(*[F.count_if(F.col("field") == c).alias(c) for c in columns])
    return g


def identity_rollup(events: DataFrame) -> DataFrame:
    """Hosts, processes, certificate fingerprints and events per workload identity."""
    d = distinct_counts(events, "spiffe_id", ["host_id", "process_id", "svid_sha256"])
    n = events.filter("spiffe_id IS NOT NULL").groupBy("spiffe_id").agg(F.count("*").alias("events"))
    return n.join(d, "spiffe_id").select(
        "spiffe_id", "events", F.col("host_id").alias("hosts"), F.col("process_id").alias("processes"),
        F.col("svid_sha256").alias("fingerprints"))


def more_than_one(rows: DataFrame, key: str, value: str, type_: str, severity: str) -> DataFrame:
    """Keys with more than one distinct value: multiple owners, changed cards, split contexts, drift."""
    pairs = rows.filter(present(key) & present(value)).select(key, value).distinct()
    return pairs.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(
        F.lit(type_).alias("type"), F.lit(severity).alias("severity"), F.col(key).alias("subject_id"), "n")


def context_tasks(rows: DataFrame) -> DataFrame:
    return rows.filter("context_id <> '' AND task_id <> ''").select("context_id", "task_id").distinct().groupBy(
        "context_id").agg(F.count("*").alias("tasks"))


def approved_contexts(attestations: DataFrame) -> DataFrame:
    """Distinct execution contexts of approved runs."""
    return attestations.select("model_ref", "model_revision", "fingerprint_sha256", "thinking").distinct()


def coverage(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Present and total expected items per case, percent, and the missing ones.

    ``expected``: keys, item; ``found``: keys, item.
    """
    j = expected.join(found.select(*keys, "item").distinct().withColumn("_have", F.lit(True)), [*keys, "item"], "left")
    have = F.coalesce("_have", F.lit(False))
    return j.groupBy(*keys).agg(
        F.count_if(have).alias("present"), F.count("*").alias("total"),
        F.round(100.0 * F.count_if(have) / F.count("*"), 1).alias("percent"),
        F.array_join(F.array_sort(F.collect_set(F.when(~have, F.col("item")))), ",").alias("missing"))


def finding_cube(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Finding counts over analyzer x severity x tenant (or other columns) with all subtotals."""
    return findings.cube(*(by or ["analyzer", "severity", "tenant_id"])).agg(
        F.count("*").alias("n"), F.grouping_id().alias("level"))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def fleet_view(registry: DataFrame, states: DataFrame, now: Column, default_seconds: float = 300.0) -> DataFrame:
    """Node state with staleness: never seen, or silent for 2.5 expected intervals."""
    j = registry.join(states, "node_id", "left")
    age = (F.unix_micros(now) - F.unix_micros("last_seen")) / 1e6
    stale = age > F.coalesce("expected_seconds", F.lit(default_seconds)) * 2.5
    return j.select("node_id", F.when(F.col("last_seen").isNull(), "NEVER_SEEN").when(stale, "STALE")
                    .otherwise(F.col("state")).alias("state"), F.coalesce(stale, F.lit(True)).alias("stale"),
                    F.round(age, 1).alias("age_seconds"))


def refusal_rates(records: DataFrame) -> DataFrame:
    """Heuristic refusal rate per expected class."""
    return records.groupBy("expected_refusal").agg(
        F.count("*").alias("n"), F.avg(looks_like_refusal("text").cast("double")).alias("refusal_rate"))


def detection_quality(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected and forbidden signals per test against what was found.

    ``expected``: test_id, signal, kind (expected or forbidden).  ``found``: test_id, signal.
    """
    j = expected.join(found.select("test_id", "signal").distinct().withColumn("_hit", F.lit(True)), ["test_id", "signal"], "left")
    hit = F.coalesce("_hit", F.lit(False))
    want, avoid = F.col("kind") == "expected", F.col("kind") == "forbidden"
    return j.groupBy("test_id").agg(
        F.count_if(want & hit).alias("tp"), F.count_if(want & ~hit).alias("fn"), F.count_if(avoid & hit).alias("fp")).withColumn(
        "passed", (F.col("fn") == 0) & (F.col("fp") == 0))


def detection_metrics(quality: DataFrame) -> DataFrame:
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return quality.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
                       F.round(F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0), 4).alias("precision"),
                       F.round(F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0), 4).alias("recall"),
                       F.bool_and("passed").alias("passed"))


def font_runs(runs: DataFrame) -> DataFrame:
    """Per-document font-trick statistics from the run table (doc_id, run_ord, font, text).

    A font name ending in a hex suffix names the character it draws; ``0`` names none.
    """
    suffix = F.regexp_extract("font", r"^.+ (0|[0-9a-fA-F]{2,8})$", 1)
    decoded = F.when(F.length(suffix) % 2 == 0, F.expr("try_validate_utf8(CAST(unhex(__s) AS STRING))"))
    r = runs.withColumn("__s", suffix).withColumn(
        "visible", F.when(F.col("__s") == "0", "").when(F.col("__s") == "", None)
        .when(F.char_length(decoded) == 1, decoded))
    chars = F.split("text", "")
    n = F.char_length("text")
    same = F.size(F.filter(chars, lambda x: x == F.col("visible")))
    mapped = F.col("visible").isNotNull()
    stealth = F.when(F.col("visible") == "", n).otherwise(0)
    mismatch = F.when(mapped & (F.col("visible") != ""), n - same).otherwise(0)
    stats = r.groupBy("doc_id").agg(
        F.count("*").alias("runs"), F.count_if(n == 1).alias("one_char"),
        F.sum(F.when(mapped, n).otherwise(0)).alias("mapped"), F.sum(stealth).alias("stealth"),
        F.sum(mismatch).alias("mismatch"))
    fonts = r.filter("font IS NOT NULL").select("doc_id", "font", mapped.alias("m")).distinct().groupBy("doc_id").agg(
        F.count("*").alias("fonts"), F.count_if("m").alias("coded_fonts"))
    return stats.join(fonts, "doc_id", "left").fillna(0, ["fonts", "coded_fonts"])


def font_findings(stats: DataFrame) -> DataFrame:
    rules = [
        ("per_character_font_switching", "critical",
         (F.col("runs") >= 20) & (F.col("one_char") / F.col("runs") >= 0.70) & (F.col("fonts") >= 8)),
        ("machine_visible_text_disagreement_via_font_mapping", "critical",
         (F.col("mapped") >= 10) & (F.col("mismatch") / F.greatest(F.col("mapped") - F.col("stealth"), F.lit(1)) >= 0.30)),
        ("stealth_font_machine_only_characters", "critical", F.col("stealth") > 0),
        ("evilfonttool_style_font_family_pattern", "high", F.col("coded_fonts") >= 8),
    ]
    hits = F.filter(F.array(*[F.when(c, F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"))) for t, s, c in rules]),
                    lambda x: x.isNotNull())
    return stats.select("doc_id", F.explode(hits).alias("__f")).select("doc_id", "__f.type", "__f.severity")


def glyph_collapse(glyphs: DataFrame) -> DataFrame:
    """Fonts whose printable code points share one outline or are blank.

    ``glyphs``: font_id, codepoint, outline_sha256, commands.
    """
    g = glyphs.filter("codepoint BETWEEN 32 AND 126")
    per = g.groupBy("font_id", "outline_sha256").agg(F.count("*").alias("n"), F.count_if(F.col("commands") == 0).alias("blank"))
    f = per.groupBy("font_id").agg(
        F.sum(F.when(F.col("outline_sha256").isNotNull(), F.col("n")).otherwise(0)).alias("n"),
        F.max(F.when(F.col("outline_sha256").isNotNull(), F.col("n")).otherwise(0)).alias("largest"),
        F.sum("n").alias("printable"), F.sum("blank").alias("blank"))
    rules = [("font_glyph_outline_collapse", (F.col("n") >= 20) & (F.col("largest") / F.col("n") >= 0.70)),
             ("font_mass_blank_glyph_mapping", (F.col("printable") >= 20) & (F.col("blank") / F.col("printable") >= 0.70))]
    hits = F.filter(F.array(*[F.when(c, F.lit(t)) for t, c in rules]), lambda x: x.isNotNull())
    return f.select("font_id", "n", "largest", F.explode(hits).alias("type"))


def alias_collisions(members: DataFrame) -> DataFrame:
    """Members of an archive that a portable file system could not tell apart, after the first."""
    from ..functions.text import portable_path
    m = members.withColumn("alias", portable_path("name"))
    first = m.groupBy("archive_id", "alias").agg(F.min("ordinal").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return m.join(first, ["archive_id", "alias"]).filter("ordinal > first").select("archive_id", "ordinal", "name", "alias")


def capped_examples(findings: DataFrame, keys: list[str], example: str, k: int) -> DataFrame:
    """``(keys, total, examples)``: how many findings there are, and the first ``k`` of them in order of ``example``.

    Each task keeps ``k`` rows of a key before they are dealt out, so a finding type
    with very many rows is never gathered.  Nulls come last and are not listed.
    """
    first = Window.partitionBy(*keys).orderBy(F.col(example).asc_nulls_last())
    shown = (findings.select(*keys, example).withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= k)
             .groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col(example).isNotNull(), F.struct("__n", example)))),
                                             lambda x: x[example]).alias("examples")))
    counts = findings.groupBy(*keys).agg(F.count("*").alias("total"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
    joined = counts.alias("a").join(shown.alias("b"), reduce(and_, same))
    return joined.select(*[F.col(f"a.{c}").alias(c) for c in keys], "total", "examples")
