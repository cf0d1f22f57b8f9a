"""Query registry and the small SQL dialect shim shared by Spark and the oracle.

The given tables are mapped to the domain tables of this engine by SQL text
that both engines run, so the two sides of a check start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
# Names of queries that return the four finding columns.
FINDING_QUERIES: set[str] = set()


class Spark:
    """Spark spelling of the functions that differ between the engines."""

    name = "spark"

    @staticmethod
    def sha(x): return f"sha2({x}, 256)"

    @staticmethod
    def jstr(x, path): return f"get_json_object({x}, '$.{path}')"

    @staticmethod
    def arr(*xs): return f"array({', '.join(xs)})"

    @staticmethod
    def ts_add(ts, n, unit): return f"timestampadd({unit}, {n}, {ts})"

    @staticmethod
    def epoch(ts): return f"CAST(floor(unix_micros(CAST({ts} AS TIMESTAMP)) / 1000000) AS BIGINT)"


class Duck:
    """DuckDB spelling."""

    name = "duck"

    @staticmethod
    def sha(x): return f"sha256({x})"

    @staticmethod
    def jstr(x, path): return f"json_extract_string({x}, '$.{path}')"

    @staticmethod
    def arr(*xs): return f"[{', '.join(xs)}]"

    @staticmethod
    def ts_add(ts, n, unit): return f"({ts} + to_{unit.lower()}s(CAST({n} AS BIGINT)))"

    @staticmethod
    def epoch(ts): return f"CAST(floor(epoch_us({ts}) / 1000000) AS BIGINT)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def domain(spark: SparkSession, sf: str, build, **extra: DataFrame) -> DataFrame:
    """Run a domain-table mapping on Spark.  ``build(d)`` returns SQL with ``{table}`` names."""
    text = build(Spark)
    used = {t: table(spark, sf, t) for t in TABLES if "{" + t + "}" in text}
    used.update(extra)
    return spark.sql(text, **used)


def duck(build) -> str:
    """The same mapping as DuckDB SQL over the registered views."""
    text = build(Duck)
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL counterpart where one exists."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
            if getattr(sql, "is_findings", False):
                FINDING_QUERIES.add(name)
        return fn
    return register


class FindingSql(str):
    """SQL of a detector."""

    is_findings = True


def finding_sql(cte: str, rules: list[tuple[str, str, str]], *, src: str, event_id: str = "event_id",
                subject: str = "subject_id", columns: str = "") -> str:
    """Oracle text of a row-local detector: one UNION ALL branch per finding type."""
    branches = [
        f"SELECT '{t}' AS type, '{sev}' AS severity, CAST({subject} AS VARCHAR) AS subject_id, "
        f"CAST({event_id} AS VARCHAR) AS event_id FROM {src} WHERE {cond}"
        for t, sev, cond in rules
    ]
    return FindingSql(f"{cte} " + " UNION ALL ".join(branches))


def brief(findings: DataFrame) -> DataFrame:
    """The finding columns the oracle comparison uses."""
    return findings.select("type", "severity", "subject_id", "event_id")
