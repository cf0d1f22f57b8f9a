"""Site-relative removal of boilerplate lines.

For every host, the share of its pages that contain a line is compared with a
ratio; lines above it are navigation, footers and notices, and go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import SPACES
from caseweave.llm.url_filter import host_path
from caseweave.runtime import materialize

# What is not text, what ends a line, and what is left of markup.  The patterns read alike in Python and RE2.
DROPPED = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BREAK = (r"(?i)</?(?:html|head|title|body|header|footer|nav|main|section|article|aside|div|p|br|hr|ul|ol|li|dl|dt|dd"
         r"|table|tr|td|th|h[1-6]|form|pre|blockquote)\b[^>]*>")
TAG = r"<[^>]*>"


def html_lines(html: str | None) -> list[str]:
    """Non-empty lines of visible text, trimmed; entities stay as they are."""
    text = re.sub(TAG, "", re.sub(BREAK, "\n", re.sub(DROPPED, "", html or "")))
    return [s for s in (line.strip(SPACES.decode()) for line in text.split("\n")) if s]


def page_lines(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, host, lines)`` of every page."""
    picked = pages.select(F.col(id_col).alias("id"), host_path(F.col(url_col))[0].alias("host"),
                          F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = [html_lines(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("host"), pa.array(lines, pa.list_(pa.string()))],
                                             names=["id", "host", "lines"])

    return picked.mapInArrow(run, f"id {dict(picked.dtypes)['id']}, host string, lines array<string>")


def drop_boilerplate(lines: DataFrame, ratio: float = 0.5, least_pages: int = 3, id_col: str = "id",
                     host_col: str = "host", lines_col: str = "lines") -> DataFrame:
    """``(id, host, n_lines, n_dropped, kept)`` per row; ``kept`` has the lines that stay, in order.

    A line goes if it occurs on more than ``ratio`` of its host's pages and on at
    least ``least_pages`` of them; all its repeats on a page go with it.  Every
    row is a page, so repeated rows count as pages of their own.  Pages without a
    host (null or odd URL) share the empty host.  Null line arrays and null lines
    count as none.  An empty table gives no rows.  Other columns are not read.

    Lines are compared by two 64-bit hashes; only hashes are shuffled.  Counts
    are summed before the shuffle, and only boilerplate lines take part in the
    join, which Spark splits where one host is large.
    """
    have = F.filter(F.coalesce(F.col(lines_col), F.array().cast("array<string>")), lambda x: x.isNotNull())
    pages = materialize(lines.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col), F.lit("")).alias("host"),
                                     have.alias("lines"), F.monotonically_increasing_id().alias("row")))
    key = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b")))
    keyed = pages.select("row", "host", key.alias("keys"))
    on_pages = (keyed.select("host", F.explode(F.array_distinct("keys")).alias("key"))
                .groupBy("host", F.col("key.a").alias("a"), F.col("key.b").alias("b")).agg(F.count("*").alias("n")))
    hosts = keyed.groupBy("host").agg(F.count("*").alias("pages"))
    bad = materialize(on_pages.filter(F.col("n") >= least_pages).join(hosts, "host")
                      .filter(F.col("n") > F.col("pages") * ratio).select("host", "a", "b"))
    placed = (keyed.select("row", "host", F.posexplode("keys").alias("at", "key"))
              .select("row", "at", "host", F.col("key.a").alias("a"), F.col("key.b").alias("b")))
    gone = (placed.join(bad, ["host", "a", "b"], "left_semi")
            .groupBy("row").agg(F.collect_list("at").alias("gone")))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x, i: ~F.array_contains("gone", i)))
    return (pages.join(gone, "row", "left")
            .select(F.col("id").alias(id_col), F.col("host").alias(host_col), F.size("lines").alias("n_lines"),
                    F.coalesce(F.size("gone"), F.lit(0)).alias("n_dropped"), kept.alias("kept")))
