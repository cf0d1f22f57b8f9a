"""One registered query per operator, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm import (decontamination, fingerprint, lexical_search, line_dedup, lm_scoring, mixing, quality, sharding, simhash,
                            spelling, substring_dedup, suffix_dedup, url_filter)
from caseweave.llm.common import table

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]
MIX_WEIGHTS = [5.0, 2.0, 1.0]
SHARDS = 24


def op1_attention_scores(spark: SparkSession, sf: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0, F.lit(True))
    return lm_scoring.score_documents(table(spark, sf, "documents"), ~held_out)


def op2_ring_shards(spark: SparkSession, sf: str) -> DataFrame:
    out = sharding.shard_rows(table(spark, sf, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op3_entropy_digests(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.edit_probe(table(spark, sf, "documents"))


def op4_rule_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op5_url_digests(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf, "pages"), rules)


def op6_host_lines(spark: SparkSession, sf: str) -> DataFrame:
    out = line_dedup.drop_boilerplate(line_dedup.page_lines(table(spark, sf, "pages")))
    return out.select(F.col("id").alias("page_id"), "host", "n_lines", "n_dropped",
                      F.array_join("kept", "\n").alias("kept_text"))


def op7_golay_simhash(spark: SparkSession, sf: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_cube_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), MIX_WEIGHTS).drop("h")


def op9_anchor_repeats(spark: SparkSession, sf: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf, "documents"), keep_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("spans").alias("n_spans"))


def op10_spaced_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op11_reversed_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical_search.rank(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op12_q_chunk_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(table(spark, sf, "documents"))


def op13_suffix_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf, "documents"), keep_bytes=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_attention_scores": op1_attention_scores,
    "op2_ring_shards": op2_ring_shards,
    "op3_entropy_digests": op3_entropy_digests,
    "op4_rule_quality": op4_rule_quality,
    "op5_url_digests": op5_url_digests,
    "op6_host_lines": op6_host_lines,
    "op7_golay_simhash": op7_golay_simhash,
    "op8_cube_mix": op8_cube_mix,
    "op9_anchor_repeats": op9_anchor_repeats,
    "op10_spaced_seeds": op10_spaced_seeds,
    "op11_reversed_search": op11_reversed_search,
    "op12_q_chunk_variants": op12_q_chunk_variants,
    "op13_suffix_repeats": op13_suffix_repeats,
}

ORACLE: dict[str, str] = {
    "op5_url_digests": r"""
WITH p AS (
  SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(rule_host, rule_path, said) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT page_id, rule_host || rule_path AS rule, said,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS k
  FROM h JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT h.page_id, host, path, rule, coalesce(said, 'allow') AS verdict
FROM h LEFT JOIN m ON m.page_id = h.page_id AND m.k = 1
""",
    "op6_host_lines": rf"""
WITH t AS (
  SELECT page_id, url,
         regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{line_dedup.DROPPED}', '', 'g'),
                                       '{line_dedup.BREAK}', chr(10), 'g'), '{line_dedup.TAG}', '', 'g') AS text
  FROM pages),
l AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '^([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         list_filter(list_transform(string_split(text, chr(10)),
                                    lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))),
                     lambda x: x <> '') AS lines
  FROM t),
e AS (SELECT DISTINCT page_id, host, unnest(lines) AS line FROM l),
c AS (SELECT host, line, count(*) AS n FROM e GROUP BY ALL),
b AS (
  SELECT c.host, list(line) AS bad FROM c JOIN (SELECT host, count(*) AS pages FROM l GROUP BY host) h USING (host)
  WHERE n >= 3 AND n > pages * 0.5 GROUP BY c.host),
k AS (
  SELECT page_id, l.host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)) AS kept
  FROM l LEFT JOIN b USING (host))
SELECT page_id, host, CAST(len(lines) AS INT) AS n_lines, CAST(len(lines) - len(kept) AS INT) AS n_dropped,
       array_to_string(kept, chr(10)) AS kept_text FROM k
""",
    "op11_reversed_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
s AS (SELECT count(*) AS all_n, CAST(sum(len(terms)) AS BIGINT) AS all_terms FROM d WHERE len(terms) > 0),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf
       FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, text AS item_text,
             unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(all_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM tf, s GROUP BY term),
sc AS (
  SELECT item_id, item_text, r, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * all_n) // all_terms)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY ALL),
k AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY item_id, item_text ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM sc WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM k WHERE rank <= 10
""",
    "op13_suffix_repeats": """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k, hex(encode(coalesce(text, ''))) AS h
  FROM documents),
pages AS (SELECT r, k, p, substr(h, 2 * p + 1, 1098) AS piece
          FROM (SELECT r, k, h, unnest(range(0, len(h) // 2 - 49, 500)) AS p FROM d)),
w AS (SELECT r, k, p + b AS a, substr(piece, 2 * b + 1, 100) AS s
      FROM (SELECT r, k, p, piece, unnest(range(least(500, len(piece) // 2 - 49))) AS b FROM pages)),
c AS (SELECT r, a FROM w JOIN (SELECT s, min(k) AS first FROM w GROUP BY s) USING (s) WHERE first < k),
i AS (SELECT r, a, sum(fresh) OVER (PARTITION BY r ORDER BY a) AS island
      FROM (SELECT r, a, CASE WHEN a <= lag(a) OVER (PARTITION BY r ORDER BY a) + 50 THEN 0 ELSE 1 END AS fresh FROM c)),
p AS (SELECT r, min(a) AS lo, max(a) + 50 AS hi FROM i GROUP BY r, island),
g AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS before FROM p),
k AS (SELECT r, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS tail,
             string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS head
      FROM g JOIN d USING (r) GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (r)
""",
}
