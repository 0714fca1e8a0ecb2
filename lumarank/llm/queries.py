"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumarank.llm import bpe, packing, phash, quantiles, spam, splits, topn, vectors
from lumarank.runtime import latest, strip_blanks, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@_query("p1_found")
def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return vectors.neighbour_pairs(table(spark, root, "embedding_cache"), table(spark, root, "embedding_models"))


@_query("p1_recall")
def p1_recall(spark: SparkSession, root: str) -> DataFrame:
    return vectors.neighbour_recall(table(spark, root, "embedding_cache"), table(spark, root, "embedding_models"))


_HASHES = r"""
WITH cur AS (SELECT DISTINCT file_path, phash FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY mtime_ns DESC NULLS LAST, phash DESC NULLS LAST) AS r
             FROM visual_hash_cache WHERE file_path IS NOT NULL) WHERE r = 1),
bare AS (SELECT file_path, regexp_replace(regexp_replace(regexp_replace(lower(phash), '[\s\x{00a0}\x{3000}]+', '', 'g'), '^(0x|\\x|x|#)', ''), '[:\-_.,;/|]', '', 'g') AS h FROM cur),
ok AS (SELECT file_path, CAST('0x' || h AS UBIGINT) AS h FROM bare WHERE regexp_full_match(h, '[0-9a-f]{16}'))
"""


@_query("p2_found", _HASHES + "SELECT a.file_path AS path_a, b.file_path AS path_b FROM ok a JOIN ok b ON a.file_path < b.file_path AND bit_count(xor(a.h, b.h)) <= 5")
def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return phash.near_files(table(spark, root, "visual_hash_cache"))


@_query(
    "p2_classes",
    _HASHES
    + """, cls AS (SELECT h, min(file_path) AS class_id, count(*) AS copies FROM ok GROUP BY h),
near AS (SELECT a.h, count(*) AS links FROM cls a JOIN cls b ON a.h <> b.h AND bit_count(xor(a.h, b.h)) <= 5 GROUP BY a.h)
SELECT ok.file_path, cls.class_id, cls.copies, coalesce(near.links, 0) AS links FROM ok JOIN cls USING (h) LEFT JOIN near USING (h)""",
)
def p2_classes(spark: SparkSession, root: str) -> DataFrame:
    return phash.file_classes(table(spark, root, "visual_hash_cache"))


_LABELS = r"""
WITH norm AS (SELECT label_id, source, lower(regexp_replace(split, '^[\s\x{00a0}\x{3000}]+|[\s\x{00a0}\x{3000}]+$', '', 'g')) AS split,
  lower(regexp_replace(target, '^[\s\x{00a0}\x{3000}]+|[\s\x{00a0}\x{3000}]+$', '', 'g')) AS target,
  lower(replace(regexp_replace(path, '^[\s\x{00a0}\x{3000}]+|[\s\x{00a0}\x{3000}]+$', '', 'g'), '\', '/')) AS p FROM aesthetic_labels),
rec AS (SELECT DISTINCT label_id, split, source, concat(regexp_extract(p, '^(?:.*_(s[a-z0-9]{5})/|.*/(s[a-z0-9]{5})[_\- ]|.*(s[a-z0-9]{5})/)', 1),
  regexp_extract(p, '^(?:.*_(s[a-z0-9]{5})/|.*/(s[a-z0-9]{5})[_\- ]|.*(s[a-z0-9]{5})/)', 2), regexp_extract(p, '^(?:.*_(s[a-z0-9]{5})/|.*/(s[a-z0-9]{5})[_\- ]|.*(s[a-z0-9]{5})/)', 3), '/',
  regexp_extract(p, '^(?:.*/)?(?:s[a-z0-9]{5}[_\- ])?[^/]*?([a-z][a-z0-9]{0,4}?)[_\-]?([0-9]{4,})[^/]*$', 1), ':',
  ltrim(regexp_extract(p, '^(?:.*/)?(?:s[a-z0-9]{5}[_\- ])?[^/]*?([a-z][a-z0-9]{0,4}?)[_\-]?([0-9]{4,})[^/]*$', 2), '0'), '#', target) AS record
  FROM norm WHERE split IN ('train', 'holdout') AND target <> '' AND label_id IS NOT NULL AND p IS NOT NULL),
ok AS (SELECT * FROM rec WHERE regexp_matches(record, '^[^/#]+/[^/:#]+:[^/#]*#'))
"""


@_query("p3_found", _LABELS + "SELECT DISTINCT least(a.label_id, b.label_id) AS label_a, greatest(a.label_id, b.label_id) AS label_b FROM ok a JOIN ok b USING (record) WHERE a.split = 'train' AND b.split = 'holdout'")
def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return splits.overlap_pairs(table(spark, root, "aesthetic_labels"))


@_query("p3_report", _LABELS + "SELECT a.split, a.source, count(*) AS labels FROM ok a WHERE EXISTS (SELECT 1 FROM ok b WHERE b.record = a.record AND b.split <> a.split) GROUP BY a.split, a.source")
def p3_report(spark: SparkSession, root: str) -> DataFrame:
    return splits.overlap_report(table(spark, root, "aesthetic_labels"))


@_query(
    "p4_found",
    r"""WITH cur AS (SELECT file_path, lower(regexp_replace(group_id, '^[\s\x{00a0}\x{3000}]+|[\s\x{00a0}\x{3000}]+$', '', 'g')) AS group_id, total_score,
  row_number() OVER (PARTITION BY file_path ORDER BY processed_at DESC NULLS LAST, lower(regexp_replace(group_id, '^[\s\x{00a0}\x{3000}]+|[\s\x{00a0}\x{3000}]+$', '', 'g')) DESC NULLS LAST, total_score DESC NULLS LAST) AS r
  FROM processed WHERE file_path IS NOT NULL)
SELECT group_id, file_path FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY total_score DESC, file_path) AS k FROM cur
  WHERE r = 1 AND group_id <> '' AND total_score >= 0 AND total_score <= 10) WHERE k <= 5""",
)
def p4_found(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "processed", ["file_path", "group_id", "total_score", "processed_at"]).filter(F.col("file_path").isNotNull())
    rows = rows.withColumn("group_id", F.lower(strip_blanks(F.col("group_id"))))
    rows = latest(rows, ["file_path"], [F.col("processed_at")], ["group_id", "total_score"])
    rows = rows.filter((F.col("group_id") != "") & F.col("total_score").between(0, 10))
    return topn.top_n_per_group(rows, "group_id", "file_path", "total_score", 5).select("group_id", "file_path")


_QS, _NAMES = (0.5, 0.9, 0.95, 0.99), ("p50", "p90", "p95", "p99")


@_query("p5_percentiles")
def p5_percentiles(spark: SparkSession, root: str) -> DataFrame:
    daily = quantiles.daily_latency_sketches(table(spark, root, "attempts", ["attempt_id", "model", "task", "recorded_at", "latency_ms"]))
    return quantiles.sketch_quantiles(quantiles.merge_sketches(daily, ["model", "task"]), _QS, _NAMES)


@_query(
    "p5_within_error",
    r"""WITH once AS (SELECT attempt_id, min({'l': latency_ms, 'm': lower(regexp_replace(model, '^[\s\x{00a0}\x{3000}]+|[\s\x{00a0}\x{3000}]+$', '', 'g')), 't': task}) AS x
  FROM attempts WHERE latency_ms > 0 AND isfinite(latency_ms) AND attempt_id IS NOT NULL GROUP BY attempt_id)
SELECT x.m AS model, x.t AS task, count(*) AS n, true AS within FROM once GROUP BY x.m, x.t""",
)
def p5_within_error(spark: SparkSession, root: str) -> DataFrame:
    """Whether the exact ranks of all percentiles of p5_percentiles are within the stated error."""
    attempts = table(spark, root, "attempts", ["attempt_id", "model", "task", "recorded_at", "latency_ms"])
    rows, got = quantiles.attempt_latencies(attempts), p5_percentiles(spark, root)
    joined = rows.join(got.withColumnRenamed("model", "m").withColumnRenamed("task", "t"), F.col("model").eqNullSafe(F.col("m")) & F.col("task").eqNullSafe(F.col("t")))
    counts = [F.count_if(F.col("latency_ms") < F.col(n)).alias(f"lt_{n}") for n in _NAMES] + [F.count_if(F.col("latency_ms") <= F.col(n)).alias(f"le_{n}") for n in _NAMES]
    ranks = joined.groupBy("model", "task").agg(F.count("*").alias("n"), *counts)
    good = F.lit(True)
    for q, name in zip(_QS, _NAMES):
        want = F.greatest(F.lit(1), F.ceil(F.col("n") * q - 1e-9))
        off = F.greatest(F.col(f"lt_{name}") + 1 - want, want - F.col(f"le_{name}"), F.lit(0))
        good = good & (off <= F.lit(quantiles.EPSILON) * (F.col("n") - want) + 1)
    return ranks.select("model", "task", "n", good.alias("within"))


@_query("p6_ids")
def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return bpe.encode_column(table(spark, root, "documents"), "doc_id", "text")


@_query("p7_packing")
def p7_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack_documents(table(spark, root, "documents"), table(spark, root, "prompt_windows"))


@_query("p7_summary")
def p7_summary(spark: SparkSession, root: str) -> DataFrame:
    return packing.packing_summary(p7_packing(spark, root), packing.window_capacity(table(spark, root, "prompt_windows")))


@_query("p8_found")
def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return spam.spam_documents(table(spark, root, "documents", ["doc_id", "text", "source"]))
