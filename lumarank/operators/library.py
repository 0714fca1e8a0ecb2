"""Listing and summary of a photo library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumarank.functions.text import substring_search

#: Orders of a listing by name; unknown names list by path.
ORDERS = {
    "path": lambda: [F.col("file_path").asc()],
    "newest": lambda: [F.col("mtime_ns").desc_nulls_last(), F.col("file_path").asc()],
    "score_desc": lambda: [F.col("total_score").desc_nulls_last(), F.col("file_path").asc()],
    "score_asc": lambda: [F.col("total_score").asc_nulls_last(), F.col("file_path").asc()],
}


def with_scores(index: DataFrame, scores: DataFrame) -> DataFrame:
    """All indexed files with the latest score of each, if any."""
    return index.join(scores, "file_path", "left")


def matching(items: DataFrame, search: str = "", scene: str = "", decision: str = "", scored: str = "") -> DataFrame:
    """Items that satisfy all given conditions; empty ones ask for nothing."""
    where: list[Column] = [substring_search(F.col("file_path"), search)]
    if scene:
        where.append(F.coalesce("scene_key", F.lit("")) == scene)
    if decision:
        where.append(F.coalesce("decision", F.lit("")) == decision)
    if scored in ("yes", "no"):
        where.append(F.col("total_score").isNotNull() if scored == "yes" else F.col("total_score").isNull())
    out = items
    for condition in where:
        out = out.filter(condition)
    return out


def order_of(name: str) -> Sequence[Column]:
    return ORDERS.get(name, ORDERS["path"])()


def summary(items: DataFrame) -> DataFrame:
    """One row: indexed files, scored ones, records, errors and the mean score."""
    return items.agg(
        F.count("*").alias("indexed"), F.count("total_score").alias("scored"), F.count("status").alias("records"), F.count_if(F.col("status") == "error").alias("errors"), F.avg("total_score").alias("average_score")
    )


def suggestions(rows: DataFrame, suggest: Column, min_count: int, limit: int) -> DataFrame:
    """Frequent free texts with a suggestion; the limit holds for the texts before those without one leave."""
    counts = rows.groupBy("raw").agg(F.count("*").alias("photos")).filter(F.col("photos") >= min_count)
    return counts.orderBy(F.desc("photos"), "raw").limit(limit).withColumn("suggestion", suggest).filter(F.col("suggestion").isNotNull())
