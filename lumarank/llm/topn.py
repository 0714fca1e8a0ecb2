"""Top N items within every group, by partition lower bounds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumarank.runtime import cut

#: Rows a partition keeps before it hands its survivors on; a memory bound, not a result bound.
FLUSH_ROWS = 200_000
#: Groups up to which the table of bounds is broadcast; beyond, it is joined over the ranking's own partitioning.
BROADCAST_ROWS = 100_000


def _best(pdf: pd.DataFrame, n: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["g", "s", "i"], ascending=[True, False, True], kind="mergesort")
    pdf["r"] = pdf.groupby("g", sort=False).cumcount() + 1
    return pdf[pdf["r"] <= n]


def _local_survivors(n: int):
    """Each partition's own top N of every group it sees, with the local rank.

    The row of local rank N is the partition's N-th best, a valid lower bound of the group's.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf if kept is None else pd.concat([kept[["g", "i", "s"]], pdf], ignore_index=True)
            kept = _best(pdf, n)
            if len(kept) > FLUSH_ROWS:
                yield kept
                kept = None
        if kept is not None and len(kept):
            yield kept

    return run


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int = 5) -> DataFrame:
    """The ``n`` highest-scoring items of every group as ``(group, item, score, rank)``.

    Order: score descending, then item ascending by code point; equal (score, item) rows are
    one item each and stay apart. Every partition reduces each group to its local top N before
    any shuffle; the local N-th best scores are lower bounds, and the greatest of a group is
    joined to the survivors and filters them. Only groups that fill N places in two partitions or
    more have a bound that can filter; while they are few enough to broadcast, the survivors are
    filtered before they are exchanged, so that a group that fills its places in P partitions sends
    little more than N rows instead of N * P. What is left is ranked.

    Rows with a null group, a null item, or a null or NaN score take no part; an empty input
    gives an empty result. Other columns, whatever their names, are ignored.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType(
        [T.StructField("g", fields[group]), T.StructField("i", fields[item]), T.StructField("s", T.DoubleType()), T.StructField("r", T.LongType())]
    )
    rows = df.select(F.col(f"`{group}`").alias("g"), F.col(f"`{item}`").alias("i"), F.col(f"`{score}`").cast("double").alias("s"))
    rows = rows.filter(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
    survivors = cut(rows.mapInPandas(_local_survivors(n), schema))  # at most n rows of a group and partition
    bounds = survivors.filter(F.col("r") == n).groupBy("g").agg(F.max("s").alias("bound"), F.count("*").alias("full")).filter("full > 1").select("g", "bound")
    bounds = F.broadcast(bounds) if bounds.count() <= BROADCAST_ROWS else bounds.hint("merge")
    left = survivors.join(bounds, "g", "left").filter(F.col("bound").isNull() | (F.col("s") >= F.col("bound")))
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("s"), F.asc("i")))).filter(F.col("rank") <= n)
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")
