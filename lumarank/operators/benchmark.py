"""Metrics of benchmark runs and model attempts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def share(numerator: Column, denominator: Column) -> Column:
    """A ratio; null where the denominator is 0."""
    return numerator / F.nullif(denominator, F.lit(0))


def clean_attempts(attempts: DataFrame) -> DataFrame:
    """Attempts once each, the model normalised, latency null unless finite and above 0."""
    value = F.col("latency_ms")
    rows = attempts.filter(F.col("attempt_id").isNotNull()).dropDuplicates(["attempt_id"])
    return rows.withColumn("model", F.lower(F.trim("model"))).withColumn("latency_ms", F.when((value > 0) & (value < float("inf")), value))


def summary_of_attempts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Success rates, mean latency and quality, and the first three failures in order of id."""
    failed = F.when(~F.col("schema_success"), F.struct("attempt_id", "error"))
    # the smallest three by aggregation of bounded arrays would need a custom buffer: failures are
    # ranked first and only three rows per key are gathered
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("attempt_id"))
    few = rows.filter(failed.isNotNull()).select(*keys, "attempt_id", F.coalesce("error", F.lit("")).alias("error")).withColumn("k", rank).filter(F.col("k") <= 3)
    examples = few.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "error"))), lambda x: x["error"]), "; ").alias("failures"))
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("attempts"),
        F.avg(F.col("json_success").cast("double")).alias("json_rate"),
        F.avg(F.col("schema_success").cast("double")).alias("schema_rate"),
        F.avg("latency_ms").alias("mean_latency_ms"),
        F.avg("quality.average").alias("mean_quality"),
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & sums[k].eqNullSafe(examples[k])
    return sums.join(examples, condition, "left").select(*[sums[k] for k in keys], "attempts", "json_rate", "schema_rate", "mean_latency_ms", "mean_quality", "failures")


def nearest_in_blocks(rows: DataFrame, item: str, vector: str, group: str, block_rows: int = 4096, other_groups: bool = False) -> DataFrame:
    """``(item, group, neighbour, neighbour_group, cos)``: the most similar other item of every item.

    Exact: the collection is cut into blocks and every pair of blocks is one task's matrix
    product, so that nothing is held whole; each task keeps one candidate per item. Equal
    similarities (to nine decimals) go to the smaller item. With ``other_groups`` only items of
    another group count. For millions of vectors use an
    index instead; this is the check of one.
    """
    total = rows.count()
    blocks = max(1, -(-total // block_rows))
    cut = rows.select(F.col(item).cast("long").alias("i"), F.col(group).cast("string").alias("g"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(item), F.lit(blocks)).cast("int").alias("b"))
    spots = F.expr(f"concat(transform(sequence(0, {blocks - 1}), x -> struct(b as qb, x as db, true as q, x = b as d)), transform(filter(sequence(0, {blocks - 1}), x -> x <> b), x -> struct(x as qb, b as db, false as q, true as d)))")

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        q, d = pdf[pdf["q"]], pdf[pdf["d"]]
        if not len(q) or not len(d):
            return pd.DataFrame({"i": [], "n": [], "ng": [], "cos": []})
        unit = lambda s: (m := np.stack(s.to_list())) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        cos = np.round(unit(q["v"]) @ unit(d["v"]).T, 9)
        cos[q["i"].to_numpy()[:, None] == d["i"].to_numpy()[None, :]] = -9
        if other_groups:
            cos[q["g"].to_numpy()[:, None] == d["g"].to_numpy()[None, :]] = -9
        at = cos.argmax(axis=1)
        out = pd.DataFrame({"i": q["i"].to_numpy(), "n": d["i"].to_numpy()[at], "ng": d["g"].to_numpy()[at], "cos": cos[np.arange(len(q)), at]})
        return out[out["cos"] > -9]

    pairs = cut.select("i", "g", "v", F.explode(spots).alias("s")).select("i", "g", "v", "s.*")
    found = pairs.groupBy("qb", "db").applyInPandas(best, "i long, n long, ng string, cos double")
    top = found.groupBy("i").agg(F.min(F.struct((-F.col("cos")).alias("c"), F.col("n").alias("n"), F.col("ng").alias("ng"))).alias("t"))
    return top.join(cut.select("i", "g"), "i").select(F.col("i").alias(item), F.col("g").alias(group), F.col("t.n").alias("neighbour"), F.col("t.ng").alias("neighbour_group"), (-F.col("t.c")).alias("cos"))


def parameter_grid(spark: SparkSession, values: dict[str, Sequence]) -> DataFrame:
    """All combinations of stated parameter values, generated from one row without a join."""
    grid = spark.range(1, numPartitions=1)
    for name, options in values.items():
        kind = "string" if isinstance(options[0], str) else ("double" if any(isinstance(o, float) for o in options) else "bigint")
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(o).cast(kind) for o in options])))
    return grid.drop("id")


def deduplicated_timings(rows: DataFrame, run: str, stages: Sequence[str], compile_stage: str) -> DataFrame:
    """Sums of stage seconds with each inference run counted once, and the greatest compile time."""
    per_run = rows.filter(F.col(run).isNotNull()).groupBy(run).agg(*[F.min(s).alias(s) for s in stages], F.max(compile_stage).alias(compile_stage))
    return per_run.agg(F.count("*").alias("runs"), *[F.sum(s).alias(s) for s in stages], F.max(compile_stage).alias(compile_stage))


def common_or_mixed(column: Column) -> Column:
    """The value if all rows of a group share it, else ``mixed``."""
    return F.when(F.min(column) == F.max(column), F.min(column)).otherwise("mixed")
