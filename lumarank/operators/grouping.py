"""Bursts: islands of capture time and their merging."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumarank.functions.identity import hamming
from lumarank.functions.scoring import cosine

#: Islands without a time that one window holds.
ISLANDS = 100_000


def seconds_between(early: Column, late: Column) -> Column:
    """Elapsed seconds with their fraction."""
    return (F.unix_micros(late.cast("timestamp")) - F.unix_micros(early.cast("timestamp"))) / 1e6


def time_islands(df: DataFrame, time: str, order: str, gap_seconds: float, partition: Sequence[str] = ()) -> DataFrame:
    """Adds ``island``: a new one where a time is missing or more than the gap after the one before.

    Rows without a time sort last and are islands of their own. With ``partition`` (a camera,
    a folder) islands are numbered within it and windows stay distributed; without one, days
    are windows of their own and only their last and first times meet in a second, small
    window, so that no task holds the whole library.
    """
    stamp = F.col(time)
    if partition:
        w = Window.partitionBy(*partition).orderBy(stamp.asc_nulls_last(), order)
        before = F.lag(stamp).over(w)
        fresh = before.isNull() | stamp.isNull() | (seconds_between(before, stamp) > gap_seconds)
        return df.withColumn("island", F.sum(F.when(fresh, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    days = df.withColumn("__day", F.to_date(stamp)).withColumn("__tie", F.when(stamp.isNull(), F.pmod(F.xxhash64(order), F.lit(64))).otherwise(0))
    w = Window.partitionBy("__day", "__tie").orderBy(stamp, order)
    before = F.lag(stamp).over(w)
    fresh = before.isNull() | stamp.isNull() | (seconds_between(before, stamp) > gap_seconds)
    local = days.withColumn("__local", F.sum(F.when(fresh, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per_day = local.groupBy("__day", "__tie").agg(F.min(stamp).alias("a"), F.max(stamp).alias("b"), F.max("__local").alias("n"))
    chain = Window.orderBy(F.col("__day").asc_nulls_last(), "__tie")  # one row per day
    joined = F.coalesce(seconds_between(F.lag("b").over(chain), F.col("a")) <= gap_seconds, F.lit(False))
    steps = per_day.withColumn("__n", F.col("n") - joined.cast("int")).withColumn("__shift", joined.cast("int"))
    starts = steps.withColumn("__start", F.sum("__n").over(chain.rowsBetween(Window.unboundedPreceding, -1)))
    starts = starts.select(F.col("__day").alias("d"), F.col("__tie").alias("t"), (F.coalesce("__start", F.lit(0)) - F.col("__shift")).alias("__start"))
    out = local.join(starts, local["__day"].eqNullSafe(starts["d"]) & (local["__tie"] == starts["t"]))
    return out.withColumn("island", F.col("__local") + F.col("__start")).drop("d", "t", "__day", "__tie", "__local", "__start")


def island_edges(df: DataFrame, time: str, order: str, carry: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """First and last row of each island as structs: the only rows that hashes or vectors are needed of."""
    row = F.struct(F.col(time).alias("time"), F.col(order).alias("item"), *[F.col(c) for c in carry])
    key = F.struct(F.col(time), F.col(order))
    return df.groupBy(*partition, "island").agg(F.min_by(row, key).alias("first"), F.max_by(row, key).alias("last"), F.count("*").alias("members"))


def merged_islands(edges: DataFrame, same: Column, partition: Sequence[str] = (), max_gap_seconds: float = 600.0) -> DataFrame:
    """Adds ``group_seq`` to island edges: neighbours merge within the gap where ``same`` holds.

    ``same`` compares ``prev`` (the last row of the island before) with ``first``. Islands
    without a time never merge. With ``partition`` windows run within it; without one, days are
    windows of their own (islands without a time, which come last, pieces of ISLANDS), and only one
    row of each meets in a second window that chains them.
    """
    near = lambda: F.coalesce((seconds_between(F.col("prev.time"), F.col("first.time")) <= max_gap_seconds) & same, F.lit(False))
    if partition:
        w = Window.partitionBy(*partition).orderBy("island")
        rows = edges.withColumn("prev", F.lag("last").over(w)).withColumn("__new", F.when(near(), 0).otherwise(1))
        return rows.withColumn("group_seq", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new", "prev")
    rows = edges.withColumn("__day", F.coalesce(F.to_date("first.time").cast("string"), F.concat(F.lit("none "), (F.col("island") / ISLANDS).cast("bigint"))))
    w, chain = Window.partitionBy("__day").orderBy("island"), Window.orderBy("__lo")
    days = rows.groupBy("__day").agg(F.min("island").alias("__lo"), F.max_by("last", "island").alias("__last"))
    before = days.select(F.col("__day").alias("__d"), F.lag("__last").over(chain).alias("__before"), F.col("__lo"))
    rows = rows.withColumn("prev", F.lag("last").over(w)).join(before, F.col("__day") == F.col("__d"))
    rows = rows.withColumn("prev", F.coalesce("prev", "__before")).withColumn("__new", F.when(near(), 0).otherwise(1))
    counts = rows.groupBy("__day", "__lo").agg(F.sum("__new").alias("n"))
    shift = F.coalesce(F.sum("n").over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("__day").alias("__c"), shift.alias("__shift"))
    local = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("group_seq", local).join(counts, F.col("__day") == F.col("__c")).withColumn("group_seq", F.col("group_seq") + F.col("__shift"))
    return out.drop("__new", "prev", "__day", "__d", "__before", "__lo", "__c", "__shift")


def similar_edges(hash_column: str | None = None, vector_column: str | None = None, max_bits: int = 10, min_cosine: float = 0.9) -> Column:
    """Whether the edges of neighbouring islands look alike: by hash, else by vector."""
    out = F.lit(False)
    if hash_column:
        out = out | F.coalesce(hamming(F.col(f"prev.{hash_column}"), F.col(f"first.{hash_column}")) <= max_bits, F.lit(False))
    if vector_column:
        out = out | F.coalesce(cosine(F.col(f"prev.{vector_column}"), F.col(f"first.{vector_column}")) >= min_cosine, F.lit(False))
    return out


def named_groups(df: DataFrame, group: Sequence[str], path: str) -> DataFrame:
    """``(group..., group_id, members)`` with the name derived from the sorted members.

    The digest runs over the members in their order, batch by batch, so that a group of any size
    is never gathered. Rows of a null path count as members but not for the name.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([*[T.StructField(g, fields[g]) for g in group], T.StructField("group_id", T.StringType()), T.StructField("members", T.LongType())])

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, hashed, known, members = None, None, 0, 0
        done: list[tuple] = []
        for pdf in batches:
            paths = pdf["__path"].to_numpy()
            keys = list(pdf[list(group)].itertuples(index=False, name=None))
            same = [tuple(None if x != x else x for x in k) for k in keys]  # missing numbers arrive as NaN
            start = 0
            for i in range(1, len(same) + 1):
                if i < len(same) and same[i] == same[start]:
                    continue
                if at != same[start] or hashed is None:
                    if hashed is not None:
                        done.append((*at, "group_" + hashed.hexdigest()[:16], members))
                    at, hashed, known, members = same[start], hashlib.sha256(), 0, 0
                own = [p for p in paths[start:i] if p is not None]
                if own:
                    hashed.update((("\x00" if known else "") + "\x00".join(own)).encode("utf-8"))
                known, members, start = known + len(own), members + i - start, i
            if done:
                yield pd.DataFrame(done, columns=schema.names)
                done = []
        if hashed is not None:
            yield pd.DataFrame([(*at, "group_" + hashed.hexdigest()[:16], members)], columns=schema.names)

    rows = df.select(*group, F.col(path).alias("__path"))
    return rows.repartition(*group).sortWithinPartitions(*group, "__path").mapInPandas(digest, schema)
