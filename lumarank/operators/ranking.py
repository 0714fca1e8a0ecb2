"""Ranking within groups and group-wide rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumarank.runtime import cut, parallelism

#: Rows of a group that one task orders; larger groups are spread over range partitions.
HOT_ROWS = 500_000
#: Groups up to which the table of large groups is broadcast.
BROADCAST_ROWS = 100_000


def positions(df: DataFrame, group: Sequence[str], order: Sequence[Column], position: str, size: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds the place of each row in its group (from 1, by ``order``) and, if named, the group's size.

    Groups of up to ``hot_rows`` rows are numbered by a window. The rows of a larger one are spread
    over range partitions by group and order, numbered where they lie, and moved up by the number of
    rows in the partitions before, so that no task holds a whole large group. Rows that ``order``
    leaves equal are numbered in any order. Both ways give the same numbers.
    """
    w = Window.partitionBy(*group)
    numbered = df.withColumn(position, F.row_number().over(w.orderBy(*order)))
    numbered = numbered.withColumn(size, F.count("*").over(w)) if size else numbered
    key = F.struct(*group)
    hot = df.groupBy(key.alias("__hot")).agg(F.count("*").alias("__size")).filter(F.col("__size") > hot_rows)
    found = hot.count()  # at most one in hot_rows of the rows
    if not found:
        return numbered
    flagged = df.join(F.broadcast(hot) if found <= BROADCAST_ROWS else hot.hint("merge"), key == F.col("__hot"), "left")
    cold = flagged.filter("__hot IS NULL").drop("__hot", "__size").withColumn(position, F.row_number().over(w.orderBy(*order)))
    cold = cold.withColumn(size, F.count("*").over(w)) if size else cold
    ordered = flagged.filter("__hot IS NOT NULL").repartitionByRange(parallelism(df.sparkSession), "__hot", *order).sortWithinPartitions("__hot", *order)
    ordered = cut(ordered.withColumn("__id", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__id", 33))
    pieces = ordered.groupBy("__hot", "__part").agg(F.min("__id").alias("__first"), F.count("*").alias("__rows"))  # a few rows per group
    before = F.sum("__rows").over(Window.partitionBy("__hot").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select(F.col("__hot").alias("__h"), F.col("__part").alias("__p"), "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    placed = ordered.join(pieces, (F.col("__hot") == F.col("__h")) & (F.col("__part") == F.col("__p")))
    placed = placed.withColumn(position, (F.col("__id") - F.col("__first") + F.col("__before") + 1).cast("int"))
    placed = placed.withColumn(size, F.col("__size")) if size else placed
    return cold.unionByName(placed.select(*cold.columns))


def ranked(df: DataFrame, group: Sequence[str], score: str, tie: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``rank`` (score descending, missing last, then ``tie``) and ``size`` of the group."""
    return positions(df, group, [F.desc_nulls_last(score), *map(F.asc, tie)], "rank", "size", hot_rows)


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The whole latest row of each key; one aggregation instead of a ranking of all versions."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    top = df.groupBy(*keys).agg(F.max_by(row, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("__row"))
    return top.select("__row.*")


def changed_ranks(df: DataFrame, rank: str, size: str, group: str) -> Column:
    """Whether fresh rank, size or group differ from the stored ones (nulls compare equal)."""
    return ~(F.col("rank").eqNullSafe(F.col(rank)) & F.col("size").eqNullSafe(F.col(size)) & F.col("group_key").eqNullSafe(F.col(group)))


def _marked(df: DataFrame, few: DataFrame, item: Column, mark: str) -> DataFrame:
    """``df`` with a flag on the rows whose ``item``, a struct, is in ``few``."""
    few = few.select(F.col("item").alias("__item"), F.lit(True).alias(mark))
    return df.join(few.hint("merge"), item == F.col("__item"), "left").drop("__item").withColumn(mark, F.coalesce(mark, F.lit(False)))


def best_of_group_reviewed(df: DataFrame, group: Sequence[str], score: str, tie: Sequence[str], decision: str = "decision", reasons: str = "reasons") -> DataFrame:
    """Turns the best row of a group without keeps and without reasoned rejects from reject to review.

    The best row has the greatest score (missing counts as 0), then the smallest ``tie``, which
    names a row. Groups are aggregated and only the rows to turn are joined back by their names, so a
    large group is neither sorted nor gathered.
    """
    blocked = F.bool_or((F.col(decision) == "keep") | ((F.col(decision) == "reject") & (F.size(reasons) > 0)))
    first = F.min(F.struct((-F.coalesce(F.col(score), F.lit(0.0))).alias("s"), F.struct(*tie).alias("item"), F.col(decision).alias("d")))
    best = df.groupBy(*group).agg(blocked.alias("blocked"), first.alias("first"))
    lifted = best.filter(~F.coalesce("blocked", F.lit(False)) & (F.col("first.d") == "reject")).select("first.item")
    rows = _marked(df, lifted, F.struct(*tie), "__lift")
    rows = rows.withColumn(reasons, F.when(F.col("__lift"), F.array_append(reasons, F.lit("top1_review_fallback"))).otherwise(F.col(reasons)))
    return rows.withColumn(decision, F.when(F.col("__lift"), "review").otherwise(F.col(decision))).drop("__lift")


def guarded(df: DataFrame, group: Sequence[str], score: str, tie: Sequence[str], floor: float) -> DataFrame:
    """Raises the best score of a group whose best is below ``floor`` to it: that of the smallest ``tie``, which names a row, among equals."""
    first = F.min(F.when(F.col(score).isNotNull(), F.struct((-F.col(score)).alias("s"), F.struct(*tie).alias("item"))))
    low = df.groupBy(*group).agg(first.alias("first")).filter(-F.col("first.s") < floor).select("first.item")
    rows = _marked(df, low, F.struct(*tie), "__low")
    return rows.withColumn("guarded", F.when(F.col("__low"), F.lit(float(floor))).otherwise(F.col(score))).drop("__low")


def complete_groups(df: DataFrame, group: Sequence[str], done: Column) -> DataFrame:
    """``(group..., complete)``: whether every member is done, so that the group can be skipped."""
    return df.groupBy(*group).agg(F.bool_and(F.coalesce(done, F.lit(False))).alias("complete"))


def lowest_values(values: dict[str, Column], limit: int, descending: bool = False) -> Column:
    """Names of the ``limit`` lowest (or highest) known values, ties in the given order."""
    entries = F.filter(F.array(*[F.when(v.isNotNull(), F.struct((-v if descending else v).alias("v"), F.lit(i).alias("i"), F.lit(n).alias("n"))) for i, (n, v) in enumerate(values.items())]), lambda x: x.isNotNull())
    return F.transform(F.slice(F.array_sort(entries), 1, limit), lambda x: x["n"])


def moving_pace(df: DataFrame, time: str, k: int, partition: Sequence[str] = ()) -> DataFrame:
    """Adds ``seconds_per_item`` over the last ``k`` completions, null for the first."""
    w = Window.partitionBy(*partition).orderBy(time).rowsBetween(-(k - 1), 0)
    span = (F.unix_micros(F.last(time).over(w).cast("timestamp")) - F.unix_micros(F.first(time).over(w).cast("timestamp"))) / 1e6
    n = F.count("*").over(w)
    return df.withColumn("seconds_per_item", F.when(n > 1, span / (n - 1)))


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 48) -> DataFrame:
    """One page of an ordered listing; page and size are clamped to 1..1,000,000 and 1..200."""
    number, size = max(1, min(1_000_000, number)), max(1, min(200, size))
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(total: int, size: int) -> int:
    return max(1, -(-total // size))
