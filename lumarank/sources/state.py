"""Keyed state as append-only parquet with a latest-wins view.

Every write appends versioned rows; reading keeps the latest version per key. There is no
update in place, so a write that fails or runs twice leaves the state as it was or equal.
Versions are given by the caller (a run number) or taken from the clock.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumarank.operators.ranking import latest_rows

VERSION, REMOVED = "__version", "__removed"


class StateTable:
    """A parquet folder of versions of rows with the given key."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], partition_by: Sequence[str] = ()):
        self.spark, self.path, self.key, self.partition_by = spark, path, list(key), list(partition_by)

    def _exists(self) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return system.exists(hadoop) and system.getContentSummary(hadoop).getFileCount() > 0

    def _append(self, rows: DataFrame, removed: bool, version: int | None) -> None:
        out = rows.withColumn(VERSION, F.lit(version if version is not None else time.time_ns()).cast("bigint")).withColumn(REMOVED, F.lit(removed))
        writer = out.write.mode("append")
        (writer.partitionBy(*self.partition_by) if self.partition_by else writer).parquet(self.path)

    def upsert(self, rows: DataFrame, version: int | None = None, skip_null: str | None = None) -> None:
        """Adds or replaces rows by key; rows whose ``skip_null`` column is null are left out."""
        self._append(rows.filter(F.col(skip_null).isNotNull()) if skip_null else rows, False, version)

    def remove(self, keys: DataFrame, version: int | None = None) -> None:
        """Removes rows by key."""
        self._append(keys.select(*self.key).distinct(), True, version)

    def update(self, changes: DataFrame, version: int | None = None) -> None:
        """Changes columns of existing rows by key; nulls in ``changes`` leave the old value."""
        own = self.read()
        columns = [c for c in changes.columns if c not in self.key]
        new = changes.select(*self.key, *[F.col(c).alias(f"__new_{c}") for c in columns])
        joined = own.join(new, self.key)
        self._append(joined.select(*[F.coalesce(f"__new_{c}", F.col(c)).alias(c) if c in columns else F.col(c) for c in own.columns]), False, version)

    def replace_children(self, rows: DataFrame, parent: Sequence[str], version: int | None = None) -> None:
        """Replaces all rows of the parents that occur in ``rows`` (signals of a file)."""
        version = version if version is not None else time.time_ns()
        if self._exists():
            old = self.read().join(rows.select(*parent).distinct(), list(parent), "left_semi")
            self.remove(old.join(rows.select(*self.key), self.key, "left_anti"), version)
        self.upsert(rows, version)

    def read(self) -> DataFrame:
        """The latest version of every key that isn't removed."""
        rows = self.spark.read.option("mergeSchema", "true").parquet(self.path)
        top = latest_rows(rows, self.key, [F.col(VERSION), ~F.col(REMOVED)])
        return top.filter(~F.col(REMOVED)).drop(VERSION, REMOVED)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows of the given keys."""
        on = [k for k in self.key if k in keys.columns]
        return self.read().join(keys.select(*on).distinct(), on, "left_semi")

    def clear(self) -> int:
        """Removes all rows and returns how many there were."""
        if not self._exists():
            return 0
        rows = self.read()
        n = rows.count()
        self.remove(rows)
        return n

    def compact(self, target: str) -> StateTable:
        """Writes only the latest versions to another folder."""
        out = self.read().withColumn(VERSION, F.lit(0)).withColumn(REMOVED, F.lit(False))
        out.write.mode("overwrite").parquet(target)
        return StateTable(self.spark, target, self.key, self.partition_by)


def refreshed_index(old: DataFrame, scan: DataFrame, generation: int) -> tuple[DataFrame, DataFrame]:
    """``(index, removed)`` after a scan: all scanned files in the new generation, and the files that went."""
    index = scan.withColumn("scan_generation", F.lit(generation))
    return index, old.join(scan.select("file_path"), "file_path", "left_anti")


def append_event(spark: SparkSession, path: str, events: DataFrame) -> None:
    """Appends to the event log, by day, which streams read as files arrive."""
    events.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def finished(status: str = "status") -> Column:
    """Finish time for terminal states."""
    return F.when(F.col(status).isin("completed", "failed", "cancelled"), F.current_timestamp())


def reconciled(jobs: DataFrame, active: Sequence[str] = ("pending", "running")) -> DataFrame:
    """Jobs that a crash left active, as cancelled: the rows to upsert at the next start."""
    return jobs.filter(F.col("status").isin(*active)).withColumn("status", F.lit("cancelled"))
