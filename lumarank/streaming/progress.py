"""Structured Streaming forms of the incremental operations."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lumarank.runtime import ensure_checkpoint_dir

#: State that grows with the input, kept on the executors' disks and not in their heaps.
STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
}


def progress(events: DataFrame) -> DataFrame:
    """Counters per job from an event log; works on batches and, in update mode, on streams."""
    kind = F.col("event_type")
    return events.groupBy("user_id").agg(
        F.count_if(kind == "view").alias("started"), F.count_if(kind == "purchase").alias("done"), F.count_if(kind == "error").alias("failed"), F.max("ts").alias("last_seen")
    )


def file_stream(spark: SparkSession, path: str, schema: StructType, per_batch: int = 100, glob: str = "*.parquet") -> DataFrame:
    """Files that arrive in a folder, at most ``per_batch`` per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", glob).parquet(path)


def _instants(events: DataFrame, time: str) -> tuple[DataFrame, str]:
    """Events with ``time`` as an instant, which watermarks need, and the type to give back."""
    kind = events.schema[time].dataType.simpleString()
    return events.withColumn(time, F.col(time).cast("timestamp")), kind


def burst_stream(events: DataFrame, time: str, keys: Sequence[str], gap: str, late: str) -> DataFrame:
    """Bursts that a gap of more than ``gap`` closes, emitted once no later row within ``late`` can join."""
    rows, kind = _instants(events, time)
    out = rows.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap)).agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count("*").alias("members"))
    return out.select(*keys, F.col("started").cast(kind).alias("started"), F.col("ended").cast(kind).alias("ended"), "members")


def all_bursts(events: DataFrame, time: str, order: str, keys: Sequence[str], gap: str) -> DataFrame:
    """Bursts as ``burst_stream`` has them, of all rows however old, for complete mode.

    No watermark drops a row, and times stay as they are. Rows without a time are bursts of their
    own, as in ``time_islands``; they are told apart by ``order``, and those that agree in it are
    counted as one and repeated. A window begins at its first time and ends ``gap`` (a fixed
    length: hours or less) after its last, so the state, which holds every burst, has no other times.
    """
    at = F.coalesce(F.col(time), F.lit("1970-01-01").cast(events.schema[time].dataType))
    lone = F.when(F.col(time).isNull(), F.struct(order))
    out = events.groupBy(*keys, lone.alias("__lone"), F.session_window(at, gap).alias("__span")).agg(F.count("*").alias("members"))
    timed, span = F.col("__lone").isNull(), F.col("__span")
    each = F.when(timed, F.array("members")).otherwise(F.array_repeat(F.lit(1).cast("long"), F.col("members").cast("int")))
    return out.select(*keys, F.when(timed, span["start"]).alias("started"), F.when(timed, span["end"] - F.expr(f"INTERVAL '{gap}'")).alias("ended"), F.explode(each).alias("members"))


def rate_windows(events: DataFrame, time: str, width: str, slide: str | None, late: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts in tumbling or sliding windows with late rows admitted up to ``late``."""
    rows, kind = _instants(events, time)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    counts = rows.withWatermark(time, late).groupBy(window, *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").cast(kind).alias("start"), F.col("window.end").cast(kind).alias("end"), *keys, "n")


def only_new(batch: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a batch whose key and fingerprint aren't in the state yet (nulls compare equal)."""
    condition: Column = F.lit(True)
    for k in keys:
        condition = condition & batch[k].eqNullSafe(done[k])
    return batch.join(done, condition, "left_anti")


def incremental_sink(stream: DataFrame, state: str, keys: Sequence[str], checkpoint: str, transform=None) -> StreamingQuery:
    """Runs over what has arrived and appends rows not yet in ``state``.

    A batch that is repeated after a failure writes to the same sub-folder again, so that every
    row is kept once.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(list(keys))
        try:
            done = spark.read.option("recursiveFileLookup", "true").parquet(state)
        except Exception as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            done = None
        if done is not None:
            # rows of an earlier try of this batch don't count as done
            done = done.filter(~F.input_file_name().contains(f"/batch={number}/"))
            fresh = only_new(fresh, done.select(*keys), keys)
        out = transform(fresh) if transform else fresh
        out.write.mode("overwrite").parquet(f"{state}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a streaming aggregation over all that has arrived and returns its result.

    The result is kept by the session under a name of its own; for results of the size of an
    aggregate, as the complete mode's are.
    """
    name = f"stream_{uuid.uuid4().hex}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return stream.sparkSession.table(name)


def run_to_files(stream: DataFrame) -> DataFrame:
    """Runs a streaming aggregation over all that has arrived and returns its result from files.

    For results that grow with the input: tasks write them, and the driver holds none of their
    rows. Every batch has the whole result (complete mode) and replaces that of the batch before.
    Results stay in the shared checkpoint folder as checkpoints do; the state is dropped.
    The query has a copy of the session's settings, taken as it starts, so ``STATE_ON_DISK`` is
    set for that moment only.
    """
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream_{uuid.uuid4().hex}"
    result, state = f"{folder}/result", f"{folder}/state"
    written: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(result, compression="zstd")
        written.append(number)

    before = {k: spark.conf.get(k, None) for k in STATE_ON_DISK}
    try:
        for k, v in STATE_ON_DISK.items():
            spark.conf.set(k, v)
        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", state).outputMode("complete").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    try:
        q.awaitTermination()
    finally:
        q.stop()
        path = spark._jvm.org.apache.hadoop.fs.Path(state)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return spark.read.schema(stream.schema).parquet(result) if written else spark.createDataFrame([], stream.schema)
