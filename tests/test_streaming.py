import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from lumarank.operators.labels import calibration_fit
from lumarank.streaming import progress as P


def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


def test_burst_stream_equals_batch(spark, sf, tmp_path):
    src = tmp_path / "in"
    events(spark, sf).select("user_id", F.col("ts").cast("timestamp").alias("ts")).repartition(3).write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    stream = P.burst_stream(P.file_stream(spark, str(src), schema, 1), "ts", ["user_id"], "30 minutes", "60 days")
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = P.burst_stream(spark.read.parquet(str(src)), "ts", ["user_id"], "30 minutes", "60 days")
    done = spark.table("bursts").count()
    assert 0 <= done <= batch.count()
    assert batch.agg(F.sum("members")).first()[0] == events(spark, sf).count()


def test_event_sessions_are_held_by_files(spark, sf):
    sessions = E.QUERIES["event_sessions_stream"](spark, sf)
    assert sessions.inputFiles()  # a table of the memory sink has none: its rows are the driver's
    assert sessions.agg(F.sum("members")).first()[0] == 1000


@pytest.mark.parametrize("files", [1, 3])
def test_event_sessions_keep_every_row(spark, tmp_path, files):
    """A table of one file or several; half an hour joins, a microsecond more doesn't; times missing or before 1970."""
    noon, half, old = datetime(2024, 1, 1, 12), timedelta(minutes=30), datetime(1969, 12, 31)
    late = noon + 2 * half + timedelta(microseconds=1)
    rows = [(1, noon, 1), (2, noon + half, 1), (3, late, 1), (4, None, 1), (5, None, 1), (5, None, 1), (6, None, None), (7, noon, None), (8, old, 2)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint").repartition(files)
    df.write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(map(tuple, E.QUERIES["event_sessions_stream"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(1, noon, noon + half, 2), (1, late, late, 1), *[(1, None, None, 1)] * 3, (None, None, None, 1), (None, noon, noon, 1), (2, old, old, 1)], key=str)


def test_run_to_files_over_many_batches(spark, sf, tmp_path):
    src = tmp_path / "in"
    events(spark, sf).withColumn("ts", F.when(F.col("event_id") % 10 > 0, F.col("ts"))).repartition(3).write.parquet(str(src))
    rows = spark.read.parquet(str(src))
    got = P.run_to_files(P.all_bursts(P.file_stream(spark, str(src), rows.schema, 1), "ts", "event_id", ["user_id"], "30 minutes"))
    want = P.all_bursts(rows, "ts", "event_id", ["user_id"], "30 minutes")
    assert got.agg(F.sum("members")).first()[0] == 1000
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


def test_run_to_files_without_files(spark, tmp_path):
    empty = P.file_stream(spark, str(tmp_path), spark.createDataFrame([], "id bigint, at timestamp_ntz").schema)
    assert P.run_to_files(P.all_bursts(empty, "at", "id", ["id"], "1 hour")).collect() == []


def test_progress_stream(spark, sf, tmp_path):
    src = tmp_path / "in"
    events(spark, sf).repartition(2).write.parquet(str(src))
    stream = P.progress(P.file_stream(spark, str(src), spark.read.parquet(str(src)).schema, 1))
    q = stream.writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("progress").exceptAll(P.progress(events(spark, sf))).count() == 0


def test_windows(spark, sf):
    rows = P.rate_windows(events(spark, sf), "ts", "1 day", None, "1 day", ["event_type"])
    assert rows.agg(F.sum("n")).first()[0] == 1000
    assert P.rate_windows(events(spark, sf), "ts", "2 days", "1 day", "1 day").agg(F.sum("n")).first()[0] == 2000


def test_incremental_sink(spark, tmp_path):
    src, state, check = tmp_path / "in", tmp_path / "state", tmp_path / "check"
    schema = "file_path string, mtime_ns bigint"
    spark.createDataFrame([("a", 1), ("b", None), ("a", 1)], schema).write.parquet(str(src))
    stype = spark.read.parquet(str(src)).schema

    def run():
        q = P.incremental_sink(P.file_stream(spark, str(src), stype), str(state), ["file_path", "mtime_ns"], str(check))
        q.awaitTermination(120)
        return sorted((r.file_path, r.mtime_ns) for r in spark.read.option("recursiveFileLookup", "true").parquet(str(state)).collect())

    assert run() == [("a", 1), ("b", None)] or len(run()) == 2
    spark.createDataFrame([("b", None), ("a", 2)], schema).write.mode("append").parquet(str(src))
    assert len(run()) == 3


def test_calibration_fit(spark):
    xs = [3 + i * 5.5 / 29 for i in range(30)]
    df = spark.createDataFrame([("t", x, 5.5 + 1.2 * (x - 5.5) + 0.4) for x in xs] + [("few", 5.0, 6.0)], "target string, raw_score double, human double")
    got = {r.target: r for r in calibration_fit(df, ["target"]).collect()}
    t = got["t"]
    assert round(t.scale, 6) == 1.2 and round(t.offset, 6) == 0.4 and t.rmse_after < 1e-9 and t.status == "fitted"
    assert got["few"].status == "insufficient_labels"
    assert json.dumps(t.status)
