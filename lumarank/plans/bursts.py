"""Bursts, sessions, event logs and job roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumarank.functions.identity import hamming
from lumarank.operators import grouping as G
from lumarank.operators import ranking as R
from lumarank.plans.catalog import query
from lumarank.plans.common import rs as r
from lumarank.runtime import table
from lumarank.runtime import reported as half_up

_ISL = """WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR ts IS NULL OR epoch_us(ts) - epoch_us(before) > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts NULLS LAST, event_id ROWS UNBOUNDED PRECEDING) AS island FROM l)
"""


def islands(spark: SparkSession, root: str) -> DataFrame:
    return G.time_islands(table(spark, root, "events"), "ts", "event_id", 1800.0, ["user_id"])


@query("burst_islands", _ISL + "SELECT user_id, island, count(*) AS members, min(event_id) AS first_id, max(event_id) AS last_id FROM i GROUP BY ALL")
def burst_islands(spark: SparkSession, root: str) -> DataFrame:
    """Bursts per camera: a gap of more than half an hour begins a new one."""
    return islands(spark, root).groupBy("user_id", "island").agg(F.count("*").alias("members"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query(
    "library_bursts",
    """WITH l AS (SELECT event_id, ts, lag(ts) OVER (ORDER BY ts, event_id) AS before FROM events),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) > 600000000 THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM l)
SELECT event_id, island::BIGINT AS island FROM i""",
)
def library_bursts(spark: SparkSession, root: str) -> DataFrame:
    """Bursts over the whole library without a camera to split by: days are windows, their borders are joined."""
    rows = G.time_islands(table(spark, root, "events", ["event_id", "ts"]), "ts", "event_id", 600.0)
    return rows.select("event_id", F.col("island").cast("bigint").alias("island"))


@query(
    "burst_merge",
    _ISL
    + """, e AS (SELECT user_id, island, arg_min({'t': ts, 'v': value}, (ts, event_id)) AS first, arg_max({'t': ts, 'v': value}, (ts, event_id)) AS last, count(*) AS members FROM i GROUP BY ALL),
p AS (SELECT *, lag(last) OVER (PARTITION BY user_id ORDER BY island) AS prev FROM e),
g AS (SELECT *, sum(CASE WHEN coalesce(epoch_us(first.t) - epoch_us(prev.t) <= 14400000000 AND abs(prev.v - first.v) <= 5, false) THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY island ROWS UNBOUNDED PRECEDING) AS group_seq FROM p)
SELECT user_id, group_seq, sum(members)::BIGINT AS members, count(*) AS islands FROM g GROUP BY ALL""",
)
def burst_merge(spark: SparkSession, root: str) -> DataFrame:
    """Neighbouring bursts merged where their edges are alike and near in time."""
    edges = G.island_edges(islands(spark, root), "ts", "event_id", ["value"], ["user_id"])
    same = F.abs(F.col("prev.value") - F.col("first.value")) <= 5
    rows = G.merged_islands(edges, same, ["user_id"], 14400.0)
    return rows.groupBy("user_id", "group_seq").agg(F.sum("members").alias("members"), F.count("*").alias("islands"))


@query(
    "session_windows",
    _ISL + "SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM i GROUP BY user_id, island",
)
def session_windows(spark: SparkSession, root: str) -> DataFrame:
    """The same bursts by the built-in session window, which also runs as a stream."""
    rows = table(spark, root, "events", ["user_id", "ts"])
    return rows.groupBy("user_id", F.session_window("ts", "30 minutes 1 microsecond")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("events")).drop("session_window")


@query("latest_events", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def latest_events(spark: SparkSession, root: str) -> DataFrame:
    """The latest event of every user and type."""
    return table(spark, root, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query(
    "event_progress",
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS started, count(*) FILTER (WHERE event_type = 'purchase') AS done, count(*) FILTER (WHERE event_type = 'error') AS failed, max(ts) AS last_seen FROM events GROUP BY user_id""",
)
def event_progress(spark: SparkSession, root: str) -> DataFrame:
    """Fold of an append-only event log into counters per job."""
    from lumarank.streaming.progress import progress

    return progress(table(spark, root, "events"))


@query(
    "moving_pace",
    f"""WITH e AS (SELECT *, first_value(ts) OVER w AS a, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT event_id, {r("CASE WHEN n > 1 THEN (epoch_us(ts) - epoch_us(a)) / 1e6 / (n - 1) END", 3)} AS seconds_per_item FROM e""",
)
def moving_pace(spark: SparkSession, root: str) -> DataFrame:
    """Pace over the last ten completions."""
    return R.moving_pace(table(spark, root, "events"), "ts", 10, ["user_id"]).select("event_id", half_up(F.col("seconds_per_item"), 3).alias("seconds_per_item"))


@query(
    "job_rollup",
    f"""SELECT o_orderstatus AS status, o_orderpriority AS kind, count(DISTINCT o_orderkey) AS jobs, count(l_orderkey) AS files, count(*) FILTER (WHERE l_returnflag = 'R') AS failed, {r("sum(l_quantity)", 2)} AS amount
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def job_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Files of jobs by status; files are summed per job before the join to the jobs."""
    lines = table(spark, root, "lineitem", ["l_orderkey", "l_returnflag", "l_quantity"]).groupBy("l_orderkey").agg(
        F.count("*").alias("files"), F.count_if(F.col("l_returnflag") == "R").alias("failed"), F.sum("l_quantity").alias("amount")
    )
    jobs = table(spark, root, "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"])
    rows = jobs.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("kind")).agg(
        F.count("*").alias("jobs"), total("files").alias("files"), total("failed").alias("failed"), half_up(F.sum("amount")).alias("amount")
    )


@query("active_jobs", "SELECT c_mktsegment AS kind, count(*) AS jobs FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('O', 'P') AND c_acctbal > 0 GROUP BY ALL")
def active_jobs(spark: SparkSession, root: str) -> DataFrame:
    """Jobs of an active state whose session is active as well."""
    jobs = table(spark, root, "orders", ["o_custkey", "o_orderstatus"]).filter(F.col("o_orderstatus").isin("O", "P"))
    sessions = table(spark, root, "customer", ["c_custkey", "c_mktsegment", "c_acctbal"]).filter(F.col("c_acctbal") > 0)
    return jobs.join(sessions, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("kind")).agg(F.count("*").alias("jobs"))


@query(
    "latest_job_files",
    """SELECT l_partkey AS file, l_orderkey AS job FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate DESC, l_orderkey DESC) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE k = 1""",
)
def latest_job_files(spark: SparkSession, root: str) -> DataFrame:
    """The latest job of every file, through the join of files and jobs."""
    rows = table(spark, root, "lineitem", ["l_partkey", "l_orderkey"]).join(table(spark, root, "orders", ["o_orderkey", "o_orderdate"]), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("l_partkey").alias("file")).agg(F.max(F.struct("o_orderdate", "l_orderkey"))["l_orderkey"].alias("job"))


@query(
    "boundary_hamming",
    r"""WITH cur AS (SELECT file_path, phash, mtime_ns FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY mtime_ns DESC NULLS LAST, phash DESC NULLS LAST) AS k FROM visual_hash_cache WHERE file_path IS NOT NULL) WHERE k = 1),
b AS (SELECT file_path, regexp_replace(regexp_replace(regexp_replace(lower(phash), '[\s\x{00a0}\x{3000}]+', '', 'g'), '^(0x|\\x|x|#)', ''), '[:\-_.,;/|]', '', 'g') AS t FROM cur),
h AS (SELECT file_path, regexp_replace(file_path, '/[^/]*$', '') AS folder, CAST('0x' || t AS UBIGINT) AS v FROM b WHERE regexp_full_match(t, '[0-9a-f]{16}')),
p AS (SELECT file_path, v, lag(v) OVER (PARTITION BY folder ORDER BY file_path) AS before FROM h)
SELECT file_path, bit_count(xor(v, before))::INT AS bits FROM p WHERE before IS NOT NULL""",
)
def boundary_hamming(spark: SparkSession, root: str) -> DataFrame:
    """Differing bits of each file's hash and that of the file before it in its folder."""
    from lumarank.functions.identity import readable_hash
    from lumarank.runtime import latest

    rows = latest(table(spark, root, "visual_hash_cache").filter(F.col("file_path").isNotNull()), ["file_path"], [F.col("mtime_ns")], ["phash"])
    rows = rows.withColumn("v", readable_hash(F.col("phash"))).filter(F.col("v").isNotNull()).withColumn("folder", F.regexp_replace("file_path", "/[^/]*$", ""))
    before = F.lag("v").over(Window.partitionBy("folder").orderBy("file_path"))
    return rows.withColumn("before", before).filter(F.col("before").isNotNull()).select("file_path", hamming(F.col("v"), F.col("before")).alias("bits"))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, root: str) -> DataFrame:
    """Events per day and type, counted by a stream over the table's file and read when it has caught up."""
    from lumarank.streaming.progress import run_to_table, rate_windows

    schema = table(spark, root, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(root)
    return run_to_table(rate_windows(stream, "ts", "1 day", None, "1 day", ["event_type"]), "complete").select("start", "event_type", "n")


@query("event_sessions_stream", _ISL + "SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS members FROM i GROUP BY user_id, island")
def event_sessions_stream(spark: SparkSession, root: str) -> DataFrame:
    """Bursts of events found by a stream; nearly as many as events, so files hold them."""
    from lumarank.streaming.progress import all_bursts, run_to_files

    schema = table(spark, root, "events").schema
    # a pattern: only then may a stream's path be a file as well as a folder
    stream = spark.readStream.schema(schema).parquet(f"{root}/events.parque[t]")
    return run_to_files(all_bursts(stream, "ts", "event_id", ["user_id"], "30 minutes"))
