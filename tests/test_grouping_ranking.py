from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lumarank.operators import grouping as G
from lumarank.operators import ranking as R

T0 = datetime(2024, 1, 1, 10, 0, 0)


def times(spark, *seconds):
    return spark.createDataFrame([(chr(97 + i), None if s is None else T0 + timedelta(seconds=s)) for i, s in enumerate(seconds)], "file string, ts timestamp_ntz")


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.island, set()).add(r.file)
    return sorted(sorted(v) for v in out.values())


def test_islands(spark):
    assert groups(G.time_islands(times(spark, 0, 20, 60), "ts", "file", 30)) == [["a", "b"], ["c"]]
    assert groups(G.time_islands(times(spark, 60, 0, 30), "ts", "file", 30)) == [["a", "b", "c"]]
    assert groups(G.time_islands(times(spark, 0, None, 5, None), "ts", "file", 30)) == [["a", "c"], ["b"], ["d"]]


def test_islands_across_midnight(spark):
    day = 14 * 3600
    df = times(spark, day - 10, day + 5, day + 10, day + 100, 2 * 86400 + day)
    whole = groups(G.time_islands(df, "ts", "file", 30))
    assert whole == [["a", "b", "c"], ["d"], ["e"]]
    one = df.withColumn("k", F.lit(1))
    assert groups(G.time_islands(one, "ts", "file", 30, ["k"])) == whole


def test_merge_by_hash_of_edges_only(spark):
    df = times(spark, 0, 10, 50, 60).withColumn("h", F.when(F.col("file").isin("b", "c"), F.lit(0)).otherwise(F.lit(-1)).cast("bigint"))
    edges = G.island_edges(G.time_islands(df, "ts", "file", 30), "ts", "file", ["h"])
    merged = G.merged_islands(edges, G.similar_edges("h"), max_gap_seconds=600)
    assert [r.group_seq for r in merged.collect()] == [1, 1]
    assert {r.group_seq for r in G.merged_islands(edges, G.similar_edges("h"), max_gap_seconds=30).collect()} == {1, 2}


def test_merge_by_vector(spark):
    df = times(spark, 0, 100).withColumn("v", F.when(F.col("file") == "a", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.95), F.lit(0.05))))
    edges = G.island_edges(G.time_islands(df, "ts", "file", 30), "ts", "file", ["v"])
    assert {r.group_seq for r in G.merged_islands(edges, G.similar_edges(vector_column="v")).collect()} == {1}


def rows(spark, *values):
    return spark.createDataFrame([(*v,) for v in values], "g string, f string, s double, decision string, reasons array<string>")


def test_rank_and_fallback(spark):
    df = rows(spark, ("x", "a", 5.0, "reject", []), ("x", "b", 5.0, "reject", []), ("x", "c", None, "reject", []), ("y", "d", 1.0, "reject", ["blur"]), ("y", "e", 4.0, "reject", []), ("z", "k", 9.0, "keep", []))
    ranked = {r.f: (r.rank, r.size) for r in R.ranked(df, ["g"], "s", ["f"]).collect()}
    assert ranked == {"a": (1, 3), "b": (2, 3), "c": (3, 3), "e": (1, 2), "d": (2, 2), "k": (1, 1)}
    after = {r.f: (r.decision, r.reasons) for r in R.best_of_group_reviewed(df, ["g"], "s", ["f"]).collect()}
    assert after["a"] == ("review", ["top1_review_fallback"]) and after["b"][0] == "reject" and after["e"][0] == "reject" and after["k"][0] == "keep"


def test_guard_and_complete(spark):
    df = rows(spark, ("x", "a", 5.0, "keep", []), ("x", "b", 4.0, None, []), ("y", "c", 7.0, "keep", []))
    assert {r.f: r.guarded for r in R.guarded(df, ["g"], "s", ["f"], 6.0).collect()} == {"a": 6.0, "b": 4.0, "c": 7.0}
    assert {r.g: r.complete for r in R.complete_groups(df, ["g"], F.col("decision") == "keep").collect()} == {"x": False, "y": True}


def test_lowest_values_and_pages(spark):
    df = spark.createDataFrame([(3.0, 1.0, 1.0, None)], "a double, b double, c double, d double")
    low = R.lowest_values({c: F.col(c) for c in df.columns}, 2)
    high = R.lowest_values({c: F.col(c) for c in df.columns}, 1, descending=True)
    assert tuple(df.select(low.alias("l"), high.alias("h")).first()) == (["b", "c"], ["a"])
    assert [r.id for r in R.page(spark.range(10), [F.desc("id")], 2, 3).collect()] == [6, 5, 4]
    assert R.page_count(0, 48) == 1 and R.page_count(49, 48) == 2


def test_boundary_rows_only_reach_the_merge(spark):
    """The plan aggregates to one row per island before any edge is compared."""
    df = times(spark, *range(0, 300, 10)).withColumn("h", F.lit(1).cast("bigint"))
    edges = G.island_edges(G.time_islands(df, "ts", "file", 30), "ts", "file", ["h"])
    assert edges.count() == 1


def test_large_groups_are_ordered_in_pieces(spark):
    """One group of a third of the rows, with ties and missing scores, numbered like the small ones."""
    rows = [("hot" if i % 3 == 0 else f"g{i % 7}", f"f{i:04d}", None if i % 11 == 0 else float(i * 37 % 10)) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, f string, s double").repartition(6)
    windows = {r.f: (r.rank, r.size) for r in R.ranked(df, ["g"], "s", ["f"]).collect()}
    pieces = {r.f: (r.rank, r.size) for r in R.ranked(df, ["g"], "s", ["f"], hot_rows=200).collect()}
    assert pieces == windows and len(windows) == 900 and windows["f0003"][1] == 300


def test_merge_without_partition_is_chained_over_days(spark):
    seconds = [i * 4 * 3600 + (i % 3) * 100 for i in range(40)] + [None] * 5
    df = spark.createDataFrame([(f"f{i:02d}", None if s is None else T0 + timedelta(seconds=s)) for i, s in enumerate(seconds)], "file string, ts timestamp_ntz").withColumn("h", (F.substring("file", 2, 2).cast("bigint") / 5).cast("bigint") * 0)
    edges = G.island_edges(G.time_islands(df, "ts", "file", 30), "ts", "file", ["h"])
    gap = 4 * 3600 + 50
    chained = {r["first"].item: r.group_seq for r in G.merged_islands(edges, G.similar_edges("h"), max_gap_seconds=gap).collect()}
    whole = {r["first"].item: r.group_seq for r in G.merged_islands(edges.withColumn("k", F.lit(1)), G.similar_edges("h"), ["k"], gap).collect()}
    assert chained == whole and 5 < len(set(whole.values())) < 45


def test_names_of_groups_run_over_batches(spark):
    import hashlib

    rows = [("hot", f"p{i:05d}") for i in range(25_000)] + [("a", "x"), ("a", None), ("b", None), (None, "y"), (None, "z")]
    df = spark.createDataFrame(rows, "g string, p string").repartition(5)
    got = {r.g: (r.group_id, r.members) for r in G.named_groups(df, ["g"], "p").collect()}
    name = lambda *paths: "group_" + hashlib.sha256("\x00".join(sorted(paths)).encode()).hexdigest()[:16]
    assert got == {"hot": (name(*[p for g, p in rows if g == "hot"]), 25_000), "a": (name("x"), 2), "b": (name(), 1), None: (name("y", "z"), 2)}
