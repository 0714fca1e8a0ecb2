"""All queries with SQL give the SQL's rows on the smallest data."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as E
from lumarank.plans.catalog import QUERIES, SQL


def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([norm(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = duck.execute(SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_run(spark, sf, name):
    assert QUERIES[name](spark, sf).columns


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "total" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())


def test_scans_are_pruned(spark, sf):
    plan = QUERIES["scene_distribution"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "score_metadata" not in plan and "commentary" not in plan


def test_boundary_hamming_reads_hashes_however_written(spark, tmp_path):
    rows = [("/a/1", "0000000000000000"), ("/a/2", "0X0000000000000001"), ("/a/3", " 00:00:00:00-00_00 0003"), ("/a/4", "000000000000000F"), ("/a/5", "unreadable"), ("/a/6", "ffffffffffffffff"), ("/b/1", "#0000000000000001"), ("/b/2", None)]
    spark.createDataFrame([(p, h, 1) for p, h in rows], "file_path string, phash string, mtime_ns bigint").write.parquet(str(tmp_path / "visual_hash_cache.parquet"))
    assert {tuple(r) for r in QUERIES["boundary_hamming"](spark, str(tmp_path)).collect()} == {("/a/2", 1), ("/a/3", 1), ("/a/4", 2), ("/a/6", 60)}
