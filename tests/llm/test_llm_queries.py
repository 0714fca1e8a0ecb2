"""The pN_ queries against their SQL and against brute force on the smallest data."""

import glob
import json
import os

import duckdb
import numpy as np
import pytest

from lumarank.llm import queries as Q


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = Q.QUERIES[name](spark, sf)
    got = duck.execute(Q.SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, got.fetchall()))


def test_neighbour_recall(spark, sf, duck):
    rows = duck.execute("SELECT file_path, model_key, vector_json, dims, computed_at FROM embedding_cache JOIN embedding_models USING (model_key)").fetchall()
    last = {}
    for p, m, v, d, t in rows:
        if (p, m) not in last or (t is not None and (last[p, m][2] is None or t > last[p, m][2])):
            last[p, m] = (v, d, t)
    by_model = {}
    for (p, m), (v, d, _) in last.items():
        try:
            a = np.array(json.loads(v, parse_constant=lambda x: 1 / 0), dtype=float)
        except Exception:
            continue
        if a.shape == (d,) and np.isfinite(a).all() and a.any():
            by_model.setdefault(m, []).append((p, a / np.linalg.norm(a)))
    truth = set()
    for m, own in by_model.items():
        own.sort(key=lambda x: x[0])
        mat = np.stack([v for _, v in own])
        cos = np.round(mat @ mat.T, 6)
        for i, (p, _) in enumerate(own):
            for j in [j for j in np.argsort(-cos[i], kind="stable") if j != i][:5]:
                truth.add((m, *sorted((p, own[j][0]))))
    got = {tuple(r) for r in Q.p1_found(spark, sf).select("model_key", "path_a", "path_b").collect()}
    assert len(got & truth) / len(truth) >= 0.97 and len(got - truth) / len(got) <= 0.03


def test_ids_of_all_documents(spark, sf, duck):
    tiktoken = pytest.importorskip("tiktoken")
    from lumarank.llm import bpe

    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    got = {r.doc_id: list(r.ids) for r in Q.p6_ids(spark, sf).collect()}
    assert got == {i: other.encode_ordinary(t) if t else [] for i, t in texts.items()}


def test_packing_holds_every_token(spark, sf):
    ids = {r.doc_id: len(r.ids) for r in Q.p6_ids(spark, sf).collect()}
    rows = Q.p7_packing(spark, sf).collect()
    tokens, bins = {}, {}
    for r in rows:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.token_count
        bins[r.bin_id] = bins.get(r.bin_id, 0) + r.token_count
    assert tokens == ids and max(bins.values()) <= 2048
    summary = Q.p7_summary(spark, sf).first()
    assert summary.overfull == 0 and summary.bins <= summary.least_bins + 2


def test_spam_is_a_small_share(spark, sf, duck):
    n = duck.execute("SELECT count(*) FROM documents").fetchone()[0]
    assert 0.01 * n <= Q.p8_found(spark, sf).count() <= 0.25 * n


def test_found_columns():
    import inspect

    assert "p8_found" in Q.QUERIES and inspect.isfunction(Q.QUERIES["p8_found"])
