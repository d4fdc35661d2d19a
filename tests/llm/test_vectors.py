from __future__ import annotations

import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from dossier.llm import block_topk, hnsw, queries

FOLDER = "/root/testdata/sf0.1"

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def table(spark, x, extra=()):
    rows = [(i, [float(v) for v in row], "s", 1) for i, row in enumerate(x)]
    return spark.createDataFrame(rows + list(extra), SCHEMA)


ODD = [(None, [1.0, 2.0], "", 0), (100_000, None, "", 0), (100_100, [], "", 0), (100_200, [1.0, None], "", 0), (100_300, [1.0, float("nan")], "", 0), (100_400, [float("inf"), 1.0], "", 0)]


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(size=(900, 8)), np.repeat(rng.normal(size=(1, 8)), 150, axis=0))).astype(np.float32)
    x[5] = x[100]
    return x


def test_products_equal_brute_force(spark, points, monkeypatch):
    monkeypatch.setattr(block_topk, "SHARD_ROWS", 300)
    out = block_topk.top_products(table(spark, points, ODD), every=50).toPandas()
    v = np.floor(1024 * points.astype(np.float64)).astype(np.int64)
    assert sorted(out["query_id"].unique()) == [*range(0, len(points), 50), 100_100]
    empty = out[out["query_id"] == 100_100].sort_values("rank")  # an empty vector counts as all 0
    assert empty["vec_id"].tolist() == list(range(10)) and (empty["score"] == 0).all()
    for q, own in out[out["query_id"] < 100_000].groupby("query_id"):
        s = v @ v[q]
        s, own = np.r_[s, np.zeros(100_101 - len(s), int)], own.sort_values("rank")
        best = [i for i in np.lexsort((np.arange(len(s)), -s)) if i != q and (i < len(v) or i == 100_100)][:10]
        assert own["vec_id"].tolist() == best and own["score"].tolist() == s[best].tolist() and own["rank"].tolist() == list(range(1, 11))


def test_pruning_is_exact_where_blocks_are_skipped():
    rng = np.random.default_rng(0)
    x = rng.integers(-50, 50, (640, 4)) + np.repeat(rng.integers(-2000, 2000, (10, 4)), 64, axis=0)
    cut = np.arange(0, 640, block_topk.BLOCK_ROWS)
    top, low = np.maximum.reduceat(x, cut), np.minimum.reduceat(x, cut)
    q = rng.integers(-100, 100, (20, 4))
    out, scored = block_topk.block_search(q, np.full(20, -1) - np.arange(20), x, np.arange(640), top, low, 5)
    assert scored < 0.8 * 20 * len(cut)
    floor = np.sort(q @ x.T, axis=1)[:, -5]
    known, fewer = block_topk.block_search(q, np.full(20, -1) - np.arange(20), x, np.arange(640), top, low, 5, floor)
    assert fewer <= scored and known.equals(out)
    for i in range(20):
        s = x @ q[i]
        assert out[out["query_id"] == -1 - i].sort_values(["score", "vec_id"], ascending=[False, True])["vec_id"].tolist() == np.lexsort((np.arange(640), -s))[:5].tolist()


def test_graph_recall_and_ties(spark, points, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 400)
    zero = [(200_000, [0.0] * 8, "", 0), (200_100, [1.0, 1.0], "", 0), (200_200, [1.0, 2.0], "", 0)]
    out = hnsw.nearest(table(spark, points, ODD + zero), every=50).toPandas()
    x, hits, total = points.astype(np.float64), 0, 0
    for q, own in out[out["query_id"] < 100_000].groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        own = own.sort_values("rank")
        assert np.allclose(own["score"], d[own["vec_id"]], atol=1e-12) and q not in set(own["vec_id"])
        assert own[["score", "vec_id"]].values.tolist() == sorted(own[["score", "vec_id"]].values.tolist())
        best = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        hits, total = hits + len(set(best) & set(own["vec_id"])), total + 10
    assert hits / total >= 0.95
    assert out[out["query_id"] == 200_100]["vec_id"].tolist() == [200_200] and not (out["vec_id"] == 200_000).any()
    hot = out[out["query_id"] == 900].sort_values("rank")
    assert hot["vec_id"].tolist() == list(range(901, 911)) and (hot["score"] == 0).all()


def test_products_beyond_a_long(spark):
    rows = [(0, [3e15, 1.0], "", 0), (1, [3e15, 0.0], "", 0), (2, [-3e15, 0.0], "", 0), (3, [1e200, 0.0], "", 0), (4, [0.0, 5.0], "", 0), (4, [0.0, 5.0], "", 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, rank int")
    out = block_topk.top_products(df, scale=1, every=100).toPandas()
    most = 2**63 - 1
    assert out[["rank", "vec_id", "score"]].values.tolist() == [[1, 1, most], [2, 3, most], [3, 4, 5], [4, 4, 5], [5, 2, -most]]


def test_evaluations_of_a_large_shard():
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(400, 16))[rng.integers(0, 400, 50_000)] + 0.3 * rng.normal(size=(50_000, 16))).astype(np.float32)
    graph = hnsw.Graph(x, hnsw.levels_of(np.arange(len(x)))).build()
    q = x[::500]
    found, _, evaluated = graph.search(q, hnsw.SEARCH_BEAM)
    assert evaluated / len(q) < 0.2 * len(x)
    gap = (x.astype(np.float64) ** 2).sum(1)[None] - 2 * q.astype(np.float64) @ x.T.astype(np.float64)
    best = np.argsort(gap, axis=1)[:, :11]
    assert np.mean([len(set(a) & set(b[:20])) / 11 for a, b in zip(best, found, strict=True)]) >= 0.95


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_recall_on_the_embeddings(spark):
    found = queries.op9_nearest(spark, FOLDER).toPandas()
    t = pq.read_table(f"{FOLDER}/embeddings.parquet").to_pandas()
    x, ids = np.array(t["embedding"].tolist(), np.float64), t["vec_id"].to_numpy()
    hits = total = 0
    for q, own in found.groupby("query_id"):
        d = np.where(ids == q, np.inf, ((x - x[ids == q][0]) ** 2).sum(1))
        hits, total = hits + len(set(ids[np.lexsort((ids, d))[:10]]) & set(own["vec_id"])), total + 10
    assert total == 10 * (ids % 100 == 0).sum() and hits / total >= 0.95


def test_empty(spark):
    assert hnsw.nearest(table(spark, [])).count() == 0
    assert block_topk.top_products(table(spark, [])).count() == 0
    assert hnsw.nearest(table(spark, [[1.0, 2.0]])).count() == 0
