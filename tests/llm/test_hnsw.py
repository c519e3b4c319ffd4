"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from routelens.llm.hnsw import Graph, nearest, op2_hnsw_nearest


def brute(rows, every, k):
    """(query, rank, id, distance) over rows that take part."""
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in ok:
        if q % every == 0:
            found = sorted((float(np.sqrt(((np.array(v, float) - np.array(w, float)) ** 2).sum())), i) for i, w in ok if i != q and len(w) == len(v))
            out[q] = [(i, d) for d, i in found[:k]]
    return out


def test_recall_of_one_graph():
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(1500, 24))
    graph, order = Graph.build(vectors)
    hits = 0
    for q in vectors[:60]:
        want = set(np.argsort(((vectors - q) ** 2).sum(axis=1))[:10].tolist())
        hits += len(want & set(order[graph.search(q, 64)[:10]].tolist()))
    assert hits / 600 > 0.95


@pytest.mark.parametrize("shard_rows", [40, 10_000])
def test_against_brute_force(spark, shard_rows):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(200)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, -1.0]) for i in range(60)]  # many equal vectors
    rows += [(1000, [1.0, 2.0, 3.0, -1.0]), (300, None), (400, []), (500, [0.0] * 4), (600, [1.0, None, 1.0, 1.0]), (700, [1.0, float("nan"), 1.0, 1.0]), (800, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (900, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in nearest(df, every=10, k=5, shard_rows=shard_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = {q: v for q, v in brute(rows, 10, 5).items() if v}
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        np.testing.assert_allclose([d for _, d in got[q]], [d for _, d in want[q]])


def test_empty_and_few(spark):
    df = spark.createDataFrame([(100, [1.0, 0.0]), (101, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in nearest(df).collect()] == [(100, 101)]
    assert nearest(df.limit(0)).count() == 0


def test_query_recall(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, 100, 10)
    got = op2_hnsw_nearest(spark, sf).collect()
    hit = sum((r.vec_id in {i for i, _ in want[r.query_id]}) for r in got)
    assert len(got) == 10 * len(want) and hit / len(got) > 0.95
