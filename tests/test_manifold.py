"""Neighbour graph and layout against brute force: recall, weights, and how well neighbourhoods survive."""

import math

import numpy as np
import pytest

from stemforge.operators import layout, manifold


def ranks(x, cosine):
    if cosine:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = 1 - x @ x.T
    else:
        d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")


def trustworthiness(before, after, k=15):
    """One less the penalty for points that are near after, but were not among the k nearest before."""
    n = len(before)
    order = np.empty_like(before)
    order[np.arange(n)[:, None], before] = np.arange(n)
    late = np.maximum(np.take_along_axis(order, after[:, :k], 1) - k + 1, 0)
    return 1 - late.sum() * 2 / (n * k * (2 * n - 3 * k - 1))


@pytest.fixture(scope="module")
def vectors(spark, small):
    return spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").cache()


def test_recall_of_the_descent(spark, vectors):
    points = manifold.unit_vectors(vectors, "vec_id", "embedding")
    stats = []
    got = manifold.neighbour_graph(points, stats=stats).toPandas()
    rows = sorted(vectors.collect(), key=lambda r: r["vec_id"])
    ids = np.array([r["vec_id"] for r in rows])
    near = ids[ranks(np.array([r["embedding"] for r in rows], float), True)[:, :15]]
    expected = {(int(a), int(b)) for a, bs in zip(ids, near, strict=True) for b in bs}
    assert (got.groupby("a").size() == 15).all() and (got["a"] != got["b"]).all() and stats[-1] < stats[0]
    assert len(expected & set(zip(got["a"], got["b"], strict=True))) >= 0.9 * len(expected)


def test_layout_keeps_neighbourhoods(spark, vectors):
    rows = sorted(vectors.collect(), key=lambda r: r["vec_id"])
    before = ranks(np.array([r["embedding"] for r in rows], float), True)
    found = {r["id"]: r["p"] for r in manifold.manifold(vectors, "vec_id", "embedding", turns=10, block=150).collect()}
    plain = {r["vec_id"]: r["position"] for r in layout.reduced(vectors.withColumnRenamed("embedding", "vector")).collect()}
    after = [trustworthiness(before, ranks(np.array([p[r["vec_id"]] for r in rows]), False)) for p in (found, plain)]
    print(after)
    assert len(found) == len(rows) and after[0] > after[1]


def test_weights_and_curve(spark):
    graph = spark.createDataFrame([(1, 2, 0.1, 1), (1, 3, 0.4, 2), (2, 1, 0.1, 1), (2, 3, 0.2, 2), (3, 2, 0.2, 1), (3, 4, 0.9, 2)], "a long, b long, d double, rank int")
    got = {(r["a"], r["b"]): r["w"] for r in manifold.fuzzy_graph(graph, 2).collect()}
    assert got[(1, 2)] == got[(2, 1)] == pytest.approx(1.0) and got[(2, 3)] == got[(3, 2)] == pytest.approx(1.0, abs=1e-3) and (4, 3) in got
    a, b = manifold.curve(0.1)
    assert a == pytest.approx(1.577, abs=0.02) and b == pytest.approx(0.895, abs=0.01)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [math.nan, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [2.0, 0.0]), (6, [None, 1.0])]
    frame = spark.createDataFrame(rows, "id long, vector array<double>")
    assert {r["id"] for r in manifold.manifold(frame).collect()} == {1, 4, 5}
    assert manifold.manifold(frame.where("id = 3")).count() == 0 and manifold.manifold(frame.where("id = 1")).count() == 1
