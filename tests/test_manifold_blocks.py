"""The neighbour graph moves a vector to a block of points once, whatever the blocks, and finds the same edges."""

import numpy as np

from stemforge.operators import manifold


def test_blocks_find_the_same_edges(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(300, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vector array<float>")
    points = manifold.unit_vectors(rows, "id", "vector").cache()
    assert points.first()["norm"] > 0 and dict(points.dtypes)["raw"] == "array<float>"
    moved = []
    real = manifold._met_around

    def counted(around, members, k):
        moved.append((around.count(), members.count(), around.select("block", "id").distinct().count()))
        return real(around, members, k)

    monkeypatch.setattr(manifold, "_met_around", counted)

    def edges(block):
        return {(r["a"], r["b"], r["rank"]): r["d"] for r in manifold.neighbour_graph(points, 5, rounds=2, block=block).collect()}

    one, many = edges(1000), edges(100)
    assert len(one) == 1500 and one.keys() == many.keys() and all(abs(many[e] - d) < 1e-12 for e, d in one.items())
    assert [m for _, m, _ in moved[:2]] == [300, 300]  # with one block each vector goes to it once; before, to each of its groups
    assert all(m == distinct < groups for groups, m, distinct in moved)


def test_kept_pairs():
    a, b, d = np.array([1, 1, 1, 0, 1]), np.array([2, 3, 2, 1, 4]), np.array([0.5, 0.4, 0.5 + 1e-16, 0.1, 0.6])
    assert [x.tolist() for x in manifold._kept([(a, b, d), (a, b, d)], 2)] == [[0, 1, 1], [1, 3, 2], [0.1, 0.4, 0.5]]
