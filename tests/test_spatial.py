"""Neighbours and overlaps against brute force: dense spots, ties, mixed sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemforge.operators import layout, spatial


def brute(ids, x, k):
    out = {}
    for i, (p, q) in enumerate(x):
        d = np.hypot(x[:, 0] - p, x[:, 1] - q)
        d[i] = np.inf
        near = np.lexsort((ids, d))[: min(k, len(ids) - 1)]
        out[ids[i]] = [(int(ids[j]), round(float(d[j]), 9)) for j in near]
    return out


def found(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r["a"], r["rank"])):
        out.setdefault(r["a"], []).append((r["b"], round(r["d"], 9)))
    return out


def points(seed, n):
    """Half in one spot, a tight cluster, a lattice with many ties, a few far away."""
    rng = np.random.default_rng(seed)
    spot = np.full((n // 2, 2), 7.25)
    tight = 1e-6 * rng.normal(size=(n // 5, 2)) + 3
    lattice = np.stack(np.meshgrid(np.arange(25), np.arange(20)), -1).reshape(-1, 2) * 1.0
    far = rng.uniform(-1e6, 1e6, (n // 10, 2))
    x = np.concatenate([spot, tight, lattice, far])
    return rng.permutation(len(x)), x


def test_nearest_at_any_density(spark):
    ids, x = points(1, 2000)
    frame = spark.createDataFrame([(int(i), float(p), float(q)) for i, (p, q) in zip(ids, x, strict=True)], "id long, x double, z double").repartition(5)
    got = found(spatial.nearest(frame, 3, leaf=16, fan=4))
    assert got == brute(ids, x, 3)


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_nearest_of_few(spark, n):
    rows = [(i, float(i % 3), 0.0) for i in range(n)]
    frame = spark.createDataFrame(rows + [(90, None, 1.0), (91, float("nan"), 1.0)], "id long, x double, z double")
    got = found(layout.nearest(frame, 3))
    assert got == ({} if n < 2 else brute(np.arange(n), np.array([r[1:] for r in rows]), 3))


def test_cells_are_bounded(spark):
    ids, x = points(2, 100_000)
    frame = spark.createDataFrame([(float(p), float(q)) for p, q in np.unique(x, axis=0)], "x double, z double")
    sizes = [r["count"] for r in spatial.cells_of(frame, 64).groupBy("cell").count().collect()]
    assert max(sizes) < 128 and min(sizes) >= 64 and sum(sizes) == len(np.unique(x, axis=0))


def test_overlaps_of_mixed_sizes(spark):
    rng = np.random.default_rng(3)
    discs = [(i, float(p), float(q), float(r)) for i, (p, q, r) in enumerate(zip(rng.uniform(-300, 300, 400), rng.uniform(-300, 300, 400), rng.choice([0.5, 2, 3, 8, 30], 400), strict=True))]
    discs += [(1000, 0.0, 0.0, 100.0), (1001, 145.0, 0.0, 30.0), (1002, 500.0, 500.0, 0.0), (1003, None, 1.0, 5.0), (1004, 0.25, 0.25, 0.001)]
    frame = spark.createDataFrame(discs, "id int, x double, z double, radius double").repartition(4)
    got = [(r["a"], r["b"]) for r in layout.overlaps(frame).collect()]
    whole = [d for d in discs if d[1] is not None and d[3] > 0]
    expected = {(a[0], b[0]) for a in whole for b in whole if a[0] < b[0] and np.hypot(a[1] - b[1], a[2] - b[2]) < (a[3] + b[3]) * 1.3}
    assert len(got) == len(set(got)) and set(got) == expected
    two = spark.createDataFrame([(1, 0.0, 0.0, 30.0), (3, 45.0, 0.0, 30.0)], "id int, x double, z double, radius double")
    assert [(r["a"], r["b"]) for r in layout.overlaps(two).collect()] == [(1, 3)] and layout.overlaps(two.where("id = 9")).count() == 0


def test_heights_of_mixed_spreads(spark):
    rng = np.random.default_rng(4)
    islands = [(float(a), float(b), float(h), float(s)) for a, b, h, s in zip(rng.uniform(-50, 50, 40), rng.uniform(-50, 50, 40), rng.uniform(1, 9, 40), rng.choice([0.05, 0.5, 2, 300], 40), strict=True)]
    grid = [(float(a), float(b)) for a in range(-60, 61, 6) for b in range(-60, 61, 6)]
    got = {(r["x"], r["z"]): r["height"] for r in layout.height_field(spark.createDataFrame(grid, "x double, z double"), spark.createDataFrame(islands, "x double, z double, height double, sigma double")).collect()}
    for x, z in grid:
        lifts = [h * np.exp(-((x - a) ** 2 + (z - b) ** 2) / (2 * s * s)) for a, b, h, s in islands if (x - a) ** 2 + (z - b) ** 2 <= 16 * s * s]
        assert got[(x, z)] == pytest.approx(max([-0.3, *lifts]))
    bare = layout.height_field(spark.createDataFrame(grid[:2], "x double, z double"), spark.createDataFrame([], "x double, z double, height double, sigma double"))
    assert {r["height"] for r in bare.select(F.round("height", 3).alias("height")).collect()} == {-0.3}


def test_touching_discs_do_not_overlap(spark, tmp_path):
    """Discs at just their spaced radii: 6 * 1.3 is over 7.8 as a float."""
    import duckdb

    from stemforge import plans

    rows = [(9, "a", 1, 0.0), (18, "b", 1, 156.0), (27, "c", 1, 311.98), (36, "d", 2, 156.0)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    got = sorted((r["a"], r["b"], r["d"]) for r in plans.QUERIES["overlap_pairs"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(plans.ORACLE_SQL["overlap_pairs"]).fetchall()) == [(18, 27, 7.799)]


def test_pairs_of_one_cell_are_many_tasks(spark):
    """All discs in one cell of their level: no task makes more than half of the pairs."""
    rows = [(i, (i % 60) * 0.5, (i // 60) * 0.5, 25.0) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id int, x double, z double, radius double").coalesce(1)
    made = [r["count"] for r in layout.overlaps(frame).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 3000 * 2999 // 2 and max(made) < sum(made) / 2


def test_pairs_of_groups_are_compared_only_if_they_can_repeat(spark):
    from stemforge.operators import graph

    alone = spark.range(400).select((F.col("id") % 2).alias("g"), F.col("id").alias("m"))
    got = graph.co_members(alone, "g", "m")
    assert "keys=[a#" not in got._jdf.queryExecution().toString() and got.count() == 2 * 200 * 199 // 2
    shared = alone.union(spark.createDataFrame([(7, m) for m in (0, 2, 4, 5)], "g long, m long"))
    pairs = [tuple(r) for r in graph.co_members(shared, "g", "m").collect()]
    assert len(pairs) == len(set(pairs)) == 2 * 200 * 199 // 2 + 3  # 5 is with 0, 2 and 4 in the third group alone


def test_bodies_are_not_broadcast(spark):
    """Bodies are spread over nine cells each, of which their small file says nothing."""
    grid = spark.range(50).select(F.col("id").cast("double").alias("x"), F.lit(0.0).alias("z"))
    met = spatial.in_reach(grid, grid.withColumn("reach", F.lit(2.0)), "reach")
    assert "SortMergeJoin" in met._jdf.queryExecution().toString() and met.where("abs(x - i_x) <= 2").count() == 50 * 5 - 6


def test_rows_dealt_grow_as_the_input(spark, monkeypatch):
    """Twice the rows of a key are four times the pairs, but twice the rows that are shuffled; rows without a partner stay."""
    from stemforge.operators import pairs

    kind = type(spark.range(1))
    dealt, repartition = [], kind.repartition

    def counted(rows, *by):
        dealt[-1] += rows.count()
        return repartition(rows, *by)

    monkeypatch.setattr(kind, "repartition", counted)
    for n in (100_000, 200_000):
        rows = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("a"))
        alone = spark.range(50_000).select((F.col("id") + 2).cast("int").alias("g"), F.col("id").alias("a"))
        dealt.append(0)
        pairs.meet(rows.union(alone), rows.withColumnRenamed("a", "b"), ["g"], ["a"], ["b"])
    assert dealt[1] <= 2.1 * dealt[0] and dealt[0] <= 2 * 100_000 * 32


def test_blocks_are_bounded(spark):
    from stemforge.operators import pairs

    assert [pairs.block_rows(n) for n in (0, 1e9, 2.0**38, 1e30)] == [2048, 2048, 2**14, 2**17]


def test_pairs_of_larger_blocks_are_whole(spark, monkeypatch):
    """Blocks that grow with the pairs lose and repeat none."""
    from stemforge.operators import pairs

    monkeypatch.setattr(pairs, "PLACES", 9)
    rows = spark.range(600).select((F.col("id") % 3).alias("g"), F.col("id").alias("a"))
    met = pairs.meet(rows, rows.where("g < 2").withColumnRenamed("a", "b"), ["g"], ["a"], ["b"], block=7)
    assert met.count() == met.distinct().count() == 2 * 200 * 200


def test_distances_are_rounded_as_in_sql(spark):
    """Halves and what lies just beside them."""
    import duckdb

    from stemforge.functions import geometry

    values = [0.0, 2.5e-7, 5e-7, 4.9999999999999996e-7, 1.5e-6, 2.5e-6, 0.1, 1 / 3, 665.5999995, 665.59999949999, 316.1234565, 123456.7890125]
    got = spark.createDataFrame([(v,) for v in values], "d double").select(geometry.rounded(F.col("d"), 6).alias("d")).collect()
    assert [r["d"] for r in got] == [duckdb.execute(f"SELECT round({v!r}::DOUBLE, 6)").fetchone()[0] for v in values]
