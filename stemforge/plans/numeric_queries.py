"""Vectors, positions, fields of height, time series."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import arrays, geometry
from ..operators import layout, manifold
from .registry import Tables, query

_CENTROIDS = """
    long AS (SELECT label, unnest(embedding) AS x, unnest(generate_series(0, len(embedding) - 1)) AS dim FROM embeddings),
    c AS (SELECT label, dim, avg(CAST(x AS DOUBLE)) AS value FROM long GROUP BY label, dim),
    p AS (SELECT label AS id, max(value) FILTER (dim = 0) * 100 AS x, max(value) FILTER (dim = 1) * 100 AS z, max(value) FILTER (dim = 2) * 100 AS height FROM c GROUP BY label)
"""


def _positions(t: Tables):
    """Label centroids as points: the first three dimensions, times 100."""
    c = layout.centroids(t.embeddings, "label", "embedding").where("dim < 3")
    pick = lambda d: F.max(F.when(F.col("dim") == d, F.col("value"))) * 100
    return c.groupBy(F.col("label").alias("id")).agg(pick(0).alias("x"), pick(1).alias("z"), pick(2).alias("height"))


@query("WITH long AS (SELECT label, unnest(embedding) AS x, unnest(generate_series(0, len(embedding) - 1)) AS dim FROM embeddings) SELECT label, dim, count(*) AS n, round(avg(CAST(x AS DOUBLE)), 6) AS value FROM long GROUP BY label, dim")
def centroid(spark, sf_dir):
    got = layout.centroids(Tables(spark, sf_dir).embeddings, "label", "embedding")
    return got.select("label", F.col("dim").cast("long").alias("dim"), "n", F.round("value", 6).alias("value"))


@query("""
    WITH v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings), m AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1, min(c) AS c0, max(c) AS c1 FROM v)
    SELECT vec_id, round((a - a0) / (a1 - a0), 6) AS a, round((b - b0) / (b1 - b0), 6) AS b, round((c - c0) / (c1 - c0), 6) AS c, CAST(0.5 AS DOUBLE) AS k FROM v, m
""")
def minmax_norm(spark, sf_dir):
    v = Tables(spark, sf_dir).embeddings.select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("abc")], F.lit(1.0).alias("k"))
    return layout.scaled(v, ["a", "b", "c", "k"]).select("vec_id", *[F.round(n, 6).alias(n) for n in "abck"])


@query("""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT vec_id AS id, list_sum(v[1:32]) AS x, list_sum(v[33:64]) AS z FROM v),
    d AS (SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2) AS d FROM p a JOIN p b ON a.id <> b.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM d) SELECT a, rank, b, round(d, 6) AS d FROM r WHERE rank <= 3
""")
def knn3(spark, sf_dir):
    """All vectors as points: the sums of both halves of their dimensions."""
    total = lambda first: F.aggregate(F.slice("embedding", first, 32), F.lit(0.0), lambda s, x: s + x.cast("double"))
    points = Tables(spark, sf_dir).embeddings.select(F.col("vec_id").alias("id"), total(1).alias("x"), total(33).alias("z"))
    return layout.nearest(points, 3).select("a", F.col("rank").cast("long").alias("rank"), "b", F.round("d", 6).alias("d"))


@query(f"""
    WITH {_CENTROIDS}, e AS (SELECT a.id AS a, b.id AS b, CASE WHEN (a.id + b.id) % 2 = 0 THEN 'compound' ELSE 'field' END AS kind, sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2) AS d FROM p a JOIN p b ON a.id < b.id)
    SELECT kind, count(*) AS n, round(avg(d), 6) AS avg_d, round(median(d), 6) AS median_d, round(max(d), 6) AS max_d FROM e GROUP BY kind
""")
def edge_length_stats(spark, sf_dir):
    p = _positions(Tables(spark, sf_dir))
    kind = F.when((F.col("a") + F.col("b")) % 2 == 0, "compound").otherwise("field")
    edges = p.select(F.col("id").alias("a")).join(p.select(F.col("id").alias("b")), F.col("a") < F.col("b")).withColumn("kind", kind)
    return layout.edge_lengths(edges, p).select("kind", "n", *[F.round(c, 6).alias(c) for c in ("avg_d", "median_d", "max_d")])


@query(f"WITH {_CENTROIDS} SELECT round(min(height), 6) AS min_h, round(max(height), 6) AS max_h, round(avg(height), 6) AS avg_h, round(stddev_pop(height), 6) AS std_h FROM p")
def height_stats(spark, sf_dir):
    got = layout.height_stats(_positions(Tables(spark, sf_dir)))
    return got.select(*[F.round(c, 6).alias(c) for c in got.columns])


_DISC = "SELECT s_suppkey AS id, s_acctbal / 20 AS x, CAST(s_nationkey * 20 AS DOUBLE) AS z, least(8.0, greatest(3.0, (s_suppkey % 9) * 0.8 + 2)) AS radius FROM supplier"


@query(f"""
    WITH s AS ({_DISC}) SELECT a.id AS a, b.id AS b, round(sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2), 6) AS d FROM s a JOIN s b ON a.id < b.id AND sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2) < (a.radius + b.radius) * 1.3
""")
def overlap_pairs(spark, sf_dir):
    s = Tables(spark, sf_dir).supplier
    discs = s.select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 20).alias("x"), (F.col("s_nationkey") * 20).cast("double").alias("z"), geometry.radius(F.col("s_suppkey") % 9).cast("decimal(3,1)").alias("radius"))
    return layout.overlaps(discs).select("a", "b", geometry.rounded(F.col("d"), 6).alias("d"))


_SIZED = "SELECT c_custkey AS id, c_acctbal / 10 AS x, CAST(c_nationkey * 40 AS DOUBLE) AS z, 0.125 * 2 ** (c_custkey % 12) AS r FROM customer"


def _sized(t: Tables):
    """Customers as bodies of widths from an eighth to 256."""
    return t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10).alias("x"), (F.col("c_nationkey") * 40).cast("double").alias("z"), (F.pow(F.lit(2.0), F.col("c_custkey") % 12) * 0.125).alias("radius"))


@query(f"WITH s AS ({_SIZED}) SELECT a.id AS a, b.id AS b, round(sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2), 6) AS d FROM s a JOIN s b ON a.id < b.id AND sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2) < (a.r + b.r) * 1.3")
def overlap_mixed(spark, sf_dir):
    """Overlapping discs, the largest two thousand times as wide as the smallest."""
    return layout.overlaps(_sized(Tables(spark, sf_dir))).select("a", "b", geometry.rounded(F.col("d"), 6).alias("d"))


@query(f"""
    WITH s AS ({_SIZED}), g AS (SELECT o_orderkey AS id, CAST(o_orderkey % 997 AS DOUBLE) AS x, CAST(o_custkey % 991 AS DOUBLE) AS z FROM orders),
    j AS (SELECT g.id, 1 + s.id % 9 AS h, r / 8 AS sigma, (g.x - s.x) ** 2 + (g.z - s.z) ** 2 AS d2 FROM g JOIN s ON (g.x - s.x) ** 2 + (g.z - s.z) ** 2 <= 16 * (r / 8) ** 2),
    m AS (SELECT id, max(h * exp(-d2 / (2 * sigma * sigma))) AS h FROM j GROUP BY id)
    SELECT g.id, round(greatest(-0.3, coalesce(h, -0.3)), 6) AS height FROM g LEFT JOIN m USING (id)
""")
def island_heights(spark, sf_dir):
    """Height at the place of every order among islands of all widths."""
    t = Tables(spark, sf_dir)
    islands = _sized(t).select("x", "z", (F.lit(1) + F.col("id") % 9).cast("double").alias("height"), (F.col("radius") / 8).alias("sigma"))
    grid = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 997).cast("double").alias("x"), (F.col("o_custkey") % 991).cast("double").alias("z"))
    return layout.height_field(grid, islands).select("id", F.round("height", 6).alias("height"))


@query("""
    WITH n AS (SELECT p_partkey AS id, p_size % 2 = 0 AS placed, row_number() OVER (PARTITION BY p_size % 2 = 0 ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS total, p_size AS s FROM part), c AS (SELECT *, ceil(sqrt(total)) AS cols FROM n)
    SELECT id, CASE WHEN placed THEN CAST(s AS DOUBLE) ELSE (i % cols - cols / 2) * 25.0 END AS x, CASE WHEN placed THEN -CAST(s AS DOUBLE) ELSE (floor(i / cols) - cols / 2) * 25.0 END AS z FROM c
""")
def grid_fallback(spark, sf_dir):
    """Parts of even size have a place; the others are put on a grid of their own."""
    p = Tables(spark, sf_dir).part.withColumn("placed", F.col("p_size") % 2 == 0)
    rows = p.select(F.col("p_partkey").alias("id"), F.when(F.col("placed"), F.col("p_size").cast("double")).alias("x"), F.when(F.col("placed"), -F.col("p_size").cast("double")).alias("z"))
    return layout.fallback_positions(rows, F.col("id")).select("id", "x", "z")


@query(f"""
    WITH r AS (SELECT s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
    SELECT id, round(cos(i * {2 * math.pi} / n) * least(8.0, greatest(3.0, n * 0.8 + 2)) * 0.6, 6) + 0.0 AS x, round(sin(i * {2 * math.pi} / n) * least(8.0, greatest(3.0, n * 0.8 + 2)) * 0.6, 6) + 0.0 AS z FROM r
""")
def ring_placement(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("s_nationkey")
    r = Tables(spark, sf_dir).supplier.select(F.col("s_suppkey").alias("id"), (F.row_number().over(w.orderBy("s_suppkey")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    x, z = geometry.ring_place(F.col("i"), F.col("n"), geometry.radius(F.col("n")))
    return r.select("id", (F.round(x, 6) + 0.0).alias("x"), (F.round(z, 6) + 0.0).alias("z"))


@query(f"""
    WITH {_CENTROIDS}, i AS (SELECT x AS ix, z AS iz, height + 5 AS ih, 2.0 + id % 3 AS sigma FROM p), g AS (SELECT CAST(a.range AS DOUBLE) - 10 AS x, CAST(b.range AS DOUBLE) - 10 AS z FROM range(21) a, range(21) b)
    SELECT g.x, g.z, round(greatest(-0.3, coalesce(max(CASE WHEN (g.x - ix) ** 2 + (g.z - iz) ** 2 <= 16 * sigma * sigma THEN ih * exp(-((g.x - ix) ** 2 + (g.z - iz) ** 2) / (2 * sigma * sigma)) END), -0.3)), 6) AS height FROM g, i GROUP BY g.x, g.z
""")
def gaussian_field(spark, sf_dir):
    islands = _positions(Tables(spark, sf_dir)).select("x", "z", (F.col("height") + 5).alias("height"), (F.lit(2.0) + F.col("id") % 3).alias("sigma"))
    axis = spark.range(21)
    grid = axis.select((F.col("id") - 10).cast("double").alias("x")).crossJoin(axis.select((F.col("id") - 10).cast("double").alias("z")))
    return layout.height_field(grid, islands).select("x", "z", F.round("height", 6).alias("height"))


@query()
def perlin_fbm(spark, sf_dir):
    axis = spark.range(32)
    grid = axis.select((F.col("id") * 0.17).alias("x")).crossJoin(axis.select((F.col("id") * 0.23).alias("y")))
    return grid.select("x", "y", F.round(geometry.fractal_noise(F.col("x"), F.col("y")), 6).alias("value"))


def _ramp_sql(channel: int) -> str:
    stops = [(f"({h}e0)", f"({c[channel]}e0)") for h, c in geometry.RAMP]
    steps = " ".join(f"WHEN h <= {h1} THEN {c0} + ({c1} - {c0}) * (h - {h0}) / ({h1} - {h0})" for (h0, c0), (h1, c1) in zip(stops, stops[1:], strict=False))
    return f"round(CASE WHEN h <= {stops[0][0]} THEN {stops[0][1]} WHEN h >= {stops[-1][0]} THEN {stops[-1][1]} {steps} END, 4)"


@query(f"WITH c AS (SELECT c_custkey AS id, c_acctbal / 700 - 1 AS h FROM customer) SELECT id, {_ramp_sql(0)} AS r, {_ramp_sql(1)} AS g, {_ramp_sql(2)} AS b FROM c")
def ramp_colour(spark, sf_dir):
    rows = Tables(spark, sf_dir).customer.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 700 - 1).alias("h"))
    return rows.select("id", *[F.round(geometry.ramp_channel(F.col("h"), i), 4).alias(n) for i, n in enumerate("rgb")])


@query("""
    WITH RECURSIVE p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS z FROM embeddings),
    e AS (SELECT row_number() OVER (ORDER BY (p.vec_id * 37) % 101, p.vec_id) - 1 AS n, p.i AS a, q.i AS b, 0.02 * [CAST(3 AS DOUBLE), 0.3, 0.5, 0.1][(p.vec_id % 4 + 1)::INT] AS w FROM p JOIN p q ON q.vec_id = p.vec_id + 1),
    r(s, xs, zs) AS (SELECT CAST(0 AS BIGINT), (SELECT list(x ORDER BY i) FROM p), (SELECT list(z ORDER BY i) FROM p) UNION ALL
        SELECT s + 1, list_transform(xs, lambda v, j: CASE WHEN j = a AND d >= 1 THEN v + dx / d * pull WHEN j = b AND d >= 1 THEN v - dx / d * pull ELSE v END),
               list_transform(zs, lambda v, j: CASE WHEN j = a AND d >= 1 THEN v + dz / d * pull WHEN j = b AND d >= 1 THEN v - dz / d * pull ELSE v END)
        FROM (SELECT *, least(w * d, 5) AS pull FROM (SELECT *, sqrt(dx * dx + dz * dz) AS d FROM (SELECT s, xs, zs, a, b, w, xs[b] - xs[a] AS dx, zs[b] - zs[a] AS dz FROM r JOIN e ON e.n = r.s % (SELECT count(*) FROM e) WHERE r.s < 2 * (SELECT count(*) FROM e))))),
    f AS (SELECT xs, zs FROM r ORDER BY s DESC LIMIT 1)
    SELECT vec_id, round(xs[i], 9) AS x, round(zs[i], 9) AS z FROM p, f
""")
def ordered_nudge(spark, sf_dir):
    """Neighbours by id pulled together in a mixed order, twice over: each pull sees those before it."""
    v = Tables(spark, sf_dir).embeddings
    key = F.col("vec_id")
    points = v.select(key.alias("id"), (F.col("embedding")[0].cast("double") * 100).alias("x"), (F.col("embedding")[1].cast("double") * 100).alias("z"))
    kinds = F.element_at(F.array(*[F.lit(k) for k in layout.EDGE_WEIGHTS]), (key % 4 + 1).cast("int"))
    edges = v.select(key.alias("a"), (key + 1).alias("b"), F.struct((key * 37 % 101).alias("k"), key.alias("id")).alias("ord"), kinds.alias("kind"))
    return layout.nudge_in_order(points, edges, 2).select(F.col("id").alias("vec_id"), F.round("x", 9).alias("x"), F.round("z", 9).alias("z"))


@query("""
    WITH d AS (SELECT user_id, CAST(date_part('year', ts) AS INTEGER) - CAST(CASE WHEN event_type = 'error' THEN 600 ELSE 0 END AS INTEGER) AS year, sum(CAST(value AS DECIMAL(18, 2))) AS f FROM events GROUP BY ALL)
    SELECT user_id, year, CAST(f AS DOUBLE) AS f FROM d WHERE year > 1500
""")
def freq_series(spark, sf_dir):
    """Yearly sums as text fields; years up to 1500 and fields that are no numbers are dropped."""
    year = F.year("ts") - F.when(F.col("event_type") == "error", 600).otherwise(0)
    sums = Tables(spark, sf_dir).events.groupBy("user_id", year.alias("year")).agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("f"))
    points = sums.groupBy("user_id").agg(F.collect_list(F.struct(F.col("year").cast("string").alias("year"), F.col("f").cast("string").alias("f"))).alias("points"))
    return points.select("user_id", F.explode(arrays.frequency_points(F.col("points"))).alias("p")).select("user_id", "p.year", "p.f")


@query("""
    WITH s AS (SELECT s_suppkey AS id, s_acctbal / 20 AS x, CAST(s_nationkey AS DOUBLE) AS y, CAST(s_suppkey % 50 AS DOUBLE) AS z FROM supplier), n AS (SELECT a.id, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz FROM s a JOIN s b ON b.id = a.id + 1)
    SELECT id, round((ax + bx) / 2, 6) AS mid_x, round((ay + by_) / 2, 6) AS mid_y, round((az + bz) / 2, 6) AS mid_z, round(sqrt((bx - ax) ** 2 + (by_ - ay) ** 2 + (bz - az) ** 2), 6) AS length,
           round(atan2(bx - ax, bz - az), 6) AS yaw, round(atan2(by_ - ay, sqrt((bx - ax) ** 2 + (bz - az) ** 2)), 6) AS pitch FROM n
""")
def bridge_geometry(spark, sf_dir):
    s = Tables(spark, sf_dir).supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 20).alias("x"), F.col("s_nationkey").cast("double").alias("y"), (F.col("s_suppkey") % 50).cast("double").alias("z"))
    n = s.join(s.select((F.col("id") - 1).alias("id"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz")), "id")
    return n.select("id", *[F.round(c, 6).alias(k) for k, c in geometry.bridge(*map(F.col, ("x", "y", "z", "bx", "by", "bz"))).items()])


@query()
def pca_layout(spark, sf_dir):
    """Principal components; the sign of each is fixed by its largest member, so that runs agree."""
    v = Tables(spark, sf_dir).embeddings.select("vec_id", F.col("embedding").alias("vector"))
    return layout.reduced(v).select("vec_id", *[F.round(F.abs(F.col("position")[i]), 4).alias(n) for i, n in enumerate(("x", "z", "height"))])


@query()
def manifold_layout(spark, sf_dir):
    """All vectors, in all dimensions, reduced by the graph of their nearest neighbours and fitted into the world."""
    found = manifold.manifold(Tables(spark, sf_dir).embeddings, "vec_id", "embedding")
    return layout.world_place(found.select(F.col("id").alias("vec_id"), *[F.col("p")[i].alias(c) for i, c in enumerate(("x", "z", "height"))]))


@query()
def refined_layout(spark, sf_dir):
    """Nudge along edges as often as the operator does, separate, fit into the world."""
    p = _positions(Tables(spark, sf_dir)).withColumn("radius", F.lit(3.0))
    edges = p.select(F.col("id").alias("a")).join(p.select(F.col("id").alias("b")), F.col("a") < F.col("b")).withColumn("kind", F.lit("compound"))
    return layout.world_fit(layout.separate(layout.nudge(p, edges)))
